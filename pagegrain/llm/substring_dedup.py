"""Substring dedup by relative Lempel-Ziv parsing against all earlier documents.

The reference is every document, cut into content-defined blocks: a block is a run
of windows (50 consecutive words) that share their smallest 8-gram hash, the
anchor.  The index maps (anchor, hash of the block's words) to the first document
that holds the block and its place there.

A document is parsed from left to right.  Where a block of it is indexed under an
earlier document, a factor begins at the block's place in that document and is
extended for as long as the following blocks continue there.  Where a block is
held only in part, which happens at the ends of a copy, each of its windows is looked
up by its own hash under the same anchor, so that a factor ends at the very word
where the copy does; a window that begins elsewhere begins a factor of its own.
Factors of at least 50 words are what earlier documents hold.

Every window lies in one block, equal windows have equal anchors, and the first
document that holds a window holds it in a block that is indexed under itself.  So the
words of all factors are exactly those of windows that also start in a document with
a smaller doc_id."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialise, own_name
from .words import gram_hashes, prefix_sums, range_hashes, texts

ANCHOR = 8
SEGMENT = 1 << 15  # windows of a document that are cut into blocks at once; a block ends at such a border
AT_ONCE = 1 << 13  # words whose bytes are joined at once
LOW = np.uint64((1 << 30) - 1)  # a place among the words of a segment
BLOCKS = "doc_id long, text_key long, start int, size int, anchor long, block long"
WINDOWS = "doc_id long, text_key long, start int, anchor long, hash long"
FACTORS = "doc_id long, text_key long, factors array<struct<start: int, size: int, source: long, source_start: int>>"


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def segment_blocks(words: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """First window, number of windows, anchor and hash of each block of a segment's word hashes."""
    n = len(words) - window + 1
    anchors = gram_hashes(words, min(ANCHOR, window))
    width = len(anchors) - n + 1
    keyed = (anchors & ~LOW) | np.arange(len(anchors), dtype=np.uint64) & LOW  # leftmost of equal ones
    least = smallest(keyed, width)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    size = np.diff(np.append(first, n))
    sums, down = prefix_sums(words)
    return first, size, anchors[(least[first] & LOW).astype(np.int64)], range_hashes(sums, down, first, size + window - 1)


def segments(n: int, window: int) -> Iterator[tuple[int, int]]:
    """Word ranges that hold each window of n words in one of them."""
    for a in range(0, n - window + 1, SEGMENT):
        yield a, min(n, a + SEGMENT + window - 1)


def _arrow(columns: list[tuple], schema: str) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*columns, strict=True)], names(schema))


def _blocks(window: int):
    def run(batches):
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            out, held = [], 0
            for row, _, _, _, hashes in texts(batch.column(2)):
                for a, b in segments(len(hashes), window):
                    first, size, anchor, block = segment_blocks(hashes[a:b], window)
                    m = len(first)
                    out.append((np.full(m, ids[row]), np.full(m, keys[row]), (first + a).astype(np.int32), size.astype(np.int32), anchor.view(np.int64), block.view(np.int64)))
                    held += m
                if held > SEGMENT:
                    yield _arrow(out, BLOCKS)
                    out, held = [], 0
            if out:
                yield _arrow(out, BLOCKS)

    return run


def _windows(window: int):
    """Every window in the listed blocks of each document."""

    def run(batches):
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            lists = batch.column(3)
            out, held = [], 0
            for row, _, _, _, hashes in texts(batch.column(2)):
                edges = lists[row].values
                every = np.stack([edges.field(i).to_numpy().astype(np.int64) for i in range(3)])
                for a, b in segments(len(hashes), window):
                    first, size, anchor = every[:, (every[0] >= a) & (every[0] < a + SEGMENT)]
                    m = int(size.sum())
                    if not m:
                        continue
                    sums, down = prefix_sums(hashes[a:b])
                    begin = np.repeat(first - a - np.cumsum(size) + size, size) + np.arange(m)
                    out.append((np.full(m, ids[row]), np.full(m, keys[row]), (begin + a).astype(np.int32), np.repeat(anchor, size), range_hashes(sums, down, begin, window).view(np.int64)))
                    held += m
                if held > SEGMENT:
                    yield _arrow(out, WINDOWS)
                    out, held = [], 0
            if out:
                yield _arrow(out, WINDOWS)

    return run


def parsed(start: np.ndarray, size: np.ndarray, source: np.ndarray, source_start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Factors (start, size, source, source_start) of one document's matches with earlier ones.

    From left to right a factor takes in the next match for as long as it begins within
    or right behind the factor and lies in the same document at the same distance."""
    order = np.lexsort((source_start, source, start))
    start, size, source, source_start = start[order], size[order], source[order], source_start[order]
    end = start + size
    begins = np.ones(len(start), bool)
    begins[1:] = (source[1:] != source[:-1]) | (source_start[1:] - start[1:] != source_start[:-1] - start[:-1]) | (start[1:] > end[:-1])
    first = np.flatnonzero(begins)
    return start[first], np.maximum.reduceat(end, first) - start[first], source[first], source_start[first]


def _parse(window: int):
    def run(batches):
        for batch in batches:
            lists, out = batch.column(2), []
            for row in range(len(batch)):
                found = parsed(*(lists[row].values.field(i).to_numpy().astype(np.int64) for i in range(4)))
                long = found[1] >= window
                out.append([c[long] for c in found])
            sizes = np.cumsum([0, *(len(c[0]) for c in out)])
            start, size, source, at = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4
            fields = [pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(source, pa.int64()), pa.array(at, pa.int32())]
            found = pa.StructArray.from_arrays(fields, ["start", "size", "source", "source_start"])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), found)], ["doc_id", "text_key", "factors"])

    return run


def text_key() -> Column:
    """With doc_id one value for each row, since ids may repeat with other texts."""
    return F.xxhash64(F.col("text").cast("string"))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.col("text").cast("string").alias("text"))


def copied_factors(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, text_key, factors array<struct<start, size, source, source_start>>): for rows that
    have any, what to remove, and the document and word where it was found.

    Rows without a doc_id take no part.  Rows with one doc_id never copy each other:
    each keeps its words unless a smaller id has them.  Equal windows within one
    document are no copies.  Texts under a window's length, null or empty ones have
    no factors; an empty table has none."""
    source = keyed(docs.where("doc_id is not null"))
    every = materialise(source.mapInArrow(_blocks(window), BLOCKS), "blocks")
    # joins below read written tables on both sides, so that AQE can split hot anchors and windows
    shared = materialise(every.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor"), "shared-anchors")
    held = materialise(every.join(shared, "anchor"), "shared-blocks")
    discard(every, shared)
    least = F.min(F.struct("doc_id", "start"))  # its parts in this order
    index = held.groupBy("anchor", "block").agg(least.alias("at")).select("anchor", "block", F.col("at.doc_id").alias("source"), F.col("at.start").alias("source_start"))
    index = materialise(index, "block-index")
    found = held.join(index, ["anchor", "block"])
    copies = found.where("source < doc_id").select("doc_id", "text_key", "start", (F.col("size") + window - 1).alias("size"), "source", "source_start")
    unsure = materialise(index.groupBy("anchor").agg(F.min("source").alias("a"), F.max("source").alias("b")).where("a < b").select("anchor"), "unsure-anchors")
    edges = found.where("source = doc_id").join(unsure, "anchor").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "size", "anchor")).alias("edges"))
    windows = source.join(edges, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "edges").mapInArrow(_windows(window), WINDOWS)
    windows = materialise(windows, "boundary-windows")
    first = windows.groupBy("anchor", "hash").agg(least.alias("at"), F.max("doc_id").alias("last")).where("at.doc_id < last")
    first = materialise(first.select("anchor", "hash", F.col("at.doc_id").alias("source"), F.col("at.start").alias("source_start")), "first-windows")
    partly = windows.join(first, ["anchor", "hash"]).where("source < doc_id").select("doc_id", "text_key", "start", F.lit(window).alias("size"), "source", "source_start")
    matches = copies.union(partly).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "size", "source", "source_start")).alias("matches"))
    factors = materialise(matches.mapInArrow(_parse(window), FACTORS), "factors")
    discard(held, index, unsure, windows, first)
    return factors


def covered(n: int, factors: pa.Scalar) -> np.ndarray:
    """Which of n words lie in a factor."""
    step = np.zeros(n + 1, np.int64)
    if factors.is_valid:
        first, size = (factors.values.field(i).to_numpy() for i in (0, 1))
        np.add.at(step, first, 1)
        np.add.at(step, first + size, -1)
    return np.cumsum(step[:-1]) > 0


def kept_parts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> Iterator[bytes]:
    """The kept words joined by one space, in parts of bounded size."""
    glue = b""
    for a in range(0, len(starts), AT_ONCE):
        b = min(len(starts), a + AT_ONCE)
        words = data[starts[a] : ends[b - 1]].tobytes().split()
        if gone[a:b].any():
            words = [words[i] for i in np.flatnonzero(~gone[a:b]).tolist()]
        if words:
            yield glue + b" ".join(words)
            glue = b" "


def _digests(batches):
    for batch in batches:
        factors, out = batch.column(2), []
        for row, data, starts, ends, _ in texts(batch.column(1)):
            gone, digest = covered(len(starts), factors[row]), hashlib.sha256()
            for part in kept_parts(data, starts, ends, gone):
                digest.update(part)
            out.append((len(starts), int(gone.sum()), digest.hexdigest()))
        n, removed, kept = zip(*out, strict=True) if out else ((), (), ())
        yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def substring_dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row, by copied_factors.

    A null or empty text has no words and the digest of no bytes; repeated rows are
    answered each; an empty table gives an empty one."""
    every = keyed(docs).join(copied_factors(docs, window), ["doc_id", "text_key"], "left")
    return every.select("doc_id", "text", "factors").mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_copies(docs: DataFrame, window: int = 50) -> DataFrame:
    """docs, all columns, with the copied words taken out of text; the words that stay
    are then joined by one space.  Other texts stay as they are, byte for byte.
    Rows without a doc_id stay unchanged; an empty table gives an empty one."""
    one, two, three = (own_name(docs, x) for x in ("factors_doc", "factors_text", "factors_found"))
    factors = copied_factors(docs, window).toDF(one, two, three)
    mine = own_name(docs, "own_text_key")
    found = docs.withColumn(mine, text_key())
    found = found.join(factors, (F.col("doc_id").cast("long") == F.col(one)) & (F.col(mine) == F.col(two)), "left")
    cut = F.pandas_udf(_cut, "string")  # only rows with factors go through Python
    text = F.when(F.col(three).isNull(), F.col("text")).otherwise(cut(F.col("text").cast("string"), F.col(three))).alias("text")
    return found.select(*[text if name == "text" else F.col(f"`{name}`") for name in docs.columns])


def _cut(column, factors):
    import pandas as pd

    found = pa.array([None if f is None else [{"start": x["start"], "size": x["size"]} for x in f] for f in factors], pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32())])))
    out: list = [None] * len(column)
    for row, data, starts, ends, _ in texts(pa.array(column, pa.string())):
        if found[row].is_valid and column.iloc[row] is not None:
            out[row] = b"".join(kept_parts(data, starts, ends, covered(len(starts), found[row]))).decode()
    return pd.Series(out, dtype=object)
