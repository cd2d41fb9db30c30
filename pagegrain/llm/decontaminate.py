"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may differ by k = m * rate edits.  Cut into k + 1 pieces, one
piece at least stands unchanged in any match, so exact hits of pieces (one automaton
over all pieces) give every place to look at, and Myers' bit-parallel algorithm
computes the edit distance there.  Texts and items are compared lower-cased, with
every run of other characters than letters and digits as one space."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE = 0.06  # edits for each character of an item
AT_ONCE = 1 << 20  # characters of items whose pieces are searched in one pass
OTHER = re.compile(r"[\W_]+")
LEAKS = "doc_id long, item_id long, distance int, n_chars int, start long"


def normal(text: str | None) -> str:
    """Words joined by one space, one space at either end; empty if there are none."""
    found = OTHER.sub(" ", (text or "").lower()).strip()
    return f" {found} " if found else ""


def cut(item: str, k: int) -> list[tuple[int, str]]:
    """item in k + 1 pieces of almost equal length, with their places."""
    edges = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the first best match of pattern with a substring of text, if its
    distance is at most `most`: Myers' bit-vectors, a column of the matrix for each character."""
    m = len(pattern)
    at: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        at[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, None
    for end, c in enumerate(text, 1):
        equal = at.get(c, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        plus = down | (full & ~(horizontal | up))
        minus = up & horizontal
        score += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1 & full, minus << 1 & full
        up = minus | (full & ~(vertical | plus))
        down = plus & vertical
        if score <= most and (best is None or score < best[0]):
            best = (score, end)
    return best


class Matcher:
    """The pieces of a bounded number of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        import ahocorasick

        self.items = [(i, n, int(len(n) * rate)) for i, text in items if (n := normal(text))]
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for row, (_, item, k) in enumerate(self.items):
            for place, piece in cut(item, k):
                pieces[piece].append((row, place))
        self.found = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.found.add_word(piece, (len(piece), places))
        self.found.make_automaton()

    def matches(self, text: str | None) -> Iterator[tuple[int, int, int, int]]:
        """(item id, distance, item's characters, start) of each item's best match in a text."""
        if not self.items or not (text := normal(text)):
            return
        windows: dict[int, list[list[int]]] = defaultdict(list)
        for end, (size, places) in self.found.iter(text):
            for row, place in places:
                _, item, k = self.items[row]
                start = end + 1 - size - place
                a, b = max(0, start - k), start + len(item) + k
                held = windows[row]
                if held and a <= held[-1][1]:
                    held[-1][0], held[-1][1] = min(a, held[-1][0]), max(b, held[-1][1])
                else:
                    held.append([a, b])
        for row, held in sorted(windows.items()):
            item_id, item, k = self.items[row]
            best = None
            for a, b in held:
                got = myers(item, text[a:b], k)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], max(0, a + got[1] - len(item)))
                    if not got[0]:
                        break
            if best:
                yield item_id, best[0], len(item), best[1]


def blocks_of_items(benchmark: DataFrame, at_most: int = AT_ONCE) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about at most so many characters, one after another on the driver."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = 1 + int(2 * total // at_most) if total > at_most else 1
    for block in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == block).orderBy("item_id", "text").collect()
        if rows:
            yield [(r.item_id, r.text) for r in rows]


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, distance, n_chars, start: a row for each row of docs and item of which
    its whole text holds a match; start is a character of the normalised text.

    Null and empty texts and items match nothing.  Repeated rows each have their own
    rows; items with equal texts all match; an empty table gives an empty one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in blocks_of_items(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, held=held):
            matcher = Matcher(held.value, rate)
            for batch in batches:
                got = [(doc.as_py(), *m) for doc, text in zip(*batch.columns, strict=True) for m in matcher.matches(text.as_py())]
                doc, item, distance, size, start = zip(*got, strict=True) if got else ((),) * 5
                yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(distance, pa.int32()), pa.array(size, pa.int32()), pa.array(start, pa.int64())], ["doc_id", "item_id", "distance", "n_chars", "start"])

        found = rows.mapInArrow(run, LEAKS)
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], LEAKS)


def _holds_item(docs: DataFrame, block: list[tuple[int, str]], rate: float) -> Column:
    held = docs.sparkSession.sparkContext.broadcast(block)
    made: list[Matcher] = []

    @F.pandas_udf("boolean")
    def holds(texts):
        if not made:
            made.append(Matcher(held.value, rate))
        return texts.map(lambda t: any(True for _ in made[0].matches(t)), na_action="ignore").fillna(False).astype(bool)

    return holds(F.col("text").cast("string"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """docs, all columns, without the rows whose text holds a match of an item."""
    for block in blocks_of_items(benchmark):
        docs = docs.where(~_holds_item(docs, block, rate))
    return docs
