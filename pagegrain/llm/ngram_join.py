"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Documents with equal shingle sets form a class; the join runs over classes.

1. A pass over all texts makes each set's size, class id and a parity
   signature of its bits, and counts shingles in hashed slots of a fixed number: of
   some 2 million shingles that a task reads in a row, those that several sets hold.
   What is rare thus leaves no count, and slots tell frequent shingles from it at any size.
2. Those counts order shingles from rare to frequent.  Of a set of n, the first
   n - ceil(0.8 n) + 1 are its short inverted lists: a partner must be on one of
   them, whatever the order.  Lists are merged by a shuffle; a list's members go to the bucket named by
   its smallest class, which folds the many lists of one group into few buckets.
   A frequent shingle's list is salted first and its parts' buckets joined after.
3. In a bucket, in blocks of bounded size, the signatures' differing bits bound the
   overlap from above; what is left falls into groups of possible links, and a
   class is in one group.
4. A group's texts meet in blocks, whatever their number, whose inverted lists are made
   once: DivideSkip merges each query's short lists, probes the long ones for what can
   still reach the overlap and keeps sets that do.  Only links between what isn't connected yet are written, at
   most one for each member of a block, but every pair of a list is either tested or
   already connected.
5. The links' connected components are the classes' components."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import materialise, own_name
from .words import LOWER, gram_hashes, mix, pieces, prefix_sums, range_hashes, spans, utf8, word_hashes

SHINGLE = 5
PERCENT = 80  # the least similarity
BITS = 2048
SLOT_BITS, SLOT_ROWS = 22, 64
COUNTED = 1 << 21  # shingles of different sets of which those are counted that several sets hold
SALTED = 15  # lists of counts with more binary digits have parts
BLOCK = 4096  # signatures of a bucket that meet in one task
PROBED = 64  # long lists that are probed at once
PAIRS, FEW = 1 << 16, 1 << 12  # pairs of signatures that are compared at once, and so few that they are at a stroke
TEXTS, SHINGLES = 1024, 1 << 21  # texts, and shingles of them, that meet in one task
FEATURES = "doc_id long, row_key long, n int, class long, bits binary, slot int, counts binary"


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of a column of texts."""
    data, offsets = utf8(column)
    for a, b in pieces(offsets):
        at = offsets[a : b + 1]
        piece = LOWER[data[at[0] : at[-1]]]
        starts, ends, rows = spans(piece, at - at[0])
        hashes = word_hashes(piece, starts, ends)
        grams = gram_hashes(hashes, k)
        for row in range(a, b):
            first, end = rows[row - a], rows[row - a + 1]
            if end - first >= k:
                yield row, np.unique(grams[first : end - k + 1])
            elif end > first:
                sums, down = prefix_sums(hashes[first:end])
                yield row, range_hashes(sums, down, np.zeros(1, np.int64), end - first)
            else:
                yield row, np.zeros(0, np.uint64)


def class_of(shingles: np.ndarray) -> int:
    """A set's id, equal for equal sets."""
    if not len(shingles):
        return 0
    return int(mix(np.array([mix(shingles).sum() + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def least_overlap(n: int, m: int, percent: int = PERCENT) -> int:
    """The overlap that sets of n and m need: 100 * overlap >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def parity_bits(shingles: np.ndarray) -> bytes:
    """For each of 2,048 places, or of a power of 2 from twice the set's size, whether an odd number of shingles falls there."""
    width = max(BITS, 1 << (2 * len(shingles) - 1).bit_length())
    return np.packbits((np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(bool), bitorder="little").tobytes()


def slot_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def add_repeated(counts: np.ndarray, sets: list[np.ndarray]) -> None:
    """Add to the slots' counts the shingles that several of these sets hold, each so many times."""
    if not sets:
        return
    held = np.sort(np.concatenate(sets))
    first = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
    times = np.diff(np.append(first, len(held)))
    np.add.at(counts, slot_of(held[first[times > 1]]), times[times > 1].astype(counts.dtype))


def _features(batches):
    counts = np.zeros(1 << SLOT_BITS, np.uint32)
    names = [x.split()[0] for x in FEATURES.split(", ")]
    held: list = []  # of sets that differ
    seen: set = set()
    size = 0
    for batch in batches:
        sizes, classes, bits = [], [], []
        for _, s in shingle_sets(batch.column(2)):
            sizes.append(len(s))
            classes.append(class_of(s))
            bits.append(parity_bits(s) if len(s) else None)
            if len(s) and classes[-1] not in seen:
                seen.add(classes[-1])
                held.append(s)
                size += len(s)
                if size >= COUNTED:
                    add_repeated(counts, held)
                    held, seen, size = [], set(), 0
        m = len(batch)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(classes, pa.int64()), pa.array(bits, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
    add_repeated(counts, held)
    parts = counts.reshape(SLOT_ROWS, -1)
    live = np.flatnonzero(parts.any(1))
    m = len(live)
    yield pa.record_batch([pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())] + [pa.array(live, pa.int32()), pa.array([_sparse(parts[i]) for i in live], pa.binary())], names)


def _sparse(counts: np.ndarray) -> bytes:
    """The places and values of counts that aren't 0."""
    at = np.flatnonzero(counts)
    return np.stack((at.astype(np.uint32), counts[at].astype(np.uint32))).tobytes()


def _slot_levels(pdf):
    import pandas as pd

    total = np.zeros((1 << SLOT_BITS) // SLOT_ROWS, np.int64)
    for x in pdf["counts"]:
        at, n = np.frombuffer(x, np.uint32).reshape(2, -1)
        total[at] += n
    return pd.DataFrame({"slot": [pdf["slot"].iloc[0]], "levels": [np.ceil(np.log2(total + 1)).astype(np.uint8).tobytes()]})


def slot_levels(features: DataFrame) -> np.ndarray:
    """The number of binary digits of each slot's count, 0 for none.  The driver gets 2**22 bytes, however large the input."""
    levels = np.zeros((SLOT_ROWS, (1 << SLOT_BITS) // SLOT_ROWS), np.uint8)
    for row in features.where("slot is not null").select("slot", "counts").groupBy("slot").applyInPandas(_slot_levels, "slot int, levels binary").collect():
        levels[row.slot] = np.frombuffer(row.levels, np.uint8)
    return levels.ravel()


def _short_lists(levels, percent: int):
    """(key, class, hot) for each short list of each set: key is the shingle, salted if it is frequent."""

    def run(batches):
        level_of = levels.value
        for batch in batches:
            keys, classes, hot, seen = [], [], [], set()
            for _, s in shingle_sets(batch.column(0)):
                n = len(s)
                if not n or (c := class_of(s)) in seen:
                    continue
                seen.add(c)
                level = level_of[slot_of(s)].astype(np.uint64)
                order = np.argsort(level << np.uint64(58) | s >> np.uint64(6), kind="stable")[: n - -(-percent * n // 100) + 1]
                s, parts = s[order], np.maximum(level[order], np.uint64(SALTED)) - np.uint64(SALTED)
                salt = np.uint64(c & 0x7FFFFFFFFFFFFFFF) % (np.uint64(1) << parts)
                keys.append(mix(s + salt))
                classes.append(np.full(len(s), c))
                hot.append(np.where(parts > 0, s, np.uint64(0)))
            if keys:
                yield pa.record_batch([pa.array(np.concatenate(x).view(np.int64)) for x in (keys, classes, hot)], ["key", "class", "hot"])

    return run


def _buckets(batches):
    """(pivot, class, hot) of rows sorted by (key, class): the first of a key's rows is its
    pivot; lists of one row go, unless they are a part of a salted list.  Only the row
    before a batch is remembered."""
    last_key = last_pivot = last_class = last_hot = None
    pending = False  # the last row begins a list and has not been written
    for batch in batches:
        key, cls, hot = (c.to_numpy() for c in batch.columns)
        if not len(key):
            continue
        new = np.concatenate(([key[0] != last_key], key[1:] != key[:-1]))
        begin = np.flatnonzero(new)
        pivot = np.empty_like(cls)
        if not new[0]:
            pivot[: begin[0] if len(begin) else len(key)] = last_pivot
        sizes = np.diff(np.append(begin, len(key)))
        pivot[len(key) - sizes.sum() :] = np.repeat(cls[begin], sizes)
        single = new & np.concatenate((new[1:], [False])) & (hot == 0)
        held_back = bool(new[-1]) and hot[-1] == 0
        keep = ~single
        if held_back:
            keep[-1] = False
        out = [pivot[keep], cls[keep], hot[keep]]
        if pending and not new[0]:
            out = [np.concatenate(([x], y)) for x, y in zip((last_pivot, last_class, last_hot), out, strict=True)]
        pending = held_back
        last_key, last_pivot, last_class, last_hot = key[-1], pivot[-1], cls[-1], hot[-1]
        if len(out[0]):
            rows = np.unique(np.stack(out, 1), axis=0)
            yield pa.record_batch([pa.array(rows[:, i]) for i in range(3)], ["pivot", "class", "hot"])


def _groups(batches) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole groups of sorted (pivot, i, j, ..) rows, and where each group begins."""
    rest: list = []
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([*rest, batch]).combine_chunks()
        at = _begins(table)
        if len(at) > 1:
            yield table.slice(0, int(at[-1])), at[:-1]
            table = table.slice(int(at[-1])).combine_chunks()
        rest = table.to_batches()
    if rest:
        table = pa.Table.from_batches(rest).combine_chunks()
        yield table, _begins(table)


def _begins(table: pa.Table) -> np.ndarray:
    change = np.zeros(len(table), bool)
    change[0] = True
    for i in range(3):
        x = table.column(i).to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def folded(bits: list[bytes]) -> np.ndarray:
    """Parity signatures as rows of 64-bit words, all folded to the width of the shortest."""
    least = min(map(len, bits))
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, least // 8), axis=0) for x in bits])


def _near(n: np.ndarray, bits: np.ndarray, m: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    if len(n) * len(m) <= FEW:
        apart = np.bitwise_count(bits[:, None, :] ^ others[None, :, :]).sum(-1, dtype=np.int64)
    else:
        apart = np.zeros((len(n), len(m)), np.int32)
        for k in range(bits.shape[1]):
            apart += np.bitwise_count(bits[:, k, None] ^ others[None, :, k])
        apart = apart.astype(np.int64)
    near = 100 * np.minimum(n[:, None], m[None, :]) >= percent * np.maximum(n[:, None], m[None, :])
    return near & ((100 + percent) * apart <= (200 - 2 * percent) * (n[:, None] + m[None, :]))  # overlap = (total - apart) / 2 at most


def possible(n: np.ndarray, bits: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of a group can link: sizes within reach, and no more differing bits than
    a pair of these sizes may have differing shingles.  In a large group only sizes within reach are compared."""
    if len(n) ** 2 <= FEW:
        ok = _near(n, bits, n, bits, percent)
    else:
        by = np.argsort(n, kind="stable")
        n, bits = n[by], np.asfortranarray(bits[by])
        end = np.searchsorted(n, n * 100 // percent, "right")  # of the sizes within reach of each, from its own on
        held = np.zeros((len(n), len(n)), bool)
        a = 0
        while a < len(n):
            b = min(len(n), a + 256)
            while b > a + 1 and (b - a) * (int(end[b - 1]) - a) > PAIRS:
                b = (a + b) // 2
            x, y = slice(a, b), slice(a, int(end[b - 1]))
            held[x, y] = _near(n[x], bits[x], n[y], bits[y], percent)
            a = b
        held |= held.T
        back = np.argsort(by)
        ok = held[np.ix_(back, back)]
    np.fill_diagonal(ok, False)
    return ok


def tree(ok: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of a symmetric boolean matrix."""
    links, left = [], np.ones(len(ok), bool)
    for root in range(len(ok)):
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front:
            more = np.flatnonzero(ok[front.pop()] & left).tolist()
            left[more] = False
            links += [(root, k) for k in more]
            front += more
    return links


def _possible_links(percent: int):
    def run(batches):
        for table, begin in _groups(batches):
            cls, n = table.column("class").to_numpy(), table.column("n").to_numpy().astype(np.int64)
            bits = table.column("bits").to_pylist()
            out = []
            for s, e in zip(begin.tolist(), np.append(begin[1:], len(n)).tolist(), strict=True):
                if e - s == 2:
                    x, y = int(n[s]), int(n[s + 1])
                    if 100 * min(x, y) < percent * max(x, y):
                        continue
                if e - s > 1:
                    out += [(cls[s + a], cls[s + b]) for a, b in tree(possible(n[s:e], folded(bits[s:e]), percent))]
            if out:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return run


class Inverted:
    """Inverted lists of a block's sets, made once: for each element the ids of its sets, ascending."""

    def __init__(self, elements: np.ndarray, ids: np.ndarray, count: int):
        by = np.argsort(elements, kind="stable")
        elements, self.ids, self.count = elements[by], ids[by], count
        first = np.flatnonzero(np.concatenate(([True], elements[1:] != elements[:-1]))) if len(elements) else np.zeros(0, np.int64)
        self.elements, self.begin = elements[first], np.append(first, len(elements))

    @classmethod
    def of(cls, index: Mapping[int, list[int]]) -> Inverted:
        ids = np.array([k for x in index.values() for k in x], np.int64)
        return cls(np.repeat(np.array(list(index), np.uint64), [len(x) for x in index.values()]), ids, int(ids.max(initial=-1)) + 1)

    def lists(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the lists of query's elements begin, and how long they are, the shortest first."""
        at = np.searchsorted(self.elements, query)
        at = at[np.append(self.elements, np.uint64(0))[at] == query] if len(self.elements) else at[:0]
        at = at[at < len(self.elements)]
        length = self.begin[at + 1] - self.begin[at]
        by = np.argsort(length, kind="stable")
        return self.begin[at][by], length[by]

    def merged(self, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Each id's number of these lists."""
        shift = np.repeat(begin - np.cumsum(length) + length, length)
        return np.bincount(self.ids[shift + np.arange(len(shift))], minlength=self.count)


def divide_skip(query, index: Inverted | Mapping[int, list[int]], least: int, allowed: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(id, overlap) of indexed sets, of those allowed, that share at least so many of query's elements.

    The longest lists are set aside, as many as DivideSkip's rule gives; the short ones are merged,
    and ids that can't reach the rest of the threshold are skipped; the others are probed in the
    long lists, from the shortest on, as long as they can reach the threshold."""
    index = index if isinstance(index, Inverted) else Inverted.of(index)
    begin, length = index.lists(np.asarray(query, np.uint64))
    if len(length) < least:
        return []
    aside = min(least - 1, int(least / (0.0085 * np.log2(int(length[-1]) + 1) + 1)))
    short = len(length) - aside
    count = index.merged(begin[:short], length[:short])
    ids = np.flatnonzero((count >= least - aside) if allowed is None else (count >= least - aside) & allowed)
    count = count[ids]
    for a in range(short, len(length), PROBED):
        if not len(ids):
            return []
        b = min(a + PROBED, len(length))
        count = count + index.merged(begin[a:b], length[a:b])[ids]
        live = count + len(length) - b >= least
        ids, count = ids[live], count[live]
    return list(zip(ids.tolist(), count.tolist(), strict=True))


def link_group(sets: list[np.ndarray], percent: int = PERCENT, first: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what the group's links connect; places in sets.  first: which sets are of
    the first of two blocks; then links of a set of each block count alone.

    The inverted lists are made once.  Each set searches among those that the signatures allow it
    and that aren't connected with it yet; a few sets spread over the sizes search first,
    so that large components soon hold together."""
    count = len(sets)
    label, links = np.arange(count), []
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets = [sets[k] for k in order]
    sizes = np.array([len(s) for s in sets], np.int64)
    ok = possible(sizes, folded([parity_bits(s) for s in sets]), percent)
    search = listed = np.arange(count)
    if first is not None:
        first = first[order]
        ok &= first[:, None] != first[None, :]
        search, listed = np.flatnonzero(first), np.flatnonzero(~first)
    index = Inverted(np.concatenate([sets[k] for k in listed] or [np.zeros(0, np.uint64)]), np.repeat(listed, sizes[listed]), count)
    hubs = search[:: max(1, len(search) // 16)]
    for k in dict.fromkeys([*hubs.tolist(), *search.tolist()]):
        some = ok[k] & (label != label[k])
        if not some.any():
            continue
        ok[k, some] = ok[some, k] = False  # tested now
        n = int(sizes[k])
        for other, overlap in divide_skip(sets[k], index, least_overlap(n, int(sizes[some].min()), percent), some):
            if label[other] != label[k] and overlap >= least_overlap(n, int(sizes[other]), percent):
                label[label == max(label[k], label[other])] = min(label[k], label[other])
                links.append((int(order[k]), int(order[other])))
    return links


def _links(percent: int):
    def run(batches):
        for table, begin in _groups(batches):
            i, j, own, cls = (table.column(c).to_numpy() for c in ("i", "j", "own", "class"))
            text = table.column("text").combine_chunks()
            end = np.append(begin[1:], len(cls))
            out = []
            for s, e in zip(begin.tolist(), end.tolist(), strict=True):
                sets = [x for _, x in shingle_sets(text.slice(s, e - s))]
                out += [(cls[s + a], cls[s + b]) for a, b in link_group(sets, percent, own[s:e] == i[s] if i[s] != j[s] else None)]
            if out:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return run


def _in_blocks(members: DataFrame, size: str) -> DataFrame:
    """members (pivot, class, ..), a written table, dealt to pairs of blocks (i, j) of their
    bucket, each pair of members meeting in one at least, own the member's block; size is SQL for a bucket's
    number of blocks.  Only the few buckets with several are written and joined."""
    sizes = materialise(members.groupBy("pivot").agg(F.expr(f"cast({size} as int)").alias("blocks")).where("blocks > 1"), "blocks")
    dealt = members.join(sizes, "pivot", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.col("class"), F.col("blocks").cast("long")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("i", F.least("own", "o")).withColumn("j", F.greatest("own", "o"))


def ngram_classes(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(features: doc_id, row_key, n, class of every row; components: class, label of linked classes)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
    every = materialise(docs.mapInArrow(_features, FEATURES), "features")
    levels = spark.sparkContext.broadcast(slot_levels(every))
    features = every.where("slot is null").select("doc_id", "row_key", "n", "class")
    lists = docs.select("text").mapInArrow(_short_lists(levels, percent), "key long, class long, hot long")
    rows = lists.repartition("key").sortWithinPartitions("key", "class").mapInArrow(_buckets, "pivot long, class long, hot long")
    rows = materialise(rows, "short-lists")
    parts = rows.where("hot <> 0").select("hot", "pivot").distinct()
    tops = parts.join(parts.groupBy("hot").agg(F.min("pivot").alias("top")), "hot").select("pivot", "top").distinct()
    members = rows.where("hot = 0").select("pivot", "class").union(rows.where("hot <> 0").select("pivot", "class").distinct().join(tops, "pivot").select("top", "class")).distinct()
    signed = every.where("n > 0").groupBy("class").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min(F.struct("row_key", "doc_id")).alias("row"))
    signed = materialise(signed, "signatures")
    width = lambda n: F.greatest(F.lit(BITS), F.pow(F.lit(2), F.ceil(F.log2(2 * n))).cast("int"))
    least = width(F.col("n"))  # a partner that isn't smaller has this width or the next
    dealt = members.join(signed.select("class", "n"), "class").withColumn("width", F.explode(F.array_distinct(F.array(least, width(F.col("n") * (100 / percent))))))
    dealt = materialise(dealt.select(F.xxhash64("pivot", "width").alias("pivot"), "class"), "dealt")
    met = _in_blocks(dealt, f"ceil(count(*) / {BLOCK}D)").select("pivot", "i", "j", "class")
    met = met.join(signed.select("class", "n", "bits"), "class").select("pivot", "i", "j", "class", "n", "bits")
    near = met.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j").mapInArrow(_possible_links(percent), "a long, b long")
    near = connected_components(near).select(F.col("label").alias("pivot"), F.col("id").alias("class"))
    near = materialise(near.join(signed.select("class", "n"), "class").select("pivot", "class", "n"), "near")
    needed = near.select("class").join(signed.select("class", F.col("row.row_key").alias("key"), F.col("row.doc_id").alias("id")), "class")
    texts = docs.join(needed, (F.col("row_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("class", "text").dropDuplicates(["class"])
    met = _in_blocks(near, f"greatest(1, ceil(count(*) / {TEXTS}D), ceil(sum(n) / {SHINGLES}D))").select("pivot", "i", "j", "own", "class").join(texts, "class").select("pivot", "i", "j", "own", "class", "text")
    links = met.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j", "class").mapInArrow(_links(percent), "a long, b long")
    return features, connected_components(links).select(F.col("id").alias("class"), "label")


def _components(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, row_key, n, component_id of every row."""
    features, labels = ngram_classes(docs, percent)
    classes = features.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    classes = classes.join(labels, "class", "left").select("class", "least", F.coalesce("label", "class").alias("label"))
    named = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    named = classes.join(named, "label").select(F.col("class").alias("c"), "component_id")
    out = features.join(named, (features["class"] == named["c"]) & (features["n"] > 0), "left")
    return out.select("doc_id", "row_key", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def ngram_join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: links join rows whose sets of distinct
    5-word shingles have a Jaccard similarity of at least percent.

    A text of fewer words is one shingle; a null or empty one has none, links with
    nothing and is its own component.  Repeated rows share a set and thus a component.
    A row without a doc_id counts for links but names no component; if nothing in its
    component has an id, component_id is null.  An empty table gives an empty one."""
    return _components(docs, percent).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs, all columns, with one row of each component: the one with its smallest doc_id,
    once if it is repeated.  Rows without words and rows without an id stay, though
    equal rows of the latter become one."""
    decided = _components(docs, percent).where("n = 0 or doc_id is null or doc_id = component_id")
    mine, key, one, repeated = (own_name(docs, x) for x in ("kept_own_key", "kept_key", "kept_doc", "kept_repeated"))
    decided = decided.groupBy("row_key", "doc_id").agg(F.expr("count(*) > 1 and max(n) > 0").alias(repeated)).toDF(key, one, repeated)
    found = docs.withColumn(mine, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    kept = found.join(decided, (F.col(mine) == F.col(key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(one)))
    names = [F.col(f"`{name}`") for name in docs.columns]
    once = kept.where(F.col(repeated)).dropDuplicates([key, one])
    return kept.where(~F.col(repeated)).select(*names).union(once.select(*names))
