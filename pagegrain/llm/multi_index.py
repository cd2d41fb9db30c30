"""Approximate nearest neighbours by an inverted multi-index.

Each half of a vector is quantised by a codebook of its own, and a cell is a pair of
centroids.  A query walks the cells by summed distance (least inner product last) with
a heap until they hold a share of all entries that reached the wanted recall on a
bounded sample of queries searched exactly; the entries of those cells are reranked
on the original vectors.  Equal vectors are one entry.  Cells lie side by side in
blocks of bounded size, a large cell in several; a query goes to the blocks that its
cells touch, with the cells it wants there.  A task holds one block's entries and lets
the block's queries pass."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import materialise

K = 20
CODES = 512  # most centroids of a codebook, which grow with the root of the table; the driver knows a count for each pair of them
SAMPLE, PROBES = 16384, 128  # vectors that fit the codebooks, queries that fit the share
WANTED = 0.95  # share of the sample's true neighbours that the walked cells must hold
BLOCK = 4096  # entries that are held at once
QUERIES = 1 << 16  # queries of a block for which a task holds its entries; more have them held again


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = x[near == c].mean(0)
    return centres


def cells_of(x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    half = books[0].shape[1]
    a, b = (((c**2).sum(1) - 2 * part @ c.T).argmin(1) for part, c in zip((x[:, :half], x[:, half:]), books, strict=True))
    return a * len(books[1]) + b


def walk(q: np.ndarray, books: tuple[np.ndarray, np.ndarray], counts: np.ndarray, wanted: float) -> list[int]:
    """Cells by falling summed inner product of the halves until they hold `wanted` entries:
    the heap has the frontier of the two sorted lists of centroids."""
    half = books[0].shape[1]
    left, right = books[0] @ q[:half], books[1] @ q[half:]
    a, b = np.argsort(-left, kind="stable"), np.argsort(-right, kind="stable")
    heap, out, total = [(-(left[a[0]] + right[b[0]]), 0, 0)], [], 0
    while heap and total < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(b) + int(b[j])
        if counts[cell]:
            out.append(cell)
            total += counts[cell]
        if j + 1 < len(b):
            heapq.heappush(heap, (-(left[a[i]] + right[b[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(left[a[i + 1]] + right[b[0]]), i + 1, 0))
    return out


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def exact(q: np.ndarray, x: np.ndarray) -> float:
    """Inner product, rounded once: products of two 32-bit floats are exact in double."""
    return math.fsum((q * x).tolist())


def best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, float]]:
    """(id, score) of the k largest inner products of one query, ties to smaller ids."""
    rough = x @ q
    if not len(rough):
        return []
    least = np.partition(rough, -min(k, len(rough)))[-min(k, len(rough))]
    some = np.flatnonzero(rough >= least - 1e-9 * (1 + abs(least)))
    return sorted(((int(ids[i]), exact(q, x[i])) for i in some), key=lambda r: (-r[1], r[0]))[:k]


def rerank(batches, k: int):
    """(q, entry, score) of rows sorted by (block, side, kind, cell): a block's entries, then its queries."""
    key, held, block = None, [], None
    for batch in batches:
        if not len(batch):
            continue
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        at = np.stack([cols[n].to_numpy() for n in ("block", "side", "kind")], 1)
        ids, cell = cols["entry"].to_numpy(), cols["cell"].to_numpy()
        v = cols["v"].flatten().to_numpy().reshape(len(batch), -1)
        cuts = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]).any(1))))
        out = []
        for s, e in zip(cuts.tolist(), np.append(cuts[1:], len(batch)).tolist(), strict=True):
            if key != tuple(at[s, :2]):
                key, held, block = tuple(at[s, :2]), [], None
            if at[s, 2] == 0:
                held.append((ids[s:e], cell[s:e], v[s:e].copy()))
                continue
            if block is None:
                block = tuple(np.concatenate(c) for c in zip(*held, strict=True)) if held else ()
            if not block:
                continue
            for row in range(s, e):
                wanted = cols["cells"][row].values.to_numpy()
                first, last = np.searchsorted(block[1], wanted, "left"), np.searchsorted(block[1], wanted, "right")
                size = last - first
                place = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
                out += [(int(ids[row]), i, score) for i, score in best(v[row], block[2][place], block[0][place], k)]
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["q", "entry", "score"])


def search(vectors: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, its k
    nearest other rows by inner product, nearest first, ties to the smaller vec_id.

    Rows whose vec_id or vector is null, whose vector is zero, empty, holds null or
    non-finite components take no part, nor do those of another length than most, which have no
    inner product with the rest; repeated rows count once; fewer rows give fewer neighbours; an empty table gives an empty one."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    d = common["d"]
    rows = rows.where(F.size("v") == d).withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), "v")}).select("vec_id", "h", "g", "v")
    # equal vectors: one entry, with the k + 1 smallest ids; the window keeps so many of each task's rows before the shuffle
    small = rows.select("vec_id", "h", "g").distinct().withColumn("r", F.row_number().over(Window.partitionBy("h", "g").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    lists = small.groupBy("h", "g").agg(F.min("vec_id").alias("entry"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    first = rows.groupBy("h", "g").agg(F.min_by("v", "vec_id").alias("v"))
    asked = rows.where(F.col("vec_id") % every == 0).select("h", "g").distinct().withColumn("asked", F.lit(True))
    entries = materialise(lists.join(first, ["h", "g"]).join(asked, ["h", "g"], "left"), "entries")
    count = entries.count()
    half, codes = d // 2, max(1, min(CODES, int((count / 16) ** 0.5)))
    x = matrix(entries.select("entry", "v").orderBy(F.xxhash64("entry")).limit(SAMPLE).toPandas()["v"])
    books = (k_means(x[:, :half], codes), k_means(x[:, half:], codes))
    cells = len(books[0]) * len(books[1])
    shared = spark.sparkContext.broadcast(books)

    @F.pandas_udf("int")
    def cell_of(v: pd.Series) -> pd.Series:
        return pd.Series(cells_of(matrix(v), shared.value), dtype="int32") if len(v) else pd.Series([], dtype="int32")

    placed = materialise(entries.withColumn("cell", cell_of("v")), "cells")
    counts = np.zeros(cells, np.int64)
    for r in placed.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]

    # the share of entries to walk, from exact neighbours of a few queries
    probes = placed.where("asked").select("entry", "v").orderBy(F.xxhash64("entry", F.lit(7))).limit(PROBES).toPandas()
    if not len(probes):
        return spark.createDataFrame([], schema)
    q, own = matrix(probes["v"]), probes["entry"].to_numpy()
    tried = spark.sparkContext.broadcast((q, own))

    def nearest(batches):
        held = [[] for _ in tried.value[1]]
        for pdf in batches:
            m, ids, cell = matrix(pdf["v"]), pdf["entry"].to_numpy(), pdf["cell"].to_numpy()
            if not len(ids):
                continue
            scores = m @ tried.value[0].T
            for i in range(len(held)):
                s = np.where(ids == tried.value[1][i], -np.inf, scores[:, i])
                top = np.argpartition(-s, min(k, len(s)) - 1)[:k]
                held[i] = sorted(held[i] + [(-s[t], int(ids[t]), int(cell[t])) for t in top if np.isfinite(s[t])])[:k]
        yield pd.DataFrame([(i, s, e, c) for i, x in enumerate(held) for s, e, c in x], columns=["i", "s", "e", "cell"])

    near = placed.select("entry", "v", "cell").mapInPandas(nearest, "i int, s double, e long, cell int")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("s", "e"))).where(F.col("r") <= k).select("i", "cell").collect()
    order = [walk(x, books, counts, count) for x in q]
    before = [dict(zip(o, np.cumsum(counts[o]).tolist(), strict=True)) for o in order]
    reach = sorted(before[r["i"]][r["cell"]] for r in near)
    wanted = max(k + 1, 1 + reach[min(len(reach) - 1, int(WANTED * len(reach)))]) if reach else count  # its own entry counts, too

    # cells side by side in blocks
    whole = counts >= BLOCK
    parts = np.where(whole, -(-counts // BLOCK), 1)
    packed = np.cumsum(np.where(whole, 0, counts)) // BLOCK
    start = np.where(whole, packed[-1] + 1 + np.cumsum(np.where(whole, parts, 0)) - parts, packed)
    plan = spark.sparkContext.broadcast(tuple(x.astype(np.int32) for x in (counts, start, parts)))

    @F.pandas_udf("int")
    def block_of(cell: pd.Series, entry: pd.Series) -> pd.Series:
        _, start, parts = plan.value
        c = cell.to_numpy()
        return pd.Series((start[c] + entry.to_numpy() % parts[c]).astype("int32"))

    @F.pandas_udf("array<struct<block int, cells array<int>>>")
    def route(v: pd.Series) -> pd.Series:
        counts, start, parts = plan.value
        out = []
        for x in v:
            to: dict[int, list[int]] = {}
            for c in walk(np.asarray(x, float), shared.value, counts, wanted):
                for b in range(start[c], start[c] + parts[c]):
                    to.setdefault(b, []).append(c)
            out.append([{"block": b, "cells": sorted(c)} for b, c in to.items()])
        return pd.Series(out)

    routed = placed.where("asked").select("entry", "v", F.explode(route("v")).alias("to"))
    routed = materialise(routed.select("entry", "v", F.col("to.block").alias("block"), F.col("to.cells").alias("cells")), "routes")
    many = routed.groupBy("block").agg((1 + F.floor(F.count("*") / QUERIES)).cast("int").alias("sides")).where("sides > 1")
    many = materialise(many, "wanted-blocks")
    sides = F.coalesce("sides", F.lit(1))
    asking = routed.join(many, "block", "left").select("block", F.pmod(F.xxhash64("entry"), sides).cast("int").alias("side"), F.lit(1).alias("kind"), "entry", F.lit(-1).alias("cell"), "v", "cells")
    dealt = placed.select("entry", "v", "cell", block_of("cell", "entry").alias("block")).join(many, "block", "left")
    dealt = dealt.select("block", F.explode(F.sequence(F.lit(0), sides - 1)).alias("side"), F.lit(0).alias("kind"), "entry", "cell", "v", F.lit(None).cast("array<int>").alias("cells"))
    met = dealt.union(asking).repartition("block", "side").sortWithinPartitions("block", "side", "kind", "cell")
    got = met.mapInArrow(lambda batches: rerank(batches, k + 1), "q long, entry long, score double")
    got = got.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "entry"))).where(F.col("r") <= k + 1)
    # from entries to rows: at most (k + 1) * (k + 1) ids for a query's vector, then each query row takes its own id out
    ids = got.join(placed.select("entry", "ids"), "entry").select("q", F.explode("ids").alias("vec_id"), "score")
    ids = ids.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    answers = ids.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))
    answers = answers.join(placed.select(F.col("entry").alias("q"), "h", "g"), "q").select("h", "g", "found")
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "h", "g").distinct()
    out = queries.join(answers, ["h", "g"]).withColumn("found", F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k))
    out = out.select("query_id", F.posexplode("found").alias("at", "f"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))
