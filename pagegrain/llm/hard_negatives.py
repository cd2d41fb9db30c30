"""Hard negatives by a Voronoi-partition kNN join.

A component is added to every vector so that all have the largest norm; an anchor gets 0 there.
Then a larger inner product with an anchor is a smaller distance to it, and triangle inequalities
bound scores.  Vectors belong to the cell of their nearest pivot.  Anchors form groups
of neighbouring cells; a group knows the least and greatest distance of its anchors to each pivot and
the scores that can still matter to them.  From that follows, for each group and cell, the ring of distances
from the pivot in which a candidate may serve: a candidate is sent to those groups alone.  A group's
anchors then meet its candidates in slices of bounded size, exactly.

The join runs twice.  Positives: the score of an anchor's fifth row of its label in a bounded
sample of real rows is a floor for what it needs.  Negatives: the scores of the positives
give the range."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import materialise

PIVOTS, SAMPLE = 256, 4096  # most cells; rows that pivots and floors are taken from
GROUP, SLICE = 4096, 16384  # anchors and candidates that meet in one task
AT_ONCE = 512, 4096  # of these, in one matrix product
EXACT = 1 << 53  # whole numbers below are exact in a double
LONG = (1 << 63) - 1


def matrix(lists, width: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with zeros."""
    if isinstance(lists, pa.Array):
        at, flat = np.asarray(lists.offsets), np.asarray(lists.values.to_numpy(zero_copy_only=False), np.float64)
        at, flat = at - at[0], flat[at[0] : at[-1]]
    else:
        parts = [np.asarray(x, np.float64) for x in lists]
        at, flat = np.cumsum([0, *map(len, parts)]), np.concatenate([np.zeros(0), *parts])
    size = np.diff(at)
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - at[row]] = flat
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of vectors of whole numbers, exactly: by Python's integers where a double can't hold them, cut to a long."""
    if not q.size or not x.size or float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < EXACT:
        return (q @ x.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(q) @ whole(x).T, -LONG, LONG).astype(np.int64)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T))


def augmented(x: np.ndarray, norm: float, anchor: bool = False) -> np.ndarray:
    more = np.zeros(len(x)) if anchor else np.sqrt(np.maximum(0, norm**2 - (x**2).sum(1)))
    return np.column_stack((x, more))


def top(s: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(-score, id) of the k largest; ids ascend, so the first of equal scores have the smaller ones."""
    if len(s) > k:
        edge = np.partition(s, -k)[-k]
        over = np.flatnonzero(s > edge)
        some = np.concatenate((over, np.flatnonzero(s == edge)[: k - len(over)]))
        s, ids = s[some], ids[some]
    return sorted(zip((-int(v) for v in s), ids.tolist(), strict=True))


def meet(batches, width: int, k: int, negatives: bool) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (unit, kind): a unit's anchors, then its candidates pass in batches.
    Yields each anchor's k best candidates for each range of scores that it has."""
    unit, parts, held, best = None, [], None, {}

    def out() -> Iterator[pa.RecordBatch]:
        rows = [(*held[0][i], p, c, -s) for (i, p), found in best.items() for s, c in found]
        for a in range(0, len(rows), 1 << 16):
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows[a : a + (1 << 16)], strict=True)], ["anchor_id", "label", "h", "range", "id", "score"])

    for batch in batches:
        units, kinds = batch["unit"].to_numpy(), batch["kind"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, (units[1:] != units[:-1]) | (kinds[1:] != kinds[:-1])]) if len(units) else []
        for s, e in zip(cuts, [*cuts[1:], len(units)], strict=True):
            piece = batch.slice(s, e - s)
            if units[s] != unit:
                if held:
                    yield from out()
                unit, parts, held, best = units[s], [], None, {}
            ids, labels, x = piece["id"].to_numpy(), piece["label"].to_numpy(), matrix(piece["v"], width)
            if kinds[s] == 0:
                ranges = [[(int(x), int(y)) for x, y in zip(a or (), b or (), strict=True)] for a, b in zip(piece["low"].to_pylist(), piece["high"].to_pylist(), strict=True)]
                parts.append((list(zip(ids.tolist(), labels.tolist(), piece["h"].to_pylist(), strict=True)), labels, x, ranges))
                continue
            if not parts:
                continue
            if held is None:
                held = sum((p[0] for p in parts), []), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]), sum((p[3] for p in parts), [])
            for b in range(0, len(ids), AT_ONCE[1]):
                order = b + np.argsort(ids[b : b + AT_ONCE[1]], kind="stable")
                cid, clabel, cx = ids[order], labels[order], x[order]
                for a in range(0, len(held[0]), AT_ONCE[0]):
                    score = products(held[2][a : a + AT_ONCE[0]], cx)
                    for i in range(a, min(a + AT_ONCE[0], len(held[0]))):
                        row = score[i - a]
                        fit = (cid != held[0][i][0]) & ((clabel != held[1][i]) if negatives else (clabel == held[1][i]))
                        ranges = held[3][i]
                        if negatives:
                            fit &= (row >= min(r[0] for r in ranges)) & (row <= max(r[1] for r in ranges))
                        at = np.flatnonzero(fit)
                        if len(at):
                            near, near_id = row[at], cid[at]
                            for p, (least, most) in enumerate(ranges if negatives else [(None, None)]):
                                inside = slice(None) if least is None else (near >= least) & (near <= most)
                                found = top(near[inside], near_id[inside], k)
                                if found:
                                    best[i, p] = sorted(best.get((i, p), []) + found)[:k]
    if held:
        yield from out()


class Space:
    """What all tasks know: width, largest norm, pivots, the group that each cell's anchors belong to."""

    def __init__(self, width: int, norm: float, pivots: np.ndarray, anchors: int, group: int):
        self.width, self.norm, self.pivots = width, norm, pivots
        leaders, far = [0], distances(pivots, pivots[:1])[:, 0]
        while len(leaders) < min(len(pivots), -(-anchors // group)):
            leaders.append(int(far.argmax()))
            far = np.minimum(far, distances(pivots, pivots[leaders[-1:]])[:, 0])
        self.leader = distances(pivots, pivots[leaders]).argmin(1)

    def slack(self) -> float:
        return 1e-6 * (self.norm + float(np.abs(self.pivots).max(initial=0)))


def pivots_of(x: np.ndarray, count: int, rounds: int = 5) -> np.ndarray:
    centres = x[:count].copy()
    for _ in range(rounds):
        near = distances(x, centres).argmin(1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = x[near == c].mean(0)
    return centres


def _rings(anchors: DataFrame, space: Space, group: int) -> pd.DataFrame:
    """One row for each group of anchors(v, least, most): how many, and for each cell the ring of distances
    from its pivot in which candidates may score from least to most with one of them.  The number of groups is bounded
    by that of cells."""

    def some(batches):
        held: dict[int, list] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            q = matrix(pdf["v"], space.width)
            d, norms = distances(augmented(q, 0, True), space.pivots), (q**2).sum(1)
            # anchors that nothing bounds from below stay apart from the others
            g = 2 * space.leader[d.argmin(1)] + pdf["least"].isna().to_numpy()
            for k in np.unique(g):
                m = g == k
                rows = [[m.sum()], d[m].min(0), d[m].max(0), [norms[m].min()], [norms[m].max()], [pdf["least"][m].fillna(-np.inf).min()], [pdf["most"][m].fillna(np.inf).max()]]
                held[int(k)] = [f(a, b) for f, a, b in zip((np.add, np.minimum, np.maximum, np.minimum, np.maximum, np.minimum, np.maximum), held[int(k)], rows, strict=True)] if int(k) in held else [np.asarray(r, float) for r in rows]
        yield pd.DataFrame([(k, *(v.tolist() for v in x)) for k, x in held.items()], columns=["g", "n", "a", "b", "q", "w", "least", "most"])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        n, a, b, q, w, least, most = (f(np.stack(pdf[c]), axis=0) for c, f in (("n", np.sum), ("a", np.min), ("b", np.max), ("q", np.min), ("w", np.max), ("least", np.min), ("most", np.max)))
        far = np.sqrt(np.maximum(0, w + space.norm**2 - 2 * least))
        close = np.sqrt(np.maximum(0, q + space.norm**2 - 2 * most))
        slack = space.slack()
        return pd.DataFrame([(pdf["g"][0], int(n[0]), (np.maximum(a - far, close - b) - slack).tolist(), (b + far + slack).tolist())], columns=["g", "n", "inner", "outer"])

    parts = anchors.select("v", "least", "most").mapInPandas(some, "g int, n array<double>, a array<double>, b array<double>, q array<double>, w array<double>, least array<double>, most array<double>")
    return parts.groupBy("g").applyInPandas(whole, "g int, n long, inner array<double>, outer array<double>").orderBy("g").toPandas()


def _joined(anchors: DataFrame, placed: DataFrame, space: Space, k: int, negatives: bool, group: int, piece: int) -> DataFrame:
    """(anchor_id, label, h, range, id, score): the local joins' best, to be merged by anchor and range."""
    rings = _rings(anchors, space, group)
    spark = placed.sparkSession
    if not len(rings):
        return spark.createDataFrame([], "anchor_id long, label long, h long, range long, id long, score long")
    names, inner, outer = rings["g"].to_numpy(), np.stack(rings["inner"]), np.stack(rings["outer"])

    def groups_of(cell: np.ndarray, radius: np.ndarray) -> np.ndarray:
        return (radius[:, None] >= inner[:, cell].T) & (radius[:, None] <= outer[:, cell].T)

    def count(batches):
        total = np.zeros(len(names), np.int64)
        for pdf in batches:
            total += groups_of(pdf["cell"].to_numpy(), pdf["radius"].to_numpy()).sum(0)
        yield pd.DataFrame({"at": np.arange(len(names)), "c": total})

    sizes = dict(placed.select("cell", "radius").mapInPandas(count, "at int, c long").groupBy("at").sum("c").toDF("at", "c").collect())
    slices = np.array([max(1, -(-sizes[i] // piece)) for i in range(len(names))])
    sides = np.maximum(1, -(-rings["n"].to_numpy() // group))
    base = np.concatenate(([0], np.cumsum(slices * sides)))

    @F.pandas_udf("array<long>")
    def candidate_units(cell: pd.Series, radius: pd.Series, dealt: pd.Series) -> pd.Series:
        allowed, deal = groups_of(cell.to_numpy(), radius.to_numpy()), dealt.to_numpy()
        return pd.Series([np.concatenate([np.zeros(0, np.int64), *(base[g] + np.arange(sides[g]) * slices[g] + deal[i] % slices[g] for g in np.flatnonzero(allowed[i]))]) for i in range(len(deal))])

    @F.pandas_udf("array<long>")
    def anchor_units(v: pd.Series, least: pd.Series, dealt: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        g = 2 * space.leader[distances(augmented(matrix(v, space.width), 0, True), space.pivots).argmin(1)] + least.isna().to_numpy()
        at = np.searchsorted(names, g)
        return pd.Series([base[i] + (d % sides[i]) * slices[i] + np.arange(slices[i]) for i, d in zip(at, dealt.to_numpy(), strict=True)])

    def dealt(salt: int) -> Column:
        return F.shiftrightunsigned(F.xxhash64("id", "h", F.lit(salt)), 1)

    lists = [F.lit(None).cast("array<decimal(38,0)>").alias(c) for c in ("low", "high")]
    ask = anchors.select(F.explode(anchor_units("v", "least", dealt(1))).alias("unit"), F.lit(0).alias("kind"), "id", "label", "h", "v", *(("low", "high") if negatives else lists))
    give = placed.select(F.explode(candidate_units("cell", "radius", dealt(2))).alias("unit"), F.lit(1).alias("kind"), "id", "label", "h", "v", *lists)
    met = ask.union(give).repartition("unit").sortWithinPartitions("unit", "kind")
    width = space.width
    return met.mapInArrow(lambda batches: meet(batches, width, k, negatives), "anchor_id long, label long, h long, range long, id long, score long")


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, group: int = GROUP, piece: int = SLICE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of
    vectors(vec_id, label, v), v an array of whole numbers as doubles; `anchor` selects the anchors.

    A score is an integer inner product.  An anchor's positives are its first other rows of its
    label, its negatives for each of them the first rows of other labels with low * positive <=
    100 * score <= high * positive; higher scores first, ties by smaller vec_id.

    Rows with a null vec_id, label, vector or component take no part; rows equal in all three
    columns count once, rows of one vec_id that differ are never each other's positive or negative.  Missing
    components of shorter vectors count as zero.  Scores beyond a long count as its largest or smallest value.  Without anchors, positives or rows in the range there are no rows."""
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<double>").alias("v"), anchor.alias("anchor"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = rows.where(sound).select(F.col("vec_id").alias("id"), "label", "v", F.coalesce("anchor", F.lit(False)).alias("anchor"), F.xxhash64("v").alias("h"))
    rows = materialise(rows.groupBy("id", "label", "h", "v").agg(F.max("anchor").alias("anchor")), "vectors")
    facts = rows.agg(F.max(F.size("v")).alias("width"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("norm"), F.count("*").alias("n"), F.sum(F.col("anchor").cast("long")).alias("anchors")).first()
    if not facts["anchors"]:
        return spark.createDataFrame([], schema)
    width, norm = facts["width"], float(facts["norm"]) ** 0.5 * (1 + 1e-12)
    sample = rows.orderBy(F.xxhash64("id", "h")).limit(SAMPLE).select("id", "label", "v").toPandas()
    known = matrix(sample["v"], width)
    known_id, known_label = sample["id"].to_numpy(), sample["label"].to_numpy()
    space = Space(width, norm, pivots_of(augmented(known, norm), max(1, min(PIVOTS, len(known), int(facts["n"] ** 0.5 / 4)))), facts["anchors"], group)
    # a slice is smaller where the whole table would not keep the tasks busy
    piece = max(1024, min(piece, facts["n"] // (4 * spark.sparkContext.defaultParallelism)))

    @F.pandas_udf("struct<cell int, radius double>")
    def place(v: pd.Series) -> pd.DataFrame:
        d = distances(augmented(matrix(v, width), norm), space.pivots)
        return pd.DataFrame({"cell": d.argmin(1).astype("int32"), "radius": d.min(1)})

    @F.pandas_udf("double")
    def floor_of(v: pd.Series, own: pd.Series, label: pd.Series) -> pd.Series:
        """What the last positive scores at least: the same rank among sampled rows of the label."""
        out = np.full(len(v), np.nan)
        for a in range(0, len(v), AT_ONCE[0]):
            score = matrix(v[a : a + AT_ONCE[0]], width) @ known.T
            fit = (label.to_numpy()[a : a + AT_ONCE[0], None] == known_label) & (own.to_numpy()[a : a + AT_ONCE[0], None] != known_id)
            for i in np.flatnonzero(fit.sum(1) >= positives):
                out[a + i] = np.partition(score[i][fit[i]], -positives)[-positives]
        return pd.Series(out) - 1e-6 * norm**2

    placed = materialise(rows.withColumn("at", place("v")).select("id", "label", "h", "v", "anchor", "at.cell", "at.radius"), "placed")
    anchors = placed.where("anchor").select("id", "label", "h", "v")
    asking = materialise(anchors.withColumn("least", F.nanvl(floor_of("v", "id", "label"), F.lit(None).cast("double"))).withColumn("most", F.lit(None).cast("double")), "anchors")
    who = ["anchor_id", "label", "h"]
    found = _first(_joined(asking, placed, space, positives, False, group, piece), who, positives)
    found = found.select(*who, F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = found.withColumn("low", F.ceil(F.col("positive_score").cast("decimal(20,0)") * low / 100).cast("decimal(38,0)")).withColumn("high", F.floor(F.col("positive_score").cast("decimal(20,0)") * high / 100).cast("decimal(38,0)"))
    found = materialise(found, "positives")
    ranges = found.where("low <= high").select(*who, "low", "high").distinct().groupBy(*who).agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("of"))
    ranges = ranges.select(F.col("anchor_id").alias("id"), "label", "h", F.col("of.low").alias("low"), F.col("of.high").alias("high"))
    armed = anchors.join(ranges, ["id", "label", "h"]).withColumn("least", F.array_min("low").cast("double") - 1).withColumn("most", F.array_max("high").cast("double") + 1)
    armed = materialise(armed, "ranges")
    near = _first(_joined(armed, placed, space, negatives, True, group, piece), [*who, "range"], negatives)
    bounds = armed.select(F.col("id").alias("anchor_id"), "label", "h", F.posexplode(F.arrays_zip("low", "high")).alias("range", "of")).select(*who, F.col("range").cast("long").alias("range"), "of.low", "of.high")
    near = near.join(bounds, [*who, "range"]).select(*who, "low", "high", F.col("r").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = found.join(near, [*who, "low", "high"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, v of embeddings: components as floor(256 * x); every seventh vec_id carries the next label, as
    mislabelled rows would."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    return embeddings.select("vec_id", label.cast("long").alias("label"), F.when(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), v).alias("v"))
