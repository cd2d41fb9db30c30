"""Shards that all hold the same mixture, by proportional stratified interleaving.

Each row's key is a seeded digest.  Ordered by it, the n rows of a stratum have ranks 0 to n - 1,
and a row's fractional rank is (rank + start) / n, where start lies between 0 and 1 and is a
digest of the stratum, so that strata of few rows don't meet in one place.  Sorted by fractional
rank, every stretch of rows holds each stratum in proportion; the order is cut into shards whose
counts differ by one at most.

No rank is counted in one task: keys and fractional ranks fall into buckets of about BUCKET rows
whatever the strata are, buckets are counted first, and a row's rank is its bucket's running
total and its place there.  So a stratum with most of the rows is spread like any other.  Only
DataFrame functions are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import materialise, own_name

BUCKET = 4096  # rows of a bucket
SEED = "shards"


def _fraction(digest: Column) -> Column:
    """The first 32 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def running(counts: DataFrame, at: str, n: str, within: list[str]) -> DataFrame:
    """counts with `before`, the sum of n at smaller places of the same group.  Places are summed
    by blocks of 1,024 first, so that a window has a block's places, or the blocks."""
    block = F.floor(F.col(at) / 1024).alias("block")
    blocks = counts.groupBy(*within, block).agg(F.sum(n).alias("whole"))
    w = Window.partitionBy(*within).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*within, "block", F.coalesce(F.sum("whole").over(w), F.lit(0)).alias("base"))
    w = Window.partitionBy(*within, "block").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    inner = counts.withColumn("block", block).withColumn("inside", F.coalesce(F.sum(n).over(w), F.lit(0)))
    return inner.join(blocks, [*within, "block"]).withColumn("before", F.col("base") + F.col("inside")).drop("block", "base", "inside")


def interleave(rows: DataFrame, shards: int, stratum: str = "source", keys: tuple[str, ...] = ("doc_id",), seed: str = SEED, bucket: int = BUCKET) -> DataFrame:
    """rows with shard (from 0) and slot (from 0, without gaps in each shard).

    `keys` name the columns whose values, with the seed, decide the order; rows that agree in all
    of them stand in any order.  A null stratum is one of its own, null keys count as empty.
    Columns called shard or slot are replaced; other names may be anything.  With fewer rows than
    shards some shards stay empty; an empty table gives an empty one."""
    rows = rows.drop("shard", "slot")
    total = rows.count()
    buckets = max(1, -(-total // bucket))
    st, key, part, place, frac = (own_name(rows, x) for x in ("st", "key", "part", "place", "frac"))
    told = rows.withColumn(st, F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")))
    told = told.withColumn(key, F.md5(F.concat_ws(":", F.lit(seed), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)).cast("binary")))
    told = told.withColumn(part, F.shiftright(_fraction(F.col(key)) * buckets, 32))
    counts = running(told.groupBy(st, part).agg(F.count("*").alias("n")), part, "n", [st])
    sizes = counts.groupBy(st).agg(F.sum("n").alias("of"))
    start = (_fraction(F.md5(F.concat(F.lit(f"{seed}:"), F.col(st)).cast("binary"))) + F.lit(0.5)) / F.lit(float(1 << 32))
    counts = counts.join(sizes, st).select(st, part, "before", "of", start.alias("start"))
    counts = materialise(counts.toDF(st, part, *(own_name(rows, x) for x in ("before", "of", "start"))), "ranks")
    before, of, start = counts.columns[2:]
    inside = F.row_number().over(Window.partitionBy(st, part).orderBy(key))
    ranked = told.withColumn(place, inside).join(counts, [st, part])
    ranked = ranked.withColumn(frac, (F.col(before) + F.col(place) - 1 + F.col(start)) / F.col(of))
    ranked = ranked.withColumn(part, F.least(F.floor(F.col(frac) * buckets), F.lit(buckets - 1)))
    ranked = materialise(ranked.select(*rows.columns, st, part, frac), "ranked")
    counts = running(ranked.groupBy(part).agg(F.count("*").alias(of)), part, of, []).select(part, F.col("before").alias(before))
    # neighbouring buckets stay in one task, so that a shard written from here has few files
    placed = ranked.repartitionByRange(part).withColumn(place, F.row_number().over(Window.partitionBy(part).orderBy(frac, st)))
    placed = placed.join(counts, part).withColumn(place, F.col(before) + F.col(place) - 1)
    placed = placed.withColumn("shard", F.expr(f"cast(`{place}` * {shards} div {max(1, total)} as int)"))
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return placed.select(*rows.columns, "shard", (F.col(place) - first).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int, stratum: str = "source", keys: tuple[str, ...] = ("doc_id",), seed: str = SEED) -> None:
    """Whole rows as Parquet under path/shard=N, each file in the order of slots."""
    placed = interleave(docs, shards, stratum, keys, seed)
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def document_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: every document's place.  Texts are
    read once, for their size and checksum, and don't pass a shuffle; a null text has none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    narrow = materialise(narrow, "sizes")
    placed = interleave(narrow, shards, "source", ("doc_id", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
