"""A sink that writes work only where the state it was made from still holds.

State is a base table and what batches have committed.  A batch writes its committed rows and its refused ones under its own id;
what it reads are batches before it alone, so that a batch that is run again writes the same rows
over the old ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def digest(columns: list[str], of: Callable[[str], Column] = F.col) -> Column:
    """A digest of a row's state."""
    return F.sha2(F.to_json(F.struct(*(of(c).alias(c) for c in columns)), {"ignoreNullFields": "false"}), 256)


def judged(attempts: DataFrame, now: DataFrame, key: str, state: list[str]) -> DataFrame:
    """key, seq, state columns, reason of attempts (key, seq, seen, state columns) at rows of now (key, state columns): reason is null for
    those that may be committed, `changed` where the state is no longer the one with digest `seen`, `unknown`
    where the key doesn't exist.  Attempts at one key follow their seq; each must have seen what the one committed before it left."""
    made = attempts.select(key, "seq", "seen", *state, digest(state).alias("made"))
    listed = made.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("seq", "seen", "made", *state))).alias("tries"))
    listed = listed.join(now.select(key, digest(state).alias("now")), key, "left")
    start = F.struct(F.col("now").alias("now"), F.array().cast("array<boolean>").alias("ok"))

    def step(held: Column, one: Column) -> Column:
        fits = F.coalesce(held["now"] == one["seen"], F.lit(False))
        return F.struct(F.when(fits, one["made"]).otherwise(held["now"]).alias("now"), F.concat(held["ok"], F.array(fits)).alias("ok"))

    told = listed.withColumn("ok", F.aggregate("tries", start, step)["ok"])
    each = told.select(key, F.col("now").isNull().alias("unknown"), F.inline(F.arrays_zip("tries", "ok")))
    return each.select(key, "tries.seq", *(f"tries.{c}" for c in state), F.when(~F.col("ok"), F.when(F.col("unknown"), "unknown").otherwise("changed")).alias("reason"))


class Guarded:
    """Rows (key, seq, seen, state columns) are attempts: work made from the state with digest `seen`."""

    def __init__(self, base: DataFrame, path: str, key: str, state: list[str]):
        self.base, self.path, self.key, self.state = base.select(key, *state), path, key, state

    def _batch(self, kind: str, batch: int) -> str:
        return f"{self.path}/{kind}/batch={batch:020d}"

    def _written(self, spark: SparkSession, kind: str, schema: StructType, before: int | None) -> DataFrame:
        """Rows of a kind with their batch's number, of batches before one, or of all."""
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
        if not there:
            return spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
        rows = spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(f"{self.path}/{kind}").withColumn("batch", F.col("batch").cast("long"))
        return rows if before is None else rows.where(F.col("batch") < before)

    def current(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """key and state as batches before one, or all, have left it."""
        schema = StructType([self.base.schema[self.key], *(self.base.schema[c] for c in self.state)]).add("seq", "long")
        done = self._written(spark, "committed", schema, before)
        last = done.groupBy(self.key).agg(F.max_by(F.struct(*self.state), F.struct("batch", "seq")).alias("new"))
        both = self.base.join(last, self.key, "full_outer")
        return both.select(self.key, *(F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in self.state))

    def refused(self, spark: SparkSession) -> DataFrame:
        schema = StructType([self.base.schema[self.key]]).add("seq", "long").add("reason", "string")
        return self._written(spark, "refused", schema, None).select(self.key, "seq", "reason")

    def __call__(self, attempts: DataFrame, batch: int) -> None:
        """Write one batch, as foreachBatch does: what may be committed, and what is refused with its reason."""
        spark = attempts.sparkSession
        each = judged(attempts, self.current(spark, batch), self.key, self.state).persist()  # both tables come from one fold
        try:
            each.where("reason is null").select(self.key, *self.state, "seq").write.mode("overwrite").parquet(self._batch("committed", batch))
            each.where("reason is not null").select(self.key, "seq", "reason").write.mode("overwrite").parquet(self._batch("refused", batch))
        finally:
            each.unpersist()
