"""Windows over long keys, cut into parts, so that a key with most of the rows is many groups.

A row's part is its time by `part`; what a window would bring from other parts is looked up, one row for each part."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIRST, LAST = Window.unboundedPreceding, Window.currentRow


def _joined(rows: DataFrame, parts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with their part's value; null keys are keys like others."""
    names = [*keys, "part"]
    other = parts.select(*(F.col(c).alias(f"its_{c}") for c in names), value)
    on = F.lit(True)
    for c in names:
        on = on & F.col(c).eqNullSafe(F.col(f"its_{c}"))
    return rows.join(other, on, "left").drop(*(f"its_{c}" for c in names))


def nearest(rows: DataFrame, marks: DataFrame, keys: list[str], part: int, following: bool) -> DataFrame:
    """rows with `mark`, the nearest mark of the same keys after (or before) their place (at, rank, seq);
    marks have a struct `mark` beside their place.  A mark at a row's own place isn't found; null if there is none."""
    names = rows.columns
    own = rows.select(F.struct(*names).alias("row"), *keys, "at", "rank", "seq", F.lit(None).cast(marks.schema["mark"].dataType).alias("mark"))
    both = own.union(marks.select(F.lit(None).cast(own.schema["row"].dataType).alias("row"), *keys, "at", "rank", "seq", "mark"))
    both = both.withColumn("part", F.floor(F.col("at") / part))
    order = [F.desc(c) if following else F.asc(c) for c in ("at", "rank", "seq")] + [F.col("mark").isNotNull()]
    inside = Window.partitionBy(*keys, "part").orderBy(*order).rowsBetween(FIRST, -1)
    both = both.withColumn("found", F.last("mark", ignorenulls=True).over(inside))
    place = F.when(F.col("mark").isNotNull(), F.struct("at", "rank", "seq"))
    parts = both.groupBy(*keys, "part").agg((F.min_by if following else F.max_by)("mark", place).alias("edge"))
    beyond = Window.partitionBy(*keys).orderBy(F.desc("part") if following else F.asc("part")).rowsBetween(FIRST, -1)
    parts = parts.select(*keys, "part", F.last("edge", ignorenulls=True).over(beyond).alias("beyond"))
    out = _joined(both.where("row is not null"), parts, keys, "beyond")
    return out.select("row.*", F.coalesce("found", "beyond").alias("mark"))


def before(rows: DataFrame, keys: list[str], mark: Column, part: int) -> DataFrame:
    """rows (keys, at, seq, ..) with `mark`, a struct of the row before."""
    told = rows.withColumns({"part": F.floor(F.col("at") / part), "_mark": mark})
    inside = Window.partitionBy(*keys, "part").orderBy("at", "seq")
    parts = told.groupBy(*keys, "part").agg(F.max_by("_mark", F.struct("at", "seq")).alias("edge"))
    parts = parts.select(*keys, "part", F.lag("edge").over(Window.partitionBy(*keys).orderBy("part")).alias("beyond"))
    out = _joined(told.withColumn("found", F.lag("_mark").over(inside)), parts, keys, "beyond")
    return out.select(*rows.columns, F.coalesce("found", "beyond").alias("mark"))


def running(rows: DataFrame, keys: list[str], value: Column, name: str, part: int, total: Callable[[Column], Column] = F.sum) -> DataFrame:
    """rows (keys, at, seq, ..) with `name`, the sum or largest of value up to each row."""
    told = rows.withColumns({"part": F.floor(F.col("at") / part), "_added": value})
    inside = Window.partitionBy(*keys, "part").orderBy("at", "seq").rowsBetween(FIRST, LAST)
    parts = told.groupBy(*keys, "part").agg(total(F.col("_added")).alias("whole"))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(FIRST, -1)
    parts = parts.select(*keys, "part", total(F.col("whole")).over(earlier).alias("carried"))
    out = _joined(told.withColumn("inside", total(F.col("_added")).over(inside)), parts, keys, "carried")
    both = F.coalesce("carried", F.lit(0)) + F.coalesce("inside", F.lit(0)) if total is F.sum else F.greatest("carried", "inside")
    return out.select(*rows.columns, both.alias(name))
