"""Catalogue of fonts and the file behind a font's name, from a listing of a folder (name)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _stems(listing: DataFrame) -> DataFrame:
    found = listing.where(F.lower("name").endswith(".ttf")).distinct()
    return found.select("name", F.regexp_replace("name", r"\.[tT]{2}[fF]$", "").alias("stem"))


def catalogue(listing: DataFrame) -> DataFrame:
    """(id, name): the default font, then each stem once without regard to case (the first by name), titled."""
    one = _stems(listing).where(F.lower("stem") != "default").groupBy(F.lower("stem")).agg(F.min("stem").alias("id"))
    spark = listing.sparkSession
    return spark.createDataFrame([("default", "Default")], "id string, name string").unionByName(one.select("id", F.initcap(F.translate("id", "_-", "  ")).alias("name")))


def resolve(requests: DataFrame, listing: DataFrame, default: str) -> DataFrame:
    """(font, file): the file of that name, else with .ttf, else one that differs in case, else the default.
    Names that hold a path separator lead out of the folder and get the default."""
    stems = _stems(listing)
    keys = stems.select(F.explode(F.array(F.struct(F.col("name").alias("key"), F.lit(0).alias("rank")), F.struct(F.col("stem").alias("key"), F.lit(1).alias("rank")), F.struct(F.lower("name").alias("key"), F.lit(2).alias("rank")), F.struct(F.lower("stem").alias("key"), F.lit(2).alias("rank")))).alias("k"), "name").select("k.key", "k.rank", "name")
    asked = requests.select("font").distinct()
    wanted = asked.select("font", F.explode(F.array(F.struct(F.col("font").alias("key"), F.lit(True).alias("same")), F.struct(F.lower("font").alias("key"), F.lit(False).alias("same")))).alias("w")).select("font", "w.key", "w.same")
    found = wanted.join(keys, "key").where(F.col("same") == (F.col("rank") < 2)).groupBy("font").agg(F.min(F.struct("rank", "name")).alias("best"))
    safe = ~F.coalesce(F.col("font").rlike(r"[/\\]") | F.col("font").isin("", "default"), F.lit(True))
    return asked.join(found, "font", "left").select("font", F.when(safe, F.col("best.name")).alias("file")).fillna(default, ["file"])
