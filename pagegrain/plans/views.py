"""Domain tables derived from the driver's tables by integer arithmetic, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PAGE_W, PAGE_H = 400, 600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    index = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return orders.select(F.col("o_orderkey").alias("page_id"), F.col("o_custkey").alias("chapter_id"), index.alias("page_index"), (F.col("o_orderstatus") == "F").alias("skipped"), F.col("o_totalprice").cast("long").alias("price"))


def box(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem")
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    item = item.withColumn("box_index", F.row_number().over(place) - 1).withColumn("qty", F.col("l_quantity").cast("long"))
    bubble = F.col("l_linenumber") <= 2
    x1 = (F.col("l_partkey") * 37 + F.col("l_suppkey") * 11) % 300
    y1 = (F.col("l_partkey") * 53 + F.col("qty") * 17) % 450
    w = F.when(bubble, 80 + F.col("l_suppkey") % 60).otherwise(20 + F.col("l_suppkey") % 40)
    h = F.when(bubble, 90 + F.col("qty")).otherwise(12 + F.floor(F.col("qty") / 2))
    boxes = item.select(F.col("l_orderkey").alias("page_id"), "box_index", F.when(bubble, "bubble").otherwise("text").alias("kind"), x1.alias("x1"), y1.alias("y1"), (x1 + w).alias("x2"), (y1 + h).alias("y2"), F.round(F.col("l_discount") * 9 + 0.05, 4).alias("confidence"), (F.col("l_returnflag") == "A").alias("removed"))
    return boxes


def excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rectangle for each page; its corners come in any order."""
    p = page(spark, sf_dir)
    a, b = F.col("price") % 400, (F.col("price") * 7) % 400
    return p.select("page_id", a.alias("ax"), b.alias("bx"), ((F.col("price") * 3) % 600).alias("ay"), ((F.col("price") * 11) % 600).alias("cy"))


def invocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = table(spark, sf_dir, "events")
    case_id = F.concat("event_type", F.lit("_"), (F.col("user_id") % 20).cast("string"))
    event = event.withColumn("case_id", case_id)
    index = F.row_number().over(Window.partitionBy("case_id").orderBy("ts", "event_id")) - 1
    return event.select("case_id", index.alias("invocation_index"), F.col("value").alias("latency_ms"), (F.col("event_id") % 4).alias("model_calls"), (F.col("event_id") % 3).alias("cluster_count"), "user_id", "event_id", "ts")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invocations with what the execution rules look at."""
    e = F.col("event_id")
    short = F.col("user_id") % 5 == 0
    kind = F.when(short, F.element_at(F.array(F.lit("white"), F.lit("black"), F.lit("low_std"), F.lit(None)), (F.expr("(user_id % 20) div 5") + 1).cast("int")))
    count = F.when(short, F.when(e % 7 == 0, 0).otherwise(1)).otherwise(F.when(e % 11 == 0, 1).otherwise(0))
    taken = F.when(e % 13 == 0, "black").otherwise(F.coalesce(kind, F.lit("white")))
    crop = F.struct((400 + e % 150).cast("int").alias("w"), F.lit(300).alias("h"))
    calls = F.when(short, F.when(e % 3 == 0, 1).otherwise(0)).otherwise(e % 4)
    rows = invocation(spark, sf_dir)
    rows = rows.withColumns({"expected_execution": F.when(short, "shortcut").otherwise("model_required"), "expected_type": kind, "model_calls": calls, "shortcut_count": count, "tile_count": e % 3, "active_tile_count": e % 5, "image_width": F.lit(512), "image_height": F.lit(512)})
    return rows.withColumns({"shortcut_types": F.when(F.col("shortcut_count") == 1, F.array(taken)).otherwise(F.array().cast("array<string>")), "crops": F.array_repeat(crop, (F.col("cluster_count") - F.when(e % 17 == 0, 1).otherwise(0)).cast("int"))})


def region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two text regions for each page."""
    p = page(spark, sf_dir).withColumn("region_id", F.explode(F.array(F.lit(0), F.lit(1))))
    x, y = (F.col("price") * (3 + F.col("region_id"))) % 300, (F.col("price") * (7 + F.col("region_id"))) % 450
    return p.select("page_id", "region_id", x.alias("x1"), y.alias("y1"), (x + 100).alias("x2"), (y + 150).alias("y2"))


def pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 by 8 gray images."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img"), F.posexplode("embedding").alias("i", "e"))
    return e.select("img", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), F.floor((F.col("e").cast("double") + 1) * 127.5).cast("int").alias("v"))


#: The same tables for the oracle, as common table expressions.
SQL = {
    "page": """page AS (SELECT o_orderkey AS page_id, o_custkey AS chapter_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS page_index,
  o_orderstatus = 'F' AS skipped, CAST(trunc(o_totalprice) AS BIGINT) AS price FROM orders)""",
    "box": """box0 AS (SELECT *, CAST(trunc(l_quantity) AS BIGINT) AS qty, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS box_index,
  (l_partkey * 37 + l_suppkey * 11) % 300 AS x1, (l_partkey * 53 + CAST(trunc(l_quantity) AS BIGINT) * 17) % 450 AS y1 FROM lineitem),
box AS (SELECT l_orderkey AS page_id, box_index, CASE WHEN l_linenumber <= 2 THEN 'bubble' ELSE 'text' END AS kind, x1, y1,
  x1 + CASE WHEN l_linenumber <= 2 THEN 80 + l_suppkey % 60 ELSE 20 + l_suppkey % 40 END AS x2, y1 + CASE WHEN l_linenumber <= 2 THEN 90 + qty ELSE 12 + qty // 2 END AS y2,
  round(l_discount * 9 + 0.05, 4) AS confidence, l_returnflag = 'A' AS removed FROM box0)""",
    "excluded": "excluded AS (SELECT page_id, price % 400 AS ax, (price * 7) % 400 AS bx, (price * 3) % 600 AS ay, (price * 11) % 600 AS cy FROM page)",
    "invocation": """invocation AS (SELECT event_type || '_' || (user_id % 20) AS case_id, row_number() OVER (PARTITION BY event_type || '_' || (user_id % 20) ORDER BY ts, event_id) - 1 AS invocation_index,
  value AS latency_ms, event_id % 4 AS model_calls, event_id % 3 AS cluster_count, user_id, event_id, ts FROM events)""",
    "run": """run AS (SELECT * REPLACE (CASE WHEN user_id % 5 = 0 THEN CAST(event_id % 3 = 0 AS INTEGER) ELSE event_id % 4 END AS model_calls), CASE WHEN user_id % 5 = 0 THEN 'shortcut' ELSE 'model_required' END AS expected_execution,
  CASE WHEN user_id % 5 = 0 THEN ['white', 'black', 'low_std', NULL][(user_id % 20) // 5 + 1] END AS expected_type, CAST(CASE WHEN user_id % 5 = 0 THEN event_id % 7 <> 0 ELSE event_id % 11 = 0 END AS INTEGER) AS shortcut_count,
  event_id % 3 AS tile_count, event_id % 5 AS active_tile_count, 400 + event_id % 150 AS crop_w, greatest(0, cluster_count - CAST(event_id % 17 = 0 AS INTEGER)) AS crops,
  CASE WHEN event_id % 13 = 0 THEN 'black' ELSE coalesce(CASE WHEN user_id % 5 = 0 THEN ['white', 'black', 'low_std', NULL][(user_id % 20) // 5 + 1] END, 'white') END AS taken FROM invocation)""",
    "region": """region AS (SELECT page_id, r AS region_id, (price * (3 + r)) % 300 AS x1, (price * (7 + r)) % 450 AS y1, (price * (3 + r)) % 300 + 100 AS x2, (price * (7 + r)) % 450 + 150 AS y2 FROM page, (VALUES (0), (1)) v(r))""",
    "px": """px0 AS (SELECT vec_id AS img, unnest(embedding) AS e, unnest(range(64)) AS i FROM embeddings),
px AS (SELECT img, i // 8 AS y, i % 8 AS x, CAST(floor((CAST(e AS DOUBLE) + 1) * 127.5) AS INTEGER) AS v FROM px0)""",
}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    return "WITH " + "RECURSIVE " * recursive + ",\n".join(SQL[n] for n in names) + ("," if body.startswith("+") else "") + "\n" + body.removeprefix("+")
