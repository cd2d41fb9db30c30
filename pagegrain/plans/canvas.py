"""Queries of clicks, selections and the splitting of tall boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import canvas
from . import views
from .catalog import query
from .views import sql, table


def clicks(k: SparkSession, d: str) -> DataFrame:
    """Events as clicks of five tools; a second of an event's time is a millisecond of a click's."""
    at = F.expr("unix_micros(cast(ts as timestamp)) div 1000000")
    return table(k, d, "events").select("event_type", "event_id", at.alias("at"), (F.col("user_id") * 7 % 40).alias("x"), (F.col("event_id") % 25).alias("y"))


query("double_clicks", lambda k, d: canvas.double_clicks(clicks(k, d), "event_type"), """WITH c AS (SELECT event_type, event_id, epoch_us(ts) // 1000000 AS t, user_id * 7 % 40 AS x, event_id % 25 AS y FROM events),
n AS (SELECT *, coalesce(t - lag(t) OVER w < 350 AND (x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 < 400, false) AS near FROM c WINDOW w AS (PARTITION BY event_type ORDER BY t, event_id)),
r AS (SELECT *, sum(CAST(NOT near AS INTEGER)) OVER (PARTITION BY event_type ORDER BY t, event_id) AS chain FROM n)
SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type, chain ORDER BY t, event_id) % 2 = 0 AS "double" FROM r""")


def _selected(k: SparkSession, d: str) -> DataFrame:
    seeds = table(k, d, "embeddings").select(F.col("vec_id").alias("img"), F.lit(0).cast("long").alias("click"), (F.col("vec_id") % 8).alias("y"), F.expr("vec_id div 8 % 8").alias("x"))
    return canvas.flood_select(views.pixel(k, d), seeds).select("img", "refused", "pixels", F.array_min("runs.x1").alias("x1"), F.array_max("runs.x2").alias("x2"))


query("flood_select", _selected, sql("""+ m AS (SELECT p.img, p.y, p.x, p.y = s.y AND p.x = s.x AS seed FROM px p JOIN px s ON p.img = s.img AND s.y = s.img % 8 AND s.x = s.img // 8 % 8 WHERE abs(p.v - s.v) <= 22),
f AS (SELECT img, y, x FROM m WHERE seed UNION SELECT m.img, m.y, m.x FROM f JOIN m ON m.img = f.img AND abs(m.y - f.y) + abs(m.x - f.x) = 1),
n AS (SELECT img, count(*) > 10 AS refused, count(*) AS pixels, min(x) AS x1, max(x) + 1 AS x2 FROM f GROUP BY img)
SELECT img, refused, CASE WHEN refused THEN 0 ELSE pixels END AS pixels, CAST(CASE WHEN NOT refused THEN x1 END AS INTEGER) AS x1, CAST(CASE WHEN NOT refused THEN x2 END AS INTEGER) AS x2 FROM n""", "px", recursive=True))


def scans(k: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Embeddings as gray pages, a row of pixels for each component, dark in the middle where it is negative; and their boxes."""
    v = table(k, d, "embeddings").select(F.col("vec_id").alias("page_id"), "embedding")
    row = lambda e: F.when(e < 0, F.concat(F.array_repeat(F.lit(255), 12), F.array_repeat(F.floor((e + 1) * 200).cast("int"), 18), F.array_repeat(F.lit(255), 10))).otherwise(F.array_repeat(F.lit(255), 40))
    pages = v.select("page_id", F.transform("embedding", row).alias("gray"))
    corner = lambda *c: F.struct(*(F.lit(x).alias(n) for n, x in zip(("box_index", "x1", "y1", "x2", "y2"), c, strict=True)))
    boxes = v.select("page_id", F.explode(F.array(corner(0, 0, 0, 40, 64), corner(1, 4, 2, 36, 62), corner(2, 0, 10, 40, 40))).alias("b"))
    mask = F.when(F.col("b.box_index") == 1, F.transform(F.sequence(F.lit(1), F.lit(60)), lambda y: F.array_repeat(y.cast("int"), 32)))
    return pages, boxes.select("page_id", "b.*", mask.alias("mask"))


query("tall_lines", lambda k, d: canvas.split_tall(*scans(k, d)).select("page_id", "box_index", "line", "x1", "y1", "x2", "y2", F.aggregate(F.flatten("mask"), F.lit(0).cast("long"), lambda a, m: a + m).alias("mask_sum")))
