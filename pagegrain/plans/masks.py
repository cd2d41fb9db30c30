"""Queries of page masks, slices, pairs of images and saves of geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bench, manifest, raster
from . import views
from .catalog import query
from .views import sql, table

C = F.col
SIDE = 24  # embeddings as images of 8 by 8, each pixel three times as wide and high


def _gray(k: SparkSession, d: str) -> DataFrame:
    wide = table(k, d, "embeddings").select(C("vec_id").alias("page_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))).alias("y"))
    row = F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda x: F.floor((F.element_at("embedding", (F.floor(C("y") / 3) * 8 + F.floor(x / 3) + 1).cast("int")).cast("double") + 1) * 127.5).cast("int"))
    return wide.select("page_id", "y", row.alias("gray"))


def _boxes(k: SparkSession, d: str) -> DataFrame:
    """A box with a mask for each image; for some a box without one, or with a mask of another size than its own."""
    i = C("page_id")
    grid = lambda h, w, value: F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(w - 1)), lambda x: value(y, x).cast("int")))
    none = F.lit(None).cast("array<array<int>>")
    part = lambda there, x1, y1, x2, y2, mask: F.when(there, F.struct(*(v.cast("long").alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (x1, y1, x2, y2), strict=True)), mask.alias("mask")))
    own = part(F.lit(True), i % 18, i % 15, i % 18 + 7, i % 15 + 5, grid(5, 7, lambda y, x: F.when(((y * x + i) % 4 == 0) & (i % 7 != 6), 200).otherwise(60)))
    bare = part((i % 5 == 0) & (i % 7 != 6), F.lit(21), F.lit(21), F.lit(23), F.lit(22), none)
    other = part((i % 3 == 1) & (i % 7 != 6), F.lit(-2), F.lit(10), F.lit(4), F.lit(14), grid(2, 3, lambda y, x: (y * 3 + x + i) % 3 * 100))
    return table(k, d, "embeddings").select(C("vec_id").alias("page_id")).select("page_id", F.explode(F.array_compact(F.array(own, bare, other))).alias("b")).select("page_id", F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), "b.*")


def page_mask(k: SparkSession, d: str) -> DataFrame:
    place = F.zip_with("row", F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda v, x: v * (C("y") * SIDE + x)).cast("array<long>")
    total = lambda a: F.sum(F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v))
    return raster.page_masks(_boxes(k, d), _gray(k, d)).groupBy("page_id", "wide").agg(F.sum(F.size(F.filter("row", lambda v: v > 127))).alias("pixels"), total("row").alias("total"), total(place).alias("placed"))


def _grown(source: str, kernel: str) -> str:
    return f"SELECT t.img, t.y, t.x, max(s.v) AS v FROM {source} t JOIN {kernel} k ON true JOIN {source} s ON s.img = t.img AND s.y = t.y + k.dy AND s.x = t.x + k.dx GROUP BY t.img, t.y, t.x"


def _kernel(reach: dict[int, int]) -> str:
    return "(VALUES " + ", ".join(f"({dy}, {dx})" for dy, r in reach.items() for dx in range(-r, r + 1)) + ")"


#: How far the ellipses of 7 and 9 and the square of 3 reach sideways in each row.
SEVEN = {-3: 0, -2: 2, -1: 3, 0: 3, 1: 3, 2: 2, 3: 0}
NINE = {-4: 0, -3: 3, -2: 3, -1: 4, 0: 4, 1: 4, 2: 3, 3: 3, 4: 0}
THREE = {-1: 1, 0: 1, 1: 1}
query("page_mask", page_mask, sql(f"""+ g AS (SELECT img, y * 3 + a AS y, x * 3 + b AS x, v FROM px, (VALUES (0), (1), (2)) i(a), (VALUES (0), (1), (2)) j(b)),
e7(dy, dx) AS {_kernel(SEVEN)}, e9(dy, dx) AS {_kernel(NINE)}, s3(dy, dx) AS {_kernel(THREE)},
p AS (SELECT img, y, x, greatest(CASE WHEN x >= img % 18 AND x < img % 18 + 7 AND y >= img % 15 AND y < img % 15 + 5 THEN CASE WHEN ((y - img % 15) * (x - img % 18) + img) % 4 = 0 AND img % 7 <> 6 THEN 200 ELSE 60 END ELSE 0 END,
  CASE WHEN img % 5 = 0 AND img % 7 <> 6 AND x >= 13 AND y >= 13 THEN 255 ELSE 0 END,
  CASE WHEN img % 3 = 1 AND img % 7 <> 6 AND x < 4 AND y >= 10 AND y < 14 THEN ((y - 10) // 2 * 3 + (x + 2) // 2 + img) % 3 * 100 ELSE 0 END) AS v FROM g),
m AS (SELECT *, max(v) OVER (PARTITION BY img) > 127 AS live FROM p), l AS (SELECT img, y, x, v FROM m WHERE live),
u AS ({_grown('l', 'e7')}), o AS ({_grown('u', 's3')}),
w AS (SELECT u.img FROM u JOIN o ON o.img = u.img AND o.y = u.y AND o.x = u.x JOIN g ON g.img = u.img AND g.y = u.y AND g.x = u.x WHERE o.v > 127 AND u.v <= 127 GROUP BY u.img HAVING count(*) * sum(g.v * g.v) - sum(g.v) * sum(g.v) > 324 * count(*) * count(*)),
lw AS (SELECT * FROM l WHERE img IN (SELECT img FROM w)), n AS ({_grown('lw', 'e9')}),
r AS (SELECT img, y, x, v FROM m WHERE NOT live UNION ALL SELECT * FROM u WHERE img NOT IN (SELECT img FROM w) UNION ALL SELECT * FROM n)
SELECT img AS page_id, count(*) FILTER (WHERE v > 127) AS pixels, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (y * {SIDE} + x)) AS BIGINT) AS placed, img IN (SELECT img FROM w) AS wide FROM r GROUP BY img""", "px"))


def page_slices(k: SparkSession, d: str) -> DataFrame:
    pages = views.page(k, d).select(C("page_id").alias("img"), F.when(C("price") % 9 > 0, C("price") % 6000 + 1).alias("height"))
    cuts = pages.select("img", "height", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("n")).where("height > 1580 and n * 1400 < height - 500")
    return raster.slices(pages, cuts.select("img", (C("n") * 1400 + C("img") % 90).cast("long").alias("cut")), F.concat(F.lit("p"), C("img").cast("string")), F.lit(".png"))


query("page_slices", page_slices, sql("""+ i AS (SELECT page_id AS img, CASE WHEN price % 9 > 0 THEN price % 6000 + 1 END AS height FROM page),
e AS (SELECT img, n * 1400 + img % 90 AS bottom FROM i, (VALUES (1), (2), (3)) v(n) WHERE height > 1580 AND n * 1400 < height - 500 UNION SELECT img, height FROM i WHERE height IS NOT NULL),
s AS (SELECT img, bottom, row_number() OVER w - 1 AS place, coalesce(lag(bottom) OVER w, 0) AS top FROM e WINDOW w AS (PARTITION BY img ORDER BY bottom))
SELECT img, CAST(place AS INTEGER) AS place, top, bottom, 'p' || img || '_0' || place || '.png' AS name FROM s UNION ALL SELECT img, 0, NULL, NULL, 'p' || img || '.png' FROM i WHERE height IS NULL""", "page"))


def golden_pairs(k: SparkSession, d: str) -> DataFrame:
    p = table(k, d, "pages").select(C("page_id").alias("case_id"), F.coalesce("html", F.lit("")).alias("t"))
    candidate = p.where("case_id % 7 > 0").select("case_id", F.sha2(F.concat("t", F.when(C("case_id") % 3 == 0, "x").otherwise("")).cast("binary"), 256).alias("digest"))
    return bench.golden_pairs(p.select("case_id"), p.where("case_id % 5 > 0").select("case_id", F.sha2(C("t").cast("binary"), 256).alias("digest")), candidate)


query("golden_pairs", golden_pairs, """WITH p AS (SELECT page_id AS case_id, coalesce(html, '') AS t FROM pages),
b AS (SELECT case_id, sha256(t) AS d FROM p WHERE case_id % 5 > 0), c AS (SELECT case_id, sha256(CASE WHEN case_id % 3 = 0 THEN t || 'x' ELSE t END) AS d FROM p WHERE case_id % 7 > 0)
SELECT p.case_id, CASE WHEN b.d IS NULL THEN 'missing baseline' WHEN c.d IS NULL THEN 'missing candidate' WHEN b.d <> c.d THEN 'differs' ELSE 'identical' END AS state FROM p LEFT JOIN b ON b.case_id = p.case_id LEFT JOIN c ON c.case_id = p.case_id""")
#: A minute of an event's time is a millisecond of an edit's.
query("geometry_saves", lambda k, d: manifest.geometry_saves(table(k, d, "events").select("user_id", "event_id", F.expr("unix_micros(cast(ts as timestamp)) div 60000000").alias("at")), "user_id", "at", "event_id", reply=C("event_id") % 900), """WITH t AS (SELECT user_id, event_id, epoch_us(ts) // 60000000 AS a FROM events),
n AS (SELECT *, row_number() OVER w AS generation, lead(a) OVER w AS b FROM t WINDOW w AS (PARTITION BY user_id ORDER BY a, event_id)),
s AS (SELECT *, a + 300 + event_id % 900 AS answered, lead(a) OVER (PARTITION BY user_id ORDER BY a, event_id) + 300 AS later FROM n WHERE b IS NULL OR b - a > 300)
SELECT user_id, event_id, CAST(generation AS INTEGER) AS generation, coalesce(later < answered, false) AS aborted, NOT coalesce(later < answered, false) AND (b IS NULL OR b > answered) AS cleared FROM s""")
