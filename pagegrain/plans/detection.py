"""Queries of detection on pages' pixels, of passes mapped back, of lines and cuts at the parameters of pages, and of guarded commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grouping, manifest, profile, spatial
from ..streaming import edits, guarded
from . import grouped, media, views
from .catalog import query
from .queries import GAP
from .views import PAGE_H, PAGE_W, sql, table

C = F.col
WIDE, HIGH = 160, 256


def page_rows(k: SparkSession, d: str) -> DataFrame:
    """Embeddings as pages of 256 rows: each component is four rows, with a dark bar where it is low."""
    e = table(k, d, "embeddings").select(C("vec_id").alias("page_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(HIGH - 1))).alias("y"))
    v = F.element_at("embedding", (F.floor(C("y") / 4) + 1).cast("int"))
    bar = F.concat(F.array_repeat(F.lit(255), 20), F.array_repeat(F.floor((v + 1) * 200).cast("int"), 100), F.array_repeat(F.lit(255), 40))
    return e.select("page_id", "y", F.when(v < 0, bar).otherwise(F.array_repeat(F.lit(255), WIDE)).alias("row"))


def page_boxes(k: SparkSession, d: str) -> DataFrame:
    """A bubble with two texts and four texts elsewhere on each of these pages, at places that differ."""
    i = C("vec_id")
    one = lambda n, kind, *c: F.struct(F.lit(n).alias("box_index"), F.lit(kind).alias("kind"), *((v + i % m).cast("int").alias(name) for (v, m), name in zip(c, ("x1", "y1", "x2", "y2"), strict=True)), F.round(F.abs(F.element_at("embedding", n + 1)).cast("double") % 0.3 + 0.04 + 0.1 * n, 4).alias("confidence"))
    found = [one(0, "bubble", (F.lit(8), 5), (F.lit(6), 4), (F.lit(120), 9), (F.lit(120), 7)), one(1, "text", (F.lit(20), 7), (F.lit(12), 5), (F.lit(60), 30), (F.lit(40), 19)), one(2, "text", (F.lit(25), 9), (F.lit(50), 13), (F.lit(80), 20), (F.lit(100), 17)), one(3, "text", (F.lit(10), 11), (F.lit(135), 9), (F.lit(90), 40), (F.lit(150), 23)), one(4, "text", (F.lit(15), 17), (F.lit(160), 29), (F.lit(100), 35), (F.lit(225), 30)), one(5, "text", (F.lit(100), 33), (F.lit(70), 90), (F.lit(135), 20), (F.lit(170), 60)), one(6, "bubble", (F.lit(60), 23), (F.lit(140), 50), (F.lit(120), 35), (F.lit(200), 50))]
    return table(k, d, "embeddings").select(i, "embedding").select(i.alias("page_id"), F.inline(F.array(*found)))


query("detect_lines", lambda k, d: grouping.detect(page_boxes(k, d), WIDE, HIGH, rows=page_rows(k, d)))


def passes(k: SparkSession, d: str) -> DataFrame:
    """Line items as what three passes over their order's page have found."""
    b = views.box(k, d).withColumn("pass", F.element_at(F.array(F.lit("plain"), F.lit("flipped"), F.lit("small")), (C("box_index") % 3 + 1).cast("int")))
    return b.select("page_id", "pass", "box_index", *((C(c) + (30 if c[0] == "x" else 0)).alias(c) for c in ("x1", "y1", "x2", "y2")), "confidence")


BACK = """+ p AS (SELECT page_id, box_index, confidence, ['plain', 'flipped', 'small'][box_index % 3 + 1] AS pass, x1 + 30 AS x1, y1, x2 + 30 AS x2, y2 FROM box),
m AS (SELECT page_id, pass, box_index, confidence, CASE pass WHEN 'flipped' THEN greatest(0, 400 - x2) WHEN 'small' THEN least(400, CAST(round_even(x1 / 0.85::DOUBLE, 0) AS BIGINT)) ELSE x1 END AS x1, CASE pass WHEN 'flipped' THEN greatest(0, 400 - x1) WHEN 'small' THEN least(400, CAST(round_even(x2 / 0.85::DOUBLE, 0) AS BIGINT)) ELSE x2 END AS x2,
  CASE pass WHEN 'flipped' THEN least(600, y1) WHEN 'small' THEN least(600, CAST(round_even(y1 / 0.85::DOUBLE, 0) AS BIGINT)) ELSE y1 END AS y1, CASE pass WHEN 'flipped' THEN least(600, y2) WHEN 'small' THEN least(600, CAST(round_even(y2 / 0.85::DOUBLE, 0) AS BIGINT)) ELSE y2 END AS y2 FROM p)
"""
query("passes_mapped", lambda k, d: spatial.mapped_back(passes(k, d), PAGE_W, PAGE_H), sql(BACK + "SELECT * FROM m WHERE x2 > x1 AND y2 > y1", "box"))
query("passes_merged", lambda k, d: spatial.passes_merged(passes(k, d), PAGE_W, PAGE_H))


def own_mask() -> Column:
    """A box's mask: of its size, a row short, empty, or none."""
    side = F.when(C("box_index") % 4 == 1, C("y2") - C("y1") - 1).otherwise(C("y2") - C("y1")).cast("int")
    line = F.array_repeat(F.when(C("box_index") % 5 == 2, 0).otherwise(255), (C("x2") - C("x1")).cast("int"))
    return F.when(C("page_id") % 3 > 0, F.array_repeat(line, side))


EMPTY = """SELECT page_id, box_index, x1 + mx AS x1, y1 + my AS y1, x2 - mx AS x2, y2 - my AS y2, confidence, CAST((x2 - x1 - 2 * mx) * (y2 - y1 - 2 * my) AS BIGINT) AS pixels FROM (SELECT *, greatest(2, ((x2 - x1) * 3) // 100) AS mx, greatest(2, ((y2 - y1) * 3) // 100) AS my FROM box b WHERE kind = 'bubble' AND page_id % 3 > 0 AND box_index % 4 <> 1 AND box_index % 5 <> 2
  AND NOT EXISTS (SELECT 1 FROM box t WHERE t.page_id = b.page_id AND t.kind = 'text' AND ((t.x1 + t.x2) / 2.0 BETWEEN b.x1 AND b.x2 AND (t.y1 + t.y2) / 2.0 BETWEEN b.y1 AND b.y2 OR greatest(least(t.x2, b.x2) - greatest(t.x1, b.x1), 0) * greatest(least(t.y2, b.y2) - greatest(t.y1, b.y1), 0) >= 0.5 * (t.x2 - t.x1) * (t.y2 - t.y1))))"""
query("empty_bubbles", lambda k, d: spatial.empty_bubbles(views.box(k, d), own_mask()).select("page_id", "box_index", "x1", "y1", "x2", "y2", "confidence", F.size(F.flatten("mask")).cast("long").alias("pixels")), sql(EMPTY, "box"))
query("free_text_hulls", lambda k, d: spatial.free_text_hulls(views.box(k, d), PAGE_W, PAGE_H), sql(f"""+ edge AS (SELECT a.page_id, a.box_index AS p, b.box_index AS q FROM box a JOIN box b ON a.page_id = b.page_id AND a.box_index <> b.box_index AND a.kind = 'text' AND b.kind = 'text' AND {GAP['x']} <= 35 AND (abs(a.y1 - b.y1) < 45 OR abs(a.y2 - b.y2) < 45 OR {GAP['y']} <= 40)),
reach AS (SELECT page_id, box_index, box_index AS r FROM box WHERE kind = 'text' UNION SELECT reach.page_id, reach.box_index, q FROM reach JOIN edge ON edge.page_id = reach.page_id AND p = r),
c AS (SELECT page_id, box_index, min(r) AS cluster FROM reach GROUP BY ALL),
g AS (SELECT c.page_id, CAST(cluster AS INTEGER) AS cluster, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, max(confidence) AS confidence, count(*) AS n, sum(y2 - y1) AS heights FROM c JOIN box b ON b.page_id = c.page_id AND b.box_index = c.box_index GROUP BY ALL)
SELECT page_id, cluster, greatest(0, x1 - 20) AS x1, greatest(0, y1 - CASE WHEN n = 1 THEN 6 ELSE 8 END) AS y1, least(400, x2 + 20) AS x2, least(600, y2 + CASE WHEN n = 1 THEN 6 ELSE 8 END) AS y2, confidence, n > 3 OR (n > 1 AND (y2 - y1) * n > 4 * heights) AS split FROM g""", "box", recursive=True))


def tall_lines(k: SparkSession, d: str) -> DataFrame:
    return media.tall(k, d).select("img", F.posexplode("gray").alias("y", "row"))


query("line_runs", lambda k, d: profile.line_runs(tall_lines(k, d)), """WITH e AS (SELECT vec_id AS img, unnest(embedding) AS e, unnest(range(64)) AS i FROM embeddings),
r AS (SELECT img, i * 10 + j AS y, CASE WHEN e < -0.17::DOUBLE THEN (24 * 255 + 24 * floor((e + 1) * 120)) / 48 WHEN e > 0.2::DOUBLE THEN (43 * 255 + 5 * 60) / 48 ELSE 255 END AS m FROM e, range(10) t(j)),
f AS (SELECT * FROM (SELECT img, y, m < quantile_cont(m, 0.9) OVER (PARTITION BY img) - 2 AS t FROM r) WHERE t),
g AS (SELECT img, min(y) AS first, max(y) AS last FROM (SELECT img, y, y - row_number() OVER (PARTITION BY img ORDER BY y) AS g FROM f) GROUP BY img, g HAVING max(y) - min(y) + 1 >= 4)
SELECT img, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, CAST(least(3, greatest(1, (first - coalesce(lag(last) OVER w + 1, 0)) // 2)) AS INTEGER) AS pad_top, CAST(least(3, greatest(1, (coalesce(lead(first) OVER w, 640) - last - 1) // 2)) AS INTEGER) AS pad_bottom FROM g WINDOW w AS (PARTITION BY img ORDER BY first)""")
query("safe_cut", lambda k, d: profile.safe_cut(grouped.tall_rows(k, d)), """WITH r AS (SELECT l_orderkey // 1000 AS img, row_number() OVER (PARTITION BY l_orderkey // 1000 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS y, (l_partkey * 7 + l_suppkey) % 61 = 0 AS unsafe, l_quantity AS score FROM lineitem),
b AS (SELECT img, y, score, count(*) OVER w = 25 AND NOT bool_or(unsafe) OVER w AS ok, max(y) OVER (PARTITION BY img) + 1 AS h FROM r WINDOW w AS (PARTITION BY img ORDER BY y ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING))
SELECT img, CAST(arg_min(y, (abs(y - 1400), score, y)) FILTER (WHERE ok AND y >= 1232 AND y < least(h - 500, 1580) - 12) AS INTEGER) AS cut FROM b GROUP BY img""")


def _limits(k: SparkSession, d: str) -> DataFrame:
    """Conversations as requests, a turn being an entry."""
    rows = table(k, d, "conversations").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(C("turn").cast("string"), "text"))).alias("t"), F.map_from_entries(F.collect_list(F.struct(C("turn").cast("string"), F.when(C("turn") % 7 == 6, "justify").otherwise("left")))).alias("h"))
    return manifest.render_limits(rows.select("conv_id", C("t").alias("translations"), C("h").alias("horizontal"), F.create_map(F.lit("0"), F.when(C("conv_id") % 9 == 4, "low").otherwise("top")).alias("vertical")), "conv_id", 5, 150)


query("render_limits", _limits, "SELECT conv_id, CASE WHEN count(*) > 5 THEN 'too many translations' WHEN max(length(text)) > 150 THEN 'text too long' WHEN bool_or(turn % 7 = 6) THEN 'horizontal alignment' WHEN conv_id % 9 = 4 THEN 'vertical alignment' END AS error FROM conversations GROUP BY conv_id")


def _attempts(k: SparkSession, d: str) -> DataFrame:
    """Events as attempts at their user's state: two fields; what an attempt has seen is one of three states. A sixth of the users isn't known."""
    e = table(k, d, "events").select("user_id", C("event_id").alias("seq"), (C("event_id") * 7 % 3).alias("was"), (C("event_id") % 3).alias("v"))
    seen = F.sha2(F.to_json(F.struct(C("was").alias("v"), F.lit(None).cast("string").alias("note")), {"ignoreNullFields": "false"}), 256)
    attempts = e.select("user_id", "seq", seen.alias("seen"), "v", F.lit(None).cast("string").alias("note"))
    now = e.select("user_id").distinct().where("user_id % 6 > 0").select("user_id", (C("user_id") % 3).alias("v"), F.lit(None).cast("string").alias("note"))
    return guarded.judged(attempts, now, "user_id", ["v", "note"]).select("user_id", "seq", "v", "reason")


CHAIN = """done AS (SELECT user_id, first AS state, CAST(-1 AS BIGINT) AS seq FROM s UNION ALL SELECT user_id, v, seq FROM (SELECT d.user_id, a.v, a.seq, row_number() OVER (PARTITION BY d.user_id ORDER BY a.seq) AS r FROM done d JOIN a ON a.user_id = d.user_id AND a.seq > d.seq AND a.was = d.state) WHERE r = 1)"""
query("guarded_commits", _attempts, f"""WITH RECURSIVE a AS (SELECT user_id, event_id AS seq, event_id * 7 % 3 AS was, event_id % 3 AS v FROM events), s AS (SELECT DISTINCT user_id, user_id % 3 AS first FROM events WHERE user_id % 6 > 0),
{CHAIN}
SELECT a.user_id, a.seq, a.v, CASE WHEN a.user_id % 6 = 0 THEN 'unknown' WHEN d.seq IS NULL THEN 'changed' END AS reason FROM a LEFT JOIN done d ON d.user_id = a.user_id AND d.seq = a.seq""")
query("optimistic_commits", lambda k, d: edits.commits(table(k, d, "events").select("user_id", "event_id", (C("event_id") % 4).alias("read"))), """WITH RECURSIVE a AS (SELECT user_id, event_id, event_id % 4 AS read FROM events), done AS (SELECT DISTINCT user_id, CAST(-1 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS n FROM a UNION ALL SELECT user_id, event_id, n + 1 FROM (SELECT d.user_id, a.event_id, d.n, row_number() OVER (PARTITION BY d.user_id ORDER BY a.event_id) AS r FROM done d JOIN a ON a.user_id = d.user_id AND a.event_id > d.event_id AND a.read = d.n) WHERE r = 1)
SELECT a.user_id, a.event_id, a.read, CAST(count(d.n) OVER (PARTITION BY a.user_id ORDER BY a.event_id) AS BIGINT) AS version, d.n IS NOT NULL AS applied FROM a LEFT JOIN done d ON d.user_id = a.user_id AND d.event_id = a.event_id""")
