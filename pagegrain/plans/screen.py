"""Queries of the editor's and reader's rules, manifests, images of pages, guards and run checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import editor as e
from ..functions import scalars as s
from ..operators import bench, manifest, profile
from ..sources import chapters
from ..sources import links as link_source
from . import views
from .catalog import query
from .views import PAGE_H, PAGE_W, sql, table

C = F.col


def _w() -> Column:
    return C("x2") - C("x1")


def _h() -> Column:
    return C("y2") - C("y1")


def _boxes(k: SparkSession, d: str, **columns) -> DataFrame:
    return views.box(k, d).select("page_id", "box_index", *[c.alias(n) for n, c in columns.items()])


# geometry
query("kernel_size", lambda k, d: _boxes(k, d, size=e.kernel_size(_w() * 7, _h() * 5)), sql("SELECT page_id, box_index, CAST(greatest(9, least(15, round_even(least((x2 - x1) * 7, (y2 - y1) * 5) * 0.025::DOUBLE, 0) * 2 + 1)) AS INTEGER) AS size FROM box", "box"))
query("ocr_upscale", lambda k, d: _boxes(k, d, **dict(zip(("w", "h"), e.upscaled(_w(), _h()), strict=True))), sql("""+ f AS (SELECT *, x2 - x1 AS w, y2 - y1 AS h, least(4.0::DOUBLE, greatest(64.0::DOUBLE / greatest(x2 - x1, 1), 128.0::DOUBLE / greatest(y2 - y1, 1), 1.0::DOUBLE)) AS f FROM box)
SELECT page_id, box_index, CASE WHEN h >= 128 AND w >= 64 THEN w ELSE greatest(64, CAST(floor(w * f) AS BIGINT)) END AS w, CASE WHEN h >= 128 AND w >= 64 THEN h ELSE greatest(128, CAST(floor(h * f) AS BIGINT)) END AS h FROM f""", "box"))


def _crop(k: SparkSession, d: str) -> DataFrame:
    there = C("box_index") % 2 == 0
    mask = [F.when(there, x) for x in (C("x1") % 30, C("y1") % 30, C("x1") % 30 + 9, C("y1") % 30 + 5)]
    return _boxes(k, d, **e.text_crop((C("x1"), C("y1"), C("x2"), C("y2")), mask, PAGE_W, PAGE_H))


query("ocr_crop", _crop, sql("""SELECT page_id, box_index, CASE WHEN box_index % 2 = 0 THEN greatest(x1, x1 + x1 % 30 - 12) ELSE greatest(0, x1 - 20) END AS x1, CASE WHEN box_index % 2 = 0 THEN greatest(y1, y1 + y1 % 30 - 12) ELSE greatest(0, y1 - 20) END AS y1,
  CASE WHEN box_index % 2 = 0 THEN least(x2, x1 + x1 % 30 + 21) ELSE least(400, x2 + 20) END AS x2, CASE WHEN box_index % 2 = 0 THEN least(y2, y1 + y1 % 30 + 17) ELSE least(600, y2 + 20) END AS y2 FROM box""", "box"))
query("line_components", lambda k, d: views.box(k, d).where(e.is_text_line(C("x1"), C("y1"), _w(), _h() - 20, _w() * _h() % 90, 360, 450)).select("page_id", "box_index"), sql("""+ c AS (SELECT *, x2 - x1 AS w, y2 - y1 - 20 AS h, (x2 - x1) * (y2 - y1) % 90 AS area FROM box)
SELECT page_id, box_index FROM c WHERE area >= 20 AND h >= 6 AND CAST(y1 <= 4 AS INTEGER) + CAST(y1 + h >= 446 AS INTEGER) + CAST(x1 <= 4 AS INTEGER) + CAST(x1 + w >= 356 AS INTEGER) < 2 AND NOT ((y1 <= 4 OR y1 + h >= 446) AND w / 360 > 0.85 AND h < 15)""", "box"))
query("edge_handle", lambda k, d: _boxes(k, d, mode=e.handle(C("x1") + C("y1") % (_w() + 1), C("y1") + C("x1") % (_h() + 1), C("x1"), C("y1"), C("x2"), C("y2"))), sql("""+ p AS (SELECT *, y1 % (x2 - x1 + 1) AS dx, x1 % (y2 - y1 + 1) AS dy, greatest(3.0::DOUBLE, least(10.0::DOUBLE, least(x2 - x1, y2 - y1) / 3.0::DOUBLE)) AS edge FROM box),
q AS (SELECT *, CASE WHEN dy < edge THEN 'n' WHEN y2 - y1 - dy < edge THEN 's' ELSE '' END || CASE WHEN dx < edge THEN 'w' WHEN x2 - x1 - dx < edge THEN 'e' ELSE '' END AS m FROM p)
SELECT page_id, box_index, CASE WHEN m = '' THEN 'move' ELSE m END AS mode FROM q""", "box"))
query("drawn_rectangle", lambda k, d: _boxes(k, d, **e.drawn(C("x2"), C("y1"), C("x1"), C("y2"), F.lit(0.25))), sql("""+ r AS (SELECT page_id, box_index, CAST(floor(x1 * 0.25::DOUBLE + 0.5) AS BIGINT) AS a, CAST(floor(y1 * 0.25::DOUBLE + 0.5) AS BIGINT) AS b, CAST(floor(x2 * 0.25::DOUBLE + 0.5) AS BIGINT) AS c, CAST(floor(y2 * 0.25::DOUBLE + 0.5) AS BIGINT) AS d FROM box)
SELECT page_id, box_index, CASE WHEN c - a >= 10 AND d - b >= 10 THEN a END AS x1, CASE WHEN c - a >= 10 AND d - b >= 10 THEN b END AS y1, CASE WHEN c - a >= 10 AND d - b >= 10 THEN c END AS x2, CASE WHEN c - a >= 10 AND d - b >= 10 THEN d END AS y2 FROM r""", "box"))
query("resize_clamp", lambda k, d: _boxes(k, d, **e.resized(C("x1"), C("y1"), C("x2"), C("y2"), C("box_index") * 60 - 120, C("x1") - 150, PAGE_W, PAGE_H)), sql("SELECT page_id, box_index, greatest(x1 + 10, least(400, x2 + box_index * 60 - 120)) AS x2, greatest(y1 + 10, least(600, y2 + x1 - 150)) AS y2 FROM box", "box"))
query("brush_radius", lambda k, d: views.page(k, d).select("page_id", e.brush_radius(C("price") % 3000).alias("radius")), sql("SELECT page_id, CAST(least(30, greatest(10, floor(price % 3000 * 0.018::DOUBLE + 0.5))) AS BIGINT) AS radius FROM page", "page"))
query("page_size", lambda k, d: views.page(k, d).select("page_id", F.coalesce(F.nullif(C("price") % 3, F.lit(0)), F.nullif(C("page_index") % 4, F.lit(0)), F.lit(1 << 31)).alias("width")), sql("SELECT page_id, coalesce(nullif(price % 3, 0), nullif(page_index % 4, 0), 2147483648) AS width FROM page", "page"))

# scalars
SETTING = "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'many' WHEN 3 THEN '-3' ELSE ' ' || CAST(event_id % 20 AS VARCHAR(9)) END"
query("thread_count", lambda k, d: table(k, d, "events").select("event_id", e.threads(F.expr(SETTING), C("event_id") % 12).alias("threads")), f"SELECT event_id, coalesce(greatest(1, TRY_CAST(trim(s) AS INTEGER)), CASE WHEN c >= 8 THEN 8 WHEN c >= 4 THEN 2 ELSE 1 END) AS threads FROM (SELECT event_id, event_id % 12 AS c, nullif(trim({SETTING}), '') AS s FROM events)")
query("error_message", lambda k, d: table(k, d, "events").select("event_id", e.error_message(F.element_at(F.array(*map(F.lit, (400, 404, 422, 500, 418))), (C("event_id") % 5 + 1).cast("int")), F.when(C("event_id") % 3 == 0, F.array(C("event_type"), F.lit(" "), F.lit("again"))).otherwise(F.array().cast("array<string>"))).alias("message")), """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type || '; again' ELSE ['bad request (400)', 'not found (404)', 'malformed data (422)', 'internal error (500)', 'HTTP 418'][event_id % 5 + 1] END AS message FROM events""")


def _colour() -> Column:
    """Colours of all forms, right and wrong."""
    six, kind = F.lpad(F.lower(F.hex("price")), 6, "0"), C("price") % 5
    return F.coalesce(F.when(kind == 0, F.concat(F.lit(" #"), six)).when(kind == 1, F.substring(six, 4, 3)).when(kind == 2, F.concat(F.lit("#zz"), six)).when(kind == 3, "auto"), F.lit(""))


query("hex_color", lambda k, d: views.page(k, d).select("page_id", (c := s.hex_colour(_colour(), "#808080")).alias("colour"), s.luminance(c).alias("luminance"), e.stroke_colour(s.luminance(c)).alias("stroke")), sql("""+ h AS (SELECT page_id, price % 5 AS m, upper(lpad(to_hex(price), 6, '0')) AS h FROM page),
c AS (SELECT page_id, CASE m WHEN 0 THEN h WHEN 1 THEN h[4:4] || h[4:4] || h[5:5] || h[5:5] || h[6:6] || h[6:6] ELSE '808080' END AS c FROM h),
l AS (SELECT page_id, c, (299 * CAST('0x' || c[1:2] AS BIGINT) + 587 * CAST('0x' || c[3:4] AS BIGINT) + 114 * CAST('0x' || c[5:6] AS BIGINT)) / 1000 AS luminance FROM c)
SELECT page_id, '#' || c AS colour, luminance, CASE WHEN luminance > 128 THEN '#000000' ELSE '#FFFFFF' END AS stroke FROM l""", "page"))
NAME = "CASE p_partkey % 3 WHEN 0 THEN 'Page' || CAST(p_partkey AS VARCHAR(20)) || '.png' WHEN 1 THEN '00' || CAST(p_partkey AS VARCHAR(20)) || 'b' ELSE 'x1234567890123456789012' || CAST(p_partkey AS VARCHAR(20)) END"
query("natural_sort", lambda k, d: table(k, d, "part").select("p_partkey", s.natural_key(F.expr(NAME)).alias("key")), """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'page' || lpad(CAST(length(n) AS VARCHAR), 6, '0') || '~' || n || '.png' WHEN 1 THEN lpad(CAST(length(n) AS VARCHAR), 6, '0') || '~' || n || 'b'
  ELSE 'x' || lpad(CAST(22 + length(n) AS VARCHAR), 6, '0') || '~1234567890123456789012' || n END AS key FROM (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS n FROM part)""")

# manifests and pages
IDS = "CASE c_custkey % 4 WHEN 0 THEN substring(md5(CAST(c_custkey AS VARCHAR(20))), 1, 8) WHEN 1 THEN upper(substring(md5(CAST(c_custkey AS VARCHAR(20))), 1, 8)) WHEN 2 THEN substring(md5(CAST(c_custkey AS VARCHAR(20))), 1, 9) ELSE NULL END"
query("chapter_ids", lambda k, d: table(k, d, "customer").select("c_custkey", chapters.valid_id(F.expr(IDS)).alias("valid")), f"SELECT c_custkey, coalesce(regexp_full_match({IDS}, '[a-f0-9]{{8}}'), false) AS valid FROM customer")
TEXT = """CASE c_custkey % 5 WHEN 0 THEN '{"pages": [' WHEN 1 THEN '{"pages": []}' WHEN 2 THEN '{"pages": [{"original": "a"}]}'
  ELSE concat('{"source_url": "u', c_custkey, '", "pages": [{"original": "a"}, {"original": "b", "boxes": [{"x1": 1}]}], "workflow": {"stage": "review", "page_index": ', c_custkey % 4, '}}') END"""
query("chapter_scan", lambda k, d: chapters.summaries(table(k, d, "customer").select(C("c_custkey").alias("chapter_id"), F.expr(TEXT).alias("manifest"), (C("c_custkey") * 7 % 1000).alias("updated"))), """SELECT c_custkey AS chapter_id, CASE WHEN m = 2 THEN '' ELSE 'u' || c_custkey END AS source_url, CASE WHEN m = 2 THEN 1 ELSE 2 END AS pages, CASE WHEN m = 2 THEN 'preview' ELSE 'review' END AS stage,
  CAST(CASE WHEN m = 2 THEN 0 ELSE c_custkey % 4 END AS INTEGER) AS page_index, c_custkey * 7 % 1000 AS updated FROM (SELECT c_custkey, c_custkey % 5 AS m FROM customer) WHERE m >= 2""")
IMAGES = """concat(coalesce(html, ''), '<img src="', coalesce(url, ''), '"><IMG alt="" data-src=''', coalesce(url, ''), '?d'' src="x.png"><!-- <img src="http://no.example/"> --><img src=/rel/', page_id, '.png><img data-src="" src="https://a.example/', page_id, '.png">')"""
query("image_links", lambda k, d: link_source.images(table(k, d, "pages").select("page_id", F.expr(IMAGES).alias("html"))), f"""WITH h AS (SELECT page_id, regexp_extract_all(regexp_replace({IMAGES}, '(?is)<!--.*?-->|<script\\b.*?</script>', '', 'g'), '(?i)<img\\b[^>]*>') AS t FROM pages), i AS (SELECT page_id, unnest(t) AS tag, unnest(range(len(t))) AS place FROM h),
v AS (SELECT page_id, place, {', '.join(f"nullif(trim(regexp_extract(tag, '{p}', 1) || regexp_extract(tag, '{p}', 2) || regexp_extract(tag, '{p}', 3)), '') AS {n}" for n, p in (('d', '(?i)\\sdata-src\\s*=\\s*(?:"([^"]*)"|\'\'([^\'\']*)\'\'|([^\\s>"\'\']+))'), ('s', '(?i)\\ssrc\\s*=\\s*(?:"([^"]*)"|\'\'([^\'\']*)\'\'|([^\\s>"\'\']+))')))} FROM i)
SELECT page_id, CAST(place AS INTEGER) AS place, coalesce(d, s) AS link FROM v WHERE regexp_matches(coalesce(d, s), '(?i)^https?://')""")
query("missing_models", lambda k, d: table(k, d, "part").select("p_partkey").join(table(k, d, "lineitem").where("l_quantity > 49").select(C("l_partkey").alias("p_partkey")), "p_partkey", "left_anti"), "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
query("affected_pages", lambda k, d: views.box(k, d).where("removed").select("page_id").distinct(), sql("SELECT DISTINCT page_id FROM box WHERE removed", "box"))
query("page_failures", lambda k, d: manifest.failures(views.page(k, d).select("chapter_id", C("page_index").cast("int").alias("page_index"), F.when(C("price") % 3 == 0, F.concat(F.lit("e"), C("price").cast("string"))).alias("error"))), sql("""+ f AS (SELECT chapter_id, count(*) AS n, count(*) FILTER (WHERE price % 3 = 0) AS failed, string_agg(CAST(page_index AS VARCHAR), ', ' ORDER BY page_index) FILTER (WHERE price % 3 = 0) AS which, arg_min(price, page_index) FILTER (WHERE price % 3 = 0) AS p FROM page GROUP BY chapter_id)
SELECT chapter_id, failed, CASE WHEN failed = n THEN 'all pages failed, first: e' || p ELSE 'failed: ' || which || '; first: e' || p END AS message FROM f WHERE failed > 0""", "page"))

# guards
STATE = ["chapter_id", "page_index", "skipped", "price"]
query("state_fingerprint", lambda k, d: manifest.fingerprint(views.page(k, d).withColumn("price", F.when(C("price") % 2 == 0, C("price"))), "page_id", STATE), sql("""SELECT page_id, sha256('{"chapter_id":' || chapter_id || ',"page_index":' || page_index || ',"skipped":' || CAST(skipped AS VARCHAR) || ',"price":' || CASE WHEN price % 2 = 0 THEN CAST(price AS VARCHAR) ELSE 'null' END || '}') AS state FROM page""", "page"))
query("commit_guard", lambda k, d: manifest.guarded(p := views.page(k, d), p.where("page_id % 11 > 0").withColumn("skipped", C("skipped") | (C("price") % 4 == 0)), "page_id", STATE), sql("SELECT page_id, page_id % 11 > 0 AND (skipped OR price % 4 <> 0) AS committed FROM page", "page"))
query("ocr_write_back", lambda k, d: manifest.write_back(b := views.box(k, d), b.withColumn("x2", C("x2") + (C("y1") % 4 == 0).cast("int"))), sql("+ r AS (SELECT page_id, box_index, x1, y1, x2 + CAST(y1 % 4 = 0 AS INTEGER) AS x2, y2 FROM box) SELECT b.page_id, b.box_index, NOT removed AND (b.x1, b.y1, b.x2, b.y2) = (r.x1, r.y1, r.x2, r.y2) AS written FROM box b JOIN r ON r.page_id = b.page_id AND r.box_index = b.box_index", "box"))
query("stale_commits", lambda k, d: manifest.stale(table(k, d, "events"), "user_id", F.unix_micros(C("ts").cast("timestamp")) - (C("event_id") % 7) * 3_600_000_000), """SELECT user_id, event_id, CAST(row_number() OVER w AS INTEGER) AS version, coalesce(epoch_us(lag(ts) OVER w) > epoch_us(ts) - (event_id % 7) * 3600000000, false) AS stale FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")

# runs
METRICS = "model_calls cluster_count tile_count active_tile_count shortcut_count".split()
query("telemetry_summary", lambda k, d: bench.telemetry_summary(views.run(k, d)), sql("SELECT case_id, metric, min(v) AS least, max(v) AS most, round(avg(v), 2) AS mean, min(v) = max(v) AS invariant FROM (" + " UNION ALL ".join(f"SELECT case_id, '{m}' AS metric, CAST({m} AS BIGINT) AS v FROM run" for m in METRICS) + ") GROUP BY case_id, metric", "invocation", "run"))
query("case_set_diff", lambda k, d: bench.set_difference(*(views.invocation(k, d).where(f"user_id % 20 <> {x}").select("case_id").distinct() for x in (3, 5))), sql("+ c AS (SELECT DISTINCT case_id, user_id % 20 AS u FROM invocation) SELECT case_id, CASE WHEN u = 5 THEN 'baseline' ELSE 'candidate' END AS side FROM c WHERE u IN (3, 5)", "invocation"))
query("workload_hash", lambda k, d: manifest.fingerprint(views.box(k, d).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("x1", "y1", "x2", "y2", "box_index"))).alias("boxes")), "page_id", ["boxes"]), sql("""SELECT page_id, sha256('{"boxes":[' || string_agg('{"x1":' || x1 || ',"y1":' || y1 || ',"x2":' || x2 || ',"y2":' || y2 || ',"box_index":' || box_index || '}', ',' ORDER BY x1, y1, x2, y2, box_index) || ']}') AS state FROM box GROUP BY page_id""", "box"))
query("file_integrity", lambda k, d: bench.tampered((p := table(k, d, "pages").where("html is not null")).where("page_id % 5 > 0").select(C("page_id").cast("string").alias("name"), C("html").cast("binary").alias("content")), p.select(C("page_id").cast("string").alias("name"), F.sha2(F.when(C("page_id") % 7 == 0, F.concat("html", F.lit("x"))).otherwise(C("html")).cast("binary"), 256).alias("expected"))), """WITH e AS (SELECT page_id, sha256(CASE WHEN page_id % 7 = 0 THEN html || 'x' ELSE html END) AS expected FROM pages WHERE html IS NOT NULL), f AS (SELECT page_id, sha256(html) AS found FROM pages WHERE html IS NOT NULL AND page_id % 5 > 0)
SELECT CAST(e.page_id AS VARCHAR) AS name, CASE WHEN found IS NULL THEN 'missing' WHEN found = expected THEN 'ok' ELSE 'changed' END AS state FROM e LEFT JOIN f ON f.page_id = e.page_id""")


def _gate(k: SparkSession, d: str) -> DataFrame:
    e_ = table(k, d, "embeddings").select(C("vec_id").alias("img"))
    golden = C("img") % 9 > 0
    base = F.when(C("img") % 2 == 0, 40.0)
    return bench.quality_gate(e_.select("img", F.when(golden, 28.0 + C("img") % 13).alias("psnr"), (0.84 + (C("img") % 17) / 100).alias("ssim"), (C("img") % 7).cast("double").alias("mae"), base.alias("base_psnr"), F.lit(0.9).alias("base_ssim"), F.lit(3.0).alias("base_mae")))


query("quality_gate", _gate, """WITH q AS (SELECT vec_id AS img, CASE WHEN vec_id % 9 > 0 THEN 28.0::DOUBLE + vec_id % 13 END AS p, 0.84::DOUBLE + (vec_id % 17) / 100::DOUBLE AS s, vec_id % 7 AS m, CASE WHEN vec_id % 2 = 0 THEN 40 ELSE 100 END AS bp FROM embeddings)
SELECT img, CASE WHEN p IS NULL THEN 'incompatible' WHEN p < 30 OR s < 0.85::DOUBLE OR m > 5 OR round(bp - p, 2) > 2 OR round(0.9::DOUBLE - s, 4) > 0.05::DOUBLE OR m - 3 > 2 THEN 'regression' ELSE 'ok' END AS status FROM q""")

# rasters
query("mask_dilate", lambda k, d: profile.grown(views.pixel(k, d), 1), sql("""+ r AS (SELECT img, y, x, max(v) OVER (PARTITION BY img, y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM px)
SELECT img, y, x, max(v) OVER (PARTITION BY img, x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM r""", "px"))
query("has_paint", lambda k, d: profile.painted(views.pixel(k, d), 250), sql("SELECT img, bool_or(v > 250) AS painted FROM px GROUP BY img", "px"))
