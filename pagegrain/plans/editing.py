"""Queries over chapters, edits, styles and readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import layout
from ..operators import manifest
from ..sources import fonts
from . import views
from .catalog import query
from .views import PAGE_H, PAGE_W, sql, table


def _chapters(k: SparkSession, d: str) -> DataFrame:
    box = F.struct("x1", "y1", "x2", "y2", F.lit("m").alias("mask"))
    boxes = views.box(k, d).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("box_index", box.alias("box")))).alias("boxes"))
    pages = views.page(k, d).join(boxes.select("page_id", F.transform("boxes", lambda b: b["box"]).alias("boxes")), "page_id", "left")
    page = F.struct("page_index", F.lit("raw/a.png").alias("original"), F.when(~F.col("skipped"), "clean/a.png").alias("clean"), "boxes")
    return pages.groupBy("chapter_id").agg(F.sort_array(F.collect_list(page)).alias("pages"))


def _public(k: SparkSession, d: str) -> DataFrame:
    flat = manifest.public_view(_chapters(k, d)).select("chapter_id", F.explode("pages").alias("p"))
    return flat.select("chapter_id", "p.page_index", "p.original", "p.clean", F.coalesce(F.size("p.boxes"), F.lit(0)).alias("n"))


query("public_manifest", _public, sql("SELECT chapter_id, page_index, '/api/image/' || chapter_id || '/' || page_index || '/original' AS original, CASE WHEN NOT skipped THEN '/api/image/' || chapter_id || '/' || page_index || '/clean' END AS clean, (SELECT count(*) FROM box b WHERE b.page_id = page.page_id) AS n FROM page", "page", "box"))
query("region_normalize", lambda k, d: (b := views.box(k, d)).select("page_id", "box_index", F.when(F.col("box_index") % 2 == 0, F.col("x2") + 90).otherwise(F.col("x1") - 50).alias("x1"), F.col("y2").alias("y1"), "x2", F.col("y1").alias("y2")).select("page_id", "box_index", *[c.alias(n) for n, c in manifest.normal_region(PAGE_W, PAGE_H).items()]), sql("""+ r AS (SELECT page_id, box_index, greatest(0, least(CASE WHEN box_index % 2 = 0 THEN x2 + 90 ELSE x1 - 50 END, 400)) AS a, least(x2, 400) AS b, least(y2, 600) AS c, y1 AS e FROM box)
SELECT page_id, box_index, least(a, b) AS nx1, greatest(a, b) AS nx2, least(c, e) AS ny1, greatest(c, e) AS ny2, abs(a - b) >= 10 AND abs(c - e) >= 10 AS ok FROM r""", "box"))
query("box_rule_violations", lambda k, d: manifest.edit_violation(views.box(k, d).withColumns({"x1": F.col("x1") - 20, "y2": F.col("y2") - F.col("box_index") * 9}), PAGE_W, PAGE_H), sql("""SELECT * FROM (SELECT page_id, box_index, CASE WHEN x1 - 20 < 0 THEN 'negative' WHEN x1 - 20 >= x2 OR y1 >= y2 - box_index * 9 THEN 'reversed' WHEN x2 > 400 OR y2 - box_index * 9 > 600 THEN 'beyond image' WHEN x2 - x1 + 20 < 10 OR y2 - box_index * 9 - y1 < 10 THEN 'too small' END AS violation FROM box) WHERE violation IS NOT NULL""", "box"))


def _objects(k: SparkSession, d: str) -> DataFrame:
    return views.page(k, d).select("page_id", F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("text "), F.col("page_id").cast("string"))).otherwise("").alias("translation"), F.when(F.col("page_id") % 2 == 0, "#00FF00").alias("color"), F.when(F.col("page_id") % 5 == 0, F.lit(True)).alias("bold"), F.when(F.col("page_id") % 7 == 0, "").alias("font"))


def _asked(k: SparkSession, d: str) -> DataFrame:
    return views.page(k, d).where("page_id % 4 < 2").select("page_id", F.when(F.col("page_id") % 4 == 0, "").otherwise("asked").alias("translation"), F.when(F.col("page_id") % 6 == 0, "").alias("color"))


query("style_coalesce", lambda k, d: manifest.styles(_objects(k, d), _asked(k, d), "page_id"), sql("""SELECT page_id, translation, CASE WHEN asked AND page_id % 6 = 0 THEN '' WHEN page_id % 2 = 0 THEN '#00FF00' ELSE 'auto' END AS color, CASE WHEN page_id % 7 = 0 THEN '' ELSE 'default' END AS font, 'auto' AS "fontSize", page_id % 5 = 0 AS bold, 'auto' AS "strokeWidth", 'auto' AS "strokeColor", 'transparent' AS "bgColor", '0' AS "cornerRadius", 'center' AS "horizontalAlign", 'middle' AS "verticalAlign"
FROM (SELECT page_id, page_id % 4 < 2 AS asked, CASE WHEN page_id % 4 = 1 THEN 'asked' WHEN page_id % 3 > 0 THEN 'text ' || page_id ELSE '' END AS translation FROM page) WHERE translation <> ''""", "page"))
query("style_defaults", lambda k, d: manifest.sanitised(views.page(k, d).select("page_id", F.map_concat(F.create_map(F.lit("horizontalAlign"), F.element_at(F.array(*map(F.lit, ("left", "right", "justify"))), (F.col("page_id") % 3 + 1).cast("int"))), F.when(F.col("page_id") % 5 == 0, F.create_map(F.lit("shadow"), F.lit("1"))).otherwise(F.create_map(F.lit("font"), F.lit("wide")))).alias("style")), "page_id"), sql("""SELECT page_id, 'auto' AS color, CASE WHEN page_id % 5 = 0 THEN 'default' ELSE 'wide' END AS font, 'auto' AS "fontSize", 'false' AS bold, 'auto' AS "strokeWidth", 'auto' AS "strokeColor", 'transparent' AS "bgColor", '0' AS "cornerRadius", ['left', 'right', 'justify'][page_id % 3 + 1] AS "horizontalAlign", 'middle' AS "verticalAlign",
  CASE WHEN page_id % 5 = 0 THEN 'unknown key' WHEN page_id % 3 = 2 THEN 'horizontalAlign' END AS error FROM page""", "page"))
query("render_candidates", lambda k, d: manifest.render_candidates(views.page(k, d).select("page_id", F.when(F.col("page_id") % 3 == 0, "x").otherwise((F.col("price") % 9).cast("string")).alias("box_key")), views.page(k, d).select(F.concat("page_id", F.lit("_"), F.col("price") % 4).alias("draft_key"), F.when(F.col("price") % 2 == 0, "t").otherwise("").alias("text")), views.box(k, d)), sql("""SELECT page_id, box_index FROM box WHERE NOT removed AND (page_id, box_index) IN (SELECT (page_id, price % 9) FROM page WHERE page_id % 3 > 0 UNION SELECT (page_id, price % 4) FROM page WHERE price % 2 = 0)""", "page", "box"))


def _drafts(k: SparkSession, d: str) -> DataFrame:
    """Drafts of a page and of the tenfold page: the prefix must end at its underscore."""
    p, i = F.col("page_id").cast("string"), F.col("price") % 4
    drafts = F.create_map(F.concat(p, F.lit("_0")), i.cast("string"), F.concat(p, F.lit("0_1")), F.lit("other"), F.concat(p, F.lit("_2")), F.lit("second"))
    return views.page(k, d).select("page_id", F.array_join(F.array_sort(F.map_values(manifest.page_drafts(drafts, F.col("page_id")))), ",").alias("drafts"))


query("draft_prefix", _drafts, sql("SELECT page_id, (price % 4) || ',second' AS drafts FROM page", "page"))
query("ocr_cache", lambda k, d: manifest.cached_text((t := table(k, d, "documents")).select("doc_id", "lang", "text"), t.where("doc_id % 3 > 0").select("doc_id", F.when(F.col("doc_id") % 3 == 1, "seen").otherwise("").alias("ocr_text"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("xx").alias("ocr_lang")), "doc_id"), "SELECT doc_id, hit, CASE WHEN hit THEN 'seen' ELSE text END AS text FROM (SELECT doc_id, text, coalesce(doc_id % 3 = 1 AND doc_id % 2 = 0 AND lang IS NOT NULL, false) AS hit FROM documents)")
query("stage_infer", lambda k, d: manifest.stage(views.page(k, d).select("chapter_id", (F.col("price") % 20 == 0).alias("rendered"), F.when(F.col("price") % 7 == 0, "c").alias("clean"))), sql("SELECT chapter_id, CASE WHEN bool_or(price % 20 = 0) THEN 'editor' WHEN bool_or(price % 7 = 0) THEN 'review' ELSE 'preview' END AS stage FROM page GROUP BY chapter_id", "page"))
query("save_status", lambda k, d: manifest.save_status(table(k, d, "events").select("user_id", (F.col("event_id") % 200 == 0).alias("error"), F.when(F.col("event_id") % 150 == 1, 1).otherwise(0).alias("saving"), F.when(F.col("event_id") % 50 == 2, 1).otherwise(0).alias("dirty")), "user_id"), "SELECT user_id, CASE WHEN bool_or(event_id % 200 = 0) THEN 'error' WHEN bool_or(event_id % 150 = 1) THEN 'saving' WHEN bool_or(event_id % 50 = 2) THEN 'dirty' ELSE 'saved' END AS status FROM events GROUP BY user_id")


def _served(k: SparkSession, d: str) -> DataFrame:
    original, clean, rendered = F.lit("o"), F.when(F.col("price") % 3 > 0, "c"), F.when(F.col("price") % 5 == 0, "r")
    kind = F.when(F.col("page_id") % 2 == 0, "rendered").otherwise("clean")
    return views.page(k, d).select("page_id", manifest.served_file(kind, original, clean, rendered).alias("file"), manifest.synced_file(rendered.isNotNull(), clean, original).alias("copied"))


query("served_file", _served, sql("SELECT page_id, CASE WHEN page_id % 2 = 0 AND price % 5 = 0 THEN 'r' WHEN price % 3 > 0 THEN 'c' WHEN page_id % 2 = 0 THEN 'o' END AS file, CASE WHEN price % 5 <> 0 THEN CASE WHEN price % 3 > 0 THEN 'c' ELSE 'o' END END AS copied FROM page", "page"))
query("tombstones", lambda k, d: manifest.without(views.box(k, d), views.page(k, d).select("page_id", (F.col("price") % 5).alias("box_index"))).select("page_id", "box_index", "removed"), sql("SELECT page_id, box_index, removed OR EXISTS (SELECT 1 FROM page p WHERE p.page_id = box.page_id AND p.price % 5 = box.box_index) AS removed FROM box", "page", "box"))
query("render_invalidation", lambda k, d: manifest.is_rendered(views.page(k, d).select("page_id", F.when(F.col("price") % 4 > 0, F.col("price") % 100).alias("rendered_at")), views.box(k, d).select("page_id", F.col("x1").alias("at"))), sql("SELECT p.page_id, price % 4 > 0 AND coalesce(price % 100 > m, true) AS rendered FROM page p LEFT JOIN (SELECT page_id, max(x1) AS m FROM box GROUP BY 1) b ON p.page_id = b.page_id", "page", "box"))
query("keep_manual", lambda k, d: manifest.keep_manual((b := views.box(k, d)).where("not removed").select("page_id", "box_index"), b.where("removed").withColumn("manual", F.col("box_index") % 2 == 0)), sql("SELECT page_id, box_index FROM box WHERE NOT removed OR box_index % 2 = 0", "box"))
query("upload_guard", lambda k, d: manifest.accept_uploads(table(k, d, "orders").select(F.col("o_custkey").alias("chapter_id"), F.when(F.col("o_orderkey") % 2 == 0, "f").alias("name"), F.col("o_totalprice").cast("long").alias("size")), 9, 1_500_000), "SELECT chapter_id, CASE WHEN n = 0 THEN 'no file' WHEN n > 9 THEN 'too many files' WHEN b > 1500000 THEN 'too large' END AS refused FROM (SELECT o_custkey AS chapter_id, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS n, sum(CAST(trunc(o_totalprice) AS BIGINT)) AS b FROM orders GROUP BY 1)")

RAW, READ = ("CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN ' ' WHEN 2 THEN NULL ELSE '.' END", "CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN concat(text, '!') ELSE '' END")
query("ocr_choice", lambda k, d: table(k, d, "documents").select("doc_id", layout.read_choice(F.expr(RAW), F.expr(READ)).alias("text")), f"SELECT doc_id, CASE WHEN length(trim(r)) >= 2 THEN r WHEN length(e) >= length(r) THEN e ELSE r END AS text FROM (SELECT doc_id, coalesce({RAW}, '') AS r, coalesce({READ}, '') AS e FROM documents)")
query("ocr_lines", lambda k, d: table(k, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("turn").alias("y"), "text", (F.col("turn") % 4 / 4).alias("confidence"))).alias("l")).select("conv_id", layout.joined_lines(F.col("l")).alias("text")), "SELECT c.conv_id, coalesce(t, '') AS text FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT conv_id, string_agg(trim(text, ' '), chr(10) ORDER BY turn, text) AS t FROM conversations WHERE turn % 4 > 1 AND trim(text, ' ') <> '' GROUP BY 1) x ON c.conv_id = x.conv_id")


def _layout(k: SparkSession, d: str) -> DataFrame:
    pad, w, h = layout.inner_box(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    align = F.element_at(F.array(*map(F.lit, ("left", "center", "right"))), (F.col("box_index") % 3 + 1).cast("int"))
    x, y = layout.start(F.col("x1"), pad, w, F.lit(31), align, "left", "right"), layout.start(F.col("y1"), pad, h, F.lit(17), F.lit("middle"), "top", "bottom")
    return views.box(k, d).select("page_id", "box_index", pad.alias("pad"), x.alias("x"), y.alias("y"))


query("text_layout", _layout, sql("""+ p AS (SELECT *, greatest(2, least(6, CAST(floor(least(x2 - x1, y2 - y1) * 0.08::DOUBLE) AS BIGINT))) AS pad FROM box)
SELECT page_id, box_index, pad, x1 + pad + CASE box_index % 3 WHEN 0 THEN 0 WHEN 1 THEN greatest(0, x2 - x1 - 2 * pad - 31) // 2 ELSE greatest(0, x2 - x1 - 2 * pad - 31) END AS x, y1 + pad + greatest(0, y2 - y1 - 2 * pad - 17) // 2 AS y FROM p""", "box"))
query("font_fit", lambda k, d: layout.fitted(table(k, d, "orders").select(F.col("o_orderkey").alias("page_id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus", F.col("o_totalprice").cast("string")).alias("text"), (40 + F.col("o_custkey") % 200).alias("width"), (30 + F.col("o_orderkey") % 150).alias("height")), "page_id"))
query("font_catalogue", lambda k, d: fonts.catalogue(table(k, d, "part").select(F.concat(F.when(F.col("p_size") % 2 == 0, F.upper(F.translate("p_name", " ", "_"))).otherwise(F.translate("p_name", " ", "-")), F.lit(".ttf")).alias("name"))), """SELECT id, name FROM (SELECT id, string_agg(upper(w[1:1]) || lower(w[2:]), ' ' ORDER BY i) AS name FROM (SELECT id, unnest(string_split_regex(id, '[-_]')) AS w, generate_subscripts(string_split_regex(id, '[-_]'), 1) AS i FROM (SELECT min(s) AS id FROM (SELECT CASE WHEN p_size % 2 = 0 THEN upper(replace(p_name, ' ', '_')) ELSE replace(p_name, ' ', '-') END AS s FROM part) GROUP BY lower(s))) GROUP BY id) UNION ALL SELECT 'default', 'Default'""")
