"""Queries of a page's processing as a whole, its second pass, commits of its results, and files of slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import editor, layout
from ..functions import scalars as s
from ..operators import fill, manifest, processing, profile, raster
from ..operators.held import folder
from ..sources import chapters, masks, output
from . import detection, media, views
from .catalog import query
from .views import sql, table

C = F.col


def excluded(k: SparkSession, d: str) -> DataFrame:
    i = C("vec_id")
    return table(k, d, "embeddings").select(i.alias("page_id"), (i % 50).alias("ax"), (i % 50 + 40).alias("bx"), (i % 160 + 30).alias("ay"), (i % 160).alias("cy"))


def found(k: SparkSession, d: str) -> DataFrame:
    return processing.found_boxes(detection.page_rows(k, d), detection.page_boxes(k, d), excluded(k, d), detection.WIDE, detection.HIGH)


query("page_plan", lambda k, d: processing.page_plan(detection.page_rows(k, d), found(k, d)).select("img", "part", F.array_join(C("boxes").cast("array<string>"), ",").alias("boxes"), "x1", "y1", "x2", "y2", "pixels", "route", "value"))


def edited(k: SparkSession, d: str) -> DataFrame:
    """The scenes of the fill plans after an edit: some boxes removed, and a mask of half the page's size painted by hand."""
    small = media.marks(20, (3, 6), (4, 5))
    boxes = F.transform("boxes", lambda b: b.withField("removed", (b["box_index"] + C("img")) % 3 == 0))
    return media.scene(k, d, small).select("img", "gray", boxes.alias("boxes"), F.when(C("img") % 5 > 0, C("mask")).alias("manual"))


query("second_plan", lambda k, d: fill.second_plan(edited(k, d)).select("img", "part", F.array_join(C("boxes").cast("array<string>"), ",").alias("boxes"), "x1", "y1", "x2", "y2", "pixels", "route", "value", "waits_for"))


def _results(k: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two thirds of the pages have results; what they have seen is their boxes' number, which is their state."""
    n = views.box(k, d).groupBy("page_id").agg(F.count("*").alias("n"), F.count_if("removed").alias("gone"))
    p = views.page(k, d).join(n, "page_id", "left").select("page_id", "chapter_id", "page_index", F.when(C("price") % 4 == 0, "old").alias("clean"), (C("price") % 2 == 0).alias("rendered"), F.sha2(F.coalesce("n", F.lit(0)).cast("string"), 256).alias("state"))
    r = views.page(k, d).join(n, "page_id", "left").where("page_id % 3 > 0").select("page_id", F.lit("new").alias("clean"), F.when(C("price") % 5 == 0, F.concat(F.lit("e"), C("page_id").cast("string"))).alias("error"), F.sha2((C("n") - F.when(C("gone") > 2, 1).otherwise(0)).cast("string"), 256).alias("seen"))
    return p, r


RESULTS = """+ n AS (SELECT page_id, count(*) AS n, count(*) FILTER (WHERE removed) AS gone FROM box GROUP BY page_id),
o AS (SELECT p.page_id, chapter_id, page_index, price, page_id % 3 > 0 AS there, CASE WHEN page_id % 3 > 0 THEN CASE WHEN price % 5 = 0 THEN 'failed' WHEN n IS NULL OR gone > 2 THEN 'stale' ELSE 'committed' END END AS outcome FROM page p LEFT JOIN n USING (page_id))
"""
query("partial_commit", lambda k, d: processing.committed(*_results(k, d)), sql(RESULTS + "SELECT page_id, chapter_id, page_index, CASE WHEN outcome = 'committed' THEN 'new' WHEN price % 4 = 0 THEN 'old' END AS clean, price % 2 = 0 AND outcome IS DISTINCT FROM 'committed' AS rendered, outcome FROM o", "page", "box"))
query("processing_outcomes", lambda k, d: processing.outcomes(processing.committed(*_results(k, d)), _results(k, d)[1]), sql(RESULTS + """SELECT chapter_id, CASE WHEN bool_or(outcome = 'committed') THEN 'review' END AS stage, CAST(min(page_index) FILTER (WHERE outcome = 'committed') AS INTEGER) AS page_index,
  CASE WHEN count(*) FILTER (WHERE outcome = 'failed') = 0 THEN NULL WHEN bool_and(outcome = 'failed') THEN 'all pages failed, first: ' ELSE 'failed: ' || string_agg(CAST(page_index AS VARCHAR), ', ' ORDER BY page_index) FILTER (WHERE outcome = 'failed') || '; first: ' END || 'e' || arg_min(page_id, page_index) FILTER (WHERE outcome = 'failed') AS message
FROM o WHERE there GROUP BY chapter_id""", "page", "box"))


def slices(k: SparkSession, d: str) -> DataFrame:
    """Pages of 640 rows cut at rows that depend on their ids, as files, read back.  Parts meet the vectors that pages are made of: pixels
    are neither shuffled nor broadcast, which the planner would do, for it takes an array for a single value."""
    pages = table(k, d, "embeddings").select(C("vec_id").alias("img"), "embedding")
    cuts = pages.select("img", F.explode(F.array(*(F.lit(x) + C("img") % 20 for x in (150, 300, 480)))).alias("cut"))
    parts = raster.slices(pages.select("img", F.lit(640).alias("height")), cuts, F.concat(F.lit("p"), C("img").cast("string")), F.lit(".png"))
    listed = parts.groupBy("img").agg(F.sort_array(F.collect_list(F.struct("place", "top", "bottom", "name"))).alias("parts"))
    return output.slice_files(pages.join(listed, "img").select("img", media.tall_gray().alias("gray"), "parts"))


def _read_back(k: SparkSession, d: str) -> DataFrame:
    files = slices(k, d).withColumns({"key": F.concat_ws(":", "img", "name"), "payload": F.base64("content")})
    total = F.aggregate(F.flatten("mask"), F.lit(0).cast("long"), lambda a, v: a + v)
    return masks.stored_masks(files, "key", "payload").select("key", "width", "height", total.alias("total"))


query("slice_files", _read_back, """WITH e AS (SELECT vec_id AS img, unnest(embedding) AS e, unnest(range(64)) AS i FROM embeddings),
r AS (SELECT img, i * 10 + j AS y, CAST(CASE WHEN e < -0.17::DOUBLE THEN 24 * 255 + 24 * floor((e + 1) * 120) WHEN e > 0.2::DOUBLE THEN 43 * 255 + 5 * 60 ELSE 48 * 255 END AS BIGINT) AS s FROM e, range(10) t(j)),
p AS (SELECT *, CAST(y >= 150 + img % 20 AS INTEGER) + CAST(y >= 300 + img % 20 AS INTEGER) + CAST(y >= 480 + img % 20 AS INTEGER) AS place FROM r)
SELECT img || ':p' || img || '_0' || place || '.png' AS key, 48 AS width, CAST(count(*) AS INTEGER) AS height, CAST(sum(s) AS BIGINT) AS total FROM p GROUP BY img, place""")
query("text_background", lambda k, d: views.box(k, d).select("page_id", "box_index", layout.corner_radius(C("x1") - 40, C("x2") - C("x1"), C("y2") - C("y1")).alias("radius"), F.size(layout.bold_offsets(C("removed"))).alias("draws"), layout.has_background(F.element_at(F.array(F.lit("transparent"), F.lit("none"), F.lit(""), F.lit("#fff"), F.lit(None).cast("string")), (C("box_index") % 5 + 1).cast("int"))).alias("filled")), sql("SELECT page_id, box_index, CAST(greatest(0, least(x1 - 40, (least(x2 - x1, y2 - y1) - 1) // 2)) AS INTEGER) AS radius, CAST(CASE WHEN removed THEN 4 ELSE 1 END AS INTEGER) AS draws, box_index % 5 = 3 AS filled FROM box", "box"))
query("reader_choice", lambda k, d: table(k, d, "documents").select("doc_id", s.reader(F.when(C("doc_id") % 4 == 0, "ja").when(C("doc_id") % 4 == 1, "ko").otherwise(C("lang"))).alias("r")).select("doc_id", "r.reader", "r.name"), "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'page' ELSE 'lines' END AS reader, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'korean' ELSE CASE lower(lang) WHEN 'ko' THEN 'korean' WHEN 'zh' THEN 'ch' WHEN 'ja' THEN 'japan' ELSE lang END END AS name FROM documents")


def _region_changes(k: SparkSession, d: str) -> DataFrame:
    """Boxes as regions that are moved: by two thirds of their width to the left, or beyond the page; some reversed, some without a corner, some pages without a size."""
    x1, x2 = C("x1") - F.when(C("box_index") % 3 == 0, 60).otherwise(0), C("x2") + F.when(C("box_index") % 3 == 1, 200).otherwise(0)
    y2 = F.when(C("box_index") % 5 == 4, C("y1") - 1).when(C("page_id") % 7 > 0, C("y2"))
    known = C("page_id") % 4 > 0
    corners, refused = editor.region_change(x1, C("y1"), x2, y2, F.when(known, 400), F.when(known, 600))
    return views.box(k, d).select("page_id", "box_index", *(c.alias(n) for n, c in corners.items()), refused.alias("refused"))


query("region_change", _region_changes, sql("""+ r AS (SELECT page_id, box_index, x1 - CASE WHEN box_index % 3 = 0 THEN 60 ELSE 0 END AS a, y1 AS b, x2 + CASE WHEN box_index % 3 = 1 THEN 200 ELSE 0 END AS c, CASE WHEN box_index % 5 = 4 THEN y1 - 1 WHEN page_id % 7 > 0 THEN y2 END AS e, page_id % 4 > 0 AS known FROM box),
q AS (SELECT *, CASE WHEN known THEN greatest(0, least(a, 400)) ELSE a END AS p1, CASE WHEN known THEN least(c, 400) ELSE c END AS p2, CASE WHEN known THEN least(b, 600) ELSE b END AS q1, CASE WHEN known THEN greatest(0, least(e, 600)) ELSE e END AS q2 FROM r),
f AS (SELECT *, CASE WHEN e IS NULL THEN 'invalid' WHEN a < 0 OR b < 0 THEN 'negative' WHEN a >= c OR b >= e THEN 'reversed' WHEN p2 - p1 < 10 OR q2 - q1 < 10 THEN 'too small' END AS refused FROM q)
SELECT page_id, box_index, CASE WHEN refused IS NULL THEN p1 END AS x1, CASE WHEN refused IS NULL THEN q1 END AS y1, CASE WHEN refused IS NULL THEN p2 END AS x2, CASE WHEN refused IS NULL THEN q2 END AS y2, refused FROM f""", "box"))
NAMES = "concat('page', o_custkey % 97, CASE o_orderkey % 6 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.gif' WHEN 3 THEN '.Zip' WHEN 4 THEN 'png' ELSE '.cbz' END)"
query("upload_order", lambda k, d: manifest.upload_order(table(k, d, "orders").select((C("o_orderkey") % 200).alias("chapter_id"), F.expr(NAMES).alias("name")).distinct(), s.natural_key(C("name"))), f"""WITH f AS (SELECT DISTINCT o_orderkey % 200 AS chapter_id, {NAMES} AS name FROM orders)
SELECT chapter_id, name, CAST(row_number() OVER (PARTITION BY chapter_id ORDER BY CAST(regexp_extract(name, '[0-9]+') AS INTEGER), lower(name), name) - 1 AS INTEGER) AS place FROM f WHERE regexp_matches(name, '(?i)\\.(png|jpg|jpeg|webp|bmp|zip|cbz)$')""")
query("mask_summary", lambda k, d: profile.mask_summary(views.pixel(k, d).where("y < 4"), table(k, d, "lineitem").select((C("l_orderkey") % 1000).alias("img"))), sql("""+ m AS (SELECT img, y, x FROM px WHERE y < 4 AND v > 127),
f AS (SELECT img, y, x, y * 8 + x AS r FROM m UNION SELECT m.img, m.y, m.x, f.r FROM f JOIN m ON m.img = f.img AND abs(m.y - f.y) <= 1 AND abs(m.x - f.x) <= 1),
g AS (SELECT img, count(DISTINCT r) AS components FROM (SELECT img, y, x, min(r) AS r FROM f GROUP BY ALL) GROUP BY img), b AS (SELECT l_orderkey % 1000 AS img, count(*) AS boxes FROM lineitem GROUP BY 1)
SELECT p.img, count(*) FILTER (WHERE v > 127) AS pixels, round(count(*) FILTER (WHERE v > 127) / 32, 4) AS ratio, coalesce(any_value(components), 0) AS components, coalesce(any_value(boxes), 0) AS boxes FROM px p LEFT JOIN g ON g.img = p.img LEFT JOIN b ON b.img = p.img WHERE y < 4 GROUP BY p.img""", "px", recursive=True))


def _written(k: SparkSession, d: str) -> DataFrame:
    """Chapters' manifests, 64 files of many pages, written, found again by a scan, and read; a second writing replaces the first."""
    p = views.page(k, d).select(F.lower(F.lpad(F.hex(C("chapter_id") % 64), 8, "0")).alias("chapter_id"), "page_id", "price", "skipped")
    page = F.struct(F.concat(F.lit("p"), C("page_id").cast("string")).alias("original"), "skipped", (C("price") % 1000).cast("int").alias("width"))
    listed = p.groupBy("chapter_id").agg(F.to_json(F.struct(F.first("chapter_id").alias("chapter_id"), F.transform(F.sort_array(F.collect_list(F.struct("page_id", page.alias("page")))), lambda r: r["page"]).alias("pages"))).alias("manifest"))
    place = f"{folder(k)}/chapters"
    chapters.write_all(listed.withColumn("manifest", F.lit("{}")), place)
    chapters.write_all(listed, place)
    read = chapters.scan(k, place).select("chapter_id", F.inline(chapters.parsed(C("manifest"))["pages"]))
    return read.groupBy("chapter_id").agg(F.count("*").alias("pages"), F.count_if("skipped").alias("skipped"), F.sum("width").alias("widths"), F.min("original").alias("first"))


query("chapters_written", _written, sql("SELECT lower(lpad(to_hex(chapter_id % 64), 8, '0')) AS chapter_id, count(*) AS pages, count(*) FILTER (WHERE skipped) AS skipped, CAST(sum(price % 1000) AS BIGINT) AS widths, min('p' || page_id) AS first FROM page GROUP BY 1", "page"))
