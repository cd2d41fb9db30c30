"""Queries over order-dependent groupings, detection, windows of pages and uploads."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import grouping, profile, spatial
from ..sources import archive
from ..sources.links import with_fallback
from . import views
from .catalog import query
from .views import PAGE_H, PAGE_W, sql, table


def _texts(k: SparkSession, d: str) -> DataFrame:
    return views.box(k, d).where("kind = 'text'")


query("capacity_clusters", lambda k, d: grouping.capacity_clusters(views.box(k, d), most=250))
query("line_groups", lambda k, d: grouping.line_groups(_texts(k, d)))
query("bubble_texts", lambda k, d: grouping.bubble_texts(views.box(k, d)))
query("free_texts", lambda k, d: grouping.free_texts(views.box(k, d), PAGE_W, PAGE_H))


def _detected(k: SparkSession, d: str) -> DataFrame:
    box = views.box(k, d)
    return grouping.detect(box, PAGE_W, PAGE_H, spatial.bubbles_without_text(box).join(box.select("page_id", "box_index", "confidence"), ["page_id", "box_index"]))


query("detect", _detected)
query("textobj_boxes", lambda k, d: grouping.region_boxes(views.region(k, d), views.box(k, d)), sql("""SELECT a.page_id, region_id, string_agg(CAST(box_index AS VARCHAR), ',' ORDER BY b.y1, b.x1, box_index) AS boxes FROM region a JOIN box b ON a.page_id = b.page_id AND NOT removed
  AND ((b.x1 + b.x2) / 2.0 BETWEEN a.x1 AND a.x2 AND (b.y1 + b.y2) / 2.0 BETWEEN a.y1 AND a.y2 OR least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1)) GROUP BY 1, 2""", "page", "box", "region"))


def _candidates(k: SparkSession, d: str) -> DataFrame:
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return views.box(k, d).select("page_id", "box_index", ((F.col("x1") + F.col("x2") - 60) * 1.0).alias("cx"), ((F.col("y1") + F.col("y2")) * 1.0).alias("cy"), (w * 2.0).alias("bw"), (h * 2.0).alias("bh"), F.array("confidence", (F.col("box_index") % 5) / 10).alias("scores"), F.lit(2.0).alias("scale"), F.lit(10).alias("pad_x"), F.lit(-8).alias("pad_y"))


query("decode_candidates", lambda k, d: grouping.decode(_candidates(k, d), PAGE_W, PAGE_H), sql("""+ c AS (SELECT page_id, box_index, CAST(CASE WHEN confidence >= box_index % 5 / 10 THEN 0 ELSE 1 END AS INTEGER) AS class, greatest(confidence, box_index % 5 / 10) AS confidence,
  greatest(0.0::DOUBLE, (x1 + x2 - 60 - (x2 - x1) - 10) / 2) AS x1, least(400.0::DOUBLE, (x1 + x2 - 60 + (x2 - x1) - 10) / 2) AS x2, greatest(0.0::DOUBLE, (y1 + y2 - (y2 - y1) + 8) / 2) AS y1, least(600.0::DOUBLE, (y1 + y2 + (y2 - y1) + 8) / 2) AS y2 FROM box)
SELECT * FROM c WHERE confidence >= 0.2 AND x2 - x1 >= 4 AND y2 - y1 >= 4""", "box"))

query("detect_tiles", lambda k, d: profile.detection_windows(table(k, d, "orders").select((F.col("o_orderkey") * 7 % 6000 + 1).alias("height")).distinct()), """WITH RECURSIVE h AS (SELECT DISTINCT o_orderkey * 7 % 6000 + 1 AS height FROM orders),
t AS (SELECT height, CAST(0 AS BIGINT) AS top FROM h UNION ALL SELECT height, top + 824 FROM t WHERE height > 1536 AND top + 1024 < height) SELECT height, top, CASE WHEN height <= 1536 THEN height ELSE least(top + 1024, height) END AS bottom FROM t""")
query("tile_blend", lambda k, d: profile.blend(views.pixel(k, d).withColumn("img", F.expr("img div 2")).withColumn("weight", F.lit(1.0) + F.col("x") % 2)), sql("SELECT img // 2 AS img, y, x, round(sum(v * (1.0::DOUBLE + x % 2)) / sum(1.0::DOUBLE + x % 2), 4) AS v FROM px GROUP BY 1, 2, 3", "px"))


def tall_rows(k: SparkSession, d: str) -> DataFrame:
    """Line items of a thousand orders each as rows of a tall image; some rows hold content."""
    order = Window.partitionBy("img").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    item = table(k, d, "lineitem").withColumn("img", F.expr("l_orderkey div 1000"))
    return item.select("img", (F.row_number().over(order) - 1).alias("y"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 61 == 0).alias("unsafe"), F.col("l_quantity").alias("score"))


query("cut_rows", lambda k, d: profile.cut_rows(tall_rows(k, d)))
query("mask_components", lambda k, d: profile.mask_components(views.pixel(k, d)))
query("source_fallback", lambda k, d: with_fallback((p := table(k, d, "part").select("p_partkey", "p_size")).where("p_size < 0"), p.where("p_size > 40")), "SELECT p_partkey, p_size FROM part WHERE p_size > 40")


def uploads(k: SparkSession, d: str) -> DataFrame:
    """Pages' html packed as images into archives of pages whose ids differ in the last digit alone, one for each chapter."""

    def pack(batches):
        for pdf in batches:
            rows = []
            for chapter, held in zip(pdf["chapter_id"], pdf["held"], strict=True):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    for r in held:
                        z.writestr(f"p/{r['page_id']}.{'png' if r['page_id'] % 4 else 'txt'}", r["html"] or "")
                rows.append((chapter, 0, "pages.cbz", out.getvalue()))
            yield pd.DataFrame(rows, columns=["chapter_id", "upload", "name", "content"])

    held = table(k, d, "pages").groupBy(F.expr("cast(page_id div 10 as string)").alias("chapter_id")).agg(F.sort_array(F.collect_list(F.struct("page_id", "html"))).alias("held"))
    return held.mapInPandas(pack, "chapter_id string, upload int, name string, content binary")


query("archive_pages", lambda k, d: archive.pages(uploads(k, d)).select("chapter_id", "page", "name", F.length("content").alias("size")), """SELECT CAST(page_id // 10 AS VARCHAR) AS chapter_id, CAST(row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) - 1 AS INTEGER) AS page, page_id || '.png' AS name, CAST(octet_length(encode(html)) AS INTEGER) AS size FROM pages WHERE page_id % 4 > 0 AND html IS NOT NULL AND html <> ''""")
