"""A page's processing put together: detection, exclusions, fills; and what becomes of its results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fill, grouping, spatial
from .held import held


def found_boxes(rows: DataFrame, boxes: DataFrame, excluded: DataFrame, w: int, h: int) -> DataFrame:
    """(page_id, box_index, x1, y1, x2, y2, confidence): what is detected on pages (rows: page_id, y, row) from candidates, without what has its
    centre in an excluded rectangle (page_id, ax, ay, bx, cy); numbered from 0 by confidence."""
    found = grouping.detect(boxes, w, h, rows=rows).withColumn("box_index", F.row_number().over(grouping._order()) - 1)
    found = held(found)
    return found.join(spatial.outside_excluded(found, excluded), ["page_id", "box_index"], "left_semi")


def page_plan(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The fill plan of those boxes.  A page's rows meet in one task, for its fills follow each other; pages without boxes have no plan.
    Pages and boxes are merged: the planner takes a page for a single value and would broadcast it."""
    listed = found.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(*(F.col(c).cast("int").alias(c) for c in ("box_index", "x1", "y1", "x2", "y2")), F.lit(None).cast("array<array<int>>").alias("mask")))).alias("boxes"))
    gray = rows.join(listed.select("page_id"), "page_id", "left_semi").groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("y", "row"))), lambda r: r["row"]).alias("gray"))
    return fill.box_plan(gray.hint("merge").join(listed, "page_id").select(F.col("page_id").alias("img"), "gray", "boxes"))


def committed(pages: DataFrame, results: DataFrame) -> DataFrame:
    """(page_id, chapter_id, page_index, clean, rendered, outcome): pages (with state, the digest of what they are now) after results (page_id, clean, error,
    seen): each good result is committed by itself, whatever becomes of the others.

    outcome: null for pages without a result, else failed, stale (the state has changed since `seen`) or committed; a committed page has
    the new clean image and isn't rendered any more."""
    both = pages.join(results.select("page_id", F.col("clean").alias("made"), "error", "seen", F.lit(True).alias("there")), "page_id", "left")
    outcome = F.when(F.col("error").isNotNull(), "failed").when(~F.col("seen").eqNullSafe(F.col("state")), "stale").otherwise("committed")
    outcome = F.when(F.col("there"), outcome)
    done = F.coalesce(outcome == "committed", F.lit(False))
    return both.select("page_id", "chapter_id", "page_index", F.when(done, F.col("made")).otherwise(F.col("clean")).alias("clean"), (F.coalesce("rendered", F.lit(False)) & ~done).alias("rendered"), outcome.alias("outcome"))


def outcomes(done: DataFrame, results: DataFrame) -> DataFrame:
    """(chapter_id, stage, page_index, message) of each chapter with results: review at the first committed page, or nothing if there is none;
    what failed, with the first error, if something did."""
    told = done.join(results.select("page_id", "error"), "page_id").groupBy("chapter_id").agg(
        F.min(F.when(F.col("outcome") == "committed", F.col("page_index"))).alias("page_index"),
        F.count("*").alias("n"),
        F.sort_array(F.collect_list(F.when(F.col("outcome") == "failed", F.struct("page_index", "error")))).alias("e"),
    )
    first = F.get("e", F.lit(0))["error"]
    which = F.array_join(F.transform("e", lambda x: x["page_index"].cast("string")), ", ")
    message = F.when(F.size("e") == 0, F.lit(None).cast("string")).when(F.size("e") == F.col("n"), F.concat(F.lit("all pages failed, first: "), first)).otherwise(F.concat(F.lit("failed: "), which, F.lit("; first: "), first))
    return told.select("chapter_id", F.when(F.col("page_index").isNotNull(), "review").alias("stage"), "page_index", message.alias("message"))
