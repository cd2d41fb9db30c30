"""Row profiles and image measures of gray pixels (img, y, x, v)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .content import cut_places, joined


def row_profile(px: DataFrame) -> DataFrame:
    """Deviation of each row plus twice the number of pixels far from white and from black."""
    far = (F.abs(255 - F.col("v")) > 18) & (F.abs("v") > 18)
    return px.groupBy("img", "y").agg(F.round(F.stddev_pop("v") + 2 * F.count_if(far), 4).alias("score"))


def text_rows(px: DataFrame) -> DataFrame:
    """Rows whose mean is under the image's 90th percentile of row means, less 2."""
    rows = px.groupBy("img", "y").agg(F.avg("v").alias("mean"))
    limit = F.percentile("mean", 0.9).over(Window.partitionBy("img")) - 2
    return rows.withColumn("is_text", F.col("mean") < limit).select("img", "y", "is_text")


def runs(px: DataFrame, least: int = 4) -> DataFrame:
    """Gaps and islands: first and last row of each run of at least so many text rows, with
    a padding of half the gap to its neighbours, from 1 to 3."""
    w = Window.partitionBy("img").orderBy("y")
    flagged = text_rows(px).withColumn("new", (F.col("is_text") != F.coalesce(F.lag("is_text").over(w), ~F.col("is_text"))).cast("int"))
    island = flagged.withColumn("island", F.sum("new").over(w)).where("is_text").groupBy("img", "island").agg(F.min("y").alias("first"), F.max("y").alias("last"))
    kept = island.where(F.col("last") - F.col("first") + 1 >= least)
    o = Window.partitionBy("img").orderBy("first")
    top = F.floor((F.col("first") - F.coalesce(F.lag("last").over(o) + 1, F.lit(0))) / 2)
    return kept.select("img", "first", "last", F.least(F.lit(3), F.greatest(F.lit(1), top)).cast("int").alias("pad_top"))


def safe_rows(px: DataFrame, reach: int = 12, limit: float = 18.0) -> DataFrame:
    """Rows around which all rows within reach exist and have a small score."""
    w = Window.partitionBy("img").orderBy("y").rowsBetween(-reach, reach)
    scored = row_profile(px)
    return scored.withColumn("ok", (F.count("*").over(w) == 2 * reach + 1) & (F.max("score").over(w) <= limit + 16)).where("ok").select("img", "y", "score")


def nearest_cut(px: DataFrame, target: int = 1400, reach: int = 12) -> DataFrame:
    """The safe row nearest to a target; ties by the smaller score, then the first."""
    near = F.struct(F.abs(F.col("y") - target), "score", "y")
    return safe_rows(px, reach).groupBy("img").agg(F.min_by("y", near).alias("cut"))


def fill_class(px: DataFrame, masked: Column | None = None, light: int = 215, dark: int = 35, share: float = 0.7, flat: float = 12.0) -> DataFrame:
    """How to fill an image's mask, judged by its other pixels: white or black if 70 % of them are,
    low_std if they hardly differ, else model; with the median of the pixels that decided, cut to an integer."""
    rest = px if masked is None else px.where(~masked)
    v = F.col("v")
    part = lambda c: F.avg(c.cast("int"))
    median = lambda c: F.floor(F.percentile(F.when(c, v), 0.5)).cast("int")
    got = rest.groupBy("img").agg(part(v > light).alias("light"), part(v < dark).alias("dark"), F.stddev_pop("v").alias("std"), median(v > light).alias("m_light"), median(v < dark).alias("m_dark"), median(F.lit(True)).alias("m_all"))
    white, black, even = F.col("light") >= share, F.col("dark") >= share, F.col("std") < flat
    kind = F.when(white, "white").when(black, "black").when(even, "low_std").otherwise("model")
    return got.select("img", kind.alias("fill"), F.when(white, F.col("m_light")).when(black, F.col("m_dark")).when(even, F.col("m_all")).alias("value"))


def image_quality(a: DataFrame, b: DataFrame) -> DataFrame:
    """MAE, PSNR (100 for equal images) and single-window SSIM of images with equal ids."""
    both = a.alias("a").join(b.select("img", "y", "x", F.col("v").alias("w")), ["img", "y", "x"])
    d = F.col("v") - F.col("w")
    got = both.groupBy("img").agg(F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), F.avg("v").alias("ma"), F.avg("w").alias("mb"), F.var_pop("v").alias("va"), F.var_pop("w").alias("vb"), F.covar_pop("v", "w").alias("c"))
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    ssim = (2 * F.col("ma") * F.col("mb") + c1) * (2 * F.col("c") + c2) / ((F.col("ma") ** 2 + F.col("mb") ** 2 + c1) * (F.col("va") + F.col("vb") + c2))
    psnr = F.when(F.col("mse") == 0, 100.0).otherwise(F.round(10 * F.log10(255.0 * 255.0 / F.col("mse")), 2))
    return got.select("img", F.round("mae", 4).alias("mae"), psnr.alias("psnr"), F.round(ssim, 4).alias("ssim"))


def auto_colour(px: DataFrame) -> DataFrame:
    """Text colour for a background: white on dark, black on light."""
    return px.groupBy("img").agg(F.when(F.avg("v") < 135, "#FFFFFF").otherwise("#000000").alias("colour"))


def union_max(a: DataFrame, b: DataFrame) -> DataFrame:
    """Masks joined by their larger pixel."""
    return a.unionByName(b).groupBy("img", "y", "x").agg(F.max("v").alias("v"))


def coverage(px: DataFrame, above: int = 127) -> DataFrame:
    return px.groupBy("img").agg(F.count_if(F.col("v") > above).alias("pixels"), F.round(F.count_if(F.col("v") > above) / F.count("*"), 4).alias("ratio"))


def tiles(heights: DataFrame, size: int = 512, step: int = 448) -> DataFrame:
    """Starts of overlapping tiles over a length; the last ends where the length does."""
    length = F.col("length")
    usual = F.filter(F.sequence(F.lit(0), length, F.lit(step)), lambda s: s + size < length)
    starts = F.when(length <= size, F.array(F.lit(0).cast(heights.schema["length"].dataType))).otherwise(F.array_union(usual, F.array(length - size)))
    return heights.select("length", F.explode(starts).alias("start"))


def detection_windows(pages: DataFrame, size: int = 1024, step: int = 824, tall: int = 1536) -> DataFrame:
    """Overlapping windows of tall pages, the last one cut at the page's end; lower pages are one window.
    A window starts at each step until one has reached the end."""
    h = F.col("height")
    starts = F.when(h <= tall, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), h.cast("long") - size + step - 1), F.lit(step).cast("long")))
    spread = pages.select("height", F.explode(starts).alias("top"))
    return spread.where((F.col("top") == 0) | (F.col("top") - step + size < h)).select("height", "top", F.when(h <= tall, h).otherwise(F.least(F.col("top") + size, h)).cast("long").alias("bottom"))


def blend(tiles_: DataFrame) -> DataFrame:
    """Overlapping tiles' pixels (img, y, x, v, weight) as their weighted mean."""
    return tiles_.groupBy("img", "y", "x").agg(F.round(F.sum(F.col("v") * F.col("weight")) / F.sum("weight"), 4).alias("v"))


def cut_rows(rows: DataFrame, target: int = 1400, search: int = 180, least: int = 500, wider: int = 800, band: int = 12) -> DataFrame:
    """(img, place, cut): where a tall image (rows img, y, unsafe, score) is cut, one cut after the other.

    The next cut is the row nearest to target rows further whose neighbours within band are all
    safe (ties: smaller score, then first), within search of that row, else within search +
    wider, and at least `least` rows from the cut before and from the end.  Without one, or
    once the rest is at most target + least rows, the cuts end.  Rows' bands come from a
    window; only the candidates of an image, one array, pass through Python, which looks at them where Arrow holds them."""
    w = Window.partitionBy("img").orderBy("y").rowsBetween(-band, band)
    marked = rows.withColumn("ok", (F.count("*").over(w) == 2 * band + 1) & ~F.max("unsafe").over(w))
    listed = marked.groupBy("img").agg((F.max("y") + 1).cast("long").alias("height"), F.sort_array(F.collect_list(F.when(F.col("ok"), F.struct(F.col("y").cast("long").alias("y"), F.col("score").cast("double").alias("score"))))).alias("safe"))

    def cut(batches):
        for batch in batches:
            imgs, heights, out = batch["img"].to_pylist(), batch["height"].to_pylist(), []
            for i, img in enumerate(imgs):
                held = batch["safe"][i].values
                safe, score = (held.field(c).to_numpy(zero_copy_only=False) for c in ("y", "score"))
                out += [(img, place, at) for place, at in enumerate(cut_places(safe, score, heights[i], target, search, least, wider, band))]
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int32(), pa.int64()), strict=True)], ["img", "place", "cut"])

    return listed.mapInArrow(cut, "img long, place int, cut long")


def grown(px: DataFrame, reach: int) -> DataFrame:
    """The largest value within reach in both directions, by two passes of windows within an image."""
    row, column = (Window.partitionBy("img", a).orderBy(b).rangeBetween(-reach, reach) for a, b in (("y", "x"), ("x", "y")))
    wide = px.withColumn("v", F.max("v").over(row))
    return wide.select("img", "y", "x", F.max("v").over(column).alias("v"))


def painted(px: DataFrame, above: int) -> DataFrame:
    """Whether an image has any pixel above a value."""
    return px.groupBy("img").agg(F.bool_or(F.col("v") > above).alias("painted"))


def memory_span(samples: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """First, largest and last sample of each key."""
    at = F.struct(*order)
    return samples.groupBy(key).agg(F.min_by(value, at).alias("start"), F.max(value).alias("peak"), F.max_by(value, at).alias("finish"))


def mask_components(px: DataFrame, above: int = 127) -> DataFrame:
    """(img, component, pixels, x1, y1, x2, y2) of each 8-connected group of mask pixels, numbered by
    its first pixel in row order; x2 and y2 are exclusive.  One image is one unit: its mask's pixels are one array."""

    def group(batches):
        for batch in batches:
            for i in range(len(batch)):
                held = batch["mask"][i].values
                ys, xs = (held.field(c).to_numpy().astype(np.int64) for c in ("y", "x"))
                new = np.r_[True, (ys[1:] != ys[:-1]) | (xs[1:] != xs[:-1] + 1)]
                rows, begins, ends = ys[new], xs[new], xs[np.r_[new[1:], True]] + 1
                label = joined(rows, begins, ends)
                first, at = np.unique(label, return_inverse=True)  # numbered by their first runs
                n = len(first)
                box = [np.full(n, start) for start in (np.iinfo(np.int32).max, np.iinfo(np.int32).max, -1, -1)]
                for f, to, value in zip((np.minimum, np.minimum, np.maximum, np.maximum), box, (begins, rows, ends, rows + 1), strict=True):
                    f.at(to, at, value)
                pixels = np.bincount(at, ends - begins, n).astype(np.int64)
                yield pa.record_batch([pa.array(np.full(n, batch["img"][i].as_py())), pa.array(np.arange(n, dtype=np.int32)), pa.array(pixels), *(pa.array(c.astype(np.int32)) for c in box)], ["img", "component", "pixels", "x1", "y1", "x2", "y2"])

    mask = px.where(F.col("v") > above).groupBy("img").agg(F.sort_array(F.collect_list(F.struct("y", "x"))).alias("mask"))
    return mask.mapInArrow(group, "img long, component int, pixels long, x1 int, y1 int, x2 int, y2 int")


def line_runs(rows: DataFrame, least: int = 4, most: int = 3) -> DataFrame:
    """(img, first, last, pad_top, pad_bottom) of each run of at least so many rows of text of images kept by rows (img, y, row): half the gap
    to the kept run above and below, from 1 to 3; the gaps of the outer runs reach to the image's ends."""
    mean = F.aggregate("row", F.lit(0.0), lambda a, v: a + v) / F.size("row")
    page = Window.partitionBy("img")
    means = rows.where(F.size("row") > 0).select("img", "y", mean.alias("mean"))
    flagged = means.withColumns({"text": F.col("mean") < F.percentile("mean", 0.9).over(page) - 2, "height": F.max("y").over(page) + 1}).where("text")
    island = flagged.withColumn("g", F.col("y") - F.row_number().over(page.orderBy("y"))).groupBy("img", "height", "g").agg(F.min("y").alias("first"), F.max("y").alias("last")).where(F.col("last") - F.col("first") + 1 >= least)
    o = page.orderBy("first")
    pad = lambda gap: F.least(F.lit(most), F.greatest(F.lit(1), F.floor(gap / 2))).cast("int")
    above = F.col("first") - F.coalesce(F.lag("last").over(o) + 1, F.lit(0))
    below = F.coalesce(F.lead("first").over(o), F.col("height")) - F.col("last") - 1
    return island.select("img", "first", "last", pad(above).alias("pad_top"), pad(below).alias("pad_bottom"))


def safe_cut(rows: DataFrame, target: int = 1400, search: int = 180, least: int = 500, band: int = 12) -> DataFrame:
    """(img, cut): the first cut of a tall image (rows img, y, unsafe, score): of the rows within search of target, at least `least` from both
    ends and band from the search's ends, whose neighbours within band all exist and are safe, the nearest one to target; ties by
    the smaller score, then the first.  Null if there is none."""
    w = Window.partitionBy("img").orderBy("y").rowsBetween(-band, band)
    seen = rows.select("img", "y", "score", ((F.count("*").over(w) == 2 * band + 1) & ~F.max("unsafe").over(w)).alias("ok"), (F.max("y").over(Window.partitionBy("img")) + 1).alias("height"))
    low, high = F.greatest(F.lit(least), F.lit(target - search)) + band, F.least(F.col("height") - least, F.lit(target + search)) - band
    inside = F.col("ok") & (F.col("y") >= low) & (F.col("y") < high)
    return seen.groupBy("img").agg(F.min_by("y", F.when(inside, F.struct(F.abs(F.col("y") - target), "score", "y"))).alias("cut"), F.count_if(inside).alias("n")).select("img", F.when(F.col("n") > 0, F.col("cut")).alias("cut"))


def mask_summary(px: DataFrame, boxes: DataFrame, above: int = 127) -> DataFrame:
    """(img, pixels, ratio, components, boxes): what the metadata of a mask holds: its pixels, their share, its groups of pixels that touch by sides or
    corners, and how many boxes (img) it was made of."""
    groups = mask_components(px, above).groupBy("img").agg(F.count("*").alias("components"))
    made = boxes.groupBy("img").agg(F.count("*").alias("boxes"))
    none = F.lit(0).cast("long")
    return coverage(px, above).join(groups, "img", "left").join(made, "img", "left").select("img", "pixels", "ratio", F.coalesce("components", none).alias("components"), F.coalesce("boxes", none).alias("boxes"))
