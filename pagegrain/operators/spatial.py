"""Joins and filters of boxes.  Every pair shares a page, so joins hash on page_id."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.geometry import centre, contains, corner, gaps, iou, overlap
from .labels import linked

PAIRS = 1 << 20  # pairs of boxes compared at once


def valid_boxes(boxes: DataFrame, w: int, h: int) -> DataFrame:
    """Positive sides, at most .97 of the width and .35 of the page, aspect from 1/25 to 25."""
    bw, bh = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return boxes.where((bw > 0) & (bh > 0) & (bw <= 0.97 * w) & (bw * bh <= 0.35 * w * h) & (bw <= 25 * bh) & (bh <= 25 * bw))


def pairs(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    return left.alias("a").join(right.alias("b"), (F.col("a.page_id") == F.col("b.page_id")) & on, how)


def text_in_bubble(boxes: DataFrame) -> DataFrame:
    """(page_id, text, bubble) for each text inside a bubble; a text may lie in several."""
    texts, bubbles = boxes.where("kind = 'text'"), boxes.where("kind = 'bubble'")
    return pairs(texts, bubbles, contains("a", "b")).select("a.page_id", F.col("a.box_index").alias("text_index"), F.col("b.box_index").alias("bubble_index"))


def _empty(boxes: DataFrame) -> DataFrame:
    """Bubbles that hold no text, with mx and my, by which they are shrunk: 3 % but at least 2 on each side."""
    texts, bubbles = boxes.where("kind = 'text'"), boxes.where("kind = 'bubble'")
    empty = pairs(bubbles, texts.select("page_id", "x1", "y1", "x2", "y2"), contains("b", "a"), "left_anti")
    return empty.withColumns({f"m{c}": F.greatest(F.lit(2), F.floor((F.col(f"{c}2") - F.col(f"{c}1")) * 3 / 100)) for c in "xy"})


def _shrunk() -> list[Column]:
    return [(F.col("x1") + F.col("mx")).alias("x1"), (F.col("y1") + F.col("my")).alias("y1"), (F.col("x2") - F.col("mx")).alias("x2"), (F.col("y2") - F.col("my")).alias("y2")]


def bubbles_without_text(boxes: DataFrame) -> DataFrame:
    """Bubbles that hold no text, shrunk by 3 % but at least 2 on each side."""
    return _empty(boxes).select("page_id", "box_index", *_shrunk())


def standalone_text(boxes: DataFrame) -> DataFrame:
    texts, bubbles = boxes.where("kind = 'text'"), boxes.where("kind = 'bubble'")
    return pairs(texts, bubbles, contains("a", "b"), "left_anti").select("page_id", "box_index")


def outside_excluded(boxes: DataFrame, excluded: DataFrame) -> DataFrame:
    """Boxes whose centre lies in no excluded rectangle."""
    x, y = centre("a")
    inside = x.between(F.least("b.ax", "b.bx"), F.greatest("b.ax", "b.bx")) & y.between(F.least("b.ay", "b.cy"), F.greatest("b.ay", "b.cy"))
    return pairs(boxes, excluded, inside, "left_anti").select("page_id", "box_index")


def free_text_edges(boxes: DataFrame, x_gap: int = 35, y_gap: int = 40, edge: int = 45) -> DataFrame:
    """Pairs of texts near enough to be one: close in x, and in y, at their tops or at their bottoms."""
    texts = boxes.where("kind = 'text'")
    dx, dy = gaps("a", "b")
    near = (dx <= x_gap) & ((F.abs(corner("a", "y1") - corner("b", "y1")) < edge) | (F.abs(corner("a", "y2") - corner("b", "y2")) < edge) | (dy <= y_gap))
    return pairs(texts, texts, (F.col("a.box_index") < F.col("b.box_index")) & near).select("a.page_id", F.col("a.box_index").alias("a_index"), F.col("b.box_index").alias("b_index"))


def close_edges(boxes: DataFrame, reach: int = 35) -> DataFrame:
    dx, dy = gaps("a", "b")
    return pairs(boxes, boxes, (F.col("a.box_index") < F.col("b.box_index")) & (dx <= reach) & (dy <= reach)).select("a.page_id", F.col("a.box_index").alias("a_index"), F.col("b.box_index").alias("b_index"))


def heavy_overlaps(boxes: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Pairs of one kind whose intersection over union is above the threshold."""
    same = (F.col("a.kind") == F.col("b.kind")) & (F.col("a.box_index") < F.col("b.box_index")) & (overlap("a", "b") > 0) & (iou("a", "b") > threshold)
    return pairs(boxes, boxes, same).select("a.page_id", F.col("a.box_index").alias("a_index"), F.col("b.box_index").alias("b_index"), F.round(iou("a", "b"), 6).alias("iou"))


def cluster_hulls(boxes: DataFrame, w: int, h: int, pad_x: int = 20, pad_y: int = 8) -> DataFrame:
    """A padded hull for each page's texts, cut at the page, with the best confidence and whether it should be split."""
    hull = boxes.where("kind = 'text'").groupBy("page_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.max("confidence").alias("confidence"), F.count("*").alias("n"), F.avg(F.col("y2") - F.col("y1")).alias("mean_h"))
    split = (F.col("n") > 3) | (F.col("y2") - F.col("y1") > 4 * F.col("mean_h"))
    return hull.select("page_id", F.greatest(F.col("x1") - pad_x, F.lit(0)).alias("x1"), F.greatest(F.col("y1") - pad_y, F.lit(0)).alias("y1"), F.least(F.col("x2") + pad_x, F.lit(w)).alias("x2"), F.least(F.col("y2") + pad_y, F.lit(h)).alias("y2"), "confidence", split.alias("split"))


def kept_boxes(boxes: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Greedy non-maximum suppression on each page: best confidence first (ties by index), drop what
    overlaps a kept box by more than the threshold.  What is left keeps all its columns.  The order decides, so a
    page's boxes are one row; the pages of a batch are judged at once, each page's best box that is left in each round."""
    names = boxes.columns

    def keep(batches):
        for batch in batches:
            held = batch["boxes"].flatten()
            sizes = np.diff(batch["boxes"].offsets.to_numpy())
            x1, y1, x2, y2 = (held.field(c).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2"))
            x1, y1, x2, y2 = (v.astype(np.int64) if v.dtype.kind in "iu" else v for v in (x1, y1, x2, y2))
            page, area = np.repeat(np.arange(len(sizes)), sizes), (x2 - x1) * (y2 - y1)
            left, kept = np.arange(len(held)), [np.zeros(0, np.int64)]
            while len(left):
                first = np.append(True, np.diff(page[left]) != 0)
                kept.append(left[first])
                best = left[first][np.cumsum(first) - 1]
                both = np.maximum(0, np.minimum(x2[left], x2[best]) - np.maximum(x1[left], x1[best])) * np.maximum(0, np.minimum(y2[left], y2[best]) - np.maximum(y1[left], y1[best]))
                left = left[~first & ~(both > threshold * (area[left] + area[best] - both))]
            some = pa.array(np.sort(np.concatenate(kept)))
            yield pa.record_batch([held.field(c).take(some) for c in names], names)

    row = F.struct((-F.col("confidence")).alias("_order"), F.col("box_index").alias("_index"), *names)
    listed = boxes.groupBy("page_id").agg(F.sort_array(F.collect_list(row)).alias("boxes"))
    return listed.select("boxes").mapInArrow(keep, StructType([StructField(f.name, f.dataType) for f in boxes.schema]))


def suppress(boxes: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(page_id, box_index) of kept_boxes."""
    kept = kept_boxes(boxes.select("page_id", "box_index", "x1", "y1", "x2", "y2", "confidence"), threshold)
    return kept.select(F.col("page_id").cast("long").alias("page_id"), F.col("box_index").cast("int").alias("box_index"))


def components(boxes: DataFrame, edges: DataFrame) -> DataFrame:
    """(page_id, box_index, cluster): each box with the smallest index that edges on its page reach.
    A page's boxes and edges are one row each; many pages pass through Python at once."""

    def close(batches):
        for pdf in batches:
            out = []
            for page, nodes, links in zip(pdf["page_id"], pdf["nodes"], pdf["links"], strict=True):
                root = {int(i): int(i) for i in nodes}

                def find(i, root=root):
                    while root[i] != i:
                        root[i] = i = root[root[i]]
                    return i

                for x in links if links is not None else ():
                    if (p := find(x["a_index"])) != (q := find(x["b_index"])):
                        root[max(p, q)] = min(p, q)
                out += [(page, i, find(i)) for i in root]
            yield pd.DataFrame(out, columns=["page_id", "box_index", "cluster"])

    nodes = boxes.groupBy("page_id").agg(F.collect_list("box_index").alias("nodes"))
    links = edges.groupBy("page_id").agg(F.collect_list(F.struct("a_index", "b_index")).alias("links"))
    return nodes.join(links, "page_id", "left").mapInPandas(close, "page_id long, box_index int, cluster int")


def clustered_texts(boxes: DataFrame, x_gap: int = 35, y_gap: int = 40, edge: int = 45) -> DataFrame:
    """A page's texts with cluster: components of free_text_edges over a page's texts by one shuffle: a page's
    boxes are one row of arrays, and pairs are compared by them.  Their other columns pass as they are."""
    names = boxes.columns

    def close(batches):
        for batch in batches:
            held = batch["boxes"].flatten()
            if not len(held):
                continue
            index, x1, y1, x2, y2 = (held.field(f"_{c}").to_numpy() for c in ("box_index", "x1", "y1", "x2", "y2"))
            sizes = np.diff(batch["boxes"].offsets.to_numpy())
            first = np.repeat(np.cumsum(sizes) - sizes, sizes)  # of each box's page
            of_page = np.repeat(sizes, sizes)
            ends, links, row = np.cumsum(of_page), [], 0
            while row < len(index):  # so many pairs at once
                end = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + PAIRS, "right")))
                some = of_page[row:end]
                a = np.repeat(np.arange(row, end), some)
                b = np.arange(len(a)) - np.repeat(np.cumsum(some) - some, some) + first[a]
                dx, dy = np.maximum(x1[a] - x2[b], x1[b] - x2[a]), np.maximum(y1[a] - y2[b], y1[b] - y2[a])
                near = (dx <= x_gap) & ((np.abs(y1[a] - y1[b]) < edge) | (np.abs(y2[a] - y2[b]) < edge) | (dy <= y_gap))
                links.append((a[near], b[near]))
                row = end
            label = linked(len(index), *(np.concatenate(x) for x in zip(*links, strict=True)))
            yield pa.record_batch([*(held.field(c) for c in names), pa.array(index[label].astype(np.int32))], [*names, "cluster"])

    corners = (F.col(c).cast("long").alias(f"_{c}") for c in ("box_index", "x1", "y1", "x2", "y2"))
    texts = boxes.where("kind = 'text'").groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(*corners, *names))).alias("boxes"))
    return texts.select("boxes").mapInArrow(close, StructType([*(StructField(f.name, f.dataType) for f in boxes.schema), StructField("cluster", IntegerType())]))


def near_texts(boxes: DataFrame, x_gap: int = 35, y_gap: int = 40, edge: int = 45) -> DataFrame:
    """(page_id, box_index, cluster) of clustered_texts."""
    out = clustered_texts(boxes.select("page_id", "box_index", "x1", "y1", "x2", "y2", "kind"), x_gap, y_gap, edge)
    return out.select(F.col("page_id").cast("long").alias("page_id"), F.col("box_index").cast("int").alias("box_index"), "cluster")


def best_box(boxes: DataFrame) -> DataFrame:
    """The most confident box of each page and kind; ties to the smaller index."""
    return boxes.groupBy("page_id", "kind").agg(F.min_by("box_index", F.struct(-F.col("confidence"), "box_index")).alias("box_index"), F.max("confidence").alias("confidence"))


def reading_order(boxes: DataFrame) -> DataFrame:
    """Each page's box indices by (y1, x1, index)."""
    listed = F.sort_array(F.collect_list(F.struct("y1", "x1", "box_index")))
    return boxes.groupBy("page_id").agg(F.array_join(F.transform(listed, lambda r: r["box_index"].cast("string")), ",").alias("reading"))



def mapped_back(boxes: DataFrame, w: int, h: int) -> DataFrame:
    """Boxes of several passes over one image (page_id, pass, box_index, corners, confidence) on the image itself: `plain` ones as they are, those
    of a `flipped` pass mirrored, those of a `small` one (.85 of both sides, rounded) enlarged, cut at the image.  Boxes without an area go, as do
    those of a small pass over an image of 10 pixels or less."""
    small = {"x": round(w * 0.85), "y": round(h * 0.85)}
    size = {"x": w, "y": h}
    flipped, shrunk = F.col("pass") == "flipped", F.col("pass") == "small"
    cut = lambda v, c: F.greatest(F.lit(0), F.least(F.lit(size[c]), v)).cast("long")
    out = {}
    for c in "xy":
        for i, other in ((1, 2), (2, 1)):
            own = F.col(f"{c}{i}")
            mirrored = cut(F.lit(w) - F.col(f"x{other}") if c == "x" else own, c)
            out[f"{c}{i}"] = F.when(flipped, mirrored).when(shrunk, cut(F.bround(own / F.lit(small[c] / size[c])), c)).otherwise(own.cast("long"))
    fits = ~shrunk | F.lit(min(small.values()) > 10)
    return boxes.where(fits).select("page_id", "pass", "box_index", *(v.alias(c) for c, v in out.items()), "confidence").where("x2 > x1 and y2 > y1")


def passes_merged(boxes: DataFrame, w: int, h: int, threshold: float = 0.3) -> DataFrame:
    """The boxes of all passes on the image, after suppression; ties by pass (plain, flipped, small) and index."""
    back = mapped_back(boxes, w, h)
    place = F.when(F.col("pass") == "plain", 0).when(F.col("pass") == "flipped", 1).otherwise(2)
    order = F.row_number().over(Window.partitionBy("page_id").orderBy(place, "box_index"))
    numbered = back.withColumn("number", order)
    kept = kept_boxes(numbered.select("page_id", F.col("number").alias("box_index"), "pass", F.col("box_index").alias("own_index"), "x1", "y1", "x2", "y2", "confidence"), threshold)
    return kept.select("page_id", "pass", F.col("own_index").alias("box_index"), "x1", "y1", "x2", "y2", "confidence")


def empty_bubbles(boxes: DataFrame, mask: Column | str = "mask") -> DataFrame:
    """bubbles_without_text of boxes with masks (arrays of rows): only those whose mask has their size and anything
    in it, with confidence and the mask cut like the box.  What is left must have the mask's size, too.  The mask is a column, or is made
    of a box's columns; then it is made for bubbles without text only, so that no mask is shuffled."""
    mask = F.col(mask) if isinstance(mask, str) else mask
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    fits = (w > 2 * F.col("mx")) & (h > 2 * F.col("my"))
    rows = _empty(boxes).where(F.coalesce(fits, F.lit(False)))

    def cut(m: Column) -> Column:
        """The part of a whole mask, else null."""
        whole = (F.size(m) == h) & F.forall(m, lambda r: F.size(r) == w) & F.exists(m, lambda r: F.array_max(r) > 0)
        return F.when(whole, F.transform(F.slice(m, (F.col("my") + 1).cast("int"), (h - 2 * F.col("my")).cast("int")), lambda r: F.slice(r, (F.col("mx") + 1).cast("int"), (w - 2 * F.col("mx")).cast("int"))))

    # a mask is made once: as the only member of an array it is a variable, not an expression that is copied
    part = F.get(F.transform(F.array(mask), cut), F.lit(0))
    cut_out = rows.withColumn("part", F.explode(F.array_compact(F.array(part))))
    return cut_out.select("page_id", "box_index", *_shrunk(), "confidence", F.col("part").alias("mask"))


def free_text_hulls(boxes: DataFrame, w: int, h: int, pad_x: int = 20, pad_y: int = 8, single: int = 6) -> DataFrame:
    """A hull for each cluster of near texts, padded and cut at the page, with the best confidence and whether it is to be split by lines: over
    three boxes, or higher than four of their mean heights.  A single box is padded less above and below."""
    texts = boxes.where("kind = 'text'")
    held = texts.join(near_texts(texts), ["page_id", "box_index"])
    hull = held.groupBy("page_id", "cluster").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.max("confidence").alias("confidence"), F.count("*").alias("n"), F.sum(F.col("y2") - F.col("y1")).alias("heights"))
    pad = F.when(F.col("n") == 1, single).otherwise(pad_y)
    split = (F.col("n") > 3) | (F.col("n") > 1) & ((F.col("y2") - F.col("y1")) * F.col("n") > 4 * F.col("heights"))
    return hull.select("page_id", "cluster", F.greatest(F.lit(0), F.col("x1") - pad_x).alias("x1"), F.greatest(F.lit(0), F.col("y1") - pad).alias("y1"), F.least(F.lit(w), F.col("x2") + pad_x).alias("x2"), F.least(F.lit(h), F.col("y2") + pad).alias("y2"), "confidence", split.alias("split"))
