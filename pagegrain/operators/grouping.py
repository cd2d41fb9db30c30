"""Order-dependent groupings of a page's boxes, and detection put together from them.

Each page's boxes are one row; many pages pass through Python at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.geometry import contains
from .canvas import split_rows
from .held import held
from .spatial import clustered_texts, kept_boxes, pairs, valid_boxes

BOX = ("box_index", "x1", "y1", "x2", "y2")


def labelled(boxes: DataFrame, label: Callable[[list], Iterable[tuple[int, int]]], name: str, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """boxes with name: what label says of each page's boxes, which it gets by ascending index.  Their other columns pass as they are."""
    names = boxes.columns

    def run(batches):
        for batch in batches:
            held, ends = batch["boxes"].flatten(), np.cumsum(np.diff(batch["boxes"].offsets.to_numpy()))
            listed = [dict(zip(BOX, b, strict=True)) for b in zip(*(held.field(f"_{c}").to_pylist() for c in BOX), strict=True)]
            at, got, first = [], [], 0
            for end in ends.tolist():
                place = {b["box_index"]: n for n, b in enumerate(listed[first:end], first)}
                for index, value in label(listed[first:end]):
                    at.append(place[index])
                    got.append(value)
                first = end
            some = pa.array(at, pa.int64())
            yield pa.record_batch([*(held.field(c).take(some) for c in names), pa.array(got, pa.int32())], [*names, name])

    row = F.struct(*(F.col(c).cast("long").alias(f"_{c}") for c in BOX), *names)
    listed = boxes.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("boxes"))
    return listed.select("boxes").mapInArrow(run, StructType([*(StructField(f.name, f.dataType) for f in boxes.schema), StructField(name, IntegerType())]))


def by_page(boxes: DataFrame, label: Callable[[list], Iterable[tuple[int, int]]], name: str, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(keys, box_index, name) of labelled."""
    out = labelled(boxes.select(*keys, *BOX), label, name, keys)
    return out.select(*(F.col(k).cast("long").alias(k) for k in keys), F.col("box_index").cast("int").alias("box_index"), name)


def _capacity(reach: int, most: int):
    """Clusters grow, by ascending index and in as many passes as it takes, by boxes within reach
    of a member, while the hull's sides stay within most; a cluster's label is its first index."""

    def label(boxes):
        left = boxes
        while left:
            seed, left = left[0], left[1:]
            members, hull = [seed], [seed["x1"], seed["y1"], seed["x2"], seed["y2"]]
            grown = True
            while grown:
                grown, rest = False, []
                for b in left:
                    wider = [min(hull[0], b["x1"]), min(hull[1], b["y1"]), max(hull[2], b["x2"]), max(hull[3], b["y2"])]
                    fits = wider[2] - wider[0] <= most and wider[3] - wider[1] <= most
                    if fits and any(b["x1"] - m["x2"] <= reach and m["x1"] - b["x2"] <= reach and b["y1"] - m["y2"] <= reach and m["y1"] - b["y2"] <= reach for m in members):
                        members.append(b)
                        hull, grown = wider, True
                    else:
                        rest.append(b)
                left = rest
            for m in members:
                yield m["box_index"], seed["box_index"]

    return label


def capacity_clusters(boxes: DataFrame, reach: int = 35, most: int = 600) -> DataFrame:
    """(page_id, box_index, cluster): nearby boxes together, in hulls of bounded sides."""
    return by_page(boxes, _capacity(reach, most), "cluster")


def text_lines(boxes: list, share: float = 0.5) -> list[list]:
    """Boxes by (y1, x1), each in the first line that it shares over half of the lower height with."""
    lines = []  # [top, bottom, boxes]
    for b in sorted(boxes, key=lambda b: (b["y1"], b["x1"])):
        for line in lines:
            low = min(b["y2"] - b["y1"], line[1] - line[0])
            if low > 0 and min(b["y2"], line[1]) - max(b["y1"], line[0]) > share * low:
                line[:2] = min(line[0], b["y1"]), max(line[1], b["y2"])
                line[2].append(b)
                break
        else:
            lines.append([b["y1"], b["y2"], [b]])
    return sorted(lines, key=lambda line: line[0])


def _line_groups(many: int = 3, tall: float = 4.0, limit: float = 3.0):
    """Groups of lines, in reading order, of at most 3 mean heights; boxes that are few and low
    enough stay one group."""

    def label(boxes):
        mean = sum(b["y2"] - b["y1"] for b in boxes) / len(boxes)
        if len(boxes) <= many and max(b["y2"] for b in boxes) - min(b["y1"] for b in boxes) <= tall * mean:
            yield from ((b["box_index"], 0) for b in boxes)
            return
        group, top, bottom = -1, 0, 0
        for low, high, members in text_lines(boxes):
            if group < 0 or max(bottom, high) - min(top, low) > limit * mean:
                group, top, bottom = group + 1, low, high
            else:
                top, bottom = min(top, low), max(bottom, high)
            for b in members:
                yield b["box_index"], group

    return label


def line_groups(boxes: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(keys, box_index, line_group): see _line_groups."""
    return by_page(boxes, _line_groups(), "line_group", keys)


def _hulls(grouped: DataFrame, keys: list[str], *more) -> DataFrame:
    return grouped.groupBy(*keys).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.max("confidence").alias("confidence"), F.count("*").alias("n"), F.min("box_index").alias("first_index"), *more)


def bubble_texts(boxes: DataFrame) -> DataFrame:
    """A hull for each line group of the texts inside a bubble: padded by 24 and 10, within the bubble and 8 around it."""
    keys, sides = ("page_id", "bubble_index"), BOX[1:]
    texts, bubbles = boxes.where("kind = 'text'"), boxes.where("kind = 'bubble'")
    inside = pairs(texts.select("page_id", *BOX, "confidence"), bubbles.select("page_id", *BOX), contains("a", "b"))
    texts = inside.select("a.page_id", *(F.col(f"a.{c}").alias(c) for c in (*BOX, "confidence")), F.col("b.box_index").alias("bubble_index"), *(F.col(f"b.{c}").alias(f"b{c}") for c in sides))
    out = _hulls(labelled(texts, _line_groups(), "line_group", keys), [*keys, "line_group"], *(F.first(f"b{c}").alias(f"b{c}") for c in sides))
    edge = {"x1": F.greatest(F.col("x1") - 24, F.col("bx1") - 8), "y1": F.greatest(F.col("y1") - 10, F.col("by1") - 8), "x2": F.least(F.col("x2") + 24, F.col("bx2") + 8), "y2": F.least(F.col("y2") + 10, F.col("by2") + 8)}
    return out.select("page_id", "bubble_index", "line_group", *[e.alias(c) for c, e in edge.items()], "confidence").where("x2 > x1 and y2 > y1")


def free_texts(boxes: DataFrame, w: int, h: int, most: float = 0.35) -> DataFrame:
    """A hull for each line group of each cluster of texts outside bubbles, padded by 20 and 8 (a
    single box: 6), cut at the page; hulls over .35 of the page are dropped."""
    texts, bubbles = boxes.where("kind = 'text'"), boxes.where("kind = 'bubble'")
    alone = pairs(texts.select("page_id", *BOX, "kind", "confidence"), bubbles.select("page_id", *BOX[1:]), contains("a", "b"), "left_anti")
    keys = ("page_id", "cluster")
    clustered = clustered_texts(alone).select("page_id", *BOX, "confidence", "cluster")
    hull = _hulls(labelled(clustered, _line_groups(), "line_group", keys), [*keys, "line_group"])
    pad = F.when(F.col("n") == 1, 6).otherwise(8)
    edge = {"x1": F.greatest(F.lit(0), F.col("x1") - 20), "y1": F.greatest(F.lit(0), F.col("y1") - pad), "x2": F.least(F.lit(w), F.col("x2") + 20), "y2": F.least(F.lit(h), F.col("y2") + pad)}
    out = hull.select(*keys, "line_group", *[e.alias(c) for c, e in edge.items()], "confidence")
    return out.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")) & ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) <= most * w * h))


def detect(boxes: DataFrame, w: int, h: int, empty_bubbles: DataFrame | None = None, iou: float = 0.35, floor: float = 0.05, rows: DataFrame | None = None) -> DataFrame:
    """(page_id, x1, y1, x2, y2, confidence): texts of bubbles, bubbles without text (where given: those
    with a mask) and clusters of free texts, valid ones only, after a last suppression over confidences from 0.05.
    With the pages' pixels (rows: page_id, y, row) tall boxes are split into their lines before."""
    sides = ["page_id", *BOX[1:], "confidence"]
    found = bubble_texts(boxes).select(*sides).unionByName(free_texts(boxes, w, h).select(*sides))
    if empty_bubbles is not None:
        found = found.unionByName(empty_bubbles.select(*sides))
    found = valid_boxes(found, w, h).where(F.col("confidence") >= floor).distinct()
    order = F.row_number().over(_order())
    numbered = found.withColumn("box_index", order)
    if rows is not None:
        numbered = held(numbered)
        lines = split_rows(rows, numbered).drop("line").join(numbered.select("page_id", "box_index", "confidence"), ["page_id", "box_index"])
        numbered = held(lines.select(*sides).distinct().withColumn("box_index", order))
    return kept_boxes(numbered, iou).select(*sides)


def _order():
    from pyspark.sql.window import Window

    return Window.partitionBy("page_id").orderBy(F.desc("confidence"), *BOX[1:])


def region_boxes(regions: DataFrame, boxes: DataFrame) -> DataFrame:
    """(page_id, region_id, boxes): for each region the boxes that aren't removed and have their
    centre in it or share area with it, by (y1, x1, index)."""
    cx, cy = (F.col(f"b.{c}1") + F.col(f"b.{c}2") for c in "xy")
    inside = (cx / 2).between(F.col("a.x1"), F.col("a.x2")) & (cy / 2).between(F.col("a.y1"), F.col("a.y2"))
    share = (F.least("a.x2", "b.x2") > F.greatest("a.x1", "b.x1")) & (F.least("a.y2", "b.y2") > F.greatest("a.y1", "b.y1"))
    found = pairs(regions, boxes.where("not removed"), inside | share)
    listed = F.sort_array(F.collect_list(F.struct(F.col("b.y1"), F.col("b.x1"), F.col("b.box_index"))))
    return found.groupBy("a.page_id", "a.region_id").agg(F.array_join(F.transform(listed, lambda r: r["box_index"].cast("string")), ",").alias("boxes"))


def decode(candidates: DataFrame, w: int, h: int, threshold: float = 0.2) -> DataFrame:
    """Candidates (page_id, box_index, cx, cy, bw, bh in the letterboxed frame, scores, scale, pad_x, pad_y) as boxes:
    the best class's score reaches the threshold, corners are mapped back and cut at the image, sides are at least 4."""
    best = F.array_max("scores")
    low, high = {}, {}
    for c, side, size in (("x", "bw", w), ("y", "bh", h)):
        at = lambda sign, c=c, side=side: (F.col(f"c{c}") + sign * F.col(side) / 2 - F.col(f"pad_{c}")) / F.col("scale")
        low[c], high[c] = F.greatest(F.lit(0.0), at(-1)), F.least(F.lit(float(size)), at(1))
    found = candidates.select("page_id", "box_index", (F.array_position("scores", best) - 1).cast("int").alias("class"), best.alias("confidence"), *[F.round(e[c], 4).alias(f"{c}{i}") for c in "xy" for i, e in ((1, low), (2, high))])
    return found.where((F.col("confidence") >= threshold) & (F.col("x2") - F.col("x1") >= 4) & (F.col("y2") - F.col("y1") >= 4))
