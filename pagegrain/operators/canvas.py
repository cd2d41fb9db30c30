"""Clicks on a canvas, the area that a click selects, and tall boxes split by their pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SELECTION = "img long, click long, refused boolean, pixels long, runs array<struct<y: int, x1: int, x2: int>>"
PAGES = 16  # pages whose pixels and lines are Python's objects at once
SPLIT = pa.schema([("page_id", pa.int64()), ("box_index", pa.int32()), ("line", pa.int32()), *((c, pa.int32()) for c in ("x1", "y1", "x2", "y2")), ("mask", pa.list_(pa.list_(pa.int32())))])
LINES = "page_id long, box_index int, line int, x1 int, y1 int, x2 int, y2 int, mask array<array<int>>"


def double_clicks(clicks: DataFrame, key: str, within_ms: int = 350, reach: float = 20, part_ms: int = 600_000) -> DataFrame:
    """(key, event_id, double): whether a click (key, event_id, at in ms, x, y) is the second of a double one.

    A click is double if it follows its key's click before in less than within_ms, nearer
    than reach, and that one isn't double itself: along a chain of such clicks every second
    one is.  Chains are counted within parts of part_ms, so that a busy key is many groups;
    a part begins with what the parts before it, one row each, leave.  Clicks at one time
    follow event_id; a click without a time or place is near to none."""
    if part_ms < within_ms:
        raise ValueError("a part must be as long as a double click at least")

    def near(at: Column, x: Column, y: Column) -> Column:
        apart = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
        return F.coalesce((F.col("at") - at < within_ms) & (apart < reach * reach), F.lit(False))

    rows = clicks.select(F.col(key).alias("key"), "event_id", "at", "x", "y", F.coalesce(F.floor(F.col("at") / part_ms), F.lit(-1).cast("long")).alias("part"))
    inside = Window.partitionBy("key", "part").orderBy("at", "event_id")
    rows = rows.withColumn("place", F.row_number().over(inside) - 1)
    rows = rows.withColumn("alone", (F.col("place") > 0) & ~near(*(F.lag(c).over(inside) for c in ("at", "x", "y"))))
    rows = rows.withColumn("chain", F.sum(F.col("alone").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("step", F.row_number().over(Window.partitionBy("key", "part", "chain").orderBy("at", "event_id")) - 1)

    click, order = F.struct("at", "x", "y", "step", "chain"), F.col("place")
    parts = rows.groupBy("key", "part").agg(F.min_by(click, order).alias("first"), F.max_by(click, order).alias("last"))
    before = Window.partitionBy("key").orderBy("part")
    parts = parts.select("key", "part", "last", "first.at", "first.x", "first.y", F.lag("last").over(before).alias("prior"))
    parts = parts.withColumn("joined", near(F.col("prior.at"), F.col("prior.x"), F.col("prior.y")))
    # what the first click of a part is follows from the one before: known, or the opposite of a chain's end
    known = ~F.col("joined") | (F.col("prior.chain") > 0)
    flip = F.when(~F.col("joined"), 0).when(F.col("prior.chain") > 0, 1 - F.col("prior.step") % 2).otherwise(1 + F.col("prior.step") % 2)
    parts = parts.withColumns({"known": known.cast("int"), "flip": flip})
    parts = parts.withColumn("since", F.sum("known").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    carried = F.sum("flip").over(Window.partitionBy("key", "since").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) % 2
    parts = parts.select(F.col("key").alias("its_key"), F.col("part").alias("its_part"), carried.alias("carried"))

    out = rows.join(parts, F.col("key").eqNullSafe(F.col("its_key")) & (F.col("part") == F.col("its_part")))
    double = (F.col("step") + F.when(F.col("chain") == 0, F.col("carried")).otherwise(0)) % 2 == 1
    return out.select(F.col("key").alias(key), "event_id", double.alias("double"))


def like_seed(image: np.ndarray, y: int, x: int, tolerance: int) -> np.ndarray:
    """(row, begin, end) of each run of the pixels that hang together with one by their sides,
    all channels within tolerance of it."""
    same = (np.abs(image - image[y, x]) <= tolerance).all(-1)
    edges = np.diff(np.pad(same, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (rows, begins), ends = np.nonzero(edges == 1), np.nonzero(edges == -1)[1]
    of_row = np.searchsorted(rows, np.arange(len(image) + 1))
    first = int(of_row[y] + np.searchsorted(begins[of_row[y] : of_row[y + 1]], x, "right") - 1)
    found, left = [first], np.ones(len(rows), bool)
    left[first] = False
    for run in found:  # grows while it is read
        for row in (rows[run] - 1, rows[run] + 1):
            if 0 <= row < len(image):
                a, b = of_row[row], of_row[row + 1]
                touching = np.arange(a + np.searchsorted(ends[a:b], begins[run], "right"), a + np.searchsorted(begins[a:b], ends[run]))
                touching = touching[left[touching]]
                left[touching] = False
                found += touching.tolist()
    found.sort()
    return np.stack([rows[found], begins[found], ends[found]], 1)


def flood_select(px: DataFrame, clicks: DataFrame, channels: tuple[str, ...] = ("v",), tolerance: int = 22, share: float = 0.15, most: int = 260_000) -> DataFrame:
    """(img, click, refused, pixels, runs) of clicks (img, click, y, x) on images (img, y, x, channels).

    What hangs together with the clicked pixel and has its colour is selected, as runs of
    rows (x2 exclusive), but refused whole if it is more than share of the image or more than
    `most` pixels.  A click outside of its image selects nothing.  One image is one array."""

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                held = batch["held"][i].values
                ys, xs = (held.field(c).to_numpy() for c in ("y", "x"))
                image = np.full((ys.max() + 1, xs.max() + 1, len(channels)), np.iinfo(np.int32).min, np.int64)
                image[ys, xs] = np.stack([held.field(c).to_numpy() for c in channels], 1)
                height, width = image.shape[:2]
                y, x = batch["y"][i].as_py(), batch["x"][i].as_py()
                runs = like_seed(image, y, x, tolerance) if 0 <= y < height and 0 <= x < width else np.zeros((0, 3), np.int64)
                count = int((runs[:, 2] - runs[:, 1]).sum())
                refused = count > min(int(height * width * share + 0.5), most)
                runs = runs[:0] if refused else runs
                listed = pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in runs.T], ["y", "x1", "x2"])
                found = pa.ListArray.from_arrays(pa.array([0, len(runs)], pa.int32()), listed)
                yield pa.record_batch([batch["img"].slice(i, 1).cast(pa.int64()), batch["click"].slice(i, 1).cast(pa.int64()), pa.array([refused]), pa.array([0 if refused else count], pa.int64()), found], ["img", "click", "refused", "pixels", "runs"])

    images = px.groupBy("img").agg(F.collect_list(F.struct("y", "x", *channels)).alias("held"))
    return images.join(clicks.select("img", "click", "y", "x").dropna(), "img").mapInArrow(select, SELECTION)


def text_lines(gray: np.ndarray, box: tuple[int, int, int, int], tall: int = 45, least: int = 4, pad: int = 3, trim: int = 10) -> list[tuple[int, int, int, int]]:
    """A tall box's lines of text as boxes; the box itself if it is low or has fewer than two lines."""
    x1, y1, x2, y2 = box
    crop = gray[y1:y2, x1:x2]
    if y2 - y1 <= tall or not crop.size:
        return [box]
    dark = np.concatenate(([0], crop.mean(1) < np.percentile(crop, 90) - 2, [0])).astype(np.int8)
    begins, ends = np.flatnonzero(np.diff(dark) == 1), np.flatnonzero(np.diff(dark) == -1)
    long = ends - begins >= least
    begins, ends = begins[long], ends[long]
    if len(begins) < 2:
        return [box]
    room_above = begins - np.append(0, ends[:-1])
    room_below = np.append(begins[1:], len(crop)) - ends
    tops = np.maximum(0, y1 + begins - np.clip(room_above // 2, 1, pad))
    bottoms = np.minimum(len(gray), y1 + ends + np.clip(room_below // 2, 1, pad))
    out = []
    for top, bottom in zip(tops.tolist(), bottoms.tolist(), strict=True):
        columns = gray[top:bottom, x1:x2].mean(0)
        text = np.flatnonzero(columns < np.percentile(columns, 90) - 2)
        left, right = (max(x1, x1 + int(text[0]) - trim), min(x2, x1 + int(text[-1]) + trim)) if len(text) else (x1, x2)
        out.append((left, top, right, bottom))
    return out


def cut_mask(mask: np.ndarray | None, box: tuple[int, int, int, int], line: tuple[int, int, int, int]) -> np.ndarray:
    """The part of a box's mask that a line covers, 0 beyond the box; without a mask all is 255."""
    (bx, by, _, _), (x1, y1, x2, y2) = box, line
    if mask is None:
        return np.full((y2 - y1, x2 - x1), 255, np.int64)
    above, left = max(0, by - y1), max(0, bx - x1)
    own = mask[max(0, y1 - by) : max(0, y2 - by), max(0, x1 - bx) : max(0, x2 - bx)]
    out = np.zeros((y2 - y1, x2 - x1), np.int64)
    out[above : above + own.shape[0], left : left + own.shape[1]] = own
    return out


def split_tall(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """(page_id, box_index, line, x1, y1, x2, y2, mask): tall boxes of pages (page_id, gray: rows of
    pixels) become their lines of text, trimmed to what they hold; other boxes stay, as line 0.

    boxes hold page_id, box_index, x1, y1, x2, y2 within the page and a mask of their size or
    null.  A page and its boxes are one row, so a page's pixels are shuffled once; of the pages of a batch few at a time are Python's objects."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), PAGES):
                pdf, out = batch.slice(first, PAGES).to_pandas(), []
                for page, gray, listed in zip(pdf["page_id"], pdf["gray"], pdf["boxes"], strict=True):
                    gray = np.stack([np.asarray(r) for r in gray]) if len(gray) else np.zeros((0, 0))
                    for b in listed:
                        box = (b["x1"], b["y1"], b["x2"], b["y2"])
                        mask = None if b["mask"] is None else np.stack([np.asarray(r) for r in b["mask"]])
                        out += [(page, b["box_index"], k, *line, cut_mask(mask, box, line).tolist()) for k, line in enumerate(text_lines(gray, box))]
                if out:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SPLIT, strict=True)], schema=SPLIT)

    held = boxes.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("box_index", "x1", "y1", "x2", "y2", "mask"))).alias("boxes"))
    return pages.select("page_id", "gray").join(held, "page_id").mapInArrow(split, LINES)


def split_rows(rows: DataFrame, boxes: DataFrame, tall: int = 45, bucket: int = 64) -> DataFrame:
    """(page_id, box_index, line, x1, y1, x2, y2): split_tall's boxes, of pages kept by rows (page_id, y, row).

    Only tall boxes look at pixels, and only at the rows and columns they cover, and one row around
    them: boxes and rows meet by buckets of rows, so a page is never in one place.  A page's rows are complete; a tall
    box on a page without rows stays."""
    corners = ("x1", "y1", "x2", "y2")
    own = boxes.select("page_id", "box_index", *(F.col(c).cast("int").alias(c) for c in corners))
    low, high = F.greatest(F.lit(0), F.col("y1") - 1), F.col("y2")
    asked = own.where(F.col("y2") - F.col("y1") > tall).withColumn("bucket", F.explode(F.sequence(F.floor(low / bucket), F.floor(high / bucket))))
    there = rows.select("page_id", F.col("y").cast("int").alias("y"), "row", F.floor(F.col("y") / bucket).alias("bucket"))
    # merged, for the planner takes a row of pixels for a single value and would broadcast pages
    met = asked.join(there.hint("merge"), ["page_id", "bucket"]).where((F.col("y") >= low) & (F.col("y") <= high) & (F.col("x2") > F.col("x1")))
    part = F.slice("row", F.greatest(F.lit(0), F.col("x1")) + 1, F.col("x2") - F.greatest(F.lit(0), F.col("x1")))
    crops = met.groupBy("page_id", "box_index", *corners).agg(F.sort_array(F.collect_list(F.struct("y", part.alias("part")))).alias("crop"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page, index, x1, y1, x2, y2, crop in pdf.itertuples(index=False):
                gray, top = np.stack([np.asarray(r["part"]) for r in crop]), crop[0]["y"]
                lines = text_lines(gray, (0, y1 - top, x2 - x1, y2 - top))
                out += [(page, index, k, x1 + a, top + b, x1 + c, top + d) for k, (a, b, c, d) in enumerate(lines)]
            yield pd.DataFrame(out, columns=["page_id", "box_index", "line", *corners])

    lines = crops.select("page_id", "box_index", *corners, "crop").mapInPandas(split, "page_id long, box_index int, line int, x1 int, y1 int, x2 int, y2 int")
    rest = own.join(crops.select("page_id", "box_index").hint("merge"), ["page_id", "box_index"], "left_anti")
    return lines.unionByName(rest.select("page_id", F.col("box_index").cast("int").alias("box_index"), F.lit(0).alias("line"), *corners))
