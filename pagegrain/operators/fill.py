"""What is to be filled on a page, and how: a plan of crops, with constant fills done.

An image and its mask, or its boxes, are one unit.  Its parts (groups of mask pixels, or clusters of boxes) are
filled in order, since a later crop sees what an earlier one has filled.  A part whose surroundings are nearly all white,
nearly all black or even gets their median; others need a model, which is not here: the plan says so, in which tiles, and which later parts
look at pixels that such a part would change."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .content import gathered, image, joined, runs, widened
from .grouping import _capacity, _line_groups
from .raster import ellipse, square

LIVE = 127
PLAN = "img long, part int, boxes array<int>, x1 int, y1 int, x2 int, y2 int, pixels long, route string, value int, waits_for int, tiles array<struct<y1: int, x1: int, y2: int, x2: int, active: boolean>>"
Part = tuple[list[int], tuple[int, int, int, int], np.ndarray]  # boxes, crop, its mask


def fill_of(crop: np.ndarray, mask: np.ndarray, light: int = 215, dark: int = 35, share: float = 0.7, flat: float = 12.0) -> tuple[str, int | None]:
    """The route of a crop and, unless it needs a model, the value that fills its mask."""
    rest = crop[~mask]
    if rest.size:
        for route, some in (("white", rest > light), ("black", rest < dark)):
            if some.mean() >= share:
                return route, int(np.median(rest[some]))
        if rest.std() < flat:
            return "low_std", int(np.median(rest))
    return "model", None


def tile_starts(length: int, size: int, step: int) -> list[int]:
    return [0] if length <= size else sorted({*range(0, length - size + 1, step), length - size})


def tiles_of(mask: np.ndarray, size: int = 512, overlap: int = 64) -> list[dict]:
    """The tiles of a crop larger than one; those without a masked pixel are passed over."""
    h, w = mask.shape
    if max(h, w) <= size:
        return []
    corners = ((y, x, min(h, y + size), min(w, x + size)) for y in tile_starts(h, size, size - overlap) for x in tile_starts(w, size, size - overlap))
    return [{"y1": y1, "x1": x1, "y2": y2, "x2": x2, "active": bool(mask[y1:y2, x1:x2].any())} for y1, x1, y2, x2 in corners]


def filled(gray: np.ndarray, parts: Iterable[Part], least: int = 4) -> tuple[list[tuple], np.ndarray]:
    """The plan's rows of an image's parts in order, and the image with its constant fills.  Crops of mask parts are tiled, those of boxes aren't."""
    out, plan, waiting = gray.copy(), [], []
    for number, (boxes, crop, mask) in enumerate(parts):
        x1, y1, x2, y2 = crop
        pixels = int(mask.sum())
        if min(y2 - y1, x2 - x1) < least or not pixels:
            plan.append((number, boxes, *crop, pixels, "none", None, None, []))
            continue
        route, value = fill_of(out[y1:y2, x1:x2], mask)
        changed = [n for n, (a, b, c, d), m in waiting if min(c, x2) > max(a, x1) and min(d, y2) > max(b, y1) and m[max(b, y1) - b : min(d, y2) - b, max(a, x1) - a : min(c, x2) - a].any()]
        plan.append((number, boxes, *crop, pixels, route, value, changed[-1] if changed else None, tiles_of(mask) if not boxes and route == "model" else []))
        if route == "model":
            waiting.append((number, crop, mask))
        else:
            out[y1:y2, x1:x2][mask] = value
    return plan, out


def mask_parts(mask: np.ndarray, pad: int = 72, most: int = 15, fewest: int = 9) -> Iterator[Part]:
    """Groups of pixels over LIVE that touch by sides or corners, in row order, each grown by an ellipse that
    follows its size, in a crop that reaches `pad` further."""
    height, width = mask.shape
    rows, begins, ends = runs(mask > LIVE)
    label = joined(rows, begins, ends)
    order = np.argsort(label, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(label[order])) + 1) if len(order) else []:
        top, bottom, left, right = rows[group].min(), rows[group].max() + 1, begins[group].min(), ends[group].max()
        size = int(np.clip(round(max(1, min(right - left, bottom - top)) * 0.025) * 2 + 1, fewest, most))
        r = size // 2
        own = np.zeros((bottom - top + 2 * r, right - left + 2 * r), bool)
        for y, a, b in zip(rows[group] - top + r, begins[group] - left + r, ends[group] - left + r, strict=True):
            own[y, a:b] = True
        grown = widened(own, ellipse(size))
        # of the grown group, what lies on the image
        y0, x0 = max(0, top - r), max(0, left - r)
        y9, x9 = min(height, bottom + r), min(width, right + r)
        grown = grown[y0 - (top - r) : y9 - (top - r), x0 - (left - r) : x9 - (left - r)]
        crop = max(0, x0 - pad), max(0, y0 - pad), min(width, x9 - 1 + pad), min(height, y9 - 1 + pad)
        local = np.zeros((crop[3] - crop[1], crop[2] - crop[0]), bool)
        local[y0 - crop[1] : y9 - crop[1], x0 - crop[0] : x9 - crop[0]] = grown
        yield [], tuple(map(int, crop)), local


def crop_around(hull: tuple[int, int, int, int], width: int, height: int, pad: int = 35, longest: float = 1.8) -> tuple[int, int, int, int]:
    """A hull padded: cut at the image if it is long, else a square moved into the image as far as it fits."""
    (x1, y1, x2, y2), size = (v + s * pad for v, s in zip(hull, (-1, -1, 1, 1), strict=True)), (width, height)
    w, h = x2 - x1, y2 - y1
    if max(w / max(1, h), h / max(1, w)) > longest:
        return max(0, x1), max(0, y1), min(width, x2), min(height, y2)
    side, ends = max(w, h), []
    for low, high, full in ((x1, x2, size[0]), (y1, y2, size[1])):
        a, b = (low + high - side) / 2, (low + high + side) / 2
        ends.append((0, min(full, b - a)) if a < 0 else (max(0, a - (b - full)), full) if b > full else (a, b))
    return int(ends[0][0]), int(ends[1][0]), int(ends[0][1]), int(ends[1][1])


def local_mask(boxes: list[dict], crop: tuple[int, int, int, int], gray: np.ndarray, margin: int = 8, busy: float = 18.0) -> np.ndarray:
    """The boxes' masks in a crop, grown by an ellipse of 7, or of 9 where the pixels around it vary."""
    cx, cy, cx2, cy2 = crop
    out = np.zeros((max(0, cy2 - cy), max(0, cx2 - cx)), bool)
    for b in boxes:
        w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
        if w <= 0 or h <= 0:
            continue
        x1, y1, x2, y2 = b["x1"] - cx, b["y1"] - cy, b["x2"] - cx, b["y2"] - cy
        if b.get("mask") and b["mask"][0]:
            own = np.asarray(b["mask"]) > LIVE
            if own.shape != (h, w):
                own = own[np.ix_(np.arange(h) * own.shape[0] // h, np.arange(w) * own.shape[1] // w)]
            part = out[max(0, y1) : max(0, y2), max(0, x1) : max(0, x2)]
            part |= own[max(0, -y1) : max(0, -y1) + part.shape[0], max(0, -x1) : max(0, -x1) + part.shape[1]]
        else:
            out[max(0, y1 - margin) : max(0, y2 + margin + 1), max(0, x1 - margin) : max(0, x2 + margin + 1)] = True
    if not out.any():
        return out
    grown = widened(out, ellipse(7))
    ring = widened(grown, square(3)) & ~grown
    return widened(out, ellipse(9)) if ring.any() and gray[ring].std() > busy else grown


def box_parts(gray: np.ndarray, boxes: list[dict], reach: int = 35, side: int = 600, most: float = 0.35) -> Iterator[Part]:
    """Clusters of near boxes, split where they have many lines; a cluster of several boxes over
    `most` of the page is left out."""
    height, width = gray.shape
    known = {b["box_index"]: b for b in boxes}
    clusters: dict[int, list[dict]] = {}
    for index, first in _capacity(reach, side)(sorted(boxes, key=lambda b: b["box_index"])):
        clusters.setdefault(first, []).append(known[index])
    for cluster in clusters.values():
        groups: dict[int, list[dict]] = {}
        for index, group in _line_groups()(cluster):
            groups.setdefault(group, []).append(known[index])
        for members in groups.values():
            hull = (min(b["x1"] for b in members), min(b["y1"] for b in members), max(b["x2"] for b in members), max(b["y2"] for b in members))
            if len(members) == 1 or (hull[2] - hull[0]) * (hull[3] - hull[1]) <= most * width * height:
                crop = crop_around(hull, width, height)
                yield sorted(b["box_index"] for b in members), crop, local_mask(members, crop, gray[crop[1] : crop[3], crop[0] : crop[2]])


def _planned(batches, parts_of: Callable, rows: bool) -> Iterator[pa.RecordBatch]:
    """The plan's rows, or the filled images' rows, of each image."""
    schema = pa.schema([("img", pa.int64()), ("part", pa.int32()), ("boxes", pa.list_(pa.int32())), *((n, pa.int32()) for n in ("x1", "y1", "x2", "y2")), ("pixels", pa.int64()), ("route", pa.string()), ("value", pa.int32()), ("waits_for", pa.int32()), ("tiles", pa.list_(pa.struct([*((n, pa.int32()) for n in ("y1", "x1", "y2", "x2")), ("active", pa.bool_())])))])
    for batch in batches:
        for i in range(len(batch)):
            held = batch["gray"][i]
            if not (held.is_valid and len(held.values) and batch["img"][i].is_valid):
                continue
            img, gray = batch["img"][i].as_py(), image(held.values).astype(np.int64)
            plan, out = filled(gray, parts_of(gray, batch, i) if gray.size else [])
            if rows:
                flat = pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1], out.astype(np.int32).ravel())
                yield pa.record_batch([pa.array(np.full(len(out), img)), pa.array(np.arange(len(out), dtype=np.int32)), flat], ["img", "y", "row"])
            elif plan:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(([img] * len(plan), *zip(*plan, strict=True)), schema, strict=True)], schema=schema)


def _by_mask(gray: np.ndarray, batch: pa.RecordBatch, i: int) -> Iterable[Part]:
    held = batch["mask"][i]
    mask = image(held.values) if held.is_valid and len(held.values) else None
    if mask is not None and mask.shape != gray.shape:
        raise ValueError("a mask has its image's size")
    return () if mask is None else mask_parts(mask)


def _by_boxes(gray: np.ndarray, batch: pa.RecordBatch, i: int) -> Iterable[Part]:
    return box_parts(gray, batch["boxes"][i].as_py() or [])


def _by_edit(gray: np.ndarray, batch: pa.RecordBatch, i: int, faint: int = 10) -> Iterator[Part]:
    """What an edited page is filled with again: its boxes that aren't removed, then what was painted by hand, however faint, in the page's size."""
    yield from box_parts(gray, [b for b in batch["boxes"][i].as_py() or [] if not b["removed"]])
    held = batch["manual"][i]
    if held.is_valid and len(held.values):
        manual = image(held.values)
        h, w = gray.shape
        manual = manual[np.ix_(np.arange(h) * manual.shape[0] // h, np.arange(w) * manual.shape[1] // w)]
        yield from mask_parts((manual > faint) * 255)


def mask_plan(images: DataFrame) -> DataFrame:
    """The plan of images (img, gray, mask: rows of one size), part by part.  Images or masks that are
    null or empty have no parts."""
    return images.select("img", "gray", "mask").mapInArrow(lambda b: gathered(_planned(b, _by_mask, False)), PLAN)


def mask_filled(images: DataFrame) -> DataFrame:
    """(img, y, row): those images with their constant fills."""
    return images.select("img", "gray", "mask").mapInArrow(lambda b: _planned(b, _by_mask, True), "img long, y int, row array<int>")


def box_plan(images: DataFrame) -> DataFrame:
    """The plan of images (img, gray, boxes: array of box_index, x1, y1, x2, y2, mask); crops of boxes aren't tiled."""
    return images.select("img", "gray", "boxes").mapInArrow(lambda b: gathered(_planned(b, _by_boxes, False)), PLAN)


def box_filled(images: DataFrame) -> DataFrame:
    return images.select("img", "gray", "boxes").mapInArrow(lambda b: _planned(b, _by_boxes, True), "img long, y int, row array<int>")


def second_plan(images: DataFrame) -> DataFrame:
    """The plan of pages that were edited (img, gray, boxes with removed, manual: a mask of any size, or null): parts of boxes first, then those of
    the manual mask, which see what the boxes' fills have left."""
    return images.select("img", "gray", "boxes", "manual").mapInArrow(lambda b: gathered(_planned(b, _by_edit, False)), PLAN)


def second_filled(images: DataFrame) -> DataFrame:
    return images.select("img", "gray", "boxes", "manual").mapInArrow(lambda b: _planned(b, _by_edit, True), "img long, y int, row array<int>")
