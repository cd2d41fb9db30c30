"""Scalar rules of the editor and the reader of text, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a status stands for where a reply has no detail of its own.
STATUS = {400: "bad request", 404: "not found", 422: "malformed data", 500: "internal error", 502: "bad gateway", 504: "timeout"}


def kernel_size(w: Column, h: Column) -> Column:
    """Odd size of a mask's dilation: a fortieth of the shorter side, rounded to even, doubled and one more, 9 to 15."""
    return F.greatest(F.lit(9), F.least(F.lit(15), F.bround(F.least(w, h) * 0.025).cast("int") * 2 + 1))


def upscaled(w: Column, h: Column, least_w: int = 64, least_h: int = 128, most: float = 4.0) -> tuple[Column, Column]:
    """Size at which text is read: small images grow in proportion, at most 4 times, to 64 by 128 at least."""
    scale = F.least(F.lit(most), F.greatest(F.lit(float(least_w)) / F.greatest(w, F.lit(1)), F.lit(float(least_h)) / F.greatest(h, F.lit(1)), F.lit(1.0)))
    enough = (h >= least_h) & (w >= least_w)
    return tuple(F.when(enough, x).otherwise(F.greatest(F.lit(n), F.floor(x * scale))) for x, n in ((w, least_w), (h, least_h)))


def text_crop(box: tuple[Column, ...], mask: tuple[Column, ...], w: int, h: int, near: int = 12, far: int = 20) -> dict[str, Column]:
    """Where a box's text is read: its mask's bounding box with a margin, kept within the box, or,
    without a mask, the box with a wider margin, kept within the image.  mask: within the box, ends exclusive, or null."""
    out = {}
    for i, (name, size) in enumerate((("x1", w), ("y1", h), ("x2", w), ("y2", h))):
        low, own, high = box[i % 2], mask[i], box[i % 2 + 2]
        held = F.greatest(low, low + own - near) if i < 2 else F.least(high, low + own + near)
        free = F.greatest(F.lit(0), box[i] - far) if i < 2 else F.least(F.lit(size), box[i] + far)
        out[name] = F.when(own.isNotNull(), held).otherwise(free)
    return out


def is_text_line(x: Column, y: Column, w: Column, h: Column, area: Column, image_w: int, image_h: int, edge: int = 4) -> Column:
    """Whether a component is a line of text: 20 pixels and 6 rows at least, at most one border
    touched, and no thin bar along the upper or lower border."""
    top, bottom, left, right = y <= edge, y + h >= image_h - edge, x <= edge, x + w >= image_w - edge
    touched = sum((c.cast("int") for c in (bottom, left, right)), top.cast("int"))
    return (area >= 20) & (h >= 6) & (touched < 2) & ~((top | bottom) & (w / image_w > 0.85) & (h < 15))


def threads(setting: Column, cpus: Column) -> Column:
    """A whole number from the setting, 1 at least; else by CPUs: 8 from 8 on, 2 from 4 on, else 1."""
    own = F.when(F.trim(setting).rlike(r"^[+-]?\d{1,9}$"), F.trim(setting).cast("int"))
    return F.coalesce(F.greatest(F.lit(1), own), F.when(cpus >= 8, 8).when(cpus >= 4, 2).otherwise(1))


def handle(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The edge or corner that a pointer is at, else `move`; edges are a third of the shorter side wide, 3 to 10."""
    edge = F.greatest(F.lit(3.0), F.least(F.lit(10.0), F.least(x2 - x1, y2 - y1) / 3))
    side = F.when(y - y1 < edge, "n").when(y2 - y < edge, "s").otherwise("")
    side = F.concat(side, F.when(x - x1 < edge, "w").when(x2 - x < edge, "e").otherwise(""))
    return F.when(side == "", "move").otherwise(side)


def drawn(ax: Column, ay: Column, bx: Column, by: Column, scale: Column, least: int = 10) -> dict[str, Column]:
    """A rectangle drawn on the screen in pixels of the image, corners in any order, rounded half up; null if it is too small."""
    sides = {"x1": F.least(ax, bx), "y1": F.least(ay, by), "x2": F.greatest(ax, bx), "y2": F.greatest(ay, by)}
    own = {k: F.floor(v * scale + 0.5) for k, v in sides.items()}
    large = (own["x2"] - own["x1"] >= least) & (own["y2"] - own["y1"] >= least)
    return {k: F.when(large, v) for k, v in own.items()}


def resized(x1: Column, y1: Column, x2: Column, y2: Column, dx: Column, dy: Column, w: int, h: int, least: int = 10) -> dict[str, Column]:
    """A rectangle whose lower right corner is moved, within the page and no smaller than least."""
    return {"x2": F.greatest(x1 + least, F.least(F.lit(w), x2 + dx)), "y2": F.greatest(y1 + least, F.least(F.lit(h), y2 + dy))}


def region_change(x1: Column, y1: Column, x2: Column, y2: Column, w: Column, h: Column, least: int = 10) -> tuple[dict[str, Column], Column]:
    """The corners of an object's new region, cut at its page if that page's size is known, and why the change is refused (null if it isn't);
    corners are null then."""
    known = w.isNotNull() & h.isNotNull()
    cut = {n: F.when(known, F.greatest(F.lit(0), F.least(c, w if n[0] == "x" else h))).otherwise(c) for n, c in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2))}
    missing = x1.isNull() | y1.isNull() | x2.isNull() | y2.isNull()
    small = (cut["x2"] - cut["x1"] < least) | (cut["y2"] - cut["y1"] < least)
    refused = F.when(missing, "invalid").when((x1 < 0) | (y1 < 0), "negative").when((x1 >= x2) | (y1 >= y2), "reversed").when(small, "too small")
    return {n: F.when(refused.isNull(), c) for n, c in cut.items()}, refused


def brush_radius(width: Column) -> Column:
    """A 0.018th of the width, rounded half up, 10 to 30."""
    return F.least(F.lit(30), F.greatest(F.lit(10), F.floor(width * 0.018 + 0.5)))


def error_message(status: Column, detail: Column) -> Column:
    """The details of a reply (an array), joined; or what its status stands for, or its number."""
    said = F.array_join(F.filter(detail, lambda x: F.trim(x) != ""), "; ")
    named = F.lit(None).cast("string")
    for code, text in STATUS.items():
        named = F.when(status == code, F.lit(f"{text} ({code})")).otherwise(named)
    return F.coalesce(F.nullif(said, F.lit("")), named, F.concat(F.lit("HTTP "), status.cast("string")))


def stroke_colour(luminance: Column) -> Column:
    """Black around bright text, white around dark."""
    return F.when(luminance > 128, "#000000").otherwise("#FFFFFF")
