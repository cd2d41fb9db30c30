"""Rectangles as columns; coordinates are inclusive integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def corner(table: str, name: str) -> Column:
    return F.col(f"{table}.{name}" if table else name)


def area(t: str = "") -> Column:
    return (corner(t, "x2") - corner(t, "x1")) * (corner(t, "y2") - corner(t, "y1"))


def overlap(a: str, b: str) -> Column:
    """Area that two rectangles share."""
    w = F.least(corner(a, "x2"), corner(b, "x2")) - F.greatest(corner(a, "x1"), corner(b, "x1"))
    h = F.least(corner(a, "y2"), corner(b, "y2")) - F.greatest(corner(a, "y1"), corner(b, "y1"))
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def centre(t: str = "") -> tuple[Column, Column]:
    return (corner(t, "x1") + corner(t, "x2")) / 2, (corner(t, "y1") + corner(t, "y2")) / 2


def contains(inner: str, outer: str, share: float = 0.5) -> Column:
    """The inner one's centre lies in the outer one, edges included, or so much of its area does."""
    x, y = centre(inner)
    inside = x.between(corner(outer, "x1"), corner(outer, "x2")) & y.between(corner(outer, "y1"), corner(outer, "y2"))
    return inside | ((area(inner) > 0) & (overlap(inner, outer) / area(inner) >= share))


def gaps(a: str, b: str) -> tuple[Column, Column]:
    """Distance of two rectangles along each axis; 0 where they overlap."""
    x = F.greatest(corner(a, "x1") - corner(b, "x2"), corner(b, "x1") - corner(a, "x2"), F.lit(0))
    y = F.greatest(corner(a, "y1") - corner(b, "y2"), corner(b, "y1") - corner(a, "y2"), F.lit(0))
    return x, y


def iou(a: str, b: str) -> Column:
    return overlap(a, b) / (area(a) + area(b) - overlap(a, b))


def letterbox(w: Column, h: Column, size: int = 1024) -> tuple[Column, Column, Column]:
    """Scale and paddings that centre a w by h image in a square."""
    scale = F.least(size / w, size / h)
    return scale, F.floor((size - F.round(w * scale)) / 2), F.floor((size - F.round(h * scale)) / 2)


def crop(w: int, h: int, pad: int = 35, longest: float = 1.8) -> dict[str, Column]:
    """A rectangle padded; a long one is cut at the image's edges, another one becomes a
    square that is shifted into the image as far as it fits."""
    low, high, size = {}, {}, {"x": w, "y": h}
    for c in "xy":
        low[c], high[c] = F.col(f"{c}1") - pad, F.col(f"{c}2") + pad
    bw, bh = (high[c] - low[c] for c in "xy")
    long = F.greatest(bw / F.greatest(F.lit(1), bh), bh / F.greatest(F.lit(1), bw)) > longest
    side, out = F.greatest(bw, bh), {}
    for c in "xy":
        a, b = ((low[c] + high[c] + sign * side) / 2 for sign in (-1, 1))
        start = F.when(a < 0, 0).when(b > size[c], F.greatest(F.lit(0), a - (b - size[c]))).otherwise(a)
        end = F.when(a < 0, F.least(F.lit(size[c]), b - a)).when(b > size[c], size[c]).otherwise(b)
        out[f"c{c}1"] = F.when(long, F.greatest(low[c], F.lit(0))).otherwise(F.floor(start)).cast("long")
        out[f"c{c}2"] = F.when(long, F.least(high[c], F.lit(size[c]))).otherwise(F.floor(end)).cast("long")
    return {n: out[n] for n in ("cx1", "cy1", "cx2", "cy2")}
