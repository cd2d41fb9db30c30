"""Laying out text in boxes.  Widths come from a metric, (text, font size) -> pixels, since no fonts are shipped."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Metric = Callable[[str, int], float]
SMALLEST, LARGEST = 6, 48


def monospace(text: str, size: int) -> float:
    """A metric of equally wide characters, .6 of the size each."""
    return 0.6 * size * len(text)


def wrap(text: str, size: int, width: float, metric: Metric = monospace) -> list[str]:
    """Lines of a text: words as long as they fit, too wide words by characters, blank lines kept."""
    out = []
    for line in text.splitlines():
        held, made = "", len(out)
        for word in line.split():
            whole = metric(word, size) <= width
            if not whole and held:
                out.append(held)
                held = ""
            for part, glue in [(word, " ")] if whole else [(c, "") for c in word]:
                longer = f"{held}{glue}{part}" if held else part
                if held and metric(longer, size) > width:
                    out.append(held)
                    longer = part
                held = longer
        if held or len(out) == made:
            out.append(held)
    return out


def line_height(size: int, stroke: int, share: float = 1.18) -> int:
    """With an ascent and a descent of a size together."""
    return int(max(size, 8) * share) + 2 * stroke


def fit(text: str, width: int, height: int, stroke: int = 2, metric: Metric = monospace) -> tuple[int, list[str]]:
    """The size that a bisection from 6 to 48 finds last to fit, and the lines; size 6 if none fits."""
    low, high, best = SMALLEST, LARGEST, None
    while low <= high:
        size = (low + high) // 2
        lines = wrap(text, size, width, metric)
        if lines and len(lines) * line_height(size, stroke) <= height and max(metric(x, size) for x in lines) <= width:
            best, low = (size, lines), size + 1
        else:
            high = size - 1
    return best or (SMALLEST, wrap(text, SMALLEST, width, metric))


def fitted(texts: DataFrame, key: str, metric: Metric = monospace) -> DataFrame:
    """(key, font_size, n_lines) of rows key, text, width, height; null text is empty."""

    def run(batches):
        for pdf in batches:
            got = [fit(t or "", int(w), int(h), metric=metric) for t, w, h in zip(pdf["text"], pdf["width"], pdf["height"], strict=True)]
            yield pd.DataFrame({key: pdf[key], "font_size": [g[0] for g in got], "n_lines": [len(g[1]) for g in got]})

    return texts.select(key, "text", "width", "height").mapInPandas(run, f"{key} long, font_size int, n_lines int")


def inner_box(w: Column, h: Column, padding: int = 6) -> tuple[Column, Column, Column]:
    """Padding, width and height left for text in a w by h box: 8 % of the shorter side, from 2 to padding."""
    pad = F.greatest(F.lit(2), F.least(F.lit(padding).cast("long"), F.floor(F.least(w, h) * 0.08)))
    return pad, w - pad * 2, h - pad * 2


def start(at: Column, pad: Column, room: Column, size: Column, align: Column, first: str, last: str) -> Column:
    """Where text of a size starts along an axis; anything but first and last is centred."""
    left = F.greatest(F.lit(0), room - size)
    return at + pad + F.when(align == first, 0).when(align == last, left).otherwise(F.floor(left / 2))


def read_choice(raw: Column, enhanced: Column) -> Column:
    """The plain reading if it has two characters or more, else the longer one (the enhanced one on ties)."""
    r, e = F.coalesce(raw, F.lit("")), F.coalesce(enhanced, F.lit(""))
    return F.when(F.length(F.trim(r)) >= 2, r).when(F.length(e) >= F.length(r), e).otherwise(r)


def joined_lines(lines: Column, least: float = 0.25) -> Column:
    """The texts of lines array<struct<y, text, confidence>> by y, trimmed, without weak and empty ones."""
    kept = F.filter(F.sort_array(lines), lambda r: (r["confidence"] > least) & (F.trim(r["text"]) != ""))
    return F.array_join(F.transform(kept, lambda r: F.trim(r["text"])), "\n")


def bold_offsets(bold: Column) -> Column:
    """Where a text is drawn for each time it is: bold text four times, a pixel to the right and below."""
    at = lambda *places: F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in places))
    return F.when(F.coalesce(bold, F.lit(False)), at((0, 0), (1, 0), (0, 1), (1, 1))).otherwise(at((0, 0)))


def corner_radius(radius: Column, w: Column, h: Column) -> Column:
    """The radius of a background's corners: not under 0, and not over half of the shorter side less one."""
    return F.greatest(F.lit(0), F.least(radius.cast("int"), F.floor((F.least(w, h) - 1) / 2).cast("int")))


def has_background(colour: Column) -> Column:
    return ~F.coalesce(colour.isin("transparent", "none", ""), F.lit(True))
