"""Contrast and neighbourhoods of gray images.

Weighted neighbourhoods and closing work on rows (img, y, row), row an array, by windows over an image's rows, in built-in
expressions.  Contrast by tiles takes an image (img, gray), an array of rows, as one unit, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import raster
from .content import image

#: Fixed weights: a Gaussian of seven pixels and a sharpening cross.
FEATHER = (0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125)
SHARPEN = {-1: {0: -0.3}, 0: {-1: -0.3, 0: 2.2, 1: -0.3}, 1: {0: -0.3}}


def _mirrored(at: Column, size: Column) -> Column:
    """A place beyond an end, counted back from it; the end itself isn't repeated."""
    turn = F.greatest(F.lit(1), 2 * (size - 1))
    place = F.pmod(at, turn)
    return F.when(size == 1, 0).otherwise(F.least(place, turn - place)).cast("int")


def _along(row: str, weights: dict[int, float]) -> Column:
    size = F.size(row)
    total = lambda x: sum((F.get(row, _mirrored(x + dx, size)) * F.lit(float(w)) for dx, w in weights.items()), F.lit(0.0))
    return F.when(size == 0, F.col(row)).otherwise(F.transform(F.sequence(F.lit(0), size - 1), total))


def convolved(rows: DataFrame, kernel: dict[int, dict[int, float]]) -> DataFrame:
    """rows (img, y, row) with each pixel the weighted sum of its neighbours: row below -> pixel to the
    right -> weight.  Beyond the border images are mirrored about their outer pixels.  An image has rows 0 to its height - 1,
    of one length; a null row stays null."""
    sums = {dy: F.when(F.col("row").isNotNull(), _along("row", w)).alias(f"w{i}") for i, (dy, w) in enumerate(kernel.items())}
    page = Window.partitionBy("img")
    rows = rows.select("img", "y", F.col("row").cast("array<double>").alias("row")).withColumn("height", F.count("*").over(page))
    wide = rows.select("img", "y", "height", *sums.values())
    order = Window.partitionBy("img").orderBy("y")
    reach = max((abs(dy) for dy in kernel), default=0)

    def moved(name: str, dy: int) -> Column:
        """The row at y + dy, mirrored: for a border row one of those on the other side."""
        to = _mirrored(F.col("y") + dy, F.col("height")) - F.col("y")
        out = F.lead(name, dy).over(order) if dy >= 0 else F.lag(name, -dy).over(order)
        for d in range(-reach, reach + 1):
            if d != dy:
                out = F.when(to == d, F.lead(name, d).over(order) if d >= 0 else F.lag(name, -d).over(order)).otherwise(out)
        return out

    parts = [moved(f"w{i}", dy) for i, dy in enumerate(kernel)]
    named = wide.select("img", "y", *(p.alias(f"p{i}") for i, p in enumerate(parts)))
    total = F.col("p0")
    for i in range(1, len(parts)):
        total = F.zip_with(total, F.col(f"p{i}"), lambda a, b: a + b)
    return named.select("img", "y", total.alias("row"))


def feathered(rows: DataFrame, weights: tuple[float, ...] = FEATHER) -> DataFrame:
    """Rows softened by a separable kernel: along each row, then down the columns."""
    r = len(weights) // 2
    along = rows.select("img", "y", _along("row", {i - r: w for i, w in enumerate(weights)}).alias("row"))
    return convolved(along, {i - r: {0: w} for i, w in enumerate(weights)})


def sharpened(rows: DataFrame) -> DataFrame:
    """Rows sharpened, rounded to whole values from 0 to 255; halves, told to nine digits, to the even one."""
    return convolved(rows, SHARPEN).select("img", "y", F.transform("row", lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint(F.round(v, 9)))).cast("int")).alias("row"))


def blended(under: DataFrame, over: DataFrame, alpha: DataFrame) -> DataFrame:
    """(img, y, row): a painted image over another by a soft mask (rows from 0 to 1), cut to whole values."""
    both = under.join(over.select("img", "y", F.col("row").alias("over")), ["img", "y"]).join(alpha.select("img", "y", F.col("row").alias("alpha")), ["img", "y"])
    mixed = F.transform("row", lambda v, i: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.get("over", i) * F.get("alpha", i) + v * (1 - F.get("alpha", i))))).cast("int"))
    return both.select("img", "y", mixed.alias("row"))


def closed_rows(rows: DataFrame, size: int) -> DataFrame:
    """Masks' rows (img, y, row of 0 to 255) grown by an ellipse and shrunk again; what is outside takes no part."""
    inverse = lambda n: F.transform(n, lambda v: 255 - v)
    keyed = rows.withColumn("height", F.count("*").over(Window.partitionBy("img")).cast("int"))
    shape = {"row": ("row", raster.ellipse(size))}
    grown = raster.dilated(keyed.select("img", "height", "y", F.col("row").cast("array<int>").alias("row")), ["img", "height"], shape)
    back = raster.dilated(grown.select("img", "height", "y", inverse("row").alias("row")), ["img", "height"], shape)
    return back.select("img", "y", inverse("row").alias("row"))


def clipped(counts: np.ndarray, limit: int) -> np.ndarray:
    """A histogram cut at a limit; what was cut is spread evenly, its remainder over every so-manieth value."""
    over = int(np.maximum(0, counts - limit).sum())
    out = np.minimum(counts, limit) + over // 256
    rest = over % 256
    if rest:
        out[np.arange(rest) * max(1, 256 // rest)] += 1
    return out


def equalised(gray: np.ndarray, clip: float = 2.5, tiles: int = 8) -> np.ndarray:
    """Contrast by tiles: each tile's clipped histogram gives a table, a pixel mixes the four nearest tiles'.

    An image whose sides the tiles don't divide is mirrored at its right and lower border up to the next multiple (by a
    whole tile count on a side that is divided already)."""
    height, width = gray.shape
    full = gray
    if height % tiles or width % tiles:
        down, right = tiles - height % tiles, tiles - width % tiles
        turn = lambda n, more: [0] * (n + more) if n == 1 else [min(i % (2 * n - 2), 2 * n - 2 - i % (2 * n - 2)) for i in range(n + more)]
        full = gray[np.ix_(turn(height, down), turn(width, right))]
    th, tw = full.shape[0] // tiles, full.shape[1] // tiles
    blocks = full.reshape(tiles, th, tiles, tw).swapaxes(1, 2).reshape(tiles * tiles, -1)
    limit = max(1, int(clip * th * tw / 256))
    tables = np.stack([np.rint(np.cumsum(clipped(np.bincount(b, minlength=256), limit)) * (255 / (th * tw))) for b in blocks]).reshape(tiles, tiles, 256)

    def between(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place = np.arange(n) / size - 0.5
        low = np.floor(place).astype(int)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), place - low

    y1, y2, ya = between(height, th)
    x1, x2, xa = between(width, tw)
    table = lambda y, x: tables[y[:, None], x[None], gray]
    upper = table(y1, x1) * (1 - xa) + table(y1, x2) * xa
    lower = table(y2, x1) * (1 - xa) + table(y2, x2) * xa
    return np.clip(np.rint(upper * (1 - ya[:, None]) + lower * ya[:, None]), 0, 255).astype(np.int64)


def upright(gray: np.ndarray, dark: float = 130) -> np.ndarray:
    """Light background, dark text: inverted if the middle of the image is dark."""
    h, w = gray.shape
    inner = gray[h // 4 : 3 * h // 4, w // 4 : 3 * w // 4] if h >= 8 and w >= 8 else gray
    return 255 - gray if inner.mean() < dark else gray


def enhanced(pages: DataFrame, clip: float = 2.5, tiles: int = 8, sharpen: bool = True) -> DataFrame:
    """(img, y, row) of images (img, gray) as a reader of text gets them: inverted if dark, contrast by tiles,
    sharpened.  Null images and those without pixels give nothing; values are 0 to 255."""

    def rows_of(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                gray = batch["gray"][i]
                if gray.is_valid and len(gray.values):
                    held = image(gray.values).astype(np.int64)
                    if held.size:
                        out = equalised(upright(held), clip, tiles).astype(np.int32)
                        flat = pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1], out.ravel())
                        yield pa.record_batch([pa.array(np.full(len(out), batch["img"][i].as_py())), pa.array(np.arange(len(out), dtype=np.int32)), flat], ["img", "y", "row"])

    rows = pages.select("img", "gray").mapInArrow(rows_of, "img long, y int, row array<int>")
    return sharpened(rows) if sharpen else rows


def padded(rows: DataFrame, pad: int, value: int = 255) -> DataFrame:
    """Rows with a border of one value around each image."""
    edge = F.array_repeat(F.lit(value), pad)
    size = rows.groupBy("img").agg(F.max("y").alias("last"), F.max(F.size("row")).alias("width"))
    inner = rows.select("img", (F.col("y") + pad).cast("int").alias("y"), F.concat(edge, F.col("row").cast("array<int>"), edge).alias("row"))
    if not pad:
        return inner
    outside = F.concat(F.sequence(F.lit(0), F.lit(pad - 1)), F.sequence(F.col("last") + 1 + pad, F.col("last") + 2 * pad)).cast("array<int>")
    return inner.union(size.select("img", F.explode(outside).alias("y"), F.array_repeat(F.lit(value), F.col("width") + 2 * pad).alias("row")))
