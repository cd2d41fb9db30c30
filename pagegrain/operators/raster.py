"""Masks of pages from boxes' masks, and slices of tall images.

A mask is kept by rows, (page_id, y, row), row being an array of the page's width; rows that
are absent hold nothing.  A page's rows are spread over tasks but for windows over a page, which spill.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LIVE = 127


def ellipse(size: int) -> dict[int, int]:
    """How far an ellipse of an odd size reaches sideways in each of its rows."""
    r = size // 2
    return {dy: round(sqrt(r * r - dy * dy)) for dy in range(-r, r + 1)}


def square(size: int) -> dict[int, int]:
    r = size // 2
    return dict.fromkeys(range(-r, r + 1), r)


def _merged(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Arrays of equal length that share their keys, as their largest values; null where there is none."""
    listed = rows.groupBy(*keys).agg(*(F.collect_list(n).alias(n) for n in names))
    largest = lambda n: F.aggregate(n, F.array_repeat(F.lit(0), F.size(F.get(n, F.lit(0)))), lambda a, r: F.zip_with(a, r, lambda p, q: F.greatest(p, q)))
    return listed.select(*keys, *(F.when(F.size(n) > 0, largest(n)).alias(n) for n in names))


def pasted(boxes: DataFrame, margin: int = 8) -> DataFrame:
    """Boxes (page_id, width, height of the page, x1, y1, x2, y2, mask) as rows (page_id, height, y, row) of their pages' masks.

    Where boxes overlap the largest value counts.  A mask of another size than its box is
    stretched to it by nearest pixels; a box without one is a filled rectangle, wider by margin
    and with its ends included.  Boxes without an area, or off the page, give nothing."""
    own = (F.size("mask") > 0) & (F.size(F.get("mask", F.lit(0))) > 0)
    b = boxes.withColumn("own", F.coalesce(own, F.lit(False))).where("x2 > x1 and y2 > y1")
    more = F.when(F.col("own"), 0).otherwise(margin)
    low = lambda c: F.greatest(F.lit(0), F.col(c) - more).cast("int")
    high = lambda c, size: F.least(F.col(size), F.col(c) + F.when(F.col("own"), 0).otherwise(margin + 1)).cast("int")
    b = b.withColumns({"left": low("x1"), "top": low("y1"), "right": high("x2", "width"), "bottom": high("y2", "height")}).where("right > left and bottom > top")

    def nearest(at: Column, start: str, end: str, size: Column) -> Column:
        return F.floor((at - F.col(start)) * size / (F.col(end) - F.col(start))).cast("int")

    source = lambda y: F.when(F.col("own"), F.get("mask", nearest(y, "y1", "y2", F.size("mask"))))
    lines = F.transform(F.sequence("top", F.col("bottom") - 1), lambda y: F.struct(y.alias("y"), source(y).alias("line")))
    b = b.select("page_id", "width", "height", "x1", "x2", "left", "right", "own", F.explode(lines).alias("l")).select("*", "l.y", "l.line")
    value = lambda x: F.when(F.col("own"), F.get("line", nearest(x, "x1", "x2", F.size("line")))).otherwise(255).cast("int")
    middle = F.transform(F.sequence("left", F.col("right") - 1), value)
    row = F.concat(F.array_repeat(F.lit(0), F.col("left")), middle, F.array_repeat(F.lit(0), (F.col("width") - F.col("right")).cast("int")))
    return _merged(b.select("page_id", "height", "y", row.alias("row")), ["page_id", "height", "y"], ["row"])


def dilated(rows: DataFrame, keys: list[str], shapes: dict[str, tuple[str, dict[int, int]]], when: Column | None = None) -> DataFrame:
    """Several dilations of rows (keys with height, y, arrays) by one shuffle: name -> array and how far sideways
    it reaches for each row above and below.  Rows for which `when` doesn't hold stay as they are."""
    when = F.lit(True) if when is None else when
    x = lambda source: F.sequence(F.lit(0), F.size(source) - 1)

    def wide(source: str, r: int) -> Column:
        return F.transform(x(source), lambda i: F.array_max(F.slice(source, F.greatest(F.lit(1), i + 1 - r), F.least(i, F.lit(r)) + r + 1))) if r else F.col(source)

    needed = sorted({(source, r) for source, reach in shapes.values() for r in (0, *reach.values())})
    widened = F.create_map(*(p for source, r in needed for p in (F.lit(f"{source} {r}"), F.when(when | F.lit(r == 0), wide(source, r)))))

    def step(dy: int) -> Column:
        names = (F.when(when, F.lit(f"{source} {reach[dy]}") if dy in reach else F.lit(None)).when(F.lit(dy == 0), f"{source} 0").alias(name) for name, (source, reach) in shapes.items())
        return F.when(when | F.lit(dy == 0), F.struct((F.col("y") + dy).alias("y"), *names))

    steps = F.array_compact(F.array(*(step(dy) for dy in sorted({dy for _, reach in shapes.values() for dy in reach}))))
    moved = rows.select(*keys, widened.alias("widened"), F.explode(steps).alias("s")).where("s.y >= 0 and s.y < height")
    return _merged(moved.select(*keys, F.col("s.y").alias("y"), *(F.element_at("widened", F.col(f"s.{n}")).alias(n) for n in shapes)), [*keys, "y"], list(shapes))


def page_masks(boxes: DataFrame, gray: DataFrame, usual: int = 7, large: int = 9, busy: float = 18.0) -> DataFrame:
    """(page_id, y, row, wide) of each page's dilated mask; wide: whether the page took the large ellipse.

    gray: (page_id, y, gray), an array for each row of a page.  The mask of pasted boxes grows by
    the usual ellipse, or by the large one if the pixels around the grown mask deviate by more than
    busy.  A mask with no value above 127 stays as it is."""
    page, keys = Window.partitionBy("page_id"), ["page_id", "height", "live"]
    mask = pasted(boxes).withColumn("live", F.max(F.array_max("row")).over(page) > LIVE)
    grown = dilated(mask, keys, {"usual": ("row", ellipse(usual)), "large": ("row", ellipse(large))}, F.col("live"))
    around = dilated(grown, keys, {"usual": ("usual", {0: 0}), "large": ("large", {0: 0}), "outer": ("usual", square(3))}).join(gray, ["page_id", "y"], "left")
    ring = F.when(F.col("live"), F.filter("gray", lambda _, i: (F.get("outer", i) > LIVE) & (F.coalesce(F.get("usual", i), F.lit(0)) <= LIVE)))
    total = lambda power: F.sum(F.aggregate("ring", F.lit(0).cast("long"), lambda a, v: a + v * v if power == 2 else a + (v if power else 1))).over(page)
    sums = around.withColumn("ring", ring).withColumns({"n": total(0), "s": total(1), "q": total(2)})
    wide = F.coalesce(F.col("n") * F.col("q") - F.col("s") * F.col("s") > busy**2 * F.col("n") * F.col("n"), F.lit(False))
    return sums.select("page_id", "y", F.when(wide, F.col("large")).otherwise(F.col("usual")).alias("row"), wide.alias("wide")).where("row is not null")


def slices(images: DataFrame, cuts: DataFrame, prefix: Column, suffix: Column) -> DataFrame:
    """(img, place, top, bottom, name) of the parts into which an image (img, height) is cut at rows (img, cut);
    an image without cuts is one part, one whose height isn't known (it can't be decoded) passes whole, without bounds."""
    listed = cuts.groupBy("img").agg(F.array_sort(F.collect_set("cut")).alias("cuts"))
    inside = F.filter(F.coalesce("cuts", F.array().cast("array<long>")), lambda c: (c > 0) & (c < F.col("height")))
    ends = F.when(F.col("height").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.concat(inside, F.array(F.col("height").cast("long"))))
    named = images.join(listed, "img", "left").withColumns({"name": prefix, "suffix": suffix, "ends": ends})
    part = named.select("img", "name", "suffix", "ends", F.posexplode("ends").alias("place", "bottom"))
    top = F.when(F.col("bottom").isNotNull(), F.when(F.col("place") == 0, F.lit(0).cast("long")).otherwise(F.get("ends", F.col("place") - 1)))
    label = F.when(F.col("bottom").isNull(), F.concat("name", "suffix")).otherwise(F.concat("name", F.lit("_"), F.when(F.col("place") < 10, "0").otherwise(""), F.col("place").cast("string"), "suffix"))
    return part.select("img", "place", top.alias("top"), "bottom", label.alias("name"))
