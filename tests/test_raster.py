"""Masks of pages and slices on empty, missing and odd input."""

from pyspark.sql import functions as F

from pagegrain.operators import raster

BOXES = "page_id long, width int, height int, x1 long, y1 long, x2 long, y2 long, mask array<array<int>>"
GRAY = "page_id long, y int, gray array<int>"


def test_masks_of_odd_boxes(spark):
    full = [[200] * 2] * 2
    boxes = spark.createDataFrame([(1, 30, 30, 10, 10, 12, 12, full), (1, 30, 30, 40, 40, 44, 44, full), (1, 30, 30, 5, 5, 5, 9, full), (2, 30, 30, 15, 15, 16, 16, []), (3, 30, 30, 15, 15, 16, 16, [[]]), (4, 30, 30, 3, 3, 5, 5, [[90, 0], [0, 90]])], BOXES)
    got = {}
    for r in raster.page_masks(boxes, spark.createDataFrame([], GRAY)).collect():
        assert not r.wide and len(r.row) == 30
        got.setdefault(r.page_id, {}).update({(r.y, x): v for x, v in enumerate(r.row) if v})
    around = {(y + dy, x + dx) for y in (10, 11) for x in (10, 11) for dy, reach in raster.ellipse(7).items() for dx in range(-reach, reach + 1)}
    assert set(got[1]) == around and set(got[1].values()) == {200}
    rectangle = {(y, x) for y in range(7, 25) for x in range(7, 25)}
    assert rectangle < set(got[2]) and got[2] == got[3]
    assert got[4] == {(3, 3): 90, (4, 4): 90}
    assert raster.page_masks(boxes.where("false"), spark.createDataFrame([], GRAY)).count() == 0


def test_slices(spark):
    images = spark.createDataFrame([(1, 3000), (2, 100), (3, None)], "img long, height long")
    cuts = spark.createDataFrame([(1, 1400), (1, 1400), (1, 2000), (1, 3000), (1, -5), (3, 10), (None, 7)], "img long, cut long")
    got = raster.slices(images, cuts, F.lit("p"), F.lit(".png")).orderBy("img", "place").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 1400, "p_00.png"), (1, 1, 1400, 2000, "p_01.png"), (1, 2, 2000, 3000, "p_02.png"), (2, 0, 0, 100, "p_00.png"), (3, 0, None, None, "p.png")]
