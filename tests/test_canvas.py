"""Clicks, selections and tall boxes against plain Python that follows them one by one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagegrain.operators import canvas
from pagegrain.plans import canvas as plans
from pagegrain.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("part_ms", [350, 1000, 600_000])
def test_double_clicks(spark, part_ms):
    rng, rows, at = random.Random(3), [], 0
    for i in range(1500):
        at += rng.choice([0, 40, 100, 200, 349, 350, 2000] if i % 300 > 60 else [90, 120])
        rows.append((rng.choice("aab") if i % 300 > 60 else "a", i, at, rng.choice([0, 5, 19, 20, 40]) if i % 300 > 60 else 0, 0))
    rows += [("a", 9000, None, 1, 1), ("a", 9001, 5, None, 1), (None, 9002, 5, 1, 1), (None, 9003, 9, 1, 1)]
    want, last = {}, {}
    for key, i, t, x, y in sorted(rows, key=lambda r: (str(r[0]), -1 if r[2] is None else r[2], r[1])):
        held = last.get(key)
        double = bool(held and None not in (t, x, *held) and t - held[0] < 350 and (x - held[1]) ** 2 + (y - held[2]) ** 2 < 400)
        want[i] = double
        last[key] = None if double else (t, x, y)
    df = spark.createDataFrame(rows, "who string, event_id long, at long, x int, y int").repartition(7)
    got = {r.event_id: r.double for r in canvas.double_clicks(df, "who", part_ms=part_ms).collect()}
    assert got == want and 100 < sum(want.values())


def test_double_clicks_of_none(spark):
    empty = spark.createDataFrame([], "who string, event_id long, at long, x int, y int")
    assert canvas.double_clicks(empty, "who").count() == 0
    with pytest.raises(ValueError):
        canvas.double_clicks(empty, "who", part_ms=10)


def test_flood_select(spark):
    rng, px, clicks = random.Random(5), [], []
    images = {}
    for img in range(30):
        h, w = rng.randint(1, 14), rng.randint(1, 14)
        images[img] = {(y, x): (rng.choice([0, 20, 60]), rng.choice([0, 10])) for y in range(h) for x in range(w)}
        px += [(img, y, x, a, b) for (y, x), (a, b) in images[img].items()]
        clicks += [(img, c, rng.randrange(h), rng.randrange(w)) for c in range(3)] + [(img, 3, h, 0), (img, 4, None, 0)]
    want = {}
    for img, c, y, x in clicks:
        if y is None:
            continue
        image = images[img]
        found = [(y, x)] if (y, x) in image else []
        for a, b in found:
            found += [n for n in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)) if n in image and n not in found and all(abs(p - q) <= 22 for p, q in zip(image[n], image[y, x], strict=True))]
        refused = len(found) > int(len(image) * 0.5 + 0.5)
        want[img, c] = (refused, frozenset() if refused else frozenset(found))
    got = canvas.flood_select(spark.createDataFrame(px, "img long, y int, x int, r int, g int"), spark.createDataFrame(clicks, "img long, click long, y int, x int"), ("r", "g"), share=0.5)
    rows = got.collect()
    assert {(r.img, r.click): (r.refused, frozenset((k.y, x) for k in r.runs for x in range(k.x1, k.x2))) for r in rows} == want
    assert all(r.pixels == len(want[r.img, r.click][1]) for r in rows)
    assert {r for r, _ in want.values()} == {True, False}


def naive_lines(gray, box):
    x1, y1, x2, y2 = box
    crop = gray[y1:y2, x1:x2]
    back = np.percentile(crop, 90)
    spans, start = [], None
    for y in range(y2 - y1 + 1):
        dark = y < y2 - y1 and crop[y].mean() < back - 2
        if dark and start is None:
            start = y
        if not dark and start is not None:
            spans += [(start, y)] * (y - start >= 4)
            start = None
    if y2 - y1 <= 45 or len(spans) < 2:
        return [box]
    out = []
    for k, (a, b) in enumerate(spans):
        above = a - (spans[k - 1][1] if k else 0)
        below = (spans[k + 1][0] if k + 1 < len(spans) else y2 - y1) - b
        top, bottom = max(0, y1 + a - min(3, max(1, above // 2))), min(len(gray), y1 + b + min(3, max(1, below // 2)))
        means = [float(gray[top:bottom, x].mean()) for x in range(x1, x2)]
        text = [x for x, m in zip(range(x1, x2), means, strict=True) if m < np.percentile(means, 90) - 2]
        out.append((max(x1, min(text) - 10), top, min(x2, max(text) + 10), bottom) if text else (x1, top, x2, bottom))
    return out


def test_split_tall(spark):
    pages, boxes = plans.scans(spark, SF)
    images = {r.page_id: np.array(r.gray) for r in pages.collect()}
    listed = {(r.page_id, r.box_index): r for r in boxes.collect()}
    want = {}
    for (page, box), r in listed.items():
        for k, line in enumerate(naive_lines(images[page], (r.x1, r.y1, r.x2, r.y2))):
            x1, y1, x2, y2 = line
            cells = [(r.mask[y - r.y1][x - r.x1] if r.y1 <= y < r.y2 and r.x1 <= x < r.x2 else 0) if r.mask else 255 for y in range(y1, y2) for x in range(x1, x2)]
            want[page, box, k] = (*line, sum(cells))
    got = {tuple(r)[:3]: tuple(r)[3:] for r in QUERIES["tall_lines"](spark, SF).collect()}
    assert got == want and len(want) > len(listed)


def test_split_tall_without_boxes(spark):
    pages, boxes = plans.scans(spark, SF)
    assert canvas.split_tall(pages, boxes.where(F.lit(False))).count() == 0
    assert canvas.split_tall(pages.limit(0), boxes).count() == 0
