"""Whole detection, tall boxes by rows, passes, and guarded commits against plain Python."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagegrain.operators import canvas, grouping, profile, spatial
from pagegrain.plans import canvas as canvas_plans
from pagegrain.plans import detection
from pagegrain.streaming.guarded import Guarded, digest

SF = "/root/testdata/sf0.001"


def groups_of_lines(boxes):
    mean = sum(b[3] - b[1] for b in boxes) / len(boxes)
    if len(boxes) <= 3 and max(b[3] for b in boxes) - min(b[1] for b in boxes) <= 4 * mean:
        return [boxes]
    lines = []
    for b in sorted(boxes, key=lambda b: (b[1], b[0])):
        for line in lines:
            top, bottom = min(x[1] for x in line), max(x[3] for x in line)
            low = min(b[3] - b[1], bottom - top)
            if low > 0 and (min(b[3], bottom) - max(b[1], top)) / low > 0.5:
                line.append(b)
                break
        else:
            lines.append([b])
    lines.sort(key=lambda line: min(b[1] for b in line))
    out = []
    for line in lines:
        if out and max(b[3] for b in out[-1] + line) - min(b[1] for b in out[-1] + line) <= 3 * mean:
            out[-1] = out[-1] + line
        else:
            out.append(list(line))
    return out


def inside(t, b):
    x, y = (t[0] + t[2]) / 2, (t[1] + t[3]) / 2
    if b[0] <= x <= b[2] and b[1] <= y <= b[3]:
        return True
    both = max(0, min(t[2], b[2]) - max(t[0], b[0])) * max(0, min(t[3], b[3]) - max(t[1], b[1]))
    return both > 0 and both / ((t[2] - t[0]) * (t[3] - t[1])) >= 0.5


def near(a, b):
    gap = lambda lo, hi: max(a[lo] - b[hi], b[lo] - a[hi], 0)
    return gap(0, 2) <= 35 and (abs(a[1] - b[1]) < 45 or abs(a[3] - b[3]) < 45 or gap(1, 3) <= 40)


def hull(group):
    return min(b[0] for b in group), min(b[1] for b in group), max(b[2] for b in group), max(b[3] for b in group), max(b[4] for b in group)


def lines_of(box, gray):
    """A tall box's lines, pixel by pixel."""
    x1, y1, x2, y2, c = box
    crop = gray[y1:y2, x1:x2]
    if y2 - y1 <= 45 or not crop.size:
        return [box]
    dark = [row.mean() < np.percentile(crop, 90) - 2 for row in crop]
    found, y = [], 0
    for is_dark, run in itertools.groupby(dark):
        n = len(list(run))
        if is_dark and n >= 4:
            found.append((y, y + n))
        y += n
    if len(found) < 2:
        return [box]
    out = []
    for k, (a, b) in enumerate(found):
        before, after = found[k - 1][1] if k else 0, found[k + 1][0] if k + 1 < len(found) else y2 - y1
        top, bottom = max(0, y1 + a - min(3, max(1, (a - before) // 2))), min(len(gray), y1 + b + min(3, max(1, (after - b) // 2)))
        means = gray[top:bottom, x1:x2].mean(0)
        text = [i for i, m in enumerate(means) if m < np.percentile(means, 90) - 2]
        left, right = (max(x1, x1 + text[0] - 10), min(x2, x1 + text[-1] + 10)) if text else (x1, x2)
        out.append((left, top, right, bottom, c))
    return out


def suppressed(boxes, limit):
    kept = []
    for b in sorted(boxes, key=lambda b: (-b[4], *b[:4])):
        size = (b[2] - b[0]) * (b[3] - b[1])
        for k in kept:
            both = max(0, min(b[2], k[2]) - max(b[0], k[0])) * max(0, min(b[3], k[3]) - max(b[1], k[1]))
            if both > limit * (size + (k[2] - k[0]) * (k[3] - k[1]) - both):
                break
        else:
            kept.append(b)
    return kept


def detected(boxes, gray, w, h):
    texts, bubbles = [b[1:] for b in boxes if b[0] == "text"], [b[1:] for b in boxes if b[0] == "bubble"]
    found, used = [], set()
    for b in bubbles:
        own = [t for t in texts if inside(t, b)]
        used |= set(own)
        for g in groups_of_lines(own) if own else []:
            x = hull(g)
            found.append((max(b[0] - 8, x[0] - 24), max(b[1] - 8, x[1] - 10), min(b[2] + 8, x[2] + 24), min(b[3] + 8, x[3] + 10), x[4]))
    left = [t for t in texts if t not in used]
    while left:
        cluster = [left.pop(0)]
        for c in cluster:
            close = [t for t in left if near(c, t)]
            cluster += close
            left = [t for t in left if t not in close]
        for g in groups_of_lines(sorted(cluster, key=texts.index)):
            x, pad = hull(g), 6 if len(g) == 1 else 8
            x = max(0, x[0] - 20), max(0, x[1] - pad), min(w, x[2] + 20), min(h, x[3] + pad), x[4]
            if (x[2] - x[0]) * (x[3] - x[1]) <= 0.35 * w * h:
                found.append(x)
    valid = lambda b: 0 < b[2] - b[0] <= 0.97 * w and 0 < b[3] - b[1] and (b[2] - b[0]) * (b[3] - b[1]) <= 0.35 * w * h and b[2] - b[0] <= 25 * (b[3] - b[1]) and b[3] - b[1] <= 25 * (b[2] - b[0]) and b[4] >= 0.05
    found = {b for b in found if valid(b)}
    return set(suppressed({line for b in found for line in lines_of(b, gray)}, 0.35))


def test_detect_with_lines(spark):
    pages = detection.page_rows(spark, SF).where("page_id % 11 = 0")
    boxes = detection.page_boxes(spark, SF).where("page_id % 11 = 0")
    got, want, split = {}, {}, 0
    for r in grouping.detect(boxes, detection.WIDE, detection.HIGH, rows=pages.repartition(3)).collect():
        got.setdefault(r.page_id, set()).add((r.x1, r.y1, r.x2, r.y2, r.confidence))
    gray, listed = {}, {}
    for r in pages.orderBy("page_id", "y").collect():
        gray.setdefault(r.page_id, []).append(r.row)
    for r in boxes.orderBy("page_id", "box_index").collect():
        listed.setdefault(r.page_id, []).append((r.kind, r.x1, r.y1, r.x2, r.y2, r.confidence))
    for page, own in listed.items():
        want[page] = detected(own, np.array(gray[page]), detection.WIDE, detection.HIGH)
        split += len(want[page])
    assert got == want and split > 3 * len(want)


def test_tall_boxes_by_rows_equal_those_by_pages(spark):
    pages, boxes = canvas_plans.scans(spark, SF)
    rows = pages.select("page_id", F.posexplode("gray").alias("y", "row"))
    corners = ["page_id", "box_index", "line", "x1", "y1", "x2", "y2"]
    want = {tuple(r) for r in canvas.split_tall(pages, boxes).select(*corners).collect()}
    assert {tuple(r) for r in canvas.split_rows(rows, boxes, bucket=7).collect()} == want
    assert {tuple(r) for r in canvas.split_rows(rows.where("false"), boxes).select("page_id", "box_index", "line").collect()} == {(r.page_id, r.box_index, 0) for r in boxes.collect()}


def test_passes_merged(spark):
    listed = {}
    for r in spatial.mapped_back(detection.passes(spark, SF), 400, 600).collect():
        listed.setdefault(r.page_id, []).append(((-r.confidence, ("plain", "flipped", "small").index(r["pass"]), r.box_index), (r.x1, r.y1, r.x2, r.y2)))
    want = set()
    for page, boxes in listed.items():
        kept = []
        for key, b in sorted(boxes):
            for _, k in kept:
                both = max(0, min(b[2], k[2]) - max(b[0], k[0])) * max(0, min(b[3], k[3]) - max(b[1], k[1]))
                if both > 0.3 * ((b[2] - b[0]) * (b[3] - b[1]) + (k[2] - k[0]) * (k[3] - k[1]) - both):
                    break
            else:
                kept.append((key, b))
        want |= {(page, key[2]) for key, _ in kept}
    assert {(r.page_id, r.box_index) for r in spatial.passes_merged(detection.passes(spark, SF), 400, 600).collect()} == want


def test_line_runs_and_cuts_of_nothing(spark):
    assert profile.line_runs(spark.createDataFrame([(1, 0, [])], "img long, y int, row array<int>")).count() == 0
    assert profile.safe_cut(spark.createDataFrame([(1, 0, False, 1.0)], "img long, y int, unsafe boolean, score double")).first().cut is None


# commits behind a guard: a page's state, an edit that comes while work on the page runs, and that work's result
STATE = ["boxes", "mask", "excluded", "skipped", "clean"]
A, B, C = "10 10 40 40", "50 50 80 80", "90 90 120 120"
START = ("|".join((A, B, C)), None, "", False, None)
SCENARIOS = {
    "one box deleted": ("|".join((B, C)), None, "", False, None),
    "another one deleted": (C, None, "", False, None),
    "repainted": (START[0], "10 10 50 50", "", False, None),
    "box added": ("|".join((A, B, C, "50 50 100 100")), None, "", False, None),
    "box moved": ("|".join(("20 20 80 80", B, C)), None, "", False, None),
    "mask reset": (START[0], "", "", False, None),
    "skipped": ("", None, "", True, None),
    "excluded": ("", None, "60 60 120 120", False, None),
    "no contention": None,
}
ROW = "page_id long, seq long, seen string, boxes string, mask string, excluded string, skipped boolean, clean string"


def seen_of(spark, state):
    return spark.createDataFrame([state], "boxes string, mask string, excluded string, skipped boolean, clean string").select(digest(STATE).alias("d")).first().d


def test_guarded_commits(spark, tmp_path):
    base = spark.createDataFrame([(i, *START) for i in range(len(SCENARIOS))], "page_id long, boxes string, mask string, excluded string, skipped boolean, clean string").coalesce(1)
    sink = Guarded(base, str(tmp_path / "sink"), "page_id", STATE)
    before = seen_of(spark, START)
    edits = [(i, 1, before, *state) for i, state in enumerate(SCENARIOS.values()) if state]
    work = [(i, 2, before, *START[:4], "clean.png") for i in range(len(SCENARIOS))] + [(99, 3, before, *START), (None, 4, before, *START)]
    batches = [spark.createDataFrame(x, ROW).coalesce(1) for x in (edits, work)]
    for n, rows in enumerate(batches):
        for _ in range(2):  # each batch twice
            sink(rows, n)
    now = {r.page_id: tuple(r)[1:] for r in sink.current(spark).collect()}
    want = {i: state or (*START[:4], "clean.png") for i, state in enumerate(SCENARIOS.values())}
    assert now == want
    refused = {(r.page_id, r.reason) for r in sink.refused(spark).collect()}
    assert refused == {(i, "changed") for i, state in enumerate(SCENARIOS.values()) if state} | {(99, "unknown"), (None, "unknown")}
    sink(batches[0], 0)  # an old batch again, after a later one
    assert {r.page_id: tuple(r)[1:] for r in sink.current(spark).collect()} == want


def test_guarded_stream(spark, tmp_path):
    """Attempts of one page in order: each that has seen the one before is committed, across batches and within one."""
    base = spark.createDataFrame([(1, 0)], "page_id long, v long").coalesce(1)
    of = lambda v: spark.createDataFrame([(v,)], "v long").select(digest(["v"]).alias("d")).first().d
    steps = [(1, 1, of(0), 5), (1, 2, of(0), 6), (1, 3, of(5), 7), (1, 4, of(7), 8), (1, 5, of(5), 9), (1, 6, of(8), 10)]
    schema = "page_id long, seq long, seen string, v long"
    src = str(tmp_path / "in")
    for i in range(0, 6, 2):
        spark.createDataFrame(steps[i : i + 2], schema).coalesce(1).write.mode("append").parquet(src)
    sink = Guarded(base, str(tmp_path / "sink"), "page_id", ["v"])
    q = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "at")).start()
    q.processAllAvailable()
    q.stop()
    assert sink.current(spark).first().v == 10
    assert {r.seq for r in sink.refused(spark).collect()} == {2, 5}


def test_a_page_from_candidates_to_its_plan(spark):
    """The composition's steps, against detection and exclusions one by one, and the plan against the same parts taken by hand."""
    from pagegrain.operators import fill, processing
    from pagegrain.plans import processing as plans

    some = "page_id % 17 = 3"
    rows, boxes, outside = (t(spark, SF).where(some) for t in (detection.page_rows, detection.page_boxes, plans.excluded))
    found = processing.found_boxes(rows, boxes, outside, detection.WIDE, detection.HIGH)
    listed, gray = {}, {}
    for r in boxes.orderBy("page_id", "box_index").collect():
        listed.setdefault(r.page_id, []).append((r.kind, r.x1, r.y1, r.x2, r.y2, r.confidence))
    for r in rows.orderBy("page_id", "y").collect():
        gray.setdefault(r.page_id, []).append(r.row)
    out = {r.page_id: (min(r.ax, r.bx), max(r.ax, r.bx), min(r.ay, r.cy), max(r.ay, r.cy)) for r in outside.collect()}
    want = {}
    for page, own in listed.items():
        for b in detected(own, np.array(gray[page]), detection.WIDE, detection.HIGH):
            a = out[page]
            if not (a[0] <= (b[0] + b[2]) / 2 <= a[1] and a[2] <= (b[1] + b[3]) / 2 <= a[3]):
                want.setdefault(page, set()).add(b)
    got = {}
    for r in found.collect():
        got.setdefault(r.page_id, {})[r.box_index] = (r.x1, r.y1, r.x2, r.y2, r.confidence)
    assert {p: set(x.values()) for p, x in got.items()} == want and sum(map(len, want.values())) < sum(len(detected(o, np.array(gray[p]), detection.WIDE, detection.HIGH)) for p, o in listed.items())
    plan = {}
    for r in processing.page_plan(rows.repartition(3), found).collect():
        plan.setdefault(r.img, []).append((r.part, tuple(r.boxes), r.pixels, r.route, r.value))
    for page, own in got.items():
        g = np.array(gray[page])
        parts = fill.box_parts(g, [{"box_index": i, "x1": b[0], "y1": b[1], "x2": b[2], "y2": b[3], "mask": None} for i, b in own.items()])
        assert sorted(plan.get(page, [])) == [(p[0], tuple(p[1]), p[6], p[7], p[8]) for p in fill.filled(g, parts)[0]]
        assert sorted(i for p in plan.get(page, []) for i in p[1]) == sorted(own) or any(len(p[1]) > 1 for p in plan.get(page, []))


def test_second_pass(spark):
    from pagegrain.operators import fill

    g = np.full((60, 60), 250)
    boxes = [(0, 10, 10, 20, 20, None, False), (1, 40, 40, 50, 50, None, True)]
    manual = np.zeros((30, 30), int)
    manual[25, 25], manual[2, 2] = 11, 10
    schema = "img long, gray array<array<int>>, boxes array<struct<box_index: int, x1: int, y1: int, x2: int, y2: int, mask: array<array<int>>, removed: boolean>>, manual array<array<int>>"
    rows = spark.createDataFrame([(1, g.tolist(), boxes, manual.tolist()), (2, g.tolist(), None, None)], schema)
    got = sorted((r.img, r.part, tuple(r.boxes), r.route, r.value) for r in fill.second_plan(rows).collect())
    assert got == [(1, 0, (0,), "white", 250), (1, 1, (), "white", 250)]
    nine = {d: round((16 - d * d) ** 0.5) for d in range(-4, 5)}
    spot = {(y + dy, x + dx) for y in (50, 51) for x in (50, 51) for dy, r in nine.items() for dx in range(-r, r + 1) if y + dy < 60 and x + dx < 60}
    assert {r.part: r.pixels for r in fill.second_plan(rows).collect()}[1] == len(spot)


def test_files_are_written_whole(spark, tmp_path):
    from pagegrain.sources.output import write_files

    folder = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"c{i % 3}/page_{i:03d}.png", bytes([i] * i)) for i in range(20)] + [("c0/none", None)], "path string, content binary")
    for _ in range(2):
        write_files(rows.repartition(4), folder)
    found = {str(p.relative_to(folder)): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found == {r.path: bytes(r.content or b"") for r in rows.collect()}
    with pytest.raises(Exception, match="outside"):
        write_files(spark.createDataFrame([("../x", b"1")], "path string, content binary"), folder)


def test_region_changes(spark):
    from pagegrain.functions import editor

    rows = [((5, 5, 30, 30), (400, 600), (5, 5, 30, 30), None), ((-1, 5, 30, 30), (400, 600), None, "negative"), ((30, 5, 5, 30), (400, 600), None, "reversed"), ((395, 5, 900, 30), (400, 600), None, "too small"), ((395, 5, 900, 30), (None, 600), (395, 5, 900, 30), None), ((390, 590, 900, 900), (400, 600), (390, 590, 400, 600), None), ((1, 1, None, 9), (400, 600), None, "invalid"), ((5, 5, 14, 30), (400, 600), None, "too small")]
    df = spark.createDataFrame([(i, *r, *s) for i, (r, s, _, _) in enumerate(rows)], "i int, x1 int, y1 int, x2 int, y2 int, w int, h int")
    corners, refused = editor.region_change(*(F.col(c) for c in ("x1", "y1", "x2", "y2", "w", "h")))
    got = df.select("i", *(c.alias(f"n{n}") for n, c in corners.items()), refused.alias("refused")).orderBy("i").collect()
    assert [(None if r.nx1 is None else (r.nx1, r.ny1, r.nx2, r.ny2), r.refused) for r in got] == [(w, e) for _, _, w, e in rows]
