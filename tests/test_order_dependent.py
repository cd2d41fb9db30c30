"""Order-dependent operators against plain Python that is written anew, and sources on small files."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from pagegrain.functions import layout
from pagegrain.operators import bench, grouping, manifest, profile
from pagegrain.plans import grouped, views
from pagegrain.plans.queries import QUERIES
from pagegrain.sources import archive, fonts
from pagegrain.streaming.edits import changes, commits, debounce

SF = "/root/testdata/sf0.001"


def hull(rows):
    return min(r.x1 for r in rows), min(r.y1 for r in rows), max(r.x2 for r in rows), max(r.y2 for r in rows)


@pytest.fixture(scope="module")
def boxes(spark):
    pages = {}
    for r in views.box(spark, SF).orderBy("page_id", "box_index").collect():
        pages.setdefault(r.page_id, []).append(r)
    return pages


def naive_groups(rows):
    """Indices in groups of lines, recomputing every extent from the members."""
    mean = sum(r.y2 - r.y1 for r in rows) / len(rows)
    x1, y1, x2, y2 = hull(rows)
    if len(rows) <= 3 and y2 - y1 <= 4 * mean:
        return {frozenset(r.box_index for r in rows)}
    lines = []
    for r in sorted(rows, key=lambda r: (r.y1, r.x1, r.box_index)):
        fitting = [x for x in lines if (m := min(r.y2 - r.y1, hull(x)[3] - hull(x)[1])) > 0 and (min(r.y2, hull(x)[3]) - max(r.y1, hull(x)[1])) / m > 0.5]
        if fitting:
            fitting[0].append(r)
        else:
            lines.append([r])
    groups = []
    for line in sorted(lines, key=lambda x: hull(x)[1]):
        if groups and (h := hull(groups[-1] + line))[3] - h[1] <= 3 * mean:
            groups[-1] += line
        else:
            groups.append(list(line))
    return {frozenset(r.box_index for r in g) for g in groups}


def as_sets(rows, label):
    found = {}
    for r in rows:
        found.setdefault((r.page_id, r[label]), set()).add(r.box_index)
    return {(page, frozenset(s)) for (page, _), s in found.items()}


def test_line_groups(spark, boxes):
    want = {(p, g) for p, rows in boxes.items() if (texts := [r for r in rows if r.kind == "text"]) for g in naive_groups(texts)}
    assert as_sets(QUERIES["line_groups"](spark, SF).collect(), "line_group") == want


def test_capacity_clusters(spark, boxes):
    want = set()
    for page, rows in boxes.items():
        left = list(rows)
        while left:
            cluster = [left.pop(0)]
            while True:
                before = len(cluster)
                for r in list(left):
                    h = hull([*cluster, r])
                    near = any(max(r.x1 - m.x2, m.x1 - r.x2, r.y1 - m.y2, m.y1 - r.y2) <= 35 for m in cluster)
                    if near and h[2] - h[0] <= 250 and h[3] - h[1] <= 250:
                        cluster.append(r)
                        left.remove(r)
                if len(cluster) == before:
                    break
            want |= {(page, r.box_index, cluster[0].box_index) for r in cluster}
    assert {tuple(r) for r in QUERIES["capacity_clusters"](spark, SF).collect()} == want


def test_bubble_texts(spark, boxes):
    want = set()
    for page, rows in boxes.items():
        for b in (r for r in rows if r.kind == "bubble"):
            held = []
            for t in (r for r in rows if r.kind == "text"):
                share = max(0, min(t.x2, b.x2) - max(t.x1, b.x1)) * max(0, min(t.y2, b.y2) - max(t.y1, b.y1))
                if b.x1 <= (t.x1 + t.x2) / 2 <= b.x2 and b.y1 <= (t.y1 + t.y2) / 2 <= b.y2 or share >= 0.5 * (t.x2 - t.x1) * (t.y2 - t.y1):
                    held.append(t)
            for g in naive_groups(held) if held else ():
                members = [t for t in held if t.box_index in g]
                x1, y1, x2, y2 = hull(members)
                box = max(x1 - 24, b.x1 - 8), max(y1 - 10, b.y1 - 8), min(x2 + 24, b.x2 + 8), min(y2 + 10, b.y2 + 8)
                if box[2] > box[0] and box[3] > box[1]:
                    want.add((page, b.box_index, *box, max(t.confidence for t in members)))
    got = {(r.page_id, r.bubble_index, r.x1, r.y1, r.x2, r.y2, r.confidence) for r in QUERIES["bubble_texts"](spark, SF).collect()}
    assert got == want


def test_free_texts(spark, boxes):
    want = set()
    for page, rows in boxes.items():
        inside = lambda t, b: b.x1 <= (t.x1 + t.x2) / 2 <= b.x2 and b.y1 <= (t.y1 + t.y2) / 2 <= b.y2 or max(0, min(t.x2, b.x2) - max(t.x1, b.x1)) * max(0, min(t.y2, b.y2) - max(t.y1, b.y1)) >= 0.5 * (t.x2 - t.x1) * (t.y2 - t.y1)
        free = [t for t in rows if t.kind == "text" and not any(inside(t, b) for b in rows if b.kind == "bubble")]
        near = lambda a, b: max(a.x1 - b.x2, b.x1 - a.x2) <= 35 and (abs(a.y1 - b.y1) < 45 or abs(a.y2 - b.y2) < 45 or max(a.y1 - b.y2, b.y1 - a.y2) <= 40)
        while free:
            cluster, seen = [free.pop(0)], 0
            while seen < len(cluster):
                found = [t for t in free if near(t, cluster[seen])]
                free = [t for t in free if t not in found]
                cluster += found
                seen += 1
            for g in naive_groups(cluster):
                members = [t for t in cluster if t.box_index in g]
                (x1, y1, x2, y2), pad = hull(members), 6 if len(members) == 1 else 8
                x1, y1, x2, y2 = max(0, x1 - 20), max(0, y1 - pad), min(400, x2 + 20), min(600, y2 + pad)
                if x2 > x1 and y2 > y1 and (x2 - x1) * (y2 - y1) <= 0.35 * 400 * 600:
                    want.add((page, x1, y1, x2, y2, max(t.confidence for t in members)))
    got = {(r.page_id, r.x1, r.y1, r.x2, r.y2, r.confidence) for r in QUERIES["free_texts"](spark, SF).collect()}
    assert got == want


def test_mask_components(spark):
    pixels = {}
    for r in views.pixel(spark, SF).where("v > 127").collect():
        pixels.setdefault(r.img, set()).add((r.y, r.x))
    want = set()
    for img, left in pixels.items():
        label = {p: p for p in left}
        for _ in range(64):  # smallest pixel spreads over neighbours
            label = {(y, x): min(label[q] for i in (-1, 0, 1) for j in (-1, 0, 1) if (q := (y + i, x + j)) in label) for y, x in label}
        for number, first in enumerate(sorted(set(label.values()))):
            ys, xs = zip(*[p for p, f in label.items() if f == first], strict=True)
            want.add((img, number, len(ys), min(xs), min(ys), max(xs) + 1, max(ys) + 1))
    assert {tuple(r) for r in QUERIES["mask_components"](spark, SF).collect()} == want


def test_detect_is_free_of_overlaps(spark):
    rows = {}
    for r in QUERIES["detect"](spark, SF).collect():
        rows.setdefault(r.page_id, []).append(r)
    assert rows
    for held in rows.values():
        for i, a in enumerate(held):
            for b in held[:i]:
                both = max(0, min(a.x2, b.x2) - max(a.x1, b.x1)) * max(0, min(a.y2, b.y2) - max(a.y1, b.y1))
                assert both <= 0.35 * ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - both)
        assert all(r.confidence >= 0.05 and 0 < r.x2 - r.x1 <= 388 for r in held)


def naive_cuts(rows, target, search, least, wider, band):
    unsafe, height, cuts, at = {y for y, bad, _ in rows if bad}, len(rows), [], 0
    score = {y: s for y, _, s in rows}
    while height - at > target + least:
        aim = at + target
        for reach in (search, search + wider):
            low, high = max(at + least, aim - reach), min(height - least, aim + reach)
            safe = [y for y in range(max(0, low + band), min(height, high - band)) if all(0 <= z < height and z not in unsafe for z in range(y - band, y + band + 1))]
            if safe:
                break
        if not safe:
            break
        at = min(safe, key=lambda y: (abs(y - aim), score[y], y))
        cuts.append(at)
    return cuts


def test_cut_rows(spark):
    rows = {}
    for r in grouped.tall_rows(spark, SF).orderBy("img", "y").collect():
        rows.setdefault(r.img, []).append((r.y, r.unsafe, r.score))
    want = {(img, i, y) for img, held in rows.items() for i, y in enumerate(naive_cuts(held, 140, 18, 50, 80, 12))}
    assert {tuple(r) for r in profile.cut_rows(grouped.tall_rows(spark, SF), 140, 18, 50, 80).collect()} == want and len(want) > 20
    want = {(img, i, y) for img, held in rows.items() for i, y in enumerate(naive_cuts(held, 1400, 180, 500, 800, 12))}
    assert {tuple(r) for r in QUERIES["cut_rows"](spark, SF).collect()} == want and want
    low = spark.createDataFrame([(1, y, False, 0.0) for y in range(50)], "img long, y int, unsafe boolean, score double")
    assert profile.cut_rows(low).count() == 0


def test_candidates_of_cuts_are_no_objects(spark):
    text = QUERIES["cut_rows"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "MapInPandas" not in text
    rows = [(img, y, y % (31 + img) == 7, float(y * 37 % 11) if y % 5 else 2.0) for img in range(3) for y in range(3000 - 400 * img)]
    want = {(img, i, y) for img in range(3) for i, y in enumerate(naive_cuts([r[1:] for r in rows if r[0] == img], 140, 18, 50, 80, 3))}
    df = spark.createDataFrame(rows, "img long, y int, unsafe boolean, score double").repartition(3)
    assert {tuple(r) for r in profile.cut_rows(df, 140, 18, 50, 80, 3).collect()} == want and len(want) > 20
    unknown = df.where("img = 0").withColumn("score", F.when(F.col("y") % 2 == 0, F.col("score")))  # an unknown score is the last of a tie
    assert {tuple(r)[:2] for r in profile.cut_rows(unknown, 140, 18, 50, 80, 3).collect()} == {w[:2] for w in want if w[0] == 0}


def test_wrap_and_fit():
    assert layout.wrap("aa bb\n\nccc", 10, 30) == ["aa bb", "", "ccc"]
    assert layout.wrap("aa bbbbbbb c", 10, 18) == ["aa", "bbb", "bbb", "b c"]
    assert layout.wrap("x yy", 10, 1) == ["x", "y", "y"]
    assert layout.wrap("", 10, 30) == []
    draw = random.Random(5)
    for _ in range(200):
        text = " ".join("x" * draw.randint(1, 9) for _ in range(draw.randint(1, 8)))
        w, h = draw.randint(10, 200), draw.randint(10, 200)
        size, lines = layout.fit(text, w, h)
        fits = lambda s, text=text, w=w, h=h: (x := layout.wrap(text, s, w)) and len(x) * layout.line_height(s, 2) <= h and max(map(len, x)) * 0.6 * s <= w
        assert lines == layout.wrap(text, size, w)
        assert size == 6 or fits(size)
        assert "".join(lines).replace(" ", "") == text.replace(" ", "")


def test_fit_in_spark(spark):
    rows = spark.createDataFrame([(1, "one two", 60, 60), (2, None, 60, 60)], "page_id long, text string, width int, height int")
    want = {(1, layout.fit("one two", 60, 60)[0], len(layout.fit("one two", 60, 60)[1])), (2, 6, 0)}
    assert {tuple(r) for r in layout.fitted(rows, "page_id").collect()} == want


def packed(names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in names:
            z.writestr(name, data)
    return out.getvalue()


def test_archive_limits(spark, tmp_path):
    first = packed([("b/10.png", b"x" * 30), ("b/2.png", b"y" * 5), ("__MACOSX/3.png", b"z"), (".h.png", b"z"), ("n.txt", b"z"), ("b/0.png", b""), ("b/7.png", b"w" * 200)])
    folder = tmp_path / "abcdef01"
    folder.mkdir()
    (folder / "a").write_bytes(first)  # an archive without the suffix
    (folder / "b.zip").write_bytes(b"broken")
    (folder / "c.png").write_bytes(b"q" * 40)
    (folder / "d.cbz").write_bytes(packed([("1.png", b"r" * 10)]))
    held = archive.uploads(spark, str(tmp_path))
    got = lambda **k: [(r.page, r.name, len(r.content)) for r in archive.pages(held, **k).orderBy("page").collect()]
    assert got() == [(0, "2.png", 5), (1, "7.png", 200), (2, "10.png", 30), (3, "c.png", 40), (4, "1.png", 10)]
    assert got(entry=100) == [(0, "2.png", 5), (1, "10.png", 30), (2, "c.png", 40), (3, "1.png", 10)]
    assert got(entry=100, total=50) == [(0, "2.png", 5), (1, "10.png", 30)]  # the loose file ends all
    assert got(total=60) == [(0, "2.png", 5), (1, "c.png", 40), (2, "1.png", 10)]  # the large entry ends its archive only
    assert got(files=2) == [(0, "2.png", 5), (1, "7.png", 200)]


def test_fonts(spark):
    listing = spark.createDataFrame([("Wide-face.TTF",), ("a_b.ttf",), ("A_B.ttf",), ("x.otf",)], "name string")
    assert {tuple(r) for r in fonts.catalogue(listing).collect()} == {("default", "Default"), ("Wide-face", "Wide Face"), ("A_B", "A B")}
    asked = spark.createDataFrame([("a_b",), ("a_b.ttf",), ("WIDE-FACE",), ("../a_b",), ("none",), ("",)], "font string")
    got = {r.font: r.file for r in fonts.resolve(asked, listing, "base.ttf").collect()}
    assert got == {"a_b": "a_b.ttf", "a_b.ttf": "a_b.ttf", "WIDE-FACE": "Wide-face.TTF", "../a_b": "base.ttf", "none": "base.ttf", "": "base.ttf"}


def test_changes_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "event_id")
    half = events.orderBy("ts").limit(events.count() // 2).agg({"ts": "max"}).first()[0]
    src = str(tmp_path / "in")
    events.where(F.col("ts") <= F.lit(half)).coalesce(1).write.parquet(src)
    run = lambda: changes(spark.readStream.schema(events.schema).parquet(src)).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    run()
    events.where(F.col("ts") > F.lit(half)).coalesce(1).write.mode("append").parquet(src)
    run()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("user_id", "event_id", "event_type").collect())
    assert got == sorted(tuple(r) for r in manifest.changes_only(events, "user_id", "event_type").collect())


def test_commits(spark):
    log = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (1, 3, 1), (1, 4, 5), (1, 5, 2), (2, 6, 1)], "user_id long, event_id long, read int")
    got = {r.event_id: (r.version, r.applied) for r in commits(log).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (2, True), 4: (2, False), 5: (3, True), 6: (0, False)}


def test_debounce_gap(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00.000", 1.0, 1), (1, "2024-01-01 00:00:00.299", 2.0, 2), (1, "2024-01-01 00:00:00.599", 3.0, 3)], "user_id long, ts string, value double, event_id long")
    assert sorted((r.value, r.n) for r in debounce(rows, gap_ms=300).collect()) == [(2.0, 2), (3.0, 1)]


def test_compare_notes_other_workloads_and_images(spark):
    cols = "case_id string, p50_ms double, calls long, mean_calls double, workload string, psnr double, ssim double, mae double"
    a = spark.createDataFrame([(c, 100.0, 1, 1.0, "w", 100.0, 1.0, 0.0) for c in "abcde"], cols)
    b = spark.createDataFrame([("a", 105.0, 1, 1.0, "w", 99.0, 0.99, 0.5), ("b", 90.0, 1, 1.0, "other", 99.0, 1.0, 0.0), ("c", 90.0, 1, 1.0, "w", 97.9, 1.0, 0.0), ("d", 90.0, None, 1.5, "w", 99.0, 1.0, 0.0), ("f", 90.0, 1, 1.0, "w", 99.0, 1.0, 0.0)], cols)
    got = {r.case_id: r.status for r in bench.compare(a, b).collect()}
    assert got == {"a": "ok", "b": "incompatible", "c": "regression", "d": "regression", "e": "incompatible", "f": "incompatible"}


def test_empty_tables(spark):
    none = views.box(spark, SF).where("false")
    assert grouping.detect(none, 400, 600).count() == grouping.capacity_clusters(none).count() == grouping.line_groups(none).count() == 0


def test_chapters_round_trip(spark, tmp_path):
    import json

    from pagegrain.sources import chapters

    page = {"original": "a.png", "boxes": [{"x1": 1, "y1": 2, "x2": 3, "y2": 4, "confidence": 1.0, "mask": None}]}
    rows = [("0a1b2c3d", json.dumps({"chapter_id": "0a1b2c3d", "source_url": "u", "pages": [page, page]})), ("ffffffff", '{"pages": ['), ("00000000", '{"pages": []}'), ("11111111", None)]
    written = spark.createDataFrame(rows, "chapter_id string, manifest string")
    chapters.write_all(written, str(tmp_path))
    chapters.write_all(written.where("chapter_id = '0a1b2c3d'"), str(tmp_path))
    assert sorted(p.name for p in (tmp_path / "0a1b2c3d").iterdir() if not p.name.endswith(".crc")) == ["manifest.json"]
    found = chapters.summaries(chapters.scan(spark, str(tmp_path))).drop("updated").collect()
    assert [tuple(r) for r in found] == [("0a1b2c3d", "u", 2, "preview", 0)]
    one = chapters.read_one(spark, str(tmp_path), "0a1b2c3d").first()
    assert one.pages[1].boxes[0].x2 == 3 and one.workflow is None
    with pytest.raises(ValueError):
        chapters.read_one(spark, str(tmp_path), "../../etc")
    with pytest.raises(ValueError):
        chapters.write_all(written.withColumn("chapter_id", F.lit("x")), str(tmp_path))


def test_digest_tells_states_apart(spark):
    from pagegrain.operators import manifest

    rows = [(1, "a|b", "c"), (2, "a", "b|c"), (3, None, "c"), (4, "~", "c"), (5, "null", "c")]
    states = manifest.fingerprint(spark.createDataFrame(rows, "id int, a string, b string"), "id", ["a", "b"]).collect()
    assert len({r.state for r in states}) == 5


def test_natural_order(spark):
    from pagegrain.functions import scalars

    names = ["x2", "x10", "X1", "x007", "10", "9", "x" + "9" * 30, "x1" + "0" * 30]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(scalars.natural_key(F.col("n"))).collect()]
    assert got == ["9", "10", "X1", "x2", "x007", "x10", "x" + "9" * 30, "x1" + "0" * 30]
