"""Image files, tall pages, contrast, fills, masks, addresses and guarded commits against plain Python."""

import base64
import io
import ipaddress
import math
import random
import re
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagegrain.functions import addresses
from pagegrain.operators import content, enhance, fill, prototypes
from pagegrain.sources import archive, corpus, images, masks


# image files
def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png_file(w=7, h=5, depth=8, colour=0, lines=b"", laced=0, more=()):
    return masks.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, laced)) + b"".join(chunk(*m) for m in more) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


JPEG = bytes.fromhex("FFD8 FFE0 0004 4A46 FFFF C4 0004 0000 FFC2 000B 08 0123 0456 01 011100 FFDA 0004 0102 0011 22FF 0033 FFD9".replace(" ", ""))
VP8 = b"\x00\x00\x00\x9d\x01\x2a" + struct.pack("<HH", 640 | 1 << 14, 480)
VP8L = b"\x2f" + struct.pack("<I", 99 | 199 << 14) + b"\0" * 5


def riff(kind, body, lie=0):
    inner = b"WEBP" + kind + struct.pack("<I", len(body) + lie) + body
    return b"RIFF" + struct.pack("<I", len(inner)) + inner


def bmp_file(w, h, depth=24, lack=0):
    size = (w * depth + 31) // 32 * 4 * abs(h)
    return b"BM" + struct.pack("<IHHI", 54 + size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, depth, 0, size, 0, 0, 0, 0) + b"\0" * (size - lack)


GOOD = png_file(300, 200, lines=b"x")
CASES = [
    (GOOD, ("PNG", 300, 200, None)), (GOOD[:-1], ("PNG", None, None, "cut")), (GOOD[:40] + b"?" + GOOD[41:], ("PNG", None, None, "checksum")),
    (png_file(0, 9), ("PNG", None, None, "no area")), (png_file(depth=3), ("PNG", None, None, "header")), (masks.SIGNATURE + chunk(b"IDAT", b""), ("PNG", None, None, "header")),
    (masks.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IEND", b""), ("PNG", None, None, "no pixels")),
    (JPEG, ("JPEG", 0x456, 0x123, None)), (JPEG[:-2], ("JPEG", None, None, "cut")), (JPEG[:12], ("JPEG", None, None, "cut")), (b"\xff\xd8\xff\xd9\0\0", ("JPEG", None, None, "no pixels")), (b"\xff\xd8abcdef", ("JPEG", None, None, "header")),
    (riff(b"VP8 ", VP8 + b"\0" * 9), ("WEBP", 640, 480, None)), (riff(b"VP8L", VP8L), ("WEBP", 100, 200, None)), (riff(b"VP8X", b"\0" * 4 + b"\x0f\0\0\x1f\0\0"), ("WEBP", 16, 32, None)),
    (riff(b"VP8L", VP8L, lie=50), ("WEBP", None, None, "cut")), (riff(b"VP8L", b"?" + VP8L[1:]), ("WEBP", None, None, "header")), (b"RIFF\0\0\0\0WAVE", (None, None, None, "unknown format")),
    (bmp_file(10, -20), ("BMP", 10, 20, None)), (bmp_file(10, 20, lack=1), ("BMP", None, None, "cut")), (bmp_file(10, 0), ("BMP", None, None, "no area")), (b"BM", ("BMP", None, None, "cut")),
    (b"GIF89a", ("GIF", None, None, None)), (b"", (None, None, None, "unknown format")), (b"text", (None, None, None, "unknown format")), (None, (None, None, None, "unknown format")),
]


def test_image_facts(spark):
    rows = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(CASES)], "k int, content binary")
    assert {r.k: tuple(r.image) for r in images.image_facts(rows).collect()} == {i: want for i, (_, want) in enumerate(CASES)}
    got = {r.k: r.refused for r in images.checked_uploads(rows, "k", most_bytes=700, most_pixels=50_000).collect()}
    for i, (d, (form, w, h, broken)) in enumerate(CASES):
        want = "empty" if not d else "too large" if len(d) > 700 else "no image" if form is None or broken else "format" if form == "GIF" else "too many pixels" if w * h > 50_000 else None
        assert got[i] == want


# tall pages
def naive_edges(g, low, high):
    h, w = len(g), len(g[0])
    at = lambda y, x: int(g[min(max(y, 0), h - 1)][min(max(x, 0), w - 1)])
    dx = [[sum(k * (at(y + d, x + 1) - at(y + d, x - 1)) for d, k in ((-1, 1), (0, 2), (1, 1))) for x in range(w)] for y in range(h)]
    dy = [[sum(k * (at(y + 1, x + d) - at(y - 1, x + d)) for d, k in ((-1, 1), (0, 2), (1, 1))) for x in range(w)] for y in range(h)]
    m = lambda y, x: abs(dx[y][x]) + abs(dy[y][x]) if 0 <= y < h and 0 <= x < w else 0
    weak, strong = set(), set()
    for y in range(h):
        for x in range(w):
            a, b, own = abs(dx[y][x]), abs(dy[y][x]) * 2**15, m(y, x)
            if b < a * 13573:
                thin = own > m(y, x - 1) and own >= m(y, x + 1)
            elif b > a * 13573 + a * 2**16:
                thin = own > m(y - 1, x) and own >= m(y + 1, x)
            else:
                s = -1 if (dx[y][x] ^ dy[y][x]) < 0 else 1
                thin = own > m(y - 1, x - s) and own > m(y + 1, x + s)
            if thin and own > low:
                weak.add((y, x))
                if own > high:
                    strong.add((y, x))
    found, left = list(strong), weak - strong
    for y, x in found:
        near = {(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
        left -= near
        found += near
    return set(found)


def naive_grown(mask, shape, h, w):
    return {(y + dy, x + dx) for y, x in mask for dy, r in shape.items() for dx in range(-r, r + 1) if 0 <= y + dy < h and 0 <= x + dx < w}


def naive_groups(mask):
    left, out = set(mask), []
    for first in sorted(mask):
        if first in left:
            left.discard(first)
            found = [first]
            for y, x in found:
                near = {(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
                left -= near
                found += near
            out.append(found)
    return out


def picture(rng, h, w):
    g = np.full((h, w), 255, np.int64)
    for _ in range(6):
        y, x = rng.integers(0, h), rng.integers(0, w)
        g[y : y + rng.integers(1, 25), x : x + rng.integers(1, 25)] = rng.integers(0, 256)
    return np.clip(g + rng.integers(-12, 13, (h, w)) * (rng.random((h, w)) < 0.3), 0, 255)


@pytest.mark.parametrize("h,w,size", [(70, 40, 9), (33, 61, 31), (1, 30, 5), (40, 1, 5), (120, 35, 31)])
def test_content_rows(monkeypatch, h, w, size):
    monkeypatch.setattr(content, "STRIP", 16)
    for seed in range(4):
        g = picture(np.random.default_rng(seed), h, w)
        edges = naive_edges(g.tolist(), 30, 120)
        assert {tuple(p) for p in np.argwhere(content.gradient_edges(g, 30, 120)).tolist()} == edges
        shape = {d: round(math.sqrt((size // 2) ** 2 - d * d)) for d in range(-(size // 2), size // 2 + 1)}
        mask = edges | {(y, x) for y in range(h) for x in range(w) if 18 < g[y, x] < 237}
        every = {(y, x) for y in range(h) for x in range(w)}
        closed = every - naive_grown(every - naive_grown(mask, shape, h, w), shape, h, w)
        want = [False] * h
        for found in naive_groups(closed):
            ys, xs = [p[0] for p in found], [p[1] for p in found]
            if max(xs) - min(xs) + 1 >= 15 and max(ys) - min(ys) + 1 >= 15:
                for y in range(max(0, min(ys) - 4), min(h, max(ys) + 5)):
                    want[y] = True
        assert content.content_mask(g, size=size, pad=4).tolist() == want


def test_content_takes_little_room():
    import tracemalloc

    g = np.full((640, 48), 255, np.int64)
    g[::7, 5:30] = 60
    content.content_mask(g)
    tracemalloc.start()
    content.content_mask(g)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 65 * g.size  # gradients in 32 bits, running sums in 16
    wide = g * 40_000  # values that have no room there
    assert {tuple(p) for p in np.argwhere(content.gradient_edges(wide[:30], 30, 120)).tolist()} == naive_edges(wide[:30].tolist(), 30, 120)


def test_pages_rows_leave_python_in_few_batches():
    import pyarrow as pa

    some = lambda n, at=0: pa.record_batch([pa.array(range(at, at + n), pa.int64())], ["img"])
    out = list(content.gathered(iter([some(3, 10 * i) for i in range(50)] + [some(0)] * 500), least=100))
    assert [v for b in out for v in b["img"].to_pylist()] == [10 * i + j for i in range(50) for j in range(3)]
    assert len(out) < 5 and not list(content.gathered(iter([]))) and not list(content.gathered(iter([some(0)])))


def test_content_of_odd_pages(spark):
    g = picture(np.random.default_rng(9), 50, 40)
    rows = spark.createDataFrame([(1, g.tolist()), (2, []), (3, None), (4, [[255]])], "img long, gray array<array<int>>")
    got = content.scored_rows(rows, pad=2).orderBy("img", "y").collect()
    assert [(r.img, r.y) for r in got] == [(1, y) for y in range(50)] + [(4, 0)]
    assert [r.unsafe for r in got[:50]] == content.content_mask(g, pad=2).tolist()
    assert all(abs(r.score - (g[r.y].std() + 2 * ((g[r.y] > 18) & (g[r.y] < 237)).sum())) < 1e-3 for r in got[:50])
    spans = {(r.first, r.last) for r in content.content_spans(rows, pad=2).collect()}
    assert {y for a, b in spans for y in range(a, b + 1)} == {r.y for r in got[:50] if r.unsafe}


def test_cuts_of_pages(spark):
    from pagegrain.operators import profile
    from pagegrain.plans import media
    from pagegrain.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    want = profile.cut_rows(content.scored_rows(media.tall(spark, sf), pad=4), 140, 18, 50, 80, 2).collect()
    query = QUERIES["content_cuts"](spark, sf)
    assert sorted(map(tuple, query.collect())) == sorted(map(tuple, want)) and len(want) > 200
    text = query._jdf.queryExecution().executedPlan().toString()
    assert not {"Exchange", "collect_list", "MapInPandas"} & set(re.findall(r"\w+", text))  # a page's rows aren't shuffled
    odd = [(1, []), (2, None), (3, [[255]]), (4, np.full((300, 30), 255).tolist()), (5, np.full((9, 30), 255).tolist())]
    rows = spark.createDataFrame(odd, "img long, gray array<array<int>>")
    for choice in ((100, 10, 30, 20, 0), (100, 10, 30, 20, 4), (3, 2, 1, 2, 12)):
        want = profile.cut_rows(content.scored_rows(rows, pad=2), *choice).collect()
        assert sorted(map(tuple, content.page_cuts(rows, *choice, pad=2).collect())) == sorted(map(tuple, want))


def test_slices_of_odd_pages_equal_sql(spark, tmp_path):
    """Components whose level depends on the precision, and vectors that are short, null or hold nulls."""
    import duckdb

    from pagegrain.plans.queries import ORACLE, QUERIES

    edges = [-0.55, -0.475, -0.425, -0.4, -0.3]
    rows = [(0, (edges * 13)[:64]), (1, None), (2, [0.5, -0.4]), (3, [None, -0.3] * 32), (4, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(ORACLE["slice_files"]).fetchall())
    assert len(want) == 20 and sorted(tuple(r) for r in QUERIES["slice_files"](spark, str(tmp_path)).collect()) == want


def test_scenes_work_each_block_out_once(spark):
    from pagegrain.plans import media, processing
    from pagegrain.plans.queries import QUERIES
    from pagegrain.plans.views import table

    sf = "/root/testdata/sf0.001"
    vectors = {r.vec_id: r.embedding for r in table(spark, sf, "embeddings").where("vec_id < 40").collect()}
    pages = {r.img: r for r in media.scene(spark, sf).where("img < 40").collect()}
    edited = {r.img: r for r in processing.edited(spark, sf).where("img < 40").collect()}
    assert set(pages) == set(edited) == set(vectors) and len(pages) == 40
    for i, e in vectors.items():
        at = lambda y, x: e[y // 12 * 8 + x // 10]  # noqa: B023, E731
        shade = lambda v: math.floor((v + 1) * 127.5) if v > 0.2 or i % 4 == 3 else (250, 8, 128)[i % 4]  # noqa: B023, E731
        assert pages[i].gray == edited[i].gray == [[shade(at(y, x)) for x in range(80)] for y in range(96)]
        mask = [[255 * (at(y, x) > 0.2 and y % 12 < 6 and x % 10 < 7) for x in range(80)] for y in range(96)]
        assert pages[i].mask == mask
        assert edited[i].manual == ([[20 * (v > 0) for v in row[::2]] for row in mask[::2]] if i % 5 else None)
    for name in ("fill_plan_masks", "fill_plan_boxes", "filled_rows", "second_plan"):
        text = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "array_repeat" in text and "/ 12" not in text and "filter(" not in text


# contrast and neighbourhoods
def naive_equalised(g, clip, tiles):
    h, w = g.shape
    down, right = (tiles - h % tiles, tiles - w % tiles) if h % tiles or w % tiles else (0, 0)

    def turned(i, n):
        while n > 1 and i >= n:
            i = abs(2 * n - 2 - i)
        return i if n > 1 else 0

    th, tw = (h + down) // tiles, (w + right) // tiles
    tables = {}
    for a in range(tiles):
        for b in range(tiles):
            hist = [0] * 256
            for y in range(a * th, a * th + th):
                for x in range(b * tw, b * tw + tw):
                    hist[g[turned(y, h)][turned(x, w)]] += 1
            limit = max(1, int(clip * th * tw / 256))
            over = sum(max(0, v - limit) for v in hist)
            hist = [min(v, limit) + over // 256 for v in hist]
            rest = over % 256
            i, step = 0, max(1, 256 // rest) if rest else 1
            while i < 256 and rest > 0:
                hist[i] += 1
                rest -= 1
                i += step
            total, table = 0, []
            for v in hist:
                total += v
                table.append(round(total * (255 / (th * tw))))
            tables[a, b] = table
    out = np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            fy, fx = y / th - 0.5, x / tw - 0.5
            y1, x1 = math.floor(fy), math.floor(fx)
            ya, xa = fy - y1, fx - x1
            t = lambda i, j: tables[min(max(i, 0), tiles - 1), min(max(j, 0), tiles - 1)][g[y][x]]  # noqa: B023, E731
            up, low = t(y1, x1) * (1 - xa) + t(y1, x1 + 1) * xa, t(y1 + 1, x1) * (1 - xa) + t(y1 + 1, x1 + 1) * xa
            out[y, x] = min(255, max(0, round(up * (1 - ya) + low * ya)))
    return out


@pytest.mark.parametrize("h,w", [(16, 24), (19, 30), (8, 13), (3, 2), (40, 33)])
def test_equalised(h, w):
    g = picture(np.random.default_rng(h), h, w)
    assert (enhance.equalised(g) == naive_equalised(g, 2.5, 8)).all()


def test_enhanced(spark):
    rng = np.random.default_rng(1)
    pages = {1: picture(rng, 21, 18), 2: picture(rng, 12, 9) // 3, 3: np.full((2, 2), 40)}
    rows = spark.createDataFrame([(k, g.tolist()) for k, g in pages.items()] + [(4, []), (5, None)], "img long, gray array<array<int>>")
    got = {(r.img, r.y): r.row for r in enhance.enhanced(rows).collect()}
    assert set(got) == {(k, y) for k, g in pages.items() for y in range(len(g))}
    for k, g in pages.items():
        h, w = g.shape
        inner = g[h // 4 : 3 * h // 4, w // 4 : 3 * w // 4] if h >= 8 and w >= 8 else g
        even = naive_equalised(255 - g if inner.mean() < 130 else g, 2.5, 8)
        for y in range(h):
            for x in range(w):
                turn = lambda i, n: 0 if n == 1 else abs(i) if i < n else 2 * n - 2 - i
                v = 2.2 * even[y, x] - 0.3 * sum(even[turn(y + a, h), turn(x + b, w)] for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0)))
                assert got[k, y][x] == min(255, max(0, round(round(v, 9))))


@pytest.mark.parametrize("h,w", [(1, 1), (2, 3), (5, 9), (9, 2)])
def test_convolved(spark, h, w):
    g = np.random.default_rng(h).integers(0, 256, (h, w))
    rows = spark.createDataFrame([(1, y, r.tolist()) for y, r in enumerate(g)], "img long, y int, row array<int>").repartition(3)
    turn = lambda i, n: 0 if n == 1 else min(i % (2 * n - 2), 2 * n - 2 - i % (2 * n - 2))
    want = np.array([[sum(a * b * g[turn(y + i - 3, h), turn(x + j - 3, w)] for i, a in enumerate(enhance.FEATHER) for j, b in enumerate(enhance.FEATHER)) for x in range(w)] for y in range(h)])
    got = np.array([r.row for r in enhance.feathered(rows).orderBy("y").collect()])
    assert np.abs(got - want).max() < 1e-9
    bordered = np.array([r.row for r in enhance.padded(rows, 2).orderBy("y").collect()])
    assert (bordered == np.pad(g, 2, constant_values=255)).all()


def test_blended(spark):
    make = lambda v: spark.createDataFrame([(1, 0, v)], "img long, y int, row array<double>")
    out = enhance.blended(make([10.0, 200.0, 30.0]), make([110.0, 0.0, 400.0]), make([0.5, 0.25, 1.0])).first()
    assert out.row == [60, 150, 255]


# fills
def naive_fill(crop, mask):
    rest = [int(v) for v, m in zip(crop.ravel(), mask.ravel(), strict=True) if not m]
    light, dark = [v for v in rest if v > 215], [v for v in rest if v < 35]
    if rest and len(light) / len(rest) >= 0.7:
        return "white", int(np.median(light))
    if rest and len(dark) / len(rest) >= 0.7:
        return "black", int(np.median(dark))
    return ("low_std", int(np.median(rest))) if rest and np.std(rest) < 12 else ("model", None)


def test_mask_plan(spark):
    rng = np.random.default_rng(4)
    scenes = {}
    for k in range(8):
        g = np.clip(np.full((90, 110), (250, 5, 128, 128)[k % 4]) + rng.integers(-3, 4, (90, 110)), 0, 255)
        if k < 6:
            g[40:, 50:] = rng.integers(0, 256, (50, 60))
        m = np.zeros((90, 110), int)
        for _ in range(5):
            y, x = rng.integers(0, 90), rng.integers(0, 110)
            m[y : y + rng.integers(1, 12), x : x + rng.integers(1, 12)] = rng.integers(100, 256)
        scenes[k] = g, m
    schema = "img long, gray array<array<int>>, mask array<array<int>>"
    rows = spark.createDataFrame([(k, g.tolist(), m.tolist()) for k, (g, m) in scenes.items()] + [(100, [], []), (101, None, None), (102, [[1, 2]], None)], schema)
    plan = {}
    for r in fill.mask_plan(rows).collect():
        plan.setdefault(r.img, []).append(r)
    drawn = {}
    for r in fill.mask_filled(rows).orderBy("img", "y").collect():
        drawn.setdefault(r.img, []).append(r.row)
    assert set(drawn) == {*scenes, 102} and {r.route for x in plan.values() for r in x} == {"white", "black", "low_std", "model"}
    for k, (g, m) in scenes.items():
        out, waiting, want = g.copy(), [], []
        for n, found in enumerate(naive_groups({tuple(p) for p in np.argwhere(m > 127).tolist()})):
            ys, xs = [p[0] for p in found], [p[1] for p in found]
            size = min(15, max(9, round(max(1, min(max(xs) - min(xs) + 1, max(ys) - min(ys) + 1)) * 0.025) * 2 + 1))
            r = size // 2
            grown = naive_grown(found, {d: round(math.sqrt(r * r - d * d)) for d in range(-r, r + 1)}, 90, 110)
            gy, gx = [p[0] for p in grown], [p[1] for p in grown]
            x1, y1, x2, y2 = max(0, min(gx) - 72), max(0, min(gy) - 72), min(110, max(gx) + 72), min(90, max(gy) + 72)
            local = np.zeros((90, 110), bool)
            for p in grown:
                local[p] = True
            route, value = naive_fill(out[y1:y2, x1:x2], local[y1:y2, x1:x2])
            seen = [i for i, other in waiting if other[y1:y2, x1:x2].any()]
            want.append((n, x1, y1, x2, y2, int(local[y1:y2, x1:x2].sum()), route, value, seen[-1] if seen else None))
            if route == "model":
                waiting.append((n, local))
            else:
                out[y1:y2, x1:x2][local[y1:y2, x1:x2]] = value
        got = sorted((r.part, r.x1, r.y1, r.x2, r.y2, r.pixels, r.route, r.value, r.waits_for) for r in plan.get(k, []))
        assert got == want
        assert (np.array(drawn[k]) == out).all()


def test_tiles():
    mask = np.zeros((600, 1200), bool)
    mask[590, 1100] = True
    got = fill.tiles_of(mask)
    assert [(t["y1"], t["x1"]) for t in got] == [(0, 0), (0, 448), (0, 688), (88, 0), (88, 448), (88, 688)]
    assert [t["active"] for t in got] == [False] * 5 + [True]
    assert fill.tiles_of(mask[:512, :512]) == []


def test_box_plan(spark):
    rng = np.random.default_rng(6)
    g = np.full((300, 400), 240)
    g[150:, 200:] = rng.integers(0, 256, (150, 200))
    box = lambda i, x1, y1, x2, y2, m=None: (i, x1, y1, x2, y2, m)
    boxes = [box(0, 10, 10, 40, 30), box(1, 60, 12, 90, 32), box(2, 300, 220, 340, 240, np.full((10, 20), 255).tolist()), box(3, 150, 20, 150, 40), box(4, 200, 10, 240, 30)]
    schema = "img long, gray array<array<int>>, boxes array<struct<box_index: int, x1: int, y1: int, x2: int, y2: int, mask: array<array<int>>>>"
    got = {tuple(r.boxes): r for r in fill.box_plan(spark.createDataFrame([(1, g.tolist(), boxes), (2, g[:5, :5].tolist(), [])], schema)).collect()}
    assert set(got) == {(0, 1), (2,), (3,), (4,)}
    one = got[0, 1]
    assert (one.route, one.value) == ("white", 240) and (one.x1, one.y1, one.x2, one.y2) == (0, 0, 150, 150)  # a square, moved into the page
    # rectangles are 8 wider with their ends, and grow by the ellipse of 7; both lie apart
    shape = {d: round(math.sqrt(9 - d * d)) for d in range(-3, 4)}
    rect = {(y, x) for a, b, c, d in ((10, 10, 40, 30), (60, 12, 90, 32)) for y in range(b - 8, d + 9) for x in range(a - 8, c + 9)}
    assert one.pixels == len(naive_grown(rect, shape, 150, 150))
    assert got[2,].route == "model" and got[3,].route == "none" and got[4,].route == "white"  # the third box has no width
    wide = fill.local_mask([{"x1": 5, "y1": 5, "x2": 25, "y2": 15, "mask": np.full((10, 20), 255).tolist()}], (0, 0, 40, 40), rng.integers(0, 256, (40, 40)))
    nine = {d: round(math.sqrt(16 - d * d)) for d in range(-4, 5)}
    assert wide.sum() == len(naive_grown({(y, x) for y in range(5, 15) for x in range(5, 25)}, nine, 40, 40))


def test_a_cluster_over_a_third_of_the_page_is_left_out():
    gray = np.full((100, 100), 255)
    near = [{"box_index": i, "x1": 5 + 40 * i, "y1": 5, "x2": 45 + 40 * i, "y2": 90, "mask": None} for i in range(2)]
    assert list(fill.box_parts(gray, near)) == [] and len(list(fill.box_parts(gray, near[:1]))) == 1


# masks
def filtered(pixels, kinds, step):
    """Bytes of lines under given filters."""
    out, above = b"", [0] * len(pixels[0])
    for line, kind in zip(pixels, kinds, strict=True):
        sent = []
        for i, v in enumerate(line):
            a, b, c = line[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            p = a + b - c
            best = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
            sent.append((v - (0, a, b, (a + b) // 2, best)[kind]) % 256)
        out += bytes([kind, *sent])
        above = line
    return out


@pytest.mark.parametrize("colour,channels", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png_filters(colour, channels):
    rng = random.Random(colour)
    pixels = [[rng.randrange(256) for _ in range(6 * channels)] for _ in range(10)]
    data = png_file(6, 10, 8, colour, filtered(pixels, [0, 1, 2, 3, 4] * 2, channels))
    assert masks.decoded(data).reshape(10, -1).tolist() == pixels


def test_png_depths_and_palettes():
    assert masks.decoded(png_file(10, 1, 1, 0, bytes([0, 0b10110000, 0b01000000])))[0, :, 0].tolist() == [255, 0, 255, 255, 0, 0, 0, 0, 0, 255]
    assert masks.decoded(png_file(3, 1, 4, 0, bytes([0, 0x1F, 0x80])))[0, :, 0].tolist() == [17, 255, 136]
    assert masks.decoded(png_file(2, 1, 16, 0, bytes([0, 200, 1, 7, 9])))[0, :, 0].tolist() == [200, 7]
    table = (b"PLTE", bytes([1, 2, 3, 4, 5, 6]))
    assert masks.decoded(png_file(2, 1, 8, 3, bytes([0, 1, 0]), more=[table, (b"tRNS", b"\x09")]))[0].tolist() == [[4, 5, 6, 255], [1, 2, 3, 9]]


def test_mask_payloads(spark):
    m = np.random.default_rng(0).integers(0, 256, (5, 7))
    good = masks.encoded(m)
    deep = png_file(7, 5, 8, 6, filtered([[v for p in line for v in (1, 2, 3, int(p))] for line in m], [0] * 5, 4))
    tests = {0: base64.b64encode(good).decode(), 1: None, 2: "", 3: "!" * 8, 4: base64.b64encode(good[:-9]).decode(), 5: base64.b64encode(b"text").decode(), 6: base64.b64encode(deep).decode(), 7: base64.b64encode(png_file(7, 5, laced=1)).decode(), 8: base64.b64encode(png_file(60000, 60000)).decode(), 9: base64.b64encode(png_file(7, 5, lines=b"\0" * 9)).decode(), 10: base64.b64encode(png_file(1, 1, 8, 3, b"\0\5", more=[(b"PLTE", b"abc")])).decode()}
    got = {r.k: r for r in masks.stored_masks(spark.createDataFrame(list(tests.items()), "k int, mask string"), "k").collect()}
    assert got[0].mask == m.tolist() and (got[0].width, got[0].height) == (7, 5)
    assert all(got[k].mask is None and got[k].error is None for k in (1, 2))
    assert {k: got[k].error for k in (3, 4, 5, 7, 8, 9, 10)} == {3: "base64", 4: "cut", 5: "no PNG", 7: "interlaced", 8: "size", 9: "pixels", 10: "palette"}
    assert got[6].mask == [[2] * 7] * 5  # gray of 1, 2, 3
    files = spark.createDataFrame([(0, good, 14, 10), (1, deep, 7, 5), (2, b"", 7, 5), (3, None, 7, 5), (4, masks.encoded(np.zeros((2, 2))), 7, 5), (5, deep, 3, 2)], "k int, content binary, page_width int, page_height int")
    got = {r.k: r for r in masks.uploaded_masks(files, "k").collect()}
    assert got[0].mask == np.kron(m, np.ones((2, 2), int)).tolist() and got[1].mask == m.tolist()
    assert [got[k].error for k in (2, 3, 4)] == ["empty file", "empty file", "empty mask"]
    assert got[5].mask == m[np.ix_([0, 2], [0, 2, 4])].tolist()
    back = masks.with_text(spark.createDataFrame([(1, m.tolist()), (2, None), (3, [])], "k int, mask array<array<int>>")).collect()
    assert masks.decoded(base64.b64decode(back[0].payload))[:, :, 0].tolist() == m.tolist() and back[1].payload is back[2].payload is None


def test_prototype_masks(spark):
    rng = np.random.default_rng(3)
    protos = rng.normal(size=(4, 6, 8))
    boxes = []
    for i in range(30):
        x, y = rng.uniform(-50, 900), rng.uniform(-50, 900)
        boxes.append((1, i, rng.normal(size=4).tolist(), x, y, x + rng.uniform(0, 600), y + rng.uniform(0, 600), int(rng.integers(1, 12)), int(rng.integers(1, 12))))
    boxes += [(1, 40, [1.0], 0.0, 0.0, 9.0, 9.0, 3, 3), (1, 41, None, 0.0, 0.0, 9.0, 9.0, 3, 3), (1, 42, [1.0] * 4, 0.0, 0.0, 9.0, 9.0, 0, 3), (2, 0, [1.0] * 4, 0.0, 0.0, 9.0, 9.0, 3, 3)]
    pages = spark.createDataFrame([(1, 6, 8, protos.reshape(4, -1).tolist()), (3, 6, 8, None)], "page_id long, side_y int, side_x int, prototypes array<array<double>>")
    got = {r.box_index: r for r in prototypes.masks(pages, spark.createDataFrame(boxes, "page_id long, box_index int, coefficients array<double>, x1 double, y1 double, x2 double, y2 double, width int, height int")).collect()}
    assert set(got) == {*range(30), 40, 41, 42} and all(got[i].mask is None for i in (40, 41, 42))
    for _, i, c, x1, y1, x2, y2, w, h in boxes[:30]:
        full = 1 / (1 + np.exp(-sum(a * p for a, p in zip(c, protos, strict=True))))
        px, py = int(max(0, min(7, round(x1 / 128)))), int(max(0, min(5, round(y1 / 128))))
        crop = full[py : int(max(py + 1, min(6, round(y2 / 128)))), px : int(max(px + 1, min(8, round(x2 / 128))))]
        for y in range(h):
            for x in range(w):
                fy, fx = min(max((y + 0.5) * len(crop) / h - 0.5, 0), len(crop) - 1), min(max((x + 0.5) * crop.shape[1] / w - 0.5, 0), crop.shape[1] - 1)
                a, b = int(fy), int(fx)
                c2, d2 = min(a + 1, len(crop) - 1), min(b + 1, crop.shape[1] - 1)
                v = (crop[a, b] * (1 - fx + b) + crop[a, d2] * (fx - b)) * (1 - fy + a) + (crop[c2, b] * (1 - fx + b) + crop[c2, d2] * (fx - b)) * (fy - a)
                assert abs(v - 0.5) < 1e-9 or got[i].mask[y][x] == 255 * (v > 0.5)


# addresses
def test_addresses(spark):
    rng = random.Random(7)
    texts = ["::", "::1", "::2", "fe80::1%eth0", "FC00::", "fdff:ffff::", "fec0::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::1.2.3.4", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "64:ff9b::10.0.0.1", "1::2::3", ":::", ":", "1:", ":1", "12345::", "g::", "1:2:3:4:5:6:7:8:9", "::1.2.3", "::1.2.3.256", "1.2.3.4::", "127.0.0.1", "8.8.8.8", "0x7f.1", "2130706433", "127.1", "", None, "host", "8000::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff"]
    for _ in range(300):
        v = rng.choice((rng.getrandbits(128), rng.getrandbits(64), rng.choice((0xFC, 0xFD, 0xFE, 0xFF)) << 120 | rng.getrandbits(120), 0xFFFF << 32 | rng.getrandbits(32)))
        texts.append(rng.choice((str(ipaddress.IPv6Address(v)), ipaddress.IPv6Address(v).exploded)))
    nets = [ipaddress.ip_network(n) for n in addresses.BLOCKED]
    from pagegrain.functions.scalars import BLOCKED

    nets += [ipaddress.ip_network(f"{b}/{n}") for b, n in BLOCKED]

    def want(t):
        try:
            ip = ipaddress.ip_address(t)
        except ValueError:
            return None
        ip = getattr(ip, "ipv4_mapped", None) or ip
        return any(ip in n for n in nets if n.version == ip.version)

    got = {r.t: r for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", addresses.blocked(F.col("t")).alias("b"), addresses.ipv6(F.col("t")).alias("six")).collect()}
    for t in texts:
        assert got[t].b == want(t), t
        if got[t].six:
            assert (got[t].six.hi % 2**64) << 64 | got[t].six.lo % 2**64 == int(ipaddress.IPv6Address(t))


def test_fetch_refusal(spark):
    rows = [("http://8.8.8.8/x", None, None), ("http://127.0.0.1", None, "blocked"), ("https://[::1]:80/", None, "blocked"), ("https://[2001:db8::1]", None, None), ("ftp://a", ["8.8.8.8"], "scheme"), ("http:///x", ["8.8.8.8"], "no host"), ("http://h", None, "not resolved"), ("http://h", [], "not resolved"), ("http://h", ["8.8.8.8", "10.1.2.3"], "blocked"), ("http://h", ["8.8.8.8", "2606::1"], None), ("http://u@10.0.0.1@h:1/", ["8.8.8.8"], None), ("http://8.8.8.8@10.0.0.1/", ["8.8.8.8"], "blocked"), (None, None, "scheme"), ("", None, "scheme"), ("http://2130706433/", ["127.0.0.1"], "blocked"), ("http://2130706433/", None, "not resolved")]
    df = spark.createDataFrame([(i, u, a) for i, (u, a, _) in enumerate(rows)], "i int, u string, a array<string>")
    assert [r.f for r in df.select("i", addresses.refusal(F.col("u"), F.col("a")).alias("f")).orderBy("i").collect()] == [w for _, _, w in rows]


# archives and corpora
def test_broken_archive_entries(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for n in ("a.png", "b.png", "c.png"):
            z.writestr(n, n * 50)
    data = out.getvalue().replace(b"b.png" * 50, b"b.pnh" * 50)  # its checksum is wrong now
    got = archive.pages(spark.createDataFrame([("1", 0, "x.zip", data)], "chapter_id string, upload int, name string, content binary")).collect()
    assert {r.name: (r.content is None, r.error) for r in got} == {"a.png": (False, None), "b.png": (True, "BadZipFile"), "c.png": (False, None)}


def test_corpus_on_disk(spark, tmp_path):
    for n, files in {"a": ("original.png", "mask.png", "metadata.json"), "b": ("original.png",), "c": ("mask.png", "original.png"), "d": ("notes.txt",)}.items():
        (tmp_path / n).mkdir()
        for f in files:
            (tmp_path / n / f).write_text('{"boxes": [{"x1": 9}, {"x1": 1, "y2": 3.5}], "width": 1.0, "case_id": "é"}' if f.endswith("json") else f"{n}{f}")
    found = corpus.cases(corpus.listing(spark, str(tmp_path))).collect()
    assert {r.case_id for r in found} == {"é", "c"}
    image, mask = (__import__("hashlib").sha256(f"a{f}".encode()).hexdigest() for f in ("original.png", "mask.png"))
    want = f'{{"boxes":[{{"x1":1,"y2":3.5}},{{"x1":9}}],"case_id":"\\u00e9","expected_execution":"model_required","expected_shortcut_type":null,"height":0,"mask_sha256":"{mask}","mask_type":"","original_sha256":"{image}","width":1.0}}'
    assert next(r for r in found if r.case_id == "é").workload_sha256 == __import__("hashlib").sha256(want.encode()).hexdigest()
    assert {(r.folder[-1], r.lacks) for r in corpus.unpaired(corpus.listing(spark, str(tmp_path))).collect()} == {("b", "mask.png"), ("d", "both")}


def test_links_in_any_quotes(spark):
    from pagegrain.sources import links

    html = """<a href="one">1</a><A class=x HREF='two words'>2</a><a href=three>3</a><!-- <a href="no"> --><script>"<a href='no'>"</script><link rel=x href = "four"/><p>href="no"</p><a data-href="no">5</a>"""
    rows = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    assert [(r.page_id, r.place, r.link) for r in links.links(rows).orderBy("place").collect()] == [(1, i, t) for i, t in enumerate(("one", "two words", "three", "four"))]
