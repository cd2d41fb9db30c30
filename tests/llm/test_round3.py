"""Sharding, hard negatives and spelling variants against brute force, and on odd input."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagegrain.llm import hard_negatives as hn
from pagegrain.llm import registry, sharding, spelling

DOCS = "doc_id long, text string, source string, shard string, slot string, st string, key string, part string, before string, frac string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, *"abcdefg") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(3)
    rows = [(i, f"text {i}" * rng.randint(0, 3), rng.choices(["hot", "a", "b", None], [60, 20, 15, 5])[0]) for i in range(900)]
    rows += [(900 + i, "one", f"rare{i}") for i in range(50)]
    rows += [(None, None, "hot"), (None, "x", "hot"), (5, "twice", "a"), (5, "twice", "a"), (6, "other text of a known id", "a")]
    return rows


@pytest.mark.parametrize("bucket", [16, 100, 100_000])
def test_interleave(spark, mixed, bucket):
    got = sharding.interleave(docs_of(spark, mixed).repartition(3), 7, bucket=bucket)
    assert got.columns == ["doc_id", "text", "source", "st", "key", "part", "before", "frac", "shard", "slot"]
    rows = got.collect()
    assert Counter((r.doc_id, r.text, r.source) for r in rows) == Counter(mixed)
    held = defaultdict(list)
    for r in rows:
        held[r.shard].append(r)
    assert max(map(len, held.values())) - min(map(len, held.values())) <= 1
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in held.values())
    total = Counter(r.source for r in rows)
    for x in held.values():
        own = Counter(r.source for r in x)
        assert all(abs(own[s] - n / 7) <= 6 for s, n in total.items() if n >= 7)  # 50 sources of one row each fall at random
        assert 1 <= sum(n for s, n in own.items() if s and s.startswith("rare")) <= 20  # rare sources don't meet in one shard


def test_interleave_is_the_same_however_rows_are_dealt(spark, mixed):
    key = ("doc_id", "text")
    one = {tuple(r) for r in sharding.interleave(docs_of(spark, mixed).coalesce(1), 7, keys=key, bucket=50).select("doc_id", "text", "shard", "slot").collect()}
    two = {tuple(r) for r in sharding.interleave(docs_of(spark, mixed).repartition(8), 7, keys=key, bucket=500).select("doc_id", "text", "shard", "slot").collect()}
    assert one == two


def test_interleave_of_few_rows_and_of_none(spark, mixed):
    got = sharding.interleave(docs_of(spark, mixed[:3]), 40)
    assert got.count() == got.select("shard").distinct().count() == 3
    none = sharding.interleave(docs_of(spark, mixed).where("false"), 40)
    assert none.count() == 0 and none.columns[-2:] == ["shard", "slot"]
    assert sharding.document_shards(docs_of(spark, mixed).where("false")).count() == 0


def test_document_shards(spark, mixed):
    got = sharding.document_shards(docs_of(spark, mixed)).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in mixed)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_sharding_runs_no_python_on_executors(spark):
    plan = registry.op11_sharding(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_write_shards(spark, mixed, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(docs_of(spark, mixed).drop("shard", "slot"), path, 5)
    back = spark.read.parquet(path)
    assert Counter((r.doc_id, r.text, r.source) for r in back.collect()) == Counter(mixed)
    for p in (tmp_path / "shards" / "shard=2").glob("*.parquet"):
        slots = [r.slot for r in spark.read.parquet(f"file://{p}").collect()]
        assert slots == sorted(slots)


def brute(rows, k=5):
    """rows (id, label, vector) that take part, without repeats."""
    rows = sorted({(i, c, tuple(int(x) for x in v)) for i, c, v in rows})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, c, v in rows:
        if i % 10:
            continue
        every = sorted((-dot(v, w), j, d) for j, d, w in rows if j != i)
        for p, j, d in [x for x in every if x[2] == c][:k]:
            ranked = [(s, n) for s, n, e in every if e != c and 80 * -p <= 100 * -s <= 100 * -p][:k]
            out += [(i, j, r + 1, n, -p, -s) for r, (s, n) in enumerate(ranked)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, c, v, "own", "own", 1.0) for i, c, v in rows], "vec_id long, label long, v array<double>, cell string, h string, least double")


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 6)) * 200
    rows = []
    for i in range(400):
        c = i % 12
        rows.append((i, int(c // 4), [float(x) for x in np.floor(centres[c] + rng.normal(size=6) * 30)]))
    rows += [(400 + i, i % 2, [50.0, -50.0, 50.0, 0.0, 0.0, 0.0]) for i in range(25)]  # ties
    rows += [(430, 1, [0.0] * 6), (440, 2, []), (450, 0, [7.0, 1.0]), (460, 9, [float(x) for x in range(6)])]
    return rows


@pytest.mark.parametrize("group,piece", [(4096, 16384), (3, 1024)])
def test_hard_negatives(spark, clustered, group, piece):
    odd = [(None, 1, [1.0] * 6), (470, None, [1.0] * 6), (480, 1, None), (490, 1, [1.0, None, 2.0]), (500, 1, [float("nan")] * 6), (510, 1, [float("inf")] * 6)]
    table = vectors(spark, clustered + odd + clustered[:40]).repartition(3)
    got = sorted(map(tuple, hn.hard_negatives(table, F.col("vec_id") % 10 == 0, group=group, piece=piece).collect()))
    want = brute(clustered)
    assert len(want) > 200 and got == want


def test_rows_of_one_id_are_not_each_others(spark):
    rows = [(10, 1, [3.0, 4.0]), (10, 1, [4.0, 3.0]), (11, 1, [3.0, 3.0]), (12, 2, [3.0, 3.0]), (13, 2, [2.0, 3.0])]
    got = sorted(map(tuple, hn.hard_negatives(vectors(spark, rows), F.col("vec_id") % 10 == 0).collect()))
    assert got == brute(rows) and len(got) == 4


def test_hard_negatives_of_large_components(spark):
    rows = [(i, i % 2, [float(2**40 + i), float(i)]) for i in range(1, 30)] + [(40, 0, [1e30, -1e30]), (50, 1, [1e30, 3.0])]
    got = hn.hard_negatives(vectors(spark, rows), F.col("vec_id") % 10 == 0).collect()
    assert all(abs(r.positive_score) < 1 << 63 for r in got)
    small = [(i, i % 2, [float(2**28 + i), float(i)]) for i in range(1, 31)]  # sums beyond 2**53
    assert sorted(map(tuple, hn.hard_negatives(vectors(spark, small), F.col("vec_id") % 10 == 0).collect())) == brute(small)


def test_hard_negatives_of_nothing(spark, clustered):
    for rows, anchor in ((clustered[:0], "vec_id % 10 = 0"), (clustered, "vec_id < 0"), ([(10, 1, [1.0])], "true"), ([(10, 1, [1.0]), (11, 1, [1.0])], "true")):
        got = hn.hard_negatives(vectors(spark, rows), F.expr(anchor))
        assert got.count() == 0 and got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_rings_leave_candidates_out(spark, clustered):
    """Of well separated clusters a group needs few cells."""
    x = hn.matrix([r[2] for r in clustered[:400]], 6)
    norm = float(np.sqrt((x**2).sum(1).max()))
    space = hn.Space(6, norm, hn.pivots_of(hn.augmented(x, norm), 16), 40, 4)
    anchors = spark.createDataFrame([(r[2], float(np.sort(x @ x[i])[-10]), None) for i, r in enumerate(clustered[:400]) if i % 10 == 0], "v array<double>, least double, most double")
    rings = hn._rings(anchors, space, 4)
    d = hn.distances(hn.augmented(x, norm), space.pivots)
    cell, radius = d.argmin(1), d.min(1)
    share = np.mean([(radius >= np.array(r.inner)[cell]) & (radius <= np.array(r.outer)[cell]) for r in rings.itertuples()])
    assert len(rings) > 4 and share < 0.7


def edits_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.fixture(scope="module")
def words():
    rng = random.Random(12)
    out = set()
    for _ in range(120):
        w = "".join(rng.choices("abcéÿ×", k=rng.randint(6, 9)))
        out.add(w)
        for _ in range(5):
            i, c = rng.randrange(len(w)), rng.choice("abcéÿzÀ")
            w = rng.choice((w[:i] + c + w[i + 1 :], w[:i] + c + w[i:], w[:i] + w[i + 1 :]))
            if len(w) >= 6:
                out.add(w)
    out |= {"aaaaaa", "aaaaaaa", "a" * 3000, "a" * 3001}
    return sorted((w, rng.choice((5, 6, 25, 30, 130, 700))) for w in out)


def test_variants(spark, words):
    got = {r.word: tuple(r) for r in spelling.variants(spark.createDataFrame([*words, (None, 9)], "word string, n long").repartition(3)).collect()}
    n, form = dict(words), {}
    want = {}
    for w, m in words:
        near = sorted((-k, v.encode(), v) for v, k in words if edits_one(w, v))
        form[w] = near[0][2] if near and -near[0][0] >= 5 * m else None
        want[w] = (w, form[w], None, m, len(near), n[form[w]] if form[w] else None)
    for w in want:
        root = w
        while form[root]:
            root = form[root]
        want[w] = (*want[w][:2], root, *want[w][3:])
    assert got == want
    assert any(form[f] for f in form.values() if f)  # a chain of two steps at least


def test_word_counts(spark):
    rng = random.Random(5)
    pool = ["Straße", "ÀÉÎabc", "letters", "Wörter123", "plain-words", "naïveté", "İstanbul", "日本語text", "short", "a" * 50]
    rows = [(i, " ".join(rng.choices(pool, k=60)) + rng.choice(["", "\n", "."]), "s") for i in range(300)]
    rows += [(None, "nullid nullid nullid nullid nullid", "s"), (1000, None, "s"), (1001, "", "s"), (1002, "repeated " * 300_000, "s"), (3, rows[3][1], "s")]
    want = Counter()
    for i, t, _ in rows:
        for m in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    got = {r.word: r.n for r in spelling.word_counts(docs_of(spark, rows).repartition(3)).collect()}
    assert got == want and len(want) > 8


def test_variants_of_nothing(spark):
    assert spelling.spelling_variants(docs_of(spark, [(1, None, "s")])).count() == 0
    assert spelling.variants(spark.createDataFrame([("single", 5)], "word string, n long")).collect()[0] == ("single", None, "single", 5, 0, None)


WORDS = "the quick brown fox jumps over a lazy dog while many people watch it from the other side of the river and wonder what will happen next".split()
FILL = random.Random(1)


def prose(n):
    return " ".join(FILL.choices(WORDS, k=n))


NAV = "<nav><ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in WORDS[:6]) + "</ul></nav>"
LINES = "<br><br>".join(prose(60) for _ in range(9))
BLOCKS = "".join(f"<p>{prose(50)}</p>" for _ in range(6))
ARTICLE = f"<article><h1>{prose(5)}</h1>{BLOCKS}</article>"


def on_page(main, nav=NAV, footer="<footer>&copy; 2020 example</footer>"):
    return f"<!DOCTYPE html><html><head><title>t</title></head><body>{nav}{main}{footer}</body></html>"


#: what a page holds, how many characters its text has at least, and what it must not have
SHAPES = {
    "article of lines": (on_page(f"<article>{LINES}</article>"), 2000, "2020"),
    "named div of lines": (on_page(f'<div class="post">{LINES}</div>'), 2000, "2020"),
    "div with an id, of lines": (on_page(f'<div id="content">{LINES}</div>'), 2000, "2020"),
    "preformatted": (on_page(f"<pre>{prose(300)}</pre>"), 1000, "2020"),
    "text in the body": (on_page(prose(300)), 1000, "2020"),
    "no markup": (prose(300), 1000, "2020"),
    "advert in the article": (on_page(f'<article><h1>{prose(5)}</h1>{BLOCKS}<div class="ad">Zebra this now</div>{BLOCKS}</article>'), 2500, "Zebra"),
    "footer of paragraphs": (on_page(ARTICLE, footer=f"<footer><p>Zebra {prose(20)}</p><p>Zebra {prose(20)}</p></footer>"), 1200, "Zebra"),
    "thread of comments": (on_page(ARTICLE + f'<div id="disqus_thread"><div><p>Zebra {prose(20)}</p></div><div><p>Zebra {prose(15)}</p></div></div>'), 1200, "Zebra"),
    "layout by a table": (f"<html><body><table><tr><td><a href=/>Zebra</a> <a href=/n>News</a></td><td><h1>{prose(5)}</h1>{BLOCKS}</td></tr></table></body></html>", 1200, "Zebra"),
    "list of links": (on_page("<article><h1>Where to go</h1><ul>" + "".join(f'<li><a href="/x{i}">{prose(4)}</a></li>' for i in range(10)) + "</ul></article>"), 180, "2020"),
}


def test_html_extract_of_many_shapes(spark):
    from pagegrain.llm import html_extract

    rows = spark.createDataFrame([(i, n, h) for i, (n, (h, _, _)) in enumerate(SHAPES.items())], "page_id long, url string, html string")
    got = {r.url: r.text for r in html_extract.extract(rows).collect()}
    assert {n: len(got[n]) >= least and no not in got[n] for n, (_, least, no) in SHAPES.items()} == dict.fromkeys(SHAPES, True)
    assert got["list of links"].count("\n") == 10


def test_html_extract_keeps_whole_articles(spark):
    """Words of pages' articles and of what is extracted, both ways."""
    from pagegrain.llm import html_extract

    both = kept = whole = 0
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html or "" for r in rows.collect()}
    for r in html_extract.extract(rows).collect():
        at = re.search("<article.*?</article>", html[r.page_id], re.S)
        if at:
            nodes = html_extract.nodes_of(html_extract.parse(at.group(0)))
            want, have = Counter(html_extract.main_text(nodes, [True] * len(nodes)).split()), Counter(r.text.split())
            both += (want & have).total()
            kept += have.total()
            whole += want.total()
    assert whole > 10_000 and both >= 0.99 * kept and both >= 0.99 * whole


def test_license_labels_against_brute_force(spark):
    """A template stands where its words do, at one relative position, with enough of its IDF."""
    import math

    from pagegrain.llm import license_scan as ls

    rng = random.Random(6)
    texts = [None, "", "no licence at all"]
    for _, text, _ in ls.TEMPLATES:
        for damage in (0.0, 0.15, 0.4, 0.6):
            words = [w if rng.random() > damage else rng.choice(("xx", "the", "software")) for w in text.split()]
            texts.append(" ".join(["before", *rng.choices(["the", "of", "license"], k=rng.randint(0, 30)), *words, "after"]))
    told = {r.doc_id: r for r in ls.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    listed = [re.findall("[a-z0-9\u0080-￿]+", (t or "").lower()) for t in texts]
    df = Counter(w for words in listed for w in set(words))
    idf = lambda w: math.log((1 + len(texts)) / (1 + df[w]))
    seen = set()
    for i, words in enumerate(listed):
        want = {label for phrase, label in ls.BASE.items() if f" {phrase} " in f" {' '.join(words)} "}
        for label, text, must in ls.TEMPLATES:
            own = re.findall("[a-z0-9]+", text.lower())
            total = sum(map(idf, own))
            good = all(f" {p} " in f" {' '.join(words)} " for p in must)
            if good and any(sum(idf(w) for k, w in enumerate(own) if 0 <= s + k < len(words) and words[s + k] == w) >= ls.SUPPORT * total - 1e-6 for s in range(-len(own), len(words))):
                want.add(label)
        seen |= want
        assert told[i].labels == ",".join(sorted(want)), texts[i]
    assert {"apache-2.0", "mpl-2.0", "agpl-3.0", "lgpl-3.0", "epl-2.0", "cc-by"} <= seen
