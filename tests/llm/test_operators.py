"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows,
empty tables and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from pagegrain.llm import byte_bpe, decontaminate, html_extract, language_id, license_scan, multi_index, ngram_join, substring_dedup, token_records, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, class string, label string, factors string, start int"
BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "own", "own", "own", "own", 7) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdeéßñ", k=rng.randint(1, 7))) for _ in range(60)]
    passage = " ".join(rng.choices(words, k=80))
    base = rng.choices(words, k=120)
    out = [(None, "no id here at all", "en"), (1, None, "en"), (2, "", None), (3, " \t\n", "en"), (4, "one two", "en"), (5, "ONE two", "en"), (6, "日本語 テキスト 123 !!", "fr")]
    for i in range(10, 40):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append((i, " ".join(w), "de"))
    out += [(i, f"{' '.join(rng.choices(words, k=rng.randint(0, 70)))}\n{passage} {' '.join(rng.choices(words, k=20))}", "es") for i in range(40, 60)]
    out += [(60, out[-1][1], "es"), (60, out[-1][1], "es"), (61, " ".join(["same"] * 400), "en"), (62, " ".join(["same"] * 300), "en"), (63, "x " * 150_000, "en"), (60, "another text under a known id", "en")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return docs_of(spark, rows).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [(1, "x", "en")]).where("false")


def words_of(text):
    return (text or "").encode().split()


def test_byte_bpe_equals_tiktoken(docs, rows, empty):
    import tiktoken

    bpe = byte_bpe.encoder(BPE, public_tokenizers.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    got = sorted(map(tuple, byte_bpe.round_trip(docs, BPE, public_tokenizers.PATTERN).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = ref.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert byte_bpe.round_trip(empty, BPE, public_tokenizers.PATTERN).count() == 0
    ids = byte_bpe.encode(docs, BPE, public_tokenizers.PATTERN)
    assert {(r.doc_id, bytes(r.decoded).decode()) for r in byte_bpe.decode(ids, BPE, public_tokenizers.PATTERN).collect()} == {(i, t or "") for i, t, _ in rows}


def test_minimal_perfect_hash():
    keys = [str(i).encode() * (i % 5 + 1) for i in range(3000)]
    assert sorted(byte_bpe.MinimalPerfectHash(keys).places(keys)) == list(range(3000))


def test_long_text_in_parts(monkeypatch):
    bpe = byte_bpe.encoder(BPE, public_tokenizers.PATTERN)
    text = "Ein längerer Text, 123 times; " * 50
    whole = bpe.ids([text])
    monkeypatch.setattr(byte_bpe, "AT_ONCE", 64)
    assert bpe.ids([text, "a", ""]) == [whole[0], *bpe.ids(["a", ""])]


def test_token_records(docs, rows, empty, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = token_records.token_records(docs, path).orderBy("start").collect()
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(i for i, _, _ in rows if i is not None)
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    crc = lambda t: zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == sorted((str(i), crc(t)) for i, t, _ in rows)
    assert token_records.token_records(empty, path).count() == 0
    record = token_records.frame(b"payload")
    assert token_records.unframe(record) == b"payload"
    for k in (0, 9, 14, len(record) - 1):
        with pytest.raises(ValueError):
            token_records.unframe(record[:k] + bytes([record[k] ^ 1]) + record[k + 1 :])


def dedup_by_hand(rows, window=50):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            w = words_of(t)
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, t, _ in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, w, gone))
    return out


def test_substring_dedup(docs, rows, empty):
    rows = [r if len(r[1] or "") < 100_000 else r for r in rows]
    want = [(i, len(w), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(w, g, strict=True) if not y)).hexdigest()) for i, w, g in dedup_by_hand(rows)]
    got = [tuple(r) for r in substring_dedup.substring_dedup(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[2] > 0 for r in want) > 10
    assert substring_dedup.substring_dedup(empty).count() == 0
    cut = substring_dedup.remove_copies(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    kept = {str((i, " ".join(x.decode() for x, y in zip(w, g, strict=True) if not y))) for i, w, g in dedup_by_hand(rows)}
    assert {str((r.doc_id, " ".join(x.decode() for x in words_of(r.text)))) for r in cut.collect()} == kept
    assert cut.where("row_key = 'own' and factors = 'own'").count() == len(rows)


def test_substring_factors(spark):
    rng = random.Random(8)
    one, two = ([f"w{rng.randrange(10**6)}" for _ in range(300)] for _ in range(2))
    three = ["x"] * 7 + one[20:190] + ["y"] * 3 + two[100:160] + one[200:249]  # the last copy is one word too short
    four = one[:60] + two[:60]  # two factors that meet
    rows = [(1, " ".join(one), "en"), (2, " ".join(two), "en"), (3, " ".join(three), "en"), (4, " ".join(four), "en"), (None, " ".join(one), "en")]
    found = {r.doc_id: [tuple(f) for f in r.factors] for r in substring_dedup.copied_factors(docs_of(spark, rows)).collect()}
    assert found == {3: [(7, 170, 1, 20), (180, 60, 2, 100)], 4: [(0, 60, 1, 0), (60, 60, 2, 0)]}
    start, size, source, at = substring_dedup.parsed(*(np.array(x) for x in ([5, 0, 90, 60], [60, 60, 50, 50], [1, 1, 3, 2], [25, 20, 7, 0])))
    assert (start.tolist(), size.tolist(), source.tolist(), at.tolist()) == ([0, 60, 90], [65, 50, 50], [1, 2, 3], [20, 0, 7])


def test_substring_dedup_in_segments(docs, rows, monkeypatch):
    whole = sorted(map(str, substring_dedup.substring_dedup(docs).collect()))
    hashes = np.arange(1000, dtype=np.uint64)
    monkeypatch.setattr(substring_dedup, "SEGMENT", 64)
    cut = [(a, b) for a, b in substring_dedup.segments(1000, 50)]
    assert all(any(a <= s and s + 50 <= b for a, b in cut) for s in range(951)) and len(cut) == 15
    blocks = [substring_dedup.segment_blocks(hashes[a:b], 50) for a, b in cut]
    assert sum(int(size.sum()) for _, size, _, _ in blocks) == 951
    assert len(whole) == len(rows)


def test_columns_with_names_of_helpers(spark):
    text = " ".join(f"w{k}" for k in range(80))
    own = ["own_text_key", "factors_doc", "factors_text", "factors_found", "kept_key", "kept_doc", "kept_repeated", "kept_own_key", "key", "id", "row"]
    some = spark.createDataFrame([(i, text, *["own"] * len(own)) for i in (1, 2)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in own))
    cut = substring_dedup.remove_copies(some)
    assert cut.columns == some.columns and sorted((r.doc_id, r.text, r.key) for r in cut.collect()) == [(1, text, "own"), (2, "", "own")]
    kept = ngram_join.keep_one(some)
    assert kept.columns == some.columns and [r.doc_id for r in kept.collect()] == [1]


def test_long_words_hash_in_parts(monkeypatch):
    from pagegrain.llm import words

    data = np.random.default_rng(1).integers(97, 123, 5000).astype(np.uint8)
    want = words.word_hashes(data, np.array([0]), np.array([5000]))
    monkeypatch.setattr(words, "CHUNK", 256)
    assert words.word_hashes(data, np.array([0]), np.array([5000])) == want


def shingles(t):
    w = [x.lower() for x in words_of(t)]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components_by_hand(rows):
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for k, (i, _, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    return [(i, len(sets[k]), min((x for x in groups[find(k)] if x is not None), default=None) if sets[k] else i) for k, (i, _, _) in enumerate(rows)]


def test_ngram_join(docs, rows, empty):
    want = components_by_hand(rows)
    assert sorted(map(tuple, ngram_join.ngram_join(docs).collect()), key=str) == sorted(want, key=str)
    assert sum(i != c for i, _, c in want) > 5
    assert ngram_join.ngram_join(empty).count() == 0
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted({str(r.doc_id) for r in kept.collect()}) == sorted({str(i) for i, n, c in want if n == 0 or i is None or i == c})


def test_divide_skip_and_groups():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(5, 50))).astype(np.uint64) for _ in range(60)]
    index = {}
    for k, s in enumerate(sets):
        for x in s.tolist():
            index.setdefault(x, []).append(k)
    for q in sets[:20]:
        for least in (1, 3, 8, len(q)):
            want = {(k, len(np.intersect1d(q, s))) for k, s in enumerate(sets) if len(np.intersect1d(q, s)) >= least}
            assert set(ngram_join.divide_skip(q.tolist(), index, least)) == want
    base = np.arange(100, dtype=np.uint64)
    many = [np.unique(np.where(rng.random(100) < 0.06, rng.integers(0, 999, 100), base).astype(np.uint64)) for _ in range(60)]
    groups = list(range(60))

    def find(x):
        while groups[x] != x:
            x = groups[x]
        return x

    for a, b in ngram_join.link_group(many):
        assert 100 * len(np.intersect1d(many[a], many[b])) >= 80 * len(np.union1d(many[a], many[b]))
        groups[find(a)] = find(b)
    for a in range(60):
        for b in range(a):
            if 100 * len(np.intersect1d(many[a], many[b])) >= 80 * len(np.union1d(many[a], many[b])):
                assert find(a) == find(b)


def test_language_id(spark, docs, empty):
    found = {str(r.doc_id) + (r.lang_pred or ""): r for r in language_id.language_id(docs).collect()}
    assert found["1und"].score == 0 and found["2und"].rejected and found["3und"].rejected
    assert all(0 <= r.score <= 1 for r in found.values())
    assert language_id.language_id(empty).count() == 0
    assert language_id.accepted(docs).columns == docs.columns
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = language_id.language_id(real).join(real.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.95
    assert np.mean([r.rejected for r in out]) < 0.02


def test_language_id_rejects_other_languages(spark):
    import pyarrow as pa

    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(real)
    other = ["To jest zdanie po polsku, które nie należy do żadnego z języków.", "Ez egy magyar mondat, amely nem tartozik a tanult nyelvek közé.", "Tämä on suomenkielinen lause, joka ei kuulu opetettuihin kieliin.", "日本語の文章です。これは学習されていません", "xkcd qzvw pfff grrt zxqj wqkz hjkl vvxz", "Это предложение на русском языке"]
    assert model.answers(pa.array(other))[1].all()
    out = language_id.language_id(real).join(real.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    right = [r for r in out if r.lang == r.lang_pred]
    assert len(right) > 0.99 * len(out) and sum(r.rejected for r in right) <= 0.005 * len(right) + 1
    text = real.where("text is not null").limit(50).toPandas()["text"].str.cat(sep=" ")
    whole = model.answers(pa.array([text, text[:3000]]))
    small = language_id.PART
    try:
        language_id.PART = 500
        again = model.answers(pa.array([text, text[:3000]]))
    finally:
        language_id.PART = small
    assert np.allclose(whole[0], again[0], atol=1e-6) and (whole[1] == again[1]).all()


def test_decontaminate(spark, docs, empty):
    rng = random.Random(1)
    for _ in range(200):
        p, t = ("".join(rng.choices("abc", k=rng.randint(a, b))) for a, b in ((1, 10), (0, 25)))
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        got = decontaminate.myers(p, t, 99)
        assert (got[0] if got else len(p)) == min(row[1:], default=len(p))
    item = "The quick brown fox jumps over the lazy dog while seven wizards brew strong potions at noon"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, "x")], "item_id long, text string")
    texts = [(1, f"before {item} after"), (2, "see: " + item.upper().replace(" ", "  ")), (3, item.replace("quick", "quack").replace("noon", "moon")), (4, item[: len(item) // 2]), (5, None), (6, "nothing here")]
    some = docs_of(spark, [(i, t, "en") for i, t in texts])
    assert sorted((r.doc_id, r.item_id, r.distance) for r in decontaminate.leaks(some, bench).collect()) == [(1, 1, 0), (2, 1, 0), (3, 1, 2)]
    clean = decontaminate.without_leaks(some, bench)
    assert sorted(r.doc_id for r in clean.collect()) == [4, 5, 6] and clean.columns == some.columns
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(docs, bench.where("false")).count() == 0


def edits(p, t):
    """Smallest distance of p to a substring of t, by the whole matrix."""
    row = np.zeros(len(t) + 1, dtype=int)
    for i, x in enumerate(p, 1):
        step = np.minimum(row[1:] + 1, row[:-1] + np.array([x != y for y in t]))
        row = np.concatenate([[i], step])
        row = np.minimum.accumulate(row - np.arange(len(row))) + np.arange(len(row))
    return int(row.min())


def test_decontaminate_against_the_whole_matrix(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcde", k=rng.randint(2, 8))) for _ in range(40)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice((3, 12, 20))))) for i in range(6)]
    items.append((9, items[0][1]))  # two items with one text

    def edited(text, n):
        for _ in range(n):
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(("", "x", text[at] + "y")) + text[at + 1 :]
        return text

    texts = []
    for i in range(24):
        held = edited(items[i % 6][1], i % 5 * 2)
        texts.append((i, f"{' '.join(rng.choices(words, k=15))}, {held.upper() if i % 2 else held}; {' '.join(rng.choices(words, k=15))}"))
    texts += [(50, texts[0][1]), (50, texts[0][1]), (51, "é. " * 60_000 + items[2][1] + " é" * 60_000), (52, items[1][1][:20])]
    want = []
    for i, text in texts:
        for item_id, item in items:
            p, t = decontaminate.normal(item), decontaminate.normal(text)
            t = t if i != 51 else t[len(t) // 2 - 2000 : len(t) // 2 + 2000]
            if (d := edits(p, t)) <= int(len(p) * decontaminate.RATE):
                want.append((i, item_id, d, len(p)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    some = docs_of(spark, [(i, t, "en") for i, t in texts]).repartition(3)
    got = sorted((r.doc_id, r.item_id, r.distance, r.n_chars) for r in decontaminate.leaks(some, bench).collect())
    assert got == sorted(want)
    assert len({d for _, _, d, _ in got}) >= 4 and 51 in {r[0] for r in got}  # exact and edited copies occur, and the long text's
    hit = {r[0] for r in want}
    assert sorted(r.doc_id for r in decontaminate.without_leaks(some, bench).collect()) == sorted(i for i, _ in texts if i not in hit)


def test_multi_index(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[200:700] = x[0]  # a third of all rows are one vector
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9000, None), (9020, [0.0] * 16), (9040, [float("nan")] * 16), (9060, [None] * 16), (None, [1.0] * 16), (9080, [1.0])]
    got = multi_index.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).toPandas()
    scores, hit = x.astype(float) @ x.astype(float).T, 0
    for q, found in got.groupby("query_id"):
        order = [i for i in np.lexsort((np.arange(1500), -np.round(scores[q], 9))) if i != q][:20]
        assert found.sort_values("rank")["rank"].tolist() == list(range(1, 21))
        hit += len(set(order) & set(found["vec_id"]))
    assert len(got) == 75 * 20 and hit >= 0.9 * 75 * 20
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in multi_index.search(few).collect()] == [(0, 1, 1, 4.0)]
    assert multi_index.search(few.where("false")).count() == 0


def test_multi_index_recall_and_order(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").toPandas().sort_values("vec_id")
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(float)
    given = spark.createDataFrame([(int(i), v.tolist(), "own", "own", 1) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, entry string, block string, rank int")
    got = multi_index.search(given.repartition(3)).toPandas()
    hit = want = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        order = [k for k in np.lexsort((ids, -score)) if k != q][:20]
        found = got[got["query_id"] == ids[q]].sort_values("rank")
        assert found["rank"].tolist() == list(range(1, 21)) and ids[q] not in set(found["vec_id"])
        assert list(zip(-found["score"], found["vec_id"])) == sorted(zip(-found["score"], found["vec_id"]))
        at = np.searchsorted(ids, found["vec_id"])
        assert np.allclose(found["score"], score[at], rtol=1e-12, atol=1e-12)
        hit += len(set(ids[order]) & set(found["vec_id"]))
        want += 20
    assert hit >= 0.9 * want
    ties = spark.createDataFrame([(i, [1.0, float(i == 5)]) for i in (0, 3, 5, 7, 9)], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id) for r in multi_index.search(ties).orderBy("rank").collect()] == [(1, 3), (2, 5), (3, 7), (4, 9)]


def test_html_extract(spark):
    page = """<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></nav>
    <div class="ad">Buy now &amp; save</div><article><h1>A &lt;title&gt;</h1><p>First   paragraph with <b>bold</b> text, long enough to be read as an article's paragraph.</p><p><b>Second<br><p>Third &eacute;</article>
    <section class="comments"><h3>Comments</h3><div class="comment"><p>nice post</p></div></section><footer>&copy; x</footer></body></html>"""
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p"), (None, "z", page)], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    assert got[1].text == "A <title>\nFirst paragraph with bold text, long enough to be read as an article's paragraph.\nSecond\nThird é"
    assert got[1].n_chars == len(got[1].text) and got[None].text == got[1].text
    assert got[2].text == got[3].text == ""
    rng, model, wrong = random.Random(77), html_extract.trained(), 0
    for _ in range(100):
        dom = html_extract._Marked()
        dom.feed(html_extract.written_page(rng))
        nodes = html_extract.nodes_of(dom.root)
        side = {}
        for n in nodes:
            side[id(n)] = -1 in n.tokens or (n.parent is not None and side[id(n.parent)])
        for n in nodes:
            n.tokens -= {-1}
        keep = html_extract.decode(nodes, model.log_odds(html_extract.features(nodes)))
        wrong += sum(n.own for n, k in zip(nodes, keep, strict=True) if k == side[id(n)]) > 0.02 * nodes[0].total
    assert wrong <= 15


def test_html_extract_without_end_tags():
    def said(html):
        nodes = html_extract.nodes_of(html_extract.parse(html))
        return html_extract.main_text(nodes, [True] * len(nodes)).split()

    assert said("<html><head><title>x</title><body><article><p>one</p></article></body></html>") == ["one"]
    assert said("<head><title>x</title><meta a=b><script>v</script><article><p>one</p></article>") == ["one"]
    assert said("<head><title>x</title>one <p>two") == ["one", "two"]
    assert said("<div><form>x</div><p>one</p></form>two") == ["x", "one", "two"]
    for tag in ("button", "select", "noscript", "object", "svg", "textarea", "title", "template"):
        assert said(f"<body><p>a</p><{tag}><p>one</p><p>two</p></body>") == ["a", "one", "two"], tag
        assert said(f"<div><{tag}><p>one</p></div><p>two</p>") == ["one", "two"], tag
        assert said(f"<div><{tag}>x</{tag}>one</div><p>two</p>") == ["one", "two"], tag
    assert said("<div><button>x</div><p>one</p></button>two") == ["one", "two"]
    assert said("<select><option>x<option>y</select>one") == said("<title>a <b> c</title>one") == ["one"]
    assert said("one<script>x <p>y</p>") == ["one"]


def test_html_extract_of_odd_pages(spark):
    said = "Plain sentences of an article that go on for a while, as articles do."
    article = f"<article><h1>T</h1>{f'<p>{said}</p>' * 8}</article>"
    want = "\n".join(["T", *[said] * 8])
    odd = [
        f"<div class='post comment-enabled with-sidebar'>{article}</div>",
        f"<body><form><nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></nav>{article}</form></body>",
        f"<body><form>{article}",
        f"<body><button>{article}",
        f"<body><noscript>{article}",
        f"<body>{'<div>' * 3000}{article}{'</div>' * 3000}{'</p></section>' * 3000}</body>",
    ]
    rows = [(i, "u", h, "own", "own") for i, h in enumerate([*odd, odd[0]])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert got == dict.fromkeys(range(7), want)
    long = spark.createDataFrame([(1, "u", f"<body><article>{f'<p>{said}</p>' * 20000}</article></body>")], "page_id long, url string, html string")
    assert html_extract.extract(long).first().text == "\n".join([said] * 20000)
    assert html_extract.extract(long.where("false")).count() == 0


def test_html_extract_of_pages(spark):
    import re

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    pages = {r.page_id: r.html for r in rows.collect()}
    found = 0
    for r in html_extract.extract(rows).collect():
        at = re.search(r"<article[^>]*>(.*?)</article>", pages[r.page_id] or "", re.S)
        if at and r.text:
            found += 1
            held = html_extract.nodes_of(html_extract.parse(at.group(1)))
            whole = html_extract.main_text(held, [True] * len(held)).split("\n")
            assert set(r.text.split("\n")) <= set(whole) and r.n_chars == len(r.text)
    assert found > 100


def test_html_features_count_all_siblings():
    nodes = html_extract.nodes_of(html_extract.parse("<div>" + "<h2>t</h2>" * 70 + "<p>one</p>" * 90 + "</div>"))
    same = html_extract.features(nodes)[:, 9]
    assert {(n.tag, s) for n, s in zip(nodes, same, strict=True)} == {("root", 0), ("div", 1), ("h2", 70), ("p", 90)}


def test_url_filter(spark):
    urls = ["http://A.Example.NET/en/1?x", "http://x.net/de/1", "http://m.example.com/de/5#t", "https://b.org/fr/", "no scheme", None, "http://host", "ftp://h.org/a/b/c/d/e/f/g/h", "http://b.org/fr"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect()}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1] == ("x.net", "/de/1", "net/", "block")
    assert got[2] == ("m.example.com", "/de/5", "example.com/de/", "block")
    assert got[3] == ("b.org", "/fr/", "org/fr/", "allow")
    assert got[4] == got[5] == ("", "", None, "allow")
    assert got[6] == ("host", "", None, "allow") and got[8][2] is None
    assert url_filter.filter_urls(pages.where("false")).count() == 0
    labelled = spark.createDataFrame([(i, f"http://s.tld/{'junk' if i < 60 else 'good'}/{i}", 1 if i < 50 else 0 if i < 110 and i >= 60 else None) for i in range(120)], "page_id long, url string, bad int")
    verdicts = {r.page_id: r.verdict for r in url_filter.filter_urls(labelled, bad="bad").collect()}
    assert verdicts[55] == "block" and verdicts[115] == "allow"


def test_url_filter_of_deep_paths(spark):
    deep = [(i, f"http://s.tld/a/b/c/d/e/f/{'spam' if i % 2 else 'fine'}/x{i % 7}/{i}", None if i > 100 else i % 2) for i in range(120)]
    rows = spark.createDataFrame([*deep, (200, "http://t.tld/" + "/".join("abcdefghijkl") + "/one.html", None)], "page_id long, url string, bad int")
    got = {r.page_id: (r.template, r.verdict) for r in url_filter.filter_urls(rows, rules=(), bad="bad").collect()}
    assert [got[i][1] for i in (101, 102, 103, 104)] == ["block", "allow", "block", "allow"]
    assert got[101][0] != got[102][0] and got[200] == ("/a/b/c/d/e/f/g/h/i/j/k/l/one.html", "allow")


def test_url_filter_blocks_what_looks_like_a_blocked_branch(spark):
    urls = [f"http://example.com/de/item{k}/{k}" for k in range(60)] + [f"http://example.com/dea/item{k}/{k}" for k in range(20)]
    urls += [f"http://example.com/about{k}.html" for k in range(9)] + [f"http://b.org/fr/{k}" for k in range(30)] + [f"http://b.org/en/{k}" for k in range(20)]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, template string, label string")
    got = [r for r in url_filter.filter_urls(pages).collect()]
    by = {r.page_id: r for r in got}
    assert {by[k].verdict for k in range(80)} == {"block"} and {by[k].rule for k in range(60, 80)} == {None}
    assert by[0].template == by[70].template == "/{de..}/*/<n>"
    assert {by[k].verdict for k in range(80, len(urls))} == {"allow"}


def rule_by_hand(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, None)


def test_url_filter_against_plain_python(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    urls = {r.page_id: r.url for r in pages.collect()}
    got = url_filter.filter_urls(pages).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, verdict = rule_by_hand(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)


def base_by_hand(text):
    import re

    words = [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode())]
    at = {label: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p, label in license_scan.BASE.items()}
    every = [i for x in at.values() for i in x]
    return len(words), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(k for k, x in at.items() if x))


def test_license_scan_base_against_plain_python(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in rows.collect()}
    got = license_scan.license_scan(rows).collect()
    assert len(got) == len(texts) and sum(r.n_base > 0 for r in got) > 5
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_by_hand(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_license_scan_of_long_and_unlicensed_texts(spark):
    long = "the software is free of charge and any person may use it without restriction under these terms " * 40_000
    full = license_scan.TEMPLATES[1][1]
    rows = [(1, long, "en"), (2, long + full, "en"), (2, long + full, "en"), (3, "all rights reserved; no licence is granted to anyone", "en"), (4, "we discussed the mozilla public license at length yesterday", "en"), (5, full[: len(full) // 4], "en")]
    got = sorted((r.doc_id, r.labels) for r in license_scan.license_scan(docs_of(spark, rows)).collect())
    assert got == [(1, ""), (2, "mit"), (2, "mit"), (3, ""), (4, ""), (5, "")]


def test_license_scan(docs, spark, empty):
    texts = [(1, "Released under the MIT License. mit-license, MIT licenses"), (2, "the GNU General  Public\nLicense"), (3, None), (4, "Licensed under CC BY-NC 4.0"), (5, "plain words of no kind é"), (6, "Apache License and MIT license")]
    got = {r.doc_id: r for r in license_scan.license_scan(docs_of(spark, [(i, t, "en") for i, t in texts])).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 3, 5, "mit")
    assert (got[2].n_base, got[2].base_labels, got[2].first_word) == (1, "gpl", 2)
    assert (got[3].n_words, got[3].n_base, got[3].first_word, got[3].labels, got[3].score) == (0, 0, None, "", 0.0)
    assert got[4].labels == "cc-by-nc" and got[4].base_labels == ""
    assert got[5].n_words == 6 and got[5].labels == "" and got[6].base_labels == "apache,mit"
    assert license_scan.license_scan(docs).count() == docs.count() and license_scan.license_scan(empty).count() == 0


def test_license_scan_of_joined_notices(spark):
    notice = {label: text for label, text, _ in license_scan.TEMPLATES}
    joined = [notice["mit"], notice["bsd"], notice["mpl"], notice["cc-by"]]
    common = [(i, f"{notice['bsd']} {notice['mpl']} {notice['cc-by']}", "en") for i in range(2, 30)]
    rows = [(0, " filler ".join(joined), "en"), (1, " filler ".join(license_scan.TEMPLATES[i][1] for i in range(len(license_scan.TEMPLATES))), "en"), *common]
    got = {r.doc_id: r.labels for r in license_scan.license_scan(docs_of(spark, rows)).collect()}
    assert got[0] == "bsd,cc-by,mit,mpl"
    assert got[1] == ",".join(sorted(notice))
    assert got[2] == "bsd,cc-by,mpl"


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
            docs = out
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns[0] == "doc_id" and out.count() == 0
