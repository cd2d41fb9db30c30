"""The n-gram join where groups and tables are large."""

import time

import numpy as np

from pagegrain.llm import ngram_join


def near_copies(count, size, share, rng):
    """Sets of shingles of copies in each of which a share of the words differs."""
    out = []
    for _ in range(count):
        word = np.where(rng.random(size) < share, rng.integers(1, 1 << 40, size), np.arange(size) << 41).astype(np.uint64)
        out.append(np.unique(sum(word[k : size - 4 + k] * np.uint64(2 * k + 1) for k in range(5))))
    return out


def linked(a, b):
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both)


def test_near_copies_that_do_not_link_take_little_time():
    sets = near_copies(700, 400, 0.03, np.random.default_rng(4))
    began = time.thread_time()
    links = ngram_join.link_group(sets)
    assert time.thread_time() - began < 4
    assert links and all(linked(sets[a], sets[b]) for a, b in links)
    label = list(range(len(sets)))
    for a, b in links:
        label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    some = range(0, len(sets), 9)
    assert all(label[a] == label[b] for a in some for b in some if b < a and linked(sets[a], sets[b]))
    assert len(set(label)) > 50


def test_links_of_two_blocks():
    sets = near_copies(90, 200, 0.025, np.random.default_rng(5))
    first = np.arange(90) % 3 == 0
    links = ngram_join.link_group(sets, first=first)
    assert all(first[a] and not first[b] and linked(sets[a], sets[b]) for a, b in links)
    label = list(range(90))
    for a, b in links:
        label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    assert all(label[a] == label[b] for a in range(90) for b in range(90) if first[a] != first[b] and linked(sets[a], sets[b]))
    assert ngram_join.link_group(sets, first=first | True) == []


def test_sizes_out_of_reach_are_left_out():
    rng = np.random.default_rng(6)
    n = np.sort(rng.integers(5, 900, 300))[rng.permutation(300)]
    bits = rng.integers(0, 1 << 63, (300, 8)).astype(np.uint64) & rng.integers(0, 1 << 63, (300, 8)).astype(np.uint64)
    bits[::3] = bits[1::3]
    for count in (1, 2, 40, 65, 300):
        want = np.zeros((count, count), bool)
        for a in range(count):
            for b in range(count):
                apart = sum(int(x ^ y).bit_count() for x, y in zip(bits[a], bits[b], strict=True))
                want[a, b] = a != b and 100 * min(n[a], n[b]) >= 80 * max(n[a], n[b]) and 180 * apart <= 40 * (n[a] + n[b])
        assert np.array_equal(ngram_join.possible(n[:count], bits[:count], 80), want)


def test_frequent_shingles_stand_out_at_any_size():
    """Of many parts of a table, each with rare shingles and some of a few thousand that are in many texts."""
    rng = np.random.default_rng(8)
    often = rng.integers(0, 1 << 63, 2000).astype(np.uint64) * np.uint64(2)
    counts = np.zeros(1 << ngram_join.SLOT_BITS, np.uint32)
    for _ in range(30):
        sets = [np.unique(np.concatenate((rng.integers(0, 1 << 63, 30_000).astype(np.uint64) * np.uint64(2) + np.uint64(1), rng.choice(often, 100)))) for _ in range(20)]
        ngram_join.add_repeated(counts, sets)
    rare = rng.integers(0, 1 << 63, 100_000).astype(np.uint64)
    assert (counts[ngram_join.slot_of(often)] >= 2).mean() > 0.99
    assert (counts[ngram_join.slot_of(rare)] == 0).mean() > 0.99


def test_groups_in_blocks(spark, monkeypatch):
    """A line in all texts and groups of near copies that meet in blocks; components by hand."""
    monkeypatch.setattr(ngram_join, "BLOCK", 10)
    monkeypatch.setattr(ngram_join, "TEXTS", 8)
    rng = np.random.default_rng(9)
    common = " ".join(f"c{k}" for k in range(30))
    rows = []
    for k in range(150):
        own = [f"w{k % 6}x{j}" for j in range(120)]
        for j in rng.integers(0, 120, k % 9):
            own[j] = f"r{k}x{j}"
        rows.append((k, " ".join(own) + " " + common))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    label = list(range(150))
    for a in range(150):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs).collect()}
    assert got == {k: (len(sets[k]), label[k]) for k in range(150)}
    assert 6 < len(set(label)) < 140
