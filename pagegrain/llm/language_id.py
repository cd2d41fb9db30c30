"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams; a linear layer and
a softmax give each language's probability.  Both are trained by stochastic gradient
descent in numpy on a bounded sample of labelled rows.  A fifth of each language's rows
is kept out of the training and calibrates: a temperature makes scores
probabilities, and a text is rejected whose probability, or whose share of n-grams
that the training knows, lies below what nearly all right predictions there reach.
The first finds texts between languages, the second texts in none of them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import mix, pieces, utf8

BUCKETS = 1 << 15
GRAMS = (2, 3, 4)
PART = 1 << 18  # bytes of texts whose n-grams are held at once
LOST = 0.001  # share of right predictions on rows kept out of the training that each test may reject
FAR = 1.0  # deviation that chance alone gives: n-grams overlap, so theirs is some three times that of independent ones
MANY = 400  # n-grams beyond which a text's share of known ones is no surer
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
FOLD = np.arange(256, dtype=np.uint8)  # ASCII: letters lower-cased, all else a space
FOLD[:128] = 32
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)


def parts(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the parts of texts: a long text is cut at bytes that fold to a space,
    where no n-gram is lost, so that memory follows its words and not its length."""
    rows, starts, ends = [], [], []
    for row in range(len(offsets) - 1):
        at, last = int(offsets[row]), int(offsets[row + 1])
        while last - at > PART:
            cut = at + PART
            while cut < last and not len(found := np.flatnonzero(FOLD[data[cut : cut + 4096]] == 32)):
                cut += 4096
            if cut >= last:
                break
            rows.append(row)
            starts.append(at)
            ends.append(cut + int(found[0]))
            at = ends[-1] + 1
        rows.append(row)
        starts.append(at)
        ends.append(last)
    return np.array(rows, np.int64), np.array(starts, np.int64), np.array(ends, np.int64)


def subwords(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, buckets, offsets) of the hashed n-grams of blocks of parts of texts: runs of 2 to 4
    bytes with a space at most at their ends.  A long text has several parts, in order."""
    data, offsets = utf8(column)
    rows, starts, ends = parts(offsets, data)
    reach = np.concatenate(([0], np.cumsum(ends - starts)))
    for a, b in pieces(reach, PART):
        size = int(reach[b] - reach[a]) + b - a + 1
        piece = np.full(size, 32, np.uint8)  # a space before each part and at the end
        begin = reach[a:b] - reach[a] + np.arange(b - a)
        for k in range(a, b):
            at = begin[k - a] + 1
            piece[at : at + ends[k] - starts[k]] = FOLD[data[starts[k] : ends[k]]]
        letter = piece != 32
        key = piece.astype(np.uint64)
        found, places = [], []
        ok = np.ones(size, bool)  # no space inside of the run so far
        for n in range(2, max(GRAMS) + 1):
            m = size - n + 1
            if m <= 0:
                break
            key = key[:m] * np.uint64(257) + piece[n - 1 :]
            if n > 2:
                ok = ok[:m] & letter[n - 2 : n - 2 + m]
                use = ok & (letter[:m] | letter[n - 1 :])
            else:
                ok = ok[:m]
                use = letter[:m] | letter[1:]
            if n in GRAMS:
                where = np.flatnonzero(use)
                found.append((mix(key[where] + np.uint64(n)) >> np.uint64(64 - 15)).astype(np.int32))
                places.append(where)
        at = [np.searchsorted(p, np.append(begin, size)) for p in places]
        yield rows[a:b], *_interleave(found, at, b - a)


def _interleave(found: list[np.ndarray], rows: list[np.ndarray], count: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of every length, text by text."""
    if not found:
        return np.zeros(0, np.int32), np.zeros(count + 1, np.int64)
    offsets = np.sum(rows, axis=0)
    out = np.empty(offsets[-1], np.int32)
    shift = offsets[:-1].copy()
    for x, r in zip(found, rows, strict=True):
        sizes = np.diff(r)
        out[np.repeat(shift - r[:-1], sizes) + np.arange(len(x))] = x
        shift += sizes
    return out, offsets


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # embedding times linear layer, for each bucket
    bias: np.ndarray
    temperature: float
    seen: np.ndarray  # buckets that training rows hold
    usual: float  # mean share of seen n-grams in rows kept out of the training
    sure: float  # least calibrated probability
    familiar: float  # least deviation from the usual share, times the root of the number of n-grams, up to MANY

    def answers(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities of each row, equal ones where there are no n-grams, and which rows are rejected."""
        sums, known, sizes = np.zeros((len(column), len(self.languages))), np.zeros(len(column)), np.zeros(len(column))
        for rows, ids, at in subwords(column):
            for k in range(len(rows)):
                some = ids[at[k] : at[k + 1]]
                if len(some):
                    counts = np.bincount(some, minlength=BUCKETS) if len(some) > 4096 else None
                    if counts is None:
                        sums[rows[k]] += self.table[some].sum(0, dtype=np.float64)
                        known[rows[k]] += np.count_nonzero(self.seen[some])
                    else:
                        sums[rows[k]] += counts @ self.table.astype(np.float64)
                        known[rows[k]] += counts[self.seen].sum()
                    sizes[rows[k]] += len(some)
        size = np.maximum(sizes, 1)
        logits = np.where(sizes[:, None] > 0, (sums / size[:, None] + self.bias) / self.temperature, 0.0)
        p = softmax(logits)
        return p, (p.max(1) < self.sure) | ((known / size - self.usual) * np.sqrt(np.minimum(size, MANY)) < self.familiar)


def lowest(x: np.ndarray) -> float:
    """A bound that hardly any value like these lies below: the quantile LOST, but no nearer than six
    deviations, and more of them the fewer values there are to know the tail by."""
    return float(min(np.quantile(x, LOST), x.mean() - (6 + 100 / len(x)) * x.std()))


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, languages: list[str], dims: int = 16, epochs: int = 8, batch: int = 16, least_steps: int = 400, rate: float = 0.5, seed: int = 7) -> Model:
    """SGD over (buckets, counts) rows.  Every row also appears as a small random draw of its
    n-grams, so that short texts are learnt too.  A fifth of each language's rows calibrates."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    rank = np.zeros(len(rows), np.int64)  # of a row among those of its language
    for c in range(len(languages)):
        rank[order[labels[order] == c]] = np.arange((labels == c).sum())
    held, used = order[rank[order] % 5 == 4], order[rank[order] % 5 != 4]
    embedding = rng.normal(0, 0.1, (BUCKETS, dims)).astype(np.float32)
    layer, bias = np.zeros((dims, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    layer += rng.normal(0, 0.1, layer.shape)
    epochs = max(epochs, -(-least_steps // -(-len(used) // batch)))  # more rounds over few rows
    steps, step = epochs * -(-len(used) // batch), 0
    for _ in range(epochs):
        rng.shuffle(used)
        for a in range(0, len(used), batch):
            ids, weights, owner, target = [], [], [], []
            for k in used[a : a + batch]:
                buckets, counts = rows[k]
                total = counts.sum()
                sums = np.cumsum(counts)
                m = int(np.exp(rng.uniform(np.log(8), np.log(400))))
                drawn = np.minimum(np.searchsorted(sums, rng.uniform(0, total, m), "right"), len(buckets) - 1)
                for i, w in ((buckets, counts / total), (buckets[drawn], np.full(m, 1 / m))):
                    ids.append(i)
                    weights.append(w)
                    owner.append(np.full(len(i), len(target)))
                    target.append(labels[k])
            ids, weights, owner, target = np.concatenate(ids), np.concatenate(weights).astype(np.float32), np.concatenate(owner), np.array(target)
            first = np.searchsorted(owner, np.arange(len(target)))
            hidden = np.add.reduceat(embedding[ids] * weights[:, None], first, axis=0)
            error = softmax(hidden @ layer + bias).astype(np.float32)
            error[np.arange(len(target)), target] -= 1
            error /= len(target)
            speed = np.float32(rate * (1 - step / steps))
            back = error @ layer.T
            layer -= speed * (hidden.T @ error)
            bias -= speed * error.sum(0)
            np.add.at(embedding, ids, -speed * 40 * len(target) / 4 * weights[:, None] * back[owner])
            step += 1
    table = embedding @ layer
    seen = np.zeros(BUCKETS, bool)
    for k in used:
        seen[rows[k][0]] = True
    if not len(held):  # too few rows to calibrate: nothing with a letter is rejected
        return Model(languages, table.astype(np.float32), bias, 1.0, seen, 0.0, 0.0, 0.0)
    logits, shares, sizes, truth = [], [], [], []
    for k in held:  # whole rows, and small draws as in the training
        buckets, counts = rows[k]
        m = int(np.exp(rng.uniform(np.log(8), np.log(400))))
        drawn = buckets[np.minimum(np.searchsorted(np.cumsum(counts), rng.uniform(0, counts.sum(), m), "right"), len(buckets) - 1)]
        for i, w in ((buckets, counts), (drawn, np.ones(m))):
            logits.append((table[i] * (w / w.sum())[:, None]).sum(0) + bias)
            shares.append(float(w[seen[i]].sum() / w.sum()))
            sizes.append(w.sum())
            truth.append(labels[k])
    logits, shares, sizes, truth = np.array(logits), np.array(shares), np.array(sizes), np.array(truth)
    scale = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in scale]
    temperature = float(scale[np.flatnonzero(np.array(loss) <= min(loss) + 1e-4)[-1]])  # the mildest of equally good ones
    p = softmax(logits / temperature)
    right = p.argmax(1) == truth
    if not right.any():
        return Model(languages, table.astype(np.float32), bias, temperature, seen, 0.0, 0.0, 0.0)
    usual = float(shares[::2].mean())
    away = (shares - usual) * np.sqrt(np.minimum(sizes, MANY))
    best = np.clip(p.max(1)[right], 1e-12, 1 - 1e-12)
    sure = 1 / (1 + np.exp(-lowest(np.log(best / (1 - best)))))
    return Model(languages, table.astype(np.float32), bias, temperature, seen, usual, float(sure), min(lowest(away[right]), -FAR))


def _counts(batches):
    for batch in batches:
        ids, counts = [b""] * len(batch), [b""] * len(batch)
        last, total = None, np.zeros(0)
        for rows, found, at in subwords(batch.column(1)):
            for k, row in enumerate(rows.tolist()):
                more = np.bincount(found[at[k] : at[k + 1]], minlength=BUCKETS)
                total = total + more if row == last else more
                last = row
                live = np.flatnonzero(total)
                ids[row], counts[row] = live.astype("<i4").tobytes(), total[live].astype("<f4").tobytes()
        yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["lang", "ids", "counts"])


def held_out() -> Column:
    """crc32(doc_id as text) mod 3 is 1; false without a doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, per_language: int = 500, at_most: int = 8000, most_languages: int = 400) -> Model | None:
    """A model from rows that have an id, a lang and a text and are not held out: of each of the
    most_languages commonest languages the per_language rows with the smallest hashes, or fewer,
    so that at_most rows come together.  None if there are no such rows."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    common = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(min(most_languages, at_most))
    sizes = {r["lang"]: r["n"] for r in common.collect()}
    if not sizes:
        return None
    k = max(1, min(per_language, at_most // len(sizes)))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 3 * k / n + 20 / n))])
    h = F.xxhash64("doc_id", "text")
    some = rows.withColumn("h", h).where(F.pmod("h", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= k)
    got = some.select("lang", "text").mapInArrow(_counts, "lang string, ids binary, counts binary").collect()
    got = sorted((r for r in got if r["ids"]), key=lambda r: (r["lang"], bytes(r["ids"]), bytes(r["counts"])))
    if not got:
        return None
    languages = sorted({r["lang"] for r in got})
    labels = np.array([languages.index(r["lang"]) for r in got])
    return train([(np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["counts"], "<f4")) for r in got], labels, languages)


def predict(docs: DataFrame, model: Model | None) -> Column:
    """A struct of lang, score and rejected for the whole text of each row of docs.

    A null text, and one without a letter, is `und` with score 0 and rejected; so is every
    text if there was nothing to learn from.  Otherwise lang is a learned language, score
    its calibrated probability, and rejected says that it fails one of the model's two
    tests.  Equal texts get equal answers."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def run(text):
        import pandas as pd

        known = shared.value
        column = pa.array(text, pa.string())
        has = np.array([bool(x is not None and LETTER.search(x)) for x in text], bool)
        lang, score = np.full(len(text), UNKNOWN, object), np.zeros(len(text))
        if known is not None and has.any():
            p, strange = known.answers(column)
            lang[has] = np.array(known.languages, object)[p.argmax(1)][has]
            score[has] = p.max(1)[has]
        rejected = ~has | (strange if known is not None and has.any() else True)
        return pd.DataFrame({"lang": lang, "score": score, "rejected": rejected})

    return run(F.col("text").cast("string"))


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row, by a model of the rows not held out."""
    found = docs.select("doc_id", predict(docs, fit(docs)).alias("found"))
    return found.select("doc_id", held_out().alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.rejected").alias("rejected"))


def accepted(docs: DataFrame) -> DataFrame:
    """docs, all columns, without the rows that the model rejects."""
    return docs.where(~predict(docs, fit(docs))["rejected"])
