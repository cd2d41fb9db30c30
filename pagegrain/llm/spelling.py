"""Spelling variants: words one edit apart, and the form that each variant stands for.

A word's mask holds the parity of each letter's count.  Inserting or deleting a letter flips one bit,
replacing one flips at most two, so of three bands of the mask at least one stays equal.  Nor
can one edit touch both ends of a word: its first or its last letters stay.  Words meet where
a band, an end and the length agree (a word also looks among those one letter longer), so that
a bucket holds few words however large the vocabulary is; the join itself verifies parity and
edit distance, and yields a pair at the first band and end that the two have in common.

Forms point from rare words to frequent ones by a fixed ratio, so chains are short; roots are found by
pointer jumping."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialise

LEAST, OFTEN, RATIO, TYPO = 6, 5, 5, 199
RUN = re.compile("[a-zÀ-ÿ]+")
WHOLE = 1 << 20  # characters of a text whose words may be held at once
HELD = 1 << 18  # words that a task counts before it hands them on
BITS = 90  # 26 letters from a, 64 from U+00C0; others share a bit, which keeps the bound


def runs(text: str) -> Counter:
    lower = text.encode().lower().decode()  # bytes.lower changes A-Z alone
    return Counter(RUN.findall(lower) if len(lower) < WHOLE else (m[0] for m in RUN.finditer(lower)))


def counted(batches, least: int) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            own = "" if doc_id.as_py() is None else doc_id.as_py()
            key = zlib.crc32(f"{own}:".encode())
            for run, n in runs(text.as_py()).items():
                if len(run) >= least:
                    h = zlib.crc32(run.encode(), key)
                    if h % TYPO == 0:
                        run = run[: h % len(run)] + run[h % len(run) + 1 :]
                        if len(run) < least:
                            continue
                    held[run] += n
            if len(held) > HELD:
                yield out()
                held.clear()
    if held:
        yield out()


def word_counts(docs: DataFrame, least: int = LEAST, often: int = OFTEN) -> DataFrame:
    """word, n: runs of letters of all whole texts, lower-case in A-Z, with the deletions that the
    checksum of doc_id and run asks for.  Words are counted in each task before they are shuffled.
    A null text has none, a null doc_id counts as empty, repeated rows count each."""
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.mapInArrow(lambda batches: counted(batches, least), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _bands(word: str) -> list[Column]:
    """The mask in three parts; letters are dealt to them in turn."""
    code = F.transform(F.split(word, ""), lambda c: F.pmod(F.ascii(c) - F.when(F.ascii(c) < 128, 97).otherwise(166), F.lit(BITS)))

    def band(b: int) -> Column:
        return F.aggregate(F.filter(code, lambda c: c % 3 == b), F.lit(0), lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1), F.floor(c / 3).cast("int"))))

    return [band(b).alias(f"m{b}") for b in range(3)]


def near_pairs(words: DataFrame, least: int = LEAST) -> DataFrame:
    """a, a_n, b, b_n: each pair of words(word, n) that differ by one edit, once.  Words are distinct
    and have `least` letters or more; shorter ones aren't looked at."""
    end = least // 2
    w = words.where(F.char_length("word") >= least).select("word", "n", F.char_length("word").alias("size"), F.substring("word", 1, end).alias("head"), F.expr(f"right(word, {end})").alias("tail"), *_bands("word"))

    def entries(size: Column) -> list[Column]:
        return [F.struct(F.lit(b).alias("band"), F.lit(s).alias("side"), F.xxhash64(F.lit(b), F.lit(s), F.col(f"m{b}"), e, size).alias("key")) for b in range(3) for s, e in enumerate(("head", "tail"))]

    own = F.col("size")
    w = w.withColumns({"index": F.array(*entries(own)), "probe": F.array(*entries(own), *entries(own + 1))})
    some = ("word", "n", "size", "head", "tail", "m0", "m1", "m2")
    right = w.select(*(F.col(c).alias(f"b_{c}") for c in some), F.inline("index")).toDF(*(f"b_{c}" for c in some), "b_band", "b_side", "key").drop("b_band", "b_side")
    left = w.select(*(F.col(c).alias(f"a_{c}") for c in some), F.inline("probe"))
    flips = sum((F.bit_count(F.col(f"a_m{b}").bitwiseXOR(F.col(f"b_m{b}"))) for b in range(3)), F.lit(0))
    first = F.when(F.expr("a_m0 = b_m0"), 0).when(F.expr("a_m1 = b_m1"), 1).otherwise(2)
    side = F.when(F.expr("a_head = b_head"), 0).otherwise(1)
    near = (F.col("a_size") < F.col("b_size")) | ((F.col("a_size") == F.col("b_size")) & (F.col("a_word") < F.col("b_word")))
    near = near & (flips <= 2) & (first == F.col("band")) & (side == F.col("side")) & (F.levenshtein("a_word", "b_word", 1) == 1)
    met = left.join(right, (left["key"] == right["key"]) & near)
    return met.select(F.col("a_word").alias("a"), "a_n", F.col("b_word").alias("b"), "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, form): the end of each word's chain.  Chains don't close; each
    round doubles the steps taken and is a written table."""
    at = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        before, at = at, materialise(at.select("word", "root").join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(before)
        if at.where("moved").isEmpty():
            return at.select("word", "root")


def variants(words: DataFrame, least: int = LEAST, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of words(word, n), which are distinct.

    A word's form is its near word of largest n, ties to the smallest by code points, if that n
    is at least `ratio` times its own; its root is the end of the chain of forms, or itself.  Rows with a null
    word are left out; an empty table gives an empty one."""
    words = materialise(words.where("word is not null").select("word", "n"), "words")
    both = near_pairs(words, least).select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m")))))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    told = words.join(best, "word", "left")
    far = -F.col("best.m") >= ratio * F.col("n")
    told = told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(far, F.col("best.other")).alias("form"), F.when(far, -F.col("best.m")).alias("form_n"))
    told = materialise(told, "forms")
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The variants among the words of all documents."""
    return variants(word_counts(docs))
