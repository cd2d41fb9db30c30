"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves pre-tokens that are
vocabulary entries.  Tier two: the others are merged with a heap over a doubly
linked list of their bytes.  Both see each distinct pre-token of a batch once."""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import BYTE_VALUE, STEP, mix

DECODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
AT_ONCE = 1 << 20  # characters whose pre-tokens are held at once
KEPT, HELD = 1 << 18, 1 << 24  # resolved pre-tokens that a worker remembers between batches, and bytes of them


def bytes_hash(keys: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each key."""
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    data = np.frombuffer(b"".join(keys), np.uint8)
    out = np.zeros(len(keys), np.uint64)
    starts = np.cumsum(sizes) - sizes
    live = np.flatnonzero(sizes)
    at = 0
    while len(live):
        out[live] = out[live] * STEP + BYTE_VALUE[data[starts[live] + at]]
        at += 1
        live = live[sizes[live] > at]
    return mix(out + sizes.astype(np.uint64))


class MinimalPerfectHash:
    """n keys onto 0..n-1 (compress, hash and displace): each bucket stores the
    displacement that put its keys on free places, the fullest bucket first."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = max(1, n // 3)
        self.shift = np.zeros(self.buckets, np.uint64)
        if not n:
            return
        h = bytes_hash(keys)
        if len(np.unique(h)) != n:
            raise ValueError("two keys are equal or share a 64-bit hash")
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        first = np.cumsum(sizes) - sizes
        taken = np.zeros(n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            size = sizes[b]
            if not size:
                break
            own = h[order[first[b] : first[b] + size]]
            tried = 0
            while True:  # 64 displacements at a time
                shifts = np.arange(tried, tried + 64, dtype=np.uint64)
                places = self._place(own[None, :], shifts[:, None])
                good = ~taken[places].any(1)
                if size > 1:
                    ordered = np.sort(places, 1)
                    good &= (ordered[:, 1:] != ordered[:, :-1]).all(1)
                if good.any():
                    k = int(np.argmax(good))
                    self.shift[b] = shifts[k]
                    taken[places[k]] = True
                    break
                tried += 64

    def _place(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(h + shift * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    def places(self, keys: list[bytes]) -> np.ndarray:
        """Where each key would stand; a key of the set has its own place."""
        h = bytes_hash(keys)
        return self._place(h, self.shift[(h % np.uint64(self.buckets)).astype(np.int64)])


def merge_bytes(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE of one pre-token: always the leftmost pair of the lowest rank, from a
    heap of rank and place in one integer, over linked pieces.  A heap entry is
    stale if the pair that now starts there has another rank."""
    n, get = len(token), ranks.get
    shift = n.bit_length()
    mask = (1 << shift) - 1
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pair = [get(token[i : i + 2], -1) for i in range(n - 1)]
    heap = [r << shift | i for i, r in enumerate(pair) if r >= 0]
    pair.append(-1)
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        entry = pop(heap)
        i = entry & mask
        if pair[i] != entry >> shift:
            continue
        gone = after[i]
        after[i] = end = after[gone]
        pair[i] = pair[gone] = -1
        if end < n:
            before[end] = i
            if (r := get(token[i : after[end]], -1)) >= 0:
                pair[i] = r
                push(heap, r << shift | i)
        if i:
            left = before[i]
            pair[left] = r = get(token[left:end], -1)
            if r >= 0:
                push(heap, r << shift | left)
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i : after[i]]])
        i = after[i]
    return out


class ByteBpe:
    """Encoder and decoder by a file of base64 tokens and ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.find = regex.compile(pattern)
        keys = list(self.ranks)
        self.hash = MinimalPerfectHash(keys)
        places = self.hash.places(keys)
        self.key_at: list[bytes] = [b""] * len(keys)
        self.packed_at: list[bytes] = [b""] * len(keys)
        for place, key in zip(places.tolist(), keys, strict=True):
            self.key_at[place], self.packed_at[place] = key, self.ranks[key].to_bytes(4, "little")
        self.known: dict[str, bytes] = {}
        self.size = 0

    def resolve(self, tokens: list[str]) -> None:
        """Put the packed ids of distinct pre-tokens into known."""
        keys = [t.encode() for t in tokens]
        self.size += sum(map(len, keys))
        for token, key, place in zip(tokens, keys, self.hash.places(keys).tolist(), strict=True):
            if self.key_at[place] == key:
                self.known[token] = self.packed_at[place]
            else:
                self.known[token] = array("I", merge_bytes(key, self.ranks)).tobytes()

    def _packed(self, lists: list[list[str]]) -> list[bytes]:
        """The packed ids of lists of pre-tokens, whose distinct new ones are resolved together."""
        new = set().union(*lists).difference(self.known)
        if new:
            if len(self.known) + len(new) > KEPT or self.size > HELD:
                self.known.clear()
                self.size = 0
                new = set().union(*lists)
            self.resolve(list(new))
        known = self.known.__getitem__
        return [b"".join(map(known, tokens)) for tokens in lists]

    def parts(self, texts: Iterable[str]) -> Iterator[tuple[int, bytes]]:
        """(row, packed ids) of texts, rows in order: little-endian unsigned 32 bits, in
        one part for a text or, for a very long one, in several of bounded size."""
        rows: list[int] = []
        lists: list[list[str]] = []
        size = 0
        for row, text in enumerate(texts):
            if len(text) > AT_ONCE:
                found = (m.group() for m in self.find.finditer(text))
                more = iter(lambda found=found: list(islice(found, AT_ONCE // 8)), [])
            else:
                more = [self.find.findall(text)]
            for tokens in more:
                rows.append(row)
                lists.append(tokens)
                size += len(tokens)
                if size > AT_ONCE // 4:
                    yield from zip(rows, self._packed(lists), strict=True)
                    rows, lists, size = [], [], 0
        yield from zip(rows, self._packed(lists), strict=True)

    def ids(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each whole text."""
        out = [b""] * len(texts)
        for row, packed in self.parts(texts):
            out[row] = out[row] + packed if out[row] else packed
        return out

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def digests(self, texts: Iterable[str], rows: int) -> list[tuple[int, str, str]]:
        """For each text: number of ids, SHA-256 of the ids, SHA-256 of the bytes decoded from them."""
        counts = [0] * rows
        hashes = [(hashlib.sha256(), hashlib.sha256()) for _ in range(rows)]
        for row, packed in self.parts(texts):
            counts[row] += len(packed) // 4
            hashes[row][0].update(packed)
            hashes[row][1].update(self.decode(packed))
        return [(n, a.hexdigest(), b.hexdigest()) for n, (a, b) in zip(counts, hashes, strict=True)]


_held: dict[tuple[str, str], ByteBpe] = {}


def encoder(path: str, pattern: str) -> ByteBpe:
    """One encoder for a Python worker."""
    if (path, pattern) not in _held:
        _held[path, pattern] = ByteBpe(path, pattern)
    return _held[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of each row's whole text; a null or empty text has no ids.

    Repeated rows are encoded each for itself, other columns don't matter, and an
    empty table gives an empty one."""

    def run(batches):
        bpe = encoder(path, pattern)
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in bpe.ids([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded binary) of (doc_id, ids); null ids are empty, an unknown id is an error."""

    def run(batches):
        bpe = encoder(path, pattern)
        for batch in batches:
            out = [bpe.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: its whole text is
    encoded, and the second digest is of the bytes decoded from the ids.

    A null or empty text has 0 ids and the digests of no bytes.  A very long text
    passes in parts, so memory doesn't follow its length.  There is no shuffle."""

    def run(batches):
        bpe = encoder(path, pattern)
        for batch in batches:
            found = bpe.digests((x.as_py() or "" for x in batch.column(1)), len(batch))
            n, ids, decoded = zip(*found, strict=True) if found else ((), (), ())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, DECODED)
