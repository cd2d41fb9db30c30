"""Words and hashes of whole texts, vectorised over Arrow batches.

A word is a run of bytes other than space and \\t\\n\\v\\f\\r.  All hashes are
64-bit, equal in every task, and mixed so that their bits are uniform."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18  # bytes (or words) handled at once, so that memory doesn't follow a text's length
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
STEP = U64(0xD1342543DE82EF95)

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n-1 and the same of its inverse, modulo 2**64."""
    held = _powers.get(int(base))
    if held is None or len(held[0]) < n:
        size = max(n, CHUNK)
        up = np.full(size, base, U64)
        down = np.full(size, U64(pow(int(base), -1, 1 << 64)), U64)
        up[0] = down[0] = 1
        held = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 2 * CHUNK:  # what a worker keeps is bounded
            _powers[int(base)] = held
    return held[0][:n], held[1][:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes each (one row at least)."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end
        row = end


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words' starts and ends in data, and the index of each row's first word (one more at the end)."""
    inside = ~SEPARATOR[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    before[:] = False
    before[:-1] = inside[1:]
    cut = offsets[1:]
    before[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(inside & ~before) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, bytes, words' starts, words' ends, words' hashes) of each text of a column, in order."""
    data, offsets = utf8(column)
    for a, b in pieces(offsets):
        at = offsets[a : b + 1]
        piece, at = data[at[0] : at[-1]], at - at[0]
        starts, ends, rows = spans(piece, at)
        hashes = word_hashes(piece, starts, ends)
        for k in range(b - a):
            some = slice(rows[k], rows[k + 1])
            yield a + k, piece, starts[some], ends[some], hashes[some]


def long_word_hash(data: np.ndarray) -> np.uint64:
    """What word_hashes gives for one word, in parts."""
    up, _ = powers(BASE, CHUNK)
    total, shift, whole = U64(0), 1, pow(int(BASE), CHUNK, 1 << 64)
    with np.errstate(over="ignore"):
        for a in range(0, len(data), CHUNK):
            part = BYTE_VALUE[data[a : a + CHUNK]] * up[: min(CHUNK, len(data) - a)]
            total += part.sum(dtype=U64) * U64(shift)
            shift = shift * whole % (1 << 64)
    return mix(np.array([total + U64(len(data))], U64))[0]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes."""
    out = np.empty(len(starts), U64)
    word = 0
    while word < len(starts):
        base = int(starts[word])
        if ends[word] - base > CHUNK:
            out[word] = long_word_hash(data[base : ends[word]])
            word += 1
            continue
        last = max(word + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        size = int(ends[last - 1]) - base
        up, down = powers(BASE, size)
        sums = np.zeros(size + 1, U64)
        np.cumsum(BYTE_VALUE[data[base : base + size]] * up, out=sums[1:])
        s, e = starts[word:last] - base, ends[word:last] - base
        out[word:last] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64))
        word = last
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words, by its first word; empty if there are fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = words[:n].copy()
    for j in range(1, k):
        total *= STEP
        total += words[j : j + n]
    return mix(total)


def prefix_sums(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What range_hashes needs for runs of any length."""
    up, down = powers(STEP, len(words) + 1)
    sums = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return sums, down


def range_hashes(sums: np.ndarray, down: np.ndarray, first: np.ndarray, length) -> np.ndarray:
    """A hash of the words from first, so many of them."""
    return mix((sums[first + length] - sums[first]) * down[first] + np.asarray(length).astype(U64))
