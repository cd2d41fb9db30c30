"""Masks as PNG files, base64 inside manifests or bytes of an upload."""

from __future__ import annotations

import base64
import binascii
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .images import MAX_PIXELS, Broken, chunks, need, png

#: Channels of each colour type of PNG, and the share of red, green and blue in gray, in thousandths.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
GRAY = np.array([299, 587, 114])
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def encoded(mask: np.ndarray) -> bytes:
    """A gray matrix as a PNG file."""
    h, w = mask.shape
    lines = np.concatenate((np.zeros((h, 1), np.uint8), mask.astype(np.uint8)), axis=1).tobytes()
    parts = ((b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(lines)), (b"IEND", b""))
    return SIGNATURE + b"".join(struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body)) for kind, body in parts)


def _averaged(line: np.ndarray, above: np.ndarray, step: int) -> None:
    for i in range(len(line)):
        line[i] = (int(line[i]) + ((int(line[i - step]) if i >= step else 0) + int(above[i])) // 2) & 255


def _predicted(line: np.ndarray, above: np.ndarray, step: int) -> None:
    for i in range(len(line)):
        a, b, c = (int(line[i - step]), int(above[i]), int(above[i - step])) if i >= step else (0, int(above[i]), 0)
        near = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        line[i] = (int(line[i]) + (a if near[0] <= near[1] and near[0] <= near[2] else b if near[1] <= near[2] else c)) & 255


def unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Lines of bytes, the first of each naming its filter, as what they stand for; step: bytes of a pixel."""
    kinds, out = raw[:, 0], raw[:, 1:].copy()
    need(bool((kinds <= 4).all()), "filter")
    above = np.zeros(out.shape[1], np.uint8)
    for line, kind in zip(out, kinds.tolist(), strict=True):
        if kind == 1:  # running sums of each byte of a pixel
            for c in range(min(step, len(line))):
                line[c::step] = np.cumsum(line[c::step], dtype=np.uint8)
        elif kind == 2:
            line += above
        elif kind == 3:
            _averaged(line, above, step)
        elif kind == 4:
            _predicted(line, above, step)
        above = line
    return out


def decoded(data: bytes) -> np.ndarray:
    """The pixels of a PNG file, (height, width, channels) of bytes; palettes are resolved, deeper
    values cut to their upper byte, shallower ones of gray stretched.  Interlaced files aren't read."""
    held = memoryview(data)
    need(bytes(held[:8]) == SIGNATURE, "no PNG")
    w, h = png(held)
    need(0 < w * h <= MAX_PIXELS, "size")
    parts: dict[bytes, bytes] = {}
    for kind, body in chunks(held):
        if kind in (b"IHDR", b"IDAT", b"PLTE", b"tRNS"):
            parts[kind] = parts.get(kind, b"") + bytes(body)
    _, _, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    need(not laced, "interlaced")
    bits = depth * CHANNELS[colour]
    wide = (w * bits + 7) // 8
    size = h * (wide + 1)
    try:
        lines = zlib.decompressobj().decompress(parts[b"IDAT"], size)  # no more than the header promises
    except zlib.error as why:
        raise Broken("pixels") from why
    need(len(lines) == size, "pixels")
    flat = unfiltered(np.frombuffer(lines, np.uint8).reshape(h, wide + 1), max(1, bits // 8))
    if depth == 16:
        flat = flat[:, ::2]
    elif depth < 8:
        flat = np.unpackbits(flat, axis=1).reshape(h, -1, depth)
        flat = (flat @ (1 << np.arange(depth)[::-1]))[:, : w * CHANNELS[colour]].astype(np.uint8)
    pixels = flat.reshape(h, w, CHANNELS[colour])
    if colour == 3:
        need(b"PLTE" in parts, "palette")
        table = np.frombuffer(parts[b"PLTE"], np.uint8)
        need(len(table) % 3 == 0 and int(pixels.max()) < len(table) // 3, "palette")
        table, clear = table.reshape(-1, 3), np.frombuffer(parts.get(b"tRNS", b""), np.uint8)
        if len(clear):
            table = np.column_stack((table, np.append(clear, np.full(max(0, len(table) - len(clear)), 255, np.uint8))[: len(table)]))
        return table[pixels[:, :, 0]]
    return pixels * (255 // ((1 << depth) - 1)) if depth < 8 else pixels


def gray(pixels: np.ndarray) -> np.ndarray:
    if pixels.shape[2] < 3:
        return pixels[:, :, 0]
    return ((pixels[:, :, :3].astype(np.int64) @ GRAY + 500) // 1000).astype(np.uint8)


def fitted(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    """A mask in a page's size, by nearest pixels."""
    h, w = mask.shape
    return mask if (h, w) == (height, width) else mask[np.ix_(np.arange(height) * h // height, np.arange(width) * w // width)]


OUT = "width int, height int, mask array<array<int>>, error string"


def _run(files: DataFrame, key: str, columns: list[str], read) -> DataFrame:
    """key and OUT of what read makes of each row; one mask is held at a time."""
    kind = files.schema[key].dataType

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                mask, error = None, None
                try:
                    mask = read(*(batch[c][i].as_py() for c in columns))
                except Broken as why:
                    error = str(why)
                h, w = mask.shape if mask is not None else (None, None)
                rows = None if mask is None else mask.astype(np.int32).tolist()
                yield pa.record_batch([batch.column(0).slice(i, 1), pa.array([w], pa.int32()), pa.array([h], pa.int32()), pa.array([rows], pa.list_(pa.list_(pa.int32()))), pa.array([error], pa.string())], [key, "width", "height", "mask", "error"])

    return files.select(key, *columns).mapInArrow(run, f"{key} {kind.simpleString()}, {OUT}")


def stored_masks(rows: DataFrame, key: str, payload: str = "mask") -> DataFrame:
    """key, width, height, mask, error of base64 texts as manifests hold them: in gray whatever they
    were; null or empty texts give no mask and no error, malformed ones an error."""

    def read(text: str | None) -> np.ndarray | None:
        if not text:
            return None
        try:
            data = base64.b64decode("".join(text.split()), validate=True)  # lines may be broken
        except (binascii.Error, ValueError) as why:
            raise Broken("base64") from why
        return gray(decoded(data))

    return _run(rows, key, [payload], read)


def uploaded_masks(rows: DataFrame, key: str, content: str = "content", width: str = "page_width", height: str = "page_height") -> DataFrame:
    """key, width, height, mask, error of uploaded files, in their pages' size: the alpha channel of a file that has
    colours and one, else its gray.  An empty file, or a mask with nothing in it, is refused."""

    def read(data: bytes | None, w: int, h: int) -> np.ndarray:
        need(bool(data), "empty file")
        pixels = decoded(data)
        mask = fitted(pixels[:, :, 3] if pixels.shape[2] == 4 else gray(pixels), h, w)
        need(bool(mask.any()), "empty mask")
        return mask

    return _run(rows, key, [content, width, height], read)


def _texts(masks: pd.Series) -> pd.Series:
    return pd.Series([None if m is None or not len(m) else base64.b64encode(encoded(np.stack([np.asarray(r) for r in m]))).decode() for m in masks], dtype=object)


def with_text(rows: DataFrame, mask: str = "mask", name: str = "payload") -> DataFrame:
    """rows with masks (arrays of rows of 0 to 255) as base64 of PNG files; null or without rows: null."""
    return rows.withColumn(name, F.pandas_udf(_texts, "string")(F.col(mask)))
