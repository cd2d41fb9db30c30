"""Format and size of images from their bytes, without decoding pixels.

A reader takes columns of bytes, such as the `content` of Spark's binaryFile source.  Each format's own structure is
followed to its end (chunks with their checksums, segments, sizes that the header promises), so that cut files and headers
that lie are told from whole ones."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed limits of an upload and the formats it may have.
MAX_BYTES, MAX_PIXELS = 100 << 20, 50_000_000
ALLOWED = ("PNG", "JPEG", "WEBP", "BMP")
#: JPEG markers that stand alone, and those that begin a frame (C4, C8 and CC among them don't).
ALONE = {0x01, *range(0xD0, 0xD8)}
FRAMES = set(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
#: Bits a pixel for each colour type of PNG, and the depths each may have.
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}

Facts = tuple[str | None, int | None, int | None, str | None]


class Broken(ValueError):
    """What is wrong with an image."""


def need(there: bool, what: str) -> None:
    if not there:
        raise Broken(what)


def chunks(data: memoryview) -> Iterator[tuple[bytes, memoryview]]:
    """The chunks of a PNG file, whose checksums must be right, up to its end."""
    at = 8
    while True:
        need(at + 12 <= len(data), "cut")
        size, kind = struct.unpack_from(">I4s", data, at)
        need(at + 12 + size <= len(data), "cut")
        need(zlib.crc32(data[at + 4 : at + 8 + size]) == struct.unpack_from(">I", data, at + 8 + size)[0], "checksum")
        yield kind, data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IEND":
            return


def png(data: memoryview) -> tuple[int, int]:
    size, pixels = None, False
    for kind, body in chunks(data):
        if size is None:
            need(kind == b"IHDR" and len(body) == 13, "header")
            w, h, depth, colour, packing, filters, lines = struct.unpack(">IIBBBBB", body)
            need(depth in DEPTHS.get(colour, ()) and packing == filters == 0 and lines < 2, "header")
            size = w, h
        pixels = pixels or kind == b"IDAT"
    need(pixels, "no pixels")
    return size


def jpeg(data: memoryview) -> tuple[int, int]:
    at, size = 2, None
    while True:
        need(at + 4 <= len(data), "cut")
        need(data[at] == 0xFF, "header")
        marker = data[at + 1]
        if marker == 0xFF:  # filling
            at += 1
            continue
        if marker in ALONE:
            at += 2
            continue
        need(marker != 0xD9, "no pixels")
        length = struct.unpack_from(">H", data, at + 2)[0]
        need(length >= 2 and at + 2 + length <= len(data), "cut")
        if marker in FRAMES:
            need(length >= 8, "header")
            h, w = struct.unpack_from(">HH", data, at + 5)
            size = w, h
        at += 2 + length
        if marker == 0xDA:  # the pixels follow, up to the end marker
            need(size is not None, "header")
            need(bytes(data[at:]).rfind(b"\xff\xd9") >= 0, "cut")
            return size


def webp(data: memoryview) -> tuple[int, int]:
    need(len(data) >= 30, "cut")
    need(struct.unpack_from("<I", data, 4)[0] + 8 <= len(data), "cut")
    kind, length = bytes(data[12:16]), struct.unpack_from("<I", data, 16)[0]
    need(20 + length <= len(data), "cut")
    if kind == b"VP8X":
        return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
    if kind == b"VP8L":
        need(data[20] == 0x2F, "header")
        bits = struct.unpack_from("<I", data, 21)[0]
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    need(kind == b"VP8 " and bytes(data[23:26]) == b"\x9d\x01\x2a", "header")
    w, h = struct.unpack_from("<HH", data, 26)
    return w & 0x3FFF, h & 0x3FFF


def bmp(data: memoryview) -> tuple[int, int]:
    need(len(data) >= 26, "cut")
    start, head = struct.unpack_from("<II", data, 10)
    if head == 12:
        w, h, _, depth = struct.unpack_from("<HHHH", data, 18)
        packing = 0
    else:
        need(head >= 40 and len(data) >= 14 + head, "header")
        w, h, _, depth, packing = struct.unpack_from("<iiHHI", data, 18)
    need(depth in (1, 4, 8, 16, 24, 32) and w >= 0, "header")
    need(packing not in (0, 3) or start + (w * depth + 31) // 32 * 4 * abs(h) <= len(data), "cut")
    return w, abs(h)


#: How a file of each format begins, and what reads it.
READERS = (("PNG", b"\x89PNG\r\n\x1a\n", png), ("JPEG", b"\xff\xd8", jpeg), ("WEBP", b"RIFF", webp), ("BMP", b"BM", bmp), ("GIF", b"GIF8", None), ("TIFF", b"II*\0", None), ("TIFF", b"MM\0*", None))


def facts(data: bytes | None) -> Facts:
    """Format, width, height and what is wrong: a null format is none that is known."""
    held = memoryview(data or b"")
    for name, magic, read in READERS:
        if held[: len(magic)] == magic and (name != "WEBP" or held[8:12] == b"WEBP"):
            if read is None:
                return name, None, None, None
            try:
                w, h = read(held)
                need(w > 0 and h > 0, "no area")
                return name, w, h, None
            except Broken as why:
                return name, None, None, str(why)
    return None, None, None, "unknown format"


def image_facts(files: DataFrame, content: str = "content") -> DataFrame:
    """files with `image`, a struct of format, width, height and broken (null for a whole file)."""

    @F.pandas_udf("struct<format string, width long, height long, broken string>")
    def read(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([facts(d) for d in data], columns=["format", "width", "height", "broken"]).astype({"width": "Int64", "height": "Int64"})

    return files.withColumn("image", read(F.col(content)))


def refusal(size: Column, image: Column, most_bytes: int = MAX_BYTES, most_pixels: int = MAX_PIXELS) -> Column:
    """Why an upload is refused, the first reason of all; null if it isn't."""
    size = F.coalesce(size, F.lit(0))
    known = F.coalesce(image["format"].isin(*ALLOWED), F.lit(False))
    return (
        F.when(size == 0, "empty")
        .when(size > most_bytes, "too large")
        .when(image["format"].isNull() | image["broken"].isNotNull(), "no image")
        .when(~known, "format")
        .when(image["width"] * image["height"] > most_pixels, "too many pixels")
    )


def checked_uploads(files: DataFrame, key: str, content: str = "content", most_bytes: int = MAX_BYTES, most_pixels: int = MAX_PIXELS) -> DataFrame:
    """(key, format, width, height, refused) of each file.  The bytes of files over the limit aren't handed to Python."""
    size = F.octet_length(content)
    some = files.select(key, size.alias("size"), F.when(size <= most_bytes, F.col(content)).alias(content))
    told = image_facts(some, content)
    return told.select(key, "image.format", "image.width", "image.height", refusal(F.col("size"), F.col("image"), most_bytes, most_pixels).alias("refused"))


def scan(files: DataFrame, key: str, content: str = "content", most_pixels: int = MAX_PIXELS) -> DataFrame:
    """(key, width, height, error): the scan of a stored page before it is decoded."""
    told = image_facts(files.select(key, content), content)
    whole = F.col("image.broken").isNull() & F.col("image.width").isNotNull()
    error = F.when(~whole, "unreadable").when(F.col("image.width") * F.col("image.height") > most_pixels, "too many pixels")
    return told.select(key, F.when(whole, F.col("image.width")).alias("width"), F.when(whole, F.col("image.height")).alias("height"), error.alias("error"))
