"""Pages out of uploads: loose images and archives of images."""

from __future__ import annotations

import io
import re
import zipfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Image suffixes, the largest entry, all entries of a chapter together, their number.
SUFFIXES = (".png", ".jpg", ".jpeg", ".webp", ".bmp")
ENTRY, TOTAL, FILES = 100 << 20, 500 << 20, 300


def natural(name: str) -> list:
    """Runs of digits compare as numbers, the rest without case."""
    return [(0, int(t), "") if t.isdigit() else (1, 0, t.lower()) for t in re.findall(r"\d+|\D+", name)]


def _open(name: str, content: bytes):
    """The archive that an upload is, None for another file, False for a broken archive."""
    try:
        return zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        return False if name.lower().endswith((".zip", ".cbz")) else None


def entries(uploads: DataFrame) -> DataFrame:
    """(chapter_id, upload, entry, place, size, archive) of each image that uploads (chapter_id, upload
    number, name, content) hold; hidden entries, others than images, empty and broken ones are left out."""

    def listed(batches):
        for pdf in batches:
            rows = []
            for chapter, upload, name, content in zip(pdf["chapter_id"], pdf["upload"], pdf["name"], pdf["content"], strict=True):
                archive = _open(name, content)
                if archive is None:
                    rows.append((chapter, upload, name, 0, len(content), False))
                elif archive:
                    infos = sorted(archive.infolist(), key=lambda i: natural(i.filename))
                    images = [i for i in infos if not i.filename.startswith(("__MACOSX/", ".")) and i.filename.lower().endswith(SUFFIXES)]
                    rows += [(chapter, upload, i.filename, place, i.file_size, True) for place, i in enumerate(images)]
            yield pd.DataFrame(rows, columns=["chapter_id", "upload", "entry", "place", "size", "archive"])

    return uploads.select("chapter_id", "upload", "name", "content").mapInPandas(listed, "chapter_id string, upload int, entry string, place int, size long, archive boolean")


def accepted(found: DataFrame, entry: int = ENTRY, total: int = TOTAL, files: int = FILES) -> DataFrame:
    """(chapter_id, upload, entry, page): the entries that the limits let in, in order.

    An archive's entry over `entry` bytes is passed over; one that would exceed the total ends its
    archive; a loose file that would ends the upload.  No more once `files` or `total` is reached.
    The order decides, so a chapter's sizes (not its contents) are folded together."""

    def fold(pdf):
        pdf = pdf.sort_values(["upload", "place"])
        out, held, ended = [], 0, None
        for r in pdf.itertuples(index=False):
            if len(out) >= files or held >= total:
                break
            if r.upload == ended or r.archive and r.size > entry:
                continue
            if held + r.size > total:
                if not r.archive:
                    break
                ended = r.upload
            elif r.size or not r.archive:
                out.append((r.chapter_id, r.upload, r.entry, len(out)))
                held += r.size
        return pd.DataFrame(out, columns=["chapter_id", "upload", "entry", "page"])

    return found.groupBy("chapter_id").applyInPandas(fold, "chapter_id string, upload int, entry string, page int")


def pages(uploads: DataFrame, **limits: int) -> DataFrame:
    """(chapter_id, page, name, content, error) of the accepted images; names lose their folders.  An entry that
    can't be read (broken, encrypted, packed in an unknown way) has an error and no content; one upload's contents are held at a time."""
    wanted = accepted(entries(uploads), **limits)
    chosen = wanted.groupBy("chapter_id", "upload").agg(F.collect_list(F.struct("entry", "page")).alias("wanted"))

    def content(archive, entry: str) -> tuple[bytes | None, str | None]:
        try:
            return archive.read(entry), None
        except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError, zlib.error) as why:
            return None, type(why).__name__

    def read(batches):
        for pdf in batches:
            for chapter, name, whole, wanted_ in zip(pdf["chapter_id"], pdf["name"], pdf["content"], pdf["wanted"], strict=True):
                archive = _open(name, whole)
                rows = [(chapter, w["page"], re.split(r"[/\\]", w["entry"])[-1], *(content(archive, w["entry"]) if archive else (whole, None))) for w in wanted_]
                yield pd.DataFrame(rows, columns=["chapter_id", "page", "name", "content", "error"])

    return uploads.join(chosen, ["chapter_id", "upload"]).select("chapter_id", "name", "content", "wanted").mapInPandas(read, "chapter_id string, page int, name string, content binary, error string")


def uploads(spark, path: str) -> DataFrame:
    """Files below path/<chapter>/ as uploads, in name order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    named = files.select(F.element_at(parts, -2).alias("chapter_id"), F.element_at(parts, -1).alias("name"), "content")
    return named.withColumn("upload", F.row_number().over(Window.partitionBy("chapter_id").orderBy("name")) - 1)
