"""Files written from rows, and the images that slices of pages become."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.content import image
from .masks import encoded

PART = "img long, place int, name string, content binary"


def slice_files(images: DataFrame) -> DataFrame:
    """(img, place, name, content): the parts of images (img, gray, parts: array of place, top, bottom, name) as PNG files; a part
    without bounds is the whole image.  One image and one file are held at a time."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                held = batch["gray"][i]
                if held.is_valid and len(held.values):
                    gray = image(held.values)
                    for part in batch["parts"][i].as_py() or []:
                        content = encoded(gray[part["top"] or 0 : len(gray) if part["bottom"] is None else part["bottom"]])
                        yield pa.record_batch([batch["img"].slice(i, 1), pa.array([part["place"]], pa.int32()), pa.array([part["name"]]), pa.array([content], pa.binary())], ["img", "place", "name", "content"])

    return images.select("img", "gray", "parts").mapInArrow(run, PART)


def write_files(rows: DataFrame, folder: str) -> None:
    """Write (path, content) as files below folder: under names of the task's own first, then renamed, so that
    readers see whole files and a task that runs again writes them again.  Paths stay within the folder; of equal ones one wins."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        import os
        import posixpath
        import uuid

        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}")
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                to = posixpath.normpath(path.as_py())
                if to.startswith(("/", "..")):
                    raise ValueError(f"a path outside of the folder: {path.as_py()!r}")
                at = f"{base}/{to}"
                fs.create_dir(posixpath.dirname(at))
                own = f"{posixpath.dirname(at)}/.{uuid.uuid4().hex}"
                try:
                    with fs.open_output_stream(own) as out:
                        out.write(content.as_py() or b"")
                    fs.move(own, at)
                except BaseException:
                    if fs.get_file_info(own).type != pafs.FileType.NotFound:
                        fs.delete_file(own)
                    raise
            yield pa.record_batch([batch.column(0)], ["path"])

    rows.select("path", "content").mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()
