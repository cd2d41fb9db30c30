"""Chapter manifests as JSON files: point read, scan of a directory, atomic write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "struct<x1:int,y1:int,x2:int,y2:int,confidence:double,mask:string,manual:boolean,removed:boolean,ocr_text:string,ocr_lang:string>"
PAGE = f"struct<original:string,clean:string,skipped:boolean,source_page:int,slice_index:int,rendered:boolean,width:int,height:int,manual_mask:string,boxes:array<{BOX}>,excluded_regions:array<struct<x1:int,y1:int,x2:int,y2:int>>>"
MANIFEST = f"chapter_id string, source_url string, pages array<{PAGE}>, workflow struct<stage:string,page_index:int>, drafts map<string,string>, updated_at timestamp, _corrupt string"
CHAPTER_ID = "^[a-f0-9]{8}$"


def valid_id(chapter_id: Column) -> Column:
    """Eight lower-case hexadecimal digits, nothing around them; false for null."""
    return F.coalesce(chapter_id.rlike(CHAPTER_ID) & (F.length(chapter_id) == 8), F.lit(False))


def parsed(text: Column) -> Column:
    """A manifest's struct of its JSON text; null fields where it is malformed."""
    return F.from_json(text, MANIFEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})


def summaries(manifests: DataFrame, chapter: str = "chapter_id", text: str = "manifest", updated: str = "updated") -> DataFrame:
    """chapter_id, source_url, pages, stage, page_index, updated of every manifest text, newest first.

    Malformed texts and manifests without pages are left out; a missing url is empty, a
    missing stage `preview`, a missing index 0."""
    rows = manifests.select(F.col(chapter).alias("chapter_id"), parsed(F.col(text)).alias("m"), F.col(updated).alias("updated"))
    rows = rows.where(F.col("m").isNotNull() & F.col("m._corrupt").isNull() & (F.size("m.pages") > 0))
    stage, index = F.coalesce("m.workflow.stage", F.lit("preview")), F.coalesce("m.workflow.page_index", F.lit(0))
    out = rows.select("chapter_id", F.coalesce("m.source_url", F.lit("")).alias("source_url"), F.size("m.pages").alias("pages"), stage.alias("stage"), index.alias("page_index"), "updated")
    return out.orderBy(F.desc("updated"), "chapter_id")


def scan(spark: SparkSession, folder: str, name: str = "manifest.json") -> DataFrame:
    """chapter_id, manifest, updated of each manifest file in the folders below folder."""
    files = spark.read.format("binaryFile").load(f"{folder}/*/{name}")
    return files.select(F.element_at(F.split("path", "/"), -2).alias("chapter_id"), F.col("content").cast("string").alias("manifest"), F.col("modificationTime").alias("updated"))


def read_one(spark: SparkSession, folder: str, chapter_id: str) -> DataFrame:
    """The pages of one chapter; ValueError for an id of another form, an error of the reader if it isn't there."""
    import re

    if not re.fullmatch("[a-f0-9]{8}", chapter_id):
        raise ValueError(f"not a chapter id: {chapter_id!r}")
    text = spark.read.text(f"{folder}/{chapter_id}/manifest.json", wholetext=True)
    return text.select(parsed(F.col("value")).alias("m")).select("m.*").drop("_corrupt")


def write_all(manifests: DataFrame, folder: str) -> None:
    """Write (chapter_id, manifest) as one file for each chapter, in its folder: under a name of the
    task's own first, then renamed over the old one, so that readers see a whole manifest."""

    def run(batches):
        import os
        import uuid

        import pyarrow as pa
        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}")
        for batch in batches:
            for chapter, text in zip(batch.column(0), batch.column(1), strict=True):
                place = f"{base}/{chapter.as_py()}"
                fs.create_dir(place)
                own = f"{place}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(own) as out:
                    out.write((text.as_py() or "{}").encode())
                fs.move(own, f"{place}/manifest.json")
            yield pa.record_batch([batch.column(0)], ["chapter_id"])

    bad = manifests.where(~valid_id(F.col("chapter_id")))
    if not bad.isEmpty():
        raise ValueError("a chapter id has another form")
    manifests.select("chapter_id", "manifest").mapInArrow(run, "chapter_id string").write.format("noop").mode("overwrite").save()
