"""Corpora of cases on disk: folders with an image, its mask and what is known of them."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed names of a case's files, and what a case's digest is taken from, with the values of what is missing.
IMAGE, MASK, KNOWN = "original.png", "mask.png", "metadata.json"
WORKLOAD = {"case_id": "", "expected_execution": "model_required", "expected_shortcut_type": None, "width": 0, "height": 0, "mask_type": ""}


def canonical(value: object) -> str:
    """JSON with keys sorted at every level and nothing between its parts."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def workload(known: dict, image: str, mask: str) -> str:
    """The digest of a case: of what it was made with, in whatever order keys and boxes stand, and of its files' digests."""
    held = {k: known.get(k, v) for k, v in WORKLOAD.items()}
    boxes = sorted(known.get("boxes", []), key=lambda b: tuple(b.get(c, 0) for c in ("x1", "y1", "x2", "y2")))
    return hashlib.sha256(canonical({**held, "boxes": boxes, "original_sha256": image, "mask_sha256": mask}).encode()).hexdigest()


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of every file in the folders below folder."""
    return spark.read.format("binaryFile").load(f"{folder}/*/*").select("path", "content")


def _filed(files: DataFrame) -> DataFrame:
    """One row for each folder of files (path, content): digests of its image and mask, the text of its metadata.  Bytes of images don't pass the shuffle."""
    named = files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    told = named.select("folder", "name", F.sha2("content", 256).alias("digest"), F.when(F.col("name") == KNOWN, F.col("content").cast("string")).alias("text"))
    of = lambda name, column: F.max(F.when(F.col("name") == name, F.col(column)))
    return told.groupBy("folder").agg(of(IMAGE, "digest").alias("image"), of(MASK, "digest").alias("mask"), of(KNOWN, "text").alias("known"))


def _read(known: pd.Series, image: pd.Series, mask: pd.Series, folder: pd.Series) -> pd.DataFrame:
    rows = []
    for text, one, two, name in zip(known, image, mask, folder, strict=True):
        try:
            held = json.loads(text) if text else {}
        except ValueError:
            held = {}
        held = held if isinstance(held, dict) else {}
        held.setdefault("case_id", name)
        held.setdefault("expected_execution", WORKLOAD["expected_execution"])
        rows.append((held["case_id"], held["expected_execution"], workload(held, one, two)))
    return pd.DataFrame(rows, columns=["case_id", "expected_execution", "workload_sha256"])


def cases(files: DataFrame) -> DataFrame:
    """folder, case_id, expected_execution, original_sha256, mask_sha256, workload_sha256 of each folder that holds an image and a mask.

    Digests are computed anew, whatever the metadata says; without readable metadata a case has its
    folder's name and needs a model.  files: path, content."""
    held = _filed(files).where("image is not null and mask is not null")
    name = F.element_at(F.split("folder", "/"), -1)
    read = F.pandas_udf(_read, "struct<case_id string, expected_execution string, workload_sha256 string>")
    told = held.select("folder", "image", "mask", read("known", "image", "mask", name).alias("k"))
    return told.select("folder", "k.case_id", "k.expected_execution", F.col("image").alias("original_sha256"), F.col("mask").alias("mask_sha256"), "k.workload_sha256")


def unpaired(files: DataFrame) -> DataFrame:
    """folder, lacks: folders that hold an image or a mask, but not both."""
    held = _filed(files).where("image is null or mask is null")
    lacks = F.when(F.col("image").isNull() & F.col("mask").isNull(), "both").when(F.col("image").isNull(), IMAGE).otherwise(MASK)
    return held.select("folder", lacks.alias("lacks"))


def verified(found: DataFrame, stored: DataFrame) -> DataFrame:
    """case_id, state of cases (case_id, workload_sha256) against stored ones: same, changed, missing or new."""
    both = stored.select("case_id", F.col("workload_sha256").alias("was"), F.lit(True).alias("stored")).join(found.select("case_id", F.col("workload_sha256").alias("now"), F.lit(True).alias("found")), "case_id", "full_outer")
    state = F.when(F.col("found").isNull(), "missing").when(F.col("stored").isNull(), "new").when(F.col("was").eqNullSafe(F.col("now")), "same").otherwise("changed")
    return both.select("case_id", state.alias("state"))


def tampered(manifests: DataFrame, trusted: dict[str, str], key: str, text: str = "manifest", digests: str = "production_hashes") -> DataFrame:
    """key, name: the entries of a manifest's map of digests that are missing or other than the pinned ones (name -> digest).
    A manifest that can't be read has none of them."""
    held: Column = F.coalesce(F.from_json(F.get_json_object(text, f"$.{digests}"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    pinned = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(d).alias("digest")) for n, d in sorted(trusted.items())))
    each = manifests.select(key, held.alias("held"), F.inline(pinned))
    return each.where(~F.col("digest").eqNullSafe(F.element_at("held", F.col("name")))).select(key, "name")
