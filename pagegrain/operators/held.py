"""Intermediate results that several later steps read."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.  Only where it is unset and all runs in one process, a temporary one is taken."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place:
            if context.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            place = tempfile.mkdtemp(prefix="pagegrain-held-")
            atexit.register(shutil.rmtree, place, True)
        context.setCheckpointDir(place)
    return re.sub("^file:/(?!/)", "file:///", context.getCheckpointDir())


def held(df: DataFrame) -> DataFrame:
    """df computed once and kept in that folder, so that a lost executor costs nothing."""
    folder(df.sparkSession)
    return df.checkpoint()
