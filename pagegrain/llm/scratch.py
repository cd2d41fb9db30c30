"""Intermediate tables in the folder that all executors and the driver share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset and
    all runs in one process (tests)."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if held:
        return held.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":  # executors elsewhere would not see it
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    held = tempfile.mkdtemp(prefix="pagegrain-")
    atexit.register(shutil.rmtree, held, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{held}")
    return f"file://{held}"


def own_name(df: DataFrame, name: str) -> str:
    """A column name like this one that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet and read it back: lineage ends there and lost executors
    cost nothing.  Its shuffle files are of no more use then and go at once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN)
        else:
            spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for table in tables:
        files = table.inputFiles()
        if files:
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
