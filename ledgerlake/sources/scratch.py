"""Intermediate tables that several later steps read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir, with its scheme; a local one is made only
    where the session names none and all tasks run in this machine's one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        named = f"file://{tempfile.mkdtemp(prefix='scratch-')}"
        spark.sparkContext.setCheckpointDir(named)
    path = spark._jvm.org.apache.hadoop.fs.Path(named)
    # without a scheme, a path lies in Spark's default file system, for whoever reads it
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read back, so that what builds on it twice does
    not compute it twice and a lost executor does not cost it."""
    path = folder(df.sparkSession, "staged")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
