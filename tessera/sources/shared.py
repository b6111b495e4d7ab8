"""The folder that driver and executors share, and tables cut from their lineage by writing them there."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a new local folder where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return located(spark, base.rstrip("/"))


def located(spark: SparkSession, path: str) -> str:
    """A path with its file system: Spark's default one where it names none, so that Spark and ``storage`` mean the same."""
    if ":/" in path:
        return path
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return f"file://{path}" if default.startswith("file:") else f"{default.rstrip('/')}{path}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def storage(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path within it."""
    uri = f"s3{uri[3:]}" if uri.startswith(("s3a:/", "s3n:/")) else uri  # Hadoop's names for it
    return pafs.FileSystem.from_uri(uri) if ":/" in uri else (pafs.LocalFileSystem(), uri)
