"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WORK: list[str] = []


def work_dir(spark: SparkSession, name: str = "work") -> str:
    """A new folder below ``spark.checkpoint.dir``; ``clear_work`` deletes it.

    Where the setting is absent in local mode a temporary folder takes its place; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WORK.append(path)
    return path


def kept_at(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written once and read back, and the folder it is in."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once and read back, for tables that several later steps use."""
    return kept_at(df)[0]


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a work folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _WORK:
        _WORK.remove(path)


def work_count() -> int:
    """How many work folders there are, for ``clear_work``."""
    return len(_WORK)


def clear_work(spark: SparkSession, first: int = 0) -> None:
    """Deletes this session's work folders from ``first`` on. Results that are read from them must be used up."""
    for path in _WORK[first:]:
        drop(spark, path)
