"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_PATHS: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one in local runs and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="gridstone-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return _OWN[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again.

    Cuts the lineage, so that work above is never done twice and a lost
    executor costs one re-read of files that every executor can see.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridstone/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = path
    weakref.finalize(out, _PATHS.pop, id(out), None)
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a written table that no later step reads."""
    path = _PATHS.pop(id(df))
    context = df.sparkSession.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
