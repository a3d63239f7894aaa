"""Written intermediate tables in the shared folder, and Arrow batch settings."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from gridstone.sources.shared import discard, shared_dir, written

__all__ = ["discard", "documents", "prepare", "shared_dir", "written"]

#: An Arrow batch handed to Python ends at so many rows or, as texts may be long, bytes.
BATCH_ROWS, BATCH_BYTES = 1 << 14, 1 << 20

#: Tables of fewer bytes are dealt to all cores first.
SMALL_BYTES = 16 << 20

_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Ready a session for Python operators: small Arrow batches, as texts may be long, and this package on the workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="gridstone-")
    atexit.register(shutil.rmtree, folder, True)
    context.addPyFile(shutil.make_archive(f"{folder}/{top.name}", "zip", top.parent, top.name))
    _SHIPPED.add(context.applicationId)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table; dealt out anew only below SMALL_BYTES, as a small file is one split and would keep one core busy."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(spark.sparkContext.defaultParallelism) if size < SMALL_BYTES else docs
