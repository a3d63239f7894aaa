"""Reductions over streams of vector elements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.operators.reductions import KNOWN


def running_reduce(stream: DataFrame, col: str, op: str = "plus", time: str | None = None, window: str | None = None, late: str = "0 seconds") -> DataFrame:
    """The elements seen so far combined; with ``time`` and ``window``, by event-time window with a watermark.

    The state is one row a window (one in all without), as the operators
    aggregate partially before the exchange.
    """
    aggregate, _ = KNOWN[op]
    if window is None:
        return stream.agg(aggregate(F.col(col)).alias("value"), F.count("*").alias("n"))
    marked = stream.withWatermark(time, late)
    found = marked.groupBy(F.window(time, window)).agg(aggregate(F.col(col)).alias("value"), F.count("*").alias("n"))
    return found.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "value", "n")
