"""Segments of vectors: places cut like another range's, and work on each segment where it lies."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridstone.operators.lookup import position
from gridstone.operators.vector import IDX, Vec


def starts_of(lengths: DataFrame) -> DataFrame:
    """(idx): where each segment of (segment, n) begins; one row a segment."""
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return lengths.select(F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias(IDX))


def numbered_by(vec: Vec, starts: DataFrame, name: str = "segment") -> Vec:
    """With the number of the segment that holds each element, from the table of their starts (idx).

    Elements and starts meet in one ordered lookup, so there may be as many
    segments as there are elements. Empty segments hold nothing; elements
    before the first start belong to it.
    """
    found = position(vec.df, starts.select(IDX), IDX, True, name)
    return Vec(found.withColumn(name, F.greatest(F.lit(0).cast("bigint"), F.col(name) - 1)), [*vec.cols, name])


def segmented_by(vec: Vec, lengths: list[int], name: str = "segment") -> Vec:
    """Segments of the given lengths; the last takes the rest."""
    table = vec.base.sparkSession.createDataFrame(list(enumerate(lengths)), "segment bigint, n bigint")
    return numbered_by(vec, starts_of(table), name)


def segmented_like(vec: Vec, other: Vec, name: str = "segment") -> Vec:
    """Segments that begin where other's partitions begin; its rows must lie in ranges of the index."""
    return numbered_by(vec, other.segments().select(F.col("first").alias(IDX)), name)


def for_each_segment(vec: Vec, fn: Callable[[np.ndarray, int], np.ndarray], segment: str = "segment", kind: str = "double") -> Vec:
    """The first component with fn of each segment's elements, in order, and the index of its first one.

    fn gives as many elements as it gets. A segment is one group and meets in
    one task, as the part of a range that one process holds; cut long vectors
    into segments that fit.
    """
    col = vec.cols[0]
    rows = vec.df.select(segment, IDX, F.col(col).cast(kind).alias("v"))

    def run(table: pa.Table) -> pa.Table:
        own = table.sort_by(IDX)
        at = own[IDX]
        out = np.asarray(fn(own["v"].to_numpy(), at[0].as_py()))
        if len(out) != own.num_rows:
            raise ValueError(f"{len(out)} elements for {own.num_rows}")
        return pa.table([own[segment], at, pa.array(out, own.schema.field("v").type)], [segment, IDX, col])

    schema = StructType([rows.schema[segment], rows.schema[IDX]]).add(col, rows.schema["v"].dataType)
    return Vec(rows.groupBy(segment).applyInArrow(run, schema).select(IDX, col, segment), [col, segment])
