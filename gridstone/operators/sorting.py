"""Sorting vectors, with positions of the sorted order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cmp_to_key

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridstone.operators.vector import IDX, Vec
from gridstone.sources.shared import written

#: Rows of a range of the index-giving sort, about; ranges are as many as that takes.
RANGE_ROWS = 1 << 20
#: Offsets of ranges are broadcast up to so many ranges, else joined by shuffle.
BROADCAST_RANGES = 1 << 20
#: Rows of a range that a comparator sorts, about; values of the sample for each range; ranges at most.
COMPARED_ROWS, SAMPLE_PER_RANGE, MAX_SPLITTERS = 1 << 17, 64, 1 << 14
#: monotonically_increasing_id holds the partition above so many bits and the row in it below.
ROW_BITS = 33


def sort(vec: Vec, descending: bool = False, by: str | None = None) -> DataFrame:
    """The elements in order: a sampled range exchange and a sort in each range; ties in order of index."""
    key = F.col(by or vec.cols[0])
    return vec.df.orderBy(key.desc() if descending else key.asc(), IDX)


def numbered(rows: DataFrame, keys: list[Column], name: str = IDX, range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with ``name``, their place in the order of the keys, from 0.

    One range exchange, a sort in each range, and each row's number in its
    range, written once so that ranges and numbers are fixed. The counts of the
    ranges, one row each, then give their first places.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // range_rows))
    ranged = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    fixed = written(ranged.withColumn("__gs_at", F.monotonically_increasing_id()), "sorted")
    part, row = F.shiftright("__gs_at", ROW_BITS), F.col("__gs_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    split = fixed.withColumns({"__gs_part": part, "__gs_row": row})
    before = Window.orderBy("__gs_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = split.groupBy("__gs_part").agg(F.count("*").alias("n")).select("__gs_part", F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint")).alias("__gs_start"))
    if parts <= BROADCAST_RANGES:
        starts = F.broadcast(starts)
    return split.join(starts, "__gs_part").withColumn(name, F.col("__gs_start") + F.col("__gs_row")).drop("__gs_at", "__gs_part", "__gs_row", "__gs_start")


def sorted_vector(vec: Vec, descending: bool = False, range_rows: int = RANGE_ROWS) -> Vec:
    """The sorted elements as a vector: place k holds the k-th.

    As the index breaks ties, one hot value is split over ranges like any other.
    """
    col = vec.cols[0]
    rows = vec.df.select(F.col(IDX).alias("__gs_idx"), F.col(col).alias("v"))
    keys = [F.col("v").desc() if descending else F.col("v").asc(), F.col("__gs_idx").asc()]
    return Vec(numbered(rows, keys, IDX, range_rows).select(IDX, F.col("v").alias(col)))


def _placed(values: list, cuts: list, less: Callable[[object, object], int]) -> list[int]:
    """For each value how many of the ordered cuts come before it or at it, by binary search."""
    out = []
    for v in values:
        low, high = 0, len(cuts)
        while low < high:
            mid = (low + high) // 2
            if less(v, cuts[mid]) < 0:
                high = mid
            else:
                low = mid + 1
        out.append(low)
    return out


def sort_by(vec: Vec, compare: Callable[[object, object], int], range_rows: int = COMPARED_ROWS, sample: int = SAMPLE_PER_RANGE) -> Vec:
    """The elements in the order of any comparator, as a vector: place k holds the k-th; ties in order of index.

    ``compare`` is a Python function of two values that gives a negative
    number, zero or a positive one. A sample is sorted into splitters; each
    element finds its range among them by binary search, and each range is
    sorted by one task. Index breaks ties among splitters too, so a value that
    fills many ranges is cut. MAX_SPLITTERS bounds what the driver holds; beyond
    it ranges grow.
    """
    col = vec.cols[0]
    rows = vec.df.select(IDX, F.col(col).alias("v"))
    kind = rows.schema["v"].dataType

    def order(a: tuple, b: tuple) -> int:
        found = compare(a[0], b[0])
        return found if found else (a[1] > b[1]) - (a[1] < b[1])

    n = rows.count()
    parts = max(1, min(MAX_SPLITTERS, -(-n // range_rows)))
    cuts: list[tuple] = []
    if parts > 1:
        # By a hash of the index, so that a run again takes the same.
        share = min(1.0, 1.2 * parts * sample / n)
        drawn = rows.filter(F.shiftrightunsigned(F.xxhash64(IDX), 11) < F.lit(share * float(1 << 53)))
        ordered = sorted(((r.v, r[IDX]) for r in drawn.collect()), key=cmp_to_key(order))
        cuts = [ordered[len(ordered) * k // parts] for k in range(1, parts)] if ordered else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(_placed(pairs, cuts, order), pa.int32()), *batch.columns], ["part", IDX, "v"])

    def sort_range(table: pa.Table) -> pa.Table:
        pairs = list(zip(table["v"].to_pylist(), table[IDX].to_pylist(), range(table.num_rows), strict=True))
        pairs.sort(key=cmp_to_key(order))
        taken = table.take(pa.array([k for _, _, k in pairs], pa.int64()))
        return pa.table([taken["part"], pa.array(range(len(pairs)), pa.int64()), taken["v"]], ["part", "row", "v"])

    dealt = rows.mapInArrow(deal, StructType().add("part", "integer").add(IDX, "long").add("v", kind))
    done = written(dealt.groupBy("part").applyInArrow(sort_range, StructType().add("part", "integer").add("row", "long").add("v", kind)), "compared")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = done.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint")).alias("start"))
    return Vec(done.join(starts, "part").select((F.col("start") + F.col("row")).alias(IDX), F.col("v").alias(col)))


def sort_subrange(vec: Vec, first: int, last: int, descending: bool = False) -> Vec:
    """The vector with [first, last) sorted in place."""
    inner = sorted_vector(vec.slice(first, last), descending)
    return inner.copy_into(Vec(vec.df.select(IDX, vec.cols[0])), first)
