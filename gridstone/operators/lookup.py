"""Ordered lookups: where values fall in a sorted table, and the row of it that stands before them.

Probes and table meet in one range exchange over the value and are merged in
one pass; what a range needs from the ranges before it is one carry row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridstone.operators.vector import IDX, Vec
from gridstone.sources.shared import written


def _merged(probes: DataFrame, table: DataFrame, on: str, by: str | None, key_first: bool) -> DataFrame:
    """Both as rows (part, carry, group, probe, n, key), written once.

    A probe has the number of table rows before it in its range and the last
    of them of its group; each range adds a carry row with the number of its
    table rows and the last of them. Ranges are cut over (group, value, which
    table, row), so a value that fills many ranges is split like any other;
    only rows that are equal in all columns stay together.
    """
    group = lambda df: (F.col(by) if by else F.lit(None).cast("int")).alias("g")
    kind = lambda df: StructType(df.schema.fields)
    null = lambda df: F.lit(None).cast(kind(df))
    left = probes.select(group(probes), F.col(on).alias("at"), F.lit(1 if key_first else 0).alias("side"), F.xxhash64(F.struct("*")).alias("tie"), F.struct("*").alias("probe"), null(table).alias("key"))
    # Without a group the count serves, and rows of the table lose what they carry but that they are there.
    right = table.filter(F.col(on).isNotNull()).select(group(table), F.col(on).alias("at"), F.lit(0 if key_first else 1).alias("side"), F.xxhash64(F.struct("*")).alias("tie"), null(probes).alias("probe"), F.struct("*").alias("key"))
    both = left.union(right)
    # Signed zeros are one value and NaN is the greatest, as everywhere in Spark's orders.
    order = ["g", "at", "side", "tie"]
    ranged = both.repartitionByRange(*order).sortWithinPartitions(*order).select("g", "probe", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, held = TaskContext.get().partitionId(), 0, None
        types = None
        for batch in batches:
            own = pa.Table.from_batches([batch])
            types = batch.schema
            if held is not None:
                own = pa.concat_tables([held, own])
            is_key = np.asarray(pc.is_valid(own["key"]).to_numpy())
            last = np.maximum.accumulate(np.where(is_key, np.arange(own.num_rows), -1))
            # The held row was counted with its own batch.
            before = count + np.cumsum(is_key) - (held is not None)
            rows = np.flatnonzero(~is_key)
            count += int(is_key.sum()) - (held is not None)
            if len(rows):
                at = pa.array(last[rows], mask=last[rows] < 0)
                group, near = own["g"].take(rows), own["g"].take(at)
                same = pc.and_(pc.is_valid(at), pc.or_(pc.fill_null(pc.equal(group, near), False), pc.and_(pc.is_null(group), pc.is_null(near))))
                key = own["key"].take(pc.if_else(same, at, pa.scalar(None, at.type)))
                columns = [pa.array(np.full(len(rows), part, np.int32)), pa.array(np.zeros(len(rows), bool)), group, own["probe"].take(rows), pa.array(before[rows].astype(np.int64)), key]
                yield from pa.table(columns, names=["part", "carry", "g", "probe", "n", "key"]).combine_chunks().to_batches()
            held = own.slice(int(last[-1]), 1).combine_chunks() if last[-1] >= 0 else None
        if types is not None:
            one = held if held is not None else pa.table([pa.nulls(1, types.field(k).type) for k in ("g", "probe", "key")], names=["g", "probe", "key"])
            columns = [pa.array([part], pa.int32()), pa.array([True]), one["g"], pa.nulls(1, types.field("probe").type), pa.array([count], pa.int64()), one["key"]]
            yield from pa.table(columns, names=["part", "carry", "g", "probe", "n", "key"]).combine_chunks().to_batches()

    out = StructType().add("part", "integer").add("carry", "boolean").add("g", both.schema["g"].dataType).add("probe", kind(probes)).add("n", "long").add("key", kind(table))
    return written(ranged.mapInArrow(run, out), "merged")


def position(probes: DataFrame, table: DataFrame, on: str, right: bool = False, name: str = "position") -> DataFrame:
    """probes with ``name``: how many rows of table have a smaller value in ``on`` (with ``right``: a smaller or the same).

    That is the first place of the sorted table where the value could stand,
    or the first behind its equals. Null values of the table count for nothing,
    and a null probe has a null position.
    """
    found = _merged(probes, table.select(on), on, None, right)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One carry row a range.
    starts = found.filter("carry").select("part", F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint")).alias("start"))
    rows = found.filter("not carry").join(starts, "part")
    where = F.when(F.col(f"probe.{on}").isNotNull(), F.col("n") + F.col("start"))
    return rows.select(*[F.col("probe")[c].alias(c) for c in probes.columns if c != name], where.alias(name))


def asof(probes: DataFrame, table: DataFrame, on: str, by: str | None = None, exact: bool = True, name: str = "found") -> DataFrame:
    """probes with ``name``, the last row (as a struct) of table at or before each in ``on``, null without one.

    With ``by`` only rows of the same value there count, nulls being the same;
    without ``exact`` only earlier ones. Of table rows equal in ``on`` and
    ``by`` the one with the greatest hash of its columns is taken. Null values
    in ``on`` find nothing.
    """
    found = _merged(probes, table, on, by, exact)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("key").isNotNull(), F.struct("g", "key")), True).over(before)
    carried = found.filter("carry").select("part", last.alias("old"))
    rows = found.filter("not carry").join(carried, "part")
    key = F.coalesce("key", F.when(F.col("old").isNotNull() & F.col("g").eqNullSafe(F.col("old.g")), F.col("old.key")))
    return rows.select(*[F.col("probe")[c].alias(c) for c in probes.columns if c != name], F.when(F.col(f"probe.{on}").isNotNull(), key).alias(name))


def lower_bound(probes: Vec, table: Vec) -> Vec:
    """For each element of probes the first place in the sorted table that is not smaller."""
    return _bound(probes, table, False)


def upper_bound(probes: Vec, table: Vec) -> Vec:
    """For each element of probes the first place in the sorted table that is greater."""
    return _bound(probes, table, True)


def _bound(probes: Vec, table: Vec, right: bool) -> Vec:
    found = position(probes.df.select(IDX, F.col(probes.cols[0]).alias("v")), table.df.select(F.col(table.cols[0]).alias("v")), "v", right)
    return Vec(found.select(IDX, "position"), ["position"])
