"""Prefix scans in two passes over blocks of the index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from gridstone.operators.reductions import KNOWN, blocks_folded
from gridstone.operators.vector import BLOCK_ROWS, IDX, Vec, div


def _scan(vec: Vec, op: str, init: object, inclusive: bool, block: int, size: int | None) -> Vec:
    """Scan within blocks; then combine each with all that comes before its block, in this order.

    Only the block totals, one row a block, are scanned in one partition. The
    vector itself is dealt by block, so no task holds more than whole blocks.
    A vector known to fit one block is scanned by one window alone.
    """
    aggregate, combine = KNOWN[op]
    col = vec.cols[0]
    if size is not None and size <= block:
        frame = Window.orderBy(IDX).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        own = aggregate(F.col(col)).over(frame)
        found = own if init is None else F.when(own.isNull(), F.lit(init)).otherwise(combine(F.lit(init), own))
        return Vec(vec.df.select(IDX, found.alias(col)))
    rows = vec.df.withColumn("__blk", div(F.col(IDX), block))
    inside = Window.partitionBy("__blk").orderBy(IDX)
    frame = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = rows.withColumn("__s", aggregate(F.col(col)).over(frame))
    totals = rows.groupBy("__blk").agg(aggregate(F.col(col)).alias("__t"))
    before = Window.orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__blk", aggregate(F.col("__t")).over(before).alias("__o"))
    joined = local.join(offsets, "__blk")

    def both(a: Column, b: Column) -> Column:
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(combine(a, b))

    found = both(F.col("__o"), F.col("__s"))
    if init is not None:
        found = both(F.lit(init), found)
    return Vec(joined.select(IDX, found.alias(col)))


def inclusive_scan(vec: Vec, op: str = "plus", init: object = None, block: int = BLOCK_ROWS, size: int | None = None) -> Vec:
    """Element i: the elements up to i combined, after init if given. ``size`` is the length, if it is known."""
    return _scan(vec, op, init, True, block, size)


def exclusive_scan(vec: Vec, init: object, op: str = "plus", block: int = BLOCK_ROWS, size: int | None = None) -> Vec:
    """Element i: init and the elements before i combined. ``size`` is the length, if it is known."""
    return _scan(vec, op, init, False, block, size)


def scan_into(vec: Vec, out: Vec, start: int, stop: int, at: int = 0, **how) -> Vec:
    """out with the inclusive scan of vec[start, stop) written from place ``at`` on; its other elements stay."""
    return inclusive_scan(vec.slice(start, stop), **how).copy_into(out, at)


def scanned(x: np.ndarray, op: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Inclusive scan of an array by an operator on arrays: neighbours are combined, their scan gives every second place."""
    if len(x) < 2:
        return x
    half = scanned(np.asarray(op(x[:-1:2], x[1::2])), op)
    out = np.empty_like(x, dtype=half.dtype)
    out[0] = x[0]
    out[1::2] = half
    out[2::2] = op(half[: len(out[2::2])], x[2::2])
    return out


def scan_with(vec: Vec, op: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: str = "double", block: int = BLOCK_ROWS, n: int | None = None) -> Vec:
    """Inclusive scan by any associative operator on NumPy arrays, commutative or not.

    op gets two arrays of the same length and gives their elementwise
    combination. The totals of blocks are a vector again and scanned the same
    way, so they never meet in one task unless they are one block; each block
    then starts from the total before it, which travels as a row ahead of it:
    through one exchange by block, which Spark neither splits nor reads by parts
    as it may those of a join.
    """
    n = vec.df.count() if n is None else n
    # Blocks of one would never shrink.
    block, col = max(2, block), vec.cols[0]
    rows = vec.df.select(div(F.col(IDX), block).alias("blk"), F.lit(True).alias("own"), IDX, F.col(col).cast(kind).alias("v"))
    if n > block:
        totals = scan_with(Vec(blocks_folded(vec, op, kind, block), ["v"]), op, kind, block, -(-n // block))
        rows = rows.union(totals.df.select(F.col(IDX) + 1, F.lit(False), (F.col(IDX) + 1) * block - 1, "v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            blk, inner, v = batch.column("blk").to_numpy(), batch.column("own").to_numpy(zero_copy_only=False), batch.column("v").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(blk)) + 1).tolist(), len(blk)]
            parts = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if blk[a] != at:
                    at, held = blk[a], None
                if not inner[a]:
                    held = v[a : a + 1] if batch.column("v")[a].is_valid else None
                    a += 1
                if a == b:
                    continue
                own = scanned(v[a:b], op)
                if held is not None:
                    own = np.asarray(op(np.repeat(held, b - a), own))
                held = own[-1:]
                parts.append(own)
            if parts:
                yield pa.record_batch([batch.column(IDX).filter(batch.column("own")), pa.array(np.concatenate(parts), batch.schema.field("v").type)], [IDX, "v"])

    dealt = rows.repartition("blk").sortWithinPartitions("blk", IDX).select("blk", "own", IDX, "v")
    return Vec(dealt.mapInArrow(run, f"{IDX} bigint, v {kind}").select(IDX, F.col("v").alias(col)))
