"""Reductions of vectors; each is one partial and one final aggregate."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.operators.vector import BLOCK_ROWS, IDX, Vec, div, zipped

#: Operators that Spark aggregates by itself, and how two values combine.
KNOWN: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "plus": (F.sum, lambda a, b: a + b),
    "multiplies": (F.product, lambda a, b: a * b),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
    "and": (F.bool_and, lambda a, b: a & b),
    "or": (F.bool_or, lambda a, b: a | b),
    "bit_xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b)),
}


def reduce(vec: Vec, op: str = "plus", init: object = None, name: str = "value") -> DataFrame:
    """One row: the elements combined by a known associative operator, after init if given; empty gives init (or null)."""
    aggregate, combine = KNOWN[op]
    col = F.col(vec.cols[0])
    whole = vec.df.agg(aggregate(col).alias("__r"))
    if init is None:
        return whole.select(F.col("__r").alias(name))
    first = F.lit(init)
    return whole.select(F.when(F.col("__r").isNull(), first).otherwise(combine(first, F.col("__r"))).alias(name))


def folded(x: np.ndarray, op: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """One element: x combined in order by an operator on arrays, as a tree of neighbours, in about log2(len(x)) calls."""
    while len(x) > 1:
        pairs = op(x[:-1:2], x[1::2])
        x = np.append(pairs, x[-1:]) if len(x) % 2 else np.asarray(pairs)
    return x


def blocks_folded(vec: Vec, op: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: str, block: int) -> DataFrame:
    """(idx, v): the elements of each block of the index combined, blocks being numbered from 0.

    A block of any size reaches its task in Arrow batches, which are folded one by one.
    """
    col = vec.cols[0]
    rows = vec.df.select(div(F.col(IDX), block).alias("blk"), F.col(IDX), F.col(col).cast(kind).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            blk, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(blk)) + 1).tolist(), len(blk)]
            done = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                own = folded(v[a:b], op)
                if blk[a] == at:
                    own = op(held, own)
                elif at is not None:
                    done.append((at, held))
                at, held = int(blk[a]), own
            if done:
                yield pa.record_batch([pa.array([d[0] for d in done], pa.int64()), pa.array(np.concatenate([d[1] for d in done]), batch.schema.field(1).type)], [IDX, "v"])
            types = batch.schema.field(1).type
        if at is not None:
            yield pa.record_batch([pa.array([at], pa.int64()), pa.array(held, types)], [IDX, "v"])

    dealt = rows.repartition("blk").sortWithinPartitions("blk", IDX).select("blk", "v")
    return dealt.mapInArrow(run, f"{IDX} bigint, v {kind}")


def reduce_with(vec: Vec, op: Callable[[np.ndarray, np.ndarray], np.ndarray], init: object, kind: str = "double", block: int = BLOCK_ROWS, n: int | None = None) -> DataFrame:
    """One row: the elements combined in order by any associative operator on NumPy arrays, after init.

    op gets two arrays of the same length and gives their elementwise
    combination; it need not be commutative. Blocks of the index are folded
    where they are dealt to; the blocks' results are a vector again, folded the
    same way until one is left. ``n`` is the vector's length, if it is known.
    """
    n = vec.df.count() if n is None else n
    if n == 0:
        return vec.base.sparkSession.createDataFrame([(init,)], f"value {kind}")
    # Blocks of one would never shrink.
    state, block = vec, max(2, block)
    while True:
        state = Vec(blocks_folded(state, op, kind, block), ["v"])
        n = -(-n // block)
        if n == 1:
            break

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.record_batch([pa.array(np.asarray(op(np.array([init] * len(v), v.dtype), v)), batch.schema.field(0).type)], ["value"])

    return state.df.select("v").mapInArrow(last, f"value {kind}")


def count(vec: Vec, value: object, name: str = "n") -> DataFrame:
    return count_if(vec, lambda x: x == F.lit(value), name)


def count_if(vec: Vec, predicate: Callable[..., Column], name: str = "n") -> DataFrame:
    return vec.df.agg(F.count_if(predicate(*[F.col(c) for c in vec.cols])).alias(name))


def equal(a: Vec, b: Vec, name: str = "equal") -> DataFrame:
    """One row: 1 if both have the same length and elements, else 0. Two empty vectors are equal."""
    left = a.df.select(IDX, F.col(a.cols[0]).alias("x"), F.lit(1).alias("l"))
    right = b.df.select(IDX, F.col(b.cols[0]).alias("y"), F.lit(1).alias("r"))
    wrong = F.count_if(F.col("l").isNull() | F.col("r").isNull() | ~F.col("x").eqNullSafe(F.col("y")))
    return left.join(right, IDX, "full").agg((wrong == 0).cast("int").alias(name))


def dot_product(a: Vec, b: Vec, name: str = "dot") -> DataFrame:
    return reduce(zipped(a, b).transform(lambda x, y: x * y), "plus", None, name)
