"""Ghost cells: windows over neighbours, and reductions of ghosts into their owners."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstone.operators.vector import BLOCK_ROWS, IDX, Vec, with_halo


def sliding(vec: Vec, n: int, size: int, block: int = BLOCK_ROWS) -> DataFrame:
    """(idx, window): windows of n elements at each place up to size - n; windows never span the table in one task."""
    col = vec.cols[0]
    spread = with_halo(vec.df.select(IDX, col), 0, n - 1, max(block, n))
    frame = Window.partitionBy("blk").orderBy(IDX).rowsBetween(0, n - 1)
    found = spread.withColumn("window", F.collect_list(col).over(frame))
    return found.filter(F.col("own") & (F.col(IDX) <= size - n)).select(IDX, "window")


def sliding_map(vec: Vec, before: int, after: int, fn: Callable[[list[Column]], Column], size: int, periodic: bool = False, block: int = BLOCK_ROWS, steps: int = 1) -> Vec:
    """Each element with all its neighbours becomes fn of [-before .. after], so many times; elements near an end stay, unless periodic.

    All steps share one exchange: blocks get a halo for every step, and its
    outer rows, wrong after a step, are no longer looked at. With several
    steps values keep the element's type.
    """
    col = vec.cols[0]
    wide = (before * steps, after * steps)
    block = max(block, *wide)
    spread = with_halo(vec.df.select(IDX, col), *wide, block, size if periodic else None)
    w = Window.partitionBy("blk").orderBy(IDX)
    kind = vec.df.schema[col].dataType
    near = [F.lag(col, -d).over(w) if d < 0 else F.lead(col, d).over(w) if d else F.col(col) for d in range(-before, after + 1)]
    inside = F.lit(True) if periodic else (F.col(IDX) >= before) & (F.col(IDX) < size - after)
    for _ in range(steps):
        new = fn(near) if steps == 1 else fn(near).cast(kind)
        spread = spread.withColumn("__new", F.when(inside, new).otherwise(F.col(col))).drop(col).withColumnRenamed("__new", col)
    return Vec(spread.filter("own").select(IDX, col))


def moving_sum(vec: Vec, before: int, after: int, size: int, block: int = BLOCK_ROWS) -> DataFrame:
    """(idx, sum) of interior elements only."""
    col = vec.cols[0]
    spread = with_halo(vec.df.select(IDX, col), before, after, max(block, before, after))
    frame = Window.partitionBy("blk").orderBy(IDX).rowsBetween(-before, after)
    found = spread.withColumn("sum", F.sum(col).over(frame))
    return found.filter(F.col("own") & (F.col(IDX) >= before) & (F.col(IDX) < size - after)).select(IDX, "sum")


#: How a ghost's values fold into its owner: owner's value, then the ghosts'.
FOLDS: dict[str, Callable[[Column], Column]] = {"plus": F.sum, "max": F.max, "min": F.min, "multiplies": F.product}


def ghosts(vec: Vec, before: int, after: int, block: int, size: int | None = None) -> DataFrame:
    """(idx, blk, value) of the ghost cells that each block holds of its neighbours; periodic if size is given."""
    spread = with_halo(vec.df.select(IDX, vec.cols[0]), before, after, block, size)
    found = spread.filter("not own")
    home = found[IDX] if size is None else F.pmod(found[IDX], F.lit(size))
    return found.select(home.cast("bigint").alias(IDX), "blk", F.col(vec.cols[0]).alias("v"))


def halo_reduce(vec: Vec, held: DataFrame, op: str = "plus") -> Vec:
    """The vector with its ghosts ``held`` (idx, v) folded in; ``second`` takes a ghost's value (of several, the largest)."""
    col = vec.cols[0]
    own = vec.df.select(IDX, F.col(col).alias("v"), F.lit(False).alias("ghost"))
    rows = own.unionByName(held.select(IDX, "v", F.lit(True).alias("ghost")))
    folded = F.max_by("v", F.struct("ghost", "v")) if op == "second" else FOLDS[op](F.col("v"))
    return Vec(rows.groupBy(IDX).agg(folded.alias(col)))


def unstructured_exchange(vec: Vec, wanted: DataFrame) -> DataFrame:
    """(blk, idx, value) for an explicit list (idx, blk) of which block needs which element."""
    return wanted.select("blk", IDX).join(vec.df.select(IDX, vec.cols[0]), IDX)
