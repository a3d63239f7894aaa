"""Generated matrices."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.operators.linalg import Mat
from gridstone.operators.vector import div


def band(spark: SparkSession, n: int, up: int = 3, down: int = 3) -> Mat:
    """Ones on the diagonals from ``down`` below to ``up`` above."""
    rows = spark.range(n).select(F.col("id").alias("i"))
    cols = F.sequence(F.greatest(F.lit(0).cast("bigint"), F.col("i") - down), F.least(F.lit(n - 1).cast("bigint"), F.col("i") + up))
    return Mat(rows.select("i", F.explode(cols).alias("j"), F.lit(1.0).alias("v")), (n, n))


#: Rows that a task generates at most.
TASK_CELLS = 1 << 24


def _passed(df: DataFrame, sides: tuple[int, int], key: int, back: bool = False) -> DataFrame:
    """Numbers x below the product of ``sides`` permuted by three Feistel rounds on (x div side, x % side), or put back; others stay.

    Each round is a projection of its own, so that its hash is taken once.
    """
    names = ("__l", "__r")
    df = df.withColumns({"__l": div(F.col("x"), sides[1]), "__r": F.col("x") % sides[1]})
    for k in (2, 1, 0) if back else (0, 1, 2):
        own, other, n = names[k % 2], names[1 - k % 2], sides[k % 2]
        # 31 bits of a hash, scaled to the side.
        by = F.shiftright(F.shiftrightunsigned(F.xxhash64(other, F.lit(key * 4 + k)), 33) * n, 31)
        df = df.withColumn(own, (F.col(own) + (F.lit(n).cast("bigint") - by if back else by)) % n)
    x = F.when(F.col("x") < sides[0] * sides[1], F.col("__l") * sides[1] + F.col("__r")).otherwise(F.col("x"))
    return df.withColumn("x", x).drop(*names)


def _sides(cells: int) -> tuple[tuple[int, int], int]:
    """The sides of a rectangle of almost all numbers below ``cells``, and how many it leaves over, fewer than its shorter side."""
    side = max(1, math.isqrt(cells))
    other = max(1, cells // side)
    return (side, other), max(0, cells - side * other)


def random_cells(spark: SparkSession, shape: tuple[int, int], density: float = 0.01, seed: int = 0) -> DataFrame:
    """(n, i, j, v): the cells of ``random_sparse`` with their numbers n, gapless from 0."""
    cells = shape[0] * shape[1]
    sides, left = _sides(cells)
    n = int(density * cells)
    numbers = spark.range(0, n, 1, max(spark.sparkContext.defaultParallelism, -(-n // TASK_CELLS)))
    # What the first pass leaves alone is moved into the second one's rectangle.
    first = _passed(numbers.select(F.col("id").alias("n"), F.col("id").alias("x")), sides, 2 * seed)
    cell = _passed(first.withColumn("x", (F.col("x") + left) % max(1, cells)), sides, 2 * seed + 1)
    value = F.shiftrightunsigned(F.xxhash64("x", F.lit(seed + 1)), 11) / F.lit(float(1 << 53))
    return cell.select("n", div(F.col("x"), shape[1]).alias("i"), (F.col("x") % shape[1]).alias("j"), value.alias("v"))


def with_numbers(cells: DataFrame, shape: tuple[int, int], seed: int = 0, name: str = "number") -> DataFrame:
    """Rows (i, j) with the number that ``random_cells`` gives this cell, from the cell alone."""
    total = shape[0] * shape[1]
    sides, left = _sides(total)
    last = _passed(cells.withColumn("x", F.col("i") * shape[1] + F.col("j")), sides, 2 * seed + 1, True)
    return _passed(last.withColumn("x", (F.col("x") + (total - left)) % max(1, total)), sides, 2 * seed, True).withColumnRenamed("x", name)


def random_sparse(spark: SparkSession, shape: tuple[int, int], density: float = 0.01, seed: int = 0) -> Mat:
    """floor(density * cells) distinct cells with values in [0, 1).

    The cells of the numbers from 0 on under a seeded permutation of all cell
    numbers, so they are distinct without a sort, a join or a retry, whatever
    the shape; the permutation never leaves the matrix, so each number takes
    the same few steps.
    """
    return Mat(random_cells(spark, shape, density, seed), shape)
