"""Matrices from and to Matrix Market coordinate files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.operators.linalg import Mat
from gridstone.sources import market_files


def read(spark: SparkSession, path: str, one_indexed: bool = True, checked: bool = True) -> Mat:
    """A real, integer or pattern matrix, general or symmetric, as coordinates from 0.

    The head alone is read here; the cells are read by byte ranges when they
    are used. Cells of a symmetric matrix come with their mirror images, those
    of a pattern have value 1. A wrong banner, another kind or symmetry is a
    ValueError here; so are a coordinate out of bounds and a wrong number of
    cells, which one aggregate finds. Without ``checked`` there is no such job,
    and a coordinate out of bounds fails the task that reads it.
    """
    market_files.register(spark)
    head = market_files.head_of(*market_files.opened(path))
    cells = lambda bounds: spark.read.format(market_files.FORMAT).options(base=str(int(one_indexed)), bounds=bounds).load(path)
    if checked:
        _check(cells("false"), head)
    return Mat(cells("true"), (head.rows, head.cols))


def _check(cells: DataFrame, head: market_files.Head) -> None:
    outside = F.count_if((F.col("i") < 0) | (F.col("i") >= head.rows) | (F.col("j") < 0) | (F.col("j") >= head.cols))
    count, wrong, diagonal = cells.agg(F.count("*"), outside, F.count_if(F.col("i") == F.col("j"))).first()
    if wrong:
        raise ValueError(f"{wrong} coordinates out of bounds")
    count = (count + diagonal) // 2 if head.symmetric else count
    if count != head.cells:
        raise ValueError(f"{count} cells, {head.cells} announced")


def write(mat: Mat, path: str, mode: str = "append") -> None:
    """The matrix as a folder of Matrix Market text; it is there whole, with the count of its cells, or not at all."""
    market_files.register(mat.df.sparkSession)
    cells = mat.df.select("i", "j", F.col("v").cast("double").alias("v"))
    cells.write.format(market_files.FORMAT).options(rows=str(mat.shape[0]), cols=str(mat.shape[1])).mode(mode).save(path)


def distributed(mat: Mat, side: tuple[int, int], parts: int) -> DataFrame:
    """The cells with their tile, dealt by tile."""
    return mat.tiled(side).repartition(parts, "bi", "bj")
