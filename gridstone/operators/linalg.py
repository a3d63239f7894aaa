"""Matrices as coordinate tables (i, j, v), each cell at most once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstone.operators.vector import IDX, Vec, div

#: Side of the result panels of the blocked product, how deep its blocks are, and cells of the inner index that one layer may have.
PANEL_SIDE, PANEL_DEPTH, LAYER_DEPTH = 512, 512, 1 << 17
#: Rows that a block of a slim matrix has at most, and blocks that a shorter one is cut into.
SLIM_ROWS, SLIM_BLOCKS = 64, 256


def _numbers(df: DataFrame, n: int, name: str) -> DataFrame:
    """The numbers from 0 to n - 1 as one column."""
    return df.sparkSession.range(n).select(F.col("id").alias(name))


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Where equal rows of keys stand together."""
    if not len(keys):
        return []
    cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True))


class Mat:
    """``df`` has i, j (BIGINT, from 0) and v; cells that are missing are zero."""

    def __init__(self, df: DataFrame, shape: tuple[int, int]):
        self.df, self.shape = df.select("i", "j", "v"), tuple(shape)

    @staticmethod
    def from_duplicates(rows: DataFrame, shape: tuple[int, int]) -> Mat:
        """Values of equal coordinates are added."""
        return Mat(rows.groupBy("i", "j").agg(F.sum("v").alias("v")), shape)

    @staticmethod
    def from_rows(rows: DataFrame, shape: tuple[int, int]) -> Mat:
        """From one row (i, cells) for each row of the matrix, cells being an array of (j, v)."""
        cells = rows.select("i", F.explode("cells").alias("c"))
        return Mat(cells.select("i", F.col("c.j").alias("j"), F.col("c.v").alias("v")), shape)

    # Products

    def spmv(self, x: Vec, y: Vec | None = None, name: str = "v") -> Vec:
        """A x, or y + A x, with an element for every row; rows without cells give 0.

        The vector is joined by column; Spark broadcasts it if its size is
        below the session's limit and shuffles both sides otherwise. Products
        are added up before they are dealt by row.
        """
        col, zero = x.cols[0], F.lit(0)
        pairs = self.df.join(x.df.select(F.col(IDX).alias("j"), F.col(col).alias("x")), "j")
        found = pairs.groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("s")).withColumnRenamed("i", IDX)
        if y is None:
            return Vec(_numbers(self.df, self.shape[0], IDX).join(found, IDX, "left").select(IDX, F.coalesce("s", zero).alias(name)))
        both = y.df.select(IDX, F.col(y.cols[0]).alias("y")).join(found, IDX, "full")
        return Vec(both.select(IDX, (F.coalesce("y", zero) + F.coalesce("s", zero)).alias(name)))

    def spmm(self, b: DataFrame, n_cols: int | None = None) -> DataFrame:
        """(i, col, v) of the product with a slim dense matrix b (idx, col, x), with a cell for every row and column.

        ``n_cols`` is b's width; without it one aggregate finds it.
        """
        if n_cols is None:
            n_cols = (b.agg(F.max("col")).first()[0] or 0) + 1
        # Blocks of rows of b, so that cells of neighbouring columns meet in one task and are added up before they are dealt by row.
        side = max(1, min(SLIM_ROWS, self.shape[1] // SLIM_BLOCKS))
        own = b.filter(F.col(IDX).isNotNull()).groupBy(IDX).agg(F.collect_list(F.struct("col", "x")).alias("cells"))
        blocks = own.groupBy(div(F.col(IDX), side).alias("blk")).agg(F.map_from_entries(F.collect_list(F.struct(IDX, "cells"))).alias("rows"))
        # Shuffled, as Spark takes tables that were made by explode to be as small as what they were made from, and would broadcast them.
        met = self.df.withColumn("blk", div(F.col("j"), side)).join(blocks.hint("merge"), "blk")
        pairs = met.select("i", "v", F.explode(F.try_element_at("rows", F.col("j"))).alias("c"))
        found = pairs.groupBy("i", F.col("c.col").alias("col")).agg(F.sum(F.col("v") * F.col("c.x")).alias("v"))
        # One array a row, so that zeros are filled by row and not by cell; a row with all its cells is taken as it is.
        whole = found.groupBy("i").agg(F.collect_list(F.struct("col", "v")).alias("own"))
        rows = _numbers(self.df, self.shape[0], "i").join(whole.hint("merge"), "i", "left")
        zero = F.lit(0).cast(found.schema["v"].dataType)
        known = F.map_from_entries(F.coalesce("own", F.array().cast(whole.schema["own"].dataType)))
        every = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(n_cols - 1).cast("bigint")), lambda c: F.struct(c.alias("col"), F.coalesce(F.try_element_at(known, c), zero).alias("v")))
        cells = rows.select("i", F.explode(F.when(F.size("own") == n_cols, F.col("own")).otherwise(every)).alias("c"))
        return cells.select("i", "c.col", "c.v")

    def gemm(self, b: Mat, c: Mat | None = None) -> Mat:
        """A B, or C + A B: a join on the inner index and an aggregate with partial sums."""
        left = self.df.select("i", F.col("j").alias("k"), F.col("v").alias("a"))
        right = b.df.select(F.col("i").alias("k"), "j", F.col("v").alias("b"))
        product = left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))
        if c is not None:
            product = product.unionByName(c.df).groupBy("i", "j").agg(F.sum("v").alias("v"))
        return Mat(product, (self.shape[0], b.shape[1]))

    def gemm_blocked(self, b: Mat, side: int = PANEL_SIDE, depth: int = PANEL_DEPTH, layers: int | None = None) -> Mat:
        """A B on a grid of result panels of side x side cells.

        Cells of A go to every panel of their rows, cells of B to every panel
        of their columns, and each panel is worked by one task, which reads its
        cells in order of the inner index and adds up the products of blocks
        ``depth`` deep; so it holds one panel and one block of each factor, and
        no products of parts are exchanged. A long inner index with few panels
        is cut into ``layers``, as many as LAYER_DEPTH makes of it without one
        given; their panels are then added. Cells that come out as zero are
        left out. Values are doubles.
        """
        (m, inner), n = self.shape, b.shape[1]
        down, across = -(-m // side), -(-n // side)
        if layers is None:
            layers = -(-inner // LAYER_DEPTH) if down * across < inner // LAYER_DEPTH else 1
        span = -(-inner // layers)
        to = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
        layer = lambda k: div(F.col(k), span).cast("int").alias("layer")
        value = F.col("v").cast("double").alias("v")
        left = self.df.select(div(F.col("i"), side).cast("int").alias("r"), to(across).alias("c"), layer("j"), F.lit(False).alias("right"), F.col("j").alias("k"), (F.col("i") % side).cast("int").alias("at"), value)
        right = b.df.select(to(down).alias("r"), div(F.col("j"), side).cast("int").alias("c"), layer("i"), F.lit(True).alias("right"), F.col("i").alias("k"), (F.col("j") % side).cast("int").alias("at"), value)
        keys = ["r", "c", "layer"]
        met = left.union(right).withColumn("block", div(F.col("k"), depth)).repartition(*keys).sortWithinPartitions(*keys, "block")

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            panel: tuple[int, ...] | None = None
            total = np.zeros((side, side))
            held: tuple[tuple[int, ...], list[np.ndarray]] | None = None

            def added(parts: list[np.ndarray]) -> None:
                side_of, k, at, v = (np.concatenate([p[c] for p in parts]) for c in range(4))
                x, y = np.zeros((side, depth)), np.zeros((depth, side))
                own = ~side_of
                x[at[own], k[own] % depth] = v[own]
                y[k[side_of] % depth, at[side_of]] = v[side_of]
                total[:] += x @ y

            def done() -> pa.RecordBatch:
                i, j = np.nonzero(total)
                out = pa.record_batch([pa.array(i + panel[0] * side), pa.array(j + panel[1] * side), pa.array(total[i, j])], ["i", "j", "v"])
                total[:] = 0
                return out

            for batch in batches:
                cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("r", "c", "layer", "block", "right", "k", "at", "v")]
                key = np.stack(cols[:4], 1)
                for a, z in _runs(key):
                    block = tuple(int(x) for x in key[a])
                    if held is not None and held[0] != block:
                        added(held[1])
                        held = None
                    if panel is not None and panel != block[:3]:
                        yield done()
                    panel = block[:3]
                    held = (block, []) if held is None else held
                    held[1].append([x[a:z] for x in cols[4:]])
            if held is not None:
                added(held[1])
                yield done()

        cells = met.select("r", "c", "layer", "block", "right", "k", "at", "v").mapInArrow(work, "i bigint, j bigint, v double")
        if layers > 1:
            cells = cells.groupBy("i", "j").agg(F.sum("v").alias("v"))
        return Mat(cells, (m, n))

    # Parts

    def row(self, i: int) -> Vec:
        """Row i with its zeros."""
        return self._line(F.col("i") == i, "j", self.shape[1])

    def row_cells(self, i: int) -> DataFrame:
        """(idx, v) of the cells that row i has; its zeros have none."""
        return self.df.filter(F.col("i") == i).select(F.col("j").alias(IDX), "v")

    def column(self, j: int) -> Vec:
        """Column j with its zeros."""
        return self._line(F.col("j") == j, "i", self.shape[0])

    def _line(self, kept: Column, along: str, n: int) -> Vec:
        cells = self.df.filter(kept).select(F.col(along).alias(IDX), "v")
        return Vec(_numbers(self.df, n, IDX).join(cells, IDX, "left").select(IDX, F.coalesce("v", F.lit(0)).alias("v")))

    def submatrix(self, rows: tuple[int, int], cols: tuple[int, int]) -> Mat:
        """The cells of [start, end) rows and columns, from (0, 0)."""
        (r0, r1), (c0, c1) = rows, cols
        kept = self.df.filter((F.col("i") >= r0) & (F.col("i") < r1) & (F.col("j") >= c0) & (F.col("j") < c1))
        return Mat(kept.select((F.col("i") - r0).alias("i"), (F.col("j") - c0).alias("j"), "v"), (r1 - r0, c1 - c0))

    def tile(self, bi: int, bj: int, side: tuple[int, int]) -> Mat:
        rows, cols = side
        return self.submatrix((bi * rows, min((bi + 1) * rows, self.shape[0])), (bj * cols, min((bj + 1) * cols, self.shape[1])))

    def with_tile(self, tile: Mat, bi: int, bj: int, side: tuple[int, int]) -> Mat:
        """This matrix with the cells of one tile replaced."""
        r0, c0 = bi * side[0], bj * side[1]
        outside = ~((F.col("i") >= r0) & (F.col("i") < r0 + tile.shape[0]) & (F.col("j") >= c0) & (F.col("j") < c0 + tile.shape[1]))
        moved = tile.df.select((F.col("i") + r0).alias("i"), (F.col("j") + c0).alias("j"), "v")
        return Mat(self.df.filter(outside).unionByName(moved), self.shape)

    def tiled(self, side: tuple[int, int], grid: tuple[int, int] = (1, 1)) -> DataFrame:
        """With block numbers bi, bj and the rank that a block-cyclic grid gives each block."""
        bi, bj = div(F.col("i"), side[0]), div(F.col("j"), side[1])
        return self.df.select("i", "j", "v", bi.alias("bi"), bj.alias("bj"), (bi % grid[0] * grid[1] + bj % grid[1]).cast("bigint").alias("rank"))

    def find(self, i: int, j: int) -> DataFrame:
        return self.df.filter((F.col("i") == i) & (F.col("j") == j))

    # Changes

    def for_each(self, fn: Callable[..., Column]) -> Mat:
        """The cells with fn(i, j, v) for v; cells that are missing stay so."""
        return Mat(self.df.select("i", "j", fn(F.col("i"), F.col("j"), F.col("v")).alias("v")), self.shape)

    def insert(self, new: Mat) -> Mat:
        """New cells are added; cells that exist stay."""
        return Mat(self.df.unionByName(new.df.join(self.df.select("i", "j"), ["i", "j"], "left_anti")), self.shape)

    def insert_or_assign(self, new: Mat) -> Mat:
        """New cells are added and replace those that exist."""
        return Mat(self.df.join(new.df.select("i", "j"), ["i", "j"], "left_anti").unionByName(new.df), self.shape)

    def reshape(self, shape: tuple[int, int]) -> Mat:
        """Cells outside the new shape go."""
        return Mat(self.df.filter((F.col("i") < shape[0]) & (F.col("j") < shape[1])), shape)

    # Formats

    def entries(self, reverse: bool = False) -> DataFrame:
        keys = [F.col("i"), F.col("j")]
        return self.df.orderBy(*[k.desc() if reverse else k.asc() for k in keys])

    def csr(self) -> DataFrame:
        """(i, start, cells): for every row its first place in row-major order and its (j, v) by column; empty rows have none."""
        cells = self.df.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("cells"))
        rows = self.df.sparkSession.range(self.shape[0]).select(F.col("id").alias("i")).join(cells, "i", "left")
        return rows.join(self.row_pointers(), "i").select("i", "start", F.coalesce("cells", F.array().cast("array<struct<j:bigint,v:double>>")).alias("cells"))

    def row_pointers(self, block: int = 1 << 16) -> DataFrame:
        """(i, start) for every row: how many cells come before it; counts by row, then scanned by blocks of rows."""
        counts = self.df.groupBy("i").agg(F.count("*").alias("n"))
        rows = self.df.sparkSession.range(self.shape[0]).select(F.col("id").alias("i")).join(counts, "i", "left").select("i", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
        blocked = rows.withColumn("b", div(F.col("i"), block))
        inner = Window.partitionBy("b").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
        outer = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        zero = F.lit(0).cast("bigint")
        before = blocked.groupBy("b").agg(F.sum("n").alias("t")).select("b", F.coalesce(F.sum("t").over(outer), zero).alias("o"))
        local = blocked.withColumn("s", F.coalesce(F.sum("n").over(inner), zero))
        return local.join(before, "b").select("i", (F.col("o") + F.col("s")).alias("start"))

    def reduce_entries(self, name: str = "value") -> DataFrame:
        """One row: the sum of v + i + j over all cells."""
        return self.df.agg(F.sum(F.col("v") + F.col("i") + F.col("j")).alias(name))
