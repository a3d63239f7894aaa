"""Sparse matrices in compressed blocks of rows: packed row pointers, columns and values, worked by NumPy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.operators.linalg import Mat
from gridstone.operators.sorting import numbered
from gridstone.operators.vector import IDX, Vec, div

#: Cells of a block, and elements of one stretch of the vector that blocks are multiplied with (2 MB).
BLOCK_CELLS, STRETCH = 1 << 18, 1 << 18
PACKED = "struct<rows:array<bigint>,starts:array<int>,cols:array<bigint>,vals:array<double>>"


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows), kind) if rows else pa.array([], kind))


def _parts(lists: pa.Array) -> list[np.ndarray]:
    data, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _pack(cells: pa.Array) -> pa.Array:
    """Cells (i, j, v) of each block in row-major order, the rows that have any, and where each begins."""
    at, flat = cells.offsets.to_numpy(), cells.values
    i, j, v = (flat.field(c).to_numpy(zero_copy_only=False) for c in "ijv")
    rows, starts, cols, vals = [], [], [], []
    for a, b in zip(at[:-1], at[1:], strict=True):
        order = np.lexsort((j[a:b], i[a:b]))
        own, first = np.unique(i[a:b][order], return_index=True)
        rows.append(own)
        starts.append(np.append(first, b - a))
        cols.append(j[a:b][order])
        vals.append(v[a:b][order])
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
    return pa.StructArray.from_arrays([_lists(x, k) for x, k in zip((rows, starts, cols, vals), kinds, strict=True)], ["rows", "starts", "cols", "vals"])


class Csr:
    """``df`` has a row for each block and stretch of columns: blk, stretch, n (cells), first and last (rows), rows (those
    with cells), starts (into cols and vals, one more than rows), cols and vals."""

    def __init__(self, df: DataFrame, shape: tuple[int, int], stretch: int):
        self.df, self.shape, self.stretch = df, tuple(shape), stretch

    @staticmethod
    def _packed(cells: DataFrame, shape: tuple[int, int], stretch: int) -> Csr:
        """From cells with their block in blk."""
        keyed = cells.select("blk", div(F.col("j"), stretch).alias("stretch"), F.struct("i", "j", F.col("v").cast("double").alias("v")).alias("cell"))
        packed = F.arrow_udf(_pack, PACKED)("cells")
        blocks = keyed.groupBy("blk", "stretch").agg(F.collect_list("cell").alias("cells")).select("blk", "stretch", packed.alias("p"))
        part = lambda c: F.col(f"p.{c}").alias(c)
        ends = [F.size("p.cols").cast("bigint").alias("n"), F.get("p.rows", F.lit(0)).alias("first"), F.element_at("p.rows", -1).alias("last")]
        return Csr(blocks.select("blk", "stretch", *ends, *[part(c) for c in ("rows", "starts", "cols", "vals")]), shape, stretch)

    @staticmethod
    def by_rows(mat: Mat, rows: int, stretch: int = STRETCH) -> Csr:
        """Blocks of so many rows each; for matrices whose rows are of similar lengths."""
        return Csr._packed(mat.df.withColumn("blk", div(F.col("i"), rows)), mat.shape, stretch)

    @staticmethod
    def balanced(mat: Mat, cells: int = BLOCK_CELLS, stretch: int = STRETCH) -> Csr:
        """Blocks of so many cells each, in row-major order, the last perhaps smaller.

        A block begins where the one before it is full, in the midst of a row
        if need be, so a row of any length is shared by as many blocks as it fills.
        """
        placed = numbered(mat.df.select("i", "j", "v"), [F.col("i"), F.col("j")], "place")
        return Csr._packed(placed.withColumn("blk", div(F.col("place"), cells)), mat.shape, stretch)

    def _unpacked(self, blocks: DataFrame) -> DataFrame:
        def repeat(rows: pa.Array, starts: pa.Array) -> pa.Array:
            return _lists([np.repeat(r, np.diff(s)) for r, s in zip(_parts(rows), _parts(starts), strict=True)], pa.int64())

        whole = F.arrow_udf(repeat, "array<bigint>")("rows", "starts")
        cells = blocks.select(F.explode(F.arrays_zip(whole.alias("i"), F.col("cols").alias("j"), F.col("vals").alias("v"))).alias("c"))
        return cells.select(F.col("c.i").alias("i"), F.col("c.j").alias("j"), F.col("c.v").alias("v"))

    def cells(self) -> Mat:
        """The matrix as coordinates."""
        return Mat(self._unpacked(self.df), self.shape)

    def row(self, i: int) -> DataFrame:
        """(idx, v) of the cells of row i: blocks by their first and last row, then one slice of each."""
        held = self.df.filter((F.col("first") <= i) & (F.col("last") >= i)).withColumn("at", F.array_position("rows", F.lit(i).cast("bigint")).cast("int")).filter("at > 0")
        begin = F.element_at("starts", F.col("at"))
        size = F.element_at("starts", F.col("at") + 1) - begin
        cut = lambda c: F.slice(c, begin + 1, size)
        cells = held.select(F.explode(F.arrays_zip(cut("cols").alias("j"), cut("vals").alias("v"))).alias("c"))
        return cells.select(F.col("c.j").alias(IDX), F.col("c.v").alias("v"))

    def submatrix(self, rows: tuple[int, int], cols: tuple[int, int]) -> Mat:
        """The cells of [start, end) rows and columns, from (0, 0); blocks that lie outside are not unpacked."""
        (r0, r1), (c0, c1) = rows, cols
        near = (F.col("last") >= r0) & (F.col("first") < r1) & F.col("stretch").between(c0 // self.stretch, max(c0, c1 - 1) // self.stretch)
        return Mat(self._unpacked(self.df.filter(near)), self.shape).submatrix(rows, cols)

    def row_counts(self) -> DataFrame:
        """(i, n): how many cells each row has that has any; rows cut by blocks are added up."""
        size = F.transform(F.slice("starts", 2, F.size("rows")), lambda s, k: s - F.get("starts", k))
        counts = self.df.select(F.explode(F.arrays_zip(F.col("rows").alias("i"), size.alias("n"))).alias("c"))
        return counts.groupBy(F.col("c.i").alias("i")).agg(F.sum(F.col("c.n").cast("bigint")).alias("n"))

    def spmv(self, x: Vec, y: Vec | None = None, name: str = "v") -> Vec:
        """A x, or y + A x, as doubles, with an element for every row.

        x travels as packed stretches, one row for STRETCH elements, to the
        blocks that have columns there; a block becomes one sum for each of
        its rows, and only rows that several blocks share have more than one
        sum to add.
        """
        stretch = self.stretch

        def gather(items: pa.Array) -> pa.Array:
            at, flat = items.offsets.to_numpy(), items.values
            place, value = flat.field("at").to_numpy(), flat.field("x").to_numpy()
            out = []
            for a, b in zip(at[:-1], at[1:], strict=True):
                own = np.zeros(int(place[a:b].max()) + 1)
                own[place[a:b]] = value[a:b]
                out.append(own)
            return _lists(out, pa.float64())

        item = F.struct((F.col(IDX) % stretch).cast("int").alias("at"), F.col(x.cols[0]).cast("double").alias("x"))
        packed = x.df.groupBy(div(F.col(IDX), stretch).alias("stretch")).agg(F.collect_list(item).alias("items"))
        packed = packed.select("stretch", F.arrow_udf(gather, "array<double>")("items").alias("x"))

        def multiply(rows: pa.Array, starts: pa.Array, cols: pa.Array, vals: pa.Array, xs: pa.Array) -> pa.Array:
            own, sums = [], []
            for r, s, c, v, part in zip(*map(_parts, (rows, starts, cols, vals, xs)), strict=True):
                place = c % stretch
                known = place < len(part)
                near = np.where(known, part[np.where(known, place, 0)] if len(part) else 0.0, 0.0)
                own.append(r)
                sums.append(np.add.reduceat(v * near, s[:-1]))
            return pa.StructArray.from_arrays([_lists(own, pa.int64()), _lists(sums, pa.float64())], ["i", "s"])

        met = self.df.join(packed, "stretch")
        out = met.select(F.arrow_udf(multiply, "struct<i:array<bigint>,s:array<double>>")("rows", "starts", "cols", "vals", "x").alias("p"))
        sums = out.select(F.explode(F.arrays_zip(F.col("p.i").alias("i"), F.col("p.s").alias("s"))).alias("c"))
        found = sums.groupBy(F.col("c.i").alias(IDX)).agg(F.sum("c.s").alias("s"))
        rows = self.df.sparkSession.range(self.shape[0]).select(F.col("id").alias(IDX)) if y is None else y.df.select(IDX, F.col(y.cols[0]).cast("double").alias("y"))
        base: Column = F.lit(0.0) if y is None else F.coalesce("y", F.lit(0.0))
        return Vec(rows.join(found, IDX, "left").select(IDX, (base + F.coalesce("s", F.lit(0.0))).alias(name)))
