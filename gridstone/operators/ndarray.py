"""N-dimensional arrays: one row a cell, one BIGINT column a dimension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.operators.vector import IDX, Vec, div, printed

DIMS = ("i", "j", "k")


def strides(shape: tuple[int, ...]) -> tuple[int, ...]:
    """Row-major distances between neighbours of each dimension."""
    out = [1]
    for n in reversed(shape[1:]):
        out.append(out[-1] * n)
    return tuple(reversed(out))


def linear_to_index(idx: Column, shape: tuple[int, ...]) -> list[Column]:
    return [(div(idx, s) % n) for s, n in zip(strides(shape), shape, strict=True)]


def index_to_linear(dims: list[Column], shape: tuple[int, ...]) -> Column:
    return sum((d * s for d, s in zip(dims, strides(shape), strict=True)), F.lit(0).cast("bigint"))


class NdArray:
    """``df`` has the columns ``dims`` (each cell once) and value columns ``cols``."""

    def __init__(self, df: DataFrame, shape: tuple[int, ...], cols: list[str] | None = None):
        self.shape, self.dims = tuple(shape), list(DIMS[: len(shape)])
        self.cols = list(cols or [c for c in df.columns if c not in self.dims])
        self.df = df.select(*self.dims, *self.cols)

    @staticmethod
    def reshape(vec: Vec, shape: tuple[int, ...]) -> NdArray:
        """The vector's elements in row-major order."""
        dims = linear_to_index(F.col(IDX), shape)
        named = [d.alias(name) for d, name in zip(dims, DIMS, strict=False)]
        return NdArray(vec.df.select(*named, *vec.cols), shape, vec.cols)

    def flatten(self) -> Vec:
        return Vec(self.df.select(index_to_linear([F.col(d) for d in self.dims], self.shape).alias(IDX), *self.cols), self.cols)

    def rows(self) -> Vec:
        """A matrix as a vector of its rows, each an array of the first component."""
        cells = F.sort_array(F.collect_list(F.struct("j", F.col(self.cols[0]).alias("v"))))
        return Vec(self.df.groupBy(F.col("i").cast("bigint").alias(IDX)).agg(F.transform(cells, lambda c: c["v"]).alias("row")))

    @staticmethod
    def from_rows(rows: Vec, shape: tuple[int, int], name: str = "v") -> NdArray:
        """A matrix from a vector of arrays."""
        flat = rows.df.select(F.col(IDX).alias("i"), F.posexplode(rows.cols[0]).alias("j", name))
        return NdArray(flat.select("i", F.col("j").cast("bigint").alias("j"), name), shape)

    def inside(self, starts: tuple[int, ...], ends: tuple[int, ...]) -> Column:
        found = F.lit(True)
        for d, lo, hi in zip(self.dims, starts, ends, strict=True):
            found = found & (F.col(d) >= lo) & (F.col(d) < hi)
        return found

    def box(self, starts: tuple[int, ...], ends: tuple[int, ...], rebase: bool = False) -> NdArray:
        """The cells of [start, end) in each dimension, with their own indices or from 0."""
        cut = self.df.filter(self.inside(starts, ends))
        if rebase:
            cut = cut.withColumns({d: F.col(d) - lo for d, lo in zip(self.dims, starts, strict=True)})
            return NdArray(cut, tuple(hi - lo for lo, hi in zip(starts, ends, strict=True)), self.cols)
        return NdArray(cut, self.shape, self.cols)

    def at(self, *index: int) -> object:
        where = F.lit(True)
        for d, k in zip(self.dims, index, strict=True):
            where = where & (F.col(d) == k)
        row = self.df.filter(where).select(self.cols[0]).first()
        if row is None:
            raise IndexError(index)
        return row[0]

    def extent(self, dim: int) -> int:
        return self.shape[dim]

    def equal(self, other: NdArray) -> bool:
        """Whether shapes and the first components agree, in one full join."""
        if self.shape != other.shape:
            return False
        a = self.df.select(*self.dims, F.lit(True).alias("__a"), F.col(self.cols[0]).alias("__x"))
        b = other.df.select(*self.dims, F.lit(True).alias("__b"), F.col(other.cols[0]).alias("__y"))
        both = a.join(b, self.dims, "full")
        return both.filter(F.col("__a").isNull() | F.col("__b").isNull() | ~F.col("__x").eqNullSafe(F.col("__y"))).isEmpty()

    def __str__(self) -> str:
        return printed(self.df.orderBy(*self.dims).select(self.cols[0]), self.shape)

    def permute(self, order: tuple[int, ...]) -> NdArray:
        """Dimension ``order[d]`` becomes dimension d: a renaming of columns, without any exchange."""
        named = [F.col(self.dims[o]).alias(d) for d, o in zip(self.dims, order, strict=True)]
        return NdArray(self.df.select(*named, *self.cols), tuple(self.shape[o] for o in order), self.cols)

    def transpose(self, forward: bool = True) -> NdArray:
        """2-d: (i, j) to (j, i). 3-d: forward (i, j, k) to (j, k, i), otherwise back."""
        if len(self.shape) == 2:
            return self.permute((1, 0))
        return self.permute((1, 2, 0) if forward else (2, 0, 1))

    def zip(self, other: NdArray, names: list[str]) -> NdArray:
        fresh = iter(names)
        a = self.df.select(*self.dims, *[F.col(c).alias(next(fresh)) for c in self.cols])
        b = other.df.select(*self.dims, *[F.col(c).alias(next(fresh)) for c in other.cols])
        return NdArray(a.join(b, self.dims), self.shape, names)

    def for_each(self, fn: Callable[..., Column], name: str | None = None) -> NdArray:
        """One component from all components."""
        name = name or self.cols[0]
        return NdArray(self.df.withColumn(name, fn(*[F.col(c) for c in self.cols])), self.shape)

    def for_each_indexed(self, fn: Callable[..., Column], name: str | None = None) -> NdArray:
        """As for_each; fn gets the dimensions first."""
        name = name or self.cols[0]
        return NdArray(self.df.withColumn(name, fn(*[F.col(d) for d in self.dims], *[F.col(c) for c in self.cols])), self.shape)

    def neighbours(self, wanted: dict[str, tuple[str, tuple[int, ...]]]) -> NdArray:
        """With new columns: name -> (component, offset) holds the component of the cell that lies offset away, null outside.

        Each cell is sent once to every cell that looks at it, tagged, and
        gathered by one aggregate: a single exchange for any number of
        dimensions, with no window over whole rows or columns.
        """
        tags = list(wanted.items())
        rows = []
        for k, (_, (col, off)) in enumerate(tags):
            moved = [(F.col(d) - o).cast("bigint").alias(d) for d, o in zip(self.dims, off, strict=True)]
            rows.append(F.struct(*moved, F.lit(k).alias("tag"), F.col(col).cast("double").alias("x")))
        own = F.struct(*[F.col(d).cast("bigint").alias(d) for d in self.dims], F.lit(-1).alias("tag"), F.lit(None).cast("double").alias("x"))
        sent = self.df.select(F.when(F.lit(True), F.struct(*self.cols)).alias("own"), F.explode(F.array(own, *rows)).alias("r"))
        sent = sent.select(*[F.col(f"r.{d}").alias(d) for d in self.dims], F.col("r.tag").alias("tag"), F.col("r.x").alias("x"), F.when(F.col("r.tag") == -1, F.col("own")).alias("own"))
        in_shape = F.lit(True)
        for d, n in zip(self.dims, self.shape, strict=True):
            in_shape = in_shape & (F.col(d) >= 0) & (F.col(d) < n)
        kept = [F.max(F.when(F.col("tag") == -1, F.col(f"own.{c}"))).alias(c) for c in self.cols]
        seen = [F.max(F.when(F.col("tag") == k, F.col("x"))).alias(name) for k, (name, _) in enumerate(tags)]
        here = F.max(F.col("tag") == -1).alias("__here")
        found = sent.filter(in_shape).groupBy(*self.dims).agg(*kept, *seen, here).filter("__here").drop("__here")
        return NdArray(found, self.shape, [*self.cols, *wanted])

    def stencil(self, fn: Callable[..., Column], offsets: list[tuple[int, ...]], starts: tuple[int, ...], ends: tuple[int, ...], col: str | None = None, out: str | None = None) -> NdArray:
        """``out`` becomes fn of the cells at ``offsets`` inside the box; elsewhere it stays."""
        col = col or self.cols[0]
        out = out or col
        wanted = {f"__n{k}": (col, off) for k, off in enumerate(offsets)}
        near = self.neighbours(wanted)
        new = F.when(self.inside(starts, ends), fn(*[F.col(c) for c in wanted])).otherwise(F.col(out))
        return NdArray(near.df.withColumn(out, new), self.shape, self.cols)
