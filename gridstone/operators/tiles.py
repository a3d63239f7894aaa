"""N-dimensional arrays as dense tiles; stencils exchange the tiles' borders and nothing else."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.operators.ndarray import DIMS, NdArray
from gridstone.operators.vector import div
from gridstone.sources.shared import shared_dir

#: Side of a tile by number of dimensions: a quarter of a million cells, 2 MB.
SIDES = {1: (1 << 18,), 2: (512, 512), 3: (64, 64, 64)}
SLABS = "array<struct<to:int,cells:array<double>>>"

Offset = tuple[int, ...]


def _extents(at: tuple[int, ...], shape: tuple[int, ...], side: tuple[int, ...]) -> tuple[int, ...]:
    """The size of one tile; the last of a dimension may be smaller."""
    return tuple(min(s, n - t * s) for t, n, s in zip(at, shape, side, strict=True))


def _values(lists: pa.ListArray) -> list[np.ndarray]:
    """The rows of a list array of numbers as views of its values."""
    data, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _listed(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0)))


def _code(delta: Offset) -> int:
    """A direction, each part -1 to 1, as one number."""
    return sum((d + 1) * 3**k for k, d in enumerate(delta))


class Tiles:
    """``df`` has the tiles' coordinates (named as the array's dimensions) and block, their cells in row-major order as ARRAY<DOUBLE>."""

    def __init__(self, df: DataFrame, shape: tuple[int, ...], side: tuple[int, ...], name: str | None = None):
        self.df, self.shape, self.side, self.name = df, tuple(shape), tuple(side), name
        self.dims = list(DIMS[: len(shape)])

    @staticmethod
    def of(arr: NdArray, side: tuple[int, ...] | None = None, col: str | None = None) -> Tiles:
        """The array's cells dealt to tiles in one exchange; every cell must be there."""
        side = tuple(side or SIDES[len(arr.shape)])
        at = F.lit(0).cast("bigint")
        for d, n, s in zip(arr.dims, arr.shape, side, strict=True):
            at = at * F.least(F.lit(s).cast("bigint"), F.lit(n) - div(F.col(d), s) * s) + F.col(d) % s

        def pack(cells: pa.Array) -> pa.Array:
            offsets = cells.offsets.to_numpy()
            flat = cells.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
            offsets = offsets - offsets[0]
            place = flat.field("at").to_numpy() + np.repeat(offsets[:-1], np.diff(offsets))
            out = np.empty(len(place))
            out[place] = flat.field("v").to_numpy(zero_copy_only=False)
            return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out))

        keys = [div(F.col(d), s).alias(d) for d, s in zip(arr.dims, side, strict=True)]
        cell = F.struct(at.alias("at"), F.col(col or arr.cols[0]).cast("double").alias("v")).alias("cell")
        gathered = arr.df.select(*keys, cell).groupBy(*arr.dims).agg(F.collect_list("cell").alias("cells"))
        return Tiles(gathered.select(*arr.dims, F.arrow_udf(pack, "array<double>")("cells").alias("block")), arr.shape, side)

    def cells(self, name: str = "v") -> NdArray:
        """The array with a row for each cell."""
        flat = self.df.select(*[F.col(d).alias(f"t{d}") for d in self.dims], F.posexplode("block").alias("at", name))
        left, out = F.col("at").cast("bigint"), {}
        for d, n, s in reversed(list(zip(self.dims, self.shape, self.side, strict=True))):
            size = F.least(F.lit(s).cast("bigint"), F.lit(n) - F.col(f"t{d}") * s)
            out[d] = F.col(f"t{d}") * s + left % size
            left = div(left, size)
        return NdArray(flat.select(*[out[d].alias(d) for d in self.dims], name), self.shape, [name])

    def stored(self, buckets: int | None = None) -> Tiles:
        """Written once as a table in the shared folder, bucketed by tile: joins by tile then move only their other side."""
        spark = self.df.sparkSession
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        key = uuid.uuid4().hex
        name = f"gridstone_tiles_{key}"
        writer = self.df.repartition(buckets, *self.dims).write.option("path", f"{shared_dir(spark)}/gridstone/{key}/tiles")
        writer.bucketBy(buckets, *self.dims).sortBy(*self.dims).saveAsTable(name)
        return Tiles(spark.table(name), self.shape, self.side, name)

    def dropped(self) -> None:
        """Delete a stored table that no later step reads."""
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(next(r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {self.name}").collect() if r.col_name == "Location"))
        spark.sql(f"DROP TABLE {self.name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def borders(self, depth: Offset, towards: list[Offset]) -> DataFrame:
        """(tile, slabs): what each tile gets from its neighbours, the cells that lie within ``depth`` of it."""
        shape, side, rank = self.shape, self.side, len(self.shape)
        counts = [-(-n // s) for n, s in zip(shape, side, strict=True)]

        def cut(*args: pa.Array) -> pa.Array:
            out, ends = [], [0]
            for *at, block in zip(*[a.to_pylist() for a in args[:-1]], _values(args[-1]), strict=True):
                own = block.reshape(_extents(at, shape, side))
                for delta in towards:
                    if all(0 <= t + d < c for t, d, c in zip(at, delta, counts, strict=True)):
                        part = tuple(slice(max(0, n - h), n) if d > 0 else slice(0, h) if d < 0 else slice(None) for d, h, n in zip(delta, depth, own.shape, strict=True))
                        out.append((_code(delta), own[part].ravel()))
                ends.append(len(out))
            slabs = pa.StructArray.from_arrays([pa.array([c for c, _ in out], pa.int32()), _listed([s for _, s in out])], ["to", "cells"])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), slabs)

        sent = self.df.select(*self.dims, F.explode(F.arrow_udf(cut, SLABS)(*self.dims, "block")).alias("slab"))
        part = lambda k: (F.floor(F.col("slab.to") / 3**k) % 3 - 1).cast("bigint")
        moved = sent.select(*[(F.col(d) + part(k)).alias(d) for k, d in zip(range(rank), self.dims, strict=True)], "slab")
        return moved.groupBy(*self.dims).agg(F.collect_list("slab").alias("slabs"))

    def stencil(self, fn: Callable[..., np.ndarray], offsets: list[Offset], starts: Offset, ends: Offset, steps: int = 1, other: float | None = None) -> Tiles:
        """Cells of the box become fn of the cells at ``offsets``, so many times.

        fn gets one NumPy array for each offset. Outside the box, and where an
        offset leaves the array, cells stay as they are, or become ``other``.
        One exchange of borders, steps times as deep as the stencil, serves all
        steps; between them tiles recompute what they hold of their neighbours.
        The tiles themselves move only where they do not lie by tile yet.
        """
        shape, side = self.shape, self.side
        reach = [max(abs(o[k]) for o in offsets) for k in range(len(shape))]
        depth = tuple(r * steps for r in reach)
        if any(h > s for h, s in zip(depth, side, strict=True)):
            raise ValueError("a halo wider than a tile")
        signs = [sorted({0, *((o[k] > 0) - (o[k] < 0) for o in offsets)}) for k in range(len(shape))]
        if steps == 1:
            ways = {d for o in offsets for d in product(*[{0, (x > 0) - (x < 0)} for x in o])}
        else:
            ways = set(product(*signs))
        # A cell that is needed from direction d is sent the other way.
        towards = sorted(tuple(-x for x in d) for d in ways if any(d))
        least, most = [min(o[k] for o in offsets) for k in range(len(shape))], [max(o[k] for o in offsets) for k in range(len(shape))]

        def padded(at: list[int], block: np.ndarray, slabs: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, list[int], tuple[slice, ...]]:
            """The tile with what it got around it, the place of its first cell, and where in it the tile lies."""
            size = _extents(at, shape, side)
            low = [t * s for t, s in zip(at, side, strict=True)]
            before = [min(h, a) for h, a in zip(depth, low, strict=True)]
            after = [min(h, n - a - e) for h, a, n, e in zip(depth, low, shape, size, strict=True)]
            out = np.full([b + e + a for b, e, a in zip(before, size, after, strict=True)], np.nan)
            own = tuple(slice(b, b + e) for b, e in zip(before, size, strict=True))
            out[own] = block.reshape(size)
            for code, cells in slabs:
                # Sent towards +1, it comes from the side before this tile.
                way = [code // 3**k % 3 - 1 for k in range(len(shape))]
                part = tuple(slice(0, b) if w > 0 else slice(b + e, None) if w < 0 else slice(b, b + e) for w, b, e in zip(way, before, size, strict=True))
                out[part] = cells.reshape(out[part].shape)
            return out, [a - b for a, b in zip(low, before, strict=True)], own

        def step(*args: pa.Array) -> pa.Array:
            got = args[-1]
            slabs = got.values
            codes, cells, at_slab = slabs.field("to").to_pylist(), _values(slabs.field("cells")), got.offsets.to_numpy()
            out = []
            for row, (*at, block) in enumerate(zip(*[a.to_pylist() for a in args[:-2]], _values(args[-2]), strict=True)):
                mine = range(at_slab[row], at_slab[row + 1]) if got[row].is_valid else ()
                now, base, own = padded(at, block, [(codes[k], cells[k]) for k in mine])
                box = [(max(lo - b, -a), min(hi - b, n - z)) for lo, hi, b, n, a, z in zip(starts, ends, base, now.shape, least, most, strict=True)]
                for _ in range(steps):
                    new = now.copy() if other is None else np.full_like(now, other)
                    if all(a < z for a, z in box):
                        new[tuple(slice(a, z) for a, z in box)] = fn(*[now[tuple(slice(a + x, z + x) for (a, z), x in zip(box, o, strict=True))] for o in offsets])
                    now = new
                out.append(now[own].ravel())
            return _listed(out)

        joined = self.df.join(self.borders(depth, towards), self.dims, "left")
        slabs = F.coalesce("slabs", F.array().cast(SLABS))
        new = F.arrow_udf(step, "array<double>")(*self.dims, "block", slabs)
        return Tiles(joined.select(*self.dims, new.alias("block")), shape, side)

    def map(self, fn: Callable[[Column], Column]) -> Tiles:
        """Each cell alone becomes fn of it."""
        return Tiles(self.df.select(*self.dims, F.transform("block", fn).alias("block")), self.shape, self.side)


def iterated(tiles: Tiles, fn: Callable[..., np.ndarray], offsets: list[Offset], starts: Offset, ends: Offset, steps: int, at_once: int = 4) -> Tiles:
    """So many steps of a stencil, ``at_once`` for one exchange of borders, each time stored by tile; tables of passed steps go."""
    state = tiles
    while steps > 0:
        now = min(steps, at_once)
        new = state.stencil(fn, offsets, starts, ends, now)
        steps -= now
        if steps:
            new = new.stored()
            if state.name:
                state.dropped()
        state = new
    return state

