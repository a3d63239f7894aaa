"""Tiled arrays: packing, borders and stencils against NumPy."""

import numpy as np
import pytest
from gridstone.operators.ndarray import NdArray
from gridstone.operators.tiles import Tiles, iterated
from pyspark.sql import functions as F

CROSS = [(-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)]
DIAGONAL = [(-1, -1), (0, 0), (2, 1)]


def array(spark, x):
    names = ["i", "j", "k"][: x.ndim]
    rows = [(*map(int, at), float(x[at])) for at in np.ndindex(*x.shape)]
    return NdArray(spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names) + ", v double").repartition(3), x.shape)


def dense(arr):
    out = np.full(arr.shape, np.nan)
    for *at, v in arr.df.collect():
        out[tuple(at)] = v
    return out


def plain(x, fn, offsets, starts, ends, steps, other=None):
    for _ in range(steps):
        new = x.copy() if other is None else np.full_like(x, other)
        for at in np.ndindex(*x.shape):
            near = [tuple(a + o for a, o in zip(at, off, strict=True)) for off in offsets]
            if all(lo <= a < hi for a, lo, hi in zip(at, starts, ends, strict=True)) and all(0 <= a < n for p in near for a, n in zip(p, x.shape, strict=True)):
                new[at] = fn(*[x[p] for p in near])
        x = new
    return x


#: A lambda, as workers cannot import this module.
mean = lambda *near: sum(near) / len(near)


@pytest.mark.parametrize("shape, side", [((7, 9), (3, 4)), ((8, 8), (4, 8)), ((5, 1), (2, 2)), ((3, 3), (9, 9)), ((4, 5, 6), (2, 3, 4)), ((11,), (4,))])
def test_pack(spark, shape, side):
    x = np.arange(np.prod(shape), dtype=float).reshape(shape) + 0.5
    tiles = Tiles.of(array(spark, x), side)
    assert np.array_equal(dense(tiles.cells()), x)
    assert tiles.df.count() == np.prod([-(-n // s) for n, s in zip(shape, side, strict=True)])
    assert np.array_equal(dense(tiles.map(lambda v: v * 2).cells()), 2 * x)


@pytest.mark.parametrize("steps", [1, 2])
@pytest.mark.parametrize("offsets", [CROSS, DIAGONAL])
@pytest.mark.parametrize("shape, side", [((13, 9), (4, 5)), ((9, 10), (4, 4)), ((5, 6), (8, 8))])
def test_stencil(spark, shape, side, offsets, steps):
    x = np.random.default_rng(1).random(shape)
    starts, ends = (1, 0), (shape[0] - 1, shape[1])
    got = Tiles.of(array(spark, x), side).stencil(mean, offsets, starts, ends, steps)
    assert np.allclose(dense(got.cells()), plain(x, mean, offsets, starts, ends, steps))


def test_stencil_in_three_dimensions(spark):
    x = np.random.default_rng(2).random((6, 7, 5))
    offsets = [(0, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 1)]
    got = Tiles.of(array(spark, x), (3, 3, 2)).stencil(mean, offsets, (0, 1, 0), (6, 7, 5), other=-1.0)
    assert np.allclose(dense(got.cells()), plain(x, mean, offsets, (0, 1, 0), (6, 7, 5), 1, -1.0))


def test_steps_move_borders_only(spark):
    """Stored tiles stay where they are: the one exchange of a step carries slabs, a share of the cells that shrinks with the tiles' side."""
    x = np.random.default_rng(3).random((64, 64))
    stored = Tiles.of(array(spark, x), (32, 32)).stored(4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stepped = stored.stencil(mean, CROSS, (1, 1), (63, 63))
        plan = stepped.df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan and plan.count("Bucketed: true") == 2
        sent = stored.borders((1, 1), [(-1, 0), (1, 0), (0, -1), (0, 1)])
        assert sent.select(F.explode("slabs").alias("s")).agg(F.sum(F.size("s.cells"))).first()[0] == 4 * 64
        assert np.allclose(dense(stepped.cells()), plain(x, mean, CROSS, (1, 1), (63, 63), 1))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        stored.dropped()
    assert not spark.catalog.tableExists(stored.name)


def test_iterated(spark):
    x = np.random.default_rng(4).random((20, 12))
    got = iterated(Tiles.of(array(spark, x), (8, 6)), mean, CROSS, (1, 1), (19, 11), 5, 2)
    assert np.allclose(dense(got.cells()), plain(x, mean, CROSS, (1, 1), (19, 11), 5))


def test_halo_wider_than_a_tile(spark):
    with pytest.raises(ValueError):
        Tiles.of(array(spark, np.zeros((6, 6))), (2, 2)).stencil(mean, CROSS, (1, 1), (5, 5), 3)
