"""Compressed blocks, block products, comparator sorts, array operators and segments against plain versions."""

import random
from functools import cmp_to_key

import numpy as np
import pytest
from gridstone.operators import reductions, scans, segments, sorting
from gridstone.operators.csr import Csr
from gridstone.operators.linalg import Mat
from gridstone.operators.vector import Vec
from pyspark.sql import functions as F


def matrix(spark, shape, cells, seed=1):
    rng = random.Random(seed)
    own = {(rng.randrange(shape[0]), rng.randrange(shape[1])): rng.randrange(1, 99) / 4 for _ in range(cells)}
    df = spark.createDataFrame([(i, j, v) for (i, j), v in own.items()], "i long, j long, v double").repartition(3)
    full = np.zeros(shape)
    for at, v in own.items():
        full[at] = v
    return Mat(df, shape), full


def full_of(mat):
    out = np.zeros(mat.shape)
    for i, j, v in mat.df.collect():
        assert out[i, j] == 0 and v != 0
        out[i, j] = v
    return out


def values(vec):
    return [r[1] for r in vec.df.orderBy("idx").collect()]


def ways(mat):
    return [Csr.by_rows(mat, 4, 5), Csr.by_rows(mat, 1000), Csr.balanced(mat, 7, 6), Csr.balanced(mat, 1, 1 << 18)]


@pytest.mark.parametrize("k", range(4))
@pytest.mark.parametrize("shape, cells", [((13, 17), 60), ((5, 3), 15), ((20, 20), 2)])
def test_csr(spark, k, shape, cells):
    mat, full = matrix(spark, shape, cells)
    csr = ways(mat)[k]
    csr = Csr(csr.df.persist(), csr.shape, csr.stretch)
    assert np.array_equal(full_of(csr.cells()), full)
    for i in range(0, shape[0], 4):
        assert {r.idx: r.v for r in csr.row(i).collect()} == {j: full[i, j] for j in np.flatnonzero(full[i])}
    assert np.array_equal(full_of(csr.submatrix((1, 4), (1, 3))), full[1:4, 1:3])
    assert {r.i: r.n for r in csr.row_counts().collect()} == {i: np.count_nonzero(full[i]) for i in range(shape[0]) if full[i].any()}
    x = [float(j + 1) for j in range(shape[1])]
    assert np.allclose(values(csr.spmv(Vec.of(spark, x, "double"))), full @ x)
    y = [float(i) for i in range(shape[0])]
    assert np.allclose(values(csr.spmv(Vec.of(spark, x, "double"), Vec.of(spark, y, "double"))), full @ x + y)
    csr.df.unpersist()


def test_csr_of_nothing(spark):
    mat, _ = matrix(spark, (4, 4), 1)
    csr = Csr.balanced(Mat(mat.df.filter("false"), (4, 4)), 5)
    assert csr.cells().df.count() == 0
    assert values(csr.spmv(Vec.of(spark, [1.0] * 4, "double"))) == [0.0] * 4


def test_balanced_blocks(spark):
    """One row with half of all cells: no block has more than any other, and that row's sums are merged."""
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 100).cast("long").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))
    csr = Csr.balanced(Mat(df, (100, 4000)), 250)
    sizes = sorted(r.n for r in csr.df.groupBy("blk").agg(F.sum("n").alias("n")).collect())
    assert sizes == [250] * 16
    assert csr.df.filter("first <= 7 and last >= 7").count() >= 8
    want = np.bincount([7 if k % 2 == 0 else k % 100 for k in range(4000)], minlength=100)
    assert values(csr.spmv(Vec.of(spark, [1.0] * 4000, "double"))) == want.tolist()


@pytest.mark.parametrize("side, depth, layers", [(512, 512, None), (4, 3, 1), (5, 4, 3), (64, 2, 20)])
def test_gemm_blocked(spark, side, depth, layers):
    a, x = matrix(spark, (11, 19), 90, 2)
    b, y = matrix(spark, (19, 9), 80, 3)
    assert np.allclose(full_of(a.gemm_blocked(b, side, depth, layers)), x @ y)


def test_gemm_blocked_leaves_nothing_behind(spark):
    a, _ = matrix(spark, (6, 6), 9, 4)
    nothing = Mat(a.df.filter("false"), (6, 6))
    assert a.gemm_blocked(nothing).df.count() == 0 and nothing.gemm_blocked(a).df.count() == 0


def test_gemm_blocked_moves_cells_only(spark):
    """One exchange: of the factors' cells, each once for every panel of its row or column."""
    a, _ = matrix(spark, (8, 8), 30, 5)
    plan = a.gemm_blocked(a, 4, 4, 1).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


CASES = {
    "length": (lambda a, b: (len(a) > len(b)) - (len(a) < len(b)), "string"),
    "last": (lambda a, b: (a % 10 > b % 10) - (a % 10 < b % 10), "long"),
    "reverse": (lambda a, b: b - a, "long"),
    "same": (lambda a, b: 0, "long"),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("range_rows, sample", [(1 << 17, 64), (20, 4), (7, 1)])
def test_sort_by_comparator(spark, case, range_rows, sample):
    compare, kind = CASES[case]
    rng = random.Random(8)
    items = [rng.randrange(300) for _ in range(150)]
    items = ["x" * (v % 9) + str(v) for v in items] if kind == "string" else items
    got = sorting.sort_by(Vec.of(spark, items, kind), compare, range_rows, sample)
    assert values(got) == sorted(items, key=cmp_to_key(compare))
    assert [r.idx for r in got.df.orderBy("idx").collect()] == list(range(150))


def test_sort_by_comparator_of_nothing(spark):
    assert sorting.sort_by(Vec.of(spark, []), lambda a, b: a - b).df.count() == 0


MATRICES = lambda f, g: (f // 1000 * (g // 1000) % 97) * 1000 + (g // 1000 * (f % 1000) + g % 1000) % 97
OPERATORS = {
    "max": (np.maximum, max),
    "affine": (MATRICES, MATRICES),
    "first": (lambda a, b: a, lambda a, b: a),
    "last": (lambda a, b: b, lambda a, b: b),
}


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("n, block", [(1, 1 << 20), (50, 1 << 20), (50, 7), (64, 4), (33, 2)])
def test_array_operators(spark, name, n, block):
    op, plain = OPERATORS[name]
    items = [(k * 37 % 96 + 1) * 1000 + k * 11 % 97 for k in range(n)]
    want = items[:1]
    for x in items[1:]:
        want.append(plain(want[-1], x))
    vec = Vec.of(spark, items)
    vec = Vec(vec.df.repartition(3))
    assert values(scans.scan_with(vec, op, "bigint", block)) == want
    assert reductions.reduce_with(vec, op, items[0], "bigint", block).first()[0] == plain(items[0], want[-1])


def test_array_operators_are_called_few_times():
    calls = []

    def op(a, b):
        calls.append(len(a))
        return a + b

    assert reductions.folded(np.arange(10_000), op).tolist() == [sum(range(10_000))]
    assert scans.scanned(np.arange(10_000), op).tolist() == np.cumsum(np.arange(10_000)).tolist()
    assert len(calls) < 50


def test_reduce_with_of_nothing(spark):
    assert reductions.reduce_with(Vec.of(spark, []), np.add, 4, "bigint").first()[0] == 4


@pytest.mark.parametrize("op", ["plus", "max"])
@pytest.mark.parametrize("init", [None, 5])
def test_small_scan(spark, op, init):
    vec = Vec.of(spark, [3, 1, 4, 1, 5])
    assert values(scans.inclusive_scan(vec, op, init, size=5)) == values(scans.inclusive_scan(vec, op, init, 2))
    if init is not None:
        assert values(scans.exclusive_scan(vec, init, op, size=5)) == values(scans.exclusive_scan(vec, init, op, 2))
    plan = scans.inclusive_scan(vec, op, init, size=5).df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("lengths", [[50], [10, 0, 5, 1], [0, 0, 3], [1] * 60])
def test_segmented_by(spark, lengths):
    got = Vec.of(spark, list(range(100, 140))).segmented_by(lengths)
    starts = np.cumsum([0, *lengths[:-1]])
    assert [(r.v, r.segment) for r in got.df.orderBy("idx").collect()] == [(100 + k, int(np.searchsorted(starts, k, "right")) - 1) for k in range(40)]


def test_segmented_like(spark):
    other = Vec(spark.range(0, 40, 1, 6).selectExpr("id idx", "id v"))
    got = Vec.of(spark, list(range(40))).segmented_like(other)
    assert [r.segment for r in got.df.orderBy("idx").collect()] == [sum(k * 40 // 6 <= i for k in range(1, 6)) for i in range(40)]


def test_for_each_segment(spark):
    vec = Vec.of(spark, [5.0, 3.0, 9.0, 1.0, 2.0, 7.0], "double").segmented_by([2, 3, 1])
    assert values(segments.for_each_segment(vec, lambda v, start: np.sort(v) + 100 * start)) == [3.0, 5.0, 201.0, 202.0, 209.0, 507.0]
    with pytest.raises(Exception, match="elements for"):
        segments.for_each_segment(vec, lambda v, start: v[:1]).df.collect()


def test_scan_keeps_blocks_whole(spark):
    """Blocks stay whole where Spark would turn a join with their totals into a broadcast and read its exchange by parts."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        vec = Vec.of(spark, [k % 3 for k in range(60)])
        vec = Vec(vec.df.repartition(4, "idx"))
        got = values(scans.scan_with(vec, lambda a, b: np.where(b != 0, b, a), "bigint", 23))
        assert got == [k % 3 or 2 * (k > 0) for k in range(60)]
    finally:
        for name in names:
            spark.conf.unset(name)
