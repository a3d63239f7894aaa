"""Arrays, matrices, sources and kernels against NumPy and literal cases."""

import numpy as np
import pytest
from gridstone.functions import kernels
from gridstone.operators.linalg import Mat
from gridstone.operators.ndarray import NdArray, strides
from gridstone.operators.vector import IDX, Vec
from gridstone.sources import generators, matrix_market
from pyspark.sql import functions as F


def array(spark, x, cols=("v",)):
    x = np.asarray(x, dtype=float)
    rows = [(*map(int, k), float(x[k])) for k in np.ndindex(*x.shape)]
    dims = ["i", "j", "k"][: x.ndim]
    return NdArray(spark.createDataFrame(rows, ", ".join([f"{d} bigint" for d in dims] + ["v double"])).repartition(3), x.shape)


def dense(arr, col="v"):
    out = np.full(arr.shape, np.nan)
    for r in arr.df.collect():
        out[tuple(r[d] for d in arr.dims)] = r[col]
    return out


def matrix(spark, x):
    x = np.asarray(x, dtype=float)
    return Mat(spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)] or [], "i bigint, j bigint, v double"), x.shape)


def full(mat):
    out = np.zeros(mat.shape)
    for r in mat.df.collect():
        out[r.i, r.j] = r.v
    return out


def test_shapes(spark):
    assert strides((2, 3, 4)) == (12, 4, 1)
    x = np.arange(24.0).reshape(2, 3, 4)
    cube = array(spark, x)
    assert (dense(cube.transpose(True)) == np.transpose(x, (1, 2, 0))).all()
    assert (dense(cube.transpose(False)) == np.transpose(x, (2, 0, 1))).all()
    assert (dense(cube.transpose(True).transpose(False)) == x).all()
    assert (dense(NdArray.reshape(cube.flatten(), (4, 6))) == x.reshape(4, 6)).all()
    flat = array(spark, x[0])
    assert (dense(flat.transpose()) == x[0].T).all() and flat.at(2, 1) == x[0, 2, 1] and flat.extent(1) == 4
    assert (dense(flat.box((1, 1), (3, 3), True)) == x[0, 1:3, 1:3]).all()
    with pytest.raises(IndexError):
        flat.at(3, 0)


def test_wave_kernels(spark):
    e = array(spark, [[0, 0, 0], [1, 2, 3], [2, 3, 4], [3, 4, 5]])
    zero = NdArray(e.df.withColumn("out", F.lit(0.0)), e.shape, ["v", "out"])
    dx = zero.stencil(lambda here, right: right - here, [(0, 0), (1, 0)], (1, 0), (3, 3), "v", "out")
    assert dense(dx, "out").tolist() == [[0, 0, 0], [1, 1, 1], [1, 1, 1], [0, 0, 0]]
    dy = zero.stencil(lambda here, left: here - left, [(0, 0), (0, -1)], (0, 1), (4, 3), "v", "out")
    assert dense(dy, "out").tolist() == [[0, 0, 0], [0, 1, 1], [0, 1, 1], [0, 1, 1]]


def test_stencil2d(spark):
    x = np.random.default_rng(1).random((7, 9))
    want = x.copy()
    for _ in range(5):
        want[1:-1, 1:-1] = (want[:-2, 1:-1] + want[1:-1, :-2] + want[1:-1, 1:-1] + want[1:-1, 2:] + want[2:, 1:-1]) / 4
    assert np.allclose(dense(kernels.stencil2d(array(spark, x), 5)), want)


def wave(nx, ny, dt, steps):
    g, h, dx, dy = 9.81, 1.0, 2 / nx, 2 / ny
    i, j = np.meshgrid(np.arange(nx + 1), np.arange(ny + 1), indexing="ij")
    e = 0.5 * np.cos(np.pi * (-1 + (i - 0.5) * dx)) * np.cos(np.pi * (-1 + (j + 0.5) * dy))
    e[0, :] = e[:, ny] = 0
    u, v = np.zeros_like(e), np.zeros_like(e)

    def rates(e, u, v):
        du, dv, de = np.zeros_like(e), np.zeros_like(e), np.zeros_like(e)
        du[1:nx, :ny] = -dt * g * (e[2:, :ny] - e[1:nx, :ny]) / dx
        dv[1:, 1:ny] = -dt * g * (e[1:, 1:ny] - e[1:, : ny - 1]) / dy
        de[1:, :ny] = -dt * h * ((u[1:, :ny] - u[:-1, :ny]) / dx + (v[1:, 1:] - v[1:, :ny]) / dy)
        return de, du, dv

    for _ in range(steps):
        first = s = (e, u, v)
        for old, new in ((0, 1), (0.75, 0.25), (1 / 3, 2 / 3)):
            s = tuple(old * a + new * (b + r) for a, b, r in zip(first, s, rates(*s), strict=True))
        e, u, v = s
    return e, u, v


def test_waves(spark):
    grid = kernels.WaveGrid(8, 8)
    state = grid.advance(grid.start(spark), 0.01, 2)
    state = NdArray(state.df.persist(), state.shape, state.cols)
    for f, want in zip("euv", wave(8, 8, 0.01, 2), strict=True):
        assert np.allclose(dense(state, f), want)
    d0, d1 = grid.diagnostics(grid.start(spark), 0.0).first(), grid.diagnostics(state, 0.02).first()
    assert d0.l2 < 1e-12 and d1.l2 < 5e-3
    assert abs(d1.volume - d0.volume) < 1e-9 and abs(d1.energy / d0.energy - 1) < 1e-3


def test_erfc():
    import math

    x = np.concatenate([np.linspace(-9, 9, 4001), np.linspace(1.99, 2.01, 101), [0.0, -0.0, 40.0, -40.0]])
    want = np.array([math.erfc(v) for v in x])
    assert np.abs(kernels.erfc(x) - want).max() < 4e-15
    big = x[(x > 2) & (x < 9)]
    assert np.allclose(kernels.erfc(big), [math.erfc(v) for v in big], rtol=1e-12, atol=0)


def test_fft(spark):
    rng = np.random.default_rng(3)
    x = rng.random((2, 3, 4)) + 1j * rng.random((2, 3, 4))
    rows = [(*map(int, k), float(x[k].real), float(x[k].imag)) for k in np.ndindex(*x.shape)]
    cube = NdArray(spark.createDataFrame(rows, "i bigint, j bigint, k bigint, re double, im double"), x.shape, ["re", "im"])
    there = kernels.fft3d(cube)
    assert np.allclose(dense(there, "re") + 1j * dense(there, "im"), np.fft.fftn(x))
    back = kernels.fft3d(there, True)
    assert np.allclose(dense(back, "re") + 1j * dense(back, "im"), x)
    assert kernels.parseval(there).first()[0] == pytest.approx(24 * kernels.parseval(cube).first()[0])


def test_black_scholes(spark):
    prices = spark.createDataFrame([(0, 100.0, 100.0, 1.0), (1, 90.0, 100.0, 2.0)], "idx bigint, s0 double, x double, t double")
    exact = kernels.black_scholes(prices, 0.05, 0.2, kernels.normal_cdf).orderBy(IDX).collect()
    near = kernels.black_scholes(prices, 0.05, 0.2).orderBy(IDX).collect()
    assert exact[0].vcall == pytest.approx(10.4505836, abs=1e-6) and exact[0].vput == pytest.approx(5.5735260, abs=1e-6)
    assert all(a.vcall == pytest.approx(b.vcall, abs=1e-4) and a.vput == pytest.approx(b.vput, abs=1e-4) for a, b in zip(exact, near, strict=True))


def test_matrices(spark):
    rng = np.random.default_rng(4)
    a, b = rng.random((5, 7)) * (rng.random((5, 7)) < 0.5), rng.random((7, 4))
    c, x, y = rng.random((5, 4)), rng.random(7), rng.random(5)
    ma, mb, mc = matrix(spark, a), matrix(spark, b), matrix(spark, c)
    vec = lambda z: Vec(spark.createDataFrame(list(enumerate(map(float, z))), "idx bigint, v double"))
    got = dict(ma.spmv(vec(x), vec(y)).df.collect())
    assert np.allclose([got[k] for k in range(5)], y + a @ x)
    assert np.allclose(full(ma.gemm(mb)), a @ b) and np.allclose(full(ma.gemm(mb, mc)), c + a @ b)
    for side in (2, 3, 64):
        assert np.allclose(full(ma.gemm_blocked(mb, side)), a @ b)
    slim = mb.df.selectExpr("i as idx", "j as col", "v as x")
    assert np.allclose(full(Mat(ma.spmm(slim).withColumnRenamed("col", "j"), (5, 4))), a @ b)
    assert np.allclose(full(ma.submatrix((1, 4), (2, 6))), a[1:4, 2:6])
    assert np.allclose(full(ma.reshape((3, 3)))[:3, :3], a[:3, :3])
    new = matrix(spark, np.full((5, 7), 9.0) * (rng.random((5, 7)) < 0.3))
    n = full(new)
    assert np.allclose(full(ma.insert_or_assign(new)), np.where(n != 0, n, a)) and np.allclose(full(ma.insert(new)), np.where(a != 0, a, n))
    assert np.allclose(full(ma.with_tile(ma.tile(1, 1, (2, 3)), 1, 1, (2, 3))), a)
    starts = [r.start for r in ma.row_pointers(2).orderBy("i").collect()]
    assert starts == [int((a[:k] != 0).sum()) for k in range(5)]
    csr = ma.csr().orderBy("i").collect()
    assert [[c.j for c in r.cells] for r in csr] == [np.flatnonzero(a[k]).tolist() for k in range(5)]
    none = matrix(spark, np.zeros((3, 3)))
    assert sorted(map(tuple, none.spmv(vec([1, 2, 3])).df.collect())) == [(0, 0.0), (1, 0.0), (2, 0.0)]
    assert none.spmm(spark.range(3).selectExpr("id as idx", "id % 2 as col", "1.0D as x")).filter("v = 0").count() == 6
    assert none.row(1).to_root() == [0, 0, 0] and np.allclose(ma.column(2).to_root(), a[:, 2])
    assert full(none.gemm(matrix(spark, np.ones((3, 2))))).sum() == 0
    assert [tuple(r)[:2] for r in ma.entries(True).collect()] == sorted(zip(*map(list, np.nonzero(a)), strict=True), reverse=True)


def test_generators(spark):
    assert (full(generators.band(spark, 6, 2, 1)) == np.triu(np.tril(np.ones((6, 6)), 2), -1)).all()
    m = generators.random_sparse(spark, (30, 50), 0.1, 3)
    rows = m.df.collect()
    assert len(rows) == 150 == len({(r.i, r.j) for r in rows})
    assert all(0 <= r.i < 30 and 0 <= r.j < 50 and 0 <= r.v < 1 for r in rows)
    assert {(r.i, r.j) for r in generators.random_sparse(spark, (30, 50), 0.1, 4).df.collect()} != {(r.i, r.j) for r in rows}
    assert generators.random_sparse(spark, (3, 3), 1.0).df.select("i", "j").distinct().count() == 9


def write(tmp_path, text):
    path = tmp_path / "m.mtx"
    path.write_text(text)
    return str(path)


def test_matrix_market(spark, tmp_path):
    body = "3 4 3\n1 1 2.5\n3 4 -1\n3 4 3\n".replace("3 4 3\n1", "3 4 2\n1").replace("3 4 3\n", "")
    got = matrix_market.read(spark, write(tmp_path, "%%MatrixMarket matrix coordinate real general\n% note\n\n" + body))
    assert got.shape == (3, 4) and full(got).tolist() == [[2.5, 0, 0, 0], [0, 0, 0, 0], [0, 0, 0, -1]]
    got = matrix_market.read(spark, write(tmp_path, "%%MatrixMarket matrix coordinate pattern symmetric\n3 3 2\n2 1\n3 3\n"))
    assert full(got).tolist() == [[0, 1, 0], [1, 0, 0], [0, 0, 1]]
    got = matrix_market.read(spark, write(tmp_path, "%%MatrixMarket matrix coordinate integer general\n2 2 1\n0 1 7\n"), one_indexed=False)
    assert full(got).tolist() == [[0, 7], [0, 0]]


@pytest.mark.parametrize(
    "text",
    [
        "",
        "1 1 1\n1 1 1\n",
        "%%MatrixMarket matrix array real general\n1 1\n1\n",
        "%%MatrixMarket matrix coordinate complex general\n1 1 1\n1 1 1 0\n",
        "%%MatrixMarket matrix coordinate real skew-symmetric\n2 2 1\n2 1 1\n",
        "%%MatrixMarket matrix coordinate real hermitian\n2 2 1\n2 1 1\n",
        "%%MatrixMarket matrix coordinate real general\n2 2 1\n3 1 1\n",
        "%%MatrixMarket matrix coordinate real general\n2 2 1\n1 1 1\n2 2 1\n",
        "%%MatrixMarket matrix coordinate real general\n",
    ],
)
def test_matrix_market_errors(spark, tmp_path, text):
    with pytest.raises(ValueError):
        matrix_market.read(spark, write(tmp_path, text))


def test_spmm_never_broadcasts_what_explode_made(spark):
    """The slim matrix has many more rows than the table it comes from, by whose size Spark would broadcast it; rows and cells of it may be missing."""
    n = 3000
    slim = spark.range(n).filter("id % 7 != 3").selectExpr("id as idx", "explode(sequence(0L, 4L)) as col").selectExpr("idx", "col", "idx * 10 + col as x").filter("x % 11 != 5")
    got = generators.band(spark, n, 2, 1).spmm(slim, 5)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    b = np.array([[j * 10 + c if j % 7 != 3 and (j * 10 + c) % 11 != 5 else 0 for c in range(5)] for j in range(n)])
    want = sum(np.pad(b, ((1, 2), (0, 0)))[k : k + n] for k in range(4))
    cells = got.collect()
    out = np.full((n, 5), -1.0)
    for r in cells:
        out[r.i, r.col] = r.v
    assert len(cells) == 5 * n and (out == want).all()


@pytest.mark.parametrize("shape", [(3000000, 40000), (70001, 90001), (1, 1000003), (1, 3), (37, 53)])
def test_random_cells_are_inside_and_distinct(spark, shape):
    """At sizes where walking back into the matrix took many steps, and in the narrowest; numbers come back from cells alone."""
    density = min(1.0, 2e5 / (shape[0] * shape[1]))
    n = int(density * shape[0] * shape[1])
    cells = generators.random_cells(spark, shape, density, 5)
    rows = [np.array(c) for c in zip(*generators.with_numbers(cells, shape, 5).select("n", "i", "j", "v", "number").collect(), strict=True)]
    assert sorted(rows[0]) == list(range(n)) and (rows[0] == rows[4]).all()
    assert len(np.unique(rows[1] * shape[1] + rows[2])) == n
    assert rows[1].min() >= 0 and rows[1].max() < shape[0] and rows[2].min() >= 0 and rows[2].max() < shape[1]
    assert rows[3].min() >= 0 and rows[3].max() < 1
    if n > 1000:
        assert abs((rows[1] * shape[1] + rows[2]).mean() / (shape[0] * shape[1]) - 0.5) < 0.01


def test_random_sparse_takes_the_same_steps_for_each_cell(spark):
    """No walk in a lambda function, which Spark interprets, 64 steps for every cell."""
    plan = generators.random_sparse(spark, (1200000, 60000), 1e-6, 5).df._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan and "lambda" not in plan
