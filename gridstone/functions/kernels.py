"""Numerical kernels over vectors and arrays."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.operators.halo import sliding_map
from gridstone.operators.ndarray import NdArray
from gridstone.operators.tiles import Tiles, iterated
from gridstone.operators.vector import Vec, div, zipped
from gridstone.sources.shared import discard, written

# STREAM


def stream_copy(a: Vec) -> Vec:
    return a.transform(lambda x: x)


def stream_scale(a: Vec, s: float) -> Vec:
    return a.transform(lambda x: x * F.lit(s))


def stream_add(a: Vec, b: Vec) -> Vec:
    return zipped(a, b).transform(lambda x, y: x + y)


def stream_triad(a: Vec, b: Vec, s: float) -> Vec:
    return zipped(a, b).transform(lambda x, y: x + F.lit(s) * y)


# Black-Scholes

#: Coefficients of the polynomial of erfc in 1 / (1 + p x), from Abramowitz and Stegun 7.1.26 (fixed values).
ERFC_P = 0.3275911
ERFC_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf_polynomial(x: Column) -> Column:
    """The normal distribution to about 1e-7, in built-in functions alone."""
    z = F.abs(x) / F.lit(math.sqrt(2))
    t = 1 / (1 + F.lit(ERFC_P) * z)
    poly = F.lit(0.0)
    for a in reversed(ERFC_A):
        poly = (poly + F.lit(a)) * t
    tail = F.lit(0.5) * poly * F.exp(-z * z)
    return F.when(x >= 0, 1 - tail).otherwise(tail)


#: Up to here erfc comes from a series, beyond from a continued fraction; so many terms and levels reach double precision.
ERFC_CUT, ERFC_TERMS, ERFC_LEVELS = 2.0, 45, 120


def erfc(x: np.ndarray) -> np.ndarray:
    """erfc of whole arrays, to about 1e-15: 1 - erf by its series of positive terms, and by the continued fraction for larger x."""
    z = np.abs(np.asarray(x, dtype=float))
    near, far = np.minimum(z, ERFC_CUT), np.maximum(z, ERFC_CUT)
    term = total = near
    for n in range(ERFC_TERMS):
        term = term * (2 * near * near / (2 * n + 3))
        total = total + term
    small = 1 - 2 / math.sqrt(math.pi) * np.exp(-near * near) * total
    below = far
    for n in range(ERFC_LEVELS, 0, -1):
        below = far + n / 2 / below
    large = np.exp(-far * far) / math.sqrt(math.pi) / below
    found = np.where(z < ERFC_CUT, small, large)
    return np.where(np.asarray(x) < 0, 2 - found, found)


def _normal_cdf(x: pa.Array) -> pa.Array:
    found = 0.5 * erfc(-x.to_numpy(zero_copy_only=False) / math.sqrt(2))
    return pa.array(found, pa.float64(), mask=x.is_null().to_numpy(zero_copy_only=False))


def normal_cdf(x: Column) -> Column:
    """The normal distribution through erfc, which Spark SQL lacks, on whole Arrow batches."""
    return F.arrow_udf(_normal_cdf, "double")(x)


def black_scholes(prices: DataFrame, rate: float, sigma: float, cdf=normal_cdf_polynomial) -> DataFrame:
    """prices (idx, s0, x, t) with the values vcall and vput of European options."""
    s0, x, t = F.col("s0"), F.col("x"), F.col("t")
    spread = F.lit(sigma) * F.sqrt(t)
    drift = F.log(s0 / x)
    with_d = prices.withColumns({"__d1": (drift + F.lit(rate + 0.5 * sigma * sigma) * t) / spread, "__d2": (drift + F.lit(rate - 0.5 * sigma * sigma) * t) / spread})
    paid = F.exp(F.lit(-rate) * t) * x
    d1, d2 = F.col("__d1"), F.col("__d2")
    return with_d.withColumns({"vcall": s0 * cdf(d1) - paid * cdf(d2), "vput": paid * cdf(-d2) - s0 * cdf(-d1)}).drop("__d1", "__d2")


# Stencils


def stencil1d(vec: Vec, size: int, steps: int = 1, radius: int = 1, block: int = 1 << 20) -> Vec:
    """Interior elements become the sum of their 2 radius + 1 neighbours; repeated, in one exchange."""
    return sliding_map(vec, radius, radius, lambda near: sum(near[1:], near[0]), size, block=block, steps=steps)


def iterate(state: NdArray, step: Callable[[NdArray], NdArray], steps: int, every: int = 2) -> NdArray:
    """The state after so many steps; every few of them it is written to the shared folder, so that plans stay small."""
    held = None
    for k in range(1, steps + 1):
        state = step(state)
        if k % every == 0 and k < steps:
            old, held = held, written(state.df, "state")
            state = NdArray(held, state.shape, state.cols)
            if old is not None:
                discard(old)
    return state


CROSS = [(-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)]


def stencil2d(arr: NdArray, steps: int = 1) -> NdArray:
    """Interior cells become a quarter of the sum of the five cells of the cross; repeated over tiles."""
    m, n = arr.shape
    return iterated(Tiles.of(arr), lambda *near: sum(near[1:], near[0]) / 4, CROSS, (1, 1), (m - 1, n - 1), steps).cells()


# Linear waves on a staggered grid

GRAVITY, DEPTH = 9.81, 1.0


class WaveGrid:
    """A C-grid of nx by ny cells over [-1, 1] squared; arrays have (nx + 1) by (ny + 1) places, row 0 of e and v is unused."""

    def __init__(self, nx: int, ny: int, lx: float = 2.0, ly: float = 2.0):
        self.nx, self.ny, self.lx, self.ly = nx, ny, lx, ly
        self.dx, self.dy = lx / nx, ly / ny

    def elevation(self, x: Column, y: Column, t: float) -> Column:
        """A standing wave, exact at any time."""
        c = math.sqrt(GRAVITY * DEPTH)
        omega = c * math.pi * math.hypot(1 / self.lx, 1 / self.ly)
        wave = F.cos(F.lit(2 * math.pi / self.lx) * x) * F.cos(F.lit(2 * math.pi / self.ly) * y)
        return F.lit(0.5 * math.cos(2 * omega * t)) * wave

    def centre(self) -> tuple[Column, Column]:
        x = F.lit(-self.lx / 2) + (F.col("i") - 0.5) * F.lit(self.dx)
        y = F.lit(-self.ly / 2) + (F.col("j") + 0.5) * F.lit(self.dy)
        return x, y

    def is_cell(self) -> Column:
        return (F.col("i") >= 1) & (F.col("j") < self.ny)

    def start(self, spark: SparkSession) -> NdArray:
        """Still water under the wave at time 0."""
        m, n = self.nx + 1, self.ny + 1
        cells = spark.range(m * n).select(div(F.col("id"), n).alias("i"), (F.col("id") % n).alias("j"))
        e = F.when(self.is_cell(), self.elevation(*self.centre(), 0.0)).otherwise(0.0)
        zero = F.lit(0.0)
        return NdArray(cells.select("i", "j", e.alias("e"), zero.alias("u"), zero.alias("v")), (m, n), ["e", "u", "v"])

    def rates(self, dt: float) -> dict[str, Column]:
        """dt times the time derivatives of e, u and v, from a cell and its four neighbours."""
        i, j = F.col("i"), F.col("j")
        u_inside = (i >= 1) & (i < self.nx) & (j < self.ny)
        v_inside = (i >= 1) & (j >= 1) & (j < self.ny)
        du = F.lit(-dt * GRAVITY / self.dx) * (F.col("e_right") - F.col("e"))
        dv = F.lit(-dt * GRAVITY / self.dy) * (F.col("e") - F.col("e_below"))
        flux = (F.col("u") - F.col("u_left")) / F.lit(self.dx) + (F.col("v_above") - F.col("v")) / F.lit(self.dy)
        de = F.lit(-dt * DEPTH) * flux
        return {"e": F.when(self.is_cell(), de).otherwise(0.0), "u": F.when(u_inside, du).otherwise(0.0), "v": F.when(v_inside, dv).otherwise(0.0)}

    NEAR = {"e_right": ("e", (1, 0)), "e_below": ("e", (0, -1)), "u_left": ("u", (-1, 0)), "v_above": ("v", (0, 1))}

    def step(self, state: NdArray, dt: float) -> NdArray:
        """One step of three strong-stability-preserving Runge-Kutta stages; all fields travel as columns of one table."""
        fields = ["e", "u", "v"]
        kept = NdArray(state.df.select("i", "j", *fields, *[F.col(f).alias(f"{f}0") for f in fields]), state.shape)
        for old, new in ((0.0, 1.0), (0.75, 0.25), (1 / 3, 2 / 3)):
            near = kept.neighbours(self.NEAR)
            rate = self.rates(dt)
            moved = {f: F.lit(old) * F.col(f"{f}0") + F.lit(new) * (F.col(f) + rate[f]) for f in fields}
            kept = NdArray(near.df.select("i", "j", *[moved[f].alias(f) for f in fields], *[f"{f}0" for f in fields]), state.shape)
        return NdArray(kept.df.select("i", "j", *fields), state.shape, fields)

    def advance(self, state: NdArray, dt: float, steps: int) -> NdArray:
        """So many steps, each written before the next begins."""
        return iterate(state, lambda s: self.step(s, dt), steps, 1)

    def diagnostics(self, state: NdArray, t: float) -> DataFrame:
        """One row: greatest elevation, volume, energy and L2 error against the exact wave at time t."""
        cell = F.when(self.is_cell(), F.col("e"))
        area = self.dx * self.dy
        exact = F.when(self.is_cell(), self.elevation(*self.centre(), t))
        potential = F.sum(cell * cell) * F.lit(0.5 * GRAVITY * area)
        kinetic = F.sum(F.col("u") * F.col("u") + F.col("v") * F.col("v")) * F.lit(0.5 * DEPTH * area)
        error = F.sqrt(F.sum((cell - exact) * (cell - exact)) * F.lit(area / (self.lx * self.ly)))
        return state.df.agg(F.max(cell).alias("elevation"), (F.sum(cell + DEPTH) * F.lit(area)).alias("volume"), (potential + kinetic).alias("energy"), error.alias("l2"))


# Fourier transform of a cube


def _along(n: int, inverse: bool) -> Callable[..., Column]:
    """Transform of whole lines of complex numbers, given as arrays of (re, im) in order; all lines of a batch at once."""

    def run(lines: pa.Array) -> pa.Array:
        flat = lines.values.slice(lines.offsets[0].as_py(), n * len(lines))
        z = (flat.field("re").to_numpy() + 1j * flat.field("im").to_numpy()).reshape(-1, n)
        found = (np.fft.ifft(z, axis=1) if inverse else np.fft.fft(z, axis=1)).ravel()
        cells = pa.StructArray.from_arrays([pa.array(found.real.copy()), pa.array(found.imag.copy())], ["re", "im"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lines) + 1, dtype=np.int32) * n), cells)

    return F.arrow_udf(run, "array<struct<re:double,im:double>>")


def fft3d(cube: NdArray, inverse: bool = False) -> NdArray:
    """The transform of a cube of complex cells (re, im): lines along the last dimension, then a transposition, three times.

    No task holds more than one line at a time; the transpositions rename columns.
    """
    for _ in range(3):
        line = F.transform(F.sort_array(F.collect_list(F.struct("k", "re", "im"))), lambda c: F.struct(c["re"].alias("re"), c["im"].alias("im")))
        lines = cube.df.groupBy("i", "j").agg(line.alias("line"))
        done = lines.select("i", "j", F.posexplode(_along(cube.shape[2], inverse)("line")).alias("k", "c"))
        cube = NdArray(done.select("i", "j", F.col("k").cast("bigint").alias("k"), F.col("c.re").alias("re"), F.col("c.im").alias("im")), cube.shape, ["re", "im"])
        cube = cube.transpose(False)
    return cube


def parseval(cube: NdArray, name: str = "power") -> DataFrame:
    return cube.df.agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias(name))


__all__ = ["WaveGrid", "black_scholes", "fft3d", "iterate", "normal_cdf", "normal_cdf_polynomial", "parseval", "stencil1d", "stencil2d", "stream_add", "stream_copy", "stream_scale", "stream_triad"]
