"""The registered queries over the driver tables, with their DuckDB counterparts.

Money columns have two decimals; they are summed as decimals, so that sums do
not depend on order, and returned as doubles.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.functions import kernels
from gridstone.operators import halo, lookup, reductions, scans, segments, sorting
from gridstone.operators.csr import Csr
from gridstone.operators.linalg import Mat
from gridstone.operators.ndarray import NdArray
from gridstone.operators.tiles import Tiles, iterated
from gridstone.operators.vector import IDX, Vec, div, zipped
from gridstone.sources import generators, matrix_market, shared
from gridstone.streaming import running

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

MONEY = "decimal(18,2)"
EV = "WITH ev AS (SELECT event_id AS idx, CAST(value AS DECIMAL(18,2)) AS v, user_id AS w FROM events), n AS (SELECT count(*) AS n FROM ev) "
CUBE = EV + ", c AS (SELECT idx // 100 AS i, idx // 10 % 10 AS j, idx % 10 AS k, v FROM ev) "
GRID = EV + ", g AS (SELECT idx // 100 AS i, idx % 100 AS j, v, n // 100 AS m FROM ev, n) "
SPARSE = (
    "WITH a AS (SELECT l_partkey AS i, l_suppkey AS j, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS v FROM lineitem GROUP BY ALL), "
    "x AS (SELECT s_suppkey AS idx, CAST(s_acctbal AS DECIMAL(18,2)) AS x FROM supplier) "
)
DENSE = "WITH e AS (SELECT vec_id AS i, generate_subscripts(embedding, 1) - 1 AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) "


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str, *cols: str) -> Vec:
    """The events vector: v (value, two decimals) and w (user)."""
    whole = {"v": F.col("value").cast(MONEY), "w": F.col("user_id")}
    return Vec.from_table(table(spark, d, "events"), "event_id", **{c: whole[c] for c in cols or ("v",)})


def both(spark: SparkSession, d: str) -> tuple[Vec, Vec]:
    """The two components of the events vector, over one scan."""
    whole = events(spark, d, "v", "w")
    return whole.pick("v"), whole.pick("w")


def orders(spark: SparkSession, d: str) -> Vec:
    return Vec.from_table(table(spark, d, "orders"), "o_orderkey", v=F.col("o_totalprice").cast(MONEY))


def parts(spark: SparkSession, d: str) -> Vec:
    return Vec.from_table(table(spark, d, "part"), "p_partkey", v=F.col("p_retailprice").cast(MONEY))


def size_of(spark: SparkSession, d: str, name: str = "events") -> int:
    return table(spark, d, name).count()


def grid(spark: SparkSession, d: str) -> NdArray:
    return NdArray.reshape(events(spark, d), (size_of(spark, d) // 100, 100))


def cube(spark: SparkSession, d: str) -> NdArray:
    return NdArray.reshape(events(spark, d), (size_of(spark, d) // 100, 10, 10))


def sparse(spark: SparkSession, d: str) -> Mat:
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), F.col("l_quantity").cast(MONEY).alias("v"))
    return Mat.from_duplicates(rows, (size_of(spark, d, "part"), size_of(spark, d, "supplier")))


def balances(spark: SparkSession, d: str) -> Vec:
    return Vec.from_table(table(spark, d, "supplier"), "s_suppkey", x=F.col("s_acctbal").cast(MONEY))


def embedding(spark: SparkSession, d: str) -> Mat:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v"))
    return Mat(rows.select("i", F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v")), (size_of(spark, d, "embeddings"), 64))


def doubles(df: DataFrame, *cols: str) -> DataFrame:
    """Named (or else all decimal) columns as doubles."""
    return df.withColumns({c: F.col(c).cast("double") for c, kind in df.dtypes if c in cols or (not cols and kind.startswith("decimal"))})


# Zip, transform, reduce


@register("vec_dot_product", EV + "SELECT CAST(sum(v * w) AS DOUBLE) AS dot FROM ev")
def _(spark, d):
    return doubles(reductions.dot_product(*both(spark, d)))


@register("vec_dot_product_joined", "SELECT CAST(sum(CAST(value AS DECIMAL(18,2)) * CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS dot FROM events JOIN orders ON event_id = o_orderkey")
def _(spark, d):
    return doubles(reductions.dot_product(events(spark, d), orders(spark, d)))


@register("vec_add", EV + "SELECT idx, CAST(v + w AS DOUBLE) AS v FROM ev")
def _(spark, d):
    return doubles(kernels.stream_add(*both(spark, d)).df)


@register("vec_mul", EV + "SELECT idx, CAST(v * w AS DOUBLE) AS v FROM ev")
def _(spark, d):
    return doubles(zipped(*both(spark, d)).transform(lambda a, b: a * b).df)


@register("stream_copy", EV + "SELECT idx, CAST(v AS DOUBLE) AS v FROM ev")
def _(spark, d):
    return doubles(kernels.stream_copy(events(spark, d)).df)


@register("stream_scale", EV + "SELECT idx, CAST(v * 3 AS DOUBLE) AS v FROM ev")
def _(spark, d):
    return doubles(kernels.stream_scale(events(spark, d), 3).df)


@register("stream_add", EV + "SELECT idx, CAST(v + w AS DOUBLE) AS v FROM ev")
def _(spark, d):
    return doubles(kernels.stream_add(*both(spark, d)).df)


@register("stream_triad", EV + "SELECT idx, CAST(v + 3 * w AS DOUBLE) AS v FROM ev")
def _(spark, d):
    return doubles(kernels.stream_triad(*both(spark, d), 3).df)


# Views


@register("view_take", EV + "SELECT idx, CAST(v AS DOUBLE) AS v FROM ev WHERE idx < 50")
def _(spark, d):
    return doubles(events(spark, d).take(50).df)


@register("view_take_over", EV + "SELECT idx, CAST(v AS DOUBLE) AS v FROM ev")
def _(spark, d):
    return doubles(events(spark, d).take(10**9).df)


@register("view_drop", EV + "SELECT idx - 70 AS idx, CAST(v AS DOUBLE) AS v FROM ev WHERE idx >= 70")
def _(spark, d):
    return doubles(events(spark, d).drop(70).df)


@register("view_slice", EV + "SELECT idx - 10 AS idx, CAST(v AS DOUBLE) AS v FROM ev WHERE idx >= 10 AND idx < 500")
def _(spark, d):
    return doubles(events(spark, d).slice(10, 500).df)


@register("view_counted", EV + "SELECT idx - 10 AS idx, CAST(v AS DOUBLE) AS v FROM ev WHERE idx >= 10 AND idx < 35")
def _(spark, d):
    return doubles(events(spark, d).counted(10, 25).df)


@register("view_subrange", EV + "SELECT idx - 100 AS idx, CAST(v AS DOUBLE) AS v FROM ev WHERE idx >= 100 AND idx < 300")
def _(spark, d):
    return doubles(events(spark, d).subrange(100, 300).df)


@register("view_drop_then_slice", EV + "SELECT idx - 75 AS idx, CAST(v AS DOUBLE) AS v FROM ev WHERE idx >= 75 AND idx < 90")
def _(spark, d):
    return doubles(events(spark, d).drop(70).slice(5, 20).df)


@register("view_enumerate", EV + "SELECT idx, idx AS i, CAST(v AS DOUBLE) AS v FROM ev")
def _(spark, d):
    return doubles(events(spark, d).enumerate().df)


@register("view_iota_zip", EV + "SELECT idx, idx + 1000 AS i, CAST(v AS DOUBLE) AS v FROM ev WHERE idx < 400")
def _(spark, d):
    return doubles(zipped(Vec.iota(spark, 400, 1000), events(spark, d), names=["i", "v"]).df)


@register("view_zip3_unequal", "SELECT event_id AS idx, value AS a, o_totalprice AS b, p_retailprice AS c FROM events JOIN orders ON event_id = o_orderkey JOIN part ON event_id = p_partkey")
def _(spark, d):
    return doubles(zipped(events(spark, d), orders(spark, d), parts(spark, d), names=["a", "b", "c"]).df)


@register("view_chunk", EV + "SELECT idx // 7 AS idx, count(*) AS n, CAST(sum(v) AS DOUBLE) AS total FROM ev GROUP BY ALL")
def _(spark, d):
    chunks = events(spark, d).chunk(7)
    total = F.aggregate("chunk", F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + x).cast("decimal(28,2)"))
    return doubles(chunks.select(IDX, F.size("chunk").cast("bigint").alias("n"), total.alias("total")))


@register("view_segments", EV + "SELECT n AS total, CAST(0 AS BIGINT) AS first, n - 1 AS last FROM n")
def _(spark, d):
    segments = events(spark, d).segmented(5).segments()
    return segments.agg(F.sum("n").alias("total"), F.min("first").alias("first"), F.max("last").alias("last"))


# Elementwise


@register("fill_partial", EV + "SELECT idx, CASE WHEN idx >= 100 AND idx < 200 THEN 7.0 ELSE CAST(v AS DOUBLE) END AS v FROM ev")
def _(spark, d):
    return doubles(events(spark, d).fill(7, 100, 200).df)


@register("iota_fill", EV + "SELECT idx, idx + 5 AS w FROM ev")
def _(spark, d):
    return events(spark, d, "w").fill_iota(5).df


@register("copy_offset", EV + "SELECT e.idx, CASE WHEN s.idx IS NULL THEN e.v ELSE s.v END::DOUBLE AS v FROM ev e LEFT JOIN ev s ON s.idx = e.idx - 30 AND s.idx < 100")
def _(spark, d):
    return doubles(events(spark, d).take(100).copy_into(events(spark, d), 30).df)


@register("for_each_n_negate", EV + "SELECT idx, CAST(CASE WHEN idx >= 20 AND idx < 60 THEN -v ELSE v END AS DOUBLE) AS v FROM ev")
def _(spark, d):
    return doubles(events(spark, d).for_each_n(20, 40, lambda x: -x).df)


@register("for_each_indexed", EV + "SELECT idx, CAST(CASE WHEN idx > 0 THEN v + idx ELSE v END AS DOUBLE) AS v FROM ev")
def _(spark, d):
    return doubles(events(spark, d).for_each_indexed(lambda i, x: F.when(i > 0, x + i).otherwise(x)).df)


@register("transform_shifted", EV + "SELECT e.idx, CAST(CASE WHEN s.idx IS NULL THEN e.v ELSE s.v * 2 END AS DOUBLE) AS v FROM ev e LEFT JOIN ev s ON s.idx = e.idx - 1")
def _(spark, d):
    return doubles(events(spark, d).transform_into(events(spark, d), lambda x: x * 2, 1).df)


@register("vec_resize", EV + "SELECT idx, CAST(v AS DOUBLE) AS v FROM ev UNION ALL SELECT n + r, 1.5 FROM n, range(250) t(r)")
def _(spark, d):
    n = size_of(spark, d)
    return doubles(events(spark, d).resize(n, n + 250, 1.5).df)


@register("vec_put", EV + "SELECT idx, CAST(CASE WHEN idx = 3 THEN 9 ELSE v END AS DOUBLE) AS v FROM ev")
def _(spark, d):
    return doubles(events(spark, d).put(3, 9).df)


# Reductions


@register("reduce_sum_init", EV + "SELECT CAST(100 + sum(v) AS DOUBLE) AS value FROM ev")
def _(spark, d):
    return doubles(reductions.reduce(events(spark, d), "plus", 100))


@register("reduce_max_init", EV + "SELECT CAST(greatest(10, max(v)) AS DOUBLE) AS value FROM ev")
def _(spark, d):
    return doubles(reductions.reduce(events(spark, d), "max", 10))


@register("reduce_min", EV + "SELECT CAST(min(v) AS DOUBLE) AS value FROM ev")
def _(spark, d):
    return doubles(reductions.reduce(events(spark, d), "min"))


#: Signs by data and powers of two that cancel every 31 orders, so that products of all orders are exact and finite.
FACTOR = "(CASE WHEN o_totalprice > 100000 THEN -1 ELSE 1 END) * pow(2, o_orderkey * 7 % 31 - 15)"


def factors(spark: SparkSession, d: str) -> Vec:
    return orders(spark, d).enumerate().transform(lambda i, v: F.when(v > 100000, -1).otherwise(1) * F.pow(F.lit(2.0), i * 7 % 31 - 15))


@register("reduce_product", f"SELECT product({FACTOR}) AS value FROM orders")
def _(spark, d):
    return reductions.reduce(factors(spark, d), "multiplies")


@register("reduce_empty", "SELECT CAST(5 AS BIGINT) AS value")
def _(spark, d):
    return reductions.reduce(events(spark, d, "w").take(0), "plus", 5).select(F.col("value").cast("bigint").alias("value"))


@register("reduce_custom_fold", EV + "SELECT greatest(0, max(abs(w - 40))) AS value FROM ev")
def _(spark, d):
    far = events(spark, d, "w").transform(lambda w: F.abs(w - 40))
    return reductions.reduce_with(far, np.maximum, 0, "bigint", 1000)


@register("count_value", EV + "SELECT count(*) AS n FROM ev WHERE w = 5")
def _(spark, d):
    return reductions.count(events(spark, d, "w"), 5)


@register("count_if_pred", EV + "SELECT count(*) AS n FROM ev WHERE v > 100")
def _(spark, d):
    return reductions.count_if(events(spark, d), lambda v: v > 100)


@register("equal_true", "SELECT CAST(1 AS INTEGER) AS equal")
def _(spark, d):
    return reductions.equal(events(spark, d), events(spark, d).transform(lambda v: v + 1).transform(lambda v: v - 1))


@register("equal_false", "SELECT CAST(0 AS INTEGER) AS equal")
def _(spark, d):
    return reductions.equal(events(spark, d, "w"), events(spark, d, "w").put(9, -1))


@register("equal_len_mismatch", "SELECT CAST(0 AS INTEGER) AS equal")
def _(spark, d):
    return reductions.equal(events(spark, d, "w"), events(spark, d, "w").take(10))


# Scans

RUN = "sum(v) OVER (ORDER BY idx)"


@register("scan_inclusive_sum", EV + f"SELECT idx, CAST({RUN} AS DOUBLE) AS v FROM ev")
def _(spark, d):
    return doubles(scans.inclusive_scan(events(spark, d)).df)


@register("scan_inclusive_init", EV + f"SELECT idx, CAST(100 + {RUN} AS DOUBLE) AS v FROM ev")
def _(spark, d):
    return doubles(scans.inclusive_scan(events(spark, d), init=100).df)


@register("scan_exclusive_sum", EV + f"SELECT idx, CAST(10 + {RUN} - v AS DOUBLE) AS v FROM ev")
def _(spark, d):
    return doubles(scans.exclusive_scan(events(spark, d), 10).df)


@register("scan_inclusive_max", EV + "SELECT idx, CAST(max(v) OVER (ORDER BY idx) AS DOUBLE) AS v FROM ev")
def _(spark, d):
    return doubles(scans.inclusive_scan(events(spark, d), "max").df)


@register("scan_product", f"SELECT o_orderkey AS idx, product({FACTOR}) OVER (ORDER BY o_orderkey) AS v FROM orders")
def _(spark, d):
    return scans.inclusive_scan(factors(spark, d), "multiplies", block=1000).df


@register("scan_subrange", EV + ", s AS (SELECT idx, sum(v) OVER (ORDER BY idx) AS s FROM ev WHERE idx >= 50 AND idx < 150) SELECT ev.idx, CAST(coalesce(s.s, ev.v) AS DOUBLE) AS v FROM ev LEFT JOIN s ON s.idx = ev.idx")
def _(spark, d):
    own = events(spark, d).transform(lambda v: v.cast("decimal(28,2)"))
    return doubles(scans.scan_into(own, own, 50, 150, 50).df)


@register("scan_two_pass", EV + f"SELECT idx, CAST({RUN} AS DOUBLE) AS v FROM ev")
def _(spark, d):
    return doubles(scans.inclusive_scan(events(spark, d), block=777).df)


#: The last element so far that is no multiple of four: an operator that does not commute.
@register("scan_last", EV + "SELECT idx, coalesce(last_value(nullif(w % 4, 0) IGNORE NULLS) OVER (ORDER BY idx), 0) AS w FROM ev")
def _(spark, d):
    vec = events(spark, d, "w").transform(lambda w: w % 4, "w")
    return scans.scan_with(vec, lambda a, b: np.where(b != 0, b, a), "bigint", 1500).df


@register("scan_one_block", EV + f"SELECT idx, CAST(5 + {RUN} AS DOUBLE) AS v FROM ev")
def _(spark, d):
    return doubles(scans.inclusive_scan(events(spark, d), init=5, size=size_of(spark, d)).df)


@register("scan_custom", EV + "SELECT idx, max(w) OVER (ORDER BY idx) AS w FROM ev")
def _(spark, d):
    return scans.scan_with(events(spark, d, "w"), np.maximum, "bigint", 1000).df


# Sorts


@register("sort_asc", EV + "SELECT idx, CAST(v AS DOUBLE) AS v FROM ev ORDER BY ev.v, idx")
def _(spark, d):
    return doubles(sorting.sort(events(spark, d)))


@register("sort_desc", EV + "SELECT idx, CAST(v AS DOUBLE) AS v FROM ev ORDER BY ev.v DESC, idx")
def _(spark, d):
    return doubles(sorting.sort(events(spark, d), True))


@register("sort_reindexed", EV + "SELECT row_number() OVER (ORDER BY v, idx) - 1 AS idx, CAST(v AS DOUBLE) AS v FROM ev")
def _(spark, d):
    return doubles(sorting.sorted_vector(events(spark, d)).df)


@register("sort_reindexed_desc", EV + "SELECT row_number() OVER (ORDER BY w DESC, idx) - 1 AS idx, w FROM ev")
def _(spark, d):
    return sorting.sorted_vector(events(spark, d, "w"), True).df


def _by_digits(a, b):
    """Even thousands first, and in each half the greater value first."""
    x, y = int(a // 100 % 2), int(b // 100 % 2)
    return x - y if x != y else (a < b) - (a > b)


@register("sort_comparator", EV + "SELECT row_number() OVER (ORDER BY CAST(floor(v / 100) AS BIGINT) % 2, v DESC, idx) - 1 AS idx, CAST(v AS DOUBLE) AS v FROM ev")
def _(spark, d):
    return doubles(sorting.sort_by(events(spark, d), _by_digits, 2000).df)


@register("sort_subrange", EV + ", s AS (SELECT 99 + row_number() OVER (ORDER BY v, idx) AS idx, v FROM ev WHERE idx >= 100 AND idx < 300) SELECT ev.idx, CAST(coalesce(s.v, ev.v) AS DOUBLE) AS v FROM ev LEFT JOIN s ON s.idx = ev.idx")
def _(spark, d):
    return doubles(sorting.sort_subrange(events(spark, d), 100, 300).df)


# Ordered lookups


@register("lookup_lower", EV + "SELECT idx, (SELECT count(*) FROM orders WHERE CAST(o_totalprice AS DECIMAL(18,2)) < v * 1000) AS position FROM ev")
def _(spark, d):
    return lookup.lower_bound(events(spark, d).transform(lambda v: (v * 1000).cast("decimal(28,2)")), orders(spark, d).transform(lambda v: v.cast("decimal(28,2)"))).df


@register("lookup_upper", "SELECT o_orderkey AS idx, (SELECT count(*) FROM events WHERE user_id <= o_custkey) AS position FROM orders")
def _(spark, d):
    probes = Vec.from_table(table(spark, d, "orders"), "o_orderkey", v=F.col("o_custkey"))
    return lookup.upper_bound(probes, events(spark, d, "w")).df


#: The last purchase of the same user before each event.
@register("lookup_asof", "SELECT e.event_id, p.event_id AS found_id, p.value AS found_value FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts > p.ts")
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    found = lookup.asof(rows.select("event_id", "user_id", "ts"), rows.filter("event_type = 'purchase'"), "ts", "user_id", False)
    return found.select("event_id", F.col("found.event_id").alias("found_id"), F.col("found.value").alias("found_value"))


#: The row of the sparse matrix that holds each place of its cells in row-major order, from the row pointers.
@register("lookup_rows_of_cells", SPARSE + "SELECT row_number() OVER (ORDER BY i, j) - 1 AS place, i FROM a")
def _(spark, d):
    own = sparse(spark, d)
    places = spark.range(own.df.count()).select(F.col("id").alias("start"))
    found = lookup.position(places, own.row_pointers(), "start", True)
    return found.select(F.col("start").alias("place"), (F.col("position") - 1).alias("i"))


# Sliding windows, 1-d stencils, halos


@register("sliding_windows", EV + ", s AS (SELECT idx, sum(v) OVER w3 AS total, first_value(v) OVER w3 AS a, last_value(v) OVER w3 AS z FROM ev WINDOW w3 AS (ORDER BY idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) SELECT idx, CAST(a AS DOUBLE) AS a, CAST(z AS DOUBLE) AS z, CAST(total AS DOUBLE) AS total FROM s, n WHERE idx <= n - 3")
def _(spark, d):
    w = halo.sliding(events(spark, d), 3, size_of(spark, d), 512)
    return doubles(w.select(IDX, F.col("window")[0].alias("a"), F.col("window")[2].alias("z"), (F.col("window")[0] + F.col("window")[1] + F.col("window")[2]).alias("total")))


@register("sliding_sum5", EV + ", s AS (SELECT idx, sum(v) OVER (ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM ev) SELECT idx, CAST(s AS DOUBLE) AS sum FROM s, n WHERE idx >= 2 AND idx < n - 2")
def _(spark, d):
    return doubles(halo.moving_sum(events(spark, d), 2, 2, size_of(spark, d), 640))


def _stencil_sql(steps: int) -> str:
    sql, last = EV + ", s0 AS (SELECT idx, CAST(v AS DECIMAL(28,2)) AS v FROM ev)", 0
    for k in range(1, steps + 1):
        last = k - 1
        sql += f", s{k} AS (SELECT idx, CASE WHEN idx >= 1 AND idx < n - 1 THEN CAST(lag(v) OVER (ORDER BY idx) + v + lead(v) OVER (ORDER BY idx) AS DECIMAL(28,2)) ELSE v END AS v FROM s{last}, n)"
    return sql + f" SELECT idx, CAST(v AS DOUBLE) AS v FROM s{steps}"


def _stencil(spark, d, steps):
    vec = events(spark, d).transform(lambda v: v.cast("decimal(28,2)"))
    return doubles(kernels.stencil1d(vec, size_of(spark, d), steps, 1, 512).df)


@register("stencil1d_step", _stencil_sql(1))
def _(spark, d):
    return _stencil(spark, d, 1)


@register("stencil1d_3steps", _stencil_sql(3))
def _(spark, d):
    return _stencil(spark, d, 3)


@register("halo_periodic", EV + "SELECT e.idx, CAST(p.v + e.v + q.v AS DOUBLE) AS v FROM ev e, n, ev p, ev q WHERE p.idx = (e.idx + n - 1) % n AND q.idx = (e.idx + 1) % n")
def _(spark, d):
    return doubles(halo.sliding_map(events(spark, d), 1, 1, lambda near: near[0] + near[1] + near[2], size_of(spark, d), True, 333).df)


def _halo_sql(fold: str) -> str:
    ghost = "SELECT idx, v FROM ev, n WHERE idx % 100 < 2 AND idx >= 100 UNION ALL SELECT idx, v FROM ev, n WHERE idx % 100 >= 98 AND idx < n - 100"
    return EV + f", r AS (SELECT idx, v FROM ev UNION ALL {ghost}) SELECT idx, CAST({fold}(v) AS DOUBLE) AS v FROM r GROUP BY idx"


def _halo(spark, d, op):
    vec, n = events(spark, d), size_of(spark, d)
    held = halo.ghosts(vec, 2, 2, 100).filter((F.col("blk") >= 0) & (F.col("blk") < n // 100))
    return doubles(halo.halo_reduce(vec, held, op).df)


for _op, _fold in (("plus", "sum"), ("max", "max"), ("min", "min")):
    QUERIES[f"halo_reduce_{_op}"] = lambda spark, d, op=_op: _halo(spark, d, op)
    SQL[f"halo_reduce_{_op}"] = _halo_sql(_fold)


@register("halo_reduce_second", EV + "SELECT idx, CAST(v AS DOUBLE) AS v FROM ev")
def _(spark, d):
    return _halo(spark, d, "second")


@register("halo_unstructured", EV + "SELECT idx % 3 AS blk, idx, CAST(v AS DOUBLE) AS v FROM ev WHERE idx % 5 = 0")
def _(spark, d):
    wanted = table(spark, d, "events").filter("event_id % 5 = 0").select((F.col("event_id") % 3).alias("blk"), F.col("event_id").alias(IDX))
    return doubles(halo.unstructured_exchange(events(spark, d), wanted))


# Arrays


@register("md_reshape2d", GRID + "SELECT i, j, CAST(v AS DOUBLE) AS v FROM g")
def _(spark, d):
    return doubles(grid(spark, d).df)


@register("md_flatten", EV + "SELECT idx, CAST(v AS DOUBLE) AS v FROM ev")
def _(spark, d):
    return doubles(cube(spark, d).flatten().df)


@register("md_box", GRID + "SELECT i - 2 AS i, j - 10 AS j, CAST(v AS DOUBLE) AS v FROM g WHERE i >= 2 AND i < 6 AND j >= 10 AND j < 50")
def _(spark, d):
    return doubles(grid(spark, d).box((2, 10), (6, 50), True).df)


@register("md_for_each_indexed", GRID + "SELECT i, j, CAST(v + i * 100 + j AS DOUBLE) AS v FROM g")
def _(spark, d):
    return doubles(grid(spark, d).for_each_indexed(lambda i, j, v: v + i * 100 + j).df)


@register("md_add_boxes", GRID + "SELECT i, j, CAST(v + 2 * v AS DOUBLE) AS v FROM g WHERE i >= 1 AND i < 5 AND j >= 1 AND j < 9")
def _(spark, d):
    a = grid(spark, d).box((1, 1), (5, 9))
    b = grid(spark, d).for_each(lambda v: v * 2).box((1, 1), (5, 9))
    both = a.zip(b, ["a", "b"]).for_each(lambda x, y: x + y, "v")
    return doubles(both.df.select("i", "j", "v"))


@register("md_transpose2d", GRID + "SELECT j AS i, i AS j, CAST(v AS DOUBLE) AS v FROM g")
def _(spark, d):
    return doubles(grid(spark, d).transpose().df)


@register("md_transpose3d_fwd", CUBE + "SELECT j AS i, k AS j, i AS k, CAST(v AS DOUBLE) AS v FROM c")
def _(spark, d):
    return doubles(cube(spark, d).transpose(True).df)


@register("md_transpose3d_inv", CUBE + "SELECT k AS i, i AS j, j AS k, CAST(v AS DOUBLE) AS v FROM c")
def _(spark, d):
    return doubles(cube(spark, d).transpose(False).df)


def _shift(name: str, di: int, dj: int) -> str:
    return f"LEFT JOIN g {name} ON {name}.i = g.i + {di} AND {name}.j = g.j + {dj} "


FIVE = GRID + "SELECT g.i, g.j, round(CASE WHEN g.i >= 1 AND g.i < g.m - 1 AND g.j >= 1 AND g.j < 99 THEN CAST(n.v + w.v + g.v + e.v + s.v AS DOUBLE) / 4 ELSE CAST(g.v AS DOUBLE) END, 6) AS v FROM g " + _shift("n", -1, 0) + _shift("w", 0, -1) + _shift("e", 0, 1) + _shift("s", 1, 0)


@register("md_stencil5_step", FIVE)
def _(spark, d):
    return kernels.stencil2d(grid(spark, d)).df.select("i", "j", F.round("v", 6).alias("v"))


def _five_sql(steps: int) -> str:
    sql = GRID + ", s0 AS (SELECT i, j, m, CAST(v AS DOUBLE) AS v FROM g)"
    for k in range(1, steps + 1):
        near = "".join(f" LEFT JOIN s{k - 1} {name} ON {name}.i = c.i + {di} AND {name}.j = c.j + {dj}" for name, di, dj in (("n", -1, 0), ("w", 0, -1), ("e", 0, 1), ("s", 1, 0)))
        sql += f", s{k} AS (SELECT c.i, c.j, c.m, CASE WHEN c.i >= 1 AND c.i < c.m - 1 AND c.j >= 1 AND c.j < 99 THEN (n.v + w.v + c.v + e.v + s.v) / 4 ELSE c.v END AS v FROM s{k - 1} c{near})"
    # 4 ** steps v has two decimals: no ties of rounding.
    return sql + f" SELECT i, j, round(v * {4**steps}, 2) AS v FROM s{steps}"


@register("md_stencil5_3steps", _five_sql(3))
def _(spark, d):
    """Three steps on tiles of 32 x 32, stored by tile after the second: two exchanges of borders."""
    m, n = grid(spark, d).shape
    tiles = Tiles.of(grid(spark, d), (32, 32))
    return iterated(tiles, lambda *near: sum(near) / 4, kernels.CROSS, (1, 1), (m - 1, n - 1), 3, 2).cells().df.select("i", "j", F.round(F.col("v") * 64, 2).alias("v"))


SEVEN = [(0, 0, 0), (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]


@register(
    "md_stencil7_cube",
    CUBE + "SELECT c.i, c.j, c.k, round(coalesce(CAST(sum(o.v) AS DOUBLE), 0), 6) AS v FROM c LEFT JOIN c o ON abs(o.i - c.i) + abs(o.j - c.j) + abs(o.k - c.k) <= 1 AND o.i BETWEEN c.i - 1 AND c.i + 1 "
    "AND c.i BETWEEN 1 AND (SELECT n // 100 - 2 FROM n) AND c.j BETWEEN 1 AND 8 AND c.k BETWEEN 1 AND 8 GROUP BY ALL",
)
def _(spark, d):
    m = cube(spark, d).shape[0]
    found = Tiles.of(cube(spark, d), (8, 4, 4)).stencil(lambda *near: sum(near), SEVEN, (1, 1, 1), (m - 1, 9, 9), other=0.0)
    return found.cells().df.select("i", "j", "k", F.round("v", 6).alias("v"))


@register("md_tiles", GRID + "SELECT i // 32 AS i, j // 32 AS j, count(*) AS cells, CAST(sum(v) AS DOUBLE) AS total FROM g GROUP BY ALL")
def _(spark, d):
    tiles = Tiles.of(grid(spark, d), (32, 32)).df
    total = F.aggregate("block", F.lit(0).cast("decimal(28,2)"), lambda a, v: (a + v.cast(MONEY)).cast("decimal(28,2)"))
    return doubles(tiles.select("i", "j", F.size("block").cast("bigint").alias("cells"), total.alias("total")))


@register("md_gradient_x", GRID + "SELECT g.i, g.j, round(CASE WHEN g.i >= 1 AND g.i < g.m - 1 THEN CAST(s.v - g.v AS DOUBLE) ELSE 0 END, 6) AS v FROM g " + _shift("s", 1, 0))
def _(spark, d):
    own = grid(spark, d)
    m, n = own.shape
    found = Tiles.of(own).stencil(lambda here, right: right - here, [(0, 0), (1, 0)], (1, 0), (m - 1, n), other=0.0)
    return found.cells().df.select("i", "j", F.round("v", 6).alias("v"))


@register("md_divergence", GRID + "SELECT g.i, g.j, round(CASE WHEN g.i >= 1 AND g.j < 99 THEN CAST(g.v - n.v + e.v - g.v AS DOUBLE) ELSE 0 END, 6) AS v FROM g " + _shift("n", -1, 0) + _shift("e", 0, 1))
def _(spark, d):
    own = grid(spark, d)
    m, n = own.shape
    found = Tiles.of(own).stencil(lambda here, left, up: here - left + up - here, [(0, 0), (-1, 0), (0, 1)], (1, 0), (m, n - 1), other=0.0)
    return found.cells().df.select("i", "j", F.round("v", 6).alias("v"))


#: Rows of the grid as elements: an inner place becomes the sum of its cross, from three whole rows.
@register("rows_stencil5", GRID + "SELECT g.i, g.j, CAST(CASE WHEN g.i >= 1 AND g.i < g.m - 1 AND g.j >= 1 AND g.j < 99 THEN n.v + w.v + g.v + e.v + s.v ELSE g.v END AS DOUBLE) AS v FROM g " + _shift("n", -1, 0) + _shift("w", 0, -1) + _shift("e", 0, 1) + _shift("s", 1, 0))
def _(spark, d):
    own = grid(spark, d)
    rows = own.rows()

    def cross(near):
        up, here, down = near
        sides = F.transform(here, lambda v, j: F.when((j >= 1) & (j < F.size(here) - 1), F.get(here, j - 1) + v + F.get(here, j + 1)))
        summed = F.zip_with(F.zip_with(up, down, lambda a, b: a + b), sides, lambda a, b: a + b)
        return F.zip_with(summed, here, lambda new, old: F.coalesce(new, old))

    found = halo.sliding_map(rows, 1, 1, cross, own.shape[0], block=64)
    return doubles(NdArray.from_rows(found, own.shape).df.select("i", "j", F.col("v").cast("double").alias("v")))


#: Windows of three whole rows, as arrays of arrays.
@register("rows_sliding", GRID + "SELECT g.i, g.j, CAST(g.v AS DOUBLE) AS a, CAST(p.v AS DOUBLE) AS b, CAST(q.v AS DOUBLE) AS c FROM g JOIN g p ON p.i = g.i + 1 AND p.j = g.j JOIN g q ON q.i = g.i + 2 AND q.j = g.j")
def _(spark, d):
    own = grid(spark, d)
    windows = halo.sliding(own.rows(), 3, own.shape[0], 32)
    cells = windows.select(F.col(IDX).alias("i"), F.posexplode(F.arrays_zip(*[F.col("window")[k].alias(c) for k, c in enumerate("abc")])).alias("j", "x"))
    return doubles(cells.select("i", F.col("j").cast("bigint").alias("j"), *[F.col("x")[c].alias(c) for c in "abc"]))


@register("md_diagnostics", GRID + "SELECT CAST(max(v) AS DOUBLE) AS peak, CAST(sum(v) AS DOUBLE) AS total, CAST(sum(v * v) AS DOUBLE) AS energy FROM g")
def _(spark, d):
    return doubles(grid(spark, d).df.agg(F.max("v").alias("peak"), F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("energy")))


# Sparse and dense matrices


@register("spmv", SPARSE + "SELECT p_partkey AS idx, CAST(coalesce(sum(v * x), 0) AS DOUBLE) AS v FROM part LEFT JOIN (SELECT i, v, x FROM a JOIN x ON j = idx) ON i = p_partkey GROUP BY p_partkey")
def _(spark, d):
    return doubles(sparse(spark, d).spmv(balances(spark, d)).df)


@register("spmv_accumulate", SPARSE + ", s AS (SELECT i, sum(v * x) AS s FROM a JOIN x ON j = idx GROUP BY i) SELECT p_partkey AS idx, CAST(CAST(p_retailprice AS DECIMAL(18,2)) + coalesce(s, 0) AS DOUBLE) AS v FROM part LEFT JOIN s ON i = p_partkey")
def _(spark, d):
    return doubles(sparse(spark, d).spmv(balances(spark, d), parts(spark, d)).df)


@register("spmm_slim", SPARSE + "SELECT p_partkey AS i, col, CAST(coalesce(sum(v * x * (col + 1)), 0) AS DOUBLE) AS v FROM range(8) t(col), part LEFT JOIN (SELECT i, v, x FROM a JOIN x ON j = idx) ON i = p_partkey GROUP BY p_partkey, col")
def _(spark, d):
    cols = F.explode(F.sequence(F.lit(0), F.lit(7)))
    b = balances(spark, d).df.select(IDX, "x", cols.alias("col"))
    return doubles(sparse(spark, d).spmm(b.select(IDX, F.col("col").cast("bigint").alias("col"), (F.col("x") * (F.col("col") + 1)).alias("x"))))


@register("sparse_row", SPARSE + "SELECT j AS idx, CAST(v AS DOUBLE) AS v FROM a WHERE i = 7")
def _(spark, d):
    return doubles(sparse(spark, d).row_cells(7))


@register("sparse_submatrix", SPARSE + "SELECT i - 5 AS i, j - 2 AS j, CAST(v AS DOUBLE) AS v FROM a WHERE i >= 5 AND i < 60 AND j >= 2 AND j < 8")
def _(spark, d):
    return doubles(sparse(spark, d).submatrix((5, 60), (2, 8)).df)


@register("sparse_tile", SPARSE + "SELECT i - 32 AS i, j - 4 AS j, CAST(v AS DOUBLE) AS v FROM a WHERE i >= 32 AND i < 64 AND j >= 4 AND j < 8")
def _(spark, d):
    return doubles(sparse(spark, d).tile(1, 1, (32, 4)).df)


@register("sparse_set_tile", SPARSE + "SELECT i, j, CAST(CASE WHEN i >= 32 AND i < 64 AND j >= 4 AND j < 8 THEN 2 * v ELSE v END AS DOUBLE) AS v FROM a")
def _(spark, d):
    own = sparse(spark, d)
    tile = own.tile(1, 1, (32, 4))
    return doubles(own.with_tile(Mat(tile.df.withColumn("v", F.col("v") * 2), tile.shape), 1, 1, (32, 4)).df)


@register("sparse_block_cyclic", SPARSE + "SELECT (i // 32) % 2 * 2 + (j // 4) % 2 AS rank, count(*) AS n FROM a GROUP BY ALL")
def _(spark, d):
    return sparse(spark, d).tiled((32, 4), (2, 2)).groupBy("rank").agg(F.count("*").alias("n"))


@register("sparse_find", SPARSE + "SELECT i, j, CAST(v AS DOUBLE) AS v FROM a WHERE i = 7 AND j = 3")
def _(spark, d):
    return doubles(sparse(spark, d).find(7, 3))


@register("sparse_entry_reduce", SPARSE + "SELECT CAST(sum(v + i + j) AS DOUBLE) AS value FROM a")
def _(spark, d):
    return doubles(sparse(spark, d).reduce_entries())


@register("sparse_entries_reverse", SPARSE + "SELECT i, j, CAST(v AS DOUBLE) AS v FROM a ORDER BY i DESC, j DESC")
def _(spark, d):
    return doubles(sparse(spark, d).entries(True))


def _thinned(spark: SparkSession, d: str) -> Mat:
    """Two rows in three have no cell."""
    own = sparse(spark, d)
    return Mat(own.df.filter("i % 3 = 0"), own.shape)


THIN = SPARSE + ", h AS (SELECT i, v, x FROM a JOIN x ON j = idx WHERE i % 3 = 0) "


@register("spmv_empty_rows", THIN + "SELECT p_partkey AS idx, CAST(coalesce(sum(v * x), 0) AS DOUBLE) AS v FROM part LEFT JOIN h ON i = p_partkey GROUP BY p_partkey")
def _(spark, d):
    return doubles(_thinned(spark, d).spmv(balances(spark, d)).df)


@register("spmm_empty_rows", THIN + "SELECT p_partkey AS i, col, CAST(coalesce(sum(v * x * (col + 1)), 0) AS DOUBLE) AS v FROM range(3) t(col), part LEFT JOIN h ON i = p_partkey GROUP BY p_partkey, col")
def _(spark, d):
    x = balances(spark, d)
    b = x.df.select(IDX, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("col"), F.col("x").alias("own"))
    return doubles(_thinned(spark, d).spmm(b.select(IDX, "col", (F.col("own") * (F.col("col") + 1)).alias("x")), 3))


@register("sparse_row_dense", SPARSE + "SELECT s_suppkey AS idx, CAST(coalesce(v, 0) AS DOUBLE) AS v FROM supplier LEFT JOIN a ON j = s_suppkey AND i = 7")
def _(spark, d):
    return doubles(sparse(spark, d).row(7).df)


@register("sparse_for_each", SPARSE + "SELECT i, j, CAST(v * 2 + i AS DOUBLE) AS v FROM a")
def _(spark, d):
    return doubles(sparse(spark, d).for_each(lambda i, j, v: v * 2 + i).df)


@register("sparse_from_rows", SPARSE + "SELECT i, j, CAST(v AS DOUBLE) AS v FROM a")
def _(spark, d):
    own = sparse(spark, d)
    return doubles(Mat.from_rows(own.df.groupBy("i").agg(F.collect_list(F.struct("j", "v")).alias("cells")), own.shape).df)


@register("matrix_market_roundtrip", SPARSE + "SELECT i, j, CAST(v AS DOUBLE) AS v FROM a")
def _(spark, d):
    at = f"{shared.shared_dir(spark)}/gridstone/{uuid.uuid4().hex}/matrix"
    matrix_market.write(sparse(spark, d), at)
    return matrix_market.read(spark, at).df


@register("matrix_market_tiles", SPARSE + "SELECT i // 32 AS bi, j // 4 AS bj, count(*) AS n FROM a GROUP BY ALL")
def _(spark, d):
    at = f"{shared.shared_dir(spark)}/gridstone/{uuid.uuid4().hex}/matrix"
    matrix_market.write(sparse(spark, d), at)
    return matrix_market.distributed(matrix_market.read(spark, at), (32, 4), 8).groupBy("bi", "bj").agg(F.count("*").alias("n"))


@register("sink_text", EV + "SELECT v::DOUBLE AS v FROM ev")
def _(spark, d):
    at = f"{shared.shared_dir(spark)}/gridstone/{uuid.uuid4().hex}/vector"
    events(spark, d).write_text(at)
    return spark.read.text(at).select(F.col("value").cast("double").alias("v"))


@register("view_all", EV + "SELECT idx, CAST(v AS DOUBLE) AS v FROM ev")
def _(spark, d):
    return doubles(events(spark, d).all().df)


@register("view_ranked", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS wrong FROM events")
def _(spark, d):
    ranked = events(spark, d).ranked().df
    return ranked.agg(F.count("*").alias("n"), F.count_if(F.col("rank").isNull() | (F.col("rank") < 0)).alias("wrong"))


@register("view_segmented_by", EV + "SELECT idx, CAST(v AS DOUBLE) AS v, CASE WHEN idx < 40 THEN 0 WHEN idx < 100 THEN 1 ELSE 2 END::BIGINT AS segment FROM ev")
def _(spark, d):
    return doubles(events(spark, d).segmented_by([40, 60, 1]).df)


@register("view_segmented_like", EV + "SELECT idx, CAST(v AS DOUBLE) AS v, (SELECT count(*) FROM range(1, 7) t(k) WHERE k * n // 7 <= idx) AS segment FROM ev, n")
def _(spark, d):
    other = Vec(spark.range(0, size_of(spark, d), 1, 7).select(F.col("id").alias(IDX), F.col("id").alias("v")))
    return doubles(segments.segmented_like(events(spark, d), other).df)


#: Segments that begin at the orders' places whose number is a square.
@register("view_segmented_many", EV + "SELECT idx, CAST(v AS DOUBLE) AS v, CAST(floor(sqrt(idx)) AS BIGINT) AS segment FROM ev")
def _(spark, d):
    starts = table(spark, d, "orders").select((F.col("o_orderkey") * F.col("o_orderkey")).alias(IDX))
    return doubles(segments.numbered_by(events(spark, d), starts).df)


@register("segments_local_sort", EV + ", s AS (SELECT idx // 300 AS segment, v FROM ev) SELECT segment * 300 + row_number() OVER (PARTITION BY segment ORDER BY v) - 1 AS idx, CAST(v AS DOUBLE) AS v, segment FROM s")
def _(spark, d):
    lengths = [300] * -(-size_of(spark, d) // 300)
    return segments.for_each_segment(events(spark, d).segmented_by(lengths), lambda v, start: np.sort(v)).df


@register("segments_offsets", EV + "SELECT idx, CAST(v AS DOUBLE) + (CASE WHEN idx < 40 THEN 0 WHEN idx < 100 THEN 40 ELSE 100 END) AS v, CASE WHEN idx < 40 THEN 0 WHEN idx < 100 THEN 1 ELSE 2 END::BIGINT AS segment FROM ev")
def _(spark, d):
    return segments.for_each_segment(events(spark, d).segmented_by([40, 60, 1]), lambda v, start: v + start).df


@register("vec_get", EV + "SELECT CAST(v AS DOUBLE) AS v FROM ev WHERE idx = 5")
def _(spark, d):
    return spark.createDataFrame([(float(events(spark, d).get(5)),)], "v double")


@register("rooted_copy", "SELECT n_nationkey AS idx, CAST(n_regionkey AS DOUBLE) AS v FROM nation")
def _(spark, d):
    held = Vec.from_table(table(spark, d, "nation"), "n_nationkey", v=F.col("n_regionkey").cast("double"))
    return Vec.from_root(spark, held.to_root()).df


@register("running_reduce_batch", EV + "SELECT CAST(sum(v) AS DOUBLE) AS value, count(*) AS n FROM ev")
def _(spark, d):
    return doubles(running.running_reduce(events(spark, d).df, "v"))


@register("md_equal", "SELECT true AS same, false AS other")
def _(spark, d):
    own = grid(spark, d)
    return spark.createDataFrame([(own.equal(grid(spark, d)), own.equal(own.for_each(lambda v: v + 1)))], "same boolean, other boolean")


@register("md_row_stencil", GRID + "SELECT g.i, g.j, CAST(CASE WHEN p.v IS NULL OR q.v IS NULL THEN g.v ELSE p.v + g.v + q.v END AS DOUBLE) AS v FROM g LEFT JOIN g p ON p.i = g.i - 1 AND p.j = g.j LEFT JOIN g q ON q.i = g.i + 1 AND q.j = g.j")
def _(spark, d):
    own = grid(spark, d)
    own = NdArray(own.df.withColumn("v", F.col("v").cast("double")), own.shape)
    return own.stencil(lambda a, b, c: F.round(a + b + c, 6), [(-1, 0), (0, 0), (1, 0)], (1, 0), (own.shape[0] - 1, own.shape[1])).df


# Compressed blocks of rows

PLACED = SPARSE + ", p AS (SELECT *, row_number() OVER (ORDER BY i, j) - 1 AS place FROM a) "


@register("csr_cells", SPARSE + "SELECT i, j, CAST(v AS DOUBLE) AS v FROM a")
def _(spark, d):
    return Csr.by_rows(sparse(spark, d), 64).cells().df


@register("csr_balanced_blocks", PLACED + "SELECT place // 500 AS blk, count(*) AS n, min(i) AS first, max(i) AS last FROM p GROUP BY ALL")
def _(spark, d):
    return Csr.balanced(sparse(spark, d), 500).df.select("blk", "n", "first", "last")


@register("csr_row", SPARSE + "SELECT j AS idx, CAST(v AS DOUBLE) AS v FROM a WHERE i = 7")
def _(spark, d):
    return Csr.balanced(sparse(spark, d), 50, 4).row(7)


@register("csr_submatrix", SPARSE + "SELECT i - 5 AS i, j - 2 AS j, CAST(v AS DOUBLE) AS v FROM a WHERE i >= 5 AND i < 60 AND j >= 2 AND j < 8")
def _(spark, d):
    return Csr.by_rows(sparse(spark, d), 16, 4).submatrix((5, 60), (2, 8)).df


@register("csr_row_counts", SPARSE + "SELECT i, count(*) AS n FROM a GROUP BY i")
def _(spark, d):
    return Csr.balanced(sparse(spark, d), 300).row_counts()


SPMV_ROUNDED = "SELECT p_partkey AS idx, round(CAST(coalesce(sum(v * x), 0) AS DOUBLE), 2) AS v FROM part LEFT JOIN (SELECT i, v, x FROM a JOIN x ON j = idx) ON i = p_partkey GROUP BY p_partkey"


def _rounded(vec: Vec) -> DataFrame:
    return vec.df.select(IDX, (F.round("v", 2) + 0.0).alias("v"))


@register("spmv_csr", SPARSE + SPMV_ROUNDED)
def _(spark, d):
    return _rounded(Csr.by_rows(sparse(spark, d), 128, 64).spmv(balances(spark, d)))


@register("spmv_balanced", SPARSE + SPMV_ROUNDED)
def _(spark, d):
    return _rounded(Csr.balanced(sparse(spark, d), 1000).spmv(balances(spark, d)))


NEW = ", b AS (SELECT r AS i, c AS j, CAST(1 AS DECIMAL(18,2)) AS v FROM range(50) t(r), range(3) u(c)) "


def _new(spark) -> Mat:
    cells = spark.range(150).select(div(F.col("id"), 3).alias("i"), (F.col("id") % 3).alias("j"), F.lit(1).cast(MONEY).alias("v"))
    return Mat(cells, (50, 3))


@register("sparse_upsert", SPARSE + NEW + "SELECT i, j, CAST(coalesce(b.v, a.v) AS DOUBLE) AS v FROM a FULL JOIN b USING (i, j)")
def _(spark, d):
    return doubles(sparse(spark, d).insert_or_assign(_new(spark)).df)


@register("sparse_insert_no_overwrite", SPARSE + NEW + "SELECT i, j, CAST(coalesce(a.v, b.v) AS DOUBLE) AS v FROM a FULL JOIN b USING (i, j)")
def _(spark, d):
    return doubles(sparse(spark, d).insert(_new(spark)).df)


@register("sparse_reshape", SPARSE + "SELECT i, j, CAST(v AS DOUBLE) AS v FROM a WHERE i < 100 AND j < 5")
def _(spark, d):
    return doubles(sparse(spark, d).reshape((100, 5)).df)


@register("csr_rowptr", SPARSE + ", c AS (SELECT p_partkey AS i, count(a.i) AS n FROM part LEFT JOIN a ON a.i = p_partkey GROUP BY p_partkey) SELECT i, CAST(coalesce(sum(n) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM c")
def _(spark, d):
    return sparse(spark, d).row_pointers()


@register("gemm_gram", DENSE + "SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 6) AS v FROM e a JOIN e b ON a.i = b.i GROUP BY ALL")
def _(spark, d):
    e = embedding(spark, d)
    left = Mat(e.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), (64, e.shape[0]))
    return left.gemm(e).df.select("i", "j", F.round("v", 6).alias("v"))


@register("gemm_blocked", DENSE + "SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 6) AS v FROM e a JOIN e b ON a.i = b.i GROUP BY ALL")
def _(spark, d):
    e = embedding(spark, d)
    left = Mat(e.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), (64, e.shape[0]))
    return left.gemm_blocked(e).df.select("i", "j", F.round("v", 6).alias("v"))


@register("gemm_accumulate", DENSE + "SELECT a.j AS i, b.j AS j, round(1 + sum(a.v * b.v), 6) AS v FROM e a JOIN e b ON a.i = b.i GROUP BY ALL")
def _(spark, d):
    e = embedding(spark, d)
    left = Mat(e.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), (64, e.shape[0]))
    ones = spark.range(64 * 64).select(div(F.col("id"), 64).alias("i"), (F.col("id") % 64).alias("j"), F.lit(1.0).alias("v"))
    return left.gemm(e, Mat(ones, (64, 64))).df.select("i", "j", F.round("v", 6).alias("v"))


@register("dense_row", DENSE + "SELECT j AS idx, v FROM e WHERE i = 3")
def _(spark, d):
    return embedding(spark, d).row(3).df


@register("dense_column", DENSE + "SELECT i AS idx, v FROM e WHERE j = 5")
def _(spark, d):
    return embedding(spark, d).column(5).df


@register("gen_band", "SELECT a.s_suppkey AS i, b.s_suppkey AS j, 1.0::DOUBLE AS v FROM supplier a JOIN supplier b ON b.s_suppkey BETWEEN a.s_suppkey - 2 AND a.s_suppkey + 4")
def _(spark, d):
    return generators.band(spark, size_of(spark, d, "supplier"), 4, 2).df


@register("spmm_band", "SELECT a.p_partkey AS i, c AS col, CAST(sum(CAST(b.p_retailprice AS DECIMAL(18,2)) * (c + 1)) AS DOUBLE) AS v FROM part a JOIN part b ON b.p_partkey BETWEEN a.p_partkey - 20 AND a.p_partkey + 20, range(8) w(c) GROUP BY ALL")
def _(spark, d):
    x = parts(spark, d).df
    b = x.select(IDX, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint"))).alias("col"), F.col("v").alias("own")).select(IDX, "col", (F.col("own") * (F.col("col") + 1)).alias("x"))
    band = generators.band(spark, size_of(spark, d, "part"), 20, 20)
    return doubles(Mat(band.df.withColumn("v", F.col("v").cast("int")), band.shape).spmm(b, 8))


def _random_shape(spark, d) -> tuple[int, int]:
    """As many rows and columns as there are parts and suppliers."""
    return size_of(spark, d, "part"), size_of(spark, d, "supplier")


@register("gen_random_sparse")
def _(spark, d):
    return generators.random_sparse(spark, _random_shape(spark, d), 0.02, 5).df


@register("gen_random_sparse_law", "SELECT CAST(floor(0.02e0 * (p * s)) AS BIGINT) AS n, CAST(floor(0.02e0 * (p * s)) AS BIGINT) AS cells, CAST(0 AS BIGINT) AS outside FROM (SELECT (SELECT count(*) FROM part) AS p, (SELECT count(*) FROM supplier) AS s)")
def _(spark, d):
    shape = _random_shape(spark, d)
    cells = generators.random_cells(spark, shape, 0.02, 5)
    outside = ~(F.col("i").between(0, shape[0] - 1) & F.col("j").between(0, shape[1] - 1) & (F.col("v") >= 0) & (F.col("v") < 1))
    # Each row has another n. Cells that give back their n are thus distinct, and need not be brought together to be counted.
    found = generators.with_numbers(cells, shape, 5)
    return found.agg(F.count("*").alias("n"), F.count_if(F.col("number") == F.col("n")).alias("cells"), F.count_if(outside).alias("outside"))


# Application kernels


def _prices(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias(IDX), F.col("p_retailprice").alias("s0"), (900.0 + F.col("p_size") * 10).alias("x"), (1.0 + F.col("p_partkey") % 5).alias("t"))


def _cdf_sql(x: str) -> str:
    t = f"(1 / (1 + {kernels.ERFC_P} * (abs({x}) / sqrt(2e0))))"
    a = kernels.ERFC_A
    poly = f"(((((({a[4]}) * {t} + ({a[3]})) * {t} + ({a[2]})) * {t} + ({a[1]})) * {t} + ({a[0]})) * {t})"
    tail = f"(0.5 * {poly} * exp(-({x}) * ({x}) / 2))"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END)"


@register(
    "black_scholes_poly",
    "WITH p AS (SELECT p_partkey AS idx, p_retailprice AS s0, 900e0 + p_size * 10 AS x, 1e0 + p_partkey % 5 AS t FROM part), "
    "q AS (SELECT *, (ln(s0 / x) + (0.05e0 + 0.02e0) * t) / (0.2e0 * sqrt(t)) AS d1, (ln(s0 / x) + (0.05e0 - 0.02e0) * t) / (0.2e0 * sqrt(t)) AS d2, exp(-0.05e0 * t) * x AS k FROM p) "
    f"SELECT idx, round(s0 * {_cdf_sql('d1')} - k * {_cdf_sql('d2')}, 4) AS vcall, round(k * {_cdf_sql('(-d2)')} - s0 * {_cdf_sql('(-d1)')}, 4) AS vput FROM q",
)
def _(spark, d):
    out = kernels.black_scholes(_prices(spark, d), 0.05, 0.2)
    return out.select(IDX, F.round("vcall", 4).alias("vcall"), F.round("vput", 4).alias("vput"))


@register("black_scholes_erfc")
def _(spark, d):
    return kernels.black_scholes(_prices(spark, d), 0.05, 0.2, kernels.normal_cdf).select(IDX, "vcall", "vput")


#: Forward and back again; the imaginary part is the next component of the events, so that the input is complex.
@register("fft3d_roundtrip", EV + "SELECT idx // 100 AS i, idx // 10 % 10 AS j, idx % 10 AS k, round(CAST(v AS DOUBLE), 6) AS re, round(CAST(w AS DOUBLE), 6) AS im FROM ev")
def _(spark, d):
    vec = events(spark, d, "v", "w")
    cells = vec.df.select(IDX, F.col("v").cast("double").alias("re"), F.col("w").cast("double").alias("im"))
    there = kernels.fft3d(NdArray.reshape(Vec(cells), (size_of(spark, d) // 100, 10, 10)))
    return kernels.fft3d(there, True).df.select("i", "j", "k", *[(F.round(c, 6) + 0.0).alias(c) for c in ("re", "im")])


#: Energy is kept: the transform's, over the number of cells, is that of the input.
@register("fft3d_energy", EV + "SELECT round(CAST(sum(v * v) AS DOUBLE), 3) AS power FROM ev")
def _(spark, d):
    n = size_of(spark, d)
    cells = events(spark, d).df.select(IDX, F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im"))
    there = kernels.fft3d(NdArray.reshape(Vec(cells), (n // 100, 10, 10)))
    return kernels.parseval(there).select(F.round(F.col("power") / n, 3).alias("power"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
