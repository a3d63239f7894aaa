"""Ordered lookups against bisection, and as-of joins against a loop."""

import bisect
import random

import pytest
from gridstone.operators import lookup
from gridstone.operators.vector import Vec
from pyspark.sql import functions as F


def rows_of(seed, n, spread):
    rng = random.Random(seed)
    return [rng.randrange(spread) / 2 if rng.random() > 0.02 else None for _ in range(n)]


@pytest.mark.parametrize("right", [False, True])
@pytest.mark.parametrize("n, m, spread", [(300, 200, 50), (50, 400, 3), (400, 1, 9), (200, 0, 5), (0, 10, 5), (500, 500, 1)])
def test_position(spark, right, n, m, spread):
    probes, table = rows_of(1, n, spread), rows_of(2, m, spread)
    a = spark.createDataFrame(list(enumerate(probes)), "idx long, v double").withColumn("part", F.lit(7)).repartition(3)
    b = spark.createDataFrame([(x,) for x in table], "v double")
    got = {r.idx: r.position for r in lookup.position(a, b, "v", right).collect()}
    order = sorted(x for x in table if x is not None)
    find = bisect.bisect_right if right else bisect.bisect_left
    assert got == {k: None if x is None else find(order, x) for k, x in enumerate(probes)}
    assert lookup.position(a, b, "v", right).columns == ["idx", "v", "part", "position"]


def test_one_hot_value(spark):
    """A value that most rows share is split over ranges, by the rows' other columns."""
    a = spark.range(4000).selectExpr("id idx", "CASE WHEN id % 10 = 0 THEN CAST(id AS double) ELSE 5.0D END v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = lookup._merged(a, a.select("v"), "v", None, False)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in found.filter("not carry").groupBy("part").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 3000


def test_bounds_of_vectors(spark):
    table = Vec.of(spark, [1, 3, 3, 8])
    probes = Vec.of(spark, [0, 1, 3, 4, 9])
    assert [r.position for r in lookup.lower_bound(probes, table).df.orderBy("idx").collect()] == [0, 0, 1, 3, 4]
    assert [r.position for r in lookup.upper_bound(probes, table).df.orderBy("idx").collect()] == [0, 1, 3, 3, 4]


@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("groups", [1, 3, 60])
def test_asof(spark, exact, groups):
    rng = random.Random(groups)
    group = lambda: rng.choice([*range(groups), None])
    probes = [(k, group(), rng.choice([None, rng.randrange(90)])) for k in range(300)]
    table = [(g, t, f"{g}:{t}") for g, t in {(group(), rng.randrange(90)) for _ in range(150)}] + [(0, None, "lost")]
    a, b = spark.createDataFrame(probes, "id long, g int, t int"), spark.createDataFrame(table, "g int, t int, name string")
    got = {r.id: r.found and r.found.name for r in lookup.asof(a, b, "t", "g", exact).collect()}
    for k, g, t in probes:
        fit = [x for x in table if x[0] == g and t is not None and x[1] is not None and (x[1] <= t if exact else x[1] < t)]
        assert got[k] == (max(fit, key=lambda x: x[1])[2] if fit else None)


def test_asof_without_groups(spark):
    a = spark.range(20).selectExpr("id", "CAST(id AS int) t")
    b = spark.createDataFrame([(3, "a"), (11, "b")], "t int, name string")
    got = {r.id: r.found and r.found.name for r in lookup.asof(a, b, "t").collect()}
    assert got == {k: None if k < 3 else "a" if k < 11 else "b" for k in range(20)}
