"""Vectors, scans, sorts and halos against plain Python, under several partitionings and block sizes."""

import itertools
import random

import pytest
from gridstone.operators import halo, reductions, scans, sorting
from gridstone.operators.vector import IDX, Vec, with_halo, zipped
from pyspark.sql import functions as F


def values(vec, col="v"):
    return [r[col] for r in vec.df.orderBy(IDX).collect()]


@pytest.fixture(scope="module", params=[1, 3, 8])
def parts(request):
    return request.param


def make(spark, xs, parts=3, kind="bigint"):
    vec = Vec.of(spark, xs, kind)
    return Vec(vec.df.repartition(parts))


def test_views_clamp(spark, parts):
    xs = [random.Random(1).randrange(100) for _ in range(17)]
    v = make(spark, xs, parts)
    assert values(v.take(5)) == xs[:5] and values(v.take(99)) == xs and values(v.take(0)) == []
    assert values(v.drop(5)) == xs[5:] and values(v.drop(99)) == []
    assert values(v.slice(3, 9)) == xs[3:9] and values(v.counted(3, 4)) == xs[3:7] and values(v.subrange(16, 40)) == xs[16:]
    assert values(v.drop(2).take(4).drop(1)) == xs[3:6]
    assert [r[IDX] for r in v.drop(5).df.orderBy(IDX).collect()] == list(range(12))


def test_transform_and_zip(spark, parts):
    a, b, c = [1, 2, 3, 4], [10, 20, 30], [5, 6, 7, 8, 9]
    va, vb, vc = (make(spark, x, parts) for x in (a, b, c))
    assert values(va.transform(lambda x: x * 2).transform(lambda x: x + 1)) == [3, 5, 7, 9]
    z = zipped(va, vb, vc)
    assert [(r.v0, r.v1, r.v2) for r in z.df.orderBy(IDX).collect()] == list(zip(a, b, c, strict=False))
    same = zipped(va, va.transform(lambda x: -x))
    assert same.base is va.base and "Join" not in same.df._jdf.queryExecution().optimizedPlan().toString()
    assert values(zipped(va, va.transform(lambda x: -x)).transform(lambda x, y: x * y)) == [-1, -4, -9, -16]


def test_updates_keep_the_rest(spark, parts):
    xs = list(range(100, 110))
    v = make(spark, xs, parts)
    assert values(v.for_each_n(2, 3, lambda x: -x)) == [*xs[:2], *[-x for x in xs[2:5]], *xs[5:]]
    assert values(v.fill(7)) == [7] * 10 and values(v.fill(7, 4, 6)) == [*xs[:4], 7, 7, *xs[6:]]
    assert values(v.take(3).copy_into(v, 8)) == [*xs[:8], *xs[:2]]
    assert values(v.transform_into(v, lambda x: x + 1, 1)) == [100, *[x + 1 for x in xs[:9]]]
    assert values(v.resize(10, 4)) == xs[:4] and values(v.resize(10, 12, 5)) == [*xs, 5, 5]
    assert v.get(3) == 103 and values(v.put(3, 0))[3] == 0
    with pytest.raises(IndexError):
        v.get(10)
    assert values(Vec.iota(spark, 4, 9)) == [9, 10, 11, 12] and values(Vec.filled(spark, 3, 2)) == [2, 2, 2]


def test_reductions(spark, parts):
    xs = [4, -2, 7, 7, 0]
    v = make(spark, xs, parts)
    one = lambda df: df.first()[0]
    assert one(reductions.reduce(v)) == 16 and one(reductions.reduce(v, "plus", 100)) == 116
    assert one(reductions.reduce(v, "max", 9)) == 9 and one(reductions.reduce(v, "min")) == -2 and one(reductions.reduce(v.take(3), "multiplies", 2)) == -112
    assert one(reductions.reduce(v.take(0), "min", 3)) == 3 and one(reductions.reduce(v.take(0))) is None
    assert one(reductions.count(v, 7)) == 2 and one(reductions.count_if(v, lambda x: x > 0)) == 3
    assert one(reductions.equal(v, make(spark, xs, 2))) == 1 and one(reductions.equal(v, v.put(1, 5))) == 0
    assert one(reductions.equal(v, v.take(4))) == 0 and one(reductions.equal(v.take(0), v.take(0))) == 1
    words = make(spark, list("abcdefg"), parts, "string")
    assert one(reductions.reduce_with(words, lambda a, b: a + b, ">", "string", 2)) == ">abcdefg"


@pytest.mark.parametrize("block", [1, 2, 5, 100])
def test_scans(spark, parts, block):
    xs = [3, 1, 4, 1, 5, 9, 2, 6]
    v = make(spark, xs, parts)
    run = lambda op: list(itertools.accumulate(xs, op))
    assert values(scans.inclusive_scan(v, block=block)) == run(lambda a, b: a + b)
    assert values(scans.inclusive_scan(v, "max", block=block)) == run(max)
    assert values(scans.inclusive_scan(v, "multiplies", 10, block)) == [10 * x for x in run(lambda a, b: a * b)]
    assert values(scans.exclusive_scan(v, 10, block=block)) == [10 + sum(xs[:k]) for k in range(8)]
    assert values(scans.scan_into(v, v, 2, 5, 2, block=block)) == [3, 1, 4, 5, 10, 9, 2, 6]
    words = make(spark, list("abcdefgh"), parts, "string")
    assert values(scans.scan_with(words, lambda a, b: a + b, "string", block)) == ["abcdefgh"[: k + 1] for k in range(8)]
    assert values(scans.inclusive_scan(v.take(0), block=block)) == []


@pytest.mark.parametrize("ranges", [7, 40, 1000])
def test_sorts(spark, parts, ranges):
    rng = random.Random(2)
    xs = [rng.randrange(9) for _ in range(200)] + [5] * 100
    v = make(spark, xs, parts)
    assert values(sorting.sorted_vector(v, range_rows=ranges)) == sorted(xs)
    assert values(sorting.sorted_vector(v, True, ranges)) == sorted(xs, reverse=True)
    assert values(sorting.sort_subrange(v, 10, 60)) == [*xs[:10], *sorted(xs[10:60]), *xs[60:]]
    assert [r.v for r in sorting.sort(v).collect()] == sorted(xs)
    assert values(sorting.sorted_vector(v.take(0))) == []


@pytest.mark.parametrize("block", [3, 4, 7, 100])
def test_sliding(spark, parts, block):
    xs = list(range(1, 12))
    v = make(spark, xs, parts)
    n = len(xs)
    for width in (1, 2, 3):
        got = [list(r.window) for r in halo.sliding(v, width, n, block).orderBy(IDX).collect()]
        assert got == [xs[k : k + width] for k in range(n - width + 1)]
    moved = halo.sliding_map(v, 2, 1, lambda near: near[0] * 1000 + near[3], n, block=block)
    assert values(moved) == [*xs[:2], *[xs[k - 2] * 1000 + xs[k + 1] for k in range(2, n - 1)], xs[-1]]
    around = halo.sliding_map(v, 2, 1, lambda near: near[0] * 1000 + near[3], n, True, block)
    assert values(around) == [xs[k - 2] * 1000 + xs[(k + 1) % n] for k in range(n)]
    sums = [r.sum for r in halo.moving_sum(v, 1, 2, n, block).orderBy(IDX).collect()]
    assert sums == [sum(xs[k - 1 : k + 3]) for k in range(1, n - 2)]


@pytest.mark.parametrize("op", ["plus", "max", "min", "multiplies", "second"])
def test_halo_reduce(spark, op):
    v = make(spark, [1, 2, 3, 4, 5, 6])
    held = spark.createDataFrame([(2, 10), (3, 20), (3, 30)], "idx bigint, v bigint")
    fold = {"plus": sum, "max": max, "min": min, "multiplies": lambda x: x[0] * x[1] * (x[2] if len(x) > 2 else 1), "second": max}[op]
    assert values(halo.halo_reduce(v, held, op)) == [1, 2, fold([3, 10]), fold([4, 20, 30]), 5, 6]


def test_halo_of_blocks(spark):
    spread = with_halo(make(spark, list(range(10))).df, 1, 2, 4)
    got = {b: sorted(r[0] for r in spread.filter(F.col("blk") == b).select(IDX).collect()) for b in (0, 1, 2)}
    assert got == {0: [0, 1, 2, 3, 4, 5], 1: [3, 4, 5, 6, 7, 8, 9], 2: [7, 8, 9]}
    with pytest.raises(ValueError):
        with_halo(make(spark, [1]).df, 9, 0, 4)


def test_segments(spark):
    v = make(spark, list(range(50))).segmented(4)
    rows = v.segments().orderBy("first").collect()
    assert sum(r.n for r in rows) == 50 and all(a.last + 1 == b.first for a, b in zip(rows, rows[1:], strict=False))
    assert len(values(v.ranked(), "rank")) == 50
    assert [r.chunk for r in v.chunk(20).orderBy(IDX).collect()] == [list(range(20)), list(range(20, 40)), list(range(40, 50))]


def test_structs_and_arrays(spark):
    rows = Vec(spark.createDataFrame([(k, [k, k + 1]) for k in range(5)], "idx bigint, v array<bigint>"))
    summed = halo.sliding_map(rows, 1, 1, lambda near: F.zip_with(near[0], near[2], lambda a, b: a + b), 5, block=2)
    assert values(summed) == [[0, 1], [2, 4], [4, 6], [6, 8], [4, 5]]
    pairs = Vec(spark.createDataFrame([(k, (k, -k)) for k in range(3)], "idx bigint, v struct<a:int,b:int>"))
    assert values(pairs.transform(lambda s: s["a"] * s["b"])) == [0, -1, -4]


def test_stream(spark, tmp_path):
    from gridstone.streaming.running import running_reduce

    spark.createDataFrame([(k, k * 10) for k in range(20)], "s long, v long").selectExpr("timestamp_seconds(s) as t", "v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, v long").parquet(str(tmp_path / "in"))
    for name, how, mode in (("whole", {}, "complete"), ("windows", {"time": "t", "window": "10 seconds"}, "append")):
        q = running_reduce(stream, "v", "plus", **how).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert spark.table("whole").collect()[0][:] == (1900, 20)
    assert [r.value for r in spark.table("windows").collect()] == [450]
