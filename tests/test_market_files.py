"""The Matrix Market data source: byte ranges, kinds, and commits that are whole or nothing."""

import os

import pytest
from gridstone.operators.linalg import Mat
from gridstone.sources import market_files, matrix_market
from pyarrow import fs
from pyspark.sql import functions as F


def cells(df):
    return sorted(map(tuple, df.select("i", "j", "v").collect()))


@pytest.mark.parametrize("tail", ["", "\n", "\n\n"])
def test_lines_of_ranges(tmp_path, tail, monkeypatch):
    """Whatever the cuts, each line is in one range, once and whole."""
    lines = ["", "1 2 3", "", "x" * 40, "4 5", "", "6"]
    path = tmp_path / "f"
    path.write_text("\n".join(lines) + tail)
    size = path.stat().st_size
    for block in (1, 7, 1000):
        monkeypatch.setattr(market_files, "READ_BYTES", block)
        for step in (1, 2, 3, 5, 11, 100):
            got = []
            with fs.LocalFileSystem().open_input_file(str(path)) as f:
                for a in range(0, size, step):
                    for part in market_files.lines_between(f, a, min(a + step, size)):
                        got += part.decode().split("\n")
            assert [x for x in got if x] == [x for x in lines if x]


@pytest.mark.parametrize("split", [1, 17, 1 << 20])
@pytest.mark.parametrize("kind, symmetry", [("real", "general"), ("integer", "general"), ("integer", "symmetric"), ("pattern", "symmetric"), ("pattern", "general")])
def test_format(spark, tmp_path, split, kind, symmetry):
    own = [(k % 9, k * k % (k % 9 + 1), 10**17 + k if kind == "integer" else k / 4) for k in range(40)]
    own = list({(i, j): (i, j, v) for i, j, v in own}.values())
    body = "".join(f"{i + 1}  {j + 1}" + ("" if kind == "pattern" else f"\t{v}") + "\n" for i, j, v in own)
    path = tmp_path / "m.mtx"
    path.write_text(f"%%MatrixMarket matrix coordinate {kind} {symmetry}\n% a\n%b\n\n9 9 {len(own)}\n{body}")
    market_files.register(spark)
    df = spark.read.format("matrixmarket").option("splitbytes", split).load(str(path))
    want = [(i, j, 1.0 if kind == "pattern" else v) for i, j, v in own]
    if symmetry == "symmetric":
        want += [(j, i, v) for i, j, v in want if i != j]
    assert dict(df.dtypes)["v"] == ("bigint" if kind == "integer" else "double")
    assert cells(df) == sorted(want)
    assert split > 1000 or df.rdd.getNumPartitions() >= 5
    assert cells(matrix_market.read(spark, str(path)).df) == sorted(want)


def test_bounds_fail_the_task(spark, tmp_path):
    path = tmp_path / "m.mtx"
    path.write_text("%%MatrixMarket matrix coordinate real general\n2 2 2\n1 1 1\n3 1 1\n")
    unchecked = matrix_market.read(spark, str(path), checked=False)
    with pytest.raises(Exception, match="out of bounds"):
        unchecked.df.collect()


def matrix(spark, n=50, shift=0.0):
    df = spark.range(n).select((F.col("id") % 7).alias("i"), F.col("id").alias("j"), (F.col("id") / 3 + shift).alias("v")).repartition(5)
    return Mat(df, (7, 200))


def test_write_is_whole(spark, tmp_path):
    path, own = str(tmp_path / "m"), matrix(spark)
    matrix_market.write(own, path)
    assert open(f"{path}/{market_files.HEAD}").read().split("\n")[1] == "7 200 50"
    assert not [f for f in os.listdir(path) if f.startswith("_")]
    back = matrix_market.read(spark, path)
    assert back.shape == (7, 200) and cells(back.df) == cells(own.df)


def test_append_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "m")
    matrix_market.write(matrix(spark), path)
    more = Mat(spark.createDataFrame([(0, 150, 1.5)], "i long, j long, v double"), (7, 200))
    matrix_market.write(more, path)
    assert len(cells(matrix_market.read(spark, path).df)) == 51
    with pytest.raises(Exception, match="same shape"):
        matrix_market.write(Mat(more.df, (8, 200)), path)
    assert len(cells(matrix_market.read(spark, path).df)) == 51
    matrix_market.write(more, path, "overwrite")
    assert cells(matrix_market.read(spark, path).df) == [(0, 150, 1.5)]


def test_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "m")
    bad = matrix(spark).df.withColumn("v", F.when(F.col("j") == 33, F.raise_error(F.lit("no"))).otherwise(F.col("v")).cast("double"))
    with pytest.raises(Exception, match="no"):
        matrix_market.write(Mat(bad, (7, 200)), path)
    assert not os.path.exists(path) or os.listdir(path) == []
    matrix_market.write(matrix(spark), path)
    with pytest.raises(Exception, match="no"):
        matrix_market.write(Mat(bad, (7, 200)), path, "overwrite")
    assert cells(matrix_market.read(spark, path).df) == cells(matrix(spark).df)


def test_empty_matrix(spark, tmp_path):
    path = str(tmp_path / "m")
    matrix_market.write(Mat(matrix(spark).df.filter("false"), (7, 200)), path)
    assert cells(matrix_market.read(spark, path).df) == []
