"""Registered queries against their SQL in DuckDB."""

import math
import os
import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        at = f"{sf_dir}/{t}.parquet"
        if os.path.exists(at):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}'")
    return con


def plain(x):
    if isinstance(x, float):
        return 0.0 if x == 0 else float(f"{x:.12g}") if math.isfinite(x) else str(x)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def differs(spark, con, sf_dir, query, sql):
    """What differs, or None."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    done = con.execute(sql)
    want = rows_of([c[0] for c in done.description], done.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} and {len(want[1])} rows"
    for a, b in zip(got[1], want[1], strict=True):
        if a != b:
            return f"{a} and {b}"
    if not got[1]:
        return "no rows"
    return None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    where, wanted = sys.argv[1], sys.argv[2:]
    con = connect(where)
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in wanted or [n for n in queries if not n.startswith("op") and n != "pipeline"]:
        began = time.time()
        try:
            said = differs(spark, con, where, queries[name], oracle[name]) if name in oracle else f"({queries[name](spark, where).count()} rows)"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:300]}"
        print(f"{name:30s} {time.time() - began:6.2f} {'ok' if said is None else said}", flush=True)
