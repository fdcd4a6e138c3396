import math

import duckdb
from pyspark.sql import functions as F

from riskloom.functions.exprs import (clamp_zero, ieee_div, not_equal_keep_null, portable_hash,
                                      portable_hash_sql, replace_inf, sentinel_null)


def test_ieee_div(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-2.0, 0.0), (0.0, 0.0), (None, 0.0), (3.0, 2.0), (1.0, None)],
                               "a double, b double")
    got = [r[0] for r in df.select(ieee_div("a", "b")).collect()]
    assert got[0] == math.inf and got[1] == -math.inf
    assert got[2] is None and got[3] is None and got[5] is None
    assert got[4] == 1.5


def test_ieee_div_integers_no_ansi_error(spark):
    df = spark.createDataFrame([(5, 0), (0, 0)], "a bigint, b bigint")
    got = [r[0] for r in df.select(ieee_div("a", "b")).collect()]
    assert got == [math.inf, None]


def test_clamp_zero_missing_is_zero(spark):
    df = spark.createDataFrame([(3.0,), (-1.0,), (None,)], "x double")
    assert [r[0] for r in df.select(clamp_zero("x")).collect()] == [3.0, 0.0, 0.0]


def test_sentinel_and_replace_inf(spark):
    df = spark.createDataFrame([(365243, math.inf), (-10, -math.inf), (5, 2.0)], "d bigint, r double")
    rows = df.select(sentinel_null("d").alias("d"), replace_inf("r").alias("r")).collect()
    assert [r.d for r in rows] == [None, -10, 5]
    assert [r.r for r in rows] == [1e9, -1e9, 2.0]


def test_not_equal_keeps_null(spark):
    df = spark.createDataFrame([("M",), ("XNA",), (None,), ("F",)], "g string")
    kept = [r.g for r in df.where(not_equal_keep_null("g", "XNA")).collect()]
    assert sorted(kept, key=str) == sorted(["M", None, "F"], key=str)


def test_portable_hash_matches_duckdb(spark):
    keys = list(range(1, 200)) + [10 ** 12]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    got = {r.k: r.h for r in df.select("k", portable_hash("k", seed=1001).alias("h")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT UNNEST(?) AS k", [keys])
    ref = dict(con.execute(f"SELECT k, {portable_hash_sql('k', seed=1001)} FROM t").fetchall())
    assert got == ref
    assert all(0 <= v < 2 ** 32 for v in got.values())
