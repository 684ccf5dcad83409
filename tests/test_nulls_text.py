"""Null rules, text edits and lenient casts (unit tests on tiny frames)."""

from pyspark.sql import functions as F

from scenaria.functions import (label_to_year, paste0, replace_first, skipna_sum, strict_max, strict_mean,
                                strict_min, strict_sum, strip_percent_number, to_number)
from scenaria.functions.arith import pct_of, rnd


def _rows(df):
    return {tuple(r) for r in df.collect()}


def test_strict_vs_skipna(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 3.0), ("c", None)], "k string, x double")
    out = {r.k: r for r in df.groupBy("k").agg(strict_sum("x").alias("s"), skipna_sum("x").alias("n"),
                                                strict_mean("x").alias("m"), strict_min("x").alias("lo"),
                                                strict_max("x").alias("hi")).collect()}
    assert out["a"].s is None and out["a"].n == 1.0 and out["a"].m is None
    assert out["b"].s == 5.0 and out["b"].m == 2.5 and out["b"].lo == 2.0 and out["b"].hi == 3.0
    assert out["c"].s is None and out["c"].n == 0.0  # all-null group: skip-null sum is 0


def test_null_group_key_kept(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 1.0)], "k string, x double")
    got = {r.k: r.s for r in df.groupBy("k").agg(strict_sum("x").alias("s")).collect()}
    assert got == {None: 3.0, "a": 1.0}


def test_paste0_and_first_match(spark):
    df = spark.createDataFrame([("NAM",), ("KNA",), (None,), ("NANA",), ("USA",)], "c string")
    out = df.select("c", replace_first(paste0("c"), "NA", "EU", literal=True).alias("r")).collect()
    got = {r.c: r.r for r in out}
    assert got == {"NAM": "EUM", "KNA": "KEU", None: "EU", "NANA": "EUNA", "USA": "USA"}


def test_lenient_numbers(spark):
    df = spark.createDataFrame([("12%",), ("#VALUE!",), ("1.06E+11",), ("-",), ("NA",), ("",), (" 7 ",), (None,)],
                               "t string")
    out = df.select("t", to_number("t").alias("n"), strip_percent_number("t").alias("p")).collect()
    got = {r.t: (r.n, r.p) for r in out}
    assert got["12%"] == (None, 12.0)
    assert got["#VALUE!"] == (None, None)
    assert got["1.06E+11"][0] == 1.06e11
    assert got["-"][0] is None and got["NA"][0] is None and got[""][0] is None
    assert got[" 7 "][0] == 7.0


def test_label_to_year(spark):
    df = spark.createDataFrame([("x2019",), ("x1960",), ("2020",)], "l string")
    assert [r.y for r in df.select(label_to_year("l").alias("y")).collect()] == [2019, 1960, 2020]


def test_pct_zero_denominator_is_null(spark):
    df = spark.createDataFrame([(5.0, 0.0), (5.0, 10.0), (None, 2.0)], "x double, g double")
    assert [r.p for r in df.select(pct_of("x", "g").alias("p")).collect()] == [None, 50.0, None]


def test_rnd_half_up(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (1.25,), (None,)], "x double")
    assert [r.r for r in df.select(rnd("x", 0).alias("r")).collect()] == [3.0, -2.0, 1.0, None]
