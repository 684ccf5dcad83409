"""Property tests: order and partitioning independence, interpolation bounds, strict = skip-null without
nulls, and partial aggregation ahead of every shuffle of a hot key."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scenaria.functions.nulls import skipna_sum, strict_sum
from scenaria.operators import first_per_key, grouping_sets_total, interpolate_linear
from scenaria.operators.aggregate import attach_group_stat
from scenaria.plans import bindings as B
from scenaria.plans import stimulus as S
from tests.conftest import SF


def test_region_rollup_independent_of_partitioning(spark):
    long = B.stim_long(spark, SF)
    base = sorted(map(tuple, S.stimulus_by_region(long).collect()), key=str)
    for n in (1, 3, 7):
        shuffled = long.repartition(n, F.rand(seed=n)).orderBy(F.rand(seed=n + 1))
        assert sorted(map(tuple, S.stimulus_by_region(shuffled).collect()), key=str) == base


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(2000, 2010), st.integers(-10_000, 10_000)), min_size=2, max_size=8,
                unique_by=lambda t: t[0]))
def test_interpolation_hits_knots_and_stays_between(spark, knots):
    df = spark.createDataFrame([("s", y, float(v)) for y, v in knots], "s string, year int, v double")
    got = {r.year: r.v for r in interpolate_linear(df, ["s"], "year", "v").collect()}
    ks = sorted(knots)
    assert sorted(got) == list(range(ks[0][0], ks[-1][0] + 1))
    for y, v in ks:
        assert got[y] == float(v)
    for (y0, v0), (y1, v1) in zip(ks, ks[1:]):
        lo, hi = min(v0, v1), max(v0, v1)
        for y in range(y0, y1 + 1):
            assert lo - 1e-9 <= got[y] <= hi + 1e-9


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(-100, 100)), min_size=1, max_size=20))
def test_strict_equals_skipna_without_nulls(spark, rows):
    df = spark.createDataFrame([(k, float(v)) for k, v in rows], "k string, x double")
    out = df.groupBy("k").agg(strict_sum("x").alias("a"), skipna_sum("x").alias("b")).collect()
    assert all(r.a == r.b for r in out)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_key_is_pre_aggregated_before_shuffle(spark):
    # one key holds a third of all rows: every grouped step must aggregate partially before its exchange
    df = spark.range(0, 30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 1000).cast("string")))
        .alias("k"), F.col("id").alias("o"), (F.col("id") % 7).cast("double").alias("x"))
    for out in (first_per_key(df, ["k"], ["o"]),
                grouping_sets_total(df.withColumn("c", F.lit("c")), "k", "c", "x"),
                attach_group_stat(df, ["k"], {"s": strict_sum("x")})):
        p = _plan(out)
        assert "partial_" in p, p
        assert "Window" not in p, p
    first = {r.k: r.o for r in first_per_key(df, ["k"], ["o"]).collect()}
    assert first["hot"] == 0 and len(first) == 1001
