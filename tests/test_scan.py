"""Scans and ranks over range partitions against their one-window versions."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from scenaria.operators.order import order_by_stat
from scenaria.operators.scan import RANGE, dealt, ranked, running_sum
from scenaria.operators.timeseries import interpolate_linear


def _by_window(df, keys, x, y):
    """The same interpolation with each series in one window."""
    knots = df.groupBy(*keys, x).agg(F.avg(y).alias(y))
    w = Window.partitionBy(*keys).orderBy(x)
    knot = F.when(F.col(y).isNotNull(), F.struct(F.col(x).alias("kx"), F.col(y).alias("ky")))
    s = knots.select(*keys, x, y, F.count(y).over(Window.partitionBy(*keys)).alias("n"),
                     F.last(knot, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("p"),
                     F.first(knot, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("q"), F.lead(x).over(w).alias("nx"))
    g = s.select("*", F.explode(F.sequence(F.col(x), F.coalesce(F.col("nx") - 1, F.col(x)))).alias("t"))
    v = F.when(F.col("n") < 2, None).when(F.col("t") == F.col("p.kx"), F.col("p.ky")).when(
        F.col("p").isNotNull() & F.col("q").isNotNull(),
        F.col("p.ky") + (F.col("q.ky") - F.col("p.ky")) * ((F.col("t") - F.col("p.kx")).cast("double") / (F.col("q.kx") - F.col("p.kx")).cast("double")))
    return g.select(*keys, F.col("t").cast("int").alias(x), v.cast("double").alias(y))


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_interpolation_over_ranges_equals_the_window(spark):
    rng = random.Random(7)
    rows = [("hot", 3 * i, None if rng.random() < 0.3 else rng.random()) for i in range(600)]
    rows += [("gap", i, 1.5 * i if i in (5, 395) else None) for i in range(400)]
    rows += [("one", 1990, 2.0), (None, 1, 1.0), (None, 5, 2.0), ("none", 1, None), ("none", 4, None), ("edge", 1, None), ("edge", 3, 1.0), ("edge", 9, None)]
    df = spark.createDataFrame(rows, "k string, year int, v double").repartition(5)
    assert _rows(interpolate_linear(df, ["k"], "year", "v", partitions=13)) == _rows(_by_window(df, ["k"], "year", "v"))
    assert interpolate_linear(df.limit(0), ["k"], "year", "v").collect() == []


def test_one_series_of_many_knots_runs_in_many_tasks(spark):
    df = spark.range(1_000_000).select(F.lit("hot").alias("k"), (2 * F.col("id")).cast("int").alias("year"),
                                       F.when(F.col("id") % 7 != 3, F.col("id") * 0.5).alias("v"))
    rows = dealt(df, [F.col("k"), F.col("year")], "test", 16)
    sizes = [r["count"] for r in rows.groupBy(RANGE).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 200_000
    out = interpolate_linear(df, ["k"], "year", "v", partitions=16)
    got = out.agg(F.count("*").alias("n"), F.count("v").alias("m"), F.max(F.abs(F.col("v") - F.col("year") * 0.25)).alias("e")).first()
    assert (got.n, got.m) == (1_999_999, 1_999_999) and got.e < 1e-9


def test_running_sums_do_not_depend_on_the_ranges(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "a", "b", None]), i, rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randrange(-6, 7)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(4)
    seen = {tuple(_rows(running_sum(df, ["k"], [F.col("i")], F.col("v"), "s", n))) for n in (1, 3, 11)}
    assert len(seen) == 1
    from fractions import Fraction

    total, want = {}, {}
    for k, i, v in rows:
        total[k] = total.get(k, Fraction(0)) + Fraction(v)
        want[i] = float(total[k])
    assert {r.i: r.s for r in running_sum(df, ["k"], [F.col("i")], F.col("v"), "s", 11).collect()} == want


def test_rank_without_a_single_partition(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, rng.randrange(50)) for i in range(500)], "i int, v int").repartition(6)
    got = {r.i: r.n for r in ranked(df, [F.col("v"), F.col("i")], "n", 9).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == [r.i for r in sorted(df.collect(), key=lambda r: (r.v, r.i))]
    assert sorted(got.values()) == list(range(1, 501))
    assert ranked(df.limit(0), [F.col("i")], "n").collect() == []
    many = spark.range(2000).select((F.col("id") % 500).cast("string").alias("c"), (F.col("id") * 0.37 % 11).alias("x"))
    many = many.unionByName(spark.createDataFrame([(None, 3.0), ("null mean", None)], "c string, x double"))
    out = order_by_stat(many, "c", "x")
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    stat = {}
    for r in many.collect():
        stat.setdefault(r.c, []).append(r.x)
    import math

    order = sorted(stat, key=lambda c: (stat[c][0] is None, -math.fsum(stat[c]) / len(stat[c]) if stat[c][0] is not None else 0, c is None, c or ""))
    assert {(r.c, r.order_rank) for r in out.collect()} == {(c, i + 1) for i, c in enumerate(order)}
