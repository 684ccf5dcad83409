"""Order-independent sums against exact rational arithmetic."""

import math
import random

import pytest
from pyspark.sql import functions as F

from scenaria.functions.exact import exact_mean, exact_sum
from scenaria.functions.nulls import skipna_sum, strict_mean, strict_sum


def _groups():
    rng = random.Random(4)
    out = {
        "cancel": [1e300 * 0 + 1e30, 1.0, -1e30, 1e-30, -1.0],
        "cents": [rng.randrange(10**14) / 100 for _ in range(300)],
        "wide": [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randrange(-40, 37) for _ in range(300)],
        "minus": [-0.1] * 10, "zero": [0.0, -0.0], "one": [1 / 3], "half": [1.0, 2.0**-53], "half_up": [1.0, 2.0**-53, 2.0**-200],
        "odd_half": [1.0 + 2.0**-52, 2.0**-53], "to_zero": [0.1, 0.2, -0.1, -0.2], "largest": [2.0**127, 2.0**127 - 2.0**75, -1.0],
    }
    for i in range(40):
        out[f"r{i}"] = [rng.gauss(0, 10.0 ** rng.randrange(-5, 12)) for _ in range(rng.randrange(1, 30))]
    return out


def test_sum_is_the_exact_sum_rounded_once(spark):
    groups = _groups()
    rows = [(k, x) for k, v in groups.items() for x in v] + [("cents", None), ("none", None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, x double").repartition(7)
    got = {r.k: r for r in df.groupBy("k").agg(exact_sum("x").alias("s"), exact_mean("x").alias("m")).collect()}
    for k, v in groups.items():
        assert got[k].s == math.fsum(v), k
        assert got[k].m == math.fsum(v) / len(v)
    assert got["none"].s is None and got["none"].m is None


def test_partitions_and_order_do_not_matter(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), rng.random() * 10.0 ** rng.randrange(-8, 9) * rng.choice([-1, 1])) for _ in range(4000)]
    seen, plain = set(), set()
    for n in (1, 3, 8):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "k int, x double").repartition(n)
        out = df.groupBy("k").agg(strict_sum("x").alias("s"), strict_mean("x").alias("m"), skipna_sum("x").alias("z"), F.sum("x").alias("p")).orderBy("k").collect()
        seen.add(tuple((r.s.hex(), r.m.hex(), r.z.hex()) for r in out))
        plain.add(tuple(r.p.hex() for r in out))
    assert len(seen) == 1
    assert len(plain) > 1  # what a plain sum does with the same rows


def test_in_grouping_sets(spark):
    rows = [("a", "u", 0.1), ("a", "v", 0.2), ("b", "u", 0.3), ("b", "v", 1e17), ("b", "v", -1e17)]
    df = spark.createDataFrame(rows, "k string, j string, x double")
    got = {(r.k, r.j): r.s for r in df.groupingSets([["k", "j"], ["j"], []], "k", "j").agg(exact_sum("x").alias("s")).collect()}
    assert got[None, None] == math.fsum(x for _, _, x in rows) and got[None, "v"] == 0.2 and got["b", "v"] == 0.0


def test_endless_and_too_large_values(spark):
    df = spark.createDataFrame([("i", float("inf")), ("i", 1.0), ("n", float("nan")), ("n", 1.0)], "k string, x double")
    got = {r.k: r.s for r in df.groupBy("k").agg(exact_sum("x").alias("s")).collect()}
    assert got["i"] == float("inf") and math.isnan(got["n"])
    with pytest.raises(Exception, match="beyond 2"):
        spark.createDataFrame([(1e300,)], "x double").agg(exact_sum("x")).collect()
    assert spark.createDataFrame([], "x double").agg(exact_sum("x").alias("s")).first().s is None
