"""Joins with heavy keys: the same rows as a plain join, and no task far above the others."""

import pytest
from pyspark.sql import functions as F

from scenaria.operators.skew import heavy_keys, is_small, join_skewed


@pytest.fixture
def plain(spark):
    """No broadcast, no adaptive changes: what is seen is the join's own partitioning."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def _fact(spark, n=60_000):
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 1, None).otherwise(F.col("id") % 5000)
    return spark.range(n).select(F.col("id"), key.cast("long").alias("k"))


def _sizes(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())


def test_a_key_with_a_third_of_the_rows_is_spread(plain):
    fact, dim = _fact(plain), plain.range(5000).select(F.col("id").alias("code"), (F.col("id") * 2).alias("v"))
    assert 7 in heavy_keys(fact, "k", 16) and len(heavy_keys(fact, "k", 16)) < 5
    for how in ("inner", "left"):
        out = join_skewed(fact, dim, "k", "code", how)
        sizes = _sizes(out.withColumn("p", F.spark_partition_id()))
        assert len(sizes) == 16 and max(sizes) <= 2 * sizes[8]
        want = fact.join(dim, fact.k == dim.code, how)
        assert out.columns == want.columns
        assert out.exceptAll(want).isEmpty() and want.exceptAll(out).isEmpty()
    plain_sizes = _sizes(fact.join(dim, fact.k == dim.code, "left"))
    assert max(plain_sizes) > 4 * plain_sizes[8]


def test_duplicate_and_missing_keys(plain):
    fact = plain.createDataFrame([(i, "hot" if i % 2 else f"k{i}") for i in range(400)] + [(900, None)], "id int, k string")
    dim = plain.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), (None, 4), ("other", 5)], "code string, v int")
    for how in ("inner", "left"):
        out, want = join_skewed(fact, dim, "k", "code", how, parts=8), fact.join(dim, F.col("k") == F.col("code"), how)
        assert sorted(map(repr, out.collect())) == sorted(map(repr, want.collect()))
    assert join_skewed(fact.limit(0), dim, "k", "code").collect() == []
    assert join_skewed(fact, dim.limit(0), "k", "code", "left").count() == 401
    with pytest.raises(ValueError):
        join_skewed(fact, dim, "k", "code", "full")


def test_a_small_table_is_left_to_the_planner(spark):
    dim = spark.range(5).select(F.col("id").alias("code"))
    assert is_small(dim)
    assert "_piece" not in join_skewed(_fact(spark, 10), dim, "k", "code")._jdf.queryExecution().optimizedPlan().toString()
