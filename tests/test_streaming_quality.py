"""Streaming roll-up equals the batch roll-up; quality reports find the planted cases."""

from pyspark.sql import functions as F

from scenaria.operators.aggregate import grouping_sets_total
from scenaria.plans import bindings as B
from scenaria.plans import quality as QY
from scenaria.session import scratch_path
from scenaria.streaming import finish, start
from tests.conftest import SF


def test_stream_matches_batch(spark):
    long = B.stim_long(spark, SF)
    src = scratch_path(spark, "stream-src")
    long.filter(F.col("component") != "Liquidity support").write.parquet(f"{src}/part=1")
    q = start(spark, src, long.schema, name="rollup_test")
    try:
        q.processAllAvailable()
        long.filter(F.col("component") == "Liquidity support").write.parquet(f"{src}/part=2")
        q.processAllAvailable()
        got = {(r.region, r.component): r.stimulus for r in finish(spark.table("rollup_test")).collect()}
    finally:
        q.stop()
    want = {(r.region, r.component): r.value for r in
            grouping_sets_total(long, "region", "component", "stimulus").collect()}
    assert got == want


def test_quality_reports(spark):
    prep = B.invest_prep(spark, SF)
    short = QY.short_series(prep, ["scenario", "model", "region", "variable"], "investment")
    assert {r.model for r in short.collect()} >= {"PROMO"}  # the planted bad knot
    unmatched = QY.unmatched_codes(B.stim_wide(spark, SF), B.region_dim(spark, SF))
    assert [r.country_code for r in unmatched.collect()] == ["N24"]  # the dropped nation
    inv = B.invest(spark, SF)
    assert QY.groups_without_anchor(inv, ["region", "variable", "scenario", "year"], "model", "ECONOMY").count() >= 0
