"""Reshape, first-per-key, joins, grouping sets, interpolation, stacking: semantics on tiny frames."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scenaria.functions.nulls import strict_sum
from scenaria.operators import (attach_global_stat, attach_group_stat, as_levels, column_range, densify,
                                filter_first_and_pred, first_per_key, grouping_sets_total, interpolate_linear,
                                join_left_dim, pivot_difference, pivot_wide, stack_offsets, two_stage, unpivot)
from scenaria.sources.files import with_row_index


def test_first_per_key_order_and_null_key(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), (None, 5, "n1"), (None, 3, "n0"), ("b", 1, "x")],
                               "k string, o int, v string")
    got = {r.k: r.v for r in first_per_key(df, ["k"], ["o"]).collect()}
    assert got == {"a": "early", None: "n0", "b": "x"}


def test_first_and_pred_judged_on_input(spark):
    # the first row of key a has region EU: the key is dropped, not replaced by its second row
    df = spark.createDataFrame([("a", 1, "EU"), ("a", 2, "X"), ("b", 1, None), ("c", 1, "Y")],
                               "k string, o int, region string")
    got = filter_first_and_pred(df, ["k"], ["o"], ~(F.col("region") == "EU")).collect()
    assert {(r.k, r.region) for r in got} == {("c", "Y")}


def test_pivot_absent_and_duplicate(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0)], "id string, k string, v double")
    got = {r.id: (r.x, r.y) for r in pivot_wide(df, ["id"], "k", "v", ["x", "y"]).collect()}
    assert got == {"a": (1.0, 2.0), "b": (3.0, None)}
    dup = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0)], "id string, k string, v double")
    with pytest.raises(Exception, match="duplicate cell"):
        pivot_wide(dup, ["id"], "k", "v", ["x"]).collect()


def test_densify_round_trip(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0)], "id string, k string, v double")
    got = {(r.id, r.k): r.v for r in densify(df, ["id"], "k", "v").collect()}
    assert got == {("a", "x"): 1.0, ("a", "y"): 2.0, ("b", "x"): 3.0, ("b", "y"): None}


def test_densify_has_no_bound_and_takes_null_keys(spark):
    df = spark.range(200_000).select(F.lit("a").alias("id"), F.col("id").cast("string").alias("k"), F.lit(1.0).alias("v"))
    df = df.unionByName(spark.createDataFrame([("b", None, 7.0), (None, "0", 3.0)], "id string, k string, v double"))
    out = densify(df, ["id"], "k", "v")
    assert out.count() == 3 * 200_001 and out.where("v is not null").count() == 200_002
    assert out.where("id = 'b' and k is null").first().v == 7.0
    assert out.where("id is null and k = '0'").first().v == 3.0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.sampled_from(["x", "y", "z"]),
                          st.integers(-1000, 1000)), min_size=1, max_size=12, unique_by=lambda t: (t[0], t[1])))
def test_unpivot_pivot_identity(spark, rows):
    df = spark.createDataFrame([(a, b, float(c)) for a, b, c in rows], "id string, k string, v double")
    wide = pivot_wide(df, ["id"], "k", "v", ["x", "y", "z"])
    back = unpivot(wide, ["id"], ["x", "y", "z"], "k", "v").filter(F.col("v").isNotNull())
    assert sorted(map(tuple, back.collect())) == sorted((a, b, float(c)) for a, b, c in rows)


def test_grouping_sets_world_keeps_null_region_in_total_only(spark):
    df = spark.createDataFrame([("A", "c", 1.0), ("B", "c", 2.0), (None, "c", 4.0), ("A", "d", None)],
                               "region string, comp string, x double")
    got = {(r.region, r.comp): r.value for r in grouping_sets_total(df, "region", "comp", "x").collect()}
    assert got == {("A", "c"): 1.0, ("B", "c"): 2.0, ("World", "c"): 7.0, ("A", "d"): 0.0, ("World", "d"): None}


def test_attach_group_and_global(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 4.0)], "k string, x double")
    g = {(r.k, r.x): r.s for r in attach_group_stat(df, ["k"], {"s": strict_sum("x")}).collect()}
    assert g == {("a", 1.0): 3.0, ("a", 2.0): 3.0, (None, 4.0): 4.0}
    t = {r.t for r in attach_global_stat(df, {"t": strict_sum("x")}).collect()}
    assert t == {7.0}


def test_left_join_fanout_and_null_safe(spark):
    f = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    d = spark.createDataFrame([("a", "r1"), ("a", "r2"), (None, "rn")], "k string, r string")
    assert len(join_left_dim(f, d, "k").collect()) == 3  # fan-out, null key unmatched
    got = {(r.k, r.r) for r in join_left_dim(f, d, "k", null_safe=True).collect()}
    assert got == {("a", "r1"), ("a", "r2"), (None, "rn")}


def test_interpolation_semantics(spark):
    rows = [("s1", 2020, 10.0), ("s1", 2025, 20.0),            # plain
            ("s2", 2020, 10.0), ("s2", 2022, None), ("s2", 2025, 40.0),  # null knot ignored
            ("s3", 2020, None), ("s3", 2022, 5.0), ("s3", 2024, 7.0),    # null edge: no extrapolation
            ("s4", 2020, 1.0), ("s4", 2020, 3.0), ("s4", 2022, 6.0),     # tied knots averaged
            ("s5", 2020, 1.0), ("s5", 2023, None)]                       # one knot: no interpolation
    df = spark.createDataFrame(rows, "s string, year int, v double")
    got = {(r.s, r.year): r.v for r in interpolate_linear(df, ["s"], "year", "v").collect()}
    assert [got[("s1", y)] for y in range(2020, 2026)] == [10.0, 12.0, 14.0, 16.0, 18.0, 20.0]
    assert [got[("s2", y)] for y in range(2020, 2026)] == [10.0, 16.0, 22.0, 28.0, 34.0, 40.0]
    assert [got[("s3", y)] for y in range(2020, 2025)] == [None, None, 5.0, 6.0, 7.0]
    assert [got[("s4", y)] for y in range(2020, 2023)] == [2.0, 4.0, 6.0]
    assert [got[("s5", y)] for y in range(2020, 2024)] == [None] * 4


def test_two_stage_anchor_and_rep_year(spark):
    rows = [("g1", 2020, "M", 1.0), ("g1", 2020, "X", 3.0), ("g1", 2021, "M", 5.0), ("g1", 2021, "X", 7.0),
            ("g2", 2020, "X", 1.0),                       # lacks the anchor model: vanishes
            ("g3", 2021, "M", 2.0),                       # lacks the representative year: vanishes
            ("g4", 2020, "M", None), ("g4", 2020, "X", 1.0)]  # strict mean is null
    df = spark.createDataFrame(rows, "g string, year int, model string, v double")
    got = {r.g: r.value for r in two_stage(df, ["g"], "year", "model", "v", "M", 2020).collect()}
    assert got == {"g1": 4.0, "g4": None}
    got = {r.g: r.value for r in two_stage(df, ["g"], "year", "model", "v", "M", 2020, "mean", "sum").collect()}
    assert got == {"g1": 8.0, "g4": None}


def test_pivot_difference(spark):
    df = spark.createDataFrame([("r", "1.5C", 5.0), ("r", "CPol", 3.0), ("q", "CPol", 1.0)],
                               "region string, scenario string, v double")
    got = {r.region: r.shift for r in pivot_difference(df, ["region"], "scenario", "v", "1.5C", "CPol").collect()}
    assert got == {"r": 2.0, "q": None}


def test_levels_unknown_to_null(spark):
    df = spark.createDataFrame([("b",), ("z",)], "c string")
    got = {(r.c, r.rank) for r in as_levels(df, "c", ["a", "b"], "rank").collect()}
    assert got == {(None, None), ("b", 2)}


def test_stack_offsets_signs(spark):
    df = spark.createDataFrame([("bar", "a", 1, 2.0), ("bar", "b", 2, 3.0), ("bar", "c", 3, -1.0)],
                               "bar string, lvl string, rank int, v double")
    got = {r.lvl: (r.ymin, r.ymax) for r in stack_offsets(df, ["bar"], "rank", "v").collect()}
    assert got == {"b": (0.0, 3.0), "a": (3.0, 5.0), "c": (-1.0, 0.0)}


def test_row_index_consecutive(spark):
    df = spark.range(0, 200).select(((F.col("id") * 7919) % 200).alias("k"))
    idx = with_row_index(df, ["k"], partitions=5).orderBy("row_index").collect()
    assert [r.row_index for r in idx] == list(range(1, 201))
    assert [r.k for r in idx] == list(range(200))


def test_column_range(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    assert column_range(df, "b", "d") == ["b", "c", "d"]


def test_pivot_finds_its_values(spark):
    df = spark.createDataFrame([(1, "b", 1.0), (1, "B", 2.0), (1, "a", 3.0), (2, None, 4.0), (2, "C", 5.0)], "id int, k string, v double")
    wide = pivot_wide(df, ["id"], "k", "v")
    assert wide.columns == ["id", "a", "b", "B", "C", "<NA>"]
    assert {tuple(r) for r in wide.collect()} == {(1, 3.0, 1.0, 2.0, None, None), (2, None, None, None, 5.0, 4.0)}
    listed = pivot_wide(df.where("k is not null"), ["id"], "k", "v", ["a", "b", "B", "C"])
    assert {tuple(r) for r in pivot_wide(df.where("k is not null"), ["id"], "k", "v").collect()} == {tuple(r) for r in listed.collect()}
    years = spark.createDataFrame([(1, 2020, 1.0), (1, 200, 2.0), (1, 30, 3.0)], "id int, k int, v double")
    assert pivot_wide(years, ["id"], "k", "v").columns == ["id", "30", "200", "2020"]
    assert pivot_wide(df.limit(0), ["id"], "k", "v").collect() == []
    with pytest.raises(ValueError, match="more than 2 values"):
        pivot_wide(df, ["id"], "k", "v", most=2)
