"""Bindings: every row counts, replaced inputs are read anew, scratch needs a shared folder."""

import shutil
import types

import pytest
from pyspark.sql import functions as F

from scenaria import session
from scenaria.plans import bindings as B
from scenaria.sources.files import read_csv_na_tokens, read_csv_skip_preamble

SF = "/root/testdata/sf0.001"


def cents_of(df, column):
    return df.agg(F.sum(B.cents(column))).first()[0]


def test_all_money_of_the_facts_is_in_the_results(spark):
    orders, lines = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("orders", "lineitem"))
    july = B.july_wide(spark, SF)
    parts = ["individuals_households", "health", "business", "deferrals", "loans_guarantees", "uncategorized_other"]
    assert july.agg(sum(F.sum(p) for p in parts)).first()[0] == cents_of(orders, "o_totalprice")
    stim = B.stim_wide(spark, SF).agg(F.sum("total") + F.sum("international_aid")).first()[0]
    assert stim == cents_of(orders, "o_totalprice")
    sheet = B.invest_sheet(spark, SF)
    knots = [F.sum(F.regexp_replace(F.when(F.col(y) != "#VALUE!", F.col(y)), "%", "").cast("bigint")) for y in ("1995", "2000")]
    bad = B.invest_cells(spark, SF).where("model = 'PROMO' and region = 'R5ASIA' and scenario = 'F' and variable = 'A' and year >= 2000")
    assert sum(sheet.agg(*knots).first()) + (bad.agg(F.sum("cents")).first()[0] or 0) == cents_of(lines, "l_extendedprice")
    gdp = B.gdp_wide(spark, SF).where("country_code <> 'WLD'").agg(sum(F.coalesce(F.sum(f"x{y}"), F.lit(0.0)) for y in B.YEARS)).first()[0]
    assert gdp == cents_of(lines, "l_extendedprice")


def test_a_ship_year_without_a_column_stops_the_job(spark, tmp_path):
    for t in ("nation", "region", "supplier"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.read.parquet(f"{SF}/lineitem.parquet").limit(50).withColumn("l_shipdate", F.lit("2031-01-01").cast("date")).write.parquet(str(tmp_path / "lineitem.parquet"))
    with pytest.raises(Exception, match="no column for ship year"):
        B.gdp_wide(spark, str(tmp_path)).collect()


def test_replaced_inputs_are_read_anew(spark, tmp_path):
    for t in ("nation", "region", "customer", "orders"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    total = lambda: B.stim_wide(spark, str(tmp_path)).agg(F.sum("total")).first()[0]
    before = total()
    (tmp_path / "orders.parquet").unlink()
    spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey % 2 = 0").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    assert 0 < total() < before


def test_columns_are_bound_by_the_header(spark, tmp_path):
    (tmp_path / "x.csv").write_text("total,code\n5,AAA\nNA,BBB\n")
    got = read_csv_na_tokens(spark, str(tmp_path / "x.csv"), ["code", "total"], ["total"])
    assert sorted(map(tuple, got.collect())) == [("AAA", 5.0), ("BBB", None)]
    with pytest.raises(ValueError, match="no column"):
        read_csv_na_tokens(spark, str(tmp_path / "x.csv"), ["code", "sum"])


def test_lines_that_are_no_data_can_be_seen(spark, tmp_path):
    (tmp_path / "y.csv").write_text("Source,x\n\nname,code,x\nA,AAA,1\nB,bad,2\n")
    read = lambda rejects: read_csv_skip_preamble(spark, str(tmp_path / "y.csv"), ["name", "code", "x"], "code", rejects=rejects).collect()
    assert [r.code for r in read(False)] == ["AAA"]
    assert "bad" in [r.code for r in read(True)] and len(read(True)) == 3


def test_scratch_needs_a_shared_folder_on_a_cluster():
    off = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None),
                                sparkContext=types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(off)


def test_first_row_of_the_sheet_wins(spark):
    from scenaria.plans import gdp as G
    from scenaria.plans import shares as SH
    from scenaria.plans import stimulus as S

    sheet = spark.createDataFrame([("European Union", "OECD+", 0), ("Another Union", "ASIA", 1), ("Land", "ASIA", 2)],
                                  "country string, region string, sheet_order long")
    xwalk = spark.createDataFrame([("Land", "LND")], "country_name string, iso3 string")
    dim = S.region_dimension(sheet, xwalk, {}, ())
    wide = spark.createDataFrame([("EU", 1.0, 1.0, 1.0, 1.0, 0.0, 5.0)],
                                 "country_code string, health double, non_health double, loans_guarantees double, deferrals double, "
                                 "international_aid double, total double")
    assert {r.region for r in S.stimulus_components(wide, dim, ["country_code"]).collect()} == {"OECD+"}
    gdp = spark.createDataFrame([("EU", 7.0)], "country_code string, x2019 double")
    assert {r.region: r.gdp for r in G.gdp_by_region(gdp, dim, 2019, "none").collect()} == {"OECD+": 7.0, "World": 7.0}
    twice = sheet.unionByName(spark.createDataFrame([("  LAND", "ASIA", -1)], sheet.schema))
    assert {r.country for r in SH.map_region_dimension(twice, xwalk).where("country_code = 'LND'").collect()} == {"  LAND"}
