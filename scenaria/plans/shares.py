"""Stimulus and investment relative to GDP; the Figure-1 table; regional map table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenaria.functions.arith import pct_of
from scenaria.functions.nulls import skipna_sum, strict_sum
from scenaria.operators.filters import first_per_key
from scenaria.operators.joins import cross_small, join_fanout, xwalk_name_to_code
from scenaria.operators.order import as_levels
from scenaria.operators.setops import union_by_name
from scenaria.operators.window import attach_two_grains
from scenaria.plans.investment import BASELINE, TARGET
from scenaria.plans.stimulus import CATEGORIES

from scenaria.constants import CATEGORY_LEVELS, INVEST_TYPES  # noqa: F401


def scenario_table(spark_df: DataFrame, scenarios: Sequence[str] = (TARGET, BASELINE)) -> DataFrame:
    spark = spark_df.sparkSession
    return spark.createDataFrame([(s,) for s in scenarios], "scenario string")


def stimulus_gdp_table(s1: DataFrame, xwalk: DataFrame, gdp_country: DataFrame, factor: float = 10e10) -> DataFrame:
    """Per country total of the three categories, code from the name, GDP, ``total / gdp * factor``."""
    t = s1.withColumn("total", F.col("general_spending") + F.col("health_sector_spending") + F.col("liquidity_support"))
    t = xwalk_name_to_code(t.drop("country_code") if "country_code" in t.columns else t, "country", xwalk, "country_code")
    j = t.join(gdp_country, "country_code", "left")
    return j.withColumn("gdp_share", F.try_divide(F.col("total"), F.col("gdp")) * F.lit(factor))


def stimulus_gdp_share(long: DataFrame, gdp_country: DataFrame) -> DataFrame:
    """One row per country: strict total stimulus, GDP and percent of GDP."""
    tot = long.groupBy("country_code").agg(strict_sum("stimulus").alias("total_stim"),
                                           F.min(F.struct("component", "region"))["region"].alias("region"))
    j = tot.join(gdp_country, "country_code", "left")
    return j.withColumn("pct_gdp", pct_of("total_stim", "gdp")).select(
        "country_code", "region", "total_stim", "gdp", "pct_gdp")


def stimulus_prep(master: DataFrame, gdp_master: DataFrame, scenarios: DataFrame, unit: float = 1e9) -> DataFrame:
    j = master.join(gdp_master, "region", "left")
    out = j.select(
        "region", F.col("component").alias("variable"),
        (F.col("stimulus") / F.lit(unit)).alias("avg_invest"), "gdp",
        pct_of("stimulus", "gdp").alias("pct_gdp"), F.lit("Stimulus").alias("invest_type"),
    )
    return cross_small(out, scenarios)


def shift_prep(shift: DataFrame, gdp_master: DataFrame, scenarios: DataFrame, label: str = "Investment shift",
               unit: float = 1e9) -> DataFrame:
    j = shift.select("region", "variable", F.col("shift").alias("avg_invest")).join(gdp_master, "region", "left")
    out = j.select("region", "variable", "avg_invest", "gdp",
                   pct_of(F.col("avg_invest") * F.lit(unit), "gdp").alias("pct_gdp"), F.lit(label).alias("invest_type"))
    return cross_small(out, scenarios)


def gdp_shares(energy_avg: DataFrame, gdp_master: DataFrame, stim_prep: DataFrame, shift_p: DataFrame,
               shift_p5: DataFrame, keep_scenario: str = TARGET, levels: Sequence[str] = CATEGORY_LEVELS,
               energy_unit: float = 1.0) -> DataFrame:
    """Figure-1 table. By default energy rows divide billions by GDP in units, as the source does
    (percentages 1e9 too small); ``energy_unit=1e9`` gives the corrected percentage."""
    energy = energy_avg.join(gdp_master, "region", "left").select(
        "scenario", "region", "variable", "avg_invest", "gdp",
        pct_of("avg_invest", "gdp", energy_unit).alias("pct_gdp"), F.lit("Energy investment").alias("invest_type"))
    allrows = union_by_name(energy, stim_prep, shift_p, shift_p5)
    allrows = as_levels(allrows, "variable", list(levels), "variable_rank")
    return allrows.filter(F.col("scenario") == F.lit(keep_scenario)).select(
        "scenario", "region", "variable", "avg_invest", "gdp", "pct_gdp", "invest_type", "variable_rank")


def map_region_dimension(sheet: DataFrame, xwalk: DataFrame, bloc_name: str = "European Union",
                         bloc_code: str = "EU") -> DataFrame:
    """Distinct (code, map region); a country may belong to several regions."""
    d = xwalk_name_to_code(sheet, "country", xwalk, "country_code")
    d = d.withColumn("country_code", F.when(F.col("country") == F.lit(bloc_name), F.lit(bloc_code))
                     .otherwise(F.col("country_code")))
    return first_per_key(d, ["country_code", "region"], [c for c in ("sheet_order", "country") if c in d.columns])


def map_region_rows(long: DataFrame, map_dim: DataFrame, gdp_country: DataFrame) -> DataFrame:
    """Every country row in each region the country belongs to, with the country's GDP."""
    return join_fanout(long.drop("region"), map_dim, "country_code", "region").join(gdp_country, "country_code", "left")


def map_region_stats(rows: DataFrame) -> DataFrame:
    """``map_region_rows`` with regional stimulus per component, regional GDP, regional total and ratio. The rows are read once
    for the statistics and once to attach them: store them if they are dear."""
    j = attach_two_grains(rows, ["region"], "component", {"stim_reg": strict_sum("stimulus"), "gdp_reg": skipna_sum("gdp")},
                          "stimulus", "total_stim_reg")
    return j.withColumn("pct_gdp", F.try_divide(F.col("total_stim_reg"), F.col("gdp_reg")))


def map_region_stimulus(long: DataFrame, map_dim: DataFrame, gdp_country: DataFrame) -> DataFrame:
    """``map_region_stats`` of ``map_region_rows``."""
    return map_region_stats(map_region_rows(long, map_dim, gdp_country))


__all__ = ["CATEGORIES"]
