"""Energy investment result tables: preparation, annual interpolation, two sectors, scenario shifts.

Canonical input ``sheet``: Model, Region, Scenario, Variable and one text column per knot year.
``invest`` (two-sector table): model, region, scenario, variable, year, investment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenaria.functions.arith import INFLATION_2015_TO_2019
from scenaria.functions.nulls import strict_mean
from scenaria.functions.recode import recode
from scenaria.functions.text import strip_percent_number
from scenaria.operators.aggregate import attach_group_stat, envelope, two_stage
from scenaria.operators.filters import filter_in
from scenaria.operators.joins import join_right_distinct
from scenaria.operators.project import column_range, normalise_headers, q
from scenaria.operators.reshape import pivot_difference, pivot_wide, unpivot
from scenaria.operators.timeseries import interpolate_linear
from scenaria.functions.nulls import strict_max, strict_min
from scenaria.operators.window import attach_net

from scenaria.constants import (ANCHOR_MODEL, BASELINE, FOSSIL, LOW_CARBON, SECTORS, TARGET,  # noqa: F401
                                TECHNOLOGIES)
from scenaria.constants import MODEL_REGION_RECODE as REGION_RECODE

KEYS = ("region", "variable", "scenario")


def investment_prep(sheet: DataFrame, first_year: str = "2020", last_year: str = "2025",
                    region_recode: dict | None = None, technologies: Sequence[str] = TECHNOLOGIES,
                    scenario_recode: dict | None = None) -> DataFrame:
    """Lower-case headers, recode regions, keep the year span and listed technologies, long by year,
    year as int, ``%`` removed from values, bad text null."""
    region_recode = REGION_RECODE if region_recode is None else region_recode
    df = normalise_headers(sheet)
    df = df.withColumn("region", recode("region", region_recode))
    if scenario_recode:
        df = df.withColumn("scenario", recode("scenario", scenario_recode))
    years = column_range(df, first_year, last_year)
    df = df.select("model", "region", "scenario", "variable", *[q(y) for y in years])
    df = filter_in(df, "variable", list(technologies))
    long = unpivot(df, ["model", "region", "scenario", "variable"], years, "year", "investment")
    return long.select(
        "model", "region", "scenario", "variable",
        F.col("year").try_cast("int").alias("year"),
        strip_percent_number("investment").alias("investment"),
    )


def investment_annual(prep: DataFrame) -> DataFrame:
    """Every series interpolated to each year; regions without any series survive as null rows."""
    interp = interpolate_linear(prep, ["scenario", "model", "region", "variable"], "year", "investment")
    return join_right_distinct(interp, prep, ["region"]).select(
        "scenario", "model", "region", "variable", "year", "investment")


def investment_two_sector(annual: DataFrame, fossil: Sequence[str] = FOSSIL, low_carbon: Sequence[str] = LOW_CARBON,
                          sectors: Sequence[str] = SECTORS, factor: float = INFLATION_2015_TO_2019) -> DataFrame:
    """Sector sums per (model, region, scenario, year), a missing or null technology makes the sum null,
    then the inflation factor. Sums run in the listed order, so results are reproducible bit for bit."""
    techs = list(dict.fromkeys(list(fossil) + list(low_carbon)))
    wide = pivot_wide(annual, ["model", "region", "scenario", "year"], "variable", "investment", techs)

    def ordered_sum(names):
        expr = None
        for n in names:
            expr = q(n) if expr is None else expr + q(n)
        return expr

    sec = wide.select("model", "region", "scenario", "year",
                      ordered_sum(fossil).alias(sectors[0]), ordered_sum(low_carbon).alias(sectors[1]))
    long = unpivot(sec, ["model", "region", "scenario", "year"], list(sectors), "variable", "investment")
    return long.withColumn("investment", F.col("investment") * F.lit(factor)).select(
        "model", "region", "scenario", "variable", "year", "investment")


def _period(invest: DataFrame, first: int, last: int) -> DataFrame:
    return invest.filter(F.col("year").between(first, last))


def shift_table(invest: DataFrame, first: int = 2020, last: int = 2024, rep_year: int = 2020,
                period_stat: str = "mean", anchor: str = ANCHOR_MODEL, target: str = TARGET,
                baseline: str = BASELINE) -> DataFrame:
    """Period mean (or sum) of the model mean, ``target - baseline`` and the net per region."""
    stat = two_stage(_period(invest, first, last), list(KEYS), "year", "model", "investment", anchor, rep_year,
                     "mean", period_stat, "value")
    diff = pivot_difference(stat, ["region", "variable"], "scenario", "value", target, baseline, "shift")
    diff = diff.withColumn("year", F.lit(rep_year))
    out = attach_net(diff, "region", "shift", "net")
    return out.select("region", "variable", "year", q(target), q(baseline), "shift", "net")


def investment_envelope(invest: DataFrame, first: int = 2020, last: int = 2024, rep_year: int = 2020,
                        anchor: str = ANCHOR_MODEL, scenarios: Sequence[str] = (TARGET, BASELINE)) -> DataFrame:
    sub = filter_in(_period(invest, first, last), "scenario", list(scenarios))
    env = envelope(sub, list(KEYS), "year", "model", "investment", anchor, rep_year)
    return env.select("scenario", "region", "variable", "annual", "annual_max", "annual_min")


def investment_total(invest: DataFrame, first: int = 2020, last: int = 2024, rep_year: int = 2020,
                     anchor: str = ANCHOR_MODEL, scenarios: Sequence[str] = (TARGET, BASELINE)) -> DataFrame:
    sub = filter_in(_period(invest, first, last), "scenario", list(scenarios))
    tot = two_stage(sub, list(KEYS), "year", "model", "investment", anchor, rep_year, "mean", "sum", "total")
    return tot.select("scenario", "region", "variable", "total")


def energy_average(invest: DataFrame, first: int = 2020, last: int = 2025, rep_year: int = 2020,
                   anchor: str = ANCHOR_MODEL, scenarios: Sequence[str] = (TARGET, BASELINE)) -> DataFrame:
    """Average yearly investment (model mean, then year mean) over the whole span, target scenarios."""
    avg = two_stage(_period(invest, first, last), list(KEYS), "year", "model", "investment", anchor, rep_year,
                    "mean", "mean", "avg_invest")
    return filter_in(avg, "scenario", list(scenarios))


def model_spread_shift(invest: DataFrame, rep_year: int = 2020, target: str = TARGET,
                       baseline: str = BASELINE) -> DataFrame:
    """Per model: mean over years by scenario, ``target - baseline``; then mean/max/min across models."""
    per_model = invest.groupBy("region", "variable", "model", "scenario").agg(
        strict_mean("investment").alias("annual_avg"),
        F.max(F.when(F.col("year") == F.lit(rep_year), 1).otherwise(0)).alias("_has_rep"),
    ).filter(F.col("_has_rep") == 1).drop("_has_rep")
    wide = pivot_difference(per_model, ["region", "variable", "model"], "scenario", "annual_avg", target, baseline)
    wide = wide.withColumn("year", F.lit(rep_year))
    out = attach_group_stat(wide, ["region", "variable"], {
        "mean_shift": strict_mean("shift"), "max_shift": strict_max("shift"), "min_shift": strict_min("shift")})
    return out.select("model", "region", "variable", "year", q(target), q(baseline), "shift",
                      "mean_shift", "max_shift", "min_shift")
