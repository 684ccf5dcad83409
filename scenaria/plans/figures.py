"""Chart-ready tables behind the figures (drawing is out of scope): filtered rows in chart units, the
fill level rank, and the stacked-bar offsets (``ymin`` / ``ymax``) of each segment.

All inputs are result-sized tables (regions x categories), so the stacking windows are bar-sized.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenaria.constants import FIG_ECONOMIES
from scenaria.operators.aggregate import spread_summary
from scenaria.operators.order import as_levels, order_by_stat
from scenaria.operators.project import q
from scenaria.operators.reshape import unpivot
from scenaria.operators.window import stack_offsets
from scenaria.plans.investment import BASELINE, SECTORS, TARGET
from scenaria.plans.shares import CATEGORY_LEVELS
from scenaria.plans.stimulus import BIG_ECONOMIES, CATEGORIES, IAM_REGIONS


def fig_stimulus_regions(by_region: DataFrame, regions: Sequence[str] = IAM_REGIONS, unit: float = 1e9) -> DataFrame:
    rows = by_region.filter(F.col("region").isin(list(regions))).select(
        "region", "component", (F.col("stimulus") / F.lit(unit)).alias("value"))
    return stack_offsets(as_levels(rows, "component", list(CATEGORIES), "level_rank"), ["region"], "level_rank", "value")


def fig_stimulus_economies(big: DataFrame, economies: Sequence[str] = BIG_ECONOMIES, unit: float = 1e9) -> DataFrame:
    rows = big.filter(F.col("country_code").isin(list(economies))).select(
        "country_code", "component", (F.col("stimulus") / F.lit(unit)).alias("value"))
    return stack_offsets(as_levels(rows, "component", list(CATEGORIES), "level_rank"), ["country_code"], "level_rank",
                         "value")


def fig_investment(shift: DataFrame, regions: Sequence[str], sectors: Sequence[str] = SECTORS,
                   scenarios: Sequence[str] = (BASELINE, TARGET)) -> DataFrame:
    """Both scenario panels: per (scenario, region) the sectors stacked."""
    rows = shift.filter(F.col("region").isin(list(regions)) & F.col("variable").isin(list(sectors)))
    long = unpivot(rows.select("region", "variable", *[q(s) for s in scenarios]), ["region", "variable"],
                   list(scenarios), "scenario", "value")
    return stack_offsets(as_levels(long, "variable", list(sectors), "level_rank"), ["scenario", "region"],
                         "level_rank", "value")


def fig_shift(shift: DataFrame, regions: Sequence[str], sectors: Sequence[str] = SECTORS) -> DataFrame:
    """Shift per sector stacked (negative parts below zero) with the net marker per region."""
    rows = shift.filter(F.col("region").isin(list(regions)) & F.col("variable").isin(list(sectors))).select(
        "region", "variable", F.col("shift").alias("value"), "net")
    return stack_offsets(as_levels(rows, "variable", list(sectors), "level_rank"), ["region"], "level_rank", "value")


def _share_rows(gdp_shares: DataFrame, regions: Sequence[str], measure: str, unit: float = 1.0,
                scenario: str = TARGET) -> DataFrame:
    rows = gdp_shares.filter(F.col("region").isin(list(regions)) & (F.col("scenario") == F.lit(scenario))
                             & F.col("variable").isNotNull())
    value = F.col(measure) / F.lit(unit) if unit != 1.0 else F.col(measure)
    rows = rows.select("region", "invest_type", "variable", value.alias("value"))
    return as_levels(rows, "variable", list(CATEGORY_LEVELS), "level_rank")


def fig_gdp_shares_economies(gdp_shares: DataFrame, economies: Sequence[str] = FIG_ECONOMIES) -> DataFrame:
    """Per economy facet, bars by investment type ordered by mean(-pct of GDP), fill by category."""
    rows = _share_rows(gdp_shares, economies, "pct_gdp")
    rows = order_by_stat(rows, "invest_type", "value", "type_rank")
    return stack_offsets(rows, ["region", "invest_type"], "level_rank", "value")


def fig_gdp_shares_panels(gdp_shares: DataFrame, regions: Sequence[str]) -> DataFrame:
    return stack_offsets(_share_rows(gdp_shares, regions, "pct_gdp"), ["region", "invest_type"], "level_rank", "value")


def fig_usd_panels(gdp_shares: DataFrame, regions: Sequence[str], unit: float = 1e9) -> DataFrame:
    """``avg_invest / 1e9`` per panel (the source divides billions by 1e9 again; kept as a parameter)."""
    rows = _share_rows(gdp_shares, regions, "avg_invest", unit)
    return stack_offsets(rows, ["region", "invest_type"], "level_rank", "value")


def fig_model_spread(model_spread: DataFrame, regions: Sequence[str]) -> DataFrame:
    """Mean bar and min-max range of the per-model shift, per region and sector."""
    rows = model_spread.filter(F.col("region").isin(list(regions)))
    return spread_summary(rows, ["region", "variable"], "shift").drop("summary").withColumn("bar", F.col("y"))
