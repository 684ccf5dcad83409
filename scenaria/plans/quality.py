"""Data-quality reports for the inputs of the result tables (each a small grouped job)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenaria.operators.aggregate import anchor_flag


def stimulus_above_gdp(wide: DataFrame, total: str = "total", gdp: str = "gdp") -> DataFrame:
    """Countries whose total stimulus exceeds their GDP, with the ratio."""
    return wide.filter(F.col(total) > F.col(gdp)).select(
        "country_code", total, gdp, F.try_divide(F.col(total), F.col(gdp)).alias("ratio"))


def unmatched_codes(fact: DataFrame, dim: DataFrame, key: str = "country_code") -> DataFrame:
    """Distinct fact keys with no row in the dimension."""
    return fact.select(key).distinct().join(dim.select(key).distinct(), key, "left_anti")


def groups_without_anchor(df: DataFrame, keys: Sequence[str], member: str, anchor) -> DataFrame:
    """Groups that the anchor-member filter would drop."""
    return df.groupBy(*keys).agg(anchor_flag(member, anchor).alias("_a")).filter(F.col("_a") == 0).drop("_a")


def short_series(df: DataFrame, keys: Sequence[str], value: str, min_knots: int = 2) -> DataFrame:
    """Series with fewer than ``min_knots`` non-null knots (not interpolable)."""
    return df.groupBy(*keys).agg(F.count(value).alias("knots")).filter(F.col("knots") < min_knots)
