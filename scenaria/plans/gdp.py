"""GDP result tables from a wide World-Bank-style table (one column per year).

Canonical input ``gdp_wide``: country_name, country_code, [indicator columns], x1960 ... x2019 (doubles).
Only the year column that is used is selected before any reshaping, so the scan reads one year.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenaria.functions.nulls import skipna_sum
from scenaria.operators.filters import filter_first_and_pred, filter_in
from scenaria.operators.setops import union_by_name

from scenaria.constants import EU_GDP_2019
from scenaria.constants import SELECTED_ECONOMIES as SELECTED


def gdp_year(gdp_wide: DataFrame, year: int = 2019, prefix: str = "x") -> DataFrame:
    """(country_code, gdp) for one year: the column is picked first, then reshaped (one column read)."""
    return gdp_wide.select("country_code", F.col(f"{prefix}{year}").cast("double").alias("gdp"))


def gdp_long(gdp_wide: DataFrame, first: str, last: str, prefix: str = "x") -> DataFrame:
    """Every year column between ``first`` and ``last`` as (country_code, year, gdp)."""
    from scenaria.functions.text import label_to_year
    from scenaria.operators.reshape import unpivot_range

    long = unpivot_range(gdp_wide, ["country_code"], first, last, "year", "gdp", "double")
    return long.withColumn("year", label_to_year("year", prefix))


def _constant_row(spark_df: DataFrame, region: str, gdp: float) -> DataFrame:
    return spark_df.sparkSession.range(1).select(F.lit(region).alias("region"), F.lit(gdp).cast("double").alias("gdp"))


def gdp_selected(gdp_wide: DataFrame, year: int = 2019, codes: Sequence[str] = SELECTED,
                 bloc: str = "EU", bloc_gdp: float = EU_GDP_2019) -> DataFrame:
    """GDP of the selected codes plus the bloc constant (region, gdp)."""
    sel = filter_in(gdp_year(gdp_wide, year), "country_code", list(codes))
    sel = sel.select(F.col("country_code").alias("region"), "gdp")
    return union_by_name(_constant_row(gdp_wide, bloc, bloc_gdp), sel)


def gdp_by_region(gdp_wide: DataFrame, region_dim: DataFrame, year: int = 2019, exclude_region: str = "EU",
                  world: str = "World", order_by: Sequence[str] = ("country_code",)) -> DataFrame:
    """Skip-null GDP sum per region plus World (= sum of the regional sums). Codes whose first
    region is null or ``exclude_region`` (aggregates such as WLD) drop out."""
    sheet = [c for c in ("sheet_order",) if c in region_dim.columns]
    j = gdp_year(gdp_wide, year).join(region_dim.select("country_code", "region", *sheet), "country_code", "left")
    first = filter_first_and_pred(j, ["country_code"], list(order_by) + sheet + ["region"],
                                  ~(F.col("region") == F.lit(exclude_region)))
    per_region = first.groupBy("region").agg(skipna_sum("gdp").alias("gdp"))
    total = per_region.agg(skipna_sum("gdp").alias("gdp")).select(F.lit(world).alias("region"), "gdp")
    return union_by_name(per_region, total)


def gdp_master(by_region: DataFrame, selected: DataFrame) -> DataFrame:
    return union_by_name(by_region, selected)


def gdp_by_country(gdp_wide: DataFrame, year: int = 2019, bloc: str = "EU", bloc_gdp: float = EU_GDP_2019) -> DataFrame:
    """GDP of every code plus the bloc row (country_code, gdp)."""
    rows = gdp_year(gdp_wide, year)
    const = _constant_row(gdp_wide, bloc, bloc_gdp).withColumnRenamed("region", "country_code")
    return union_by_name(const, rows)
