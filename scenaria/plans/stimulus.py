"""Stimulus result tables: components per country, income groups, economies, regions, checks.

Canonical inputs
----------------
``wide``        country_code, [gdp,] health, non_health, loans_guarantees, deferrals, international_aid,
                total, plus an order column (first occurrence wins on duplicated codes)
``region_dim``  country, country_code, region (may hold duplicated codes: they fan out)
``long``        country_code, region, component, stimulus (output of ``stimulus_components``)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenaria import constants as C
from scenaria.functions.nulls import skipna_sum, strict_sum
from scenaria.functions.recode import recode
from scenaria.functions.text import null_text, replace_first
from scenaria.operators.aggregate import attach_group_stat, grouping_sets_total, share_of_total
from scenaria.operators.filters import filter_in, first_per_key
from scenaria.operators.joins import rollup_bloc, xwalk_code_to_name, xwalk_name_to_code
from scenaria.operators.order import sort_asc
from scenaria.operators.reshape import densify, pivot_wide, unpivot
from scenaria.operators.setops import union_by_name

from scenaria.constants import (BIG_ECONOMIES, EU_MEMBERS, G20, GENERAL, HEALTH, IAM_REGIONS,  # noqa: F401
                                LIQUIDITY)

#: Column with a sheet's row order, for first-of-key rules; carried along by ``region_dimension``.
SHEET_ORDER = "sheet_order"
CATEGORIES = (GENERAL, HEALTH, LIQUIDITY)
CATEGORY_COLUMNS = {GENERAL: "general_spending", HEALTH: "health_sector_spending", LIQUIDITY: "liquidity_support"}
PARTS = ("health", "non_health", "loans_guarantees", "deferrals", "international_aid", "total")


def region_dimension(
    sheet: DataFrame, xwalk: DataFrame, region_recode: dict | None = None,
    drop_countries: Sequence[str] = C.DROPPED_COUNTRIES, unmatched_code: str = C.UNMATCHED_CODE,
    code_repair: dict | None = None, literal_first_match: bool = True,
) -> DataFrame:
    """Country name -> code, region names recoded, some countries dropped, unmatched names -> ``EU``.

    ``literal_first_match`` keeps the source's text edit (null -> "NA" -> first "NA" replaced), which also
    rewrites codes containing "NA" (NAM -> EUM, repaired by ``code_repair``; KNA -> KEU is not).
    """
    region_recode = dict(C.REGION_SHEET_RECODE) if region_recode is None else region_recode
    code_repair = dict(C.CODE_REPAIR) if code_repair is None else code_repair
    d = xwalk_name_to_code(sheet, "country", xwalk, "country_code")
    d = d.withColumn("region", recode("region", region_recode))
    for name in drop_countries:
        d = d.filter(~(F.col("country") == F.lit(name)))
    if literal_first_match:
        code = replace_first(null_text("country_code"), "NA", unmatched_code, literal=True)
        code = recode(code, code_repair)
    else:
        code = F.coalesce(F.col("country_code"), F.lit(unmatched_code))
    return d.withColumn("country_code", code)


def stimulus_components(wide: DataFrame, region_dim: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Country x {Health, General, Liquidity}; see the module notes for the residual rule.

    The first row of each code wins (by ``order_by``, then by the sheet's order if the dimension carries it in
    ``sheet_order``, else by value), empty parts count 0, ``total - parts`` is added to
    non-health spending, General = non-health + deferrals, Liquidity = loans and guarantees; international
    aid is not a part (but enters through the residual when the total includes it).
    """
    dim_cols = [c for c in region_dim.columns if c != "country_code"]
    base_cols = [c for c in wide.columns if c not in dim_cols]
    j = wide.select(*base_cols).join(region_dim, "country_code", "left")
    first = first_per_key(j, ["country_code"], list(order_by) + sorted(dim_cols, key=lambda c: c != SHEET_ORDER))
    z = {p: F.coalesce(F.col(p).cast("double"), F.lit(0.0)) for p in PARTS}
    total2 = z["deferrals"] + z["health"] + z["loans_guarantees"] + z["non_health"]
    non_health = z["non_health"] + (z["total"] - total2)
    cats = first.select(
        "country_code", "region",
        z["health"].alias(HEALTH),
        (non_health + z["deferrals"]).alias(GENERAL),
        z["loans_guarantees"].alias(LIQUIDITY),
    )
    long = unpivot(cats, ["country_code", "region"], [HEALTH, GENERAL, LIQUIDITY], "component", "stimulus")
    return long.filter(F.col("country_code").isNotNull())


def stimulus_by_income(long: DataFrame, income_dim: DataFrame, eu_code: str = "EU",
                       eu_group: str = "High income") -> DataFrame:
    """Sum and share of the world total by income group (strict sums; null group kept)."""
    j = long.drop("region").join(income_dim.withColumnRenamed("countrycode", "country_code"), "country_code", "left")
    j = j.withColumn(
        "incomegroup", F.when(F.col("country_code") == F.lit(eu_code), F.lit(eu_group)).otherwise(F.col("incomegroup"))
    )
    return share_of_total(j, "incomegroup", "stimulus", strict=True, sum_name="sum_inc_group")


def stimulus_table_s1(long: DataFrame, xwalk: DataFrame | None = None, unit: float = 1e9,
                      default_name: str = C.EU_NAME, literal_first_match: bool = True) -> DataFrame:
    """Wide table per country in billions with the country name (unmatched code -> ``default_name``)."""
    scaled = long.withColumn("stimulus", F.col("stimulus") / F.lit(unit))
    wide = pivot_wide(scaled, ["country_code", "region"], "component", "stimulus",
                      list(CATEGORIES), [CATEGORY_COLUMNS[c] for c in CATEGORIES])
    if xwalk is None:
        return wide
    named = xwalk_code_to_name(wide, "country_code", xwalk, "country")
    if literal_first_match:
        name = replace_first(null_text("country"), "NA", default_name, literal=True)
    else:
        name = F.coalesce(F.col("country"), F.lit(default_name))
    return named.withColumn("country", name)


def stimulus_big_economies(long: DataFrame, members: Sequence[str] | DataFrame = EU_MEMBERS, bloc: str = "EU",
                           economies: Sequence[str] = BIG_ECONOMIES, exclude_region: str = "EU") -> DataFrame:
    """Economies with bloc members rolled up; skip-null sums per (economy, component), one row per
    (economy, region, component) with region not null and not ``exclude_region``."""
    rolled = rollup_bloc(long, "country_code", members, bloc)
    rolled = filter_in(rolled, "country_code", list(economies))
    per_region = rolled.groupBy("country_code", "region", "component").agg(skipna_sum("stimulus").alias("_s"))
    totals = per_region.groupBy("country_code", "component").agg(F.sum("_s").alias("stimulus"))
    keep = per_region.filter(~(F.col("region") == F.lit(exclude_region))).drop("_s")
    return keep.join(totals, ["country_code", "component"]).select("country_code", "region", "component", "stimulus")


def stimulus_by_region(long: DataFrame, region_recode: dict | None = None, world: str = "World") -> DataFrame:
    """Region x component skip-null sums plus a strict World total per component (World includes
    rows without region); absent region x component pairs appear with null stimulus."""
    region_recode = dict(C.STIM_REGION_RECODE) if region_recode is None else region_recode
    recoded = long.withColumn("region", recode("region", region_recode))
    sums = grouping_sets_total(recoded, "region", "component", "stimulus", world, "skipna", "strict", "stimulus")
    return densify(sums, ["component"], "region", "stimulus").select("component", "region", "stimulus")


def stimulus_master(big: DataFrame, by_region: DataFrame) -> DataFrame:
    """Economies and regions in one long table, sorted by region."""
    econ = big.drop("region").withColumnRenamed("country_code", "region")
    return sort_asc(union_by_name(econ, by_region).select("region", "component", "stimulus"), "region")


def control_totals(big: DataFrame, by_region: DataFrame, g20: Sequence[str] = G20,
                   bloc: str = "EU", region_total: str = "OECD+", world: str = "World",
                   single: str = "USA") -> DataFrame:
    """The five check totals: G20 economies, bloc, one region, World, one economy (strict sums)."""
    rows = union_by_name(big.select(F.col("country_code").alias("region"), "component", "stimulus", F.lit(True).alias("_econ")),
                         by_region.select("region", "component", "stimulus", F.lit(False).alias("_econ")))
    is_ = lambda v: F.col("region") == F.lit(v)
    # master holds the rows of both, so each check is a condition on one frame
    checks = {"g20": F.col("_econ") & F.col("region").isin(list(g20)), "bloc": F.col("_econ") & is_(bloc),
              "region": ~F.col("_econ") & is_(region_total), "world": ~F.col("_econ") & is_(world), "single": is_(single)}
    held = F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()])
    rows = rows.withColumn("check", F.explode(F.filter(held, lambda x: x.isNotNull()))).drop("_econ")
    return attach_group_stat(rows, ["check"], {"total": strict_sum("stimulus")}).select("check", "region", "component", "stimulus", "total")


def stimulus_july_table(july: DataFrame, region_recode: dict | None = None, unit: float = 1e9) -> DataFrame:
    """July vintage: General = individuals + business + deferrals + uncategorised; empty parts count 0."""
    region_recode = dict(C.REGION_SHEET_RECODE) if region_recode is None else region_recode
    z = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in
         ("individuals_households", "business", "deferrals", "uncategorized_other", "health", "loans_guarantees")}
    general = z["individuals_households"] + z["business"] + z["deferrals"] + z["uncategorized_other"]
    return july.select(
        "country_code", recode("region", region_recode).alias("region"),
        (general / F.lit(unit)).alias("general_spending"),
        (z["health"] / F.lit(unit)).alias("health_sector_spending"),
        (z["loans_guarantees"] / F.lit(unit)).alias("liquidity_support"),
        "country",
    )
