"""Operator-level registered queries: each exercises one verb of the inventory on the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenaria.functions.arith import pct_of, safe_div
from scenaria.functions.nulls import skipna_sum, strict_max, strict_mean, strict_min, strict_sum
from scenaria.functions.text import label_to_year, null_text, paste0, replace_first, strip_percent_number
from scenaria.operators import aggregate as A
from scenaria.operators import filters as FL
from scenaria.operators import joins as J
from scenaria.operators import order as OR
from scenaria.operators import project as P
from scenaria.operators import reshape as R
from scenaria.operators import setops as U
from scenaria.operators import timeseries as TS
from scenaria.operators import window as W
from scenaria.plans import bindings as B
from scenaria.plans import gdp as G
from scenaria.plans import investment as I
from scenaria.plans import oracle as O
from scenaria.plans.catalog import register
from scenaria.session import scratch_path
from scenaria.sources import files as SRC

_YEARS = [f"x{y}" for y in B.YEARS]
_PARTS = ("health", "non_health", "loans_guarantees", "deferrals", "international_aid", "total")
_INV_KEYS = ["region", "variable", "scenario"]


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# ============================================================================================= sources

@register("scan_na_tokens", O.sql("""SELECT c_custkey AS cust_key, c_mktsegment AS market_segment,
  CASE WHEN c_acctbal < 0 OR c_acctbal < 1000 OR (c_mktsegment = 'HOUSEHOLD' AND c_acctbal > 9000) THEN NULL
       ELSE c_acctbal END AS account_balance,
  CAST(c_custkey AS DOUBLE) * 100.0 AS scaled_key
FROM customer"""))
def q_scan_na_tokens(spark, d):
    c = B.table(spark, d, "customer")
    bal = F.col("c_acctbal")
    txt = (F.when(bal < 0, "-").when(bal < 500, "NA").when(bal < 1000, "")
           .when((F.col("c_mktsegment") == "HOUSEHOLD") & (bal > 9000), "#VALUE!").otherwise(bal.cast("string")))
    text = c.select(F.col("c_custkey").cast("string").alias("Cust Key"), F.col("c_mktsegment").alias("Market Segment"),
                    txt.alias("Account Balance"), F.concat(F.col("c_custkey").cast("string"), F.lit("E+02")).alias("Scaled Key"))
    path = scratch_path(spark, "na-tokens")
    SRC.write_table(text, path, "csv")
    back = SRC.read_csv_na_tokens(spark, path, ["Cust Key", "Market Segment", "Account Balance", "Scaled Key"],
                                  numeric=["account_balance", "scaled_key"])
    return back.select(F.col("cust_key").cast("long").alias("cust_key"), "market_segment", "account_balance", "scaled_key")


def _csv_field(c):
    return F.coalesce(c.cast("string"), F.lit(""))


@register("scan_skip_preamble", O.sql(" UNION ALL ".join(
    f"SELECT country_code, {y} AS year, x{y} AS gdp FROM gdp_wide" for y in B.YEARS), ["gdp_wide"]))
def q_scan_skip_preamble(spark, d):
    gw = B.gdp_wide(spark, d)
    q = lambda s: F.concat(F.lit('"'), s, F.lit('"'))
    lines = gw.select(F.concat_ws(",", q(F.col("country_name")), q(F.col("country_code")), q(F.col("indicator_name")),
                                  q(F.col("indicator_code")), *[_csv_field(F.col(c)) for c in _YEARS]).alias("value"))
    header = ",".join(['"Country Name"', '"Country Code"', '"Indicator Name"', '"Indicator Code"']
                      + [f'"{y}"' for y in B.YEARS])
    pre = spark.createDataFrame([('"Data Source","World Development Indicators",',), ("",),
                                 ('"Last Updated Date","2020-07-01",',), (header,)], "value string")
    path = scratch_path(spark, "preamble")
    SRC.write_table(pre.unionByName(lines), path, "text")
    cols = ["country_name", "country_code", "indicator_name", "indicator_code"] + _YEARS
    back = SRC.read_csv_skip_preamble(spark, path, cols, "country_code", r"^[A-Z][A-Z0-9]{2}$", _YEARS)
    long = R.unpivot(back.select("country_code", *_YEARS), ["country_code"], _YEARS, "year", "gdp")
    return long.select("country_code", label_to_year("year").alias("year"), "gdp")


_SHEET_SCHEMA = T.StructType([T.StructField("country", T.StringType()), T.StructField("region", T.StringType())])


@register("scan_sheet_table", O.sql("SELECT country, region FROM region_sheet", ["region_sheet"]))
def q_scan_sheet_table(spark, d):
    root = scratch_path(spark, "workbook")
    SRC.write_table(B.region_sheet(spark, d), f"{root}/iam_regions", "parquet")
    return SRC.read_sheet_table(spark, root, "iam_regions", _SHEET_SCHEMA, "parquet")


@register("literal_table", O.sql("""SELECT l_linestatus, s.scenario, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS revenue
FROM lineitem JOIN (VALUES ('O', '1.5C'), ('F', 'CPol')) s(code, scenario) ON l_linestatus = s.code
GROUP BY l_linestatus, s.scenario"""))
def q_literal_table(spark, d):
    lit = spark.createDataFrame([("O", "1.5C"), ("F", "CPol")], "code string, scenario string")
    li = B.table(spark, d, "lineitem").groupBy("l_linestatus").agg(
        F.sum(B.cents("l_extendedprice")).cast("double").alias("revenue"))
    return li.join(lit, li.l_linestatus == lit.code).select("l_linestatus", "scenario", "revenue")


@register("membership_sets", O.sql(f"SELECT * FROM stim_long WHERE country_code IN {_in(B.BLOC_MEMBERS)}", ["stim_long"]))
def q_membership_sets(spark, d):
    return FL.filter_in(B.stim_long(spark, d), "country_code", list(B.BLOC_MEMBERS))


_MASTER_SCHEMA = "row_index long, region string, component string, stimulus double"


@register("export_indexed", O.sql("""SELECT row_number() OVER (ORDER BY region, component, stimulus) AS row_index,
  region, component, stimulus FROM stim_master""", ["stim_master"]))
def q_export_indexed(spark, d):
    path = scratch_path(spark, "export")
    SRC.export_indexed(B.stim_master(spark, d), path, ["region", "component"])
    return SRC.read_published(spark, path, _MASTER_SCHEMA)


@register("normalise_headers", O.sql("""SELECT "Model" AS model, "Region" AS region, "Scenario" AS scenario,
  "Variable" AS variable, "1995", "2000", "2001" FROM invest_sheet""", ["invest_sheet"]))
def q_normalise_headers(spark, d):
    return P.normalise_headers(B.invest_sheet(spark, d))


# ========================================================================================= projections

@register("project_keep", O.sql("SELECT country_code, total FROM stim_wide", ["stim_wide"]))
def q_project_keep(spark, d):
    return B.stim_wide(spark, d).select("country_code", "total")


@register("project_drop", O.sql("SELECT country_code, health, non_health, loans_guarantees, deferrals FROM stim_wide",
                                ["stim_wide"]))
def q_project_drop(spark, d):
    return P.drop_cols(B.stim_wide(spark, d), "international_aid", "total")


@register("project_rename", O.sql("SELECT country_code, region, component AS variable, stimulus AS avg_invest FROM stim_long",
                                  ["stim_long"]))
def q_project_rename(spark, d):
    return P.rename(B.stim_long(spark, d), {"component": "variable", "stimulus": "avg_invest"})


@register("project_range", O.sql("SELECT country_code, x1996, x1997, x1998, x1999 FROM gdp_wide", ["gdp_wide"]))
def q_project_range(spark, d):
    return P.select_range(B.gdp_wide(spark, d), "x1996", "x1999", keep=["country_code"])


@register("derive_chained", O.sql("""SELECT country_code, total2, tot - total2 AS other, nh + (tot - total2) AS non_health FROM (
  SELECT country_code, ((df + h) + lg) + nh AS total2, tot, nh FROM stim_cat) t""", ["stim_cat"]))
def q_derive_chained(spark, d):
    w = B.stim_wide(spark, d).fillna(0.0, subset=list(_PARTS))
    out = P.derive_chained(w, [
        ("total2", lambda: F.col("deferrals") + F.col("health") + F.col("loans_guarantees") + F.col("non_health")),
        ("other", lambda: F.col("total") - F.col("total2")),
        ("non_health", lambda: F.col("non_health") + F.col("other")),
    ])
    return out.select("country_code", "total2", "other", "non_health")


@register("derive_constant", O.sql("SELECT country_code, x2000 AS gdp, CAST(1.55e13 AS DOUBLE) AS eu FROM gdp_wide",
                                   ["gdp_wide"]))
def q_derive_constant(spark, d):
    return G.gdp_year(B.gdp_wide(spark, d), B.GDP_YEAR).withColumn("eu", F.lit(B.EU_GDP))


@register("derive_conditional", O.sql("""SELECT countrycode, CASE WHEN countrycode = 'N00' THEN 'High income'
  ELSE incomegroup END AS incomegroup FROM income_dim""", ["income_dim"]))
def q_derive_conditional(spark, d):
    i = B.income_dim(spark, d)
    return i.withColumn("incomegroup", F.when(F.col("countrycode") == "N00", F.lit("High income"))
                        .otherwise(F.col("incomegroup")))


@register("recode_map", O.sql("""SELECT DISTINCT "Region" AS sheet_region,
  CASE WHEN "Region" = 'R5AFRICA' THEN 'AFRICA' WHEN "Region" = 'R5AMERICA' THEN 'AMERICA'
       WHEN "Region" = 'R5ASIA' THEN 'ASIA' WHEN "Region" = 'R5EUROPE' THEN 'EUROPE'
       WHEN "Region" = 'R5MIDDLE EAST' THEN 'MIDEAST' ELSE "Region" END AS region FROM invest_sheet""", ["invest_sheet"]))
def q_recode_map(spark, d):
    from scenaria.functions.recode import recode
    s = B.invest_sheet(spark, d)
    return s.select(F.col("Region").alias("sheet_region"),
                    recode("Region", B.SHEET_REGION_RECODE).alias("region")).distinct()


@register("cast_lenient", O.sql("""SELECT "Model" AS model, "Region" AS region, "Scenario" AS scenario, "Variable" AS variable,
  TRY_CAST("1995" AS DOUBLE) AS v1995, TRY_CAST("2000" AS DOUBLE) AS v2000 FROM invest_sheet""", ["invest_sheet"]))
def q_cast_lenient(spark, d):
    s = B.invest_sheet(spark, d)
    return s.select(F.col("Model").alias("model"), F.col("Region").alias("region"), F.col("Scenario").alias("scenario"),
                    F.col("Variable").alias("variable"), F.col("1995").try_cast("double").alias("v1995"),
                    F.col("2000").try_cast("double").alias("v2000"))


@register("null_to_zero", O.sql("SELECT o_custkey, " + ", ".join(
    f"coalesce(CAST(sum(CASE WHEN o_orderpriority = '{p}' THEN {O.CENTS.format(c='o_totalprice')} END) AS DOUBLE), 0.0) AS {n}"
    for n, p in B.PRIORITY_PARTS.items()) + " FROM orders GROUP BY o_custkey"))
def q_null_to_zero(spark, d):
    """Order totals by customer and priority; most customers lack some priority."""
    parts = [F.sum(F.when(F.col("o_orderpriority") == p, B.cents("o_totalprice"))).cast("double").alias(n) for n, p in B.PRIORITY_PARTS.items()]
    return B.table(spark, d, "orders").groupBy("o_custkey").agg(*parts).fillna(0.0, subset=list(B.PRIORITY_PARTS))


@register("rowwise_sum", O.sql("""SELECT country_code, ((health + non_health) + loans_guarantees) + deferrals AS parts_sum
FROM stim_wide""", ["stim_wide"]))
def q_rowwise_sum(spark, d):
    w = B.stim_wide(spark, d)
    return w.select("country_code", (F.col("health") + F.col("non_health") + F.col("loans_guarantees")
                                     + F.col("deferrals")).alias("parts_sum"))


@register("scale_units", O.sql("""SELECT country_code, component, stimulus / 1e9 AS stimulus_bn,
  stimulus * CAST(1.0728 AS DOUBLE) AS inflated FROM stim_long""", ["stim_long"]))
def q_scale_units(spark, d):
    l = B.stim_long(spark, d)
    return l.select("country_code", "component", (F.col("stimulus") / F.lit(1e9)).alias("stimulus_bn"),
                    (F.col("stimulus") * F.lit(1.0728)).alias("inflated"))


# ============================================================================================= filters

@register("filter_in", O.sql("SELECT * FROM invest_cells WHERE variable IN ('A', 'R')", ["invest_cells"]))
def q_filter_in(spark, d):
    return FL.filter_in(B.invest_cells(spark, d), "variable", ["A", "R"])


@register("filter_not_equal", O.sql("SELECT country, region, country_code FROM region_dim WHERE NOT (region = 'AFRICA')",
                                    ["region_dim"]))
def q_filter_not_equal(spark, d):
    return FL.filter_not_equal(B.region_dim(spark, d), "region", "AFRICA").select("country", "region", "country_code")


@register("filter_first_and_pred", O.sql("""SELECT o_custkey, o_orderkey, o_orderstatus FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) o
WHERE rn = 1 AND NOT (o_orderstatus = 'F')"""))
def q_filter_first_and_pred(spark, d):
    """Customers whose first order is not finished; customers have many orders."""
    o = B.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return FL.filter_first_and_pred(o, ["o_custkey"], ["o_orderkey"], ~(F.col("o_orderstatus") == F.lit("F")))


@register("drop_null_rows", O.sql("""SELECT w.country_code, d.region, w.total FROM stim_wide w
LEFT JOIN region_dim d ON w.country_code = d.country_code WHERE d.region IS NOT NULL""", ["stim_wide", "region_dim"]))
def q_drop_null_rows(spark, d):
    j = B.stim_wide(spark, d).join(B.region_dim(spark, d), "country_code", "left")
    return FL.drop_null_rows(j, "region").select("country_code", "region", "total")


O.cte("invest_part_anchor", ["invest"], "SELECT * FROM invest WHERE NOT (model = 'ECONOMY' AND region = 'ASIA')")
O.two_stage_sql("part_anchor", 1995, 1999, 1995, "mean", src="invest_part_anchor")


@register("filter_anchor_member", O.sql("""SELECT region, variable, scenario, year, m AS member_mean FROM part_anchor_s1
WHERE has_anchor = 1""", ["part_anchor_s1"]))
def q_filter_anchor_member(spark, d):
    """The anchor model has no rows in one region, whose groups drop out."""
    inv = B.invest(spark, d).filter(F.col("year").between(1995, 1999) & ~((F.col("model") == B.ANCHOR) & (F.col("region") == "ASIA")))
    return A.member_stats(inv, _INV_KEYS, "year", "model", "investment", B.ANCHOR).withColumnRenamed(
        "member_mean", "member_mean")


@register("filter_repr_year", O.sql("SELECT region, variable, scenario, value FROM stage_mean", ["stage_mean"]))
def q_filter_repr_year(spark, d):
    inv = B.invest(spark, d).filter(F.col("year").between(1995, 1999))
    return A.two_stage(inv, _INV_KEYS, "year", "model", "investment", B.ANCHOR, 1995)


# =============================================================================================== joins

@register("join_left_dim", O.sql("""SELECT l.*, g.gdp FROM stim_long l LEFT JOIN gdp_country g
ON l.country_code = g.country_code""", ["stim_long", "gdp_country"]))
def q_join_left_dim(spark, d):
    return J.join_left_dim(B.stim_long(spark, d), B.gdp_country(spark, d), "country_code")


@register("join_left_renamed", O.sql("""SELECT l.*, i.incomegroup FROM stim_long l LEFT JOIN income_dim i
ON l.country_code = i.countrycode""", ["stim_long", "income_dim"]))
def q_join_left_renamed(spark, d):
    return J.join_left_renamed(B.stim_long(spark, d), B.income_dim(spark, d), "country_code", "countrycode")


@register("join_right_distinct", O.sql("""SELECT r.region, g.gdp FROM gdp_by_region g
RIGHT JOIN (SELECT DISTINCT region FROM region_dim) r ON g.region = r.region""", ["gdp_by_region", "region_dim"]))
def q_join_right_distinct(spark, d):
    gr = G.gdp_by_region(B.gdp_wide(spark, d), B.region_dim(spark, d), B.GDP_YEAR, B.BLOC_SHEET_REGION)
    return J.join_right_distinct(gr, B.region_dim(spark, d), ["region"]).select("region", "gdp")


@register("join_cross", O.sql("""SELECT m.*, s.scenario FROM stim_master m
CROSS JOIN (SELECT '1.5C' AS scenario UNION ALL SELECT 'CPol') s""", ["stim_master"]))
def q_join_cross(spark, d):
    return J.cross_small(B.stim_master(spark, d), B.scenarios(spark))


@register("xwalk_name_to_code", O.sql("""SELECT s.country, x.iso3 AS country_code FROM stim_s1 s
LEFT JOIN (SELECT lower(trim(country_name)) AS nm, min(iso3) AS iso3 FROM xwalk GROUP BY 1) x
ON lower(trim(s.country)) = x.nm""", ["stim_s1", "xwalk"]))
def q_xwalk_name_to_code(spark, d):
    return J.xwalk_name_to_code(B.stim_s1(spark, d).select("country"), "country", B.xwalk(spark, d), "country_code")


_NAME_PATTERNS = (  # pattern, what must not match, code, words that a match holds
    (r"^(red|blue) .*bolt", None, "BOLT-C", ("bolt",)), (r"\bbolt\b", r"^(red|blue) ", "BOLT", ("bolt",)),
    (r"\b(ring|widget)\b.*#1\b", None, "ONE", ("1",)), (r"^small ring\b", None, "RING-S", ("small", "ring")),
    (r"\bgizmo\b", r"#2", "GIZMO", ("gizmo",)), (r"\bgear\b", None, "GEAR", ("gear",)))


def _part_names(p):
    return F.concat_ws(" ", p["p_name"], F.concat(F.lit("#"), p["p_size"].cast("string")), p["p_brand"])


@register("xwalk_pattern_to_code", O.sql("""SELECT name, CASE WHEN count(DISTINCT code) = 1 THEN min(code) END AS code,
  count(DISTINCT code) AS n_codes, any_value(n_parts) AS n_parts
FROM (SELECT p_name || ' #' || p_size || ' ' || p_brand AS name, count(*) AS n_parts FROM part GROUP BY 1) n LEFT JOIN (VALUES """ + ", ".join(
    "(" + ", ".join("NULL" if x is None else f"'{x}'" for x in row[:3]) + ")" for row in _NAME_PATTERNS) + """) t(pattern, unless, code)
  ON regexp_matches(lower(name), pattern) AND NOT coalesce(regexp_matches(lower(name), unless), false) GROUP BY name"""))
def q_xwalk_pattern_to_code(spark, d):
    p = B.table(spark, d, "part")
    names = p.groupBy(_part_names(p).alias("name")).agg(F.count("*").alias("n_parts"))
    patterns = spark.createDataFrame([(*row[:3], list(row[3])) for row in _NAME_PATTERNS], "pattern string, unless string, code string, words array<string>")
    out = J.xwalk_pattern_to_code(names, "name", patterns, "code", "codes")
    return out.select("name", "code", F.coalesce(F.size("codes"), F.lit(0)).cast("bigint").alias("n_codes"), "n_parts")


@register("xwalk_code_to_name", O.sql("""SELECT l.country_code, l.component, coalesce(x.nm, 'European Union') AS country
FROM stim_long l LEFT JOIN (SELECT iso3, min(country_name) AS nm FROM xwalk WHERE iso3 <> 'N07' GROUP BY iso3) x ON l.country_code = x.iso3""",
                                      ["stim_long", "xwalk"]))
def q_xwalk_code_to_name(spark, d):
    """One code is missing from the crosswalk and takes the default name."""
    l = B.stim_long(spark, d).select("country_code", "component")
    return J.xwalk_code_to_name(l, "country_code", B.xwalk(spark, d).filter(F.col("iso3") != "N07"), "country", "European Union")


@register("rollup_bloc", O.sql(f"""SELECT country_code, CASE WHEN country_code IN {_in(B.BLOC_MEMBERS)} THEN 'EU'
  ELSE country_code END AS bloc_code, component, stimulus FROM stim_long""", ["stim_long"]))
def q_rollup_bloc(spark, d):
    l = B.stim_long(spark, d).select("country_code", "component", "stimulus")
    return J.rollup_bloc(l, "country_code", list(B.BLOC_MEMBERS), "EU", "bloc_code")


@register("join_fanout", O.sql("""SELECT l.country_code, l.component, l.stimulus, m.region FROM stim_long l
LEFT JOIN (SELECT DISTINCT country_code, region FROM map_dim) m ON l.country_code = m.country_code""",
                               ["stim_long", "map_dim"]))
def q_join_fanout(spark, d):
    l = B.stim_long(spark, d).drop("region")
    return J.join_fanout(l, B.map_dim(spark, d), "country_code", "region")


# ======================================================================================== aggregations

def _prep_agg(fn_sql: str, name: str, digits_cols=()):
    return O.sql(f"SELECT region, variable, year, {fn_sql} AS {name} FROM invest_prep GROUP BY 1, 2, 3", ["invest_prep"])


@register("agg_sum_strict", _prep_agg(O.strict("sum", "investment"), "total"))
def q_agg_sum_strict(spark, d):
    return B.invest_prep(spark, d).groupBy("region", "variable", "year").agg(strict_sum("investment").alias("total"))


@register("agg_sum_skipna", O.sql(f"""SELECT model, region, variable, scenario, year, {O.skipna_sum('investment')} AS total
FROM invest_prep GROUP BY 1, 2, 3, 4, 5""", ["invest_prep"]))
def q_agg_sum_skipna(spark, d):
    """By model too, so that the group of the bad knot is all null and sums to 0."""
    return B.invest_prep(spark, d).groupBy("model", "region", "variable", "scenario", "year").agg(skipna_sum("investment").alias("total"))


@register("agg_mean_strict", _prep_agg(O.strict_mean("investment"), "mean"))
def q_agg_mean_strict(spark, d):
    return B.invest_prep(spark, d).groupBy("region", "variable", "year").agg(strict_mean("investment").alias("mean"))


@register("agg_minmax_strict", O.sql(f"""SELECT region, variable, year, {O.strict('min', 'investment')} AS min_value,
  {O.strict('max', 'investment')} AS max_value FROM invest_prep GROUP BY 1, 2, 3""", ["invest_prep"]))
def q_agg_minmax_strict(spark, d):
    return B.invest_prep(spark, d).groupBy("region", "variable", "year").agg(
        strict_min("investment").alias("min_value"), strict_max("investment").alias("max_value"))


O.two_stage_sql("mm_full", 1995, 2000, 1995, "mean")
O.two_stage_sql("sm_full", 1995, 2000, 1995, "sum")


@register("agg_mean_of_mean", O.sql("SELECT * FROM mm_full", ["mm_full"]))
def q_agg_mean_of_mean(spark, d):
    return A.two_stage(B.invest(spark, d), _INV_KEYS, "year", "model", "investment", B.ANCHOR, 1995, "mean", "mean")


@register("agg_sum_of_mean", O.sql("SELECT * FROM sm_full", ["sm_full"]))
def q_agg_sum_of_mean(spark, d):
    return A.two_stage(B.invest(spark, d), _INV_KEYS, "year", "model", "investment", B.ANCHOR, 1995, "mean", "sum")


O.cte("env_full_s1", ["invest"], f"""SELECT region, variable, scenario, year, {O.strict_mean('investment')} AS mm,
  {O.strict('max', 'investment')} AS mx, {O.strict('min', 'investment')} AS mn,
  max(CASE WHEN model = 'ECONOMY' THEN 1 ELSE 0 END) AS has_anchor FROM invest GROUP BY 1, 2, 3, 4""")
O.cte("env_full", ["env_full_s1"], f"""SELECT region, variable, scenario, annual, annual_max, annual_min FROM (
  SELECT region, variable, scenario, {O.strict_mean('mm')} AS annual, {O.strict_mean('mx')} AS annual_max,
         {O.strict_mean('mn')} AS annual_min, max(CASE WHEN year = 1995 THEN 1 ELSE 0 END) AS has_rep
  FROM env_full_s1 WHERE has_anchor = 1 GROUP BY 1, 2, 3) t WHERE has_rep = 1""")


@register("agg_envelope", O.sql("SELECT * FROM env_full", ["env_full"]))
def q_agg_envelope(spark, d):
    return A.envelope(B.invest(spark, d), _INV_KEYS, "year", "model", "investment", B.ANCHOR, 1995)


@register("agg_share_of_total", O.sql(f"""SELECT component, group_sum, g AS global, group_sum / g AS share FROM (
  SELECT component, {O.strict('sum', 'stimulus')} AS group_sum FROM stim_long GROUP BY component) a
CROSS JOIN (SELECT {O.strict('sum', 'stimulus')} AS g FROM stim_long) t""", ["stim_long"]))
def q_agg_share_of_total(spark, d):
    return A.share_of_total(B.stim_long(spark, d), "component", "stimulus")


@register("agg_grouping_sets_world", O.sql("SELECT region, component, stimulus FROM region_sums", ["region_sums"]))
def q_agg_grouping_sets_world(spark, d):
    from scenaria.functions.recode import recode
    l = B.stim_long(spark, d).withColumn("region", recode("region", B.STIM_REGION_RECODE))
    return A.grouping_sets_total(l, "region", "component", "stimulus", "World", "skipna", "strict", "stimulus")


@register("agg_control_totals", O.sql("""SELECT *, CASE WHEN count(*) OVER () = count(stimulus) OVER ()
  THEN sum(stimulus) OVER () END AS total FROM stim_long WHERE region = 'ASIA'""", ["stim_long"]))
def q_agg_control_totals(spark, d):
    return A.control_total(B.stim_long(spark, d), F.col("region") == F.lit("ASIA"), "stimulus")


O.cte("model_spread_raw", ["spread_per_model"], """SELECT region, variable, model,
  max(CASE WHEN scenario = '1.5C' THEN annual_avg END) - max(CASE WHEN scenario = 'CPol' THEN annual_avg END) AS shift
FROM spread_per_model GROUP BY 1, 2, 3""")


@register("agg_spread_summary", O.sql(f"""SELECT region, variable, {O.strict('min', 'shift')} AS ymin,
  {O.strict('max', 'shift')} AS ymax, {O.strict_mean('shift')} AS y FROM model_spread_raw GROUP BY 1, 2""",
                                      ["model_spread_raw"]))
def q_agg_spread_summary(spark, d):
    ms = I.model_spread_shift(B.invest(spark, d), 1995)
    return A.spread_summary(ms, ["region", "variable"], "shift").drop("summary")


# ============================================================================================= windows

@register("win_group_stat", O.sql("""SELECT *, CASE WHEN count(*) OVER w = count(stimulus) OVER w THEN sum(stimulus) OVER w END
  AS region_total FROM stim_long WINDOW w AS (PARTITION BY region, component)""", ["stim_long"]))
def q_win_group_stat(spark, d):
    return A.attach_group_stat(B.stim_long(spark, d), ["region", "component"], {"region_total": strict_sum("stimulus")})


@register("win_global_stat", O.sql("""SELECT *, CASE WHEN count(*) OVER () = count(stimulus) OVER ()
  THEN sum(stimulus) OVER () END AS world FROM stim_long""", ["stim_long"]))
def q_win_global_stat(spark, d):
    return A.attach_global_stat(B.stim_long(spark, d), {"world": strict_sum("stimulus")})


@register("win_net", O.sql(f"""SELECT *, CASE WHEN count(*) OVER w = count(total) OVER w THEN {O.exact_sum('total', ' OVER w')} END AS net
FROM total_invest WINDOW w AS (PARTITION BY region, scenario)""", ["total_invest"]))
def q_win_net(spark, d):
    tot = I.investment_total(B.invest(spark, d), 1995, 1999, 1995, B.ANCHOR)
    return A.attach_group_stat(tot, ["region", "scenario"], {"net": strict_sum("total")})


@register("win_first_per_key", O.sql("""SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) t WHERE rn = 1"""))
def q_win_first_per_key(spark, d):
    ev = B.table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return FL.first_per_key(ev, ["user_id"], ["event_id"])


@register("win_two_grains", O.sql("""SELECT *, coalesce(sum(stimulus) OVER (PARTITION BY region), 0.0) AS total_reg FROM (
  SELECT *, CASE WHEN count(*) OVER w = count(stimulus) OVER w THEN sum(stimulus) OVER w END AS stim_reg
  FROM stim_long WINDOW w AS (PARTITION BY region, component)) t""", ["stim_long"]))
def q_win_two_grains(spark, d):
    return W.attach_two_grains(B.stim_long(spark, d), ["region"], "component", {"stim_reg": strict_sum("stimulus")},
                               "stimulus", "total_reg")


def _stack_sql(src: str, bar: str, rank: str, value: str, grid: int = O.GRID) -> str:
    """Stacked-bar offsets in SQL (same rule as ``stack_offsets``)."""
    return f"""SELECT *, CASE WHEN sgn > 0 THEN cum ELSE cum - {value} END AS ymax,
  CASE WHEN sgn > 0 THEN cum - {value} ELSE cum END AS ymin FROM (
  SELECT *, {O.exact_sum(f"coalesce({value}, 0.0)", f" OVER (PARTITION BY {bar}, sgn ORDER BY {rank} DESC NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", grid)} AS cum FROM (
    SELECT *, CASE WHEN {value} < 0 THEN -1 ELSE 1 END AS sgn FROM ({src}) s0) s1) s2"""


def _drop_sgn(stmt: str) -> str:
    return f"SELECT * EXCLUDE (sgn, cum) FROM ({stmt}) s3"


_CAT_RANK = ("CASE WHEN component = 'General spending' THEN 1 WHEN component = 'Health sector spending' THEN 2 "
             "WHEN component = 'Liquidity support' THEN 3 END")


@register("win_stack_offsets", O.sql(_drop_sgn(_stack_sql(
    f"SELECT region, component, CASE WHEN component = 'Liquidity support' THEN -stimulus ELSE stimulus END AS stimulus, "
    f"{_CAT_RANK} AS level_rank FROM stim_region", "region", "level_rank", "stimulus")), ["stim_region"]))
def q_win_stack_offsets(spark, d):
    from scenaria.plans.stimulus import CATEGORIES
    turned = F.when(F.col("component") == "Liquidity support", -F.col("stimulus")).otherwise(F.col("stimulus"))  # stacks below zero
    r = OR.as_levels(B.stim_region(spark, d).withColumn("stimulus", turned), "component", list(CATEGORIES), "level_rank")
    return W.stack_offsets(r, ["region"], "level_rank", "stimulus")


# ================================================================================ sorts, sets, ordering

@register("sort_asc", O.sql("SELECT region, component, stimulus FROM stim_master", ["stim_master"]))
def q_sort_asc(spark, d):
    return OR.sort_asc(B.stim_master(spark, d), "region", "component")


@register("order_by_stat", O.sql(f"""SELECT invest_type, CAST(row_number() OVER (ORDER BY s, invest_type) AS INTEGER) AS order_rank FROM (
  SELECT invest_type, {O.exact_mean('-pct_gdp')} AS s FROM gdp_shares GROUP BY invest_type) t""", ["gdp_shares"]))
def q_order_by_stat(spark, d):
    from scenaria.plans.catalog import _gdp_shares
    gs = _gdp_shares(spark, d)
    return OR.order_by_stat(gs, "invest_type", "pct_gdp").select("invest_type", "order_rank").distinct()


_LV = ("General spending", "Health sector spending", "Low carbon sources", "Fossil fuels")


@register("order_by_levels", O.sql("""SELECT region, CASE WHEN r IS NOT NULL THEN component END AS component, stimulus,
  r AS level_rank FROM (SELECT *, CASE WHEN component = 'General spending' THEN 1
  WHEN component = 'Health sector spending' THEN 2 WHEN component = 'Low carbon sources' THEN 3
  WHEN component = 'Fossil fuels' THEN 4 END AS r FROM stim_master) t""", ["stim_master"]))
def q_order_by_levels(spark, d):
    return OR.as_levels(B.stim_master(spark, d), "component", list(_LV), "level_rank")


@register("union_by_name", O.sql("""SELECT country_code, region, component, stimulus FROM stim_big
UNION ALL SELECT NULL, region, component, stimulus FROM stim_region""", ["stim_big", "stim_region"]))
def q_union_by_name(spark, d):
    return U.union_by_name(B.stim_big(spark, d), B.stim_region(spark, d))


@register("distinct_keys", O.sql("SELECT DISTINCT region, variable FROM invest_prep", ["invest_prep"]))
def q_distinct_keys(spark, d):
    return U.distinct_keys(B.invest_prep(spark, d), ["region", "variable"])


# ==================================================================================== scalar functions

@register("str_concat_key", O.sql("""SELECT country_code, coalesce(country_code, 'NA') || coalesce(region, 'NA')
  || coalesce(component, 'NA') AS key FROM stim_long""", ["stim_long"]))
def q_str_concat_key(spark, d):
    return B.stim_long(spark, d).select("country_code", paste0("country_code", "region", "component").alias("key"))


@register("str_null_text", O.sql("SELECT country_code, component, coalesce(region, 'NA') AS region_text FROM stim_long", ["stim_long"]))
def q_str_null_text(spark, d):
    return B.stim_long(spark, d).select("country_code", "component", null_text("region").alias("region_text"))


@register("str_replace_first", O.sql("SELECT country_code, regexp_replace(country_code, '0', 'Z') AS replaced "
                                     "FROM region_dim", ["region_dim"]))
def q_str_replace_first(spark, d):
    r = B.region_dim(spark, d)
    return r.select("country_code", replace_first("country_code", "0", "Z").alias("replaced"))


@register("str_strip_percent", O.sql("""SELECT "Model" AS model, "Region" AS region, "Scenario" AS scenario,
  "Variable" AS variable, TRY_CAST(regexp_replace("1995", '%', '') AS DOUBLE) AS v1995 FROM invest_sheet""",
                                     ["invest_sheet"]))
def q_str_strip_percent(spark, d):
    s = B.invest_sheet(spark, d)
    return s.select(F.col("Model").alias("model"), F.col("Region").alias("region"), F.col("Scenario").alias("scenario"),
                    F.col("Variable").alias("variable"), strip_percent_number("1995").alias("v1995"))


@register("num_arith", O.sql("""SELECT country_code, total - (((deferrals + health) + loans_guarantees) + non_health) AS residual,
  (total - (((deferrals + health) + loans_guarantees) + non_health)) / 2 AS half_residual,
  CASE WHEN total = 0 THEN NULL ELSE health / total END AS health_ratio FROM stim_wide""", ["stim_wide"]))
def q_num_arith(spark, d):
    w = B.stim_wide(spark, d)
    resid = F.col("total") - (F.col("deferrals") + F.col("health") + F.col("loans_guarantees") + F.col("non_health"))
    return w.select("country_code", resid.alias("residual"), (resid / F.lit(2)).alias("half_residual"),
                    safe_div("health", "total").alias("health_ratio"))


@register("num_pct_of", O.sql("""SELECT l.country_code, l.component, (l.stimulus / g.gdp) * 100.0 AS pct
FROM stim_long l LEFT JOIN gdp_country g ON l.country_code = g.country_code""", ["stim_long", "gdp_country"]))
def q_num_pct_of(spark, d):
    j = B.stim_long(spark, d).join(B.gdp_country(spark, d), "country_code", "left")
    return j.select("country_code", "component", pct_of("stimulus", "gdp").alias("pct"))


@register("label_to_year", O.sql(" UNION ALL ".join(
    f"SELECT country_code, {y} AS year, x{y} AS gdp FROM gdp_wide" for y in B.YEARS), ["gdp_wide"]))
def q_label_to_year(spark, d):
    return G.gdp_long(B.gdp_wide(spark, d), "x1995", "x2001")


# ============================================================================================= reshape

@register("unpivot_except_ids", O.sql(" UNION ALL ".join(
    f"SELECT country_code, '{p}' AS part, {p} AS value FROM stim_wide" for p in _PARTS), ["stim_wide"]))
def q_unpivot_except_ids(spark, d):
    return R.unpivot(B.stim_wide(spark, d), ["country_code"], None, "part", "value")


@register("unpivot_range", O.sql(" UNION ALL ".join(
    f"SELECT country_code, 'x{y}' AS label, x{y} AS gdp FROM gdp_wide" for y in range(1996, 2000)), ["gdp_wide"]))
def q_unpivot_range(spark, d):
    return R.unpivot_range(B.gdp_wide(spark, d), ["country_code"], "x1996", "x1999", "label", "gdp")


@register("pivot_wide", O.sql("""SELECT country_code, region,
  max(CASE WHEN component = 'General spending' THEN stimulus END) AS general_spending,
  max(CASE WHEN component = 'Health sector spending' THEN stimulus END) AS health_sector_spending,
  max(CASE WHEN component = 'Liquidity support' THEN stimulus END) AS liquidity_support
FROM stim_long GROUP BY 1, 2""", ["stim_long"]))
def q_pivot_wide(spark, d):
    from scenaria.plans.stimulus import CATEGORIES, CATEGORY_COLUMNS
    return R.pivot_wide(B.stim_long(spark, d), ["country_code", "region"], "component", "stimulus",
                        list(CATEGORIES), [CATEGORY_COLUMNS[c] for c in CATEGORIES])


@register("densify_keys", O.sql("""SELECT k.model, k.region, k.scenario, k.variable, y.year, p.investment
FROM (SELECT DISTINCT model, region, scenario, variable FROM invest_prep WHERE investment IS NOT NULL) k
CROSS JOIN (SELECT DISTINCT year FROM invest_prep WHERE investment IS NOT NULL) y
LEFT JOIN (SELECT * FROM invest_prep WHERE investment IS NOT NULL) p
  ON p.model = k.model AND p.region = k.region AND p.scenario = k.scenario AND p.variable = k.variable
  AND p.year = y.year""", ["invest_prep"]))
def q_densify_keys(spark, d):
    known = B.invest_prep(spark, d).filter(F.col("investment").isNotNull())
    return R.densify(known, ["model", "region", "scenario", "variable"], "year", "investment")


@register("column_to_row", O.sql("""SELECT region, gdp FROM gdp_by_region WHERE region <> 'World'
UNION ALL SELECT 'EU', CAST(1.55e13 AS DOUBLE)""", ["gdp_by_region"]))
def q_column_to_row(spark, d):
    gr = G.gdp_by_region(B.gdp_wide(spark, d), B.region_dim(spark, d), B.GDP_YEAR, B.BLOC_SHEET_REGION)
    return R.column_to_row(gr.filter(F.col("region") != "World"), {"region": "EU", "gdp": B.EU_GDP})


@register("pivot_difference", O.sql("""SELECT region, variable, "1.5C", "CPol", shift FROM shift_annual""",
                                    ["shift_annual"]))
def q_pivot_difference(spark, d):
    inv = B.invest(spark, d).filter(F.col("year").between(1995, 1999))
    st = A.two_stage(inv, _INV_KEYS, "year", "model", "investment", B.ANCHOR, 1995)
    return R.pivot_difference(st, ["region", "variable"], "scenario", "value", "1.5C", "CPol")


# ========================================================================================= time series

O.cte("gdp_knots", ["gdp_wide"], "SELECT country_code, year, sum(y) AS y FROM (" + " UNION ALL ".join(
    f"SELECT country_code, {y - (y - 1995) % 2} AS year, x{y} AS y FROM gdp_wide WHERE country_code <> 'WLD'" for y in range(1995, 2002))
    + ") k GROUP BY 1, 2")
O.cte("gdp_interp_staged", ["gdp_knots"], """SELECT country_code, year, y, count(y) OVER (PARTITION BY country_code) AS n,
  last_value(CASE WHEN y IS NOT NULL THEN year END IGNORE NULLS) OVER (PARTITION BY country_code ORDER BY year
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS px,
  last_value(y IGNORE NULLS) OVER (PARTITION BY country_code ORDER BY year
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS py,
  first_value(CASE WHEN y IS NOT NULL THEN year END IGNORE NULLS) OVER (PARTITION BY country_code ORDER BY year
    ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS qx,
  first_value(y IGNORE NULLS) OVER (PARTITION BY country_code ORDER BY year
    ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS qy,
  lead(year) OVER (PARTITION BY country_code ORDER BY year) AS next_x
FROM gdp_knots""")


@register("ts_interpolate_linear", O.sql("""SELECT country_code, CAST(t AS INTEGER) AS year,
  CAST(CASE WHEN n < 2 THEN NULL WHEN t = px THEN py
       WHEN px IS NOT NULL AND qx IS NOT NULL THEN py + (qy - py) * (CAST(t - px AS DOUBLE) / CAST(qx - px AS DOUBLE))
  END AS DOUBLE) AS gdp, n AS knots
FROM (SELECT *, unnest(generate_series(year, coalesce(next_x - 1, year))) AS t FROM gdp_interp_staged) g""",
                                         ["gdp_interp_staged"]))
def q_ts_interpolate_linear(spark, d):
    gw = B.gdp_wide(spark, d).filter(F.col("country_code") != "WLD")
    # a knot every second year holds the sum of its two years, so that every year counts
    long = (G.gdp_long(gw, "x1995", "x2001").withColumn("year", (F.col("year") - (F.col("year") - 1995) % 2).cast("int"))
            .groupBy("country_code", "year").agg(F.sum("gdp").alias("gdp")))
    return TS.interpolate_linear(long, ["country_code"], "year", "gdp", knot_count="knots")


@register("ts_period", O.sql("SELECT * FROM invest WHERE year BETWEEN 1995 AND 1999", ["invest"]))
def q_ts_period(spark, d):
    return TS.restrict_period(B.invest(spark, d), "year", 1995, 1999)


# ===================================================================================== figure tables (G)

from scenaria.plans import figures as FG  # noqa: E402

_REG1 = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDEAST", "World")
_INV_ECON = ("ASIA", "EUROPE")


def _stacked(src: str, bar: str, needs, level_case: str, value: str = "value", grid: int = O.GRID) -> O.Stmt:
    inner = f"SELECT *, {level_case} AS level_rank FROM ({src}) z"
    return O.sql(_drop_sgn(_stack_sql(inner, bar, "level_rank", value, grid)), needs)


_SECTOR_CASE = "CASE WHEN variable = 'Fossil fuels' THEN 1 WHEN variable = 'Low carbon sources' THEN 2 END"
_LEVEL_CASE = ("CASE WHEN variable = 'General spending' THEN 1 WHEN variable = 'Health sector spending' THEN 2 "
               "WHEN variable = 'Liquidity support' THEN 3 WHEN variable = 'Low carbon sources' THEN 4 "
               "WHEN variable = 'Fossil fuels' THEN 5 END")


@register("fig_stimulus_regions", _stacked(
    f"SELECT region, component, stimulus / 1e9 AS value FROM stim_region WHERE region IN {_in(_REG1)}",
    "region", ["stim_region"], _CAT_RANK))
def q_fig_stimulus_regions(spark, d):
    return FG.fig_stimulus_regions(B.stim_region(spark, d), _REG1)


@register("fig_stimulus_economies", _stacked(
    f"SELECT country_code, component, stimulus / 1e9 AS value FROM stim_big WHERE country_code IN {_in(B.ECONOMIES)}",
    "country_code", ["stim_big"], _CAT_RANK))
def q_fig_stimulus_economies(spark, d):
    return FG.fig_stimulus_economies(B.stim_big(spark, d), B.ECONOMIES)


def _fig_inv_sql(regions):
    src = (f"""SELECT region, variable, 'CPol' AS scenario, "CPol" AS value FROM shift_annual WHERE region IN {_in(regions)}
  AND variable IN ('Fossil fuels', 'Low carbon sources')
  UNION ALL SELECT region, variable, '1.5C', "1.5C" FROM shift_annual WHERE region IN {_in(regions)}
  AND variable IN ('Fossil fuels', 'Low carbon sources')""")
    return _stacked(src, "scenario, region", ["shift_annual"], _SECTOR_CASE)


@register("fig_investment_regions", _fig_inv_sql(_REG1))
def q_fig_investment_regions(spark, d):
    return FG.fig_investment(B.shift(spark, d, "mean"), _REG1)


@register("fig_investment_economies", _fig_inv_sql(_INV_ECON))
def q_fig_investment_economies(spark, d):
    return FG.fig_investment(B.shift(spark, d, "mean"), _INV_ECON)


@register("fig_shift", _stacked(f"""SELECT region, variable, shift AS value, net FROM shift_annual
WHERE region IN {_in(_REG1)} AND variable IN ('Fossil fuels', 'Low carbon sources')""", "region", ["shift_annual"],
                                _SECTOR_CASE))
def q_fig_shift(spark, d):
    return FG.fig_shift(B.shift(spark, d, "mean"), _REG1)


@register("fig_shift_economies", _stacked(f"""SELECT region, variable, shift AS value, net FROM shift_annual
WHERE region IN {_in(_INV_ECON)} AND variable IN ('Fossil fuels', 'Low carbon sources')""", "region", ["shift_annual"],
                                          _SECTOR_CASE))
def q_fig_shift_economies(spark, d):
    return FG.fig_shift(B.shift(spark, d, "mean"), _INV_ECON)


def _share_src(regions, measure, unit=None):
    val = f"{measure} / {unit}" if unit else measure
    return (f"SELECT region, invest_type, variable, {val} AS value FROM gdp_shares "
            f"WHERE region IN {_in(regions)} AND scenario = '1.5C' AND variable IS NOT NULL")


@register("fig_gdp_shares_economies", _stacked(
    f"""SELECT s.*, r.type_rank FROM ({_share_src(B.ECONOMIES, 'pct_gdp')}) s JOIN (
  SELECT invest_type, CAST(row_number() OVER (ORDER BY {O.exact_mean('-value')}, invest_type) AS INTEGER) AS type_rank
  FROM ({_share_src(B.ECONOMIES, 'pct_gdp')}) t GROUP BY invest_type) r USING (invest_type)""",
    "region, invest_type", ["gdp_shares"], _LEVEL_CASE))
def q_fig_gdp_shares_economies(spark, d):
    from scenaria.plans.catalog import _gdp_shares
    return FG.fig_gdp_shares_economies(_gdp_shares(spark, d), B.ECONOMIES)


@register("fig_gdp_shares_panels", _stacked(_share_src(_REG1 + B.ECONOMIES, "pct_gdp"), "region, invest_type",
                                            ["gdp_shares"], _LEVEL_CASE))
def q_fig_gdp_shares_panels(spark, d):
    from scenaria.plans.catalog import _gdp_shares
    return FG.fig_gdp_shares_panels(_gdp_shares(spark, d), _REG1 + B.ECONOMIES)


@register("fig_usd_panels", _stacked(_share_src(_REG1 + B.ECONOMIES, "avg_invest", "1e9"), "region, invest_type",
                                     ["gdp_shares"], _LEVEL_CASE, grid=110))
def q_fig_usd_panels(spark, d):
    from scenaria.plans.catalog import _gdp_shares
    return FG.fig_usd_panels(_gdp_shares(spark, d), _REG1 + B.ECONOMIES)


@register("fig_model_spread", O.sql(f"""SELECT region, variable, {O.strict('min', 'shift')} AS ymin,
  {O.strict('max', 'shift')} AS ymax, {O.strict_mean('shift')} AS y, {O.strict_mean('shift')} AS bar
FROM model_spread_raw WHERE region IN {_in(_REG1)} GROUP BY 1, 2""", ["model_spread_raw"]))
def q_fig_model_spread(spark, d):
    return FG.fig_model_spread(I.model_spread_shift(B.invest(spark, d), 1995), _REG1)
