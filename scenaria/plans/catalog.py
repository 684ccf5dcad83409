"""Registered queries: one per operator / result table, each with the SQL statement of the same result.

Every query reads the driver's tables (through ``bindings``) and runs over whole tables. Sums and means do not depend on the
order of rows (``functions.exact``), on both sides, so results are compared bit for bit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenaria.plans import bindings as B
from scenaria.plans import gdp as G
from scenaria.plans import investment as I
from scenaria.plans import oracle as O
from scenaria.plans import shares as SH
from scenaria.plans import stimulus as S


@dataclass
class Entry:
    build: Callable[[SparkSession, str], DataFrame]
    sql: O.Stmt | str | None

    def run(self, spark: SparkSession, d: str) -> DataFrame:
        return self.build(spark, d)

    def oracle(self) -> str | None:
        return self.sql.render() if isinstance(self.sql, O.Stmt) else self.sql


REGISTRY: dict[str, Entry] = {}


def register(key: str, sql):
    """Register a query with the SQL statement of the same result."""
    def deco(fn):
        REGISTRY[key] = Entry(fn, sql)
        return fn
    return deco


# =========================================================================================== results (D)

@register("region_dimension", O.sql("SELECT country, region, country_code FROM region_dim", ["region_dim"]))
def q_region_dimension(spark, d):
    return B.region_dim(spark, d).select("country", "region", "country_code")


@register("stimulus_components", O.sql("SELECT country_code, region, component, stimulus FROM stim_long", ["stim_long"]))
def q_stimulus_components(spark, d):
    return B.stim_long(spark, d)


@register("stimulus_by_income", O.sql("""SELECT incomegroup, sum_inc_group, g AS global, sum_inc_group / g AS share FROM (
  SELECT incomegroup, CASE WHEN count(*) = count(stimulus) THEN sum(stimulus) END AS sum_inc_group
  FROM (SELECT l.stimulus, CASE WHEN l.country_code = 'EU' THEN 'High income' ELSE i.incomegroup END AS incomegroup
        FROM stim_long l LEFT JOIN income_dim i ON l.country_code = i.countrycode) j GROUP BY incomegroup) a
CROSS JOIN (SELECT CASE WHEN count(*) = count(stimulus) THEN sum(stimulus) END AS g FROM stim_long) t""",
                                      ["stim_long", "income_dim"]))
def q_stimulus_by_income(spark, d):
    return S.stimulus_by_income(B.stim_long(spark, d), B.income_dim(spark, d))


O.cte("income_dim", ["nat"], """SELECT countrycode, incomegroup FROM (
  SELECT country_code AS countrycode, c_mktsegment AS incomegroup,
         row_number() OVER (PARTITION BY country_code ORDER BY n DESC, c_mktsegment DESC) AS rn
  FROM (SELECT nat.country_code, c_mktsegment, count(*) AS n FROM customer JOIN nat ON c_nationkey = nat.n_nationkey
        GROUP BY 1, 2) c) t
WHERE rn = 1 AND incomegroup <> 'HOUSEHOLD'""")


@register("stimulus_table_s1", O.sql("SELECT * FROM stim_s1", ["stim_s1"]))
def q_stimulus_table_s1(spark, d):
    return B.stim_s1(spark, d)


@register("stimulus_big_economies", O.sql("SELECT * FROM stim_big", ["stim_big"]))
def q_stimulus_big_economies(spark, d):
    return B.stim_big(spark, d)


@register("stimulus_by_region", O.sql("SELECT component, region, stimulus FROM stim_region", ["stim_region"]))
def q_stimulus_by_region(spark, d):
    return B.stim_region(spark, d)


@register("stimulus_master", O.sql("SELECT region, component, stimulus FROM stim_master", ["stim_master"]))
def q_stimulus_master(spark, d):
    return B.stim_master(spark, d)


def _checks_sql() -> str:
    def total(src, pred):
        return ("SELECT region, component, stimulus, CASE WHEN count(*) OVER () = count(stimulus) OVER () "
                "THEN sum(stimulus) OVER () END AS total "
                f"FROM {src} WHERE {pred}")
    parts = [
        ("g20", "(SELECT country_code AS region, component, stimulus FROM stim_big)",
         "region IN ('N05','N06','N07','EU','N10','N15')"),
        ("bloc", "(SELECT country_code AS region, component, stimulus FROM stim_big)", "region = 'EU'"),
        ("region", "stim_region", "region = 'EUROPE'"),
        ("world", "stim_region", "region = 'World'"),
        ("single", "stim_master", "region = 'N05'"),
    ]
    body = "\nUNION ALL\n".join(f"SELECT '{n}' AS \"check\", * FROM ({total(src, p)}) x{i}"
                                for i, (n, src, p) in enumerate(parts))
    return O.sql(body, ["stim_big", "stim_region", "stim_master"])


@register("stimulus_control_totals", _checks_sql())
def q_stimulus_control_totals(spark, d):
    big, reg = B.stim_big(spark, d), B.stim_region(spark, d)
    return S.control_totals(big, reg, B.G20_CODES, "EU", "EUROPE", "World", "N05")


@register("investment_prep", O.sql("SELECT model, region, scenario, variable, year, investment FROM invest_prep",
                                   ["invest_prep"]))
def q_investment_prep(spark, d):
    return B.invest_prep(spark, d)


@register("investment_annual", O.sql("SELECT * FROM invest_annual", ["invest_annual"]))
def q_investment_annual(spark, d):
    return B.invest_annual(spark, d)


@register("investment_two_sector", O.sql("SELECT * FROM invest", ["invest"]))
def q_investment_two_sector(spark, d):
    return B.invest(spark, d)


@register("shift_annual", O.sql("SELECT * FROM shift_annual", ["shift_annual"]))
def q_shift_annual(spark, d):
    return B.shift(spark, d, "mean")


@register("shift_five_year", O.sql("SELECT * FROM shift_5y", ["shift_5y"]))
def q_shift_five_year(spark, d):
    return B.shift(spark, d, "sum")


O.cte("envelope_s1", ["invest"], f"""SELECT region, variable, scenario, year, {O.strict_mean('investment')} AS mm,
  {O.strict('max', 'investment')} AS mx, {O.strict('min', 'investment')} AS mn,
  max(CASE WHEN model = 'ECONOMY' THEN 1 ELSE 0 END) AS has_anchor
FROM invest WHERE year BETWEEN 1995 AND 1999 AND scenario IN ('1.5C', 'CPol') GROUP BY 1, 2, 3, 4""")
O.cte("envelope", ["envelope_s1"], f"""SELECT scenario, region, variable, annual, annual_max, annual_min FROM (
  SELECT region, variable, scenario, {O.strict_mean('mm')} AS annual, {O.strict_mean('mx')} AS annual_max,
         {O.strict_mean('mn')} AS annual_min, max(CASE WHEN year = 1995 THEN 1 ELSE 0 END) AS has_rep
  FROM envelope_s1 WHERE has_anchor = 1 GROUP BY 1, 2, 3) t WHERE has_rep = 1""")


@register("investment_envelope", O.sql("SELECT * FROM envelope", ["envelope"]))
def q_investment_envelope(spark, d):
    return I.investment_envelope(B.invest(spark, d), 1995, 1999, 1995, B.ANCHOR)


O.two_stage_sql("total_invest", 1995, 1999, 1995, "sum", "total", ("1.5C", "CPol"))


@register("investment_total", O.sql("SELECT scenario, region, variable, total FROM total_invest", ["total_invest"]))
def q_investment_total(spark, d):
    return I.investment_total(B.invest(spark, d), 1995, 1999, 1995, B.ANCHOR)


@register("gdp_selected", O.sql("SELECT region, gdp FROM gdp_selected", ["gdp_selected"]))
def q_gdp_selected(spark, d):
    return G.gdp_selected(B.gdp_wide(spark, d), B.GDP_YEAR, B.SELECTED, "EU", B.EU_GDP)


@register("gdp_by_region", O.sql("SELECT region, gdp FROM gdp_by_region", ["gdp_by_region"]))
def q_gdp_by_region(spark, d):
    return G.gdp_by_region(B.gdp_wide(spark, d), B.region_dim(spark, d), B.GDP_YEAR, B.BLOC_SHEET_REGION)


@register("gdp_master", O.sql("SELECT region, gdp FROM gdp_master", ["gdp_master"]))
def q_gdp_master(spark, d):
    return B.gdp_master(spark, d)


@register("gdp_by_country", O.sql("SELECT country_code, gdp FROM gdp_country", ["gdp_country"]))
def q_gdp_by_country(spark, d):
    return B.gdp_country(spark, d)


@register("stimulus_gdp_table", O.sql("""SELECT s.region, s.general_spending, s.health_sector_spending, s.liquidity_support,
  s.country, s.total, x.iso3 AS country_code, g.gdp, (s.total / g.gdp) * 1e11 AS gdp_share
FROM (SELECT *, general_spending + health_sector_spending + liquidity_support AS total FROM stim_s1) s
LEFT JOIN (SELECT lower(trim(country_name)) AS nm, min(iso3) AS iso3 FROM xwalk GROUP BY 1) x ON lower(trim(s.country)) = x.nm
LEFT JOIN gdp_country g ON g.country_code = x.iso3""", ["stim_s1", "xwalk", "gdp_country"]))
def q_stimulus_gdp_table(spark, d):
    return SH.stimulus_gdp_table(B.stim_s1(spark, d), B.xwalk(spark, d), B.gdp_country(spark, d))


@register("stimulus_gdp_share", O.sql("""SELECT t.country_code, r.region, t.total_stim, g.gdp, (t.total_stim / g.gdp) * 100.0 AS pct_gdp
FROM (SELECT country_code, CASE WHEN count(*) = count(stimulus) THEN sum(stimulus) END AS total_stim
      FROM stim_long GROUP BY 1) t
JOIN (SELECT country_code, arg_min(region, component) AS region FROM stim_long GROUP BY 1) r USING (country_code)
LEFT JOIN gdp_country g USING (country_code)""", ["stim_long", "gdp_country"]))
def q_stimulus_gdp_share(spark, d):
    return SH.stimulus_gdp_share(B.stim_long(spark, d), B.gdp_country(spark, d))


O.cte("stim_prep", ["stim_master", "gdp_master"], """SELECT m.region, m.component AS variable, m.stimulus / 1e9 AS avg_invest,
  g.gdp, (m.stimulus / g.gdp) * 100.0 AS pct_gdp, 'Stimulus' AS invest_type, s.scenario
FROM stim_master m LEFT JOIN gdp_master g ON m.region = g.region
CROSS JOIN (SELECT '1.5C' AS scenario UNION ALL SELECT 'CPol') s""")


def _shift_prep_sql(src: str, label: str) -> str:
    return f"""SELECT m.region, m.variable, m.shift AS avg_invest, g.gdp,
  ((m.shift * 1e9) / g.gdp) * 100.0 AS pct_gdp, '{label}' AS invest_type, s.scenario
FROM {src} m LEFT JOIN gdp_master g ON m.region = g.region
CROSS JOIN (SELECT '1.5C' AS scenario UNION ALL SELECT 'CPol') s"""


O.cte("shift_prep", ["shift_annual", "gdp_master"], _shift_prep_sql("shift_annual", "Investment shift"))
O.cte("shift_prep_5y", ["shift_5y", "gdp_master"], _shift_prep_sql("shift_5y", "Investment shift (5 years)"))


@register("stimulus_prep", O.sql("SELECT * FROM stim_prep", ["stim_prep"]))
def q_stimulus_prep(spark, d):
    return SH.stimulus_prep(B.stim_master(spark, d), B.gdp_master(spark, d), B.scenarios(spark))


@register("shift_prep", O.sql("SELECT * FROM shift_prep", ["shift_prep"]))
def q_shift_prep(spark, d):
    return SH.shift_prep(B.shift(spark, d, "mean"), B.gdp_master(spark, d), B.scenarios(spark))


@register("shift_prep_5y", O.sql("SELECT * FROM shift_prep_5y", ["shift_prep_5y"]))
def q_shift_prep_5y(spark, d):
    return SH.shift_prep(B.shift(spark, d, "sum"), B.gdp_master(spark, d), B.scenarios(spark),
                         "Investment shift (5 years)")


O.two_stage_sql("energy_avg", 1995, 2000, 1995, "mean", "avg_invest")
_LEVELS = ("General spending", "Health sector spending", "Liquidity support", "Low carbon sources", "Fossil fuels")
_LEVEL_CASE = "CASE " + " ".join(f"WHEN variable = '{v}' THEN {i + 1}" for i, v in enumerate(_LEVELS)) + " END"
O.cte("gdp_shares", ["energy_avg", "gdp_master", "stim_prep", "shift_prep", "shift_prep_5y"], f"""SELECT scenario, region,
  CASE WHEN {_LEVEL_CASE} IS NOT NULL THEN variable END AS variable, avg_invest, gdp, pct_gdp, invest_type,
  {_LEVEL_CASE} AS variable_rank
FROM (
  SELECT e.scenario, e.region, e.variable, e.avg_invest, g.gdp, (e.avg_invest / g.gdp) * 100.0 AS pct_gdp,
         'Energy investment' AS invest_type
  FROM energy_avg e LEFT JOIN gdp_master g ON e.region = g.region WHERE e.scenario IN ('1.5C', 'CPol')
  UNION ALL SELECT scenario, region, variable, avg_invest, gdp, pct_gdp, invest_type FROM stim_prep
  UNION ALL SELECT scenario, region, variable, avg_invest, gdp, pct_gdp, invest_type FROM shift_prep
  UNION ALL SELECT scenario, region, variable, avg_invest, gdp, pct_gdp, invest_type FROM shift_prep_5y
) u WHERE scenario = '1.5C'""")


@B._memo
def _gdp_shares(spark, d):
    """Figure-1 table, stored once (result-sized): the charts and orderings read it."""
    inv = B.invest(spark, d)
    gm = B.gdp_master(spark, d)
    sc = B.scenarios(spark)
    energy = I.energy_average(inv, 1995, 2000, 1995, B.ANCHOR)
    return B._materialize(SH.gdp_shares(energy, gm, SH.stimulus_prep(B.stim_master(spark, d), gm, sc),
                         SH.shift_prep(B.shift(spark, d, "mean"), gm, sc),
                         SH.shift_prep(B.shift(spark, d, "sum"), gm, sc, "Investment shift (5 years)")), "gdp-shares")


@register("gdp_shares", O.sql("SELECT * FROM gdp_shares", ["gdp_shares"]))
def q_gdp_shares(spark, d):
    return _gdp_shares(spark, d)


@register("map_region_dimension", O.sql("SELECT country_code, region, country FROM map_dim", ["map_dim"]))
def q_map_region_dimension(spark, d):
    return B.map_dim(spark, d).select("country_code", "region", "country")


@register("map_gdp", O.sql("""SELECT country_code, year, gdp FROM (
  SELECT country_code, 1995 AS year, x1995 AS gdp FROM gdp_wide UNION ALL SELECT country_code, 1996, x1996 FROM gdp_wide
  UNION ALL SELECT country_code, 1997, x1997 FROM gdp_wide UNION ALL SELECT country_code, 1998, x1998 FROM gdp_wide
  UNION ALL SELECT country_code, 1999, x1999 FROM gdp_wide UNION ALL SELECT country_code, 2000, x2000 FROM gdp_wide
  UNION ALL SELECT country_code, 2001, x2001 FROM gdp_wide) t WHERE year = 2000""", ["gdp_wide"]))
def q_map_gdp(spark, d):
    long = G.gdp_long(B.gdp_wide(spark, d), "x1995", "x2001")
    return long.filter(F.col("year") == B.GDP_YEAR)


@register("map_region_stimulus", O.sql("""SELECT *, total_stim_reg / gdp_reg AS pct_gdp FROM (
  SELECT j.*,
    CASE WHEN count(*) OVER (PARTITION BY region, component) = count(stimulus) OVER (PARTITION BY region, component)
         THEN sum(stimulus) OVER (PARTITION BY region, component) END AS stim_reg,
    coalesce(sum(gdp) OVER (PARTITION BY region, component), 0.0) AS gdp_reg,
    coalesce(sum(stimulus) OVER (PARTITION BY region), 0.0) AS total_stim_reg
  FROM (SELECT l.country_code, l.component, l.stimulus, m.region, g.gdp
        FROM stim_long l LEFT JOIN (SELECT DISTINCT country_code, region FROM map_dim) m ON l.country_code = m.country_code
        LEFT JOIN gdp_country g ON l.country_code = g.country_code) j) t""",
                                         ["stim_long", "map_dim", "gdp_country"]))
def q_map_region_stimulus(spark, d):
    return SH.map_region_stats(B.map_rows(spark, d))


O.cte("spread_per_model", ["invest"], f"""SELECT region, variable, model, scenario, {O.strict_mean('investment')} AS annual_avg
FROM invest GROUP BY 1, 2, 3, 4 HAVING max(CASE WHEN year = 1995 THEN 1 ELSE 0 END) = 1""")
O.cte("model_spread", ["spread_per_model"], f"""SELECT model, region, variable, year, "1.5C", "CPol", shift,
  CASE WHEN count(*) OVER w = count(shift) OVER w THEN {O.exact_mean('shift', ' OVER w')} END AS mean_shift,
  CASE WHEN count(*) OVER w = count(shift) OVER w THEN max(shift) OVER w END AS max_shift,
  CASE WHEN count(*) OVER w = count(shift) OVER w THEN min(shift) OVER w END AS min_shift
FROM (SELECT region, variable, model, 1995 AS year, max(CASE WHEN scenario = '1.5C' THEN annual_avg END) AS "1.5C",
        max(CASE WHEN scenario = 'CPol' THEN annual_avg END) AS "CPol",
        max(CASE WHEN scenario = '1.5C' THEN annual_avg END) - max(CASE WHEN scenario = 'CPol' THEN annual_avg END) AS shift
      FROM spread_per_model GROUP BY 1, 2, 3) t
WINDOW w AS (PARTITION BY region, variable)""")


@register("model_spread_shift", O.sql("SELECT * FROM model_spread", ["model_spread"]))
def q_model_spread_shift(spark, d):
    return I.model_spread_shift(B.invest(spark, d), 1995)


O.cte("july", ["orders_nat", "nat"], """SELECT j.*, nat.country, nat.region FROM (
  SELECT country_code,
    CAST(sum(CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN cents END) AS DOUBLE) AS individuals_households,
    CAST(sum(CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' THEN cents END) AS DOUBLE) AS health,
    CAST(sum(CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '3-MEDIUM' THEN cents END) AS DOUBLE) AS business,
    CAST(sum(CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '4-NOT SPECIFIED' THEN cents END) AS DOUBLE) AS deferrals,
    CAST(sum(CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN cents END) AS DOUBLE) AS loans_guarantees,
    CAST(sum(CASE WHEN o_orderstatus <> 'F' THEN cents END) AS DOUBLE) AS uncategorized_other
  FROM orders_nat GROUP BY country_code) j JOIN nat USING (country_code)""")


@register("stimulus_july_table", O.sql("""SELECT country_code, CASE WHEN region = 'EUROPE' THEN 'OECD+' ELSE region END AS region,
  (((coalesce(individuals_households, 0.0) + coalesce(business, 0.0)) + coalesce(deferrals, 0.0))
     + coalesce(uncategorized_other, 0.0)) / 1e9 AS general_spending,
  coalesce(health, 0.0) / 1e9 AS health_sector_spending, coalesce(loans_guarantees, 0.0) / 1e9 AS liquidity_support, country
FROM july""", ["july"]))
def q_stimulus_july_table(spark, d):
    return S.stimulus_july_table(B.july_wide(spark, d), {"EUROPE": "OECD+"})
