"""Plain-SQL statements of the same bindings and result tables, for an independent SQL engine (DuckDB).

Each building block is a named CTE with its dependencies; ``sql(final, needs)`` assembles a statement.
They restate the rules of the Spark plans in set-based SQL (conditional aggregation for pivots,
``CASE WHEN count(*) = count(x)`` for strict aggregates, window lookups for interpolation).
"""

from __future__ import annotations

from collections.abc import Sequence

CENTS = "CAST(round({c} * 100) AS BIGINT)"


def _case_recode(col: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {whens} ELSE {col} END"


CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: Sequence[str], body: str) -> None:
    CTES[name] = (tuple(deps), body)


def _resolve(names: Sequence[str], out: list[str]) -> None:
    for n in names:
        if n in out:
            continue
        deps, _ = CTES[n]
        _resolve(deps, out)
        if n not in out:
            out.append(n)


class Stmt:
    """A final SELECT plus the CTE names it needs; rendered lazily, once every CTE is defined."""

    def __init__(self, final: str, needs: Sequence[str] = ()):
        self.final, self.needs = final, tuple(needs)

    def render(self) -> str:
        return render(self.final, self.needs)


def sql(final: str, needs: Sequence[str] = ()) -> Stmt:
    return Stmt(final, needs)


def render(final: str, needs: Sequence[str] = ()) -> str:
    order: list[str] = []
    _resolve(needs, order)
    if not order:
        return final
    parts = ",\n".join(f"{n} AS (\n{CTES[n][1]}\n)" for n in order)
    return f"WITH {parts}\n{final}"


#: Steps of 2**-GRID in which the SQL adds values, as whole numbers of 128 bits.
GRID = 70


def exact_sum(x: str, over: str = "", grid: int = GRID) -> str:
    """The sum of ``x``, rounded once, as ``functions.exact.exact_sum`` gives it, for sums below 2**56 of values that are
    whole steps of 2**-GRID; a finer grid holds smaller sums."""
    t = f"sum(CAST(({x}) * CAST({2**grid} AS DOUBLE) AS HUGEINT)){over}"
    shift = f"greatest(CAST(floor(log2(CAST(abs({t}) AS DOUBLE))) AS INTEGER) - 55, 0)"
    step = f"(CAST(1 AS HUGEINT) << CAST({shift} AS HUGEINT))"
    lead = f"(CAST(abs({t}) // {step} AS BIGINT) | CASE WHEN abs({t}) % {step} <> 0 THEN 1 ELSE 0 END)"
    return (f"CASE WHEN {t} = 0 THEN CAST(0 AS DOUBLE) ELSE sign({t}) * CAST({lead} AS DOUBLE) * pow(CAST(2 AS DOUBLE), {shift} - {grid}) END")


def exact_mean(x: str, over: str = "") -> str:
    return f"({exact_sum(x, over)}) / count({x}){over}"


def strict(fn: str, x: str) -> str:
    return f"CASE WHEN count(*) = count({x}) THEN {exact_sum(x) if fn == 'sum' else f'{fn}({x})'} END"


def strict_mean(x: str) -> str:
    return f"CASE WHEN count(*) = count({x}) THEN {exact_mean(x)} END"


def skipna_sum(x: str) -> str:
    return f"coalesce({exact_sum(x)}, 0.0)"


# --- bindings ------------------------------------------------------------------------------------------

cte("nat", [], """SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS country_code, upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS country,
       n_nationkey, r_name AS region
FROM nation JOIN region ON n_regionkey = r_regionkey""")

cte("xwalk", ["nat"], "SELECT country AS country_name, country_code AS iso3 FROM nat")

cte("region_sheet", ["nat"], """SELECT country, region, CAST(n_nationkey AS INTEGER) AS sheet_order FROM nat
UNION ALL SELECT 'European Union', 'BLOC', 1000 UNION ALL SELECT 'Nation_8', 'ASIA', -1 UNION ALL SELECT 'Nation_7', 'AFRICA', 1007""")

cte("region_dim", ["region_sheet", "xwalk"], """SELECT country, region, sheet_order, CASE WHEN c1 = 'EUM' THEN 'NAM' ELSE c1 END AS country_code
FROM (
  SELECT s.country, s.sheet_order, """ + _case_recode("s.region", {"MIDDLE EAST": "MIDEAST"}) + """ AS region,
         regexp_replace(coalesce(x.iso3, 'NA'), 'NA', 'EU') AS c1
  FROM region_sheet s
  LEFT JOIN (SELECT lower(trim(regexp_replace(country_name, '\\s+', ' ', 'g'))) AS nm, min(iso3) AS iso3
             FROM xwalk GROUP BY 1) x
    ON lower(trim(regexp_replace(s.country, '\\s+', ' ', 'g'))) = x.nm
) t
WHERE NOT (country = 'Nation_24')""")

cte("region_first", ["region_dim"], """SELECT country_code, region FROM (
  SELECT *, row_number() OVER (PARTITION BY country_code ORDER BY sheet_order, country, region) AS rn FROM region_dim) t WHERE rn = 1""")

cte("orders_nat", ["nat"], f"""SELECT o_orderpriority, o_orderstatus, {CENTS.format(c='o_totalprice')} AS cents, nat.country_code
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nat ON c_nationkey = nat.n_nationkey""")


def _part(prio: str, status_pred: str = "o_orderstatus <> 'P'") -> str:
    return f"CAST(sum(CASE WHEN {status_pred} AND o_orderpriority = '{prio}' THEN cents END) AS DOUBLE)"


cte("stim_wide", ["orders_nat"], f"""SELECT country_code,
  {_part('1-URGENT')} AS health, {_part('2-HIGH')} AS non_health, {_part('3-MEDIUM')} AS loans_guarantees,
  {_part('4-NOT SPECIFIED')} AS deferrals,
  CAST(sum(CASE WHEN o_orderstatus = 'P' AND country_code NOT IN ('N00','N01','N02','N03','N04') THEN cents END) AS DOUBLE) AS international_aid,
  CAST(sum(CASE WHEN o_orderstatus <> 'P' THEN cents END) AS DOUBLE) AS total
FROM orders_nat GROUP BY country_code
UNION ALL SELECT 'EU', {_part('1-URGENT', "o_orderstatus = 'P'")}, {_part('2-HIGH', "o_orderstatus = 'P'")}, {_part('3-MEDIUM', "o_orderstatus = 'P'")},
  {_part('4-NOT SPECIFIED', "o_orderstatus = 'P'")}, CAST(NULL AS DOUBLE), CAST(sum(cents) AS DOUBLE)
FROM orders_nat WHERE o_orderstatus = 'P' AND country_code IN ('N00','N01','N02','N03','N04') GROUP BY ()  HAVING count(*) > 0""")

cte("stim_cat", ["stim_wide", "region_first"], """SELECT w.country_code, d.region,
  coalesce(health, 0.0) AS h, coalesce(non_health, 0.0) AS nh, coalesce(loans_guarantees, 0.0) AS lg,
  coalesce(deferrals, 0.0) AS df, coalesce(total, 0.0) AS tot
FROM stim_wide w LEFT JOIN region_first d ON w.country_code = d.country_code""")

cte("stim_long", ["stim_cat"], """SELECT country_code, region, 'Health sector spending' AS component, h AS stimulus FROM stim_cat
UNION ALL SELECT country_code, region, 'General spending', (nh + (tot - (((df + h) + lg) + nh))) + df FROM stim_cat
UNION ALL SELECT country_code, region, 'Liquidity support', lg FROM stim_cat""")

cte("stim_rolled", ["stim_long"], """SELECT CASE WHEN country_code IN ('N00','N01','N02','N03','N04','EU') THEN 'EU'
  ELSE country_code END AS country_code, region, component, stimulus FROM stim_long""")

cte("big_per_region", ["stim_rolled"], f"""SELECT country_code, region, component, {skipna_sum('stimulus')} AS s
FROM stim_rolled WHERE country_code IN ('N05','EU','N10','N15') GROUP BY 1, 2, 3""")

cte("stim_big", ["big_per_region"], """SELECT p.country_code, p.region, p.component, t.stimulus
FROM big_per_region p JOIN (SELECT country_code, component, sum(s) AS stimulus FROM big_per_region GROUP BY 1, 2) t
  USING (country_code, component)
WHERE NOT (p.region = 'BLOC')""")

cte("stim_recoded", ["stim_long"], f"""SELECT country_code, {_case_recode('region', {'BLOC': 'EUROPE'})} AS region,
  component, stimulus FROM stim_long""")

cte("region_sums", ["stim_recoded"], f"""SELECT region, component, {skipna_sum('stimulus')} AS stimulus
FROM stim_recoded WHERE region IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT 'World', component, {strict('sum', 'stimulus')} FROM stim_recoded GROUP BY component""")

cte("stim_region", ["region_sums"], """SELECT c.component, r.region, s.stimulus
FROM (SELECT DISTINCT component FROM region_sums) c
CROSS JOIN (SELECT DISTINCT region FROM region_sums) r
LEFT JOIN region_sums s ON s.component = c.component AND s.region = r.region""")

cte("stim_master", ["stim_big", "stim_region"], """SELECT country_code AS region, component, stimulus FROM stim_big
UNION ALL SELECT region, component, stimulus FROM stim_region""")

cte("stim_s1", ["stim_long", "xwalk"], """SELECT w.country_code, w.region,
  w.general_spending, w.health_sector_spending, w.liquidity_support,
  regexp_replace(coalesce(x.nm, 'NA'), 'NA', 'European Union') AS country
FROM (
  SELECT country_code, region,
    max(CASE WHEN component = 'General spending' THEN stimulus / 1e9 END) AS general_spending,
    max(CASE WHEN component = 'Health sector spending' THEN stimulus / 1e9 END) AS health_sector_spending,
    max(CASE WHEN component = 'Liquidity support' THEN stimulus / 1e9 END) AS liquidity_support
  FROM stim_long GROUP BY 1, 2
) w LEFT JOIN (SELECT iso3, min(country_name) AS nm FROM xwalk GROUP BY iso3) x ON w.country_code = x.iso3""")

# investment
cte("invest_cells", ["nat"], f"""SELECT p_type AS model, 'R5' || nat.region AS region, l_linestatus AS scenario,
  l_returnflag AS variable, CAST(year(l_shipdate) AS INTEGER) AS year,
  CAST(sum({CENTS.format(c='l_extendedprice')}) AS BIGINT) AS cents
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nat ON s_nationkey = nat.n_nationkey
GROUP BY 1, 2, 3, 4, 5""")


def _cell(year: int, of: str, bad: bool) -> str:
    cents = f"CAST(sum(CASE WHEN {of} THEN cents END) AS VARCHAR)"
    txt = f"CASE WHEN variable = 'R' THEN {cents} || '%' ELSE {cents} END"
    if bad:
        txt = f"CASE WHEN model = 'PROMO' AND region = 'R5ASIA' AND scenario = 'F' AND variable = 'A' THEN '#VALUE!' ELSE {txt} END"
    return f'{txt} AS "{year}"'


cte("invest_sheet", ["invest_cells"], f"""SELECT model AS "Model", region AS "Region", scenario AS "Scenario",
  variable AS "Variable", {_cell(1995, 'year < 2000', False)}, {_cell(2000, 'year >= 2000', True)}, {_cell(2001, 'year = 2001', False)}
FROM invest_cells GROUP BY 1, 2, 3, 4""")

_REG = {"R5AFRICA": "AFRICA", "R5AMERICA": "AMERICA", "R5ASIA": "ASIA", "R5EUROPE": "EUROPE",
        "R5MIDDLE EAST": "MIDEAST"}
_SCN = {"O": "1.5C", "F": "CPol"}


def _prep_year(y: int) -> str:
    return (f"""SELECT "Model" AS model, {_case_recode('"Region"', _REG)} AS region,
  {_case_recode('"Scenario"', _SCN)} AS scenario, "Variable" AS variable, {y} AS year,
  TRY_CAST(regexp_replace("{y}", '%', '') AS DOUBLE) AS investment
FROM invest_sheet WHERE "Variable" IN ('A', 'N', 'R')""")


cte("invest_prep", ["invest_sheet"], _prep_year(1995) + "\nUNION ALL\n" + _prep_year(2000))

_K = "scenario, model, region, variable"
cte("interp_knots", ["invest_prep"], f"SELECT {_K}, year, {exact_mean('investment')} AS y FROM invest_prep GROUP BY {_K}, year")
cte("interp_staged", ["interp_knots"], f"""SELECT {_K}, year, y,
  count(y) OVER (PARTITION BY {_K}) AS n,
  last_value(CASE WHEN y IS NOT NULL THEN year END IGNORE NULLS) OVER (PARTITION BY {_K} ORDER BY year
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS px,
  last_value(y IGNORE NULLS) OVER (PARTITION BY {_K} ORDER BY year
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS py,
  first_value(CASE WHEN y IS NOT NULL THEN year END IGNORE NULLS) OVER (PARTITION BY {_K} ORDER BY year
      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS qx,
  first_value(y IGNORE NULLS) OVER (PARTITION BY {_K} ORDER BY year
      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS qy,
  lead(year) OVER (PARTITION BY {_K} ORDER BY year) AS next_x
FROM interp_knots""")
cte("interp", ["interp_staged"], f"""SELECT {_K}, CAST(t AS INTEGER) AS year,
  CAST(CASE WHEN n < 2 THEN NULL WHEN t = px THEN py
       WHEN px IS NOT NULL AND qx IS NOT NULL THEN py + (qy - py) * (CAST(t - px AS DOUBLE) / CAST(qx - px AS DOUBLE))
  END AS DOUBLE) AS investment
FROM (SELECT *, unnest(generate_series(year, coalesce(next_x - 1, year))) AS t FROM interp_staged) g""")
cte("invest_annual", ["interp", "invest_prep"], """SELECT i.scenario, i.model, r.region, i.variable, i.year, i.investment
FROM interp i RIGHT JOIN (SELECT DISTINCT region FROM invest_prep) r ON i.region = r.region""")

cte("invest_wide", ["invest_annual"], """SELECT model, region, scenario, year,
  max(CASE WHEN variable = 'A' THEN investment END) AS a,
  max(CASE WHEN variable = 'N' THEN investment END) AS n,
  max(CASE WHEN variable = 'R' THEN investment END) AS r
FROM invest_annual GROUP BY 1, 2, 3, 4""")
cte("invest", ["invest_wide"], """SELECT model, region, scenario, 'Fossil fuels' AS variable, year,
  a * CAST(1.0728 AS DOUBLE) AS investment FROM invest_wide
UNION ALL SELECT model, region, scenario, 'Low carbon sources', year, (n + r) * CAST(1.0728 AS DOUBLE) FROM invest_wide""")


def two_stage_sql(name: str, first: int, last: int, rep: int, period_stat: str = "mean", out: str = "value",
                  scenarios: Sequence[str] | None = None, src: str = "invest") -> None:
    scen = "" if scenarios is None else " AND scenario IN (" + ", ".join(f"'{s}'" for s in scenarios) + ")"
    stat2 = strict_mean("m") if period_stat == "mean" else strict("sum", "m")
    cte(f"{name}_s1", [src], f"""SELECT region, variable, scenario, year, {strict_mean('investment')} AS m,
  max(CASE WHEN model = 'ECONOMY' THEN 1 ELSE 0 END) AS has_anchor
FROM {src} WHERE year BETWEEN {first} AND {last}{scen} GROUP BY 1, 2, 3, 4""")
    cte(name, [f"{name}_s1"], f"""SELECT region, variable, scenario, {out} FROM (
  SELECT region, variable, scenario, {stat2} AS {out}, max(CASE WHEN year = {rep} THEN 1 ELSE 0 END) AS has_rep
  FROM {name}_s1 WHERE has_anchor = 1 GROUP BY 1, 2, 3) t WHERE has_rep = 1""")


two_stage_sql("stage_mean", 1995, 1999, 1995, "mean")
two_stage_sql("stage_sum", 1995, 1999, 1995, "sum")


def shift_sql(name: str, stage: str) -> None:
    cte(f"{name}_diff", [stage], f"""SELECT region, variable, 1995 AS year,
  max(CASE WHEN scenario = '1.5C' THEN value END) AS "1.5C", max(CASE WHEN scenario = 'CPol' THEN value END) AS "CPol"
FROM {stage} GROUP BY 1, 2""")
    cte(name, [f"{name}_diff"], f"""SELECT region, variable, year, "1.5C", "CPol", "1.5C" - "CPol" AS shift,
  CASE WHEN count(*) OVER (PARTITION BY region) = count("1.5C" - "CPol") OVER (PARTITION BY region)
       THEN {exact_sum('"1.5C" - "CPol"', " OVER (PARTITION BY region)")} END AS net
FROM {name}_diff""")


shift_sql("shift_annual", "stage_mean")
shift_sql("shift_5y", "stage_sum")

# GDP
cte("gdp_nat", ["nat"], f"""SELECT nat.country_code, nat.country, CAST(year(l_shipdate) AS INTEGER) AS year,
  sum({CENTS.format(c='l_extendedprice')}) AS cents
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nat ON s_nationkey = nat.n_nationkey GROUP BY 1, 2, 3""")

_Y = range(1995, 2002)
cte("gdp_wide", ["gdp_nat"], "SELECT country AS country_name, country_code, 'GDP (current US$)' AS indicator_name, "
    "'NY.GDP.MKTP.CD' AS indicator_code, "
    + ", ".join(f"CAST(max(CASE WHEN year = {y} THEN cents END) AS DOUBLE) AS x{y}" for y in _Y)
    + " FROM gdp_nat GROUP BY country_code, country\nUNION ALL SELECT 'World', 'WLD', 'GDP (current US$)', "
    "'NY.GDP.MKTP.CD', " + ", ".join(f"CAST(sum(CASE WHEN year = {y} THEN cents END) AS DOUBLE)" for y in _Y)
    + " FROM gdp_nat")

cte("gdp_by_region", ["gdp_wide", "region_first"], """SELECT region, gdp FROM (
  SELECT d.region, coalesce(sum(g.x2000), 0.0) AS gdp
  FROM gdp_wide g LEFT JOIN region_first d ON g.country_code = d.country_code
  WHERE NOT (d.region = 'BLOC') GROUP BY d.region) r
UNION ALL SELECT 'World', coalesce(sum(gdp), 0.0) FROM (
  SELECT coalesce(sum(g.x2000), 0.0) AS gdp
  FROM gdp_wide g LEFT JOIN region_first d ON g.country_code = d.country_code
  WHERE NOT (d.region = 'BLOC') GROUP BY d.region) w""")
cte("gdp_selected", ["gdp_wide"], """SELECT 'EU' AS region, CAST(1.55e13 AS DOUBLE) AS gdp
UNION ALL SELECT country_code, x2000 FROM gdp_wide WHERE country_code IN ('N05', 'N10', 'N15')""")
cte("gdp_master", ["gdp_by_region", "gdp_selected"], "SELECT region, gdp FROM gdp_by_region UNION ALL "
    "SELECT region, gdp FROM gdp_selected")
cte("gdp_country", ["gdp_wide"], """SELECT 'EU' AS country_code, CAST(1.55e13 AS DOUBLE) AS gdp
UNION ALL SELECT country_code, x2000 FROM gdp_wide""")

# map regions
cte("map_sheet", ["nat"], """SELECT country, region FROM nat
UNION ALL SELECT country, 'BLOC' FROM nat WHERE country_code IN ('N00','N01','N02','N03','N04','EU')
UNION ALL SELECT country, 'BLOC' FROM nat WHERE country_code IN ('N00','N01','N02','N03','N04','EU')
UNION ALL SELECT 'European Union', 'BLOC'""")
cte("map_dim", ["map_sheet", "xwalk"], """SELECT DISTINCT CASE WHEN s.country = 'European Union' THEN 'EU' ELSE x.iso3 END
  AS country_code, s.region, min(s.country) OVER (PARTITION BY CASE WHEN s.country = 'European Union' THEN 'EU'
  ELSE x.iso3 END, s.region) AS country
FROM map_sheet s LEFT JOIN (SELECT lower(trim(country_name)) AS nm, min(iso3) AS iso3 FROM xwalk GROUP BY 1) x
  ON lower(trim(s.country)) = x.nm""")
