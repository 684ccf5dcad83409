"""A representative subset of the registered queries against their SQL statements in DuckDB (sf0.001).

The full comparison of all keys is ``tools/check_oracle.py``.
"""

import math

import pytest

import __spark_entry__ as E
from tests.conftest import SF

KEYS = ["stimulus_master", "stimulus_components", "region_dimension", "investment_annual", "shift_annual",
        "gdp_shares", "map_region_stimulus", "scan_na_tokens", "scan_skip_preamble", "export_indexed",
        "densify_keys", "win_stack_offsets", "agg_grouping_sets_world", "ts_interpolate_linear", "fig_shift",
        "shift_five_year", "shift_prep", "model_spread_shift", "pivot_difference", "agg_spread_summary", "fig_model_spread",
        "stimulus_gdp_table", "xwalk_name_to_code", "stimulus_july_table", "gdp_master"]
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("key", KEYS)
def test_key_matches_sql(spark, con, key):
    df = E.queries()[key](spark, SF)
    rows = df.collect()
    assert rows and not [c for i, c in enumerate(df.columns) if all(r[i] is None for r in rows)], "a result column is null in every row"
    rel = con.execute(E.oracle_sql()[key])
    ocols = [d[0] for d in rel.description]
    assert _rows(df.columns, df.collect()) == _rows(ocols, rel.fetchall())
