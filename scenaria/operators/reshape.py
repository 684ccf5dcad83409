"""Wide <-> long reshaping with explicit value lists.

* ``unpivot`` is Spark's Expand: no shuffle.
* ``pivot_wide`` finds the values itself if none are listed (a bounded distinct pass), then
  is one grouped aggregate with one conditional cell per value (partial
  aggregation keeps hot id groups cheap). A second row for the same cell raises, as the source does.
* ``densify`` adds the absent (ids, key) combinations as null rows: distinct ids times distinct keys, and a
  null-safe left join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenaria.operators.project import column_range


def unpivot(
    df: DataFrame,
    ids: Sequence[str],
    values: Sequence[str] | None = None,
    var: str = "key",
    val: str = "value",
    dtype: str | None = None,
) -> DataFrame:
    """Long form of ``values`` (default: every column not in ``ids``); value columns get one type."""
    ids = list(ids)
    values = [c for c in df.columns if c not in ids] if values is None else list(values)
    if dtype is not None:
        df = df.select(*[F.col(f"`{c}`") for c in ids], *[F.col(f"`{c}`").cast(dtype).alias(c) for c in values])
    return df.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in values], var, val)


def unpivot_range(
    df: DataFrame, ids: Sequence[str], first: str, last: str, var: str = "key", val: str = "value",
    dtype: str | None = None,
) -> DataFrame:
    """Unpivot the columns from ``first`` to ``last`` by position (``pivot_longer(a:b)``)."""
    return unpivot(df.select(*ids, *column_range(df, first, last)), ids,
                   column_range(df, first, last), var, val, dtype)


def _cell(key: str, value: str, v, check_unique: bool) -> Column:
    hit = F.col(key).eqNullSafe(F.lit(v))
    cell = F.max(F.when(hit, F.col(value)))
    if not check_unique:
        return cell
    n = F.count(F.when(hit, F.lit(1)))
    return F.when(n > 1, F.raise_error(F.lit(f"duplicate cell for {key}={v}"))).otherwise(cell)


def key_values(df: DataFrame, key: str, most: int = 1000) -> list:
    """The distinct values of a key column in the order in which ``spread`` makes columns of them: numbers by size, text by
    letters first and then small before capital ones, null last. More than ``most`` values stop the job."""
    found = [r[0] for r in df.select(key).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{key} has more than {most} values; list those wanted")
    order = (lambda v: (v.casefold(), v.swapcase())) if any(isinstance(v, str) for v in found) else (lambda v: v)
    return sorted((v for v in found if v is not None), key=order) + [v for v in found if v is None]


def pivot_wide(
    df: DataFrame, ids: Sequence[str], key: str, value: str, values: Sequence | None = None, names: Sequence[str] | None = None,
    check_unique: bool = True, most: int = 1000,
) -> DataFrame:
    """One column per key value; absent cells are null; a duplicated cell is an error. Without ``values`` the columns
    are those that occur (``key_values``; a null key's is called ``<NA>``)."""
    values = key_values(df, key, most) if values is None else values
    names = ["<NA>" if v is None else str(v) for v in values] if names is None else list(names)
    cells = [_cell(key, value, v, check_unique).alias(n) for v, n in zip(values, names)]
    if not cells:
        return df.select(*ids).distinct()
    return df.groupBy(*ids).agg(*cells)


def pivot_difference(
    df: DataFrame, ids: Sequence[str], key: str, value: str, a, b, out: str = "shift",
    keep: Sequence | None = None,
) -> DataFrame:
    """Pivot ``key`` and add ``out = a - b`` (null when either side is absent)."""
    keep = [a, b] if keep is None else list(keep)
    for v in (a, b):
        if v not in keep:
            keep.append(v)
    wide = pivot_wide(df, ids, key, value, keep)
    return wide.withColumn(out, F.col(f"`{a}`") - F.col(f"`{b}`"))


def densify(
    df: DataFrame, ids: Sequence[str], key: str, value: str,
) -> DataFrame:
    """Every (ids, key) pair whose ids and key both occur gets a row; absent ones carry a null value.

    Distinct ids times distinct keys (the product is the result's own size), then a null-safe left join of the
    values; null ids and null keys are values like others. Two rows of one cell fan out.
    """
    ids = list(ids)
    cells = df.select(*ids).distinct().crossJoin(df.select(key).distinct())
    given = df.select(*[F.col(c).alias(f"_d_{c}") for c in [*ids, key]], F.col(value))
    same = None
    for c in [*ids, key]:
        eq = cells[c].eqNullSafe(given[f"_d_{c}"])
        same = eq if same is None else same & eq
    return cells.join(given, same, "left").select(*ids, key, value)


def column_to_row(df: DataFrame, row: dict) -> DataFrame:
    """Append one literal row (``mutate(EU = c) %>% spread %>% gather``), matching columns by name."""
    extra = df.sparkSession.range(1).select(
        *[F.lit(row.get(c)).cast(df.schema[c].dataType).alias(c) for c in df.columns]
    )
    return df.unionByName(extra)
