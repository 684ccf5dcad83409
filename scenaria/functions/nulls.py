"""Aggregates with explicit null rules.

Spark's aggregates skip nulls. The panels we reproduce use two rules and every job names which one it uses:

* strict   — any null input makes the group result null (``sum(x)`` without ``na.rm``).
* skip-null sum — nulls are skipped and an all-null group sums to 0 (``sum(x, na.rm = TRUE)``).

Sums and means do not depend on the order of the rows (``functions.exact``). All helpers are aggregate expressions with
partial (map-side) aggregation for ``groupBy().agg`` and grouping sets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenaria.functions.exact import exact_sum


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict(agg: Callable[[Column], Column], c: str | Column) -> Column:
    """``agg(c)`` if the group holds no null of ``c``, else null."""
    c = _col(c)
    return F.when(F.count(F.lit(1)) == F.count(c), agg(c))


def strict_sum(c: str | Column) -> Column:
    return strict(exact_sum, c)


def strict_mean(c: str | Column) -> Column:
    c = _col(c)
    return F.when(F.count(F.lit(1)) == F.count(c), F.try_divide(exact_sum(c), F.count(c)))


def strict_min(c: str | Column) -> Column:
    return strict(F.min, c)


def strict_max(c: str | Column) -> Column:
    return strict(F.max, c)


def skipna_sum(c: str | Column) -> Column:
    return F.coalesce(exact_sum(c), F.lit(0.0))
