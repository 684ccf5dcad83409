"""Projections: keep, drop, rename, positional ranges, chained derivations, header normalisation."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def q(name: str) -> Column:
    """Column by exact name (names such as ``1.5C`` need back-quotes)."""
    return F.col(f"`{name}`")


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` inclusive, by position (``select(a:b)``)."""
    cols = df.columns
    i, j = cols.index(first), cols.index(last)
    if i > j:
        i, j = j, i
    return cols[i : j + 1]


def select_range(df: DataFrame, first: str, last: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[q(c) for c in keep], *[q(c) for c in column_range(df, first, last)])


def drop_cols(df: DataFrame, *cols: str) -> DataFrame:
    return df.drop(*cols)


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def derive_chained(df: DataFrame, steps: Sequence[tuple[str, Callable[[], Column] | Column]]) -> DataFrame:
    """``mutate(a = f(..), b = g(a))``: each step sees the columns defined before it."""
    for name, expr in steps:
        df = df.withColumn(name, expr() if callable(expr) else expr)
    return df


def normalise_header(name: str, lower: bool = True, dots: bool = True) -> str:
    """Lower-case; with ``dots`` also turn runs of non-word characters into ``_`` (Spark-friendly)."""
    out = name.strip()
    if lower:
        out = out.lower()
    if dots:
        out = re.sub(r"[^0-9A-Za-z_+]+", "_", out).strip("_")
    return out


def normalise_headers(df: DataFrame, lower: bool = True, dots: bool = False) -> DataFrame:
    """``rename_all(tolower)``; optional snake-casing of dots and spaces."""
    return df.toDF(*[normalise_header(c, lower, dots) for c in df.columns])
