"""Ordering: sorts with R's null placement, categorical levels, ordering by a statistic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenaria.functions.exact import exact_mean
from scenaria.operators.scan import ranked


def sort_asc(df: DataFrame, *cols: str) -> DataFrame:
    """``arrange(c)``: ascending, nulls last."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in cols])


def as_levels(df: DataFrame, column: str, levels: Sequence[str], rank_col: str | None = None) -> DataFrame:
    """``factor(x, levels = v)``: values outside ``levels`` become null; optional 1-based rank column.

    The level list is a literal array, so the lookup is a pure expression (no join, no shuffle).
    """
    arr = F.array(*[F.lit(v) for v in levels])
    pos = F.array_position(arr, F.col(column))
    out = df.withColumn(column, F.when(pos > 0, F.col(column)))
    if rank_col:
        out = out.withColumn(rank_col, F.when(pos > 0, pos.cast("int")))
    return out


def order_by_stat(df: DataFrame, category: str, value: str, rank_col: str = "order_rank",
                  descending_value: bool = True) -> DataFrame:
    """``reorder(cat, -x)``: categories ranked by the mean of ``-x`` (ties by name, null means and names last); rank joined back.

    The mean does not depend on the order of rows, and the categories are ranked over ranges (``operators.scan``), so that
    neither a category nor their list lies in one task. ``df`` is read twice: store it if it is dear.
    """
    sign = -1.0 if descending_value else 1.0
    stat = df.groupBy(category).agg(exact_mean(F.col(value) * F.lit(sign)).alias("_stat"))
    rank = ranked(stat, [F.col("_stat").asc_nulls_last(), F.col(category).asc_nulls_last()], rank_col)
    rank = rank.select(F.col(category).alias("_cat"), F.col(rank_col).cast("int").alias(rank_col))
    return df.join(rank, df[category].eqNullSafe(rank["_cat"]), "left").drop("_cat")
