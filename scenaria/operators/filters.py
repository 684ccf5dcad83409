"""Row filters: membership, first occurrence per key, first-and-predicate.

First occurrence (``!duplicated(k)``) is computed as a grouped ``min`` over a struct that starts with the
ordering columns. That is an ordinary aggregate: partial aggregation runs before the shuffle, so a key
that holds a third of all rows costs one small record per task instead of one sorted window partition.
The row order must be explicit (an order column); Spark rows have no intrinsic order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_in(df: DataFrame, column: str, values: Sequence | DataFrame, negate: bool = False) -> DataFrame:
    """Membership in a literal list (``isin``) or in the rows of a one-column table (semi/anti join).

    Null never matches, as in ``%in%`` applied to ``filter`` (the predicate is false, not null).
    """
    if isinstance(values, DataFrame):
        other = values.select(F.col(values.columns[0]).alias("_member")).distinct()
        how = "left_anti" if negate else "left_semi"
        return df.join(other, F.col(column) == F.col("_member"), how)
    pred = F.col(column).isin(list(values))
    return df.filter(~pred if negate else pred)


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Keep the first row of each key in ``order_by`` order (nulls in keys form one group).

    Ties in ``order_by`` are broken by the remaining columns, so the result is deterministic.
    """
    keys, order_by = list(keys), list(order_by)
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    packed = F.struct(*[F.col(f"`{c}`") for c in order_by + rest]).alias("_first")
    out = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.min(packed).alias("_first"))
    return out.select(*[F.col(f"`{c}`") if c in keys else F.col(f"_first.`{c}`").alias(c) for c in df.columns])


def filter_first_and_pred(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], pred: Column) -> DataFrame:
    """``filter(!duplicated(k) & p)``: both parts judged on the input frame.

    The first row of each key is kept when ``p`` is true on it; ``p`` null counts as false.
    """
    return first_per_key(df, keys, order_by).filter(F.coalesce(pred, F.lit(False)))


def drop_null_rows(df: DataFrame, *cols: str) -> DataFrame:
    return df.dropna(subset=list(cols))


def filter_not_equal(df: DataFrame, column: str, value) -> DataFrame:
    """``filter(!x == v)``: rows where ``x`` is null are dropped too (three-valued logic)."""
    return df.filter(~(F.col(column) == F.lit(value)))
