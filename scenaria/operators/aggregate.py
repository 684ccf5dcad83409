"""Grouped statistics, attached statistics, grand totals and two-stage (member, then period) means.

The panels usually write ``group_by(k) %>% mutate(s = f(x))`` and then keep one row per group. Here the
statistic is one ``groupBy`` (partial + final aggregation) and, when every row needs it, the small result
is joined back on the group key instead of running a window: a window puts a whole group, possibly a
third of the data, into one task, while the join lets AQE split a skewed key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenaria.functions.nulls import skipna_sum, strict_max, strict_mean, strict_min, strict_sum


def attach_group_stat(df: DataFrame, keys: Sequence[str], stats: dict[str, Column]) -> DataFrame:
    """Every row gets the statistics of its group (null keys form a group and match each other)."""
    keys = list(keys)
    agg = df.groupBy(*keys).agg(*[e.alias(n) for n, e in stats.items()])
    agg = agg.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *stats.keys())
    cond = None
    for k in keys:
        c = df[k].eqNullSafe(agg[f"_g_{k}"])
        cond = c if cond is None else cond & c
    out = df.drop(*[n for n in stats if n in df.columns]).join(agg, cond, "left")
    return out.drop(*[f"_g_{k}" for k in keys])


def attach_global_stat(df: DataFrame, stats: dict[str, Column]) -> DataFrame:
    """Every row gets a statistic of the whole frame: a one-row aggregate, broadcast (size 1 by construction)."""
    total = df.agg(*[e.alias(n) for n, e in stats.items()])
    return df.drop(*[n for n in stats if n in df.columns]).crossJoin(F.broadcast(total))


def share_of_total(df: DataFrame, group: str, value: str, strict: bool = True,
                   sum_name: str = "group_sum", total_name: str = "global", share_name: str = "share") -> DataFrame:
    """One row per group with its sum, the grand total and the share (``sum / total``)."""
    agg_fn = strict_sum if strict else skipna_sum
    per_group = df.groupBy(group).agg(agg_fn(value).alias(sum_name))
    total = df.agg(agg_fn(value).alias(total_name))
    out = per_group.crossJoin(F.broadcast(total))
    return out.withColumn(share_name, F.try_divide(F.col(sum_name), F.col(total_name)))


def grouping_sets_total(
    df: DataFrame, group: str, by: str, value: str, total_label: str = "World",
    group_agg: str = "skipna", total_agg: str = "strict", out: str = "value",
) -> DataFrame:
    """Per (group, by) sums plus one total row per ``by`` labelled ``total_label``.

    One aggregate with ``GROUPING SETS ((group, by), (by))``: ``grouping(group)`` tells the total row from
    a real null group. Rows with a null ``group`` count in the total but yield no group row.
    """
    fns = {"skipna": skipna_sum, "strict": strict_sum}
    agg = df.groupingSets([[group, by], [by]], group, by).agg(
        F.grouping(group).alias("_is_total"),
        fns[group_agg](value).alias("_g"),
        fns[total_agg](value).alias("_t"),
    )
    agg = agg.filter((F.col("_is_total") == 1) | F.col(group).isNotNull())
    return agg.select(
        F.when(F.col("_is_total") == 1, F.lit(total_label)).otherwise(F.col(group)).alias(group),
        F.col(by),
        F.when(F.col("_is_total") == 1, F.col("_t")).otherwise(F.col("_g")).alias(out),
    )


def anchor_flag(member: str, anchor) -> Column:
    return F.max(F.when(F.col(member) == F.lit(anchor), F.lit(1)).otherwise(F.lit(0)))


def period_flag(period: str, rep) -> Column:
    return F.max(F.when(F.col(period) == F.lit(rep), F.lit(1)).otherwise(F.lit(0)))


def member_stats(
    df: DataFrame, keys: Sequence[str], period: str, member: str, value: str, anchor,
    stats: Sequence[str] = ("mean",),
) -> DataFrame:
    """Stage 1: statistic over members per (keys, period), kept only where the anchor member exists.

    ``mean`` / ``max`` / ``min`` are strict (a null member value makes the cell null).
    """
    fns = {"mean": strict_mean, "max": strict_max, "min": strict_min, "sum": strict_sum}
    agg = df.groupBy(*keys, period).agg(
        *[fns[s](value).alias(f"member_{s}") for s in stats], anchor_flag(member, anchor).alias("_has_anchor")
    )
    return agg.filter(F.col("_has_anchor") == 1).drop("_has_anchor")


def two_stage(
    df: DataFrame, keys: Sequence[str], period: str, member: str, value: str, anchor, rep_period,
    member_stat: str = "mean", period_stat: str = "mean", out: str = "value",
) -> DataFrame:
    """Stage 1 statistic over members, stage 2 mean or sum over periods, kept where ``rep_period`` exists.

    Equals: group mutate over members -> keep anchor rows -> group mutate over periods -> keep rep period.
    """
    stage1 = member_stats(df, keys, period, member, value, anchor, (member_stat,))
    fns = {"mean": strict_mean, "sum": strict_sum}
    stage2 = stage1.groupBy(*keys).agg(
        fns[period_stat](f"member_{member_stat}").alias(out), period_flag(period, rep_period).alias("_has_rep")
    )
    return stage2.filter(F.col("_has_rep") == 1).drop("_has_rep")


def envelope(
    df: DataFrame, keys: Sequence[str], period: str, member: str, value: str, anchor, rep_period,
    names: tuple[str, str, str] = ("annual", "annual_max", "annual_min"),
) -> DataFrame:
    """Period means of the member mean, member max and member min."""
    stage1 = member_stats(df, keys, period, member, value, anchor, ("mean", "max", "min"))
    stage2 = stage1.groupBy(*keys).agg(
        strict_mean("member_mean").alias(names[0]),
        strict_mean("member_max").alias(names[1]),
        strict_mean("member_min").alias(names[2]),
        period_flag(period, rep_period).alias("_has_rep"),
    )
    return stage2.filter(F.col("_has_rep") == 1).drop("_has_rep")


def spread_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(ymin, ymax, y) of a value per group as one struct column ``summary`` plus flat columns."""
    agg = df.groupBy(*keys).agg(
        F.struct(strict_min(value).alias("ymin"), strict_max(value).alias("ymax"),
                 strict_mean(value).alias("y")).alias("summary")
    )
    return agg.select(*keys, "summary", "summary.ymin", "summary.ymax", "summary.y")


def control_total(df: DataFrame, pred: Column, value: str, out: str = "total") -> DataFrame:
    """``filter(p) %>% mutate(total = sum(x))``: the filtered rows, each with the strict total."""
    sub = df.filter(pred)
    return attach_global_stat(sub, {out: strict_sum(value)})
