"""Statistics attached to rows at one or two grains, and stacked-bar offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenaria.functions.nulls import skipna_sum, strict_sum
from scenaria.operators.aggregate import attach_group_stat
from scenaria.operators.scan import running_sum


def attach_net(df: DataFrame, group: str, value: str, out: str = "net") -> DataFrame:
    """``group_by(region) %>% mutate(net = sum(shift))`` (strict sum)."""
    return attach_group_stat(df, [group], {out: strict_sum(value)})


def attach_two_grains(df: DataFrame, coarse: Sequence[str], fine: str, stats: dict[str, Column], value: str, total: str) -> DataFrame:
    """Every row gets the statistics of its (coarse, fine) group and, in ``total``, the skip-null sum of ``value`` over
    its coarse group. The coarse sum is taken over the fine groups' sums, so the rows are read once to aggregate."""
    coarse = list(coarse)
    per_fine = df.groupBy(*coarse, fine).agg(*[e.alias(n) for n, e in stats.items()], skipna_sum(value).alias("_part"))
    per_fine = attach_group_stat(per_fine, coarse, {total: F.sum("_part")})
    per_fine = per_fine.select(*[F.col(k).alias(f"_g_{k}") for k in [*coarse, fine]], *stats, total)
    same = None
    for k in [*coarse, fine]:
        c = df[k].eqNullSafe(per_fine[f"_g_{k}"])
        same = c if same is None else same & c
    return df.join(per_fine, same, "left").drop(*[f"_g_{k}" for k in [*coarse, fine]])


def stack_offsets(df: DataFrame, bar: Sequence[str], level_rank: str, value: str,
                  lo: str = "ymin", hi: str = "ymax") -> DataFrame:
    """Offsets of stacked bars: positives stack upwards and negatives downwards, separately; the
    lowest level rank sits on top (farthest from zero), as in the default stacking of bar charts.

    The running totals are exact but for one rounding, and a bar of many rows is spread over tasks (``operators.scan``).
    """
    signed = df.withColumn("_sign", F.when(F.col(value) < 0, F.lit(-1)).otherwise(F.lit(1)))
    out = running_sum(signed, [*bar, "_sign"], [F.col(level_rank).desc_nulls_first()], F.coalesce(F.col(value), F.lit(0.0)), "_cum")
    return (
        out.withColumn(hi, F.when(F.col("_sign") > 0, F.col("_cum")).otherwise(F.col("_cum") - F.col(value)))
        .withColumn(lo, F.when(F.col("_sign") > 0, F.col("_cum") - F.col(value)).otherwise(F.col("_cum")))
        .drop("_sign", "_cum")
    )
