"""Annual linear interpolation per series and period restriction.

Semantics (R's ``approx(x, y, xout = min(x):max(x))`` defaults):

* output years are every integer from the smallest to the largest year of the series, including years
  whose value is null;
* null knots are ignored; knots on the same year are averaged;
* no extrapolation: years before the first or after the last non-null knot are null;
* a series with fewer than two non-null knots cannot be interpolated; all its years are null
  (R stops with an error; ``knot_count`` reports such series).

Plan: one grouped mean over (series, year) collapses tied knots (order-independent, ``functions.exact``). The knots are dealt by
(series, year) to ranges, so that a long series is spread over tasks: the windows that find the knots on both sides run
inside (range, series), and the last known knot before a range and the first one after it come from one summary row for each
(range, series) (``operators.scan``). Years between two rows are produced by ``explode(sequence(...))``; everything stays in
JVM expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenaria.functions.exact import exact_mean
from scenaria.operators.scan import RANGE, after, before, carried, dealt, whole


def interpolate_linear(df: DataFrame, keys: Sequence[str], x: str, y: str, knot_count: str | None = None,
                       partitions: int | None = None) -> DataFrame:
    keys = list(keys)
    knot = F.when(F.col(y).isNotNull(), F.struct(F.col(x).alias("kx"), F.col(y).alias("ky")))
    knots = df.groupBy(*keys, x).agg(exact_mean(y).alias(y))  # ties averaged; an all-null year stays null
    knots = dealt(knots.withColumn("_k", knot), [*[F.col(k) for k in keys], F.col(x)], "knots", partitions)
    knots = carried(
        knots, keys,
        {"_n": F.count(y), "_first_x": F.min(x), "_first": F.min("_k"), "_last": F.max("_k")},  # structs order by year
        {"_all": F.sum("_n").over(whole(keys)), "_after_x": F.last("_first_x").over(after(keys)),
         "_before": F.last("_last", ignorenulls=True).over(before(keys)), "_after": F.last("_first", ignorenulls=True).over(after(keys))})
    w = Window.partitionBy(RANGE, *keys).orderBy(x)
    w_upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # what follows is read backwards: a frame to the end would be gone through once for each row
    w_after = Window.partitionBy(RANGE, *keys).orderBy(F.col(x).desc()).rowsBetween(Window.unboundedPreceding, -1)
    staged = knots.select(
        *keys, x, y, F.col("_all").alias("_n"),
        F.coalesce(F.last("_k", ignorenulls=True).over(w_upto), "_before").alias("_p"),
        F.coalesce(F.last("_k", ignorenulls=True).over(w_after), "_after").alias("_q"),
        F.coalesce(F.lead(x).over(w), "_after_x").alias("_next_x"),
    )
    last_t = F.coalesce(F.col("_next_x") - F.lit(1), F.col(x))
    grid = staged.select("*", F.explode(F.sequence(F.col(x), last_t)).alias("_t"))
    px, py, qx, qy = F.col("_p.kx"), F.col("_p.ky"), F.col("_q.kx"), F.col("_q.ky")
    t = F.col("_t")
    slope_part = (t - px).cast("double") / (qx - px).cast("double")
    value = (
        F.when(F.col("_n") < 2, F.lit(None))
        .when(t == px, py)
        .when(F.col("_p").isNotNull() & F.col("_q").isNotNull(), py + (qy - py) * slope_part)
    )
    out = grid.select(*keys, t.cast("int").alias(x), value.cast("double").alias(y), F.col("_n"))
    if knot_count:
        return out.withColumnRenamed("_n", knot_count)
    return out.drop("_n")


def restrict_period(df: DataFrame, year: str, first: int, last: int) -> DataFrame:
    return df.filter(F.col(year).between(first, last))
