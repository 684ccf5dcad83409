"""Prefix scans and ranks over rows dealt to range partitions: no key and no order ever lies in one task.

Rows are dealt by (key, order) to ranges and stored once with the number of their range. A window then runs inside
(range, key), so it holds at most one range's rows, and each (range, key) is summed up in one row: the last known value, the
first one, the digit sums of a running total, the number of rows. What the ranges before and after contribute is a window
over these summaries, which has one row per range, and is joined back. Values are told apart to the last bit: running
totals are carried as digit sums (``functions.exact``) and rounded once, so they do not depend on where ranges begin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenaria.functions.exact import DIGITS, digit, rounded
from scenaria.session import scratch_path

RANGE = "_range"


def dealt(df: DataFrame, order: Sequence[Column], name: str, partitions: int | None = None) -> DataFrame:
    """``df`` dealt by ``order`` to ranges, stored, with the number of each row's range in RANGE. Rows equal in all of
    ``order`` share a range."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, f"dealt-{name}")
    df.repartitionByRange(n, *order).withColumn(RANGE, F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def carried(rows: DataFrame, keys: Sequence[str], sums: dict[str, Column], over: dict[str, Column]) -> DataFrame:
    """Each dealt row with what the other ranges of its key contribute: ``sums`` are aggregates of one (range, key),
    ``over`` are columns over ``before(keys)``, ``after(keys)`` or ``whole(keys)`` of them."""
    per_range = rows.groupBy(RANGE, *keys).agg(*[e.alias(n) for n, e in sums.items()])
    mine = {c: f"_of_{c}" for c in [RANGE, *keys]}  # names of their own: both sides come from the same table
    per_range = per_range.select(*[F.col(c).alias(n) for c, n in mine.items()], *[e.alias(n) for n, e in over.items()])
    same = F.col(RANGE) == F.col(mine[RANGE])
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(mine[k]))
    return rows.join(per_range, same, "left").drop(*mine.values())


def before(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def after(keys: Sequence[str]):
    """The ranges after, from the last to the next one: ``last`` is the nearest."""
    return Window.partitionBy(*keys).orderBy(F.col(RANGE).desc()).rowsBetween(Window.unboundedPreceding, -1)


def whole(keys: Sequence[str]):
    return Window.partitionBy(*keys)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, out: str, partitions: int | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` up to and including each row, in ``order`` within its key, exact but for one
    rounding. Rows equal in ``order`` follow one another in an order of their own, but within one range."""
    rows = dealt(df.withColumn("_x", value.cast("double")), [*[F.col(k) for k in keys], *order], "running", partitions)
    w = Window.partitionBy(RANGE, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {f"_s{k}": F.coalesce(F.sum(digit(F.col("_x"), k)), F.lit(0).cast("bigint")) for k in range(DIGITS)}
    over = {f"_b{k}": F.coalesce(F.sum(f"_s{k}").over(before(keys)), F.lit(0).cast("bigint")) for k in range(DIGITS)}
    rows = carried(rows, keys, sums, over)
    digits = F.array(*[F.coalesce(F.sum(digit(F.col("_x"), k)).over(w), F.lit(0).cast("bigint")) + F.col(f"_b{k}") for k in range(DIGITS)])
    return rows.withColumn("_digits", digits).select(*df.columns, rounded(F.col("_digits")).alias(out))


def ranked(df: DataFrame, order: Sequence[Column], out: str, partitions: int | None = None) -> DataFrame:
    """``df`` with a consecutive number from 1 in ``order``, which should tell all rows apart. Each range numbers its own rows;
    the numbers of rows of the ranges before, one number per range, are added as constants."""
    rows = dealt(df, order, "ranked", partitions)
    counts = dict(rows.groupBy(RANGE).count().collect())  # a row for each range
    start, offsets = 0, []
    for k in range(max(counts, default=-1) + 1):
        offsets.append(start)
        start += counts.get(k, 0)
    local = F.row_number().over(Window.partitionBy(RANGE).orderBy(*order))
    first = F.element_at(F.lit(offsets or [0]), F.col(RANGE) + 1)
    return rows.select(*df.columns, (first + local).cast("long").alias(out))
