"""Sums of doubles that do not depend on the order of the rows.

A double is a 53-bit integer times a power of two. Its bits are cut at fixed places into digits of DIGIT bits, each digit
is summed as an integer over the group, and the digit sums are put together at the end and rounded once, to the nearest
double. Integer addition has no rounding, so tasks, partitions and retries may add in any order: the result is the correctly
rounded sum of the exact values, bit for bit the same in every run.

All of it is built-in column expressions: one integer sum for each digit, with partial aggregation, usable in
``groupBy`` and grouping sets like any other aggregate.

The digits cover values below 2**128 in size down to steps of 2**-256 (finer bits of a value are cut off, in the same way
wherever the row is). A larger value stops the job. Infinite values and NaN give what adding them gives. A digit's sum is
exact for up to 2**39 rows of a group. Nulls are skipped; a group without values gives null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGIT = 24
DIGITS = 16
#: Exponent of the lowest digit's unit.
LOWEST = -256
_BASE = 1 << DIGIT


def digit(x: Column, k: int) -> Column:
    """Digit ``k`` of a value, with the value's sign; a remainder by a power of two and a shift are both exact."""
    above, unit = 2.0 ** (LOWEST + DIGIT * (k + 1)), 2.0 ** (LOWEST + DIGIT * k)
    part = F.floor((F.abs(x) % F.lit(above)) * F.lit(1.0 / unit))
    return F.when(x < 0, -part).otherwise(part)


def _carried(sums: Column) -> Column:
    """Digit sums, lowest first, as digits from 0 to 2**DIGIT - 1 and what is left above them (``carry``, with the sign)."""
    def step(acc, s):
        whole = s + acc["carry"]
        digit = F.pmod(whole, F.lit(_BASE).cast("bigint"))
        return F.struct(F.shiftright(whole - digit, DIGIT).alias("carry"), F.concat(acc["digits"], F.array(digit)).alias("digits"))
    start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("digits"))
    return F.aggregate(sums, start, step)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _nearest(digits: Column) -> Column:
    """The double nearest to the digits (lowest first) times their units. The four leading digits hold more bits than a
    double; what lies below them only tells whether they are exact, which is kept in their last bit."""
    def from_top(top: Column) -> Column:
        first = F.greatest(top - 3, F.lit(0))
        lead = F.aggregate(F.reverse(F.slice(digits, first + 1, F.lit(4))), F.lit(0).cast("decimal(38,0)"),
                           lambda acc, d: (acc * F.lit(_BASE).cast("decimal(8,0)") + d.cast("decimal(20,0)")).cast("decimal(38,0)"))
        inexact = F.exists(F.slice(digits, 1, first), lambda d: d != 0) & (F.pmod(F.element_at(digits, first + 1), F.lit(2)) == 0)
        return (lead + F.when(inexact, 1).otherwise(0).cast("decimal(1,0)")).cast("double") * F.pow(F.lit(2.0), (first * DIGIT + LOWEST).cast("double"))
    return _let(F.array_max(F.transform(digits, lambda d, i: F.when(d != 0, i).otherwise(F.lit(0)))), from_top)


def rounded(sums: Column) -> Column:
    """The double nearest to the sum of digit sums times their units."""
    def signed(done: Column, sign: int) -> Column:
        above = F.array(F.pmod(done["carry"], F.lit(_BASE).cast("bigint")), F.shiftright(done["carry"], DIGIT))
        return _let(F.concat(done["digits"], above), lambda digits: _nearest(digits) * F.lit(float(sign)))
    return _let(sums, lambda given: _let(_carried(given), lambda done: F.when(done["carry"] >= 0, signed(done, 1)).otherwise(
        _let(_carried(F.transform(given, lambda s: -s)), lambda turned: signed(turned, -1)))))


def exact_sum(c: str | Column) -> Column:
    """The sum of a column, rounded once, whatever the order of its rows; null if it has no values."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    out_of_range = F.raise_error(F.concat(F.lit("exact_sum: beyond 2**128: "), x.cast("string")))
    endless = F.isnan(x) | (F.abs(x) == float("inf"))
    finite = F.when(~endless, F.when(F.abs(x) < 2.0**128, x).otherwise(out_of_range.cast("double")))
    sums = F.array(*[F.coalesce(F.sum(digit(finite, k)), F.lit(0).cast("bigint")) for k in range(DIGITS)])
    alone = F.max(x) + F.lit(0.0)  # one value is its own sum
    return F.when(F.count(x) == 1, alone).when(F.count(x) > 0, F.coalesce(F.sum(F.when(endless, x)), rounded(sums)))


def exact_mean(c: str | Column) -> Column:
    """``exact_sum`` over the number of values; null if there is none."""
    return F.try_divide(exact_sum(c), F.count(c))


def sum_of_digits(values: list[float]) -> list[int]:
    """Digit sums of a list in plain integers, for tests and for looking at a group by hand."""
    from fractions import Fraction

    def digit(x: float, k: int) -> int:
        cut = int(abs(Fraction(x)) / Fraction(2) ** (LOWEST + DIGIT * k)) % _BASE
        return -cut if x < 0 else cut
    return [reduce(lambda t, x: t + digit(x, k), values, 0) for k in range(DIGITS)]
