"""Arithmetic with explicit division and rounding rules.

ANSI mode raises on a zero divisor; the panels want a missing value there, so every ratio goes through
``try_divide``. ``rnd`` is half-up rounding written out as ``floor(x * 10^k + 0.5) / 10^k`` so that the
result is bit-identical to the same formula in any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenaria.constants import BILLION, INFLATION_2015_TO_2019  # noqa: F401


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: str | Column, den: str | Column) -> Column:
    return F.try_divide(_col(num), _col(den))


def pct_of(x: str | Column, ref: str | Column, scale: float = 1.0) -> Column:
    """``x * scale / ref * 100``; a zero or null reference gives null."""
    num = _col(x) * F.lit(scale) if scale != 1.0 else _col(x)
    return F.try_divide(num, _col(ref)) * F.lit(100.0)


def scale_units(x: str | Column, factor: float) -> Column:
    """Multiply by a named unit factor (divide by passing ``1 / factor``-style constants explicitly)."""
    return _col(x) * F.lit(factor)


def rnd(x: str | Column, digits: int, half: float = 0.5) -> Column:
    p = 10.0 ** digits
    return (F.floor(_col(x) * F.lit(p) + F.lit(half)).cast("double") / F.lit(p))


# Rounding boundary for comparisons across engines: slightly off one half, so that a value with a short
# exact decimal expansion (sums of cents, halves, fifths) or a small-denominator fraction never sits on
# it; last-bit differences from a different summation order are far smaller than the offset.
SIG_HALF = 0.5 + 3.5e-7


def rnd_sig(x: str | Column, sig: int = 8) -> Column:
    """Rounding to ``sig`` significant digits, used to compare order-dependent float results.

    The scale is an exact power of ten (multiply for small values, divide for large ones), so every step
    is the same IEEE operation in any engine. Next to a power of ten a last-bit difference can change
    ``floor(log10 |x|)``, but both choices round to that power, so the result is the same.
    """
    c = _col(x)
    e = F.lit(sig - 1) - F.floor(F.log10(F.abs(c)))
    up = F.pow(F.lit(10.0), e.cast("double"))
    down = F.pow(F.lit(10.0), (-e).cast("double"))
    small = F.floor(c * up + F.lit(SIG_HALF)).cast("double") / up
    large = F.floor(c / down + F.lit(SIG_HALF)).cast("double") * down
    return F.when(c == 0, c).when(e >= 0, small).otherwise(large)
