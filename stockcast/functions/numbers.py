"""Small numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def js_round(c: Column) -> Column:
    """Round half up towards positive infinity, as dashboards do."""
    return F.floor(c + F.lit(0.5)).cast("long")


def py_round(c: Column, digits: int) -> Column:
    """Round the exact binary value, as Python does: 0.125 gives 0.12 (a true tie), 1.115 gives 1.11 (it lies below).

    A product that looks like a tie is decided by what its rounding dropped.
    """
    scale = 10.0**digits
    value, scaled = c.cast("double"), c.cast("double") * scale
    low = F.floor(scaled).cast("double")
    dropped = _product_error(value, scale, scaled)
    tie = F.when(dropped > 0, low + 1.0).when(dropped < 0, low).otherwise(F.rint(scaled))
    whole = F.when(scaled - low == 0.5, tie).otherwise(F.rint(scaled))
    return F.when(F.abs(scaled) < 2.0**52, whole / scale).otherwise(value)


def _product_error(value: Column, factor: float, product: Column) -> Column:
    """``value * factor - product`` exactly: both factors in halves of 26 bits, whose products have no rounding."""
    def halves(x):
        big = x * 134217729.0
        high = big - (big - x)
        return high, x - high

    (a, b), (c, d) = halves(value), halves(factor)
    return ((a * c - product) + a * d + b * c) + b * d


def fixed(c: Column, digits: int) -> Column:
    """Fixed number of decimals as text, the scaled value rounded half up."""
    scale = 10.0**digits
    return F.format_string(f"%.{digits}f", F.floor(c * scale + F.lit(0.5)) / scale)


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def ratio(top: Column, bottom: Column, otherwise: float | Column = 0.0) -> Column:
    """``top / bottom`` where the bottom is positive, else a fixed value."""
    other = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return F.when(bottom > 0, top / bottom).otherwise(other)


def percent_change(value: Column, base: Column) -> Column:
    """Change in percent, 0 where the base is zero."""
    return F.when(base != 0, (value - base) / base * 100.0).otherwise(F.lit(0.0))


def signed_percent(c: Column) -> Column:
    """``+3.5%`` / ``-0.2%``."""
    return F.format_string("%+.1f%%", c)


def grouped(c: Column) -> Column:
    """Thousands separators and at most three decimals: ``1,234.5``."""
    return F.call_function("format_number", c, F.lit("#,##0.###"))


def std_from_band(upper: Column, mean: Column) -> Column:
    """Standard deviation implied by a 95 % band."""
    return (upper - mean) / 1.96
