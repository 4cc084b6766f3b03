"""Rounding that agrees with Python's ``round`` and ``format`` on doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_round(c: Column, digits: int) -> Column:
    """Round the exact binary value, true ties to even.

    ``x * 10^digits`` is itself rounded in floating point; the part lost there is
    recovered (error-free product) and decides values that look like ties.
    """
    x, scale = c.cast("double"), float(10**digits)
    product = x * scale
    high = x * 134217729.0 - (x * 134217729.0 - x)
    lost = (high * scale - product) + (x - high) * scale
    whole = F.floor(product).cast("double")
    part = product - whole
    odd = F.pmod(whole, F.lit(2.0)) == 1.0
    up = (part > 0.5) | ((part == 0.5) & ((lost > 0) | ((lost == 0) & odd)))
    rounded = (whole + up.cast("double")) / scale
    return F.when(F.abs(product) < 2.0**52, rounded).otherwise(x)


def percent(c: Column, decimals: int = 1) -> Column:
    """``0.8125`` as ``81.2%``."""
    value = exact_round(c.cast("double") * 100, decimals)
    return F.concat(F.format_string(f"%.{decimals}f", value), F.lit("%"))
