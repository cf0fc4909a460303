"""Two rounding rules. Spark's ``round``/``bround`` match neither on binary ties."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_half_even(x: Column, digits: int) -> Column:
    """Nearest even on ties of the scaled double; used by the features and dimensions."""
    scale = F.lit(float(10**digits))
    return F.rint(x * scale) / scale


def round_half_up(x: Column, digits: int) -> Column:
    """Away from zero on ties of the scaled double; used by query outputs."""
    scale = F.lit(float(10**digits))
    return F.signum(x) * F.floor(F.abs(x) * scale + F.lit(0.5)) / scale
