"""Exact rounding of ratios and means.

Shares are computed from two integer counts with half-up integer division, so
the printed digit never depends on how an average was accumulated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded_ratio(part: Column, whole: Column, digits: int) -> Column:
    """``part / whole`` rounded half up to ``digits``; null when whole is 0."""
    scale = 10**digits
    units = F.call_function("div", part * (2 * scale) + whole, whole * 2)
    return F.when(whole > 0, units / F.lit(float(scale)))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with one decimal."""
    return F.when(
        whole > 0, F.call_function("div", part * 2000 + whole, whole * 2) / F.lit(10.0)
    )


def safe_ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0 when nothing was counted."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def mean_rounded(column: Column) -> Column:
    """Mean rounded to a whole number, as a double."""
    return F.round(F.avg(column), 0)
