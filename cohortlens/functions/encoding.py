"""Code-table lookups and bins as conditional expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def coded(value: Column, table: Mapping[str, float], default: float) -> Column:
    """Code of ``value``; unknown and null values take the default."""
    result = None
    for name, code in table.items():
        result = (F if result is None else result).when(value == name, F.lit(code))
    return result.otherwise(F.lit(default))


def bin_label(value: Column, bins: Iterable[tuple[float | None, str]]) -> Column:
    """Label of the first bin whose exclusive upper edge lies above the value."""
    result = None
    for edge, label in bins:
        if edge is None:
            return result.otherwise(F.lit(label))
        result = (F if result is None else result).when(value < edge, F.lit(label))
    return result
