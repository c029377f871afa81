"""Derived labels: outcome, confidence band, traffic light."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens import constants as C


def outcome_success(status: Column) -> Column:
    """True when completed, false when stopped early, null while unknown."""
    name = F.upper(status)
    return F.when(name.isin(*C.COMPLETED_STATUSES), F.lit(True)).when(
        name.isin(*C.FAILED_STATUSES), F.lit(False)
    )


def outcome_confidence(status: Column, has_results: Column) -> Column:
    """How far the outcome label can be trusted, 0 to 1."""
    name = F.upper(status)
    completed = name.isin(*C.COMPLETED_STATUSES)
    return (
        F.when(completed & has_results, F.lit(C.CONFIDENCE_WITH_RESULTS))
        .when(completed, F.lit(C.CONFIDENCE_COMPLETED))
        .when(name.isin(*C.FAILED_STATUSES), F.lit(C.CONFIDENCE_FAILED))
        .otherwise(F.lit(C.CONFIDENCE_UNKNOWN))
    )


def confidence_band(probability: Column) -> Column:
    """High, Medium or Low by distance from an even chance."""
    distance = F.abs(probability - 0.5)
    return F.when(distance > 0.25, "High").when(distance > 0.1, "Medium").otherwise("Low")


def traffic_light(probability: Column) -> Column:
    """Colour of the whole-number percentage: 60 and up green, 40 and up yellow."""
    percentage = whole_percent(probability)
    return F.when(percentage >= 60, "green").when(percentage >= 40, "yellow").otherwise("red")


def whole_percent(probability: Column) -> Column:
    return F.floor(probability * 100 + 0.5).cast("int")
