"""Chart-ready aggregates. Rows without the charted value are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.functions.encoding import bin_label
from cohortlens.operators.predicates import all_of, labelled, trial_filter
from cohortlens.operators.statistics import measures


def _measures() -> dict[str, Column]:
    return measures(success_rate_pct="success_rate")


def success_by(trials: DataFrame, dimension: str, *extra: str) -> DataFrame:
    m = _measures()
    return (
        trials.filter(F.col(dimension).isNotNull())
        .groupBy(F.col(dimension).alias("name"))
        .agg(m["success_rate_pct"], m["total"], *[m[e] for e in extra])
    )


def bucketed_success(trials: DataFrame, value: str, bins) -> DataFrame:
    """Count and success rate per bin, bins in the order of their smallest value."""
    m = _measures()
    return (
        trials.filter(F.col(value).isNotNull())
        .groupBy(bin_label(F.col(value), bins).alias("bucket"))
        .agg(m["total"], m["success_rate_pct"], F.min(value).alias("_smallest"))
        .orderBy("_smallest")
        .drop("_smallest")
    )


def phase_chart(trials: DataFrame, compact: bool = False) -> DataFrame:
    return success_by(trials, "phase").orderBy("name")


def area_chart(trials: DataFrame, compact: bool = False) -> DataFrame:
    return success_by(trials, "therapeutic_area").orderBy(F.desc("success_rate"), "name")


def enrollment_chart(trials: DataFrame, compact: bool = False) -> DataFrame:
    bins = C.ENROLLMENT_BINS_COMPACT if compact else C.ENROLLMENT_BINS
    return bucketed_success(trials, "enrollment", bins)


def volume_chart(trials: DataFrame, compact: bool = False) -> DataFrame:
    """Trials per start year; the year is its first day, with its number beside it."""
    m = _measures()
    chosen = [m["total"]] if compact else [m["total"], m["successes"]]
    return (
        trials.filter(F.col("start_date").isNotNull())
        .groupBy(F.trunc("start_date", "year").alias("year"))
        .agg(*chosen)
        .withColumn("year_number", F.year("year"))
        .orderBy("year")
    )


def sponsor_chart(trials: DataFrame, compact: bool = False) -> DataFrame:
    extra = () if compact else ("avg_enrollment",)
    return (
        success_by(trials, "sponsor_class", *extra)
        .orderBy(F.desc("total"), "name")
        .limit(C.SPONSOR_CHART_ROWS)
    )


def duration_chart(trials: DataFrame, compact: bool = False) -> DataFrame:
    bins = C.DURATION_BINS_COMPACT if compact else C.DURATION_BINS
    return bucketed_success(trials, "duration_days", bins)


CHARTS = {
    "success_rate_by_phase": phase_chart,
    "success_rate_by_area": area_chart,
    "enrollment_distribution": enrollment_chart,
    "trial_volume_over_time": volume_chart,
    "sponsor_comparison": sponsor_chart,
    "duration_vs_success": duration_chart,
}


def chart_data(
    trials: DataFrame,
    chart_type: str,
    therapeutic_area: str | None = None,
    phase: str | None = None,
    compact: bool = False,
) -> DataFrame:
    """Rows of one chart over the labelled trials that pass the two filters."""
    if chart_type not in CHARTS:
        raise ValueError(f"unknown chart type: {chart_type!r}")
    where = all_of(labelled(), trial_filter(phase=phase, therapeutic_area=therapeutic_area))
    return CHARTS[chart_type](trials.filter(where), compact)
