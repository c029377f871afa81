"""Row filters. Arguments left out or empty restrict nothing."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as C


def contains_text(column: str, needle: str) -> Column:
    """Case-insensitive substring; ``%`` and ``_`` in the needle stay wildcards."""
    return F.col(column).ilike(f"%{needle}%")


def equals_upper(column: str, value: str) -> Column:
    return F.col(column) == value.upper()


def all_of(*conditions: Column | None) -> Column:
    """Conjunction of the given conditions, true when there are none."""
    return reduce(and_, [c for c in conditions if c is not None], F.lit(True))


def labelled() -> Column:
    return F.col("outcome_success").isNotNull()


def confident(floor: float = C.MIN_TRAINING_CONFIDENCE) -> Column:
    return F.col("outcome_confidence") >= floor


def trial_filter(
    query: str | None = None,
    phase: str | None = None,
    therapeutic_area: str | None = None,
    sponsor_class: str | None = None,
    status: str | None = None,
    outcome_success: bool | None = None,
    match_conditions: bool = True,
) -> Column:
    """The optional search arguments as one condition.

    ``match_conditions`` also accepts a trial whose condition list holds the
    query text as an exact member.
    """
    text = None
    if query:
        text = contains_text("title", query)
        if match_conditions:
            text = text | F.array_contains("conditions", query)
    return all_of(
        text,
        equals_upper("phase", phase) if phase else None,
        contains_text("therapeutic_area", therapeutic_area) if therapeutic_area else None,
        equals_upper("sponsor_class", sponsor_class) if sponsor_class else None,
        equals_upper("overall_status", status) if status else None,
        (F.col("outcome_success") == F.lit(outcome_success))
        if outcome_success is not None
        else None,
    )


def by_key(df: DataFrame, nct_id: str) -> DataFrame:
    """The row of one trial; the comparison reaches the file scan as it stands."""
    return df.filter(F.col("nct_id") == nct_id.upper())


def by_status(df: DataFrame, statuses=C.DEFAULT_INGEST_STATUSES, query: str | None = None):
    """Source filter: wanted statuses and an optional title text."""
    text = contains_text("title", query) if query else None
    return df.filter(all_of(F.col("overall_status").isin(*statuses), text))


def first_by_key(df: DataFrame, count: int) -> DataFrame:
    """The first ``count`` records in key order, the same ones on every run."""
    return df.orderBy("nct_id").limit(count)
