"""Trial search and detail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.operators.predicates import by_key, trial_filter

# The columns of each answer, in order
SEARCH_COLUMNS = (
    "nct_id", "title", "overall_status", "phase", "therapeutic_area", "sponsor_name",
    "sponsor_class", "enrollment", "duration_days", "has_results", "outcome_success",
    "start_date", "completion_date",
)
COMPACT_SEARCH_COLUMNS = (
    "nct_id", "title", "overall_status", "phase", "therapeutic_area", "sponsor_name",
    "enrollment", "duration_days", "outcome_success",
)
DETAIL_COLUMNS = (
    "nct_id", "title", "brief_summary", "overall_status", "phase", "study_type",
    "conditions", "therapeutic_area", "intervention_types", "intervention_names",
    "sponsor_name", "sponsor_class", "enrollment", "number_of_arms", "start_date",
    "primary_completion_date", "completion_date", "duration_days", "has_results",
    "primary_outcome_measure", "primary_outcome_timeframe", "locations_count",
    "countries", "eligibility_min_age", "eligibility_max_age", "eligibility_gender",
    "outcome_success", "outcome_confidence",
)


def search_trials(
    trials: DataFrame, limit: int = 20, compact: bool = False, **filters
) -> DataFrame:
    """Matching trials, newest completion first and undated ones last.

    Filters are those of :func:`trial_filter`. Sort and limit run as one top-k
    per partition, so only ``limit`` rows per task reach the last step. The
    compact form has fewer columns and looks at titles only.
    """
    if compact:
        filters["match_conditions"] = False
    return (
        trials.filter(trial_filter(**filters))
        .orderBy(F.desc_nulls_last("completion_date"), "nct_id")
        .limit(min(limit, C.SEARCH_LIMIT))
        .select(*(COMPACT_SEARCH_COLUMNS if compact else SEARCH_COLUMNS))
    )


def trial_details(trials: DataFrame, nct_id: str, full: bool = False) -> DataFrame:
    """One trial by id: the named columns, or all but the raw document.

    An unknown id gives a frame without rows.
    """
    row = by_key(trials, nct_id)
    return row.drop("raw_json") if full else row.select(*DETAIL_COLUMNS)
