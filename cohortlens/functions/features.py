"""The 17 model inputs, each a double without nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.functions.encoding import coded


def _number(name: str) -> Column:
    return F.col(name).try_cast("double")


def _or_else(name: str, default: float) -> Column:
    return F.coalesce(_number(name), F.lit(default))


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def feature_expressions() -> dict[str, Column]:
    """Feature name to expression over the trial columns, in model order."""
    sponsor = F.upper(F.col("sponsor_class"))
    types = F.transform(F.col("intervention_types"), F.upper)
    first_known = F.get(F.filter(types, lambda t: t.isin(*C.INTERVENTION_CODES)), F.lit(0))
    countries = F.when(F.col("countries").isNotNull(), F.size("countries")).otherwise(1)
    sites = _or_else("locations_count", 1)
    arms = _or_else("number_of_arms", 1)
    expressions = {
        "phase_numeric": coded(F.col("phase"), C.PHASE_CODES, C.PHASE_DEFAULT),
        "sponsor_class_encoded": coded(sponsor, C.SPONSOR_CODES, C.SPONSOR_DEFAULT),
        "intervention_type_encoded": coded(
            first_known, C.INTERVENTION_CODES, C.INTERVENTION_DEFAULT
        ),
        "therapeutic_area_encoded": coded(
            F.col("therapeutic_area"), C.AREA_CODES, C.AREA_DEFAULT
        ),
        "enrollment_log": F.log1p(_or_else("enrollment", 0)),
        "duration_days_log": F.log1p(_or_else("duration_days", 0)),
        "number_of_arms": F.least(F.lit(20.0), F.greatest(F.lit(1.0), arms)),
        "locations_count_log": F.log1p(sites),
        "n_countries": countries,
        "eligibility_min_age": _or_else("eligibility_min_age", 18),
        "eligibility_max_age": _or_else("eligibility_max_age", 65),
        "is_industry_sponsored": _flag(sponsor == "INDUSTRY"),
        "is_multicenter": _flag(sites > 1),
        "is_international": _flag(countries > 1),
        "has_drug_intervention": _flag(F.exists(types, lambda t: t == "DRUG")),
        "enrollment_missing": _flag(_number("enrollment").isNull()),
        "duration_missing": _flag(_number("duration_days").isNull()),
    }
    return {name: expressions[name].cast("double") for name in C.FEATURE_COLUMNS}
