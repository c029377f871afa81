"""Text to typed value: therapeutic area, age in years, registry dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens.constants import AREA_KEYWORDS, OTHER_AREA


def joined_conditions(conditions: Column) -> Column:
    """Lower-cased, space-joined condition list: the text areas are read from."""
    return F.lower(F.array_join(F.coalesce(conditions, F.array().cast("array<string>")), " "))


def therapeutic_area(lowered_text: str) -> Column:
    """Area of the first listed keyword that occurs anywhere in the named column.

    It takes a column name because the text is looked at once per keyword and
    should have been worked out before.
    """
    branches = " ".join(
        f"WHEN contains({lowered_text}, '{keyword}') THEN '{area}'"
        for keyword, area in AREA_KEYWORDS
    )
    return F.expr(f"CASE {branches} ELSE '{OTHER_AREA}' END")


def age_years(text: Column) -> Column:
    """Age text in whole years; months and weeks count as one year at least.

    Units other than year, month and week are ignored (``30 Days`` is 30), and
    anything whose first word is not a whole number is null.
    """
    lowered = F.lower(text)
    word = F.regexp_extract(lowered, r"^\s*(\S+)", 1)
    number = F.when(word.rlike(r"^[+-]?\d+$"), word.try_cast("int"))

    def at_least_one(per_year: int) -> Column:
        # greatest() skips nulls, hence the guard
        return F.when(
            number.isNotNull(), F.greatest(F.lit(1), F.floor(number / per_year).cast("int"))
        )

    return (
        F.when(F.contains(lowered, F.lit("year")), number)
        .when(F.contains(lowered, F.lit("month")), at_least_one(12))
        .when(F.contains(lowered, F.lit("week")), at_least_one(52))
        .otherwise(number)
    )


# Accepted date shapes, tried in this order
_DATE_SHAPES = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^[A-Za-z]+ \d{4}$", "MMMM yyyy"),
    (r"^\d{4}$", "yyyy"),
)


def registry_date(text: Column) -> Column:
    """Full date, ``Month YYYY`` (first of month) or ``YYYY`` (first of year).

    Each shape is checked by pattern before it is parsed, so a lenient parser
    never gets to guess; every other shape is null.
    """
    cleaned = F.trim(F.regexp_replace(text, r"\s+", " "))
    attempts = [
        F.when(cleaned.rlike(shape), F.try_to_timestamp(cleaned, F.lit(pattern)).cast("date"))
        for shape, pattern in _DATE_SHAPES
    ]
    return F.coalesce(*attempts)


def none_if_empty(text: Column, length: int) -> Column:
    """First ``length`` characters, null instead of an empty string."""
    return F.nullif(F.substring(text, 1, length), F.lit(""))
