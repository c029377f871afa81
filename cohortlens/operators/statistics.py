"""Grouped success statistics, two-group comparison, sponsor ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.functions.arithmetic import mean_rounded, percent
from cohortlens.operators.predicates import all_of, labelled, trial_filter


def measures(**renamed: str) -> dict[str, Column]:
    """The outcome aggregates; ``renamed`` gives a measure another name.

    All are plain sums and counts with partial aggregation.
    """
    total = F.count(F.lit(1))
    successes = F.count_if("outcome_success")
    table = {
        "total": total,
        "successes": successes,
        "success_rate_pct": percent(successes, total),
        "avg_enrollment": mean_rounded(F.col("enrollment")),
        "avg_duration_days": mean_rounded(F.col("duration_days")),
    }
    return {key: column.alias(renamed.get(key, key)) for key, column in table.items()}


def _allowed(dimension: str, allowed: tuple[str, ...]) -> str:
    if dimension not in allowed:
        raise ValueError(f"dimension must be one of {', '.join(allowed)}: {dimension!r}")
    return dimension


def grouped_statistics(
    trials: DataFrame,
    group_by: str,
    therapeutic_area: str | None = None,
    phase: str | None = None,
    sponsor_class: str | None = None,
    compact: bool = False,
) -> DataFrame:
    """Counts, success rate and means per value of one dimension, largest first.

    Trials without a value form a group of their own. The compact form leaves
    out the mean duration.
    """
    _allowed(group_by, C.STATISTIC_DIMENSIONS)
    m = measures()
    names = ["total", "successes", "success_rate_pct", "avg_enrollment"]
    if not compact:
        names.append("avg_duration_days")
    where = trial_filter(
        phase=phase, therapeutic_area=therapeutic_area, sponsor_class=sponsor_class
    )
    return (
        trials.filter(all_of(labelled(), where))
        .groupBy(F.col(group_by).alias("group_name"))
        .agg(*[m[n] for n in names])
        .orderBy(F.desc("total"), F.asc_nulls_last("group_name"))
    )


#: A cell takes the values with the same higher bits: at most 65,536 cells, with as many values each.
CELL_BITS = 16


def _group_measures(rows: DataFrame) -> DataFrame:
    """Per ``name``: the measures of :func:`measures`, the median by selection.

    Rows are counted per head count and group. The cells of 65,536 head counts
    are summed up in order, which shows the one or two cells that hold the
    middle ranks, and only the values inside them are ranked. So no task ever
    orders all head counts of a group, however many differ, and the result is
    exact. Sums come from the cells, those of the picked ones from their
    values: both branches then need all columns, and Spark reads and counts the
    source once for them.
    """
    sums = {
        "_n": F.count(F.lit(1)),
        "_hits": F.count_if("outcome_success"),
        "_days": F.sum(F.col("duration_days").cast("long")),
        "_dated": F.count("duration_days"),
    }
    counted = rows.groupBy("name", "enrollment").agg(*[v.alias(k) for k, v in sums.items()])
    counted = counted.withColumns(
        {
            "_cell": F.shiftright("enrollment", CELL_BITS),
            "_known": F.when(F.col("enrollment").isNotNull(), F.col("_n")).otherwise(0),
            "_heads": F.col("enrollment") * F.col("_n"),
        }
    )
    names = [*sums, "_known", "_heads"]
    group = Window.partitionBy("name")
    earlier = group.orderBy(F.asc_nulls_first("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        counted.groupBy("name", "_cell")
        .agg(*[F.sum(c).alias(c) for c in names])
        .withColumns({f"_all{c}": F.sum(c).over(group) for c in names})
        .withColumn("_before", F.coalesce(F.sum("_known").over(earlier), F.lit(0)))
    )
    low = F.call_function("div", F.col("_all_known") - 1, F.lit(2))
    high = F.call_function("div", F.col("_all_known"), F.lit(2))
    nothing = F.col("_all_known") == 0
    held = (F.col("_known") > 0) & (F.col("_before") <= high) & (F.col("_before") + F.col("_known") > low)
    picked = cells.filter(nothing | held).select(
        F.col("name").alias("_name"), F.col("_cell").alias("_picked"), "_before",
        *[F.col(f"_all{c}") for c in names], *[F.col(c).alias(f"_cell{c}") for c in names],
    )
    same = (F.col("name") == F.col("_name")) & F.col("_cell").eqNullSafe(F.col("_picked"))
    inside = Window.partitionBy("name", "_cell").orderBy("enrollment").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.join(picked, same).withColumn("_at", F.col("_before") + F.coalesce(F.sum("_known").over(inside), F.lit(0)))

    def at_rank(rank: Column) -> Column:
        here = (F.col("_at") <= rank) & (F.col("_at") + F.col("_known") > rank)
        return F.max(F.when(here, F.col("enrollment")))

    def total(c: str) -> Column:
        # what lies outside the picked cells, and what the values inside add up to
        outside = F.first(f"_all{c}") - F.sum(F.coalesce(F.when(F.col("_first"), F.col(f"_cell{c}")), F.lit(0)))
        return outside + F.coalesce(F.sum(c), F.lit(0))

    first = F.row_number().over(Window.partitionBy("name", "_cell").orderBy("enrollment")) == 1
    added = ranked.withColumn("_first", first).groupBy("name").agg(
        *[total(c).alias(c) for c in names], at_rank(low).alias("_low"), at_rank(high).alias("_high")
    )
    return added.select(
        "name",
        F.col("_n").alias("total"),
        F.col("_hits").alias("successes"),
        percent(F.col("_hits"), F.col("_n")).alias("success_rate_pct"),
        F.round(F.try_divide("_heads", "_known"), 0).alias("avg_enrollment"),
        F.round(F.try_divide("_days", "_dated"), 0).alias("avg_duration_days"),
        ((F.col("_low").cast("double") + F.col("_high")) / 2).alias("median_enrollment"),
    )


def compare_groups(
    trials: DataFrame,
    dimension: str,
    group_a: str,
    group_b: str,
    therapeutic_area: str | None = None,
    compact: bool = False,
) -> DataFrame:
    """The same measures for two values of a dimension, from a single scan.

    Values are compared as given, without changing case. A value nobody has
    appears with total 0 and nulls. The compact form has no median.
    """
    _allowed(dimension, C.COMPARE_DIMENSIONS)
    names = ["total", "successes", "success_rate_pct", "avg_enrollment", "avg_duration_days"]
    rows = trials.filter(
        all_of(
            labelled(),
            F.col(dimension).isin(group_a, group_b),
            trial_filter(therapeutic_area=therapeutic_area),
        )
    )
    if compact:
        m = measures()
        found = rows.groupBy(F.col(dimension).alias("name")).agg(*[m[n] for n in names])
    else:
        names.append("median_enrollment")
        found = _group_measures(
            rows.select(F.col(dimension).alias("name"), "enrollment", "outcome_success", "duration_days")
        )
    first = F.col("id") == 0
    asked = trials.sparkSession.range(0, 2, 1, 1).select(
        F.when(first, "group_a").otherwise("group_b").alias("side"),
        F.when(first, F.lit(group_a)).otherwise(F.lit(group_b)).alias("name"),
    )
    return asked.join(found, "name", "left").select(
        "side", "name", F.coalesce("total", F.lit(0).cast("long")).alias("total"), *names[1:]
    )


def top_sponsors(
    trials: DataFrame,
    limit: int = 10,
    therapeutic_area: str | None = None,
    phase: str | None = None,
    compact: bool = False,
) -> DataFrame:
    """Sponsors with at least three labelled trials, most trials first."""
    m = measures(total="total_trials")
    names = ["total", "successes", "success_rate_pct", "avg_enrollment"]
    if compact:
        names = ["total", "success_rate_pct"]
    where = all_of(
        labelled(),
        F.col("sponsor_name").isNotNull(),
        trial_filter(phase=phase, therapeutic_area=therapeutic_area),
    )
    return (
        trials.filter(where)
        .groupBy("sponsor_name", "sponsor_class")
        .agg(*[m[n] for n in names])
        .filter(F.col("total_trials") >= C.MIN_SPONSOR_TRIALS)
        .orderBy(F.desc("total_trials"), "sponsor_name", "sponsor_class")
        .limit(min(limit, C.SPONSOR_LIMIT))
    )
