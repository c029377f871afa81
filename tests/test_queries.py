import pytest
from pyspark.sql import functions as F

from cohortlens.operators import charts, predicates, search, statistics


def test_unknown_dimension_and_chart(trials):
    with pytest.raises(ValueError):
        statistics.grouped_statistics(trials, "title")
    with pytest.raises(ValueError):
        statistics.compare_groups(trials, "overall_status", "a", "b")
    with pytest.raises(ValueError):
        charts.chart_data(trials, "pie")


def test_no_arguments_filter_nothing(trials):
    assert trials.filter(predicates.trial_filter()).count() == trials.count()
    empty = predicates.trial_filter(query="", phase="", therapeutic_area="", sponsor_class="", status="")
    assert trials.filter(empty).count() == trials.count()


def test_outcome_filter_has_three_values(trials):
    counts = [trials.filter(predicates.trial_filter(outcome_success=o)).count() for o in (True, False)]
    unknown = trials.filter("outcome_success IS NULL").count()
    assert sum(counts) + unknown == trials.count() and min(*counts, unknown) > 0


def test_limits_are_clamped(trials):
    assert search.search_trials(trials, limit=5000).count() == 100
    assert statistics.top_sponsors(trials, limit=5000).count() <= 50


def test_newest_completion_first_and_undated_last(spark, trials):
    few = trials.orderBy(F.asc_nulls_first("completion_date")).limit(60)
    dates = [r["completion_date"] for r in search.search_trials(few, limit=100).collect()]
    known = [x for x in dates if x is not None]
    assert known == sorted(known, reverse=True) and dates[: len(known)] == known and None in dates


def test_query_text_keeps_its_wildcards(spark):
    rows = spark.createDataFrame(
        [("a", "Heart Study", ["x"]), ("b", "other", ["h%t"]), ("c", "none", ["heart"])],
        "nct_id string, title string, conditions array<string>",
    )

    def found(**arguments):
        return {r["nct_id"] for r in rows.filter(predicates.trial_filter(**arguments)).collect()}

    assert found(query="h%t") == {"a", "b"}
    assert found(query="h%t", match_conditions=False) == {"a"}
    assert found(query="heart") == {"a", "c"}


def test_compared_values_keep_their_case(trials):
    rows = {r["side"]: r for r in statistics.compare_groups(trials, "phase", "PHASE1", "phase1").collect()}
    assert rows["group_a"]["total"] > 0 and rows["group_b"]["total"] == 0
    assert rows["group_b"]["success_rate_pct"] is None
    twice = statistics.compare_groups(trials, "phase", "PHASE1", "PHASE1").collect()
    assert len(twice) == 2 and twice[0]["total"] == twice[1]["total"] > 0


def test_statistics_keep_the_null_group_and_charts_drop_it(trials):
    groups = {r["group_name"] for r in statistics.grouped_statistics(trials, "phase").collect()}
    names = {r["name"] for r in charts.chart_data(trials, "success_rate_by_phase").collect()}
    assert groups - names == {None}


def test_bins_come_in_order(trials):
    got = [r["bucket"] for r in charts.chart_data(trials, "enrollment_distribution").collect()]
    order = ["<50", "50-200", "200-500", "500-1K", "1K-5K", ">5K"]
    assert got == [b for b in order if b in got]
