"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import charts, evaluation, search, splits, statistics, upsert
from cohortlens.plans import fixtures
from cohortlens.plans.catalog import QUERIES
from cohortlens.sources import tables

from conftest import SMALL

# these run jobs while they are built; their parts are looked at below
EAGER = {
    "stream_ingest", "stream_alarms", "stream_over_limit", "table_scan", "job_log",
    "prediction_store", "metrics_store", "model_reload", "gbt_metrics", "gbt_scores",
    "gbt_score_by_id", "score_designs", "gbt_importance", "shap_importance", "cv_auc",
    "score_properties", "score_by_id_properties", "design_properties", "attribution_properties",
    "quality_from_histogram", "importance_properties", "fold_properties", "stored_run", "reload_properties",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_pairwise_joins_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert node not in text


@pytest.mark.parametrize("name, key", [("trial_details", "NCT00000042"), ("trial_details_full", "NCT00000012")])
def test_registered_look_ups_read_one_file(spark, name, key):
    found = QUERIES[name](spark, SMALL)
    assert f"EqualTo(nct_id,{key})" in plan(found) and len(found.inputFiles()) == 1


@pytest.fixture(scope="module")
def stored(spark, trials, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("trials") / "t")
    rows = trials.withColumn("raw_json", F.lit(None).cast("string"))
    tables.with_bookkeeping(rows).write.parquet(path)
    return tables.read_trials(spark, path)


def scans(df):
    return re.findall(r"FileScan parquet \[([^\]]*)\]", plan(df))


def columns(scan):
    return {c.split("#")[0] for c in scan.split(",")}


def test_key_lookup_is_pushed_to_the_scan(stored):
    text = plan(search.trial_details(stored, "nct00000001"))
    assert "EqualTo(nct_id,NCT00000001)" in text


def test_search_is_a_top_k_over_pushed_filters(stored):
    text = plan(search.search_trials(stored, phase="phase2", outcome_success=True))
    assert "TakeOrderedAndProject" in text
    assert "EqualTo(phase,PHASE2)" in text and "EqualTo(outcome_success,true)" in text


def test_statistics_read_only_their_columns_in_one_scan(stored):
    found = scans(statistics.grouped_statistics(stored, "phase"))
    assert [columns(s) for s in found] == [{"phase", "enrollment", "duration_days", "outcome_success"}]


def test_comparison_scans_once(stored):
    for compact in (True, False):
        df = statistics.compare_groups(stored, "phase", "PHASE1", "PHASE2", compact=compact)
        df.collect()
        final = plan(df).split("Initial Plan")[0]
        assert final.count("FileScan parquet") == 1 and "In(phase, [PHASE1,PHASE2])" in final


@pytest.mark.parametrize("kind", sorted(charts.CHARTS))
def test_charts_aggregate_before_the_shuffle(stored, kind):
    text = plan(charts.chart_data(stored, kind))
    assert text.count("FileScan") == 1 and "partial_count" in text


def test_small_batch_leaves_the_target_unshuffled(stored):
    batch = stored.filter("phase = 'PHASE1'").drop("ingested_at", "updated_at", "number_of_groups")
    batch = batch.withColumn("title", F.lit("new"))
    df = upsert.upsert(stored, batch)
    df.collect()
    text = plan(df)
    final = text[: text.index("Initial Plan")] if "Initial Plan" in text else text
    assert "BroadcastHashJoin [nct_id" in final and "LeftAnti" in final and "SortMergeJoin" not in final


def test_copies_of_a_key_are_reduced_before_the_shuffle(spark):
    rows = spark.range(1000).select(F.lit("k").alias("k"), F.col("id").alias("n"), F.lit("x").alias("v"))
    assert "partial_max_by" in plan(upsert.latest_per_key(rows, ["k"], ["n"]))


def test_area_counts_pairs_over_reduced_scores(spark):
    df = evaluation.auc_roc(QUERIES["prediction_flags"](spark, SMALL).select(
        F.lit(0.5).alias("predicted_proba"), F.col("correct").alias("actual_label")))
    assert "partial_count" in plan(df)


def test_training_set_is_one_pass_without_shuffle(stored):
    text = plan(splits.training_set(stored))
    assert "Exchange" not in text and ">= 0.6" in text and "PushedFilters: [IsNotNull" in text


def test_order_lines_move_once_by_order(spark):
    """Suppliers are counted without an exchange by order and supplier."""
    lines = plan(fixtures.trials(spark, SMALL, ("nct_id", "locations_count", "title")))
    assert not re.search(r"hashpartitioning\(l_orderkey#\d+L?, l_suppkey", lines)


def test_suppliers_are_counted_once_and_nulls_not(spark, tmp_path):
    day = "timestamp_ntz'2020-01-01'"
    lines = spark.sql(f"SELECT * FROM VALUES (1L, 5L, 7L, {day}), (1L, 5L, 7L, {day}), (1L, 5L, 8L, {day}), (1L, 5L, NULL, {day}), (2L, 5L, NULL, {day}) AS t(l_orderkey, l_partkey, l_suppkey, l_shipdate)")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    folded = fixtures._lines(spark, str(tmp_path), False, False).select("l_orderkey", "n_lines", "n_suppliers")
    assert sorted(map(tuple, folded.collect())) == [(1, 4, 2), (2, 1, 0)]


def test_pages_are_dealt_out_before_documents_are_made(spark):
    text = fixtures.study_pages(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    above, below = text.split("RepartitionByExpression [page_number", 1)
    assert "protocolSection" in above and "protocolSection" not in below


@pytest.mark.parametrize("name, unread", [
    ("normalize_arrays", "eligibilityModule"), ("normalize_core", "conditionsModule"), ("raw_documents", "armGroups"),
])
def test_documents_are_parsed_for_what_is_asked(spark, name, unread):
    schemas = re.findall(r"from_json\((StructField.*?)\), \(", plan(QUERIES[name](spark, SMALL)))
    assert schemas and not any(unread in s for s in schemas)


@pytest.mark.parametrize("name", ["raw_documents", "quarantine", "page_source"])
def test_lists_are_not_sorted_in_every_row(spark, name):
    rows = re.sub(r"Subquery.*", "", plan(QUERIES[name](spark, SMALL)), flags=re.S)
    assert "array_sort" not in rows
