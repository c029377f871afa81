import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import evaluation, splits
from cohortlens.plans import fixtures as X

from conftest import SMALL

SCORED = "nct_id string, model_version string, predicted_proba double, actual_label boolean"


def scored(spark, pairs):
    rows = [(f"N{i}", "v", float(p), bool(a)) for i, (p, a) in enumerate(pairs)]
    df = spark.createDataFrame(rows, SCORED)
    return df.withColumns(evaluation.score_columns(F.col("predicted_proba"), F.col("actual_label")))


def area_by_pairs(pairs):
    pos = [p for p, a in pairs if a]
    neg = [p for p, a in pairs if not a]
    if not pos or not neg:
        return None
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def sample_pairs(kind, seed):
    rng = random.Random(seed)
    draw = {
        "spread": rng.random,
        "tied": lambda: rng.choice([0.1, 0.5, 0.5, 0.9]),
        "crowded": lambda: 0.5 + rng.randrange(40) * 2.0**-50,
        "edges": lambda: rng.choice([0.0, 1.0, 2.0**-60, 1 - 2.0**-53]),
    }[kind]
    return [(draw(), rng.random() < 0.4) for _ in range(300)]


@pytest.mark.parametrize("kind", ["spread", "tied", "crowded", "edges"])
def test_area_equals_pair_counting(spark, kind):
    pairs = sample_pairs(kind, 7)
    row = evaluation.auc_roc(scored(spark, pairs)).first()
    assert row["auc_roc"] == pytest.approx(area_by_pairs(pairs), abs=1e-12)
    assert row["n_positive"] == sum(a for _, a in pairs)


def test_area_is_unchanged_by_a_monotone_map(spark):
    pairs = sample_pairs("spread", 3)
    squared = [(p * p, a) for p, a in pairs]
    one, two = (evaluation.auc_roc(scored(spark, x)).first()["auc_roc"] for x in (pairs, squared))
    assert one == pytest.approx(two, abs=1e-12)


def test_area_needs_both_classes(spark):
    assert evaluation.auc_roc(scored(spark, [(0.3, True), (0.6, True)])).first()["auc_roc"] is None


def pandas_bins(pairs):
    frame = pd.DataFrame(pairs, columns=["p", "a"])
    cut = pd.cut(frame["p"], bins=10)
    grouped = frame.groupby(cut, observed=True)["a"].agg(["mean", "count"])
    return [(float(m), int(n)) for m, n in grouped.itertuples(index=False)]


@pytest.mark.parametrize(
    "pairs",
    [
        sample_pairs("spread", 1),
        [(i / 10, i % 2 == 0) for i in range(11)],
        [(0.25, True), (0.25, False)],
        [(0.0, True), (0.0, False)],
    ],
)
def test_calibration_bins_are_those_of_pandas(spark, pairs):
    rows = evaluation.calibration(scored(spark, pairs)).collect()
    assert [(pytest.approx(r["actual_rate"]), r["n"]) for r in rows] == pandas_bins(pairs)
    assert sum(r["n"] for r in rows) == len(pairs)


def test_metrics_without_positive_predictions(spark):
    row = evaluation.overall_metrics(scored(spark, [(0.1, True), (0.2, False)])).first()
    assert (row["precision_score"], row["recall_score"], row["f1_score"]) == (0.0, 0.0, 0.0)
    assert row["accuracy"] == 0.5


def test_report_and_shares_add_up(spark):
    df = scored(spark, sample_pairs("spread", 9))
    report = {r["class_name"]: r for r in evaluation.class_report(df).collect()}
    assert report["failure"]["support"] + report["success"]["support"] == 300
    assert report["macro avg"]["f1"] == pytest.approx(
        (report["failure"]["f1"] + report["success"]["f1"]) / 2
    )
    assert sum(r["n"] for r in evaluation.confusion_shares(df).collect()) == 300


@pytest.fixture(scope="module")
def rows(spark, trials):
    return splits.training_set(trials).select("nct_id", "label").persist()


def test_rank_is_the_row_number_by_hash(spark, rows):
    import hashlib

    got = splits.shuffled_rank(rows).collect()
    for label in (0, 1):
        mine = [r for r in got if r["label"] == label]
        order = sorted(mine, key=lambda r: hashlib.md5(f"{r['nct_id']}|42".encode()).hexdigest())
        assert [r["stratum_rank"] for r in order] == list(range(1, len(mine) + 1))
        assert {r["stratum_size"] for r in mine} == {len(mine)}


def test_split_is_exact_per_class(rows):
    dealt = splits.stratified_split(rows)
    assert dealt.count() == rows.count() == dealt.select("nct_id").distinct().count()
    for r in dealt.groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect():
        assert r["t"] == -(-r["n"] * 20 // 100)


def test_folds_are_even(rows):
    counts = splits.stratified_folds(rows).groupBy("label", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in counts if r["label"] == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_too_few_training_rows(spark, rows):
    splits.require_rows(rows, 100)
    with pytest.raises(ValueError):
        splits.require_rows(rows.limit(99), 100)


def test_benchmark_limit_and_filters(spark, trials):
    predictions = X.predictions(spark, SMALL)
    limited = evaluation.benchmark_rows(predictions, "v1", limit=7).collect()
    assert [r["nct_id"] for r in limited] == sorted(r["nct_id"] for r in limited) and len(limited) == 7
    phase2 = evaluation.benchmark_rows(predictions, "v1", trials=trials, phase="phase2")
    wanted = trials.filter("phase = 'PHASE2' AND outcome_success IS NOT NULL").count()
    assert phase2.count() == wanted


def test_relative_importance(spark):
    rows = spark.createDataFrame([("a", 0.5), ("b", 0.25), ("c", 1.0)], "feature string, importance double")
    got = [(r["feature"], r["relative_pct"]) for r in evaluation.relative_importance(rows, 2).collect()]
    assert got == [("c", 100.0), ("a", 50.0)]


def test_latest_run_per_version(spark):
    rows = spark.createDataFrame(
        [("v1", 1, 0.5), ("v1", 2, 0.6), ("v2", 1, 0.7)],
        "model_version string, trained_at int, accuracy double",
    )
    got = {(r["model_version"], r["accuracy"]) for r in evaluation.latest_metrics(rows).collect()}
    assert got == {("v1", 0.6), ("v2", 0.7)}


def test_histograms_give_what_their_rows_give(spark):
    rows = spark.range(3000).select(
        (F.col("id") % 2).alias("part"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("model_version"),
        (F.pmod(F.hash("id"), F.lit(97)) / 96.0).alias("predicted_proba"), (F.pmod(F.hash("id", F.lit(1)), F.lit(3)) == 0).alias("actual_label"),
    ).withColumn("predicted_label", F.col("predicted_proba") >= 0.5)
    by = ("model_version",)
    halves = [evaluation.score_histogram(rows.filter(F.col("part") == k), by) for k in (0, 1)]
    whole = evaluation.merged_histograms(*halves)
    assert whole.count() < 97 * 4 + 1 and whole.agg(F.sum(evaluation.WEIGHT)).first()[0] == 3000
    for measure in (evaluation.overall_metrics, evaluation.auc_roc, evaluation.confusion):
        assert sorted(map(tuple, measure(whole, by).collect())) == sorted(map(tuple, measure(rows, by).collect()))
    for measure in (evaluation.calibration, evaluation.class_report, evaluation.confusion_shares):
        assert list(map(tuple, measure(whole).collect())) == list(map(tuple, measure(rows).collect()))
