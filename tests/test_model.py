from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.constants import FEATURE_COLUMNS
from cohortlens.operators import attribution, model, splits
from cohortlens.plans import fixtures as X
from cohortlens.sources import artifacts

from conftest import SMALL

SHORT = model.Boosting(trees=3, depth=3)


@pytest.fixture(scope="module")
def trained(trials):
    return model.train_model(trials, SHORT)


def test_run_metrics(trained, trials):
    row = trained.metrics.first()
    labelled = trials.filter("outcome_success IS NOT NULL").count()
    assert row["n_train"] + row["n_test"] == labelled
    assert row["n_test"] == trained.holdout.count()
    assert 0 <= row["auc_roc"] <= 1 and 0 <= row["accuracy"] <= 1


def test_scores_are_complete_and_consistent(trained, trials):
    scores = model.score_trials(trained.model, trials)
    assert scores.count() == trials.count()
    row = scores.agg(
        F.max(F.abs(F.col("success_probability") + F.col("failure_probability") - 1)),
        F.count_if(F.col("predicted_success") != (F.col("success_probability") >= 0.5)),
    ).first()
    assert row[0] < 1e-9


def test_a_learnable_label_is_learned(spark):
    rows = spark.range(600).select(
        F.col("id").cast("string").alias("nct_id"),
        *[((F.hash("id", F.lit(n)) % 100).cast("double")).alias(n) for n in FEATURE_COLUMNS],
    )
    rows = rows.withColumn("label", (F.col("enrollment_log") > 0).cast("int"))
    fitted = model.fit(rows, SHORT)
    scored = model.score_holdout(fitted, rows)
    assert scored.agg(F.avg(F.col("correct").cast("int"))).first()[0] > 0.99
    assert model.importance(fitted, spark, 1).first()["feature"] == "enrollment_log"


def test_unknown_trial_has_no_score(trained, trials):
    assert model.score_trial(trained.model, trials, "NCT99999999").isEmpty()
    assert model.score_trial(trained.model, trials, "nct00000003").count() == 1


def test_designs_are_scored_in_bulk(spark, trained):
    designs = X.designs(spark, SMALL)
    assert model.score_designs(trained.model, designs, "design_id").count() == designs.count()


def test_artefacts(spark, trained, trials, tmp_path):
    folder = str(tmp_path)
    artifacts.save_model(trained.model, trained.metrics, folder, "v1")
    loaded = artifacts.load_model(folder, "v1")
    one, two = (model.score_trials(m, trials) for m in (trained.model, loaded))
    assert one.exceptAll(two).isEmpty()
    assert artifacts.load_meta(spark, folder, "v1").first()["n_test"] == trained.metrics.first()["n_test"]
    with pytest.raises(FileNotFoundError):
        artifacts.load_model(folder, "v2")
    with pytest.raises(FileNotFoundError):
        artifacts.load_meta(spark, folder, "v2")


def test_cross_validation(trials):
    per_fold, summary = model.cross_validate(trials, model.Boosting(trees=1, depth=2), folds=3)
    areas = [r["auc_roc"] for r in per_fold.collect()]
    row = summary.first()
    assert len(areas) == 3
    assert row["cv_auc_mean"] == pytest.approx(np.mean(areas))
    assert row["cv_auc_std"] == pytest.approx(np.std(areas))


def test_attributions_add_up_to_the_log_odds(trained):
    explained = attribution.attributions(trained.model, trained.holdout)
    both = explained.join(trained.holdout.select("nct_id", "predicted_proba"), "nct_id")
    p = F.col("predicted_proba")
    total = sum((F.col(n) for n in FEATURE_COLUMNS), F.col("base"))
    row = both.agg(F.max(F.abs(total - F.log(p / (1 - p)))), F.count("*")).first()
    assert row[0] < 1e-9 and row[1] == trained.holdout.count()


def conditional_mean(node, x, known):
    """Expected tree output when only the features in ``known`` are given."""
    if node.subtreeDepth() == 0:
        return node.prediction()
    split, children = node.split(), (node.leftChild(), node.rightChild())
    if split.featureIndex() in known:
        return conditional_mean(children[int(x[split.featureIndex()] > split.threshold())], x, known)
    weights = [c.impurityStats().count() for c in children]
    values = [conditional_mean(c, x, known) for c in children]
    return float(np.dot(weights, values) / sum(weights))


def test_attributions_are_shapley_values(trained):
    fitted = model.fit(trained.holdout, model.Boosting(trees=2, depth=2))
    booster = fitted.stages[-1]
    trees = [t._call_java("rootNode") for t in booster.trees]
    rows = trained.holdout.orderBy("nct_id").limit(3)
    explained = {r["nct_id"]: r for r in attribution.attributions(fitted, rows).collect()}
    used = sorted({i for t in booster.trees for i in np.nonzero(t.featureImportances.toArray())[0]})
    assert 1 < len(used) <= 6

    for row in rows.collect():
        x = [row[n] for n in FEATURE_COLUMNS]
        cache = {}

        def value(known):
            if known not in cache:
                cache[known] = sum(
                    2 * w * conditional_mean(t, x, set(known))
                    for t, w in zip(trees, booster.treeWeights)
                )
            return cache[known]

        n = len(used)
        for i in used[:2]:
            others = [u for u in used if u != i]
            phi = sum(
                factorial(k) * factorial(n - k - 1) / factorial(n)
                * (value(tuple(sorted((*s, i)))) - value(s))
                for k in range(n)
                for s in combinations(others, k)
            )
            assert explained[row["nct_id"]][FEATURE_COLUMNS[i]] == pytest.approx(phi, abs=1e-9)


def test_mean_attribution_is_sorted(trained):
    rows = attribution.mean_attribution(attribution.attributions(trained.model, trained.holdout)).collect()
    values = [r["importance"] for r in rows]
    assert len(rows) == 17 and values == sorted(values, reverse=True)


def random_tree(draw, depth, features):
    """Nodes of a full tree with random splits; some branches have no training weight."""
    nodes = []

    def grow(level, weight):
        number = len(nodes)
        nodes.append(None)
        if level == depth:
            nodes[number] = (draw.normal(), weight, -1, -1, -1, np.nan)
            return number
        share = draw.choice([0.0, draw.uniform(0.1, 0.9)], p=[0.05, 0.95])
        left, right = grow(level + 1, weight * share), grow(level + 1, weight * (1 - share))
        nodes[number] = (0.0, weight, left, right, int(draw.integers(features)), draw.uniform(0.2, 0.8))
        return number

    grow(0, 1000.0)
    return np.array(nodes, attribution.NODE)


def subset_attributions(x, nodes):
    """Shapley values of each leaf from a table over all subsets of its path."""
    out = np.zeros(len(x))
    for paths in attribution.leaf_paths(nodes):
        for value, features, lows, highs, shares in zip(paths.values, paths.features, paths.lows, paths.highs, paths.shares):
            k = len(features)
            met = (x[features] > lows) & (x[features] <= highs)
            for i in range(k):
                rest = [j for j in range(k) if j != i]
                total = sum(
                    factorial(size) * factorial(k - size - 1) / factorial(k)
                    * np.prod([met[j] for j in known]) * np.prod([shares[j] for j in rest if j not in known])
                    for size in range(k)
                    for known in combinations(rest, size)
                )
                out[features[i]] += value * (float(met[i]) - shares[i]) * total
    return out


@pytest.mark.parametrize("depth", [1, 2, 3, 5, 6])
def test_paths_equal_tables_over_subsets(depth):
    draw = np.random.default_rng(depth)
    nodes = random_tree(draw, depth, 7)
    x = draw.uniform(size=(5, 7))
    out = np.zeros_like(x)
    for paths in attribution.leaf_paths(nodes):
        attribution.path_attributions(x, paths, out)
    assert np.allclose(out, [subset_attributions(row, nodes) for row in x], atol=1e-12)


def test_deep_trees_add_up():
    draw = np.random.default_rng(12)
    trees = [random_tree(draw, 12, 17) for _ in range(2)]
    x = draw.uniform(size=(40, 17))
    out = np.zeros_like(x)
    for groups in attribution._laid_out(trees, {}):
        for paths in groups:
            attribution.path_attributions(x, paths, out)

    def value(nodes, row):
        number = 0
        while nodes[number]["left"] >= 0:
            number = nodes[number]["left" if row[nodes[number]["feature"]] <= nodes[number]["threshold"] else "right"]
        return nodes[number]["value"]

    totals = [sum(value(t, row) for t in trees) for row in x]
    assert max(p.features.shape[1] for p in attribution.leaf_paths(trees[0])) > 9
    assert np.allclose(out.sum(axis=1) + attribution.base_value(trees), totals, atol=1e-9)


def test_fitted_deep_model_is_explained(trained):
    deep = model.fit(trained.holdout, model.Boosting(trees=2, depth=12))
    explained = attribution.attributions(deep, trained.holdout)
    scored = model.score_holdout(deep, trained.holdout.select("nct_id", "label", *FEATURE_COLUMNS))
    p = F.col("predicted_proba")
    total = sum((F.col(n) for n in FEATURE_COLUMNS), F.col("base"))
    both = explained.join(scored.select("nct_id", "predicted_proba"), "nct_id")
    assert both.agg(F.max(F.abs(total - F.log(p / (1 - p))))).first()[0] < 1e-9


def test_a_run_is_published_whole_or_not_at_all(spark, trained, trials, tmp_path, monkeypatch):
    from cohortlens.sources import runs

    folder = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        runs.load_run(spark, folder)
    assert runs.train_and_store(trials, folder, settings=model.Boosting(trees=1, depth=2), folds=2) == 0
    first = runs.load_run(spark, folder)
    row = first.metrics.first()
    assert row["n_test"] == first.predictions.count() and len(row["feature_importance"]) == 17
    assert 0 <= row["cv_auc_mean"] <= 1 and row["cv_auc_std"] >= 0 and row["trained_at"] is not None
    one = first.predictions.first()
    assert set(one["features"]) == set(FEATURE_COLUMNS) and one["model_version"] == "v1"

    def broken(*_):
        raise RuntimeError("no disk")

    cv = spark.createDataFrame([(0.5, 0.1)], "cv_auc_mean double, cv_auc_std double")
    with monkeypatch.context() as patch:
        patch.setattr(runs, "metrics_row", broken)
        with pytest.raises(RuntimeError):
            runs.store_run(folder, trained, cv)
    assert runs.load_run(spark, folder).metrics.first() == row
    assert runs.store_run(folder, trained, cv) == 1
    second = runs.load_run(spark, folder)
    assert second.number == 1 and second.metrics.first()["cv_auc_mean"] == 0.5
    scores = [model.score_trials(m, trials) for m in (trained.model, second.model)]
    assert scores[0].exceptAll(scores[1]).isEmpty()
    assert runs.load_run(spark, folder, number=0).metrics.first() == row


def test_jobs_run_side_by_side_and_fail_aloud(spark):
    import time

    pool = "spark.scheduler.pool"

    def work(k):
        def run():
            time.sleep(0.5)
            return spark.sparkContext.getLocalProperty(pool), spark.range(k + 1).count()

        return run

    began = time.perf_counter()
    assert model.side_by_side(spark, [work(k) for k in range(5)], "t") == [(f"t-{k}", k + 1) for k in range(5)]
    assert time.perf_counter() - began < 2.4 and spark.sparkContext.getLocalProperty(pool) is None

    def fails():
        raise ValueError("one")

    with pytest.raises(ValueError, match="one"):
        model.side_by_side(spark, [work(0), fails], "t")


def test_patterns_of_short_paths_equal_the_polynomial(monkeypatch):
    draw = np.random.default_rng(4)
    trees = [random_tree(draw, 6, 9) for _ in range(3)]
    x = np.round(draw.uniform(size=(300, 9)), 2)
    for nodes in trees:  # some rows lie on a bound
        x[:50, 3] = next((t["threshold"] for t in nodes if t["feature"] == 3), 0.5)
    found = []
    for most in (6, 0):
        monkeypatch.setattr(attribution, "_TABLE", most)
        out = np.zeros_like(x)
        for groups in attribution._laid_out(trees, {}):
            for paths in groups:
                attribution.path_attributions(x, paths, out)
                assert (paths.patterns is not None) == (0 < paths.features.shape[1] <= most)
        found.append(out)
    assert np.abs(found[0]).max() > 0.1 and np.allclose(*found, atol=1e-12)


def test_rows_are_explained_by_several_tasks(spark, trained, monkeypatch):
    monkeypatch.setattr(attribution, "TASK_ROWS", 40)
    rows = trained.holdout.coalesce(1)
    explained = attribution.attributions(trained.model, rows)
    assert explained.count() == rows.count() and explained.rdd.getNumPartitions() == -(-rows.count() // 40)
