import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortlens.constants import FEATURE_COLUMNS
from cohortlens.operators import boosting, model


def vectors(spark, rows, partitions, seed=7):
    """Rows with a noisy label, in a fixed order: features of many and of few values, one of them constant."""
    draw = np.random.default_rng(seed)
    x = np.column_stack([draw.normal(size=rows), draw.integers(0, 6, rows), draw.integers(0, 2, rows), np.ones(rows), draw.exponential(size=rows) * draw.integers(0, 2, rows)])
    label = (x[:, 0] + x[:, 1] * x[:, 2] / 3 + draw.normal(size=rows) > 0.8).astype(float)
    weight = np.where(label == 1, 1.7, 1.0)
    lines = [(int(k), [float(v) for v in a], float(b), float(c)) for k, (a, b, c) in enumerate(zip(x, label, weight))]
    frame = spark.createDataFrame(lines, "k long, x array<double>, label double, weight double")
    frame = frame.repartitionById(partitions, F.floor(F.col("k") * partitions / rows).cast("int")).sortWithinPartitions("k")
    return frame.select(array_to_vector("x").alias("features"), "label", "weight").persist()


def learner(trees, **more):
    settings = {"maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": 42, **more}
    return GBTClassifier(weightCol="weight", maxIter=trees, **settings)


def shape(fitted):
    """The trees as nested text with their numbers rounded."""
    def told(node):
        if node.subtreeDepth() == 0:
            return f"{node.prediction():.9f}"
        split = node.split()
        return f"({split.featureIndex()} {split.threshold():.9f} {told(node.leftChild())} {told(node.rightChild())})"

    return [told(t._call_java("rootNode")) for t in fitted.trees]


@pytest.mark.parametrize("rows", [300, 12_000])
def test_one_block_grows_the_trees_of_sparks_learner(spark, rows):
    # 12,000 rows are more than the learner takes its split candidates from
    frame = vectors(spark, rows, 1)
    mine, theirs = boosting.fit_booster(frame, learner(4), 5), learner(4).fit(frame)
    assert shape(mine) == shape(theirs)
    assert mine.treeWeights == theirs.treeWeights and mine.numFeatures == 5
    assert np.allclose(mine.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=1e-9)
    set_in = [{p.name: v for p, v in m._paramMap.items()} for m in (mine, theirs)]
    assert set_in[0] == set_in[1]
    assert mine.getMaxIter() == 4 and mine.getStepSize() == 0.1


def test_all_rows_and_columns_grow_the_trees_of_sparks_learner(spark):
    frame = vectors(spark, 400, 1, seed=3)
    whole = {"subsamplingRate": 1.0, "featureSubsetStrategy": "1.0", "maxDepth": 3}
    assert shape(boosting.fit_booster(frame, learner(3, **whole), 5)) == shape(learner(3, **whole).fit(frame))


def test_trees_do_not_depend_on_how_many_tasks_share_the_blocks(spark, monkeypatch):
    frame, found = vectors(spark, 1_200, 5), []
    for slots in (1, 2, 3, 8):
        monkeypatch.setattr(boosting, "free_slots", lambda _, n=slots: n)
        found.append(boosting.fit_booster(frame, learner(3), 5).toDebugString.split("\n")[1:])
    assert all(f == found[0] for f in found)
    scored = boosting.fit_booster(frame, learner(20), 5).transform(frame)
    assert scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0] > 0.7


def test_exchanged_sums_are_deleted(spark, monkeypatch, tmp_path):
    places = []

    def folder(_, purpose):
        places.append(tmp_path / f"{purpose}-{len(places)}")
        return str(places[-1])

    monkeypatch.setattr(boosting, "shared_folder", folder)
    boosting.fit_booster(vectors(spark, 600, 3), learner(2), 5)
    assert places and not any(p.exists() for p in places)


def test_more_trees_take_no_more_jobs(spark):
    rows = spark.range(600).select(
        F.col("id").cast("string").alias("nct_id"),
        *[((F.hash("id", F.lit(n)) % 100).cast("double")).alias(n) for n in FEATURE_COLUMNS],
    ).withColumn("label", (F.col("enrollment_log") > 0).cast("int"))

    def jobs(trees):
        spark.sparkContext.setJobGroup(f"fit-{trees}", "jobs of a training")
        try:
            model.fit(rows, model.Boosting(trees=trees, depth=3))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit-{trees}"))

    assert 0 < jobs(12) <= jobs(2)


def test_labels_and_rows_are_required(spark):
    frame = vectors(spark, 40, 1)
    with pytest.raises(ValueError):
        boosting.fit_booster(frame.withColumn("label", F.lit(2.0)), learner(1), 5)
    with pytest.raises(ValueError):
        boosting.fit_booster(frame.filter("weight < 0"), learner(1), 5)
    one_class = boosting.fit_booster(frame.withColumn("label", F.lit(0.0)), learner(2), 5)
    assert one_class.trees[0].numNodes == 1
