"""Boosted-tree success model: training, scoring, cross-validation."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.constants import FEATURE_COLUMNS
from cohortlens.functions.labels import confidence_band, traffic_light, whole_percent
from cohortlens.operators import evaluation, splits
from cohortlens.operators.boosting import fit_booster
from cohortlens.operators.predicates import by_key
from cohortlens.session import shared_folder, staged


@dataclass(frozen=True)
class Boosting:
    """The published training settings."""

    trees: int = 300
    depth: int = 6
    step: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.8
    seed: int = 42


@dataclass(frozen=True)
class Training:
    """A fitted model with the scored hold-out rows and the run's metrics."""

    model: PipelineModel
    holdout: DataFrame
    metrics: DataFrame


#: The errors that trees are fitted to are written down after so many trees, by Spark's own learner.
CHECKPOINT_TREES = 20


def _lineage_folder(spark: SparkSession) -> None:
    """Boosting cuts its lineage in the folder that ``spark.checkpoint.dir`` names, or one of our own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark, "lineage"))


def fit(train: DataFrame, settings: Boosting = Boosting(), at_once: int = 1) -> PipelineModel:
    """Boosted trees on the feature columns of ``train``, ``at_once`` such fits running at the same time.

    Positive rows carry the weight that balances the classes. The weight is a
    scalar subquery over the same rows. Trees on several blocks of rows grow in
    one stage; one block is left to Spark's learner, whose trees are fixed there
    to the last bit, also where splits tie.
    """
    balance = splits.class_weight(train).select("positive_weight").scalar()
    weighted = train.withColumn("_positive_weight", balance).select(
        *FEATURE_COLUMNS,
        F.col("label").cast("double").alias("label"),
        F.when(F.col("label") == 1, F.col("_positive_weight")).otherwise(1.0).alias("weight"),
    )
    assembler = VectorAssembler(inputCols=list(FEATURE_COLUMNS), outputCol="features")
    booster = GBTClassifier(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        maxIter=settings.trees,
        maxDepth=settings.depth,
        stepSize=settings.step,
        subsamplingRate=settings.row_share,
        featureSubsetStrategy=str(settings.column_share),
        seed=settings.seed,
        checkpointInterval=CHECKPOINT_TREES,
    )
    rows = assembler.transform(weighted).select("features", "label", "weight")
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if rows.rdd.getNumPartitions() == 1:
            _lineage_folder(train.sparkSession)
            return PipelineModel([assembler, booster.fit(rows)])
        return PipelineModel([assembler, fit_booster(rows, booster, len(FEATURE_COLUMNS), at_once)])
    finally:
        rows.unpersist()


#: Rows that are drawn together while trees grow, and the most such blocks.
FIT_ROWS, MOST_FIT_TASKS = 25_000, 10_000


def _spread(rows: DataFrame) -> DataFrame:
    """Rows dealt by their key, ``FIT_ROWS`` to a partition.

    The learner draws rows by partition, so the trees must not depend on the
    number of cores or files.
    """
    tasks = min(MOST_FIT_TASKS, -(-rows.count() // FIT_ROWS))
    return rows.repartition(max(1, tasks), "nct_id")


def probability(model: PipelineModel, features: DataFrame) -> DataFrame:
    """``features`` with the unrounded chance of success as ``predicted_proba``."""
    scored = model.transform(features)
    chance = vector_to_array("probability")[1].alias("predicted_proba")
    return scored.select(*features.columns, chance)


def score_holdout(model: PipelineModel, test: DataFrame) -> DataFrame:
    """Labelled feature rows scored: key, probability, both labels, correctness."""
    actual = F.col("label") == 1
    return (
        probability(model, test)
        .withColumn("actual_label", actual)
        .withColumns(evaluation.score_columns(F.col("predicted_proba"), F.col("actual_label")))
    )


def train_model(trials: DataFrame, settings: Boosting = Boosting(), version: str = "v1") -> Training:
    """Select, split, fit and evaluate; the hold-out rows come back scored."""
    rows = staged(splits.training_set(trials), "training-set")  # read twice by the split
    rows = staged(splits.stratified_split(rows, seed=settings.seed), "training-rows")
    splits.require_rows(rows)
    train, test = rows.filter(~F.col("is_test")), rows.filter("is_test")
    model = fit(_spread(train), settings)
    holdout = score_holdout(model, test).withColumn("model_version", F.lit(version))
    sizes = rows.agg(
        F.count_if(~F.col("is_test")).alias("n_train"), F.count_if("is_test").alias("n_test")
    ).withColumn("model_version", F.lit(version))
    by = ("model_version",)
    metrics = (
        evaluation.overall_metrics(holdout, by)
        .join(evaluation.auc_roc(holdout, by).select("model_version", "auc_roc"), "model_version")
        .join(sizes, "model_version")
        .select(
            "model_version", "accuracy", "precision_score", "recall_score", "f1_score",
            "auc_roc", "n_train", "n_test",
        )
    )
    return Training(model, holdout, metrics)


def side_by_side(spark: SparkSession, work: list[Callable[[], Any]], name: str) -> list:
    """Results of jobs that run at the same time, each in a scheduler pool of its own.

    Threads inherit the caller's job group and tags. A job that fails ends the
    call once the others are done. With ``spark.scheduler.mode=FAIR`` the pools
    share the executors evenly.
    """

    def started(number: int) -> Callable[[], Any]:
        @inheritable_thread_target(spark)
        def run():
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{name}-{number}")
            return work[number]()

        return run

    with ThreadPoolExecutor(max_workers=max(1, len(work))) as pool:
        return [f.result() for f in [pool.submit(started(k)) for k in range(len(work))]]


def cross_validate(
    trials: DataFrame, settings: Boosting = Boosting(), folds: int = 5
) -> tuple[DataFrame, DataFrame]:
    """(area per fold, its mean and population deviation), one fit per fold.

    Rows are dealt once and staged; the folds are fitted side by side.
    """
    rows = staged(splits.training_set(trials), "training-set")  # read twice by the deal
    dealt = staged(splits.stratified_folds(rows, folds, settings.seed), "fold-rows")

    def scored(k: int) -> Callable[[], DataFrame]:
        def run() -> DataFrame:
            model = fit(_spread(dealt.filter(F.col("fold") != k)), settings, folds)
            return score_holdout(model, dealt.filter(F.col("fold") == k))

        return run

    parts = side_by_side(trials.sparkSession, [scored(k) for k in range(folds)], "fold")
    per_fold = evaluation.auc_roc(reduce(DataFrame.unionByName, parts), by=("fold",))
    summary = per_fold.agg(
        F.avg("auc_roc").alias("cv_auc_mean"), F.stddev_pop("auc_roc").alias("cv_auc_std")
    )
    return per_fold, summary


def importance(model: PipelineModel, spark: SparkSession, top: int | None = 5) -> DataFrame:
    """Built-in feature importance, strongest first, four digits."""
    values = model.stages[-1].featureImportances.toArray()
    pairs = [
        F.struct(F.lit(name).alias("feature"), F.lit(round(float(v), 4)).alias("importance"))
        for name, v in zip(FEATURE_COLUMNS, values)
    ]
    rows = (
        spark.range(1)
        .select(F.explode(F.array(*pairs)).alias("_r"))
        .select("_r.*")
        .orderBy(F.desc("importance"), "feature")
    )
    return rows if top is None else rows.limit(top)


def present(scored: DataFrame, keep: tuple[str, ...], version: str = "v1") -> DataFrame:
    """Scores as shown to a reader: rounded chances, label, band and colour."""
    p = F.col("predicted_proba")
    return scored.select(
        *keep,
        (p >= 0.5).alias("predicted_success"),
        F.round(p, 4).alias("success_probability"),
        F.round(1 - p, 4).alias("failure_probability"),
        confidence_band(p).alias("confidence"),
        whole_percent(F.round(p, 4)).alias("success_pct"),
        traffic_light(F.round(p, 4)).alias("light"),
        F.lit(version).alias("model_version"),
    )


def score_trials(
    model: PipelineModel, trials: DataFrame, key: str = "nct_id", version: str = "v1"
) -> DataFrame:
    features = splits.engineer_features(trials, keep=(key,))
    return present(probability(model, features), (key,), version)


def score_trial(model: PipelineModel, trials: DataFrame, nct_id: str) -> DataFrame:
    """Score of one stored trial; no row when the id is unknown."""
    return score_trials(model, by_key(trials, nct_id))


def _design_defaults() -> dict[str, tuple[str, Column]]:
    """Type and default of each field of a hypothetical design."""
    empty = F.array().cast("array<string>")
    return {
        "phase": ("string", F.lit(None)),
        "sponsor_class": ("string", F.lit("")),
        "intervention_types": ("array<string>", empty),
        "therapeutic_area": ("string", F.lit("Other")),
        "enrollment": ("int", F.lit(None)),
        "duration_days": ("int", F.lit(None)),
        "number_of_arms": ("int", F.lit(2)),
        "locations_count": ("int", F.lit(10)),
        "countries": ("array<string>", empty),
        "eligibility_min_age": ("int", F.lit(18)),
        "eligibility_max_age": ("int", F.lit(65)),
    }


def complete_designs(designs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Designs with every model field present; missing columns and cells take defaults."""
    filled = []
    for name, (kind, default) in _design_defaults().items():
        value = default.cast(kind)
        if name in designs.columns:
            value = F.coalesce(F.col(name).cast(kind), value)
        filled.append(value.alias(name))
    return designs.select(*keep, *filled)


def score_designs(
    model: PipelineModel, designs: DataFrame, key: str, version: str = "v1"
) -> DataFrame:
    """Hypothetical designs scored in bulk."""
    return score_trials(model, complete_designs(designs, (key,)), key, version)
