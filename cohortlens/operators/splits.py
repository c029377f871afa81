"""Training rows, exact stratified splits and folds, class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.functions.features import feature_expressions
from cohortlens.operators.predicates import confident, labelled

TRAINING_INPUTS = (
    "nct_id", "phase", "sponsor_class", "intervention_types", "therapeutic_area",
    "enrollment", "duration_days", "number_of_arms", "locations_count", "countries",
    "eligibility_min_age", "eligibility_max_age", "outcome_success", "outcome_confidence",
)


def engineer_features(trials: DataFrame, keep: tuple[str, ...] = ("nct_id",)) -> DataFrame:
    """The 17 model inputs per trial, after the columns named in ``keep``."""
    columns = [e.alias(name) for name, e in feature_expressions().items()]
    return trials.select(*keep, *columns)


def training_set(trials: DataFrame) -> DataFrame:
    """Features and 0/1 ``label`` of the trials whose outcome is known well enough."""
    rows = trials.filter(labelled() & confident())
    rows = rows.withColumn("label", F.col("outcome_success").cast("int"))
    return engineer_features(rows, keep=("nct_id", "label"))


def require_rows(rows: DataFrame, least: int = C.MIN_TRAINING_ROWS) -> None:
    """Raise unless there are ``least`` rows; reads only as many partitions as that takes."""
    found = len(rows.select("label").take(least))
    if found < least:
        raise ValueError(f"not enough training rows: {found}, need {least}")


def class_balance(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def shuffled_rank(
    rows: DataFrame, stratum: str = "label", key: str = "nct_id", seed: int = 42
) -> DataFrame:
    """Adds each row's exact position in a seeded shuffle of its stratum.

    ``stratum_rank`` equals the row number by hash over the whole stratum, and
    ``stratum_size`` its row count, without sorting a stratum in one task: rows
    are cut into 65,536 cells by the first four hash digits, the cells are
    counted and summed up, and only the rows inside a cell are numbered. Hash
    digits spread keys evenly whatever the strata look like.
    """
    hashed = rows.withColumn("_hash", F.md5(F.concat(key, F.lit(f"|{seed}"))))
    hashed = hashed.withColumn("_cell", F.substring("_hash", 1, 4))
    whole = Window.partitionBy(stratum)
    earlier = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        hashed.groupBy(stratum, "_cell")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            stratum,
            "_cell",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_n").over(whole).alias("stratum_size"),
        )
    )
    inside = F.row_number().over(Window.partitionBy(stratum, "_cell").orderBy("_hash", key))
    return (
        hashed.join(cells, [stratum, "_cell"])
        .withColumn("stratum_rank", F.col("_before") + inside)
        .drop("_hash", "_cell", "_before")
    )


def stratified_split(
    rows: DataFrame, test_percent: int = 20, seed: int = 42, stratum: str = "label"
) -> DataFrame:
    """Adds ``is_test``: the same share of every class, to within one row."""
    test_rows = F.call_function("div", F.col("stratum_size") * test_percent + 99, F.lit(100))
    return (
        shuffled_rank(rows, stratum, seed=seed)
        .withColumn("is_test", F.col("stratum_rank") <= test_rows)
        .drop("stratum_rank", "stratum_size")
    )


def stratified_folds(
    rows: DataFrame, folds: int = 5, seed: int = 42, stratum: str = "label"
) -> DataFrame:
    """Adds ``fold`` from 0 to ``folds - 1``, dealt out class by class."""
    return (
        shuffled_rank(rows, stratum, seed=seed)
        .withColumn("fold", ((F.col("stratum_rank") - 1) % folds).cast("int"))
        .drop("stratum_rank", "stratum_size")
    )


def class_weight(train: DataFrame) -> DataFrame:
    """One row: class counts and the weight that balances the positive class."""
    return train.agg(
        F.count_if(F.col("label") == 0).alias("n_negative"),
        F.count_if(F.col("label") == 1).alias("n_positive"),
    ).withColumn(
        "positive_weight",
        F.col("n_negative").cast("double") / F.greatest("n_positive", F.lit(1)).cast("double"),
    )
