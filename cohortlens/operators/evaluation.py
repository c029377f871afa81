"""Quality of stored predictions, as distributed aggregates.

A scored frame has ``predicted_proba`` (0 to 1), ``predicted_label`` and
``actual_label``; stored predictions add ``nct_id``, ``model_version`` and
``correct``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.functions.arithmetic import percent, rounded_ratio, safe_ratio
from cohortlens.operators.predicates import trial_filter
from cohortlens.operators.upsert import latest_per_key


def score_columns(probability: Column, actual: Column) -> dict[str, Column]:
    """Label at the even-chance threshold and whether it was right."""
    predicted = probability >= 0.5
    return {"predicted_label": predicted, "correct": predicted == actual}


#: Rows that a line of a score histogram stands for.
WEIGHT = "n_rows"


def score_histogram(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows counted by ``by``, score and both labels.

    All measures below take it in the place of the rows, and give the same.
    Histograms of parts of the rows are merged by :func:`merged_histograms`.
    """
    keys = [*by, "predicted_proba", "predicted_label", "actual_label"]
    return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias(WEIGHT))


def merged_histograms(*parts: DataFrame) -> DataFrame:
    """The histogram of all rows of several histograms with the same columns."""
    keys = [c for c in parts[0].columns if c != WEIGHT]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum(WEIGHT).alias(WEIGHT))


def _counted(scored: DataFrame, condition: Column) -> Column:
    """How many rows meet a condition, whether they are rows or lines of a histogram."""
    if WEIGHT in scored.columns:
        return F.coalesce(F.sum(F.when(condition, F.col(WEIGHT))), F.lit(0).cast("long"))
    return F.count_if(condition)


def confusion(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of the four outcomes, per value of ``by``."""
    said, was = F.col("predicted_label"), F.col("actual_label")
    return scored.groupBy(*by).agg(
        _counted(scored, said & was).alias("tp"),
        _counted(scored, ~said & ~was).alias("tn"),
        _counted(scored, said & ~was).alias("fp"),
        _counted(scored, ~said & was).alias("fn"),
    )


def confusion_shares(scored: DataFrame) -> DataFrame:
    """The confusion counts as rows, with their share of all samples in percent."""
    total = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    return confusion(scored).select(
        F.stack(
            F.lit(4),
            F.lit("True Positive"), F.col("tp"), percent(F.col("tp"), total),
            F.lit("False Positive"), F.col("fp"), percent(F.col("fp"), total),
            F.lit("False Negative"), F.col("fn"), percent(F.col("fn"), total),
            F.lit("True Negative"), F.col("tn"), percent(F.col("tn"), total),
        ).alias("cell", "n", "share_pct")
    )


def _f1(precision: Column, recall: Column) -> Column:
    both = precision + recall
    return F.when(both > 0, 2 * precision * recall / both).otherwise(F.lit(0.0))


def overall_metrics(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return (
        confusion(scored, by)
        .withColumns(
            {
                "n_samples": tp + tn + fp + fn,
                "accuracy": safe_ratio(tp + tn, tp + tn + fp + fn),
                "precision_score": safe_ratio(tp, tp + fp),
                "recall_score": safe_ratio(tp, tp + fn),
            }
        )
        .withColumn("f1_score", _f1(F.col("precision_score"), F.col("recall_score")))
    )


def class_report(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted means."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))

    def quality(hit: Column, missed: Column, wrong: Column) -> Column:
        precision, recall = safe_ratio(hit, hit + wrong), safe_ratio(hit, hit + missed)
        return F.struct(
            precision.alias("precision"),
            recall.alias("recall"),
            _f1(precision, recall).alias("f1"),
            (hit + missed).alias("support"),
        )

    classes = confusion(scored).select(
        quality(tn, fp, fn).alias("failure"), quality(tp, fn, fp).alias("success")
    )
    a, b = F.col("failure"), F.col("success")
    support = a["support"] + b["support"]

    def mean(weight_a: Column, weight_b: Column) -> Column:
        total = weight_a + weight_b
        return F.struct(
            *[
                F.when(total > 0, (a[m] * weight_a + b[m] * weight_b) / total)
                .otherwise(F.lit(0.0))
                .alias(m)
                for m in ("precision", "recall", "f1")
            ],
            support.alias("support"),
        )

    one = F.lit(1.0)
    rows = F.stack(
        F.lit(4),
        F.lit("failure"), a,
        F.lit("success"), b,
        F.lit("macro avg"), mean(one, one),
        F.lit("weighted avg"), mean(a["support"].cast("double"), b["support"].cast("double")),
    )
    return classes.select(rows.alias("class_name", "_m")).select("class_name", "_m.*")


_LEVELS, _BITS = 4, 12
#: A cell is a power of two, down to this one, and so many bits below it.
_LEAST_POWER, _FINE_BITS = -1000, 37


def _score_cell(score: Column) -> Column:
    """A whole number that grows with a score of 0 to 1, with equal precision for large and tiny ones."""
    power = F.greatest(F.floor(F.log2(score)), F.lit(_LEAST_POWER).cast("long"))  # of 0 the logarithm is null
    above = F.floor((score * F.pow(F.lit(2.0), -power) - 1) * float(1 << _FINE_BITS))
    return (power + (1 - _LEAST_POWER)) * (1 << _FINE_BITS) + above


def auc_roc(scored: DataFrame, by: tuple[str, ...] = (), score: str = "predicted_proba") -> DataFrame:
    """Exact area under the ROC curve, ties counted half.

    The area is the share of (positive, negative) pairs in the right order.
    Counts are first reduced to one row per distinct score. The scores, all in
    0 to 1, form a tree of cells with 4,096 children each, and every ordered
    pair of different scores is counted once, at the node where their paths
    part. So each window runs over the children of one node, and no task ever
    orders all scores. Cells follow the powers of two, so scores crowded at 0
    part as well as others do.
    """
    by = list(by)
    is_positive = F.col("actual_label")
    scores = scored.groupBy(*by, F.col(score).alias("_score")).agg(
        _counted(scored, is_positive).alias("_pos"), _counted(scored, ~is_positive).alias("_neg")
    )
    scores = scores.withColumn("_cell", _score_cell(F.col("_score")))

    def big(c: str) -> Column:
        return F.col(c).cast("decimal(18,0)")

    def pairs(nodes: DataFrame, parent: Column, order: str, ties=False, root=False) -> DataFrame:
        earlier = (
            Window.partitionBy(*by, parent)
            .orderBy(order)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        below = nodes.withColumn("_below", F.coalesce(F.sum("_neg").over(earlier), F.lit(0)))
        twice = big("_pos") * big("_below") * 2
        if ties:
            twice = twice + big("_pos") * big("_neg")
        # each row is counted in the class totals once, at the root
        count = (lambda c: F.col(c)) if root else (lambda c: F.lit(0).cast("long"))
        return below.select(
            *by,
            twice.cast("decimal(38,0)").alias("_twice"),
            count("_pos").alias("_p"),
            count("_neg").alias("_n"),
        )

    parts = [pairs(scores, F.col("_cell"), "_score", ties=True)]
    nodes = scores
    for level in range(_LEVELS, 0, -1):
        nodes = nodes.groupBy(*by, "_cell").agg(
            F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg")
        )
        root = level == 1
        parent = F.lit(0) if root else F.shiftright("_cell", _BITS)
        parts.append(pairs(nodes, parent, "_cell", root=root))
        nodes = nodes.withColumn("_cell", parent)
    total = reduce(DataFrame.unionByName, parts).groupBy(*by).agg(
        F.sum("_twice").alias("_twice"),
        F.sum("_p").alias("n_positive"),
        F.sum("_n").alias("n_negative"),
    )
    possible = F.col("n_positive").cast("double") * F.col("n_negative").cast("double")
    return total.select(
        *by,
        "n_positive",
        "n_negative",
        F.when(possible > 0, F.col("_twice").cast("double") / (2 * possible)).alias("auc_roc"),
    )


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Actual success rate per equal-width probability bin; empty bins are absent.

    Bins are closed on the right. The lowest edge is lowered by a thousandth of
    the range so that it takes in the minimum; when all scores are equal the
    range is widened around them instead. The range is a scalar subquery, so
    the scores themselves are not shuffled for it.
    """
    p = F.col("predicted_proba")
    bounds = scored.agg(F.struct(F.min(p).alias("lo"), F.max(p).alias("hi"))).scalar()
    flat = F.col("_r.lo") == F.col("_r.hi")

    def pad(edge: Column) -> Column:
        return F.when(edge == 0, 0.001).otherwise(F.abs(edge) * 0.001)

    weight = [WEIGHT] if WEIGHT in scored.columns else []
    ranged = scored.select("predicted_proba", "actual_label", *weight, bounds.alias("_r")).select(
        "predicted_proba",
        "actual_label",
        *weight,
        F.when(flat, F.col("_r.lo") - pad(F.col("_r.lo"))).otherwise(F.col("_r.lo")).alias("_lo"),
        F.when(flat, F.col("_r.hi") + pad(F.col("_r.hi"))).otherwise(F.col("_r.hi")).alias("_hi"),
        flat.alias("_flat"),
    )
    lo, hi = F.col("_lo"), F.col("_hi")

    def edge(i) -> Column:
        return lo + i * ((hi - lo) / bins)

    number = reduce(
        lambda n, i: n + F.when(p > edge(F.lit(i)), 1).otherwise(0), range(1, bins), F.lit(1)
    )
    bin_ = F.col("bin")
    low = F.when((bin_ == 1) & ~F.col("_flat"), lo - (hi - lo) * 0.001).otherwise(edge(bin_ - 1))
    return (
        ranged.withColumn("bin", number)
        .groupBy("bin", "_lo", "_hi", "_flat")
        .agg(
            _counted(scored, F.col("actual_label")).alias("_hits"),
            _counted(scored, F.lit(True)).alias("n"),
        )
        .select(
            "bin",
            low.alias("bin_lo"),
            F.when(bin_ == bins, hi).otherwise(edge(bin_)).alias("bin_hi"),
            (F.col("_hits").cast("double") / F.col("n")).alias("actual_rate"),
            "n",
        )
        .orderBy("bin")
    )


def benchmark_rows(
    predictions: DataFrame,
    version: str,
    limit: int | None = None,
    trials: DataFrame | None = None,
    therapeutic_area: str | None = None,
    phase: str | None = None,
) -> DataFrame:
    """Stored predictions of one version, narrowed by area and phase of the trial.

    With a limit, the first rows in key order are taken (5,000 at most).
    """
    rows = predictions.filter(F.col("model_version") == version)
    if therapeutic_area or phase:
        wanted = trials.filter(trial_filter(therapeutic_area=therapeutic_area, phase=phase))
        rows = rows.join(wanted.select("nct_id"), "nct_id", "left_semi")
    if limit is not None:
        rows = rows.orderBy("nct_id").limit(min(limit, C.BENCHMARK_LIMIT))
    return rows


def benchmark_summary(rows: DataFrame) -> DataFrame:
    """Per version: sample count, confusion counts, metrics and four-digit accuracy."""
    return overall_metrics(rows, by=("model_version",)).withColumn(
        "accuracy", rounded_ratio(F.col("tp") + F.col("tn"), F.col("n_samples"), 4)
    )


def accuracy_by(
    predictions: DataFrame, trials: DataFrame, version: str, dimension: str
) -> DataFrame:
    """Share of right predictions per phase or area, as fraction and percent."""
    right, n = F.count_if("correct"), F.count(F.lit(1))
    return (
        predictions.filter(F.col("model_version") == version)
        .select("nct_id", "correct")
        .join(trials.select("nct_id", dimension).filter(F.col(dimension).isNotNull()), "nct_id")
        .groupBy(dimension)
        .agg(
            (right.cast("double") / n).alias("accuracy"),
            percent(right, n).alias("accuracy_pct"),
            n.alias("n"),
        )
        .orderBy(dimension)
    )


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """The newest training run of every model version."""
    return latest_per_key(metrics, ["model_version"], ["trained_at"])


def relative_importance(importance: DataFrame, top: int = 8) -> DataFrame:
    """The strongest features with their weight relative to the strongest, in percent."""
    # one row per model input, so the unpartitioned window is tiny by construction
    strongest = F.max("importance").over(Window.partitionBy())
    return (
        importance.withColumn("relative_pct", F.col("importance") / strongest * 100)
        .orderBy(F.desc("importance"), "feature")
        .limit(top)
    )
