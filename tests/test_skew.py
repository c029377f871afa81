"""One key, source or bucket holding a large share of the rows gives the same results."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import evaluation, history, splits, statistics, upsert
from cohortlens.streaming import monitor

N = 30_000


def share(hot, cold):
    """Every second row belongs to the hot value."""
    return F.when(F.col("id") % 2 == 0, F.lit(hot)).otherwise(cold)


def test_last_copy_of_a_hot_key(spark):
    rows = spark.range(N).select(
        share("hot", F.col("id").cast("string")).alias("k"), F.col("id").alias("n"),
        F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"),
    )
    got = upsert.latest_per_key(rows, ["k"], ["n"])
    assert got.count() == N // 2 + 1
    assert got.filter("k = 'hot'").first()["v"] == f"v{N - 2}"


def test_hot_group_statistics(spark):
    rows = spark.range(N).select(
        share("PHASE1", F.lit("PHASE2")).alias("phase"), (F.col("id") % 3 == 0).alias("outcome_success"),
        (F.col("id") % 100).cast("int").alias("enrollment"), F.lit(10).alias("duration_days"),
        F.lit("Oncology").alias("therapeutic_area"), F.lit("NIH").alias("sponsor_class"),
    )
    got = {r["name"]: r for r in statistics.compare_groups(rows, "phase", "PHASE1", "PHASE2").collect()}
    even = [i % 100 for i in range(0, N, 2)]
    assert got["PHASE1"]["total"] == N // 2
    assert got["PHASE1"]["median_enrollment"] == pytest.approx(sorted(even)[N // 4] - 1)
    assert got["PHASE1"]["successes"] == sum(i % 3 == 0 for i in range(0, N, 2))


def test_hot_conversation(spark):
    rows = spark.range(N).select(
        share(0, F.col("id")).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"),
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"),
    )
    top = history.conversation_summaries(rows).filter("conv_id = 0").first()
    assert (top["title"], top["message_count"]) == ("t0", N // 2)
    kept = history.replace_conversations(rows, rows.filter("turn = 0"))
    assert kept.count() == N // 2 + 1


def test_hot_class_split(spark):
    rows = spark.range(N).select(
        F.col("id").cast("string").alias("nct_id"), (F.col("id") % 50 == 0).cast("int").alias("label")
    )
    got = {(r["label"], r["is_test"]): r["count"] for r in splits.stratified_split(rows).groupBy("label", "is_test").count().collect()}
    assert got == {(1, True): 120, (1, False): 480, (0, True): 5880, (0, False): 23520}


def test_hot_score(spark):
    rows = spark.range(N).select(
        share(0.5, F.col("id") / N).alias("predicted_proba"), (F.col("id") % 3 == 0).alias("actual_label")
    )
    pairs = [(0.5 if i % 2 == 0 else i / N, i % 3 == 0) for i in range(N)]
    below, wins = 0, 0.0
    by_score = sorted(Counter(p for p, _ in pairs))
    pos, neg = Counter(p for p, a in pairs if a), Counter(p for p, a in pairs if not a)
    for s in by_score:
        wins += pos[s] * (below + neg[s] / 2)
        below += neg[s]
    expected = wins / (sum(pos.values()) * sum(neg.values()))
    assert evaluation.auc_roc(rows).first()["auc_roc"] == pytest.approx(expected, abs=1e-12)


def test_hot_client(spark):
    rows = spark.range(N).select(
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 60).alias("ts"),
        share(7, F.col("id") + 1000).alias("user_id"),
    )
    got = monitor.over_limit(rows).collect()
    assert [(r["user_id"], r["requests"]) for r in got] == [(7, N // 2)]


def test_tiny_scores_lie_in_cells_of_their_own(spark):
    rows = spark.range(1, 1001).select((F.col("id") * 1e-15).alias("p"))
    cells = rows.unionAll(spark.sql("SELECT 0.0D UNION ALL SELECT 1.0D UNION ALL SELECT 5e-324D")).select("p", evaluation._score_cell(F.col("p")).alias("cell"))
    found = [r["cell"] for r in cells.orderBy("p").collect()]
    assert len(set(found)) >= 1002 and found == sorted(found)


def test_median_of_a_group_with_as_many_values_as_rows(spark):
    rows = spark.range(1_000_000).select(
        F.when(F.col("id") % 20 == 0, "B").otherwise("A").alias("phase"), F.lit("x").alias("therapeutic_area"),
        F.when(F.col("id") % 11 != 0, F.hash("id")).alias("enrollment"), (F.col("id") % 3 == 0).alias("outcome_success"),
        F.when(F.col("id") % 5 != 0, (F.col("id") % 900).cast("int")).alias("duration_days"),
    )
    want = {
        r["phase"]: tuple(r)[1:]
        for r in rows.groupBy("phase").agg(
            F.count("*"), F.count_if("outcome_success"), F.round(F.avg("enrollment"), 0), F.round(F.avg("duration_days"), 0), F.percentile("enrollment", 0.5)
        ).collect()
    }
    got = statistics.compare_groups(rows, "phase", "A", "B").collect()
    columns = ("total", "successes", "avg_enrollment", "avg_duration_days", "median_enrollment")
    assert {r["name"]: tuple(r[c] for c in columns) for r in got} == want


def test_median_of_ties_pairs_and_nothing(spark):
    rows = [("A", n) for n in (5, 5, 5, 70_000, None)] + [("B", n) for n in (1, 200_000)] + [("C", None)]
    frame = spark.createDataFrame(rows, "phase string, enrollment int").selectExpr(
        "*", "'x' AS therapeutic_area", "true AS outcome_success", "CAST(NULL AS INT) AS duration_days"
    )
    found = {r["name"]: (r["total"], r["median_enrollment"], r["avg_enrollment"]) for r in statistics.compare_groups(frame, "phase", "A", "B").collect()}
    assert found == {"A": (5, 5.0, 17504.0), "B": (2, 100_000.5, 100_001.0)}
    found = {r["name"]: (r["total"], r["median_enrollment"], r["avg_duration_days"]) for r in statistics.compare_groups(frame, "phase", "C", "D").collect()}
    assert found == {"C": (1, None, None), "D": (0, None, None)}
