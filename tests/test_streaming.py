import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from cohortlens.sources import tables
from cohortlens.streaming import ingest, monitor

LOG = "ts timestamp, service string, user_id long, value double"
START = dt.datetime(2024, 1, 1)


def log(spark, counts, service="api"):
    """``counts[i]`` events in minute ``i``."""
    rows = [
        (START + dt.timedelta(minutes=m, seconds=s), service, s % 3, 1.0)
        for m, n in enumerate(counts)
        for s in range(n)
    ]
    return spark.createDataFrame(rows, LOG)


@pytest.mark.parametrize(
    "counts, periods, alarms",
    [
        ([11, 11, 0, 11, 12, 13, 10, 11], 2, [1, 4, 5]),
        ([11, 11, 0, 11, 12, 13, 10, 11], 3, [5]),
        ([10, 10, 10], 2, []),
        ([11], 1, [0]),
    ],
)
def test_alarm_rule(spark, counts, periods, alarms):
    got = monitor.error_alarms(log(spark, counts), 60, 10, periods).collect()
    minutes = sorted(int((r["period_start"] - START).total_seconds()) // 60 for r in got)
    assert minutes == alarms


def test_alarms_are_per_service(spark):
    both = log(spark, [11, 0], "a").unionByName(log(spark, [0, 11], "b"))
    assert monitor.error_alarms(both).isEmpty()


def test_over_limit(spark):
    got = monitor.over_limit(log(spark, [9, 60]), 60, most=19).collect()
    assert sorted((r["user_id"], r["requests"]) for r in got) == [(0, 20), (1, 20), (2, 20)]


@pytest.mark.parametrize("batches", [1, 3])
def test_stream_alarms_equal_batch_alarms(spark, tmp_path, batches):
    counts = [11, 12, 0, 15, 11, 11, 2] + [1] * 30
    whole = log(spark, counts)
    rows = whole.orderBy("ts").collect()
    size = -(-len(rows) // batches)
    for i in range(batches):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], LOG).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    alarms = monitor.error_alarms(monitor.with_lateness(stream, "2 minutes"))
    (
        alarms.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        .start().awaitTermination()
    )
    got = spark.read.schema(alarms.schema).parquet(str(tmp_path / "out"))
    expected = monitor.error_alarms(whole)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in expected.collect()}
    assert expected.count() == 3


def study(key, text):
    return {
        "protocolSection": {
            "identificationModule": {"nctId": key, "briefTitle": text},
            "statusModule": {"overallStatus": "COMPLETED"},
        }
    }


def test_ingest_stream_resumes_and_keeps_the_last_change(spark, tmp_path):
    pages, paths = tmp_path / "pages", [str(tmp_path / n) for n in ("changes", "cp")]
    pages.mkdir()

    def run():
        ingest.ingest_stream(spark, str(pages), *paths).awaitTermination()
        rows = ingest.current_trials(ingest.read_changes(spark, paths[0]))
        return {r["nct_id"]: r["title"] for r in rows.collect()}

    (pages / "a.json").write_text(json.dumps({"studies": [study("N1", "one"), study("N2", "two")]}))
    (pages / "b.json").write_text("not json")
    assert run() == {"N1": "one", "N2": "two"}
    later = [study("N2", "old"), study("N2", "new"), study("N3", "three")]
    (pages / "c.json").write_text(json.dumps({"studies": later}))
    assert run() == {"N1": "one", "N2": "new", "N3": "three"}
    assert run() == {"N1": "one", "N2": "new", "N3": "three"}
    bad = ingest.quarantine(ingest.read_changes(spark, paths[0])).collect()
    assert [r["raw_json"] for r in bad] == ["not json"]

    done = ingest.compact(spark, None, paths[0], 0, str(tmp_path / "s1"))
    assert (done.inserted, done.updated) == (2, 0)
    now = ingest.table_now(spark, done.snapshot, paths[0])
    assert {r["nct_id"]: r["title"] for r in now.collect()} == run()
    later = ingest.later_changes(spark, done.snapshot, paths[0])
    assert {r["batch_id"] for r in later.select("batch_id").distinct().collect()} == {1}
    assert "PartitionFilters: [" in (text := later._jdf.queryExecution().executedPlan().toString()) and "batch_id" in text.split("PartitionFilters: [")[1]
    done = ingest.compact(spark, done.snapshot, paths[0], 1, str(tmp_path / "s2"))
    assert (done.inserted, done.updated) == (1, 1)
    table = tables.read_trials(spark, done.snapshot)
    assert {r["nct_id"]: r["title"] for r in table.collect()} == run()


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    page = json.dumps({"studies": [study("N1", "one")]})
    rows = spark.createDataFrame([(page, "f")], "page string, page_file string")
    changes = str(tmp_path / "c")
    for _ in range(2):
        ingest._write_batch(rows, 5, changes)
    assert spark.read.parquet(changes).count() == 1


def test_a_new_run_adds_to_the_log_and_wins(spark, tmp_path):
    changes = str(tmp_path / "c")
    for run, title in ((0, "old"), (1, "new")):
        page = json.dumps({"studies": [study("N1", title)]})
        rows = spark.createDataFrame([(page, "f")], "page string, page_file string")
        ingest._write_batch(rows, 0, changes, run)
    log = ingest.read_changes(spark, changes)
    assert log.count() == 2
    assert [r["title"] for r in ingest.current_trials(log).collect()] == ["new"]


def test_copies_on_pages_of_one_file_have_one_winner(spark, tmp_path):
    pages = [(json.dumps({"studies": [study("N1", t)]}), "f") for t in ("one", "two", "three")]
    winners = set()
    for n, order in enumerate((pages, pages[::-1])):
        changes = str(tmp_path / f"c{n}")
        ingest._write_batch(spark.createDataFrame(order, "page string, page_file string"), 0, changes)
        winners |= {r["title"] for r in ingest.current_trials(ingest.read_changes(spark, changes)).collect()}
    assert len(winners) == 1


def titles(spark, changes):
    return sorted(r["title"] for r in ingest.read_changes(spark, changes).collect())


def test_a_fresh_checkpoint_on_an_old_log_loses_nothing(spark, tmp_path):
    changes = str(tmp_path / "changes")
    for n, title in enumerate(("one", "two")):
        pages = tmp_path / f"pages{n}"
        pages.mkdir()
        (pages / "a.json").write_text(json.dumps({"studies": [study("N1", title), study(f"M{n}", title)]}))
        ingest.ingest_stream(spark, str(pages), changes, str(tmp_path / f"cp{n}")).awaitTermination()
    assert titles(spark, changes) == ["one", "one", "two", "two"]
    now = {r["nct_id"]: r["title"] for r in ingest.current_trials(ingest.read_changes(spark, changes)).collect()}
    assert now == {"N1": "two", "M0": "one", "M1": "two"}
    listed = ingest.batch_log(spark, changes).collect()
    assert sorted((r["run"], r["batch_id"], r["read"], r["quarantined"]) for r in listed) == [(0, 0, 2, 0), (1, 0, 2, 0)]


def test_runs_belong_to_their_checkpoints(spark, tmp_path):
    changes, one, two = (str(tmp_path / n) for n in ("changes", "one", "two"))
    assert ingest.claim_run(spark, changes, one) == 0 and ingest.claim_run(spark, changes, two, 5) == 5
    assert ingest.claim_run(spark, changes, one) == 0 and ingest.claim_run(spark, changes, str(tmp_path / "three")) == 6
    for checkpoint, run in ((one, 1), (str(tmp_path / "four"), 5)):
        with pytest.raises(ValueError):
            ingest.claim_run(spark, changes, checkpoint, run)
    with pytest.raises(ValueError):
        ingest.claim_run(spark, str(tmp_path / "other"), one)


def test_a_log_without_a_list_keeps_its_runs(spark, tmp_path):
    changes = str(tmp_path / "c")
    page = json.dumps({"studies": [study("N1", "old")]})
    ingest._write_batch(spark.createDataFrame([(page, "f")], "page string, page_file string"), 0, changes, 3)
    assert ingest.claim_run(spark, changes, str(tmp_path / "cp")) == 4
