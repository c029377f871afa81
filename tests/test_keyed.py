"""The keyed table: what a batch touches, what a look-up reads, who wins."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cohortlens.sources import commits, keyed, tables

LAYOUT = "nct_id string, title string, n int, ingested_at string"


def rows(spark, low, high, title):
    return spark.range(low, high).select(
        F.format_string("NCT%08d", "id").alias("nct_id"), F.lit(title).alias("title"),
        F.col("id").cast("int").alias("n"), F.lit(title).alias("ingested_at"),
    )


def contents(path):
    return {str(p): p.read_bytes() for p in Path(path).rglob("*.parquet")}


@pytest.fixture
def table(spark, tmp_path):
    made = keyed.KeyedTable(spark, str(tmp_path / "t"), LAYOUT)
    made.create(rows(spark, 0, 5000, "old"), buckets=200)
    return made


def test_a_small_batch_leaves_the_rest_alone(spark, table):
    before = contents(table.path)
    batch = rows(spark, 4980, 5010, "new").drop("ingested_at")
    done = table.merge(batch, stamps={"ingested_at": F.lit("new")})
    assert (done.version, done.inserted, done.updated) == (1, 10, 20) and done.buckets <= 30
    after = contents(table.path)
    assert all(after[p] == data for p, data in before.items())
    live = {re.search(r"bucket=\d+", f).group(): f for f in table._state()["folders"].values()}
    old = {re.search(r"bucket=\d+", f).group(): f for f in table._state(0)["folders"].values()}
    assert sum(live[b] != old.get(b) for b in live) == done.buckets
    got = {r["nct_id"]: r for r in table.read().collect()}
    assert len(got) == 5010
    assert all(r["title"] == ("new" if r["n"] >= 4980 else "old") for r in got.values())
    assert all(r["ingested_at"] == ("new" if r["n"] >= 5000 else "old") for r in got.values())
    assert {r["title"] for r in table.read(0).collect()} == {"old"}


def test_target_and_batch_are_read_once(spark, table):
    from cohortlens.operators.upsert import merged

    folders = list(table._state()["folders"].values())[:3]
    plan = merged(table._folders(folders), rows(spark, 0, 10, "x"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "FullOuter" in plan


def test_a_look_up_reads_one_bucket(spark, table):
    found = table.lookup("NCT00000042")
    assert [(r["n"], r["title"]) for r in found.collect()] == [(42, "old")]
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(nct_id,NCT00000042)" in text and len(found.inputFiles()) == 1
    assert table.lookup("nobody").isEmpty() and table.lookup("").isEmpty()


def test_files_are_sorted(table):
    import pyarrow.parquet as pq

    for file in sorted(contents(table.path))[:5]:
        ids = pq.read_table(file).column("nct_id").to_pylist()
        assert ids == sorted(ids)


def test_two_writers(spark, table):
    stale = keyed.KeyedTable(spark, table.path, LAYOUT)
    read = stale._state()
    table.merge(rows(spark, 0, 1, "first"))
    bucket = next(b for b, f in table._state()["folders"].items() if f != read["folders"].get(b))
    other = next(b for b in read["folders"] if b != bucket)
    # buckets nobody else changed move to the version after; others are refused
    assert stale._publish(read, {other: read["folders"][other]}) == 2
    assert table.lookup("NCT00000000").first()["title"] == "first"
    with pytest.raises(keyed.ConcurrentChange):
        stale._publish(read, {bucket: "data/none"})
    with pytest.raises(keyed.ConcurrentChange):
        table.create(rows(spark, 0, 1, "x"))


def test_nulls_empty_batches_and_empty_tables(spark, tmp_path):
    made = keyed.KeyedTable(spark, str(tmp_path / "e"), LAYOUT)
    with pytest.raises(FileNotFoundError):
        made.read()
    made.create(rows(spark, 0, 0, "x"), buckets=4)
    assert made.read().isEmpty() and made.lookup("a").isEmpty()
    assert made.merge(rows(spark, 0, 0, "x")).version == 0
    done = made.merge(rows(spark, 0, 3, "x").withColumn("title", F.lit(None).cast("string")))
    assert (done.inserted, done.updated) == (3, 0) and {r["title"] for r in made.read().collect()} == {None}


def test_entries_are_written_once(spark, tmp_path):
    entries = commits.Entries(spark, str(tmp_path / "c"))
    assert entries.names() == [] and entries.get("a") is None
    assert entries.add("b", {"x": 1}) and entries.add("a", {"x": 2}) and not entries.add("a", {"x": 3})
    assert entries.names() == ["a", "b"] and entries.get("a") == {"x": 2}


def test_trials_are_merged_into_their_buckets(spark, trials, tmp_path):
    path = str(tmp_path / "trials")
    whole = trials.withColumn("raw_json", F.lit("{}"))
    tables.trials_by_key(spark, path).create(tables.with_bookkeeping(whole), buckets=16)
    few = whole.filter("nct_id < 'NCT00000040'").withColumn("title", F.lit("again")).withColumn("seen", F.lit(1))
    done = tables.merge_trials(spark, path, few.unionByName(few.withColumn("seen", F.lit(0))), ["seen"])
    assert (done.inserted, done.updated) == (0, few.count())
    now = tables.trials_by_key(spark, path)
    assert now.read().filter("title = 'again'").count() == few.count() and now.read().count() == trials.count()


def test_derived_columns_are_made_in_the_buckets(spark, tmp_path):
    made = keyed.KeyedTable(spark, str(tmp_path / "derived"), LAYOUT)
    parts = spark.range(300).select(F.format_string("NCT%08d", "id").alias("nct_id"), "id")

    def derive(dealt):
        text = dealt._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in text and "title" not in text
        return dealt.select("*", F.repeat(F.lit("wide"), 9).alias("title"), F.col("id").alias("n"), F.lit("x").alias("ingested_at"))

    made.create(parts, buckets=7, derive=derive)
    assert made.read().count() == 300 and made.lookup("NCT00000042").collect()[0][:3] == ("NCT00000042", "wide" * 9, 42)
