"""Staged files and who deletes them, numbers of rows."""

import os

import pytest
from pyspark.sql import functions as F

from cohortlens.session import numbered, shared_folder, staged, staging


def folders(spark):
    base = os.path.dirname(shared_folder(spark, "x"))
    return set(os.listdir(base)) if os.path.isdir(base) else set()


def test_a_scope_deletes_what_was_staged_in_it(spark):
    before = folders(spark)
    with staging(spark):
        kept = staged(staged(spark.range(5), "goes").select("id"), "stays", outlast=True)
        with staging(spark):
            inner = staged(spark.range(3), "outer-scope", outlast=True)
        assert inner.count() == 3 and len(folders(spark) - before) == 3
    left = folders(spark) - before
    assert len(left) == 1 and left.pop().startswith("stays") and kept.count() == 5


def test_a_scope_that_fails_deletes_as_well(spark):
    before = folders(spark)
    with pytest.raises(RuntimeError), staging(spark):
        staged(spark.range(5), "goes")
        raise RuntimeError
    assert folders(spark) == before


def test_numbers_of_rows_do_not_follow_the_splits(spark, tmp_path):
    spark.range(0, 5000, 1, 3).select("id", F.lit("x").alias("row"), F.lit(1).alias("d")).write.parquet(str(tmp_path / "t"))

    def told():
        rows = numbered(spark.read.parquet(str(tmp_path / "t"))).select("d.id", "row")
        return {r["id"]: r["row"] for r in rows.collect()}, rows.rdd.getNumPartitions()

    whole, few = told()
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        again, many = told()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert whole == again and len(set(whole.values())) == 5000 and many > few
    rows = numbered(spark.range(10).withColumn("x", F.rand()))
    assert {r["row"] for r in rows.collect()} == {r["row"] for r in rows.collect()} and rows.select("row").distinct().count() == 10
