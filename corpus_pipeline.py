"""From documents to packed sequences: quality rules, near-dedup, decontamination, packing."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortlens.llm.decontaminate import decontaminated  # noqa: E402
from cohortlens.llm.line_quality import cleaned  # noqa: E402
from cohortlens.llm.near_dedup import NearSettings, one_of_each  # noqa: E402
from cohortlens.llm.packing import pack  # noqa: E402
from cohortlens.session import staged, staging  # noqa: E402


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; boilerplate lines are taken out of the others."""
    return cleaned(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: five words, a similarity of 0.8 or more."""
    return one_of_each(docs, NearSettings(shingle=5, percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 2,048 tokens."""
    return pack(docs, frugal=True)  # the stages before leave little memory


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Neither MinHash nor tokenising can be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the documents that all stages keep, in sequences.

    Null, empty and wordless texts go with the quality rules, as do rejected
    documents; of repeated rows one stays. An empty table gives no pieces.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with staging(spark):  # what a stage has left goes once its result is written
            docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"), outlast=True)
    return STAGES[-1][1](spark, docs, sf_dir)
