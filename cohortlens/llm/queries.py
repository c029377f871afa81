"""The registered queries of this subpackage: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm.decontaminate import leaks
from cohortlens.llm.license_scan import license_scan
from cohortlens.llm.line_quality import line_quality
from cohortlens.llm.near_dedup import near_duplicates
from cohortlens.llm.packing import pack
from cohortlens.llm.periodic_runs import periodic_runs
from cohortlens.llm.pitman_yor import language_scores
from cohortlens.llm.sharding import interleaved
from cohortlens.llm.token_alignment import aligned_tokenizers
from cohortlens.llm.token_counts import token_counts
from cohortlens.llm.token_files import token_files
from cohortlens.llm.url_rules import judged_urls
from cohortlens.llm.warc import archived

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

#: DuckDB SQL for the queries that SQL can express.
ORACLE: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op3_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))


@query
def op6_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


@query
def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_quality(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left"
    )


@query
def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


@query
def op5_stratified_interleaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleaved(table(spark, sf_dir, "documents"), shards=40)


@query
def op10_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return found.select("page_id", "host", "path", "rule", "verdict")


@query
def op4_license_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


@query
def op8_warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


@query
def op9_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


@query
def op11_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))


@query
def op12_synchronising_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"))


@query
def op13_arrow_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_tokenizers(table(spark, sf_dir, "documents"))
