"""Proportional stratified interleaving into shards, in DataFrame functions alone.

Rows are ranked within their source in a seeded random order; a row's place is
its rank as a fraction of its source. Sorting all rows by that fraction mixes
the sources evenly everywhere, so equal runs of the order make shards that all
match the mixture. Law: ``rows``, shards differ by one row at most.

Neither ranking sorts a source or the table in one task: rows are counted in
65,536 cells of the order, the counts are summed up in two steps of 256, and
only rows of one cell are ordered together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import staged

CELLS = 1 << 16


def _bases(rows: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """For each cell how many rows of its keys lie in the cells before it."""
    coarse = F.shiftright(cell, 8)
    counts = rows.groupBy(*keys, cell).agg(F.count("*").alias("n")).withColumn("coarse", coarse)
    before = (Window.unboundedPreceding, -1)
    wide = counts.groupBy(*keys, "coarse").agg(F.sum("n").alias("n"))
    over_coarse = Window.partitionBy(*keys).orderBy("coarse").rowsBetween(*before)
    wide = wide.select(*keys, "coarse", F.coalesce(F.sum("n").over(over_coarse), F.lit(0)).alias("wide"))
    over_fine = Window.partitionBy(*keys, "coarse").orderBy(cell).rowsBetween(*before)
    fine = counts.withColumn("fine", F.coalesce(F.sum("n").over(over_fine), F.lit(0)))
    return fine.join(wide, [*keys, "coarse"]).select(*keys, cell, (F.col("wide") + F.col("fine")).alias("base"))


def interleaved(documents: DataFrame, shards: int, seed: int = 0, stratum: str = "source") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 length of the text plus 16. A null text has no bytes
    and checksum 0. Null sources are a source of their own. Rows that repeat a
    doc_id get places of their own; rows equal in id, length and checksum are
    interchangeable. Empty tables give no rows; other columns are ignored.
    ``grown_shard`` is null: the law isn't ``key``.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(stratum).alias("stratum"),
    ).withColumn("turn", F.xxhash64("doc_id", "text_crc32", F.lit(seed)))
    rows = staged(rows.withColumn("cell", F.shiftrightunsigned("turn", 48).cast("int")), "shard-rows")
    total = rows.count()
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("members"))
    ties = ("turn", "doc_id", "text_crc32", "size")
    bases = _bases(rows, ["stratum"], "cell").join(sizes, "stratum")
    inside = Window.partitionBy("stratum", "cell").orderBy(*ties)
    ranked = rows.join(bases, ["stratum", "cell"]).withColumn("rank", F.col("base") + F.row_number().over(inside) - 1)
    place = (2 * F.col("rank") + 1) / (2 * F.col("members"))
    placed = staged(
        ranked.select("doc_id", "size", "text_crc32", "stratum", "turn", place.alias("place")).withColumn(
            "cell", F.least(F.floor(F.col("place") * CELLS), F.lit(CELLS - 1)).cast("int")
        ),
        "shard-places",
    )
    inside = Window.partitionBy("cell").orderBy("place", "stratum", *ties)
    position = (F.col("base") + F.row_number().over(inside) - 1).cast("long")
    ordered = placed.join(_bases(placed, [], "cell"), "cell").withColumn("position", position)
    return ordered.withColumn("shard", F.expr(f"position * {shards} DIV {max(total, 1)}")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("position") - F.expr(f"(shard * {total} + {shards - 1}) DIV {shards}")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
