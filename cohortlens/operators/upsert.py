"""Keyed table maintenance: upsert, insert-if-absent, delete.

All functions are plans over a target and a batch. The target is scanned and
anti-joined on its key; when the batch is small (its size decides, not a hint)
Spark broadcasts the batch keys and the target is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def latest_per_key(
    rows: DataFrame, keys: list[str], order: list[str | Column], first: bool = False
) -> DataFrame:
    """The row with the greatest ``order`` for each key, or with the smallest.

    An aggregate, not a window: copies of one key are reduced inside each task
    before the shuffle, however many there are.
    """
    others = [c for c in rows.columns if c not in keys]
    rank = [F.col(o) if isinstance(o, str) else o for o in order]
    return (
        rows.groupBy(*keys)
        .agg((F.min_by if first else F.max_by)(F.struct(*others), F.struct(*rank)).alias("_row"))
        .select(*keys, *[F.col("_row")[c].alias(c) for c in others])
        .select(*rows.columns)
    )


def upsert(
    target: DataFrame,
    batch: DataFrame,
    key: str = "nct_id",
    keep: tuple[str, ...] = ("ingested_at",),
    stamps: dict[str, Column] | None = None,
    counts: Observation | None = None,
) -> DataFrame:
    """Target after the batch: known keys replaced, new keys added.

    ``batch`` has one row per key (see :func:`latest_per_key`). Columns in
    ``keep`` retain the target's value for known keys; ``stamps`` gives values
    of columns the batch does not carry, such as the update time. Remaining
    target columns missing from the batch also keep their old value. ``counts``
    takes ``inserted`` and ``updated`` while the result is computed.
    """
    stamps = stamps or {}
    held = [c for c in target.columns if c in keep or (c not in batch.columns and c not in stamps)]
    held = [c for c in held if c != key]
    keys = batch.select(key)
    known = target.select(key, *[F.col(c).alias(f"_old_{c}") for c in held]).join(
        keys, key, "left_semi"
    )
    known = known.withColumn("_known", F.lit(True))
    matched = batch.join(known, key, "left")
    if counts is not None:
        matched = matched.observe(
            counts,
            F.count_if(F.col("_known").isNull()).alias("inserted"),
            F.count_if(F.col("_known").isNotNull()).alias("updated"),
        )

    def column(name: str) -> Column:
        new = F.col(name) if name in batch.columns else stamps.get(name, F.lit(None))
        if name in held:
            new = F.when(F.col("_known"), F.col(f"_old_{name}")).otherwise(new)
        return new.cast(target.schema[name].dataType).alias(name)

    written = matched.select(*[column(c) for c in target.columns])
    return target.join(keys, key, "left_anti").unionByName(written)


def merged(
    target: DataFrame,
    batch: DataFrame,
    key: str = "nct_id",
    keep: tuple[str, ...] = ("ingested_at",),
    stamps: dict[str, Column] | None = None,
) -> DataFrame:
    """Target after the batch, with a column ``change``: kept, updated or inserted.

    Same rules as :func:`upsert`, by one full join that reads each side once. It
    shuffles the target, so it is for the part of a table that holds the keys.
    """
    stamps = stamps or {}
    old = target.select(F.struct(*target.columns).alias("_old"), F.col(key).alias("_key"))
    new = batch.select(F.struct(*batch.columns).alias("_new"), F.col(key).alias("_key"))
    joined = old.join(new, "_key", "full_outer")
    known, given = F.col("_old").isNotNull(), F.col("_new").isNotNull()

    def column(name: str) -> Column:
        held = F.col(f"_old.{name}")
        if name in batch.columns:
            value = F.col(f"_new.{name}")
        else:
            value = stamps.get(name, F.lit(None))
        if name in keep or (name not in batch.columns and name not in stamps):
            value = F.when(known, held).otherwise(value)
        return F.when(given, value).otherwise(held).cast(target.schema[name].dataType).alias(name)

    change = F.when(~given, "kept").when(known, "updated").otherwise("inserted")
    return joined.select(*[column(c) for c in target.columns], change.alias("change"))


def upsert_counts(target: DataFrame, batch: DataFrame, key: str = "nct_id") -> DataFrame:
    """One row: how many batch keys are new and how many replace a target row."""
    known = (
        target.select(key)
        .join(batch.select(key), key, "left_semi")
        .withColumn("_known", F.lit(True))
    )
    return (
        batch.select(key)
        .join(known, key, "left")
        .agg(
            F.count_if(F.col("_known").isNull()).alias("inserted"),
            F.count_if(F.col("_known").isNotNull()).alias("updated"),
        )
    )


def insert_absent(target: DataFrame, batch: DataFrame, key: str = "nct_id") -> DataFrame:
    """Only those batch rows whose key the target lacks, ready to append."""
    return batch.join(target.select(key), key, "left_anti")


def delete_keys(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Target without the rows of the given keys."""
    return target.join(keys.select(key), key, "left_anti")
