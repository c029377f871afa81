"""A table stored by key: a batch rewrites only what it touches, a look-up reads one file.

Rows are dealt into buckets by a hash of their key; a bucket is a folder of
Parquet files sorted by key, with Bloom filters on it. A version of the table
is a list of bucket folders. A batch is merged with the buckets of its keys,
read once; they are written anew, and the next version points to them and to
all other folders as they are. Versions are entries of an append-only list, so
readers see the old table or the new one, and of two writers of one version one
succeeds. The other takes its buckets over to the version after, if that one
left them alone.

Nothing is overwritten or deleted, so a version stays readable.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.upsert import merged
from cohortlens.session import staged
from cohortlens.sources.commits import Entries, numbered

#: Spark's own seed of xxhash64, so that a look-up finds the bucket without a job.
_SEED = 42


class ConcurrentChange(RuntimeError):
    """Another writer changed the same buckets; read again and repeat."""


@dataclass(frozen=True)
class Merged:
    version: int
    inserted: int
    updated: int
    buckets: int


class KeyedTable:
    """The table at ``path`` with the columns of ``layout`` (DDL) and a string ``key``."""

    def __init__(self, spark: SparkSession, path: str, layout: str, key: str = "nct_id"):
        self.spark, self.path, self.layout, self.key = spark, path.rstrip("/"), layout, key
        self._versions = Entries(spark, f"{self.path}/versions")

    def version(self) -> int | None:
        names = self._versions.names()
        return int(names[-1]) if names else None

    def _state(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        state = None if version is None else self._versions.get(numbered(version))
        if state is None:
            raise FileNotFoundError(f"no version {version} of a table at {self.path}")
        return {**state, "version": version}

    def _folders(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.layout)
        return self.spark.read.schema(self.layout).parquet(*[f"{self.path}/{f}" for f in folders])

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, tasks: int, finish: Callable[[DataFrame], DataFrame] | None = None) -> str:
        """Rows with their bucket, to bucket folders of a new name below ``data``."""
        name = f"data/{uuid.uuid4().hex}"
        dealt = rows.repartition(tasks, "bucket").sortWithinPartitions("bucket", self.key)
        (
            (finish(dealt) if finish else dealt)
            .write.partitionBy("bucket")
            .option(f"parquet.bloom.filter.enabled#{self.key}", "true")
            .parquet(f"{self.path}/{name}")
        )
        return name

    def create(
        self, rows: DataFrame, buckets: int = 64, derive: Callable[[DataFrame], DataFrame] | None = None
    ) -> int:
        """Version 0 from rows with one row per key; ``buckets`` stays fixed, so take
        the size the table will have by some 128 MB.

        With ``derive`` the rows hold the key and what the columns are made from;
        it adds the columns, row by row, once the rows are in their buckets, so
        that wide columns are neither moved nor sorted.
        """
        kinds = self._folders([]).schema
        layout = [F.col(f.name).cast(f.dataType) for f in kinds]
        finish = (lambda dealt: derive(dealt).select(*layout, "bucket")) if derive else None
        rows = (rows if derive else rows.select(*layout)).withColumn("bucket", self._bucket(buckets))
        name = self._write(rows, min(buckets, 2000), finish)
        filled = self.spark.read.parquet(f"{self.path}/{name}").select("bucket").distinct() if not rows.isEmpty() else None
        found = [r["bucket"] for r in filled.collect()] if filled is not None else []  # no more rows than buckets
        folders = {str(b): f"{name}/bucket={b}" for b in found}
        if not self._versions.add(numbered(0), {"buckets": buckets, "folders": folders}):
            raise ConcurrentChange(f"a table at {self.path} exists already")
        return 0

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the last one by default."""
        return self._folders(sorted(self._state(version)["folders"].values()))

    def lookup(self, value: str, version: int | None = None) -> DataFrame:
        """The row of one key: the files of one bucket, with the key pushed down to them."""
        state = self._state(version)
        hashed = xxhash.xxh64_intdigest(value.encode(), seed=_SEED)
        bucket = (hashed - (1 << 64) if hashed >> 63 else hashed) % state["buckets"]
        folder = state["folders"].get(str(bucket))
        return self._folders([folder] if folder else []).filter(F.col(self.key) == value)

    def merge(
        self, batch: DataFrame, keep: tuple[str, ...] = ("ingested_at",), stamps: dict[str, Column] | None = None
    ) -> Merged:
        """Known keys replaced, new ones added; the batch has one row per key.

        ``keep`` and ``stamps`` as in :func:`cohortlens.operators.upsert.upsert`.
        Counts come out of the write itself.
        """
        state = self._state()
        batch = staged(batch.withColumn("bucket", self._bucket(state["buckets"])), "merge-batch")
        touched = sorted(r["bucket"] for r in batch.select("bucket").distinct().collect())  # no more than buckets
        if not touched:
            return Merged(state["version"], 0, 0, 0)
        old = self._folders([state["folders"][str(b)] for b in touched if str(b) in state["folders"]])
        counts = Observation()
        rows = merged(old, batch.drop("bucket"), self.key, keep, stamps).observe(
            counts, F.count_if(F.col("change") == "inserted").alias("inserted"), F.count_if(F.col("change") == "updated").alias("updated")
        )
        rows = rows.drop("change").withColumn("bucket", self._bucket(state["buckets"]))
        name = self._write(rows, min(len(touched), 2000))
        version = self._publish(state, {str(b): f"{name}/bucket={b}" for b in touched})
        return Merged(version, counts.get["inserted"], counts.get["updated"], len(touched))

    def _publish(self, read: dict, folders: dict[str, str]) -> int:
        """The next version: ``folders`` in the place of those that were read."""
        base = read
        while True:
            version = base["version"] + 1
            content = {"buckets": base["buckets"], "folders": {**base["folders"], **folders}}
            if self._versions.add(numbered(version), content):
                return version
            base = self._state(version)
            if any(base["folders"].get(b) != read["folders"].get(b) for b in folders):
                raise ConcurrentChange(f"version {version} of {self.path} changed buckets of this batch")
