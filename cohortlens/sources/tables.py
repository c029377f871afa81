"""Trial table readers and the table-level sinks.

Tables are Parquet folders. A table that is rewritten keeps its old files: a
new snapshot goes to a new folder and readers are pointed at it, so nothing is
ever overwritten while it is being read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cohortlens import schemas
from cohortlens.operators.upsert import insert_absent, latest_per_key, upsert
from cohortlens.session import staged
from cohortlens.sources.keyed import KeyedTable


def read_trials(spark: SparkSession, path: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """The trials table with its declared schema; ``columns`` narrows the scan."""
    df = spark.read.schema(schemas.TRIALS_DDL).parquet(path)
    return df.select(*columns) if columns else df


def read_trials_jdbc(
    spark: SparkSession, url: str, table: str = "trials", partition: dict | None = None, **options
) -> DataFrame:
    """Trials from a relational database.

    ``partition`` holds ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions``, so that executors read ranges side by side.
    """
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, **(partition or {}), **options)
        .load()
    )


def with_bookkeeping(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Normalised rows completed to the full trials table layout."""
    now = F.current_timestamp() if now is None else now
    extra = {
        "number_of_groups": F.lit(None).cast("int"),
        "ingested_at": now,
        "updated_at": now,
    }
    return rows.withColumns({k: v for k, v in extra.items() if k not in rows.columns})


@dataclass(frozen=True)
class Ingested:
    snapshot: str
    inserted: int
    updated: int


def upsert_trials(
    spark: SparkSession, current: str | None, rows: DataFrame, order: list[str], snapshot: str
) -> Ingested:
    """Apply normalised ``rows`` to the table at ``current``; writes ``snapshot``.

    The batch is first reduced to the last row per key and staged, so that it is
    computed once and Spark knows its true size when it plans the joins. Counts
    are taken while the snapshot is written. See :func:`merge_trials` for a table
    of which a batch rewrites only a part.
    """
    latest = latest_per_key(rows, ["nct_id"], order)
    batch = staged(
        latest.drop(*[o for o in order if o not in schemas.NORMALISED_COLUMNS]), "upsert-batch"
    )
    now, counts = F.current_timestamp(), Observation()
    if current is None:
        written = with_bookkeeping(batch, now).observe(counts, F.count(F.lit(1)).alias("inserted"))
    else:
        stamps = {"ingested_at": now, "updated_at": now}
        written = upsert(read_trials(spark, current), batch, stamps=stamps, counts=counts)
    written.write.parquet(snapshot)
    return Ingested(snapshot, counts.get["inserted"], counts.get.get("updated", 0))


def merge_trials(spark: SparkSession, path: str, rows: DataFrame, order: list[str]) -> Ingested:
    """Apply normalised ``rows`` to the keyed table at ``path``, touching only their buckets."""
    latest = latest_per_key(rows, ["nct_id"], order)
    batch = latest.drop(*[o for o in order if o not in schemas.NORMALISED_COLUMNS])
    now = F.current_timestamp()
    done = trials_by_key(spark, path).merge(batch, stamps={"ingested_at": now, "updated_at": now})
    return Ingested(f"{path}@{done.version}", done.inserted, done.updated)


def trials_by_key(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, schemas.TRIALS_DDL)


def append_absent(spark: SparkSession, path: str, rows: DataFrame, order: list[str]) -> None:
    """Append the rows whose key is not in the table yet; others are left alone.

    Of several new rows with one key the first in ``order`` is kept.
    """
    columns = read_trials(spark, path).columns
    batch = latest_per_key(rows, ["nct_id"], order, first=True).select(*columns)
    insert_absent(read_trials(spark, path), batch).write.mode("append").parquet(path)


def job_row(
    spark: SparkSession,
    job_id: str,
    status: str,
    started_at,
    inserted: int = 0,
    updated: int = 0,
    error: str | None = None,
    job_type: str = "full_ingest",
) -> DataFrame:
    """One ingestion log row; a finished job carries its end time."""
    finished = F.current_timestamp() if status in ("completed", "failed") else F.lit(None)
    values = {
        "job_id": F.lit(job_id),
        "job_type": F.lit(job_type),
        "status": F.lit(status),
        "records_fetched": F.lit(inserted + updated),
        "records_inserted": F.lit(inserted),
        "records_updated": F.lit(updated),
        "error_message": F.lit(error),
        "started_at": F.lit(started_at),
        "finished_at": finished,
    }
    kinds = dict(
        part.strip().split(" ") for part in schemas.INGESTION_JOBS_DDL.replace("\n", " ").split(",")
    )
    return spark.range(1).select(*[v.cast(kinds[k]).alias(k) for k, v in values.items()])


def log_job(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("append").parquet(path)


def job_states(log: DataFrame) -> DataFrame:
    """The latest state of every logged job."""
    return latest_per_key(
        log, ["job_id"], [F.coalesce("finished_at", F.lit("1970-01-01").cast("timestamp"))]
    )


def run_logged(spark: SparkSession, log_path: str, job_id: str, work) -> Ingested:
    """Run ``work() -> Ingested`` between a ``running`` and a final log row."""
    started = spark.range(1).select(F.current_timestamp()).first()[0]
    log_job(job_row(spark, job_id, "running", started), log_path)
    try:
        done = work()
    except Exception as error:
        log_job(job_row(spark, job_id, "failed", started, error=str(error)), log_path)
        raise
    log_job(
        job_row(spark, job_id, "completed", started, done.inserted, done.updated), log_path
    )
    return done


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Store predictions; a rerun replaces those of the versions it holds."""
    (
        predictions.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model_version")
        .parquet(path)
    )


def append_metrics(metrics: DataFrame, path: str) -> None:
    """One row per training run."""
    metrics.coalesce(1).write.mode("append").parquet(path)
