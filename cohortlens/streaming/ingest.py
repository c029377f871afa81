"""Continuous ingest: landed page files to a change log, and the current table.

Each micro-batch writes its normalised studies to its own partition of a change
log, so a repeated batch replaces itself and the cost of a batch follows its
size, not that of the table. The current table is the last change per trial;
:func:`compact` folds the changes since the last snapshot into a new one, and
:func:`table_now` reads a snapshot with the changes after it.

Copies of a study are ordered by run, batch, page file, position in the page
and, where pages share a file and all these are equal, by a hash of the text.

A run belongs to one checkpoint, which numbers its batches. Runs are entries of
an append-only list beside the log: a checkpoint that the log does not know is
given a run of its own, after all others, so its batches never take the place
of another's. Finished batches are listed as well, with what they read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.normalize import normalise
from cohortlens.operators.upsert import latest_per_key, upsert
from cohortlens.schemas import NORMALISED_COLUMNS, TRIALS_DDL
from cohortlens.session import staged
from cohortlens.sources.commits import Entries, numbered
from cohortlens.sources.studies import open_pages, parse_studies
from cohortlens.sources.tables import Ingested, read_trials, upsert_trials

CHANGES_DDL = (
    f"{TRIALS_DDL}, page_file string, position int, text_hash long, run int, batch_id long, state string"
)
ORDER = ("run", "batch_id", "page_file", "position", "text_hash")


def _runs(spark: SparkSession, changes: str) -> Entries:
    return Entries(spark, f"{changes.rstrip('/')}/_runs")


def _batches(spark: SparkSession, changes: str) -> Entries:
    return Entries(spark, f"{changes.rstrip('/')}/_batches")


def claim_run(spark: SparkSession, changes: str, checkpoint: str, run: int | None = None) -> int:
    """The run of a checkpoint: the one it has, or the next, or ``run`` if nobody has it.

    A run that another checkpoint has, or that isn't this one's, is refused.
    """
    own = Entries(spark, f"{checkpoint.rstrip('/')}/run")
    held = own.get("run")
    runs = _runs(spark, changes)
    if held is not None:
        if (runs.get(numbered(held["run"])) or {}).get("owner") != held["owner"]:
            raise ValueError(f"the checkpoint {checkpoint} belongs to another change log")
        if run not in (None, held["run"]):
            raise ValueError(f"the checkpoint {checkpoint} has run {held['run']}, not {run}")
        return held["run"]
    owner = uuid.uuid4().hex
    while True:
        taken = [int(n) for n in runs.names()] + _stored_runs(spark, changes)
        number = max(taken, default=-1) + 1 if run is None else run
        if number not in taken and runs.add(numbered(number), {"owner": owner, "checkpoint": checkpoint}):
            break
        if run is not None:
            raise ValueError(f"run {run} of {changes} belongs to another checkpoint")
    own.add("run", {"run": number, "owner": owner})
    return number


def _stored_runs(spark: SparkSession, changes: str) -> list[int]:
    """Runs that the folders of a log show, for logs without a list."""
    path = spark._jvm.org.apache.hadoop.fs.Path(changes)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path)]
    return [int(n.removeprefix("run=")) for n in names if n.startswith("run=")]


def _write_batch(pages: DataFrame, batch_id: int, changes: str, run: int = 0) -> None:
    """One pass over the pages; what cannot be read goes to partitions of its own.

    The batch is listed with its counts, taken while it is written.
    """
    counts = Observation()
    read = F.col("state") == "read"
    (
        normalise(parse_studies(open_pages(pages)), keep=("page_file", "position", "readable"))
        .withColumn("state", F.when(F.col("readable"), "read").otherwise("quarantined"))
        .withColumn("text_hash", F.xxhash64("raw_json"))
        .withColumn("run", F.lit(run).cast("int"))
        .withColumn("batch_id", F.lit(batch_id).cast("long"))
        .drop("readable")
        .observe(counts, F.count_if(read).alias("read"), F.count_if(~read).alias("quarantined"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run", "batch_id", "state")
        .parquet(changes)
    )
    _batches(pages.sparkSession, changes).add(
        f"{numbered(run)}-{numbered(batch_id)}", {"run": run, "batch_id": batch_id, **counts.get}
    )


def batch_log(spark: SparkSession, changes: str) -> DataFrame:
    """run, batch_id, read, quarantined of every finished batch."""
    entries = f"{changes.rstrip('/')}/_batches"
    layout = "run int, batch_id long, read long, quarantined long"
    # the folder's name begins with an underscore, so its files are named one by one
    files = [f"{entries}/{n}.json" for n in _batches(spark, changes).names()]
    return spark.read.schema(layout).json(files) if files else spark.createDataFrame([], layout)


def ingest_stream(
    spark: SparkSession,
    source: str,
    changes: str,
    checkpoint: str,
    one_page_per_file: bool = True,
    files_per_batch: int | None = 1000,
    run: int | None = None,
):
    """Start a run over all page files not yet read, and stop when they are done.

    A micro-batch takes ``files_per_batch`` files, whatever is waiting. The run
    is that of the checkpoint (see :func:`claim_run`): a new checkpoint on a log
    that exists reads all pages again, as changes after those of all other runs.
    """
    run = claim_run(spark, changes, checkpoint, run)
    reader = spark.readStream.format("text").option("wholetext", one_page_per_file)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    pages = reader.load(source).select(
        F.col("value").alias("page"), F.col("_metadata.file_path").alias("page_file")
    )
    return (
        pages.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda rows, batch_id: _write_batch(rows, batch_id, changes, run))
        .start()
    )


def read_changes(spark: SparkSession, changes: str, columns: tuple[str, ...] = NORMALISED_COLUMNS) -> DataFrame:
    """The change log; run, batch and state are folders, so filters on them skip files.

    ``columns``, the key among them, narrows the scan and all that :func:`current_trials` moves.
    """
    rows = spark.read.schema(CHANGES_DDL).parquet(changes)
    return rows.select(*ORDER, "state", *columns)


def current_trials(changes: DataFrame) -> DataFrame:
    """The table as it stands: the last readable change of every trial."""
    read = changes.filter("state = 'read'").drop("state")
    return latest_per_key(read, ["nct_id"], list(ORDER)).drop(*ORDER)


def quarantine(changes: DataFrame) -> DataFrame:
    """Texts set aside: single studies, and whole pages where ``position`` is null."""
    return changes.filter("state = 'quarantined'").select("batch_id", "page_file", "position", "raw_json")


def _folded(snapshot: str) -> str:
    return f"{snapshot.rstrip('/')}.folded"


def _up_to(run: int, batch: int):
    return (F.col("run") < run) | ((F.col("run") == run) & (F.col("batch_id") <= batch))


def later_changes(
    spark: SparkSession, snapshot: str | None, changes: str, columns: tuple[str, ...] = NORMALISED_COLUMNS
) -> DataFrame:
    """The log without what ``snapshot`` already holds; its folders aren't read.

    ``snapshot`` is one that :func:`compact` wrote; without one, the whole log.
    """
    rows = read_changes(spark, changes, columns)
    if snapshot is None:
        return rows
    mark = spark.read.parquet(_folded(snapshot)).first()
    return rows.filter(~_up_to(mark["run"], mark["batch_id"]))


def table_now(spark: SparkSession, snapshot: str, changes: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """The table as it stands: a snapshot and the changes after it.

    Rows that came or changed since the snapshot carry the time of this reading.
    ``columns``, the key among them, narrows what is read and moved.
    """
    now = F.current_timestamp()
    changed = tuple(c for c in NORMALISED_COLUMNS if not columns or c in columns)
    later = staged(current_trials(later_changes(spark, snapshot, changes, changed)), "later-changes")  # read three times
    return upsert(read_trials(spark, snapshot, columns), later, stamps={"ingested_at": now, "updated_at": now})


def compact(
    spark: SparkSession, snapshot: str | None, changes: str, through_batch: int, new_snapshot: str, run: int = 0
) -> Ingested:
    """Fold the changes after ``snapshot`` up to a batch of a run into a new snapshot.

    What it holds is noted beside it, so the next call reads later batches only.
    """
    rows = later_changes(spark, snapshot, changes).filter("state = 'read'").drop("state")
    done = upsert_trials(spark, snapshot, rows.filter(_up_to(run, through_batch)), list(ORDER), new_snapshot)
    mark = spark.range(1).select(F.lit(run).cast("int").alias("run"), F.lit(through_batch).cast("long").alias("batch_id"))
    mark.write.mode("overwrite").parquet(_folded(new_snapshot))
    return done
