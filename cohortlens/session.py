"""Session defaults and the shared working folder."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.scheduler.mode": "FAIR",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

_local_folder: dict[str, str] = {}


def get_session(app: str = "cohortlens", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the defaults this package expects; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may do without that setting; it gets a temporary
    folder of its own. A cluster without it is an error, because a folder on
    one machine is lost with that machine and unseen by the others.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        app = context.applicationId
        if app not in _local_folder:
            _local_folder[app] = tempfile.mkdtemp(prefix="cohortlens-")
        base = _local_folder[app]
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


_open_scopes: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("staging", default=())


def staged(rows: DataFrame, purpose: str, outlast: bool = False) -> DataFrame:
    """``rows`` written below the shared folder and read back.

    What follows starts from files: it is computed once, survives lost
    executors, and is planned with the true size. Inside :func:`staging` the
    files belong to that scope, or with ``outlast`` to the one around it.
    """
    path = shared_folder(rows.sparkSession, purpose)
    scopes = _open_scopes.get()
    owner = scopes[:-1] if outlast else scopes
    if owner:
        owner[-1].append(path)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


@contextlib.contextmanager
def staging(spark: SparkSession):
    """A scope that deletes what was staged in it when it ends.

    Frames that read such files must have been computed by then; what has to
    live on is staged with ``outlast``.
    """
    paths: list[str] = []
    token = _open_scopes.set((*_open_scopes.get(), paths))
    try:
        yield
    finally:
        _open_scopes.reset(token)
        path_of, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
        for path in paths:
            place = path_of(path)
            place.getFileSystem(conf).delete(place, True)


#: Rows of an Arrow batch of whole texts, in the place of Spark's 10,000.
TEXT_ROWS = 1_000


@contextlib.contextmanager
def text_batches(spark: SparkSession):
    """A scope in which plans hand texts to Python ``TEXT_ROWS`` at a time.

    An executor holds a batch on both sides, and its JVM keeps the buffers in
    which batches grow. For jobs that run inside the scope; results don't depend on it.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(TEXT_ROWS, int(before)) if int(before) > 0 else TEXT_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def numbered(documents: DataFrame) -> DataFrame:
    """``d``, each row as a struct, and ``row``, a number that is its own whenever it is read.

    Rows of Parquet files are told by a hash of their file and place, which does
    not depend on how files are split over tasks; two of ten billion rows share
    one with a chance of about one in a billion each. Other frames are staged.
    """
    whole = F.struct("*").alias("d")
    try:
        return documents.select(whole, F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("row"))
    except AnalysisException:
        return staged(documents.select(whole, F.monotonically_increasing_id().alias("row")), "numbered", outlast=True)
