"""Request-log monitors. Each function takes a batch or a streaming frame.

The log has an event time ``ts``, a ``service``, a client ``user_id`` and a
numeric ``value``. On a stream, call :func:`with_lateness` first; results then
appear as their periods close.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as C


def with_lateness(log: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Event time as a zoned timestamp, with a bound on how late events arrive.

    Watermarks need a zoned time; a time without a zone is taken to be in that
    of the session (UTC by default here).
    """
    return log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def error_alarms(
    errors: DataFrame,
    period_seconds: int = 60,
    threshold: int = C.ALARM_THRESHOLD,
    periods: int = C.ALARM_PERIODS,
) -> DataFrame:
    """Periods in which a service is in alarm.

    A period breaches when it has more than ``threshold`` errors; the alarm
    holds at the last of ``periods`` breaching periods in a row. A period
    without errors does not breach. The run is found by a second, sliding
    window over the breaching periods: it is full only when none is missing.
    """
    step = f"{period_seconds} seconds"
    breaching = (
        errors.groupBy(F.window("ts", step).alias("period"), "service")
        .agg(F.count(F.lit(1)).alias("errors"))
        .filter(F.col("errors") > threshold)
    )
    return (
        breaching.groupBy(
            F.window("period", f"{period_seconds * periods} seconds", step).alias("run"), "service"
        )
        .agg(
            F.count(F.lit(1)).alias("_breaching"),
            F.min("errors").alias("least_errors"),
            F.sum("errors").alias("errors_in_run"),
        )
        .filter(F.col("_breaching") == periods)
        .select(
            "service",
            (F.col("run.end") - F.expr(f"INTERVAL {int(period_seconds)} SECONDS")).alias("period_start"),
            "least_errors",
            "errors_in_run",
        )
    )


def over_limit(
    log: DataFrame, period_seconds: int = 60, most: int = C.REQUEST_LIMIT
) -> DataFrame:
    """Clients with more than ``most`` requests in a fixed period."""
    return (
        log.groupBy(F.window("ts", f"{period_seconds} seconds").alias("period"), "user_id")
        .agg(F.count(F.lit(1)).alias("requests"))
        .filter(F.col("requests") > most)
        .select("user_id", F.col("period.start").alias("period_start"), "requests")
    )


def open_log(log: DataFrame, delay: str, period_seconds: int, earlier: int = 0) -> tuple[DataFrame, Column]:
    """(rows of the periods a stream left open and ``earlier`` ones before, watermark).

    A stream over ``log`` has given out every period that ends at or before the
    latest time less ``delay``.
    """
    mark = F.lit(log.agg((F.max("ts") - F.expr(f"INTERVAL {delay}")).alias("mark")).first()["mark"]).cast("timestamp")
    start = F.timestamp_seconds((F.floor(F.unix_seconds(mark) / period_seconds) - earlier) * period_seconds)
    return log.filter(F.col("ts") >= start), mark


def still_open(rows: DataFrame, mark: Column, period_seconds: int) -> DataFrame:
    """Rows of periods that end after the watermark."""
    return rows.filter(F.col("period_start") + F.expr(f"INTERVAL {int(period_seconds)} SECONDS") > mark)


def request_series(log: DataFrame, period_seconds: int = 60) -> DataFrame:
    """Requests and mean value per service and period."""
    return (
        log.groupBy(F.window("ts", f"{period_seconds} seconds").alias("period"), "service")
        .agg(F.count(F.lit(1)).alias("requests"), F.avg("value").alias("mean_value"))
        .select("service", F.col("period.start").alias("period_start"), "requests", "mean_value")
    )
