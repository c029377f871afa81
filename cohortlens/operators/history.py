"""Chat history. Messages stay in long form, one row per turn.

A conversation is never folded into a single row, so its length is not limited
by what one task can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as C

TOOL_CALLS_DDL = "array<struct<name: string, args: string>>"


def short_title(text: Column) -> Column:
    """First 60 characters, with dots when there is more."""
    cut = F.concat(F.substring(text, 1, C.TITLE_CHARS), F.lit("..."))
    return F.when(F.length(text) > C.TITLE_CHARS, cut).otherwise(text)


def conversation_summaries(messages: DataFrame) -> DataFrame:
    """Title and message count per conversation; the first user turn names it.

    Messages with ``created_at`` or ``updated_at`` give the first and the last
    of these times as well.
    """
    times = {"created_at": F.min, "updated_at": F.max}
    user_turn = F.when(F.col("role") == "user", F.col("turn"))
    # the title is cut before it is aggregated, so no long text is shuffled
    return (
        messages.withColumn("_title", short_title(F.col("text")))
        .groupBy("conv_id")
        .agg(
            F.coalesce(
                F.nullif(F.min_by("_title", user_turn), F.lit("")), F.lit("Untitled")
            ).alias("title"),
            F.count(F.lit(1)).alias("message_count"),
            F.max("turn").alias("last_turn"),
            *[pick(c).alias(c) for c, pick in times.items() if c in messages.columns],
        )
    )


def list_conversations(
    messages: DataFrame, limit: int = 20, offset: int = 0, newest: str = "conv_id"
) -> DataFrame:
    """A page of summaries, newest first; ``newest`` is the column that orders them."""
    return (
        conversation_summaries(messages)
        .orderBy(F.desc(newest), F.desc("conv_id"))
        .offset(offset)
        .limit(limit)
    )


def conversation(messages: DataFrame, conv_id) -> DataFrame:
    """The turns of one conversation in order."""
    return messages.filter(F.col("conv_id") == conv_id).orderBy("turn")


def dialogue(messages: DataFrame) -> DataFrame:
    """Only the turns that are passed on: those of the user and the assistant."""
    return messages.filter(F.col("role").isin("user", "assistant"))


def replace_conversations(messages: DataFrame, incoming: DataFrame) -> DataFrame:
    """History after an upsert: each incoming conversation replaces the stored one."""
    changed = incoming.select("conv_id").distinct()
    return messages.join(changed, "conv_id", "left_anti").unionByName(
        incoming.select(*messages.columns)
    )


def upsert_titles(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Title table after an upsert: a stored title stays, a new one is added."""
    return stored.unionByName(
        incoming.select(*stored.columns).join(stored.select("conv_id"), "conv_id", "left_anti")
    )


def _truthy(value: Column) -> Column:
    """Whether a variant value counts as set: not null, zero, false or empty."""
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | (kind == "VOID"), F.lit(False))
        .when(kind == "STRING", F.try_variant_get(value, "$", "string") != "")
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind == "OBJECT<>", F.lit(False))
        .when(kind.startswith("ARRAY"), F.to_json(value) != "[]")
        .when(kind.startswith("OBJECT"), F.lit(True))
        .otherwise(F.try_variant_get(value, "$", "double") != 0)
    )


def chart_payloads(messages: DataFrame) -> DataFrame:
    """Messages whose whole text is a JSON object with a chart type set."""
    chart = F.try_variant_get("_body", "$.chart_type", "variant")
    return (
        messages.withColumn("_body", F.try_parse_json("text"))
        .filter(F.schema_of_variant("_body").startswith("OBJECT"))
        .withColumn("_chart", chart)
        .filter(_truthy(F.col("_chart")))
        .select(
            "conv_id",
            "turn",
            F.coalesce(
                F.try_variant_get("_chart", "$", "string"), F.to_json("_chart")
            ).alias("chart_type"),
            F.to_json("_body").alias("payload"),
        )
    )


def tool_calls(messages: DataFrame, column: str = "tool_calls") -> DataFrame:
    """One row per tool call of a run, in call order."""
    return messages.select(
        "conv_id",
        "turn",
        F.posexplode(F.from_json(column, TOOL_CALLS_DDL)).alias("call", "_call"),
    ).select("conv_id", "turn", "call", F.col("_call.name").alias("tool"), F.col("_call.args").alias("args"))


def tool_usage(messages: DataFrame, column: str = "tool_calls") -> DataFrame:
    """Calls and calling conversations per tool."""
    return (
        tool_calls(messages, column)
        .groupBy("tool")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.count_distinct("conv_id").alias("conversations"),
        )
    )
