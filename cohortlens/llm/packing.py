"""Cost-balanced packing of documents into token sequences.

Documents are encoded once and staged. They are dealt by hash into groups of
about ``group`` documents, and each group is packed on its own: whole pieces of
a full sequence stand alone, and the remainders, in descending order, each go
to the sequence of lowest attention cost that still has room. A remainder that
fits nowhere is cut to fill the room that is left, so a group wastes less than
one sequence. The groups depend on the documents only, not on the machine.
"""

from __future__ import annotations

import contextlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.bpe_ids import encoded
from cohortlens.session import shared_folder, text_batches

#: Frugal runs are of about so many bytes of text; pieces are made of so many rows at a time.
RUN_BYTES, SLICE_ROWS = 1 << 20, 500

PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@dataclass(frozen=True)
class PackSettings:
    """Attention over a piece of n tokens costs ``linear`` * n + ``quadratic`` * n * n."""

    capacity: int = 2048
    group: int = 2000
    linear: float = 1.0
    quadratic: float = 1.0 / 1024


def packed_lengths(lengths: np.ndarray, settings: PackSettings) -> list[list[tuple[int, int, int, int]]]:
    """For each document its pieces (start, length, sequence, offset)."""
    size = settings.capacity
    pieces: list[list[tuple[int, int, int, int]]] = [[] for _ in lengths]
    sequence = 0
    for i, length in enumerate(lengths):
        for at in range(0, int(length) - size + 1, size):
            pieces[i].append((at, size, sequence, 0))
            sequence += 1
    rest = np.asarray(lengths, np.int64) % size
    count = -(-int(rest.sum()) // size)
    room, cost = np.full(count, size, np.int64), np.zeros(count)
    placed: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]  # document, start, length

    def place(i: int, start: int, length: int, k: int) -> None:
        placed[k].append((i, start, length))
        room[k] -= length
        cost[k] += settings.linear * length + settings.quadratic * length * length

    late = []
    for i in np.argsort(-rest, kind="stable"):
        length = int(rest[i])
        if not length:
            break
        open_cost = np.where(room >= length, cost, np.inf)
        k = int(open_cost.argmin())
        if open_cost[k] < np.inf:
            place(i, int(lengths[i]) - length, length, k)
        else:
            late.append(i)
    for i in late:
        start, left = int(lengths[i]) - int(rest[i]), int(rest[i])
        while left:
            k = int(np.where(room > 0, cost, np.inf).argmin())
            part = min(left, int(room[k]))
            place(i, start, part, k)
            start, left = start + part, left - part
    for k, content in enumerate(placed):
        offset = 0
        for i, start, length in content:
            pieces[i].append((start, length, sequence + k, offset))
            offset += length
    return pieces


def _packed_group(settings: PackSettings):
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["n_tokens", "row"], ascending=[False, True])
        base = int(batch["bin"].iloc[0]) << 32
        names = ("start", "length", "sequence_id", "offset")
        plans = packed_lengths(batch["n_tokens"].to_numpy(), settings)
        shown = [[dict(zip(names, (start, length, base + k, offset))) for start, length, k, offset in plan] for plan in plans]
        return pd.DataFrame({"row": batch["row"], "pieces": shown})

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the rows, ``SLICE_ROWS`` at a time, their ids read where Arrow holds them."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part, rows = batch.slice(at, SLICE_ROWS), []
            names = (part.column(c) for c in ("doc_id", "n_tokens", "ids", "pieces"))
            for doc_id, total, ids, pieces in zip(*names):
                wide = np.frombuffer(ids.as_buffer(), np.uint16).astype("<u4")
                doc_id, total = doc_id.as_py(), total.as_py()
                for p in pieces.as_py():
                    run = wide[p["start"] : p["start"] + p["length"]]
                    rows.append((doc_id, p["start"], p["length"], zlib.crc32(run), total, p["sequence_id"], p["offset"]))
            yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in zip(*rows)], names=PIECE)


def packing_plan(tokens: DataFrame, settings: PackSettings) -> DataFrame:
    """row, pieces (start, length, sequence_id, offset) for staged tokens."""
    groups = max(1, -(-tokens.count() // settings.group))
    dealt = tokens.select("row", "n_tokens", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("bin"))
    layout = "row long, pieces array<struct<start: long, length: long, sequence_id: long, offset: long>>"
    return dealt.groupBy("bin").applyInPandas(_packed_group(settings), layout)


def pack(documents: DataFrame, settings: PackSettings | None = None, path: str | None = None, frugal: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``sequence_id`` tells sequences apart and has gaps; ``offset`` is gapless
    within one. A null or empty text is the end id alone. Every row is packed,
    repeated rows and null ids included. An empty table gives no rows; other
    columns are ignored. ``frugal`` encodes in a seventh of the memory, for
    more time; the rows are the same.
    """
    spark = documents.sparkSession
    place = shared_folder(spark, "encoded")
    with text_batches(spark) if frugal else contextlib.nullcontext():
        tokens = encoded(documents, path, RUN_BYTES, forget=True) if frugal else encoded(documents, path)
        tokens.write.option("compression", "zstd").parquet(place)
    tokens = spark.read.parquet(place)
    plan = packing_plan(tokens, settings or PackSettings())
    joined = tokens.join(plan, "row").select("doc_id", "n_tokens", "ids", "pieces")
    return joined.mapInArrow(_digests, ", ".join(f"{name} long" for name in PIECE))
