"""Token ids in Huffman-coded files, and back.

The code is canonical and length-limited, from the counts of all ids. Documents
are dealt in ranges of doc_id; each range becomes one file of frames. A frame
holds some whole documents, their ids coded in blocks of 1,024, and the bit
offset of each block, so blocks are decoded on their own, here side by side.

File: magic, the table (largest id + 1, then a code length for every id, deflated),
frames, the offsets of the frames, their number, magic. Frame: number of documents and of
ids and bytes of payload, doc_ids with a null flag each, ids of each document,
bit offsets of the blocks, payload.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.bpe_ids import encoded
from cohortlens.llm.files import open_input, write_once
from cohortlens.session import shared_folder, staged

MAGIC = b"HUFIDS01"
LIMIT = 18
BLOCK = 1024
FRAME_IDS = 1 << 18
FILE_IDS = 1 << 23


def limited_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids that don't occur."""
    symbols = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(symbols) < 2:
        lengths[symbols] = 1
        return lengths
    if len(symbols) > 1 << limit:
        raise ValueError(f"{len(symbols)} ids don't fit codes of {limit} bits")
    symbols = symbols[np.argsort(counts[symbols], kind="stable")]
    leaves = counts[symbols].astype(np.int64)
    levels, weights = [], leaves
    for _ in range(limit - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(leaves))
        weights = both[order]
    # Walk back: of the first 2n-2 items of the last list, the leaves cost a bit, the packages double.
    take = 2 * len(symbols) - 2
    for is_leaf in reversed(levels):
        used = int(is_leaf[:take].sum())
        lengths[symbols[:used]] += 1
        take = 2 * (take - used)
    lengths[symbols[:take]] += 1
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        own = lengths[order].astype(np.int64)
        steps = (np.int64(1) << (LIMIT - own))[:-1]
        codes[order] = np.concatenate([[0], np.cumsum(steps)]) >> (LIMIT - own)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every run of ``LIMIT`` bits the id it begins with and that id's length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = np.int64(1) << (LIMIT - lengths[order].astype(np.int64))
    ids, bits = np.zeros(1 << LIMIT, np.uint32), np.ones(1 << LIMIT, np.uint8)
    total = int(spans.sum())
    ids[:total], bits[:total] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return ids, bits


def coded(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Payload of the ids and the bit offset of each block."""
    own = lengths[ids].astype(np.int64)
    starts = np.cumsum(own) - own
    total = int(own.sum())
    size = total // 8 + 5
    shifted = codes[ids].astype(np.int64) << (32 - own - (starts & 7))  # at most 18 + 7 bits
    payload = np.zeros(size, np.int64)
    for lane in range(4):
        part = (shifted >> (24 - 8 * lane)) & 0xFF
        payload += np.bincount((starts >> 3) + lane, weights=part, minlength=size).astype(np.int64)
    return payload.astype(np.uint8).tobytes(), starts[::BLOCK]


def decoded(payload: bytes, offsets: np.ndarray, count: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """All blocks of a frame at once, one id of each block at a time."""
    ids, bits = table
    data = np.frombuffer(payload, np.uint8).astype(np.uint32)
    words = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    at = offsets.astype(np.int64).copy()
    out = np.zeros((len(at), BLOCK), np.uint32)
    whole = len(at) if count % BLOCK == 0 else len(at) - 1
    for k in range(min(BLOCK, count)):
        live = len(at) if k < count - whole * BLOCK else whole
        here = at[:live]
        window = (words[here >> 3] >> (32 - LIMIT - (here & 7)).astype(np.uint32)) & np.uint32((1 << LIMIT) - 1)
        out[:live, k] = ids[window]
        at[:live] += bits[window]
    return out.reshape(-1)[:count]


def frame(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    payload, offsets = coded(ids, codes, lengths)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join(
        (
            struct.pack("<QQQ", len(doc_ids), len(ids), len(payload)), numbers.tobytes(), known.tobytes(),
            np.array(sizes, "<i8").tobytes(), offsets.astype("<i8").tobytes(), payload,
        )
    )


def frame_content(data: bytes, table: tuple[np.ndarray, np.ndarray]) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids of each document, all ids."""
    n, count, size = struct.unpack_from("<QQQ", data)
    at = 24
    numbers = np.frombuffer(data, "<i8", n, at)
    known = np.frombuffer(data, np.uint8, n, at + 8 * n)
    sizes = np.frombuffer(data, "<i8", n, at + 9 * n)
    blocks = -(-count // BLOCK)
    offsets = np.frombuffer(data, "<i8", blocks, at + 17 * n)
    first = at + 17 * n + 8 * blocks
    ids = decoded(data[first : first + size], offsets, count, table)
    return [int(d) if k else None for d, k in zip(numbers, known)], sizes, ids


def _write(folder: str, lengths: np.ndarray):
    codes = canonical_codes(lengths)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = {"part": None, "ids": 0}

        def content(stream) -> None:
            head = zlib.compress(lengths.tobytes())
            stream.write(MAGIC + struct.pack("<QQ", len(lengths), len(head)) + head)
            at, offsets = 24 + len(head), []
            doc_ids: list[int | None] = []
            sizes: list[int] = []
            parts: list[np.ndarray] = []
            waiting = 0

            def flush() -> int:
                data = frame(doc_ids, sizes, np.concatenate(parts), codes, lengths)
                stream.write(data)
                offsets.append(at)
                for held in (doc_ids, sizes, parts):
                    held.clear()
                return at + len(data)

            for batch in batches:
                for part, doc_id, ids in zip(batch["part"], batch["doc_id"], batch["ids"]):
                    made["part"] = part
                    doc_ids.append(None if doc_id is None else int(doc_id))
                    parts.append(np.frombuffer(ids, np.uint16))
                    sizes.append(len(parts[-1]))
                    made["ids"] += sizes[-1]
                    waiting += sizes[-1]
                    if waiting >= FRAME_IDS:
                        at, waiting = flush(), 0
            if doc_ids:
                at = flush()
            stream.write(np.array([*offsets, at], "<i8").tobytes() + struct.pack("<Q", len(offsets)) + MAGIC)

        address = write_once(folder, "ids.huf", content)
        if made["part"] is not None:
            yield pd.DataFrame({"part": [made["part"]], "address": [address], "n_ids": [made["ids"]]})

    return run


def _task_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's ids, one row an id."""
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for blob in batch.column("ids"):
            total += np.bincount(np.frombuffer(blob.as_py(), np.uint16), minlength=1 << 16)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"id": pa.array(found, pa.int64()), "n": pa.array(total[found], pa.int64())})


def global_counts(tokens: DataFrame) -> np.ndarray:
    """Counts of all ids. What comes to the driver is one row for each id of the vocabulary."""
    parts = tokens.select("ids").mapInArrow(_task_counts, "id long, n long")
    counts = np.zeros(1 << 16, np.int64)
    for row in parts.groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    return counts


def write_token_files(documents: DataFrame, folder: str, path: str | None = None) -> DataFrame:
    """Writes the files below ``folder``; returns part, address, n_ids, start of each.

    Parts are in ascending order of doc_id, nulls first, and so are the
    documents in a file; of rows with one doc_id the order is not defined.
    ``start`` counts the ids of all parts before.
    """
    place = shared_folder(documents.sparkSession, "encoded")
    encoded(documents, path).drop("row").write.option("compression", "zstd").parquet(place)
    tokens = documents.sparkSession.read.parquet(place)
    counts = global_counts(tokens)
    lengths = limited_lengths(counts)
    files = max(1, -(-int(counts.sum()) // FILE_IDS))
    dealt = tokens.repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    rows = dealt.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("string").alias("doc_id"), "ids")
    written = staged(rows.mapInPandas(_write(folder, lengths), "part int, address string, n_ids long"), "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    table, known = None, None
    for batch in batches:
        for address, start in zip(batch["address"], batch["start"]):
            with open_input(address) as source:
                size = source.size()
                head = source.read_at(24, 0)
                count, packed = struct.unpack("<QQ", head[8:])
                tail = source.read_at(16, size - 16)
                if head[:8] != MAGIC or tail[8:] != MAGIC:
                    raise ValueError(f"{address} is no token file")
                lengths = zlib.decompress(source.read_at(packed, 24))
                if lengths != known:
                    table, known = decoding_table(np.frombuffer(lengths, np.uint8, count)), lengths
                (frames,) = struct.unpack("<Q", tail[:8])
                offsets = np.frombuffer(source.read_at(8 * (frames + 1), size - 16 - 8 * (frames + 1)), "<i8").tolist()
                for first, stop in zip(offsets, offsets[1:]):
                    doc_ids, sizes, ids = frame_content(source.read_at(stop - first, first), table)
                    ends = np.cumsum(sizes)
                    yield pd.DataFrame(
                        {
                            "doc_id": pd.array([None if d is None else str(d) for d in doc_ids], dtype=object),
                            "start": start + ends - sizes,
                            "n_tokens": sizes,
                            "ids": [x.astype("<u4").tobytes() for x in np.split(ids, ends[:-1])],
                        }
                    )
                    start += int(ends[-1])


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian 32-bit) of every document, one task a few files."""
    spread = files.select("address", "start").repartition(max(1, files.count()), "address")
    rows = spread.mapInPandas(_read, "doc_id string, start long, n_tokens long, ids binary")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def token_files(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document, from files written and read again.

    A null text is empty and has the end id alone. Rows that repeat a doc_id
    follow each other. No documents give no rows. Other columns are ignored.
    """
    files = write_token_files(documents, shared_folder(documents.sparkSession, "ids"), path)
    return read_token_files(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
