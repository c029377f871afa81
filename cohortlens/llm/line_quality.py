"""Quality rules: per-document base rules and line frequency across documents.

A line that stands in many documents of one host is boilerplate. Lines are
normalised and hashed where the text is read; per host and line the distinct
documents are counted, reduced before each shuffle, so neither a hot host nor a
hot line is gathered. Lines above the limit are taken out, and a document of
which too little is left is rejected.

Copies of one document must not make its own lines look like boilerplate, nor
hide it: they are for near-duplicate removal, which keeps one of them. So the
count takes two passes. The first finds the lines that stand in enough
different texts. In the second a document counts by what is its own, the set of
its lines that are neither such a line nor a small edit of one. Copies agree in
it, edited copies mostly; different documents differ, however much boilerplate
stands around them and whatever other lines they share. A document without
lines of its own counts by the smallest shingle of its other frequent lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cohortlens.llm.words import LOWER, forget, utf8, window_hashes, word_hashes
from cohortlens.session import numbered, staged, staging, text_batches

SYMBOLS = b"#*$%&|<>"
WINDOW = 5

#: Rows measured or rewritten at a time.
SLICE_ROWS = 500

#: Smallest three-word shingles kept of a line, to know small edits of it.
SKETCH = 8


@dataclass(frozen=True)
class LineSettings:
    """A line is removed from a host's documents when more than ``max_documents``
    different documents of the host hold it. A document is rejected when
    fewer than ``min_words`` words or ``min_left`` percent of its words are left.
    """

    max_documents: int = 10
    min_words: int = 10
    min_left: int = 30


def repeated_words(hashes: np.ndarray) -> int:
    """Words that lie in a 5-word window found twice or more in the text."""
    windows = window_hashes(hashes, WINDOW)
    if len(windows) < 2:
        return 0
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    edge = np.zeros(len(hashes) + 1, np.int64)
    starts = np.flatnonzero(counts[inverse] > 1)
    edge[starts] += 1
    edge[starts + WINDOW] -= 1
    return int((np.cumsum(edge)[:-1] > 0).sum())


def normal_line(line: bytes) -> bytes:
    """A-Z in lower case, runs of white space as one blank, none at the ends."""
    return b" ".join(line.translate(LOWER).split())


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _measures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts and lines of the rows, ``SLICE_ROWS`` at a time: the lines of a whole batch are many times its size."""
    for whole_batch in batches:
        for at in range(0, len(whole_batch), SLICE_ROWS):
            yield _measured_slice(whole_batch.iloc[at : at + SLICE_ROWS])
    forget()


def _measured_slice(batch: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for text, host in zip(batch["text"], batch["host"]):
        data = utf8(text)
        raw = data.split()
        joined = b"".join(raw)
        chars = len(joined) - int((np.frombuffer(joined, np.uint8) & 0xC0 == 0x80).sum())
        symbols = len(data) - len(data.translate(None, SYMBOLS))
        seen: set[bytes] = set()
        repeated = 0
        lines: dict[int, dict] = {}
        salt = xxhash.xxh64_intdigest(b"" if host is None else b"h" + host.encode("utf-8", "surrogatepass"))
        for line in data.split(b"\n"):
            parts = line.split()
            if not parts:
                continue
            repeated += line in seen
            seen.add(line)
            low = normal_line(line)
            key = _signed(xxhash.xxh64_intdigest(low, seed=salt))
            if key in lines:
                lines[key]["words"] += len(parts)
                continue
            hashes = word_hashes(low.split())
            least = int(window_hashes(hashes, min(WINDOW, len(hashes))).min())
            sketch = np.unique(window_hashes(hashes, min(3, len(hashes))))[:SKETCH] ^ np.uint64(salt)
            lines[key] = {"line": key, "words": len(parts), "least": _signed(least), "sketch": sketch.view(np.int64)}
        packed = list(lines.values())
        whole = _signed(xxhash.xxh64_intdigest(np.sort(np.fromiter(lines, np.int64, len(lines))).tobytes()))
        rows.append((len(raw), chars, symbols, repeated, repeated_words(word_hashes(raw)), whole, packed))
    out = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "whole", "lines"])
    for at, name in enumerate(("row", "doc_id")):
        out.insert(at, name, batch[name].to_numpy())
    return out


def measured(rows: DataFrame) -> DataFrame:
    """Staged per row (row, doc_id, text, host): its counts, and its lines with their keys."""
    layout = (
        "row long, doc_id string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "whole long, lines array<struct<line: long, words: int, least: long, sketch: array<long>>>"
    )
    strings = rows.select("row", *[F.col(c).cast("string").alias(c) for c in ("doc_id", "text", "host")])
    with text_batches(rows.sparkSession):
        return staged(strings.mapInPandas(_measures, layout).withColumn("doc_id", F.col("doc_id").cast("long")), "line-measures")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def frequent_lines(measures: DataFrame, settings: LineSettings) -> DataFrame:
    """Keys of the lines above the limit, with the different documents that hold them.

    A key holds the host as well, so it stands for a line of one host; so does
    a shingle of a sketch.
    """
    lines = measures.select("row", "whole", F.explode("lines").alias("l")).select("row", "whole", "l.*")
    often = lines.select("line", "whole").distinct().groupBy("line").agg(F.count("*").alias("texts"))
    common = staged(often.filter(F.col("texts") > settings.max_documents).select("line"), "common-lines")
    known = common.select("line", F.lit(True).alias("common"))
    held = lines.select("row", "line").join(common, "line", "left_semi").select("row").distinct()
    marked = staged(lines.join(held, "row", "left_semi").join(known, "line", "left").drop("whole"), "marked-lines")
    # a line of which half the sketch stands in common lines is an edit of them
    parts = marked.filter("common").select(F.explode("sketch").alias("part")).distinct()
    others = marked.filter("common IS NULL").select("row", "line", F.explode("sketch").alias("part"))
    edits = others.join(parts, "part").groupBy("row", "line").agg(F.count("*").alias("n_parts"))
    own = (
        marked.filter("common IS NULL").join(edits, ["row", "line"], "left")
        .filter(2 * F.coalesce("n_parts", F.lit(0)) < F.size("sketch"))
        .groupBy("row").agg(F.bit_xor("line").alias("own"))
    )
    # the two smallest, so that each line finds the smallest of the others
    pair = marked.filter("common").groupBy("row").agg(F.min(F.struct("least", "line")).alias("one"))
    least = marked.filter("common").join(pair, "row").filter(F.col("line") != F.col("one.line")).groupBy("row").agg(F.min("least").alias("two"))
    documents = pair.select("row", "one").join(least, "row", "left").join(own, "row", "left")
    rest = F.when(F.col("own").isNotNull(), F.struct(F.lit(1).alias("kind"), F.col("own").alias("by"))).otherwise(
        F.struct(F.lit(0).alias("kind"), F.when(F.col("line") == F.col("one.line"), F.col("two")).otherwise(F.col("one.least")).alias("by"))
    )
    counted = marked.filter("common").select("row", "line").join(documents, "row").select("line", rest.alias("rest"))
    counts = counted.distinct().groupBy("line").agg(F.count("*").alias("documents"))
    return counts.filter(F.col("documents") > settings.max_documents)


def judged(measures: DataFrame, settings: LineSettings) -> DataFrame:
    """One row per row of ``measures``: its counts, ``removed`` (keys of the lines
    taken out), ``words_left``, base_failed, kept."""
    frequent = staged(frequent_lines(measures, settings), "frequent-lines").select("line")
    lines = measures.select("row", F.explode("lines").alias("l")).select("row", "l.line", "l.words")
    removed = (
        lines.join(frequent, "line").groupBy("row").agg(F.sum("words").alias("gone"), F.collect_list("line").alias("removed"))
    )
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    depleted = (left < settings.min_words) | (100 * left < settings.min_left * F.col("n_words"))
    return (
        measures.drop("lines", "whole")
        .join(removed, "row", "left")
        .withColumn("words_left", left)
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & ~depleted)
        .drop("gone")
    )


def line_quality(documents: DataFrame, settings: LineSettings | None = None, host: str = "source") -> DataFrame:
    """One row per document with its counts and verdict (see ``judged``).

    A null text counts as one without words and fails the base rules. Null
    hosts are a host of their own. Rows that repeat a document are judged one
    by one and count once for each of their lines, since they agree in all
    others. Texts of one line alone count as one document for it. Empty tables
    give no rows; other columns are ignored.
    """
    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.col(host).alias("host"))
    return judged(measured(rows), settings or LineSettings())


def _without(schema: pa.Schema):
    """Arrow function: rows ``d`` without the lines in ``removed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                yield rewritten(whole.slice(at, SLICE_ROWS))

    def rewritten(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.column("d")
        columns = dict(zip((f.name for f in rows.type), rows.flatten()))
        touched = batch.column("removed").is_valid()
        held = pa.table({"text": columns["text"], "host": batch.column("host"), "removed": batch.column("removed")}).filter(touched)
        if held.num_rows:
            texts = []
            for text, host, removed in zip(*(held.column(c).to_pylist() for c in ("text", "host", "removed"))):
                salt, gone = xxhash.xxh64_intdigest(b"" if host is None else b"h" + host.encode("utf-8", "surrogatepass")), set(removed)
                kept = [
                    line
                    for line in utf8(text).split(b"\n")
                    if not (low := normal_line(line)) or _signed(xxhash.xxh64_intdigest(low, seed=salt)) not in gone
                ]
                texts.append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
            columns["text"] = pc.replace_with_mask(columns["text"], touched, pa.array(texts, columns["text"].type))
            if "n_chars" in columns:
                columns["n_chars"] = pc.replace_with_mask(columns["n_chars"], touched, pa.array(map(len, texts), columns["n_chars"].type))
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)

    return run


#: Verdicts that change a document are broadcast up to so many rows and so many lines, and shuffled beyond.
BROADCAST_ROWS, BROADCAST_LINES = 500_000, 2_000_000


def cleaned(documents: DataFrame, settings: LineSettings | None = None, host: str = "source") -> DataFrame:
    """The documents that are kept, boilerplate lines taken out of their texts.

    All columns stay as they are but for ``text``, and ``n_chars`` where a text
    changed. Same rules as ``line_quality``. Only the rows that go or change are
    listed, and the texts are read with that list beside them.
    """
    rows = numbered(documents)
    owner = F.col(f"d.`{host}`").cast("string").alias("host")
    with staging(documents.sparkSession):
        verdict = judged(measured(rows.select("row", "d.doc_id", "d.text", owner)), settings or LineSettings())
        listed = staged(verdict.filter("NOT kept OR removed IS NOT NULL").select("row", "kept", "removed"), "line-verdicts", outlast=True)
    size = listed.agg(F.count("*").alias("rows"), F.sum(F.size("removed")).alias("lines")).first()
    if size["rows"] <= BROADCAST_ROWS and (size["lines"] or 0) <= BROADCAST_LINES:
        listed = F.broadcast(listed)
    left = rows.join(listed, "row", "left").filter("kept IS NULL OR kept").select("d", owner, "removed")
    return left.mapInArrow(_without(to_arrow_schema(documents.schema)), documents.schema)
