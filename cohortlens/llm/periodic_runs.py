"""Periodic runs of words by string synchronising sets.

Windows of 1, 2, 4, ... words get exact names by doubling, for as long as a text
repeats any. At the scale of t words a place is synchronising if the window
there, or the one t words on, has the smallest hash of the t + 1 windows between
them. That depends on the next 2t words alone, so a stretch of period q, t <= q
< 2t, that holds four periods has synchronising places q apart with equal
contexts of 2t words, and none nearer to each other. Neighbouring places with
equal contexts therefore propose all periods of the scale; how far a period
holds is read off the names.

Windows of a period of at most t / 4 are left out of the minima, as they would
crowd the set. They lie in runs of small periods, which are found apart: those
of up to three words by comparing the text with itself, the others at the
scales below.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.bpe_ids import runs_of
from cohortlens.llm.words import mixed, utf8

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Periods below the first scale.
FIRST_SCALE = 4
#: Texts are handled together in runs of about so many bytes.
RUN_BYTES = 4 << 20

_FAR = np.uint64(2**64 - 1)


def _named(keys: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Names of the keys that occur more than once, by place; -1 elsewhere."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    names = np.full(size, -1, np.int64)
    names[places[again]] = inverse[again]
    return names


def _levels(symbols: np.ndarray) -> list[np.ndarray]:
    """Names of repeated windows of 1, 2, 4, ... symbols."""
    size = len(symbols)
    names = [_named(symbols, np.arange(size), size)]
    while True:
        last, step = names[-1], 1 << (len(names) - 1)
        if size <= step:
            return names
        places = np.flatnonzero((last[:-step] >= 0) & (last[step:] >= 0))
        keys = last[places] * (last.max() + 1) + last[places + step]
        longer = _named(keys, places, size)
        if (longer < 0).all():
            return names
        names.append(longer)


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values; beyond the end they count as large."""
    size = len(values)
    blocks = -(-(size + width) // width)
    padded = np.full(blocks * width, _FAR)
    padded[:size] = values
    table = padded.reshape(blocks, width)
    upto = np.minimum.accumulate(table, axis=1).reshape(-1)
    since = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(since[:size], upto[width - 1 : width - 1 + size])


def _stretch(names: list[np.ndarray], places: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of the stretch around each place in which its period holds."""
    size = len(names[0])
    right, left = places.copy(), places.copy()
    for level in reversed(range(len(names))):
        step = 1 << level
        known = names[level]
        there = np.minimum(right + period, size - 1)
        same = (right + period < size) & (known[np.minimum(right, size - 1)] >= 0) & (known[np.minimum(right, size - 1)] == known[there])
        right = right + np.where(same, step, 0)
        here = np.maximum(left - step, 0)
        same = (left >= step) & (known[here] >= 0) & (known[here] == known[np.minimum(here + period, size - 1)])
        left = left - np.where(same, step, 0)
    return left, right - left + period


def _small_periods(symbols: np.ndarray) -> Iterator[np.ndarray]:
    """(first, length, period) of stretches of four periods and more of up to three symbols."""
    for period in range(1, FIRST_SCALE):
        same = np.concatenate([[False], symbols[:-period] == symbols[period:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        length = edges[:, 1] - edges[:, 0] + period
        found = length >= LEAST_PERIODS * period
        yield np.column_stack([edges[found, 0], length[found], np.full(found.sum(), period)])


def _periodic_windows(runs: np.ndarray, scale: int, size: int) -> np.ndarray:
    """Places whose window of ``scale`` symbols lies in a run of at most a quarter of it a period."""
    inside = runs[(runs[:, 2] * 4 <= scale) & (runs[:, 1] >= scale)]
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, inside[:, 0], 1)
    np.add.at(edge, inside[:, 0] + inside[:, 1] - scale + 1, -1)
    return np.cumsum(edge)[:size] > 0


def _distinct(runs: np.ndarray) -> np.ndarray:
    """Of the same stretch with several periods only that with the smallest, which divides them."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[first]


def repetitions(symbols: np.ndarray) -> np.ndarray:
    """Rows (first, length, period) of the maximal stretches that hold four or more
    of their smallest period, by first and period."""
    size = len(symbols)
    runs = _distinct(np.concatenate([np.zeros((0, 3), np.int64), *_small_periods(symbols)]))
    names = _levels(symbols)
    for level in range(FIRST_SCALE.bit_length() - 1, len(names) - 1):
        scale, context = 1 << level, names[level + 1]
        # only places whose context occurs again matter, and all their windows have names
        places = np.flatnonzero(context >= 0)
        hashes = mixed(names[level].astype(np.uint64)) >> np.uint64(1)
        hashes[(names[level] < 0) | _periodic_windows(runs, scale, size)] = _FAR
        least = _least_of(hashes, scale + 1)[places]
        chosen = places[(least != _FAR) & ((hashes[places] == least) | (hashes[places + scale] == least))]
        order = np.argsort(context[chosen], kind="stable")
        chosen = chosen[order]
        period = np.diff(chosen)
        near = (context[chosen[1:]] == context[chosen[:-1]]) & (period >= scale) & (period < 2 * scale)
        place, period = chosen[:-1][near], period[near]
        if not len(place):
            continue
        first, length = _stretch(names, place, period)
        found = length >= LEAST_PERIODS * period
        runs = _distinct(np.concatenate([runs, np.column_stack([first, length, period])[found]]))
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def continued(doc_id: int | None, size: int) -> np.ndarray:
    """Which original word stands at each place: for a tenth of the ids a tail repeats itself."""
    places = np.arange(size)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not size:
        return places
    g = h // 10
    a = g % size
    p = 1 + (size - a) // (3 + g % 8)
    places[a:] = a + np.arange(size - a) % p
    return places


def _found(texts: pa.Array, ids: list[int | None]) -> Iterator[tuple]:
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words = lists.flatten().dictionary_encode()
    index = words.indices.to_numpy().astype(np.int64)
    real = (np.array(pc.binary_length(words.dictionary), np.int64) > 0)[index] if len(index) else np.zeros(0, bool)
    bounds = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    ends = np.concatenate([[0], np.cumsum(real)])[bounds]
    index = index[real]
    sizes = np.diff(ends)
    shown = np.concatenate([np.zeros(0, np.int64), *[first + continued(i, n) for i, n, first in zip(ids, sizes.tolist(), ends)]])
    # a word of one text never equals one of another
    owner = np.repeat(np.arange(len(ids)), sizes)
    runs = repetitions(owner * (len(words.dictionary) + 1) + index[shown]) if len(shown) else np.zeros((0, 3), np.int64)
    dropped = np.zeros(len(shown) + 1, np.int64)
    runs = runs[runs[:, 1] >= LEAST_WORDS]
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(dropped)[:-1] == 0
    cuts = np.searchsorted(runs[:, 0], ends)
    for k, (doc_id, text) in enumerate(zip(ids, texts.to_pylist())):
        first, own = ends[k], runs[cuts[k] : cuts[k + 1]]
        here = slice(first, ends[k + 1])
        said = utf8(text).split()
        order = (shown[here] - first)[kept[here]]
        if len(order) != len(said) or (order != np.arange(len(said))).any():
            said = [said[i] for i in order.tolist()]
        rows = [(int(s - first), int(n), int(q)) for s, n, q in own]
        best = max(rows, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in rows)
        yield (
            doc_id, len(rows), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(said)).hexdigest(),
        )


RESULT = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RESULT.split(", ")]
    kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
    for batch in batches:
        texts, ids = batch.column("text"), batch.column("doc_id").to_pylist()
        for first, count in runs_of(texts, RUN_BYTES):
            columns = zip(*_found(texts.slice(first, count), ids[first : first + count]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def periodic_runs(documents: DataFrame) -> DataFrame:
    """One row per document: how many runs it has, the longest, and digests of all
    runs and of the text with every run cut down to its first period.

    Words are ``[^\\x20\\x09-\\x0D]+``; for a tenth of the ids (by crc32) a tail of the
    text is first replaced by a repetition of its beginning. Null and empty
    texts have no words and no runs; a text with a null id is taken as it is.
    Repeated rows are documents of their own; empty tables give no rows; other
    columns are ignored. Nothing is shuffled; memory is bounded by a few
    megabytes of text, or one longer text.
    """
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_scan, RESULT)
