"""Token ids of whole texts with a public tokenizer, each distinct word encoded once.

The tokenizer drops white space and never joins characters across it, so the
ids of a text are those of its words one after the other. A batch of texts is
split into words by Arrow, distinct words are cut into pieces by the split rule
of the tokenizer, distinct pieces are encoded by its model, and the ids are
gathered back. A worker keeps the pieces it has met. Words with other characters
than printable ASCII and the letters of Latin-1, and those that may hold a
special token, go through the whole ``encode`` of the tokenizer one by one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "word_bpe_49k.json"
END = 1

#: Characters that normalisation leaves alone but for lower case; the line feed stands between words.
_ODD = re.compile(r"[^\n!-~À-ÖØ-öø-ÿ]|<\|")
#: The split rule of the tokenizer for these, and the end of a word.
_PIECES = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\s]+")

#: Texts are encoded in runs of about so many bytes, pieces kept up to so many.
CHUNK_BYTES, KEPT_PIECES = 64 << 20, 600_000


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def _byte_characters() -> list[str]:
    """Byte-level alphabet: printable bytes stand for themselves, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    place = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return [place[b] for b in range(256)]


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The runs ``chosen`` of ``flat`` one after the other."""
    count = lengths[chosen]
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    shift = np.repeat(starts[chosen] - (ends - count), count)
    return flat[np.arange(total) + shift]


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Function from texts to (ids, ends): all ids as uint16, ``END`` after each
    text, and where each text ends. A null text counts as empty."""
    from tokenizers import Tokenizer, pre_tokenizers

    whole = Tokenizer.from_file(path)
    assert whole.get_vocab_size() <= 1 << 16
    last = np.zeros(1 << 16, bool)
    last[[i for token, i in whole.get_vocab().items() if token.endswith("</w>")]] = True
    plain = Tokenizer(whole.model)
    plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    letters = str.maketrans({chr(b): c for b, c in enumerate(_byte_characters())})
    known: dict[str, bytes] = {}

    def piece_ids(pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces; every piece ends with its only token of the word-end kind."""
        missing = [p for p in pieces if p not in known]
        for at in range(0, len(missing), 50_000):
            part = missing[at : at + 50_000]
            mapped = " ".join([p if p.isascii() else p.encode().decode("latin-1").translate(letters) for p in part])
            ids = np.array(plain.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, np.uint16)
            cuts = (2 * (np.flatnonzero(last[ids]) + 1)).tolist()
            assert len(cuts) == len(part)
            data = ids.tobytes()
            known.update(zip(part, map(data.__getitem__, map(slice, [0, *cuts[:-1]], cuts))))
        found = [known[p] for p in pieces]
        if len(known) > KEPT_PIECES:
            known.clear()
        return found

    def word_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after the other, and how many each has."""
        joined = "\n".join(words)
        odd: dict[int, bytes] = {}
        if _ODD.search(joined):
            words = list(words)
            for n, word in enumerate(words):
                if _ODD.search(word):
                    ids = whole.encode(word, add_special_tokens=False).ids
                    odd[n], words[n] = np.array(ids, np.uint16).tobytes(), ""
            joined = "\n".join(words)
        pieces = pa.array([*_PIECES.findall(joined.lower()), "\n"]).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        ends = distinct.index("\n")
        distinct[ends] = "."
        runs = piece_ids(distinct)
        runs[ends] = b""
        lengths = np.array([len(r) // 2 for r in runs], np.int64)
        flat = np.frombuffer(b"".join(runs), np.uint16)
        chosen = pieces.indices.to_numpy()
        ids = gathered(flat, np.cumsum(lengths) - lengths, lengths, chosen)
        total = np.cumsum(lengths[chosen])[chosen == ends]
        counts = np.diff(total, prepend=0)
        if odd:
            parts = np.split(ids, total[:-1])
            for n, run in odd.items():
                parts[n] = np.frombuffer(run, np.uint16)
            ids, counts = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return ids, counts

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        words = lists.flatten().dictionary_encode()
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        distinct = words.dictionary.to_pylist()
        flat, counts = word_ids([*distinct, ""])
        flat, counts[-1] = np.append(flat, np.uint16(END)), 1
        chosen = np.insert(words.indices.to_numpy().astype(np.int64), bounds[1:], len(distinct))
        ids = gathered(flat, np.cumsum(counts) - counts, counts, chosen)
        return ids, np.cumsum(counts[chosen])[bounds[1:] + np.arange(len(texts))]

    return encode


def runs_of(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """(first, count) of runs of texts of about ``limit`` bytes; a longer text is a run of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        before = sizes[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        yield first, stop - first
        first = stop


def with_ids(path: str, run_bytes: int = CHUNK_BYTES, forget: bool = False):
    """Arrow function: the column ``text`` gives way to n_tokens and ids (16-bit, ``END`` at the end).

    A worker needs some 20 bytes for each of the ``run_bytes`` it encodes at a
    time. With ``forget`` it drops the tokenizer and the pieces it has met at
    the end of a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            texts = batch.column("text")
            for first, count in runs_of(texts, run_bytes):
                ids, ends = encode(texts.slice(first, count))
                offsets = np.concatenate([[0], 2 * ends]).astype(np.int32)
                blobs = pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                kept = {n: batch.column(n).slice(first, count) for n in batch.schema.names if n != "text"}
                yield pa.RecordBatch.from_pydict(kept | {"n_tokens": pa.array(np.diff(ends, prepend=0)), "ids": blobs})
        if forget:
            encoder.cache_clear()
            pa.default_memory_pool().release_unused()

    return run


def encoded(documents: DataFrame, path: str | None = None, run_bytes: int = CHUNK_BYTES, forget: bool = False) -> DataFrame:
    """row, doc_id, n_tokens (end id included), ids as 16-bit numbers; ``row`` numbers the rows."""
    narrow = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return narrow.mapInArrow(with_ids(path or tokenizer_path(), run_bytes, forget), "row long, doc_id long, n_tokens long, ids binary")
