"""Token counts under a unigram model, by dynamic programming over a trie.

The distinct pre-tokens of a batch, sorted, are the trie in depth-first order:
what a word has in common with the one before it is the path they share. The
best score and the number of tokens up to each place are kept for the current
path, so they are worked out once for every shared prefix, and what stands at
the end of a word is stored as its count. Texts then add up the counts of their
words.

Pieces are those of a public vocabulary, which gives them in order of rank but
without probabilities; a piece of rank r scores -ln(r + 2).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.bpe_ids import runs_of

VOCABULARY = "piece_bpe_32k.model"
START = "▁"

#: What a character that is no piece scores below the worst piece.
UNKNOWN = 10.0


def vocabulary_path() -> str:
    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=2)
def piece_scores(path: str) -> dict[str, float]:
    """Scores of the ordinary pieces, best rank first; control and byte pieces are left out."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ordinary = [
        i for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    return {model.id_to_piece(i): -math.log(rank + 2) for rank, i in enumerate(ordinary)}


def trie_counts(words: list[str], scores: dict[str, float]) -> list[int]:
    """Tokens of each of the sorted distinct words: of the segmentations with the
    highest score the one with the fewest tokens."""
    longest = max(map(len, scores), default=1)
    worst = min(scores.values(), default=0.0) - UNKNOWN
    best, count = [0.0], [0]
    counts, before = [], ""
    for word in words:
        path = START + word
        shared = len(commonprefix((path, before)))
        del best[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(path) + 1):
            top, fewest = best[end - 1] + worst, count[end - 1] + 1
            for start in range(max(0, end - longest), end):
                score = scores.get(path[start:end])
                if score is not None:
                    total, tokens = best[start] + score, count[start] + 1
                    if total > top or (total == top and tokens < fewest):
                        top, fewest = total, tokens
            best.append(top)
            count.append(fewest)
        counts.append(count[-1])
        before = path
    return counts


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = piece_scores(path)
        for batch in batches:
            texts = batch.column("text")
            for first, size in runs_of(texts):
                lists = pc.ascii_split_whitespace(pc.fill_null(texts.slice(first, size).cast(pa.large_string()), ""))
                words = lists.flatten().dictionary_encode()
                order = pc.array_sort_indices(words.dictionary).to_numpy()
                counts = np.zeros(len(order) + 1, np.int64)
                counts[order] = trie_counts(words.dictionary.take(pa.array(order)).to_pylist(), scores)
                present = np.ones(len(order) + 1, np.int64)
                empty = np.flatnonzero(np.array(pc.binary_length(words.dictionary)) == 0)
                counts[empty], present[empty] = 0, 0
                chosen = words.indices.to_numpy()
                bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                totals = [np.concatenate([[0], np.cumsum(x[chosen])])[bounds] for x in (present, counts)]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column("doc_id").slice(first, size), "n_pretokens": pa.array(np.diff(totals[0])), "n_tokens": pa.array(np.diff(totals[1]))}
                )

    return run


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every document.

    Pre-tokens are runs of characters other than blank and U+0009 to U+000D,
    with a start mark in front. Null and empty texts have none. Repeated rows
    and null ids stay rows of their own; other columns are ignored. Nothing is
    shuffled; memory is bounded by the words of a run of texts.
    """
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_counted(path or vocabulary_path()), "doc_id long, n_pretokens long, n_tokens long")
