from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cohortlens.llm import near_dedup
from cohortlens.llm.near_dedup import NearSettings, estimated, minima, near_duplicates, packed
from cohortlens.llm.words import shingle_set, words

LAYOUT = "doc_id long, text string, kept string, component string"


def brute(rows, size=2, percent=80):
    """doc_id -> (n_shingles, smallest reachable doc_id), by all pairs."""
    sets = []
    for _, text in rows:
        w = words(text)
        n = min(size, len(w)) or 1
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    owners = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            owners[g].append(i)
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        common = defaultdict(int)
        for g in s:
            for j in owners[g]:
                if j < i:
                    common[j] += 1
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                up[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(doc_id, least.get(top(i), doc_id))
    return [(doc_id, len(sets[i]), least.get(top(i))) for i, (doc_id, _) in enumerate(rows)]


def found(spark, rows, settings=None):
    frame = spark.createDataFrame([(d, t, "x", None) for d, t in rows], LAYOUT)
    return near_duplicates(frame, settings).collect()


def by_id(rows):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=repr)


@pytest.mark.parametrize("size", [2, 5])
def test_equal_to_all_pairs(spark, size):
    draw = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(12):
        base = list(draw.choice(vocabulary, 120))
        for _ in range(int(draw.integers(2, 90))):
            copy = list(base)
            for at in draw.integers(0, 120, int(draw.integers(0, 14))):
                copy[at] = str(draw.choice(vocabulary))
            rows.append((len(rows) * 7 % 1009, " ".join(copy)))
    got = found(spark, rows, NearSettings(shingle=size, block=16))
    assert by_id(got) == sorted(brute(rows, size), key=repr)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "ONE"), (6, "one two"), (None, "one two"), (7, "x " * 70_000 + "y"),
            (7, "x " * 70_000 + "y"), (8, "x y"), (9, "ÉA b"), (10, "éa b"), (None, "alone here"), (None, "alone here")]
    got = found(spark, rows)
    assert by_id(got) == sorted(brute(rows), key=repr)
    firsts = [r for r in got if r["first"]]
    assert len(firsts) == 10 and sum(r["kept"] for r in got) == 11
    assert found(spark, []) == []


def test_estimate_is_corrected_for_chance():
    settings = NearSettings()
    a, b = settings.multipliers()
    draw = np.random.default_rng(0)
    errors = []
    for share in (0.0, 0.5, 0.8):
        for _ in range(40):
            pool = draw.integers(0, 2**63, 1000, dtype=np.uint64) * np.uint64(2)
            k = int(1000 * share)
            half = (1000 - k) // 2
            x, y = np.unique(pool[: k + half]), np.unique(np.concatenate([pool[:k], pool[k + half :]]))
            truth = k / len(np.union1d(x, y))
            x, y = (np.frombuffer(packed(minima(s, a, b)), np.uint8) for s in (x, y))
            errors.append(estimated(x, y, settings.hashes) - truth)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07


def test_shingles_of_short_texts():
    assert len(shingle_set(words("a b"), 5)) == 1 and len(shingle_set(words(" "), 5)) == 0
    assert len(shingle_set(words("a b a b a"), 2)) == 2


def test_documents_are_signed_in_slices():
    texts = [f"one two three four five six {k}" for k in range(1_200)] + [None, " "]
    batch = pa.RecordBatch.from_pydict({"row": list(range(1_202)), "doc_id": [str(k) for k in range(1_202)], "text": texts})
    made = list(near_dedup._signatures(near_dedup.NearSettings())(iter([batch])))
    assert max(part.num_rows for part in made) <= near_dedup.SLICE_ROWS and not near_dedup.WORD_HASH
    rows = pa.Table.from_batches(made).to_pylist()
    assert [r["row"] for r in rows] == list(range(1_202)) and len({r["digest"] for r in rows}) == 1_201
    assert [r["n_shingles"] for r in rows] == [6] * 1_200 + [0, 0]


def test_a_worker_gives_its_memory_back():
    import pyarrow as pa

    from cohortlens.llm import line_quality, words

    assert words.WORD_HASH.limit <= 100_000
    words.word_hashes([str(k).encode() for k in range(words.WORD_HASH.limit + 5)])
    assert 0 < len(words.WORD_HASH) <= words.WORD_HASH.limit
    called = []
    whole = pa.default_memory_pool
    try:
        pa.default_memory_pool = lambda: called.append(1) or whole()
        assert list(line_quality._measures(iter([]))) == []
        assert list(near_dedup._signatures(near_dedup.NearSettings())(iter([]))) == []
    finally:
        pa.default_memory_pool = whole
    assert len(called) == 2 and not words.WORD_HASH
