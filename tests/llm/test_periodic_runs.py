"""Runs against all periods tried at every place."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from cohortlens.llm import periodic_runs

SMALL = "/root/testdata/sf0.001"
LAYOUT = "doc_id long, text string, start string, period int"


def brute(symbols):
    """Every maximal stretch of at least four smallest periods: (first, length, period)."""
    found, n = {}, len(symbols)
    symbols = np.asarray(symbols)
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[False], symbols[:-q] == symbols[q:], [False]])
        for a, b in np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2).tolist():
            if b - a + q >= 4 * q:
                found.setdefault((a, b - a + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    names = {w: k for k, w in enumerate(dict.fromkeys(words))}
    runs = [r for r in brute([names[w] for w in words]) if r[1] >= 6] if n else []
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (
        doc_id, len(runs), *best, runs and 1000 * best[1] // best[2] or None,
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(),
    )


def key(row):
    return str(tuple(row))


def thue_morse(n):
    return [bin(i).count("1") & 1 for i in range(n)]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("seed", range(40))
def test_repetitions_of_small_alphabets(seed):
    draw = np.random.default_rng(seed)
    parts = []
    for _ in range(int(draw.integers(1, 12))):
        root = draw.integers(0, int(draw.integers(1, 4)), int(draw.integers(1, 40)))
        parts.append(np.resize(root, int(len(root) * draw.uniform(0.5, 9))))
        if draw.random() < 0.3:  # a periodic root of a periodic stretch
            inner = np.concatenate([np.resize(root, 5 * len(root)), draw.integers(0, 3, 2)])
            parts.append(np.resize(inner, int(4.3 * len(inner))))
    symbols = np.concatenate(parts)
    assert [tuple(r) for r in periodic_runs.repetitions(symbols).tolist()] == brute(symbols)


@pytest.mark.parametrize("symbols", [[0], [0] * 3, [0] * 4, [0] * 5000, thue_morse(3000), fibonacci(3000), [0, 1] * 700 + [0, 0, 1] * 300, list(range(500)) * 5])
def test_repetitions_of_known_words(symbols):
    assert [tuple(r) for r in periodic_runs.repetitions(np.array(symbols)).tolist()] == brute(symbols)


def test_documents(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = sorted((expected(r["doc_id"], r["text"]) for r in documents.collect()), key=key)
    assert sorted(map(tuple, periodic_runs.periodic_runs(documents).collect()), key=key) == want


def test_odd_documents(spark):
    odd = [None, "", " \t\n", "One", "a a a a a", "a a a a a a", "a b " * 40 + "c", "é É\x0bé É\x0cé É é É é É", "x " * 30_000,
           " ".join(f"w{i % 700}" for i in range(9_000)), "same same same same same same same", "A a " * 12]
    rows = [(None if i in (4, 5) else i, t, "clash", 1) for i, t in enumerate(odd)] + [(10, odd[10], "clash", 2)] * 2
    tenth = [i for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows += [(i, " ".join(f"w{k}" for k in range(n)), "s", 0) for n, i in enumerate(tenth)]
    frame = spark.createDataFrame(rows, LAYOUT)
    assert sorted(map(tuple, periodic_runs.periodic_runs(frame).collect()), key=key) == sorted((expected(r[0], r[1]) for r in rows), key=key)
    assert periodic_runs.periodic_runs(spark.createDataFrame([], LAYOUT)).collect() == []
