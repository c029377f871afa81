"""Words, word hashes and shingle sets inside a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

#: Odd multiplier of the rolling combination of word hashes.
STEP = np.uint64(0x9E3779B97F4A7C15)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words(text: str | None) -> list[bytes]:
    """Runs of characters other than blank and U+0009 to U+000D, A-Z lower-cased.

    ``bytes.split`` without an argument splits at exactly these six bytes.
    """
    return utf8(text).translate(LOWER).split()


class Memo(dict):
    """A function of one argument with its results kept, forgotten above ``limit``.

    The limit bounds the memory of a Python worker; results don't depend on it.
    """

    def __init__(self, function, limit: int = 500_000):
        super().__init__()
        self.function, self.limit = function, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.function(key)
        return value


WORD_HASH = Memo(xxhash.xxh64_intdigest, 100_000)


def forget() -> None:
    """At the end of a task kept hashes go, and Arrow's freed memory goes back to the system.

    The worker idles beside stages that run without Python, in the same executor.
    """
    WORD_HASH.clear()
    pa.default_memory_pool().release_unused()


def word_hashes(parts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORD_HASH.__getitem__, parts), np.uint64, len(parts))


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits spread over the whole word; one to one."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` consecutive words."""
    count = len(hashes) - size + 1
    if count < 1:
        return np.empty(0, np.uint64)
    total = hashes[:count].copy()
    for k in range(1, size):
        total = total * STEP + hashes[k : k + count]
    return mixed(total)


def shingle_set(parts: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, no words none."""
    if not parts:
        return np.empty(0, np.uint64)
    hashes = word_hashes(parts)
    return np.unique(window_hashes(hashes, min(size, len(parts))))
