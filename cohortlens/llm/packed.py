"""Arrays packed for shuffles, messages by lane, and named files of packed parts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import zstandard

from cohortlens.llm.files import open_input, opened


def squeezed(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, deflated."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def loosened(blob: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(data.reshape(width, -1).T).reshape(-1).view(kind)


def sorted_blob(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys by their differences."""
    return squeezed(np.diff(keys, prepend=np.uint64(0)))


def from_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(loosened(blob, np.uint64), dtype=np.uint64)


def merged(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Distinct keys of messages, the place of each message's keys in them, and the messages' ends."""
    parts = [from_sorted(b) for b in blobs]
    keys, place = np.unique(np.concatenate(parts), return_inverse=True)
    return keys, place, np.cumsum([len(p) for p in parts])[:-1].tolist()


def by_lane(keys: np.ndarray, lanes: int) -> Iterator[tuple[int, slice]]:
    """(lane, places) of ascending hashes; a lane is a range, and their number a power of two."""
    shift = np.uint64(64 - (lanes.bit_length() - 1))
    edges = np.searchsorted(keys, np.arange(1, lanes, dtype=np.uint64) << shift) if lanes > 1 else np.zeros(0, np.int64)
    bounds = [0, *edges.tolist(), len(keys)]
    return ((lane, slice(a, b)) for lane, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b)


def save_parts(folder: str, name: str, **parts: bytes) -> None:
    """One file of named parts.

    The content must follow from the name, so that a repeated attempt puts the
    same in the same place; the file appears whole.
    """
    system, path = opened(f"{folder}/{name}")
    system.create_dir(opened(folder)[1], recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(attempt, compression=None) as stream:
        head = json.dumps({k: len(v) for k, v in parts.items()}).encode()
        stream.write(len(head).to_bytes(8, "little") + head)
        for part in parts.values():
            stream.write(part)
    system.move(attempt, path)


def load_parts(folder: str, name: str) -> dict[str, bytes]:
    with open_input(f"{folder}/{name}") as source:
        data = source.read()
    at = 8 + int.from_bytes(data[:8], "little")
    parts = {}
    for key, size in json.loads(data[8:at]).items():
        parts[key] = data[at : at + size]
        at += size
    return parts
