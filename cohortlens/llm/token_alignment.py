"""Alignment of two tokenizers by byte offsets, in Arrow tables.

Both tokenizers begin anew where a blank, a line feed or a tab follows a plain
character. Texts are cut there into units, and each distinct unit of a chunk is
encoded and aligned once: token lists are flattened with the index of their
unit, their byte lengths summed up within it, and a hash join on the ends finds
the places where both tokenizers end. These cut a unit into groups; a join on
the group gives the links. Grouped counts of a chunk's documents go to lanes by
first id, where Spark brings them together, and come back in the order they
were sent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.bpe_ids import _byte_characters, runs_of
from cohortlens.llm.packed import from_sorted, load_parts, loosened, merged, save_parts, sorted_blob, squeezed
from cohortlens.session import shared_folder, staged

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"

#: Texts of a chunk, and of what is cut at a time; text given to a tokenizer in one piece.
CHUNK_BYTES, RUN_BYTES, PIECE_BYTES, PIECES = 12 << 20, 2 << 20, 1 << 13, 64
#: Units aligned at a time, rows of (document, pair) counted at a time.
UNITS, PAIR_ROWS = 1 << 16, 500_000
#: Text that a lane's pairs come from, and the most lanes there are.
LANE_BYTES, MOST_LANES = 24 << 20, 1 << 14

#: A pair as one number: first id, then second.
ID_BITS = 20
SHIFT = np.uint64(ID_BITS)


def tokenizer_paths() -> tuple[str, str]:
    return public_tokenizers.path(FIRST), public_tokenizers.path(SECOND)


class _Tokenizers:
    """Both tokenizers: ids of texts, and the bytes of each id."""

    def __init__(self, first: str, second: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True
        byte = {c: b for b, c in enumerate(_byte_characters())}
        vocabulary = sorted((i, t) for t, i in self.first.get_vocab().items())
        plain = [t if any(c not in byte for c in t) else None for _, t in vocabulary]
        self.first_bytes = [t.encode() if p else bytes(byte[c] for c in t) for (_, t), p in zip(vocabulary, plain)]
        self.second = SentencePieceProcessor(model_file=second)
        names = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.second_bytes = [
            bytes([int(n[3:5], 16)]) if self.second.is_byte(i) else b"" if self.second.is_control(i) else n.replace("▁", " ").encode()
            for i, n in enumerate(names)
        ]
        # units may be cut before a blank, line feed or tab, as no piece holds one of them behind another character
        cut = [n for i, n in enumerate(names) if not self.second.is_byte(i) and ("▁" in n.lstrip("▁") or "\n" in n or "\t" in n)]
        if cut or max(len(vocabulary), len(names)) > 1 << ID_BITS:
            raise ValueError("these tokenizers do not begin anew at blanks")

    def first_ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in self.first.encode_batch_fast(texts, add_special_tokens=False)]

    def second_ids(self, texts: list[str]) -> list[np.ndarray]:
        # a line feed in front takes the blank that this tokenizer adds
        return [np.array(ids[2:], np.int64) for ids in self.second.encode(["\n" + t for t in texts], num_threads=1)]


@lru_cache(maxsize=1)
def _tokenizers(first: str, second: str) -> _Tokenizers:
    return _Tokenizers(first, second)


def _solid(last: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """Whether a character, by its last three bytes, is none of white space or control.

    Characters beyond ASCII that share their first bytes with white space are passed over.
    """
    odd = (second == 0xC2) | ((third == 0xE1) & (second == 0x9A)) | ((third == 0xE2) & (second >= 0x80) & (second <= 0x81)) | ((third == 0xE3) & (second == 0x80))
    return ((last > 32) & (last < 127)) | ((last >= 128) & ~odd)


def _cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where units begin in the bytes of texts: at each text, and at a blank, line
    feed or tab behind a character that is no white space."""
    white = np.flatnonzero((data == 32) | (data == 10) | (data == 9))
    inside = white[white > 2]  # every text begins with a blank, so the first bytes hold no other cut
    mark = np.zeros(len(data) + 1, bool)
    mark[inside[_solid(data[inside - 1], data[inside - 2], data[inside - 3])]] = True
    near = white[(white > 0) & (white <= 2)]
    mark[near[(data[near - 1] > 32) & (data[near - 1] < 127)]] = True
    mark[starts] = True
    return np.flatnonzero(mark[:-1])


def _units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Units of texts, each with a blank in front, one after the other; units of each text. A null or empty text has none."""
    empty = np.array(pc.fill_null(pc.binary_length(texts), 0)) == 0
    spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pc.fill_null(texts.cast(pa.large_string()), ""), pa.scalar(" ", pa.large_string()))
    spaced = pc.if_else(pa.array(empty), pa.scalar("", pa.large_string()), spaced)
    offsets = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
    buffer = spaced.buffers()[2]
    if offsets[-1] == offsets[0]:
        return pa.array([], pa.large_binary()), np.zeros(len(texts), np.int64)
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]]
    begin = offsets[:-1] - offsets[0]
    cuts = _cuts(data, begin[~empty])
    places = np.append(cuts, len(data)).astype(np.int64)
    units = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(places), pa.py_buffer(data)])
    counts = np.diff(np.searchsorted(cuts, np.append(begin, len(data))))
    return units, np.where(empty, 0, counts)


def _joined(ends: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """Bounds of runs of units to give to a tokenizer as one text: some ``PIECE_BYTES``
    each, and no unit after one that doesn't end in a plain character, as only
    behind such a one the next unit begins anew. ``ends`` are the units' last bytes."""
    piece = ends // PIECE_BYTES
    last = ~plain
    last[:-1] |= piece[1:] != piece[:-1]
    last[-1:] = True
    return np.concatenate([[0], np.flatnonzero(last) + 1])


def _encoded(units: list[bytes], plain: np.ndarray, encode, table: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat ids of units, how many each has, and whether its tokens give back its bytes."""
    sizes = np.array([len(t) for t in table], np.int64)
    ends = np.cumsum([len(u) for u in units])
    bounds = _joined(ends, plain)
    flat, counts, good = [], np.zeros(len(units), np.int64), np.ones(len(units), bool)

    def fits(ids: np.ndarray, low: int, high: int) -> bool:
        """Takes over the ids of units ``low`` to ``high`` if they give back their bytes, each unit its own."""
        reached = np.cumsum(sizes[ids])
        stops = ends[low:high] - (ends[low - 1] if low else 0)
        upto = np.searchsorted(reached, stops)
        if not len(ids) or upto[-1] >= len(reached) or (reached[upto] != stops).any():
            return False
        if b"".join(map(table.__getitem__, ids.tolist())) != b"".join(units[low:high]):
            return False
        counts[low:high] = np.diff(upto + 1, prepend=0)
        flat.append(ids)
        return True

    for at in range(0, len(bounds) - 1, PIECES):
        cut = bounds[at : at + PIECES + 1].tolist()
        found = encode([b"".join(units[a:b]).decode() for a, b in zip(cut, cut[1:])])
        if fits(np.concatenate(found), cut[0], cut[-1]):
            continue
        for ids, a, b in zip(found, cut, cut[1:]):
            if fits(ids, a, b):
                continue
            for k in range(a, b):  # each on its own, to see which of them is changed
                (own,) = encode([units[k].decode()])
                good[k] = fits(own, k, k + 1)
    return np.concatenate([np.zeros(0, np.int64), *flat]), counts, good


def _tokens(ids: np.ndarray, counts: np.ndarray, table: list[bytes]) -> pa.Table:
    """One row a token: its unit, its place, its id, and the byte of the unit at which it ends."""
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)])), pa.array(ids))
    unit = pc.list_parent_indices(lists).to_numpy()
    sizes = np.array([len(t) for t in table], np.int64)[ids]
    total = np.cumsum(sizes)
    before = np.concatenate([[0], total])[np.cumsum(counts) - counts]
    return pa.table({"unit": unit, "place": np.arange(len(ids)), "id": pc.list_flatten(lists), "end": total - before[unit]})


def _grouped(first: pa.Table, second: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
    """Group of each token of both sides, numbered over all units; how many groups there are."""
    both = first.select(["unit", "end", "place"]).join(
        second.select(["unit", "end", "place"]), ["unit", "end"], join_type="inner", right_suffix="_b", use_threads=False
    )
    groups = []
    for side, column in ((first, "place"), (second, "place_b")):
        last = np.zeros(len(side) + 1, np.int64)
        last[both.column(column).to_numpy() + 1] = 1
        groups.append(np.cumsum(last)[:-1])
    return groups[0], groups[1], len(both)


def _links(first: pa.Table, second: pa.Table, groups: tuple[np.ndarray, np.ndarray, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, pair of ids, links) of all groups, ascending by unit; tokens of a group with one id are counted first."""
    unit = np.zeros(groups[2], np.int64)
    unit[groups[0]] = first.column("unit").to_numpy()
    sides = []
    for side, group, name in ((first, groups[0], "a"), (second, groups[1], "b")):
        keys = pa.table({"k": (group << ID_BITS) | side.column("id").to_numpy()})
        counted = keys.group_by("k", use_threads=False).aggregate([([], "count_all")])
        found = counted.column("k").to_numpy()
        sides.append(pa.table({"group": found >> ID_BITS, name: found & ((1 << ID_BITS) - 1), f"n_{name}": counted.column("count_all")}))
    pairs = sides[0].join(sides[1], "group", join_type="inner", use_threads=False)
    owner = unit[pairs.column("group").to_numpy()]
    order = np.argsort(owner, kind="stable")
    key = (pairs.column("a").to_numpy().astype(np.uint64) << SHIFT) | pairs.column("b").to_numpy().astype(np.uint64)
    return owner[order], key[order], pc.multiply(pairs.column("n_a"), pairs.column("n_b")).to_numpy()[order]


@lru_cache(maxsize=1)
def _numerals(size: int) -> pa.Array:
    """Each id in decimal with what may follow it: a comma, a bar, a semicolon."""
    return pa.array([f"{i}{mark}" for mark in ",|;" for i in range(size)], pa.large_string())


def _shown(first: pa.Table, second: pa.Table, groups: tuple[np.ndarray, np.ndarray, int], units: int) -> list[bytes]:
    """Groups of each unit as text, a semicolon after each."""
    size = max([0, *(int(side.column("id").to_numpy().max()) for side in (first, second) if len(side))]) + 1
    size = 1 << size.bit_length()
    per = [np.bincount(g, minlength=groups[2]) for g in groups[:2]]
    before = [np.cumsum(p) - p for p in per]
    marks = np.zeros(len(first) + len(second), np.int64)
    for k, (side, group) in enumerate(zip((first, second), groups[:2])):
        at = np.arange(len(side)) + (before[1][group] if k == 0 else before[0][group] + per[0][group])
        last = np.append(group[1:] != group[:-1], True) if len(group) else np.zeros(0, bool)
        marks[at] = side.column("id").to_numpy() + size * np.where(last, 1 + k, 0)
    counts = sum(np.bincount(side.column("unit").to_numpy(), minlength=units) for side in (first, second))
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)])), _numerals(size).take(pa.array(marks)))
    return pc.binary_join(lists, pa.scalar("", pa.large_string())).cast(pa.large_binary()).to_pylist()


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``counts`` of them, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _documents_with(unit: np.ndarray, owner: np.ndarray, linked: np.ndarray, pair: np.ndarray, n_units: int, n_pairs: int) -> np.ndarray:
    """In how many documents each pair is linked, from the units of the documents
    and the units that pairs are linked in."""
    per = np.bincount(linked, minlength=n_units)
    begin = np.cumsum(per) - per
    total = np.zeros(n_pairs, np.int64)
    upto = np.cumsum(per[unit])
    at = 0
    while at < len(unit):
        done = upto[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, done + PAIR_ROWS)))
        stop = int(np.searchsorted(owner, owner[stop - 1], side="right"))  # whole documents
        own, here = owner[at:stop], unit[at:stop]
        distinct = pa.table({"k": own * n_units + here}).group_by("k", use_threads=False).aggregate([]).column("k").to_numpy()
        own, here = np.divmod(distinct, n_units)
        rows = np.repeat(own, per[here]) * n_pairs + pair[_ranges(begin[here], per[here])]
        held = pa.table({"k": rows}).group_by("k", use_threads=False).aggregate([]).column("k").to_numpy()
        total += np.bincount(held % n_pairs, minlength=n_pairs)
        at = stop
    return total


def _lane_of(pairs: np.ndarray, lanes: int) -> np.ndarray:
    """All pairs of a first id lie in one lane."""
    return ((pairs >> SHIFT) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(lanes)


def _aligned(*sides: tuple[np.ndarray, np.ndarray, list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Links by unit and pair, groups as text, and number of groups of units, from
    the flat ids, counts and byte table of both sides; some units at a time."""
    stops = [np.concatenate([[0], np.cumsum(n)]) for _, n, _ in sides]
    size, parts, shown = len(sides[0][1]), [], []
    for at in range(0, size, UNITS):
        upto = min(size, at + UNITS)
        first, second = (_tokens(ids[s[at] : s[upto]], n[at:upto], table) for (ids, n, table), s in zip(sides, stops))
        groups = _grouped(first, second)
        unit, keys, links = _links(first, second, groups)
        last = np.flatnonzero(np.diff(groups[0], append=groups[2]))
        n_groups = np.bincount(first.column("unit").to_numpy()[last], minlength=upto - at)
        parts.append((unit + at, keys, links, n_groups))
        shown += _shown(first, second, groups, upto - at)
    nothing = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    unit, keys, links, n_groups = (np.concatenate(c) for c in zip(nothing, *parts))
    return unit, keys, links, shown, n_groups


def _align_chunk(texts: pa.Array, ids: pa.Array, paths: tuple[str, str]) -> tuple[dict[str, bytes], np.ndarray, np.ndarray]:
    """Parts of the chunk's file; its distinct pairs and in how many of its documents each is linked."""
    tools = _tokenizers(*paths)
    cut, counts = _units(texts)
    coded = cut.dictionary_encode()
    units = coded.dictionary.to_pylist()
    index = coded.indices.to_numpy().astype(np.int64)
    tails = np.frombuffer(b"".join([u[-3:].rjust(3) for u in units]), np.uint8).reshape(-1, 3)
    plain = _solid(tails[:, 2], tails[:, 1], tails[:, 0])
    first_ids, first_n, first_good = _encoded(units, plain, tools.first_ids, tools.first_bytes)
    second_ids, second_n, second_good = _encoded(units, plain, tools.second_ids, tools.second_bytes)
    # a document with a unit that does not come back has no tokens
    owner = np.repeat(np.arange(len(ids)), counts)
    bad = np.bincount(owner, ~(first_good & second_good)[index], len(ids)) > 0
    keep = ~bad[owner]
    index, owner, counts = index[keep], owner[keep], np.where(bad, 0, counts)
    good = first_good & second_good
    if not good.all():
        first_ids, second_ids = first_ids[np.repeat(good, first_n)], second_ids[np.repeat(good, second_n)]
        first_n, second_n = np.where(good, first_n, 0), np.where(good, second_n, 0)
    linked, keys, links, shown, n_groups = _aligned((first_ids, first_n, tools.first_bytes), (second_ids, second_n, tools.second_bytes))
    pairs, pair = np.unique(keys, return_inverse=True)
    n_links = np.bincount(linked, links, len(units)).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    digests = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        said = b"".join(map(shown.__getitem__, index[a:b].tolist()))
        digests.append(hashlib.sha256(said[:-1]).digest() if a < b else bytes(32))
    sums = [np.diff(np.concatenate([[0], np.cumsum(v[index])])[bounds]) for v in (first_n, second_n, n_groups, n_links)]
    documents = _documents_with(index, owner, linked, pair, max(1, len(units)), max(1, len(pairs)))[: len(pairs)]
    order = np.argsort(-np.bincount(index, minlength=len(units)), kind="stable")  # frequent units first: small numbers
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    parts = {
        "ids": squeezed(np.array(pc.fill_null(ids, 0), np.int64)), "known": squeezed(np.array(ids.is_valid(), np.uint8)),
        "counts": squeezed(counts), "digests": b"".join(digests), **{f"sum{k}": squeezed(v.astype(np.int64)) for k, v in enumerate(sums)},
        "index": squeezed(rank[index].astype(np.uint32)), "unit": squeezed(rank[linked].astype(np.uint32)),
        "pair": squeezed(pair.astype(np.uint32)), "links": squeezed(links.astype(np.uint64)),
        "n_units": squeezed(np.array([len(units)], np.int64)),
    }
    return parts, pairs, documents


def _align_chunks(folder: str, lanes: int, paths: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, size = 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, size
            whole = pa.Table.from_batches(held)
            held.clear()
            chunk = f"chunk-{whole.column('part')[0].as_py()}-{made}"
            made, size = made + 1, 0
            texts, ids = (whole.column(c).combine_chunks() for c in ("text", "doc_id"))
            parts, pairs, documents = _align_chunk(texts, ids, paths)
            lane = _lane_of(pairs, lanes)
            present = np.unique(lane)
            save_parts(folder, chunk, pairs=sorted_blob(pairs), **parts)
            rows = [(n, sorted_blob(pairs[m]), squeezed(documents[m])) for n in present.tolist() for m in (lane == n,)]
            pa.default_memory_pool().release_unused()
            rows = rows or [(0, sorted_blob(pairs), squeezed(documents))]  # a chunk without pairs comes back as well
            numbers, keys, blobs = zip(*rows)
            yield pa.RecordBatch.from_pydict(
                {"chunk": pa.array([chunk] * len(rows)), "lane": pa.array(numbers, pa.int32()), "keys": pa.array(keys), "documents": pa.array(blobs)}
            )

        for batch in batches:
            texts = batch.column("text")
            for first, count in runs_of(texts, RUN_BYTES):
                held.append(batch.slice(first, count))
                size += pc.sum(pc.fill_null(pc.binary_length(held[-1].column("text")), 0)).as_py() + count
                if size >= CHUNK_BYTES:
                    yield from flush()
        if held:
            yield from flush()

    return run


def _pair_counts(table: pa.Table) -> pa.Table:
    """Documents of the pairs of a lane over all chunks, and whether a pair has the most of its first id."""
    keys, place, ends = merged(table.column("keys").to_pylist())
    sent = np.concatenate([loosened(b, np.int64) for b in table.column("documents").to_pylist()])
    rows = pa.table({"place": place, "n": sent}).group_by("place", use_threads=False).aggregate([("n", "sum")])
    total = np.zeros(len(keys), np.int64)
    total[rows.column("place").to_numpy()] = rows.column("n_sum").to_numpy()
    owner = keys >> SHIFT
    begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(keys) else np.zeros(0, np.int64)
    most = np.maximum.reduceat(total, begins) if len(keys) else total
    best = total == np.repeat(most, np.diff(np.append(begins, len(keys))))
    return pa.table(
        {
            "chunk": table.column("chunk"), "lane": table.column("lane"),
            "totals": pa.array([squeezed(t) for t in np.split(total[place], ends)]), "best": pa.array([np.packbits(b).tobytes() for b in np.split(best[place], ends)]),
        }
    )


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _summed(folder: str, lanes: int):
    """Documents of a chunk, once its pairs have their corpus-wide counts."""

    def run(table: pa.Table) -> pa.Table:
        parts = load_parts(folder, table.column("chunk")[0].as_py())
        pairs = from_sorted(parts["pairs"])
        lane = _lane_of(pairs, lanes)
        totals, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        for n, t, b in zip(*(table.column(c).to_pylist() for c in ("lane", "totals", "best"))):
            mine = np.flatnonzero(lane == n)
            totals[mine] = loosened(t, np.int64)
            best[mine] = np.unpackbits(np.frombuffer(b, np.uint8), count=len(mine))
        unit, pair = loosened(parts["unit"], np.uint32), loosened(parts["pair"], np.uint32)
        links = loosened(parts["links"], np.uint64).astype(np.int64)
        (n_units,) = loosened(parts["n_units"], np.int64)
        index, counts = loosened(parts["index"], np.uint32), loosened(parts["counts"], np.int64)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        ids, known = loosened(parts["ids"], np.int64), loosened(parts["known"], np.uint8)
        columns = {"doc_id": pa.array(ids, mask=known == 0)}
        for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links")):
            columns[name] = pa.array(loosened(parts[f"sum{k}"], np.int64))
        for name, weight in (("n_best", best[pair]), ("count_sum", totals[pair])):
            per_unit = np.zeros(n_units, np.int64)
            np.add.at(per_unit, unit, links * weight)
            columns[name] = pa.array(np.diff(np.concatenate([[0], np.cumsum(per_unit[index])])[bounds]))
        digests = parts["digests"]
        columns["groups_sha256"] = pa.array([digests[32 * k : 32 * k + 32].hex() if n else "" for k, n in enumerate(counts.tolist())])
        return pa.table(columns)

    return run


def aligned_tokenizers(documents: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The first tokenizer (byte-level) encodes a blank and the text, the second
    (pieces) the text, whose blank it adds itself; special tokens are plain
    text. Byte offsets at which tokens of both end cut them into groups. A link
    is a pair of tokens of one group; the count of a pair of ids is the number
    of documents that hold it linked. ``n_best`` counts the links whose count is
    the highest of their first id, ties included.

    Null and empty texts, and texts that the tokens of either side do not give
    back byte by byte, have no tokens: zeros and an empty digest. Null ids stay
    null; repeated rows are documents of their own. No documents give no rows;
    other columns are ignored. Partitions name the chunks, so pass stored rows.
    """
    spark = documents.sparkSession
    folder = shared_folder(spark, "alignment")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    lanes = min(MOST_LANES, 8 + size // LANE_BYTES)
    sent = rows.withColumn("part", F.spark_partition_id()).mapInArrow(
        _align_chunks(folder, lanes, paths or tokenizer_paths()), "chunk string, lane int, keys binary, documents binary"
    )
    counted = staged(sent.groupBy("lane").applyInArrow(_pair_counts, "chunk string, lane int, totals binary, best binary"), "pair-counts")
    return counted.groupBy("chunk").applyInArrow(_summed(folder, lanes), RESULT)
