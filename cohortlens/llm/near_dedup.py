"""Near-duplicate components by b-bit MinHash.

Texts with equal shingle sets form a class and are handled once. Each class
gets 160 minima; five at a time they make 32 band keys, and their two low bits
make a packed signature of 40 bytes. Classes that share a band key are
candidates, the signature estimates their similarity by bit counts, corrected
for chance collisions, and the estimates that can reach the threshold are
confirmed on the full shingle sets.

Large buckets are never expanded into pairs. First every class is compared with
one or two pivots of each of its buckets, a number of comparisons in proportion
to the classes, and what is confirmed is merged. Only buckets that still hold
more than one component are then searched block by block: by signatures for
members that look like one of another component, which come out as a forest, no
pairs; then each group of look-alikes on full sets. A block whose members
already belong together isn't compared with its like, and what comes out are
links that merge components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.components import connected_components
from cohortlens.llm.words import STEP, WORD_HASH, forget, mixed, shingle_set, words
from cohortlens.session import numbered, staged, staging, text_batches

BITS = 2


@dataclass(frozen=True)
class NearSettings:
    """``percent``: linked from 100 * intersection >= percent * union on.

    With 32 bands of 5 a pair at 0.8 shares a bucket with a probability of
    1 - 3e-6. ``slack`` is what the estimate may fall short of the threshold
    before a pair is passed over: four and a half standard deviations of 160
    minima of two bits. ``block`` bounds the members compared in one task at a
    time, ``left_blocks`` the blocks of one key that a task compares with the
    others of that key. Lists of class ids that pick rows of the staged
    signatures are broadcast up to ``broadcast_ids`` of them (some 16 bytes
    each), by count, and joined by a shuffle beyond.
    """

    shingle: int = 2
    percent: int = 80
    bands: int = 32
    rows: int = 5
    slack: float = 0.17
    block: int = 256
    left_blocks: int = 8
    broadcast_ids: int = 1_000_000
    seed: int = 20240501

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def multipliers(self) -> tuple[np.ndarray, np.ndarray]:
        draw = np.random.default_rng(self.seed)
        a = draw.integers(0, 2**63, self.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        return a, draw.integers(0, 2**63, self.hashes, dtype=np.uint64)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest 32-bit value of each hash function over a non-empty set."""
    least = np.full(len(a), 2**32 - 1, np.uint64)
    for at in range(0, len(shingles), 1024):
        part = shingles[None, at : at + 1024] * a[:, None]
        part += b[:, None]
        part >>= np.uint64(32)
        np.minimum(least, part.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray, settings: NearSettings) -> np.ndarray:
    """One 64-bit key a band, its number mixed in."""
    key = np.arange(1, settings.bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for column in least.reshape(settings.bands, settings.rows).T:
        key = mixed(key * STEP + column)
    return key.view(np.int64)


def packed(least: np.ndarray) -> bytes:
    """The two low bits of each minimum, four to a byte."""
    low = (least & np.uint64(3)).astype(np.uint8)
    bits = np.empty(2 * len(low), np.uint8)
    bits[0::2], bits[1::2] = low >> 1, low & 1
    return np.packbits(bits).tobytes()


def estimated(x: np.ndarray, y: np.ndarray, count: int) -> np.ndarray:
    """Similarity from packed signatures (bytes in the last axis), corrected for chance.

    Two lanes of b bits agree by chance with probability 2**-b, so the share of
    equal lanes is j + (1 - j) * 2**-b.
    """
    differing = x ^ y
    lanes = (differing | (differing >> 1)) & np.uint8(0x55)
    equal = 1.0 - np.bitwise_count(lanes).sum(axis=-1, dtype=np.int64) / count
    chance = 2.0**-BITS
    return (equal - chance) / (1.0 - chance)


#: Rows that are signed at a time: the words and blobs of a whole batch are many times its size.
SLICE_ROWS = 500

SIGNED = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.string()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary()), ("pressed", pa.binary())]
)


def _signatures(settings: NearSettings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = settings.multipliers()
        press = zstandard.ZstdCompressor(level=3).compress

        def signed(text: str | None) -> tuple:
            parts = words(text)
            if not parts:
                return 0, None, None, None, None
            shingles = shingle_set(parts, settings.shingle)
            least = minima(shingles, a, b)
            digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
            return len(shingles), digest, band_keys(least, settings), packed(least), press(b" ".join(parts))

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                made = zip(*[signed(text.as_py()) for text in part.column("text")])
                values = [pa.array(list(column), SIGNED.field(k).type) for k, column in enumerate(made, 2)]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id").cast(pa.string()), *values], schema=SIGNED)
        forget()

    return run


def _sizes_fit(x: np.ndarray, y: np.ndarray, settings: NearSettings) -> np.ndarray:
    """Whether sets of these sizes can reach the threshold at all."""
    return 100 * np.minimum(x, y) >= settings.percent * np.maximum(x, y)


def _estimate_pairs(settings: NearSettings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floor = settings.percent / 100 - settings.slack
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(len(batch), -1) for c in ("sig_a", "sig_b"))
            score = estimated(x, y, settings.hashes)
            keep = (score >= floor) & _sizes_fit(batch["n_a"].to_numpy(), batch["n_b"].to_numpy(), settings)
            yield pd.DataFrame({"a": batch["a"][keep], "b": batch["b"][keep], "score": score[keep]})

    return run


def _linked(x: np.ndarray, y: np.ndarray, settings: NearSettings) -> bool:
    """Whether two sorted sets reach the threshold."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return 100 * common >= settings.percent * (len(x) + len(y) - common)


def _confirm(settings: NearSettings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain = zstandard.ZstdDecompressor()

        def members(blob: bytes) -> np.ndarray:
            return shingle_set(plain.decompress(blob).split(), settings.shingle)

        last, held = None, None
        for batch in batches:
            linked = []
            for b, text_a, text_b in zip(batch["b"], batch["text_a"], batch["text_b"]):
                if b != last:
                    last, held = b, members(text_b)
                other = members(text_a)
                small, large = min(len(other), len(held)), max(len(other), len(held))
                if 100 * small < settings.percent * large:
                    linked.append(False)
                    continue
                linked.append(_linked(other, held, settings))
            keep = np.array(linked, bool)
            yield pd.DataFrame({"a": batch["a"][keep], "b": batch["b"][keep]})
        forget()

    return run


def _columns(side) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    signature = np.frombuffer(b"".join([m["signature"] for m in side]), np.uint8).reshape(len(side), -1)
    return *(np.array([m[c] for m in side], np.int64) for c in ("class", "component", "n")), signature


def _alike(left, right, same: bool, settings: NearSettings) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places left, places right, estimates) of the pairs of two blocks that lie in two components and look alike."""
    floor = settings.percent / 100 - settings.slack
    (xs, xc, xn, xsig), (ys, yc, yn, ysig) = left, right
    step = max(1, 65_536 // len(ys))
    for at in range(0, len(xs), step):
        cut = slice(at, at + step)
        keep = (xc[cut, None] != yc) & _sizes_fit(xn[cut, None], yn, settings)
        if same:
            keep &= xs[cut, None] < ys
        i, j = np.nonzero(keep)
        score = estimated(xsig[cut][i], ysig[j], settings.hashes)
        close = score >= floor
        yield i[close] + at, j[close], score[close]


def _forest(count: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest place reachable from each of ``count`` places over edges i-j."""
    label = np.arange(count)
    while True:
        low = np.minimum(label[i], label[j])
        step = label.copy()
        np.minimum.at(step, i, low)
        np.minimum.at(step, j, low)
        step = step[step]
        if (step == label).all():
            return label
        label = step


def _open_members(settings: NearSettings):
    """Look-alikes of two blocks, as a forest: fewer rows than members, however many pairs look alike."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for same, left, right in zip(batch["same"], batch["left"], batch["right"]):
                left, right = _columns(left), _columns(right)
                classes, places = np.unique(np.concatenate([left[0], right[0]]), return_inverse=True)
                label = np.arange(len(classes))
                for i, j, _ in _alike(left, right, same, settings):
                    # Merge with what is known: both ends by the root they already have.
                    ends = label[places[i]], label[places[len(left[0]) + j]]
                    label = _forest(len(classes), *ends)[label]
                found = label != np.arange(len(classes))
                if found.any():
                    yield pd.DataFrame({"a": classes[found], "b": classes[label[found]]})

    return run


def _block_links(settings: NearSettings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain = zstandard.ZstdDecompressor()
        for batch in batches:
            for same, left, right in zip(batch["same"], batch["left"], batch["right"]):
                texts = {m["class"]: m["pressed"] for side in (left, right) for m in side}
                sets: dict[int, np.ndarray] = {}
                up: dict[int, int] = {}

                def members(c: int) -> np.ndarray:
                    if c not in sets:
                        sets[c] = shingle_set(plain.decompress(texts[c]).split(), settings.shingle)
                    return sets[c]

                def top(c: int) -> int:
                    while c in up:
                        c = up[c]
                    return c

                x, y = _columns(left), _columns(right)
                links = []
                for i, j, score in _alike(x, y, same, settings):
                    order = np.argsort(-score, kind="stable")
                    for m, n in zip(i[order].tolist(), j[order].tolist()):
                        one, two = top(int(x[1][m])), top(int(y[1][n]))
                        if one != two and _linked(members(int(x[0][m])), members(int(y[0][n])), settings):
                            up[one] = two
                            links.append((int(x[0][m]), int(y[0][n])))
                if links:
                    yield pd.DataFrame(links, columns=["a", "b"])
        forget()

    return run


def signatures(documents: DataFrame, settings: NearSettings) -> DataFrame:
    """Staged: row, doc_id, n_shingles, digest, bands, signature, pressed words; from rows with their number."""
    narrow = documents.select(
        "row", F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    layout = "row long, doc_id string, n_shingles long, digest binary, bands array<long>, signature binary, pressed binary"
    made = narrow.mapInArrow(_signatures(settings), layout)
    with text_batches(documents.sparkSession):
        return staged(made.withColumn("doc_id", F.col("doc_id").cast("long")), "signatures")


def _confirmed(pairs: DataFrame, texts: DataFrame, settings: NearSettings) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    first = pairs.select("a", "b").join(texts.select(F.col("class").alias("a"), F.col("pressed").alias("text_a")), "a")
    both = first.join(texts.select(F.col("class").alias("b"), F.col("pressed").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInPandas(_confirm(settings), "a long, b long")


def _picked(rows: DataFrame, ids: DataFrame, settings: NearSettings) -> DataFrame:
    """Rows whose ``class`` is one of ``ids`` (a staged list)."""
    return rows.join(F.broadcast(ids) if ids.count() <= settings.broadcast_ids else ids, "class", "left_semi")


def _texts_of(pairs: DataFrame, signed: DataFrame, purpose: str, settings: NearSettings) -> DataFrame:
    needed = staged(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), f"{purpose}-ids")
    return staged(_picked(signed.select(F.col("row").alias("class"), "pressed"), needed, settings), purpose)


def near_links(signed: DataFrame, classes: DataFrame, settings: NearSettings) -> DataFrame:
    """(node, component) of the classes with a link, from staged signatures."""
    chosen = _picked(signed.select(F.col("row").alias("class"), "bands"), classes.select("class"), settings)
    members = chosen.select("class", F.explode("bands").alias("key"))
    buckets = (
        members.groupBy("key")
        .agg(F.count("*").alias("size"), F.min("class").alias("pivot"), F.min_by("class", F.xxhash64("class", F.lit(7))).alias("other"))
        .filter("size > 1")
    )
    shared = staged(members.join(staged(buckets, "buckets"), "key").select("key", "class", "size", "pivot", "other"), "bucket-members")
    stars = (
        shared.select(F.col("class").alias("a"), F.explode(F.array("pivot", "other")).alias("b")).filter("a <> b").distinct()
    )
    sign = signed.select(F.col("row").alias("class"), F.col("n_shingles").alias("n"), "signature")

    def side(name: str) -> DataFrame:
        return sign.select(F.col("class").alias(name), F.col("n").alias(f"n_{name}"), F.col("signature").alias(f"sig_{name}"))

    signed_pairs = stars.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "sig_a", "sig_b")
    scored = staged(signed_pairs.mapInPandas(_estimate_pairs(settings), "a long, b long, score double"), "stars")
    # The two pivots that look most alike; a class has at most two pivots a band.
    ranked = F.sort_array(F.collect_list(F.struct("score", "b")), asc=False)
    best = scored.groupBy("a").agg(F.slice(ranked, 1, 2).alias("best"))
    first = staged(best.select("a", F.explode("best.b").alias("b")), "first-pairs")
    links = staged(_confirmed(first, _texts_of(first, signed, "texts", settings), settings), "links")
    labels = connected_components(links)

    def placed(frame: DataFrame, name: str) -> DataFrame:
        known = labels.select(F.col("node").alias(name), F.col("component").alias(f"c_{name}"))
        return frame.join(known, name, "left").withColumn(f"c_{name}", F.coalesce(f"c_{name}", name))

    # Buckets of two are their pivot and one more: those pairs are scored, and tried here if they weren't the best.
    twos = shared.filter("size = 2").select(F.explode(F.array("pivot", "other")).alias("b"), F.col("class").alias("a")).filter("a <> b").distinct()
    rest = placed(placed(scored.select("a", "b").join(twos, ["a", "b"], "left_semi").join(first, ["a", "b"], "left_anti"), "a"), "b")
    rest = staged(rest.filter("c_a <> c_b AND a > b").select("a", "b"), "rest-pairs")
    more = staged(_confirmed(rest, _texts_of(rest, signed, "rest-texts", settings), settings), "rest-links")

    wide = shared.filter("size > 2").select("key", "class")
    members = placed(wide, "class").select("key", "class", F.col("c_class").alias("component"))
    pairs = _block_pairs(members.join(sign, "class"), ["n", "signature"], settings)
    alike = staged(pairs.mapInPandas(_open_members(settings), "a long, b long").distinct(), "look-alikes")
    # A class lies in one group of look-alikes, but in up to 32 open buckets: its text travels once.
    opened = connected_components(alike).select(F.col("component").alias("key"), F.col("node").alias("class"))
    texts = signed.select(F.col("row").alias("class"), F.col("n_shingles").alias("n"), "signature", "pressed")
    texts = staged(_picked(texts, staged(opened.select("class").distinct(), "open-ids"), settings), "open-texts")
    again = placed(opened, "class").select("key", "class", F.col("c_class").alias("component"))
    pairs = _block_pairs(again.join(texts, "class"), ["n", "signature", "pressed"], settings)
    found = staged(pairs.mapInPandas(_block_links(settings), "a long, b long"), "open-links")
    return connected_components(links.unionByName(more).unionByName(found))


def _block_pairs(members: DataFrame, columns: list[str], settings: NearSettings) -> DataFrame:
    """key, same, left, right: pairs of blocks of a bucket that hold more than one component.

    A component with a whole block of members in the bucket has blocks of its
    own; the others share blocks. Blocks of one component aren't paired.
    """
    by_component = staged(members.groupBy("key", "component").agg(F.count("*").alias("count")), "bucket-components")
    small = F.when(F.col("count") < settings.block, F.col("count"))
    parts = by_component.groupBy("key").agg(F.count("*").alias("components"), F.sum(small).alias("loose")).filter("components > 1")
    pure = F.col("count") >= settings.block
    pieces = F.ceil(F.when(pure, F.col("count")).otherwise(F.col("loose")) / settings.block)
    opened = staged(by_component.join(parts, "key").select("key", "component", pure.alias("pure"), pieces.alias("pieces")), "open-buckets")
    blocks = (
        members.join(opened, ["key", "component"])
        .withColumn("block", F.pmod(F.xxhash64("class", F.lit(11)), F.col("pieces")))
        .withColumn("owner", F.when(F.col("pure"), F.col("component")))
        .groupBy("key", "owner", "block")
        .agg(F.collect_list(F.struct("class", "component", *columns)).alias("members"))
    )
    blocks = staged(blocks.withColumn("name", F.xxhash64("owner", "block")), "blocks")
    # A key with many blocks is dealt over tasks: each takes some left blocks and all right ones.
    salts = F.ceil(F.count("*") / settings.left_blocks).cast("int")
    hot = staged(blocks.groupBy("key").agg(salts.alias("salts")).filter("salts > 1"), "hot-keys")
    blocks = blocks.join(hot, "key", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    left = blocks.select("key", F.col("owner").alias("owner_l"), F.col("name").alias("l"), F.col("members").alias("left"), F.expr("CAST(pmod(name, salts) AS INT)").alias("salt"))
    right = blocks.select("key", F.col("owner").alias("owner_r"), F.col("name").alias("r"), F.col("members").alias("right"), F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"))
    apart = F.col("owner_l").isNull() | F.col("owner_r").isNull() | (F.col("owner_l") != F.col("owner_r"))
    return left.join(right, ["key", "salt"]).filter((F.col("l") <= F.col("r")) & apart).select("key", (F.col("l") == F.col("r")).alias("same"), "left", "right")


def near_duplicates(documents: DataFrame, settings: NearSettings | None = None) -> DataFrame:
    """One row per document: row, doc_id, n_shingles, component_id, kept, first.

    ``component_id`` is the smallest doc_id reachable over links, ``kept`` says
    that the document has it, ``first`` marks exactly one row of each component
    (the first of its rows with the smallest doc_id). ``row`` is a number made
    here.

    Null or wordless texts have no shingles and link with nothing. Rows that
    repeat a doc_id are rows of their own. A null doc_id counts as larger than
    any other; a component of such rows only has a null component_id, and its
    first row is kept. No documents give no rows. Other columns are ignored.
    """
    settings = settings or NearSettings()
    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return _assigned(signatures(rows, settings), settings)


def _assigned(signed: DataFrame, settings: NearSettings) -> DataFrame:
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id"), F.col("row"))
    classes = staged(
        signed.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("row").alias("class"), F.min(order).alias("least")), "classes"
    )
    labels = near_links(signed, classes, settings).select(F.col("node").alias("class"), "component")
    placed = classes.join(labels, "class", "left").withColumn("component", F.coalesce("component", "class"))
    heads = staged(placed.groupBy("component").agg(F.min("least").alias("head")), "heads")
    by_digest = placed.join(heads, "component").select("digest", "head")
    rows = signed.select("row", "doc_id", "n_shingles", "digest").join(by_digest, "digest", "left")
    component_id = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id"))
    first = F.col("digest").isNull() | (F.col("row") == F.col("head.row"))
    return rows.select(
        "row",
        "doc_id",
        "n_shingles",
        component_id.alias("component_id"),
        F.when(F.col("doc_id").isNull(), first).otherwise(F.col("doc_id") == component_id).alias("kept"),
        first.alias("first"),
    )


def one_of_each(documents: DataFrame, settings: NearSettings | None = None) -> DataFrame:
    """The documents, one of each component: its first with the smallest doc_id.

    All columns stay as they are. Same rules as ``near_duplicates``; rows that
    repeat are near-duplicates of each other, but for those without words.
    """
    settings = settings or NearSettings()
    rows = numbered(documents)
    with staging(documents.sparkSession):
        signed = signatures(rows.select("row", "d.doc_id", "d.text"), settings)
        gone = staged(_assigned(signed, settings).filter("NOT first").select("row"), "near-copies", outlast=True)
    # the rows that go are fewer than those that stay: the texts are read with their list beside them
    listed = F.broadcast(gone) if gone.count() <= settings.broadcast_ids else gone
    return rows.join(listed, "row", "left_anti").select("d.*")
