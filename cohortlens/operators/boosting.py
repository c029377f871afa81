"""Growing of boosted trees in one barrier stage, with the decisions of Spark ML's learner.

Spark ML runs some ten jobs for every tree, one after the other; with hundreds
of trees the time goes into starting them. Here the tasks of one stage keep
their rows, binned once to a byte a feature, for the whole training. For every
level of a tree each task adds up the gradients of its rows by node, feature
and bin, the tasks exchange these sums through files of the shared folder (a
barrier's own exchange waits a second at a time), and each of them picks the
same splits.

Split candidates, draws of rows and of columns, gains, and the order in which
ties are broken are those of ``GBTClassifier`` (variance impurity, log loss).
Rows come in blocks, the partitions of the frame that is given: rows are drawn
block by block, and the sums of several blocks are added as whole multiples of
a power of two, so the trees don't depend on how many tasks share the blocks.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import BarrierTaskContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import shared_folder

#: Rows that a task should not exceed while there are free slots, rows of one packed line, and rows of a task
#: up to which the gradients of a tree are kept from level to level.
TASK_ROWS, LINE_ROWS, KEPT_ROWS = 1_000_000, 100_000, 2_000_000

#: Most tasks of a training, as each reads the sums of all, and the longest wait between two looks for a file, in seconds.
MOST_TASKS, LONGEST_NAP = 32, 0.02

_U64 = np.uint64
_EPSILON = 2.0**-52
_INVALID = -np.finfo(float).max

PACKED = "block long, part long, n long, labels binary, weights binary, bins binary"

NODES = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, "
    "rawCount: bigint, gain: double, leftChild: int, rightChild: int, "
    "split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)


# --- the random numbers of Spark and Java ------------------------------------


def _murmur(data: bytes, seed: int) -> int:
    mask, h = 0xFFFFFFFF, seed & 0xFFFFFFFF
    for at in range(0, len(data), 4):
        k = int.from_bytes(data[at : at + 4], "little") * 0xCC9E2D51 & mask
        k = (k << 15 | k >> 17) & mask
        h ^= k * 0x1B873593 & mask
        h = (h << 13 | h >> 19) & mask
        h = (h * 5 + 0xE6546B64) & mask
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & mask
    return h ^ h >> 16


def xorshift_seed(seed: int) -> int:
    """The state that Spark's XORShiftRandom begins with."""
    data = (seed & (1 << 64) - 1).to_bytes(8, "big")
    low = _murmur(data, 0x3C074A61)
    return _murmur(data, low) << 32 | low


def _step(state: np.ndarray) -> np.ndarray:
    state = state ^ state << _U64(21)
    state ^= state >> _U64(35)
    return state ^ state << _U64(4)


def _doubles(state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next state and double of each generator, as ``java.util.Random`` makes them of 26 and 27 bits."""
    first = _step(state)
    second = _step(first)
    high = (first & _U64((1 << 26) - 1)) << _U64(27)
    # the 27 bits are a signed int; they never reach its sign
    return second, (high + (second & _U64((1 << 27) - 1))).astype(float) * 2.0**-53


def first_int(seed: int) -> int:
    """The first int of Spark's XORShiftRandom."""
    value = int(_step(np.array([xorshift_seed(seed)], _U64))[0]) & 0xFFFFFFFF
    return value - (1 << 32) if value >> 31 else value


class JavaRandom:
    """``nextLong`` of ``java.util.Random``."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & (1 << 48) - 1

    def _next(self) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & (1 << 48) - 1
        value = self.state >> 16
        return value - (1 << 32) if value >> 31 else value

    def long(self) -> int:
        return (self._next() << 32) + self._next()


def reservoir(n: int, k: int, seed: int) -> list[int]:
    """``k`` of the numbers below ``n``, as Spark's reservoir sample draws them."""
    kept, state = list(range(k)), np.array([xorshift_seed(seed)], _U64)
    for item in range(k, n):
        state, value = _doubles(state)
        place = int(value[0] * (item + 1))
        if place < k:
            kept[place] = item
    return kept


# --- split candidates ----------------------------------------------------------


def thresholds(values: np.ndarray, weights: np.ndarray, total: float, most: int) -> np.ndarray:
    """Split candidates of one feature; ``total`` is the weight that the sample should have.

    Weight that the values other than zero lack counts as that of zeros.
    """
    keep = values != 0.0
    distinct, place = np.unique(values[keep], return_inverse=True)
    if not len(distinct):
        return np.empty(0)
    counts = np.bincount(place, weights[keep], len(distinct))
    missing = total - counts.sum()
    if missing > _EPSILON * keep.sum() * 100:
        at = int(np.searchsorted(distinct, 0.0))
        distinct, counts = np.insert(distinct, at, 0.0), np.insert(counts, at, missing)
    if len(distinct) - 1 <= most:
        found = [(a + b) / 2.0 for a, b in pairwise(distinct)]
    else:
        found, stride = [], total / (most + 1)
        target, current = stride, counts[0]
        for index in range(1, len(distinct)):
            before, current = current, current + counts[index]
            if abs(before - target) < abs(current - target):
                found.append((distinct[index - 1] + distinct[index]) / 2.0)
                target += stride
    return np.array(found, float) + 0.0  # no negative zero


def _candidates(rows: DataFrame, features: Column, n: int, weight: float, booster: GBTClassifier) -> list[np.ndarray]:
    """Split candidates of every feature from a sample of some 10,000 rows, all if there are fewer."""
    bins, wanted = booster.getMaxBins(), max(booster.getMaxBins() ** 2, 10_000)
    share = wanted / n if wanted < n else 1.0
    sample = rows.select(features.alias("x"), booster.getWeightCol())
    if share < 1.0:
        # drawn by the rows' JVM form, as the learner does; a frame's own sample draws others
        spark, drawn = rows.sparkSession, sample._jdf.toJavaRDD().sample(False, share, first_int(booster.getSeed()))
        sample = DataFrame(spark._jsparkSession.createDataFrame(drawn, sample._jdf.schema()), spark)
    found = sample.toArrow()  # bounded by the size of the sample
    x = found["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(found.num_rows, -1)
    weights = found[booster.getWeightCol()].to_numpy()
    return [thresholds(column, weights, share * weight, min(bins, n) - 1) for column in x.T]


# --- rows of a task --------------------------------------------------------------


def _packer(splits: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a block as lines of bytes: labels, weights, and the bin of every feature, feature by feature."""
    kind = pa.schema(
        [("block", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("labels", pa.binary()), ("weights", pa.binary()), ("bins", pa.binary())]
    )

    def lines(batches):
        held, count, part = [], 0, 0

        def line():
            block, labels, weights, bins = zip(*held)
            n = sum(map(len, labels))
            values = (block[0], part, n, np.concatenate(labels).tobytes(), np.concatenate(weights).tobytes(), np.concatenate(bins, axis=1).tobytes())
            return pa.RecordBatch.from_pydict({k.name: [v] for k, v in zip(kind, values)}, kind)

        for batch in batches:
            if not batch.num_rows:
                continue
            label = batch["label"].to_numpy(zero_copy_only=False)
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(splits))
            bins = np.array([np.searchsorted(s, column) for s, column in zip(splits, x.T)], np.uint8)
            held.append((batch["block"][0].as_py(), (2 * label - 1).astype(np.int8), batch["weight"].to_numpy(zero_copy_only=False), bins))
            count += batch.num_rows
            if count >= LINE_ROWS:
                yield line()
                held, count, part = [], 0, part + 1
        if held:
            yield line()

    return lines


@dataclass
class Block:
    """Rows that are drawn together, with their margins and the state of the tree that grows."""

    number: int
    labels: np.ndarray
    weights: np.ndarray
    bins: np.ndarray
    margin: np.ndarray
    drawn: np.ndarray | None = None
    at: np.ndarray | None = None
    kept: tuple | None = None

    def gradients(self, tree: int, bit: int, keep: bool) -> tuple:
        """Rows drawn for a tree: their places, weight, and weighted gradient and its square, and their bins."""
        if self.kept is not None:
            return self.kept
        taken = np.flatnonzero(self.drawn >> _U64(bit) & _U64(1))
        label, w = self.labels[taken].astype(float), self.weights[taken]
        y = label if tree == 0 else 4.0 * label / (1.0 + np.exp(2.0 * label * self.margin[taken]))
        wy = w * y
        found = taken, w, wy, wy * y, self.bins[:, taken]
        if keep:
            self.kept = found
        return found


def _blocks(batches: Iterator[pa.RecordBatch], features: int) -> list[Block]:
    lines: dict[int, list] = {}
    for batch in batches:
        for r in batch.to_pylist():
            lines.setdefault(r["block"], []).append((r["part"], r))
    found = []
    for number in sorted(lines):
        parts = [r for _, r in sorted(lines.pop(number), key=lambda x: x[0])]
        bins = np.concatenate([np.frombuffer(r["bins"], np.uint8).reshape(features, r["n"]) for r in parts], axis=1)
        labels = np.concatenate([np.frombuffer(r["labels"], np.int8) for r in parts])
        weights = np.concatenate([np.frombuffer(r["weights"]) for r in parts])
        found.append(Block(number, labels, weights, bins, np.zeros(len(labels))))
    return found


# --- one tree ----------------------------------------------------------------------


@dataclass
class Node:
    """A node while its tree grows; ``stats`` are weight, weighted sum and sum of squares, and rows."""

    stats: np.ndarray | None = None
    impurity: float = 0.0
    gain: float = -1.0
    feature: int = -1
    split: int = -1
    children: tuple[int, int] | None = None
    level: int = 0
    parent: int = -1
    columns: list[int] = field(default_factory=list)
    merged: float | None = None

    def prediction(self) -> float:
        if self.merged is not None:
            return self.merged
        return float(self.stats[1] / self.stats[0]) if self.stats[0] else 0.0


def _variance(stats: np.ndarray) -> np.ndarray:
    count, total, squares = stats[..., 0], stats[..., 1], stats[..., 2]
    with np.errstate(all="ignore"):
        return np.where(count == 0, 0.0, (squares - total * total / count) / count)


@dataclass
class Shape:
    """Where the bins of the features lie in a row of sums, and in one padded to equal numbers of bins."""

    bins: list[int]

    def __post_init__(self):
        self.most = max([*self.bins, 2])
        self.starts = np.cumsum([0, *self.bins])
        self.padded = np.concatenate([f * self.most + np.arange(b) for f, b in enumerate(self.bins)])


def sums_by_bin(block: Block, tree: int, bit: int, keep: bool, slot: np.ndarray, nodes: int, shape: Shape) -> np.ndarray:
    """(nodes, bins of all features, 4) sums of the drawn rows of a block.

    ``slot`` tells the place of each node of the tree among those asked for, or ``nodes`` for the others.
    """
    taken, w, wy, wyy, bins = block.gradients(tree, bit, keep)
    at = slot[block.at[taken]]
    asked = np.flatnonzero(at < nodes)
    if len(asked) < len(at):
        at, w, wy, wyy, bins = at[asked], w[asked], wy[asked], wyy[asked], bins[:, asked]
    out = np.empty((nodes, shape.starts[-1], 4))
    for f, count in enumerate(shape.bins):
        key = at * count + bins[f] if count > 1 else at
        for k, values in enumerate((w, wy, wyy, None)):
            sums = np.bincount(key, values, nodes * count)
            out[:, shape.starts[f] : shape.starts[f] + count, k] = sums.reshape(nodes, count)
    return out


def best_splits(nodes: list[Node], sums: np.ndarray, shape: Shape, least_rows: int, least_gain: float) -> list[tuple | None]:
    """For each node its best (gain, feature, split, left sums, right sums), or none that is valid.

    The first of equal gains wins, in the order of the node's columns. A root
    gets its own sums here.
    """
    full = np.zeros((len(nodes), len(shape.bins) * shape.most, 4))
    full[:, shape.padded] = sums
    left = np.cumsum(full.reshape(len(nodes), len(shape.bins), shape.most, 4), axis=2)
    right = left[:, :, -1:] - left
    for n, node in enumerate(nodes):
        if node.stats is None:
            usable = [f for f in node.columns if shape.bins[f] > 1]
            node.stats = left[n, usable[0], 0] + right[n, usable[0], 0] if usable else left[n, node.columns[0], -1]
            node.impurity = float(_variance(node.stats))
    impurity = np.array([node.impurity for node in nodes])[:, None, None]
    with np.errstate(all="ignore"):
        total = left[..., 0] + right[..., 0]
        gain = impurity - left[..., 0] / total * _variance(left) - right[..., 0] / total * _variance(right)
    gain[(left[..., 3] < least_rows) | (right[..., 3] < least_rows) | (gain < least_gain)] = _INVALID
    gain[:, np.arange(shape.most)[None, :] >= np.array(shape.bins)[:, None] - 1] = -np.inf
    found = []
    for n, node in enumerate(nodes):
        place = int(gain[n, node.columns].argmax())
        f, split = node.columns[place // shape.most], place % shape.most
        value = float(gain[n, f, split])
        found.append(None if value <= 0 else (value, f, split, left[n, f, split], right[n, f, split]))
    return found


@dataclass(frozen=True)
class Plan:
    """What a training task needs to know."""

    trees: int
    depth: int
    step: float
    row_share: float
    columns: int
    seed: int
    splits: list
    least_rows: int
    least_gain: float
    bound: float
    whole: bool
    folder: str


def grow_tree(tree: int, bit: int, blocks: list[Block], plan: Plan, shape: Shape, keep: bool, exchange) -> list[Node]:
    """The nodes of the next tree; rows of the blocks end up in their leaves."""
    random = JavaRandom(plan.seed + tree)
    features, nodes, waiting, known = len(shape.bins), [Node()], [0], {}
    for block in blocks:
        block.at, block.kept = np.zeros(len(block.labels), np.int32), None
    while waiting:
        opened = waiting
        for number in opened:
            every = plan.columns == features
            nodes[number].columns = list(range(features)) if every else reservoir(features, plan.columns, random.long())
        asked, rest = (opened, {}) if plan.whole else _shared_out(opened, nodes)
        slot = np.full(len(nodes), len(asked), np.int64)
        slot[asked] = np.arange(len(asked))
        parts = [sums_by_bin(b, tree, bit, keep, slot, len(asked), shape) for b in blocks]
        told = dict(zip(asked, exchange(parts, (len(asked), shape.starts[-1], 4))))
        known = told | {k: known[nodes[k].parent] - told[other] for k, other in rest.items()}
        sums = np.array([known[k] for k in opened])
        waiting = []
        for number, best in zip(opened, best_splits([nodes[k] for k in opened], sums, shape, plan.least_rows, plan.least_gain)):
            node = nodes[number]
            if best is None:
                node.impurity = -1.0  # as Spark marks a node that could not be split
                continue
            node.gain, node.feature, node.split, *sides = best
            node.children = (len(nodes), len(nodes) + 1)
            for child, stats in zip(node.children, sides):
                impurity = float(_variance(stats))
                nodes.append(Node(stats, impurity, level=node.level + 1, parent=number))
                if node.level + 1 < plan.depth and not abs(impurity) < _EPSILON:
                    waiting.insert(0, child)
        _descend(blocks, nodes, opened)
    return nodes


def _shared_out(opened: list[int], nodes: list[Node]) -> tuple[list[int], dict[int, int]]:
    """Nodes whose rows are added up, and those whose sums are their parent's without those of their sibling.

    Of two siblings the one with fewer rows is added up.
    """
    rest = {}
    for number in opened:
        if nodes[number].parent >= 0:
            left, right = nodes[nodes[number].parent].children
            other = left + right - number
            if other in opened and (nodes[other].stats[3], other) < (nodes[number].stats[3], number):
                rest[number] = other
    return [k for k in opened if k not in rest], rest


def _descend(blocks: list[Block], nodes: list[Node], opened: list[int]) -> None:
    """Rows of the nodes that were split go on to a child."""
    split = [k for k in opened if nodes[k].children]
    if not split:
        return
    feature, bound, child = np.zeros(len(nodes), np.int64), np.full(len(nodes), 255, np.int16), np.arange(len(nodes), dtype=np.int32)
    for k in split:
        feature[k], bound[k], child[k] = nodes[k].feature, nodes[k].split, nodes[k].children[0]
    for block in blocks:
        at = block.at
        right = block.bins[feature[at], np.arange(len(at))] > bound[at]
        block.at = child[at] + right


def finished(nodes: list[Node], tree: int, splits: list[np.ndarray]) -> list[dict]:
    """The nodes of a tree as a stored model lists them; leaves of one prediction are merged."""
    listed: list[dict] = []

    def same(number: int) -> bool:
        node = nodes[number]
        if node.children and all([same(c) for c in node.children]):
            one, two = (nodes[c] for c in node.children)
            if one.prediction() == two.prediction():
                node.children, node.merged = None, one.prediction()
        return node.children is None

    def add(number: int) -> int:
        node, place = nodes[number], len(listed)
        row = {
            "id": place, "prediction": node.prediction(), "impurity": node.impurity,
            "impurityStats": [float(v) for v in node.stats[:3]], "rawCount": int(node.stats[3]),
            "gain": -1.0, "leftChild": -1, "rightChild": -1,
            "split": {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1},
        }
        listed.append(row)
        if node.children:
            row["gain"] = node.gain
            row["split"] = {"featureIndex": node.feature, "leftCategoriesOrThreshold": [float(splits[node.feature][node.split])], "numCategories": -1}
            row["leftChild"], row["rightChild"] = (add(c) for c in node.children)
        return place

    same(0)
    add(0)
    return [{"treeID": tree, "nodeData": row} for row in listed]


# --- all trees ---------------------------------------------------------------------


class Exchange:
    """Sums over the blocks of all tasks of a barrier stage, step by step.

    Those of several blocks are added as integers, so that their order doesn't
    matter. A file gets its name when it is whole; it is deleted once all tasks
    have read it, which is when they have written the next.
    """

    def __init__(self, context: BarrierTaskContext, plan: Plan):
        self.rank, self.tasks, self.step, self.whole = context.partitionId(), len(context.getTaskInfos()), 0, plan.whole
        self.scale = 2.0 ** (62 - int(np.ceil(np.log2(max(plan.bound, 1.0)))))
        if self.tasks > 1:
            name = context.allGather(uuid.uuid4().hex)[0]  # a folder for each attempt of the stage
            place = f"{plan.folder}/{name}"
            self.files, self.folder = fs.FileSystem.from_uri(place if ":/" in place else f"file://{place}")
            self.files.create_dir(self.folder, recursive=True)

    def __call__(self, parts: list[np.ndarray], size: tuple[int, ...]) -> np.ndarray:
        if self.whole:
            return parts[0]
        mine = np.zeros(size, np.int64)
        for part in parts:
            mine += np.rint(part * self.scale).astype(np.int64)
        if self.tasks > 1:
            self._write(mine)
            mine = sum((self._read(rank, size) for rank in range(self.tasks) if rank != self.rank), mine)
            if self.step:
                self.files.delete_file(self._name(self.step - 1, self.rank))
            self.step += 1
        return mine / self.scale

    def _name(self, step: int, rank: int) -> str:
        return f"{self.folder}/{step}-{rank}"

    def _write(self, sums: np.ndarray) -> None:
        place = self._name(self.step, self.rank)
        with self.files.open_output_stream(f"{place}.part", compression=None) as stream:
            stream.write(sums.tobytes())
        self.files.move(f"{place}.part", place)

    def _read(self, rank: int, size: tuple[int, ...]) -> np.ndarray:
        nap = LONGEST_NAP / 64
        while True:  # the stage ends all its tasks when one of them fails
            try:
                with self.files.open_input_file(self._name(self.step, rank)) as stream:
                    return np.frombuffer(stream.read(), np.int64).reshape(size)
            except FileNotFoundError:
                time.sleep(nap)
                nap = min(2 * nap, LONGEST_NAP)


def _grower(plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    shape = Shape([len(s) + 1 for s in plan.splits])
    split = pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])
    data = pa.struct(
        [
            ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()),
            ("impurityStats", pa.list_(pa.float64())), ("rawCount", pa.int64()), ("gain", pa.float64()),
            ("leftChild", pa.int32()), ("rightChild", pa.int32()), ("split", split),
        ]
    )
    kind = pa.schema([("treeID", pa.int32()), ("nodeData", data)])

    def grow(batches):
        context = BarrierTaskContext.get()
        blocks = _blocks(batches, len(plan.splits))
        keep = sum(len(b.labels) for b in blocks) <= KEPT_ROWS
        exchange = Exchange(context, plan)
        for tree in range(plan.trees):
            bit = tree % 64
            if bit == 0:
                _draw(blocks, tree, plan)
            nodes = grow_tree(tree, bit, blocks, plan, shape, keep, exchange)
            value = np.array([node.prediction() for node in nodes]) * (plan.step if tree else 1.0)
            for block in blocks:
                block.margin += value[block.at]
                block.kept = None
            if context.partitionId() == 0:
                yield pa.RecordBatch.from_pylist(finished(nodes, tree, plan.splits), kind)

    return grow


def _draw(blocks: list[Block], tree: int, plan: Plan) -> None:
    """Draws the rows of the next 64 trees, as bits; every block has a generator for each tree."""
    trees = np.arange(tree, min(tree + 64, plan.trees))
    if plan.row_share >= 1.0:
        for block in blocks:
            block.drawn = np.full(len(block.labels), ~_U64(0))
        return
    for at in range(0, len(blocks), 16):  # bounds the memory of the draws
        some = blocks[at : at + 16]
        seeds = np.array([plan.seed + trees + b.number + 1 for b in some])
        state = np.array([xorshift_seed(int(s)) for s in seeds.ravel()], _U64)
        bits = np.tile(_U64(1) << np.arange(len(trees), dtype=_U64), (len(some), 1))
        out = np.empty((max(len(b.labels) for b in some), len(some)), _U64)
        for row in range(len(out)):
            state, value = _doubles(state)
            np.bitwise_or.reduce(np.where(value.reshape(bits.shape) < plan.row_share, bits, _U64(0)), axis=1, out=out[row])
        for k, block in enumerate(some):
            block.drawn = out[: len(block.labels), k].copy()


def free_slots(spark: SparkSession) -> int:
    """Tasks that can run at the same time, as the scheduler counts them for a barrier stage."""
    context = spark.sparkContext._jsc.sc()
    return max(1, context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile()))


def _columns(share: str, features: int) -> int:
    """Features to look at in a node, from the share as ``featureSubsetStrategy`` gives it."""
    return int(np.ceil(float(share) * features))


def fit_booster(rows: DataFrame, booster: GBTClassifier, features: int, side_by_side: int = 1) -> GBTClassificationModel:
    """The model that ``booster`` would fit to ``rows`` of features, label and weight.

    ``rows`` are read three times. A share of the free slots is used when
    ``side_by_side`` trainings run at a time, as long as the rows of a task stay few.
    """
    spark = rows.sparkSession
    label, weight, x = F.col(booster.getLabelCol()), F.col(booster.getWeightCol()), vector_to_array(booster.getFeaturesCol())
    known = F.count_if(label.isin(0.0, 1.0))
    n, known, total, heaviest = rows.agg(F.count(F.lit(1)), known, F.sum(weight), F.max(weight)).first()
    if known < n:
        raise ValueError("labels must be 0 or 1")
    if not n:
        raise ValueError("there are no rows to learn from")
    splits = _candidates(rows, x, n, total, booster)
    packed = rows.select(F.spark_partition_id().cast("long").alias("block"), label.alias("label"), weight.alias("weight"), x.alias("x"))
    packed = packed.mapInArrow(_packer(splits), PACKED)

    blocks = rows.rdd.getNumPartitions()
    slots = free_slots(spark)
    tasks = max(1, min(slots, MOST_TASKS, blocks, max(slots // side_by_side, -(-n // TASK_ROWS))))
    plan = Plan(
        booster.getMaxIter(), booster.getMaxDepth(), booster.getStepSize(), booster.getSubsamplingRate(),
        _columns(booster.getFeatureSubsetStrategy(), features), booster.getSeed(), splits,
        booster.getMinInstancesPerNode(), booster.getMinInfoGain(), 16.0 * n * max(heaviest, 1.0), blocks == 1,
        shared_folder(spark, "boosting"),
    )
    dealt = packed.repartitionById(tasks, F.floor(F.col("block") * tasks / blocks).cast("int"))
    folder = shared_folder(spark, "booster")
    dealt.mapInArrow(_grower(plan), NODES, barrier=True).write.parquet(f"{folder}/data")
    _delete(spark, plan.folder)
    return _loaded(spark, folder, booster, features)


def _delete(spark: SparkSession, folder: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _loaded(spark: SparkSession, folder: str, booster: GBTClassifier, features: int) -> GBTClassificationModel:
    """The model whose nodes lie in ``folder``, with the settings of its learner, read as a stored one."""
    own = {p.name: v for p, v in booster._paramMap.items()}
    of_trees = {k: own[k] for k in ("checkpointInterval", "featuresCol", "labelCol", "maxDepth", "seed", "weightCol") if k in own}

    def described(kind: str, uid: str, settings: dict, defaults: dict, **more) -> str:
        said = {"class": f"org.apache.spark.ml.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
        return json.dumps({**said, "uid": uid, "paramMap": settings, "defaultParamMap": defaults, **more})

    trees = booster.getMaxIter()
    defaults = {p.name: v for p, v in booster._defaultParamMap.items()}
    whole = described("classification.GBTClassificationModel", booster.uid, own, defaults, numFeatures=features, numTrees=trees)
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{folder}/metadata")
    each = [
        (k, described("regression.DecisionTreeRegressionModel", f"{booster.uid}_{k}", of_trees, {}), booster.getStepSize() if k else 1.0)
        for k in range(trees)
    ]
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{folder}/treesMetadata")
    model = GBTClassificationModel.load(folder)
    _delete(spark, folder)
    return model
