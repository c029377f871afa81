"""Shapley attribution of the boosted-tree model, per scored row.

A leaf contributes its value when a row meets every condition on its path. For
a subset of known features the expected contribution is a product: 1 or 0 for
each known feature (does the row meet its conditions?) and the share of
training weight that follows the path for each unknown one. The Shapley value
of a feature weighs these products over all subsets of the others, which is the
integral over t from 0 to 1 of the product of ``share * (1 - t) + met * t``
over the other features. That is a polynomial of a degree below the number of
features on the path, so a few Gauss points give it exactly: the cost of a leaf
grows with the square of its path, not with its subsets.

What a leaf gives a row depends on nothing but which of the path's features the
row meets. For paths of a few features this is worked out once for every such
pattern, and rows look it up.

Workers get the trees alone, as arrays of nodes; the paths of one tree at a
time are laid out beside the rows of an Arrow batch.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.constants import FEATURE_COLUMNS
from cohortlens.session import shared_folder

#: Numbers in one block of (rows x leaves x path features), numbers of laid-out paths kept between batches, and the
#: most features of paths whose patterns are worked out beforehand.
_BLOCK, _KEPT, _TABLE = 1 << 18, 1 << 23, 6

#: Rows that one task explains: it lays out all trees, which takes as long as some thousand rows.
TASK_ROWS, MOST_TASKS = 10_000, 10_000

#: One node of a tree; ``left`` is -1 at a leaf.
NODE = np.dtype(
    [("value", "f8"), ("weight", "f8"), ("left", "i4"), ("right", "i4"), ("feature", "i4"), ("threshold", "f8")]
)


def tree_nodes(spark: SparkSession, model: PipelineModel) -> list[np.ndarray]:
    """The nodes of every tree as the stored model lists them; leaf values in log-odds."""
    folder = shared_folder(spark, "booster")
    model.stages[-1].save(folder)
    stored = spark.read.parquet(f"{folder}/data").select(
        "treeID",
        "nodeData.id",
        "nodeData.prediction",
        F.col("nodeData.impurityStats")[0].alias("weight"),
        "nodeData.leftChild",
        "nodeData.rightChild",
        "nodeData.split.featureIndex",
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    )
    rows = defaultdict(dict)
    for tree, number, value, *rest in stored.collect():  # bounded by the model's size
        # twice the margin of the ensemble is the log-odds
        rows[tree][number] = (2.0 * value * model.stages[-1].treeWeights[tree], *rest[:-1], np.nan if rest[-1] is None else rest[-1])
    return [np.array([found[n] for n in range(len(found))], NODE) for _, found in sorted(rows.items())]


class Paths:
    """The leaves of a tree whose paths hold ``k`` features: value, and for each
    feature the bounds within which a row follows the path and the share of
    training weight that does."""

    def __init__(self, values, features, lows, highs, shares):
        self.values, self.features, self.lows, self.highs, self.shares = values, features, lows, highs, shares
        self.patterns = None

    def size(self) -> int:
        """Numbers that are kept with the paths."""
        leaves, k = self.features.shape
        return self.features.size * (1 + (2**k if k <= _TABLE else 0))


def leaf_paths(nodes: np.ndarray) -> list[Paths]:
    """Paths to the leaves of a tree, grouped by their number of features."""
    found, open_nodes = defaultdict(list), [(0, {})]
    while open_nodes:
        number, bounds = open_nodes.pop()
        node = nodes[number]
        if node["left"] < 0:
            found[len(bounds)].append((node["value"], list(bounds), list(bounds.values())))
            continue
        feature, threshold = int(node["feature"]), node["threshold"]
        low, high, share = bounds.get(feature, (-np.inf, np.inf, 1.0))
        for child, inside in ((node["left"], (low, min(high, threshold))), (node["right"], (max(low, threshold), high))):
            part = share * nodes[child]["weight"] / node["weight"] if node["weight"] else 0.0
            open_nodes.append((int(child), {**bounds, feature: (*inside, part)}))
    groups = []
    for k, members in sorted(found.items()):
        values, features, ranges = zip(*members)
        lows, highs, shares = np.moveaxis(np.array(ranges, float).reshape(len(members), k, 3), 2, 0)
        groups.append(Paths(np.array(values, float), np.array(features, np.int64).reshape(len(members), k), lows, highs, shares))
    return groups


def base_value(trees: list[np.ndarray]) -> float:
    """Mean log-odds of the model over its training weight."""
    return float(sum((p.values * p.shares.prod(axis=1)).sum() for nodes in trees for p in leaf_paths(nodes)))


def _by_pattern(met: np.ndarray, paths: Paths) -> np.ndarray:
    """Shapley values (rows x leaves x path features) of rows that meet the features ``met`` of each leaf."""
    k = paths.features.shape[1]
    points, weights = np.polynomial.legendre.leggauss((k + 1) // 2)
    points, weights = (points + 1) / 2, weights / 2
    # a condition that nobody followed and the row does not meet leaves nothing of the leaf
    void = ((met == 0) & (paths.shares == 0)).any(axis=2)
    total = np.zeros_like(met)
    for t, w in zip(points, weights):
        factor = paths.shares * (1 - t) + met * t
        factor[factor == 0] = 1.0
        total += w * factor.prod(axis=2)[:, :, None] / factor
    total *= (met - paths.shares) * np.where(void, 0.0, paths.values)[:, :, None]
    return total


class Patterns:
    """For each feature: its bounds on the paths, the pattern bits of every leaf between two bounds, and what each
    leaf that has the feature gives to it by pattern."""

    def __init__(self, paths: Paths):
        leaves, k = paths.features.shape
        numbers = np.arange(2**k)
        met = (numbers[:, None] >> np.arange(k) & 1).astype(float)[:, None, :]
        given = _by_pattern(np.repeat(met, leaves, axis=1), paths)
        self.features = []
        for f in np.unique(paths.features):
            leaf, j = np.nonzero(paths.features == f)
            low, high = paths.lows[leaf, j], paths.highs[leaf, j]
            edges = np.unique(np.concatenate([low, high]))
            edges = edges[np.isfinite(edges)]
            # a value has so many edges below it; it is above a bound that is one of them
            below = np.arange(len(edges) + 1)[:, None]
            inside = (below > np.where(np.isinf(low), -1, np.searchsorted(edges, low))) & (
                below <= np.where(np.isinf(high), len(edges), np.searchsorted(edges, high))
            )
            bits = (inside << j).T.astype(np.intp)
            starts = np.arange(len(leaf))[:, None] * 2**k
            self.features.append((int(f), edges, bits, leaf, starts, given[:, leaf, j].T.ravel()))
        self.leaves = leaves

    def add(self, x: np.ndarray, out: np.ndarray) -> None:
        pattern = np.zeros((self.leaves, len(x)), np.intp)
        for f, edges, bits, leaf, *_ in self.features:
            pattern[leaf] += bits.take(np.searchsorted(edges, x[:, f]), axis=1, mode="clip")
        for f, _, _, leaf, starts, given in self.features:
            out[:, f] += given.take(pattern[leaf] + starts, mode="clip").sum(axis=0)


def path_attributions(x: np.ndarray, paths: Paths, out: np.ndarray) -> None:
    """Adds to ``out`` the Shapley values of every row for the leaves of ``paths``."""
    leaves, k = paths.features.shape
    if not k:
        return
    step = max(1, _BLOCK // (leaves * k))
    if k <= _TABLE:
        if paths.patterns is None:
            paths.patterns = Patterns(paths)
        for at in range(0, len(x), step):
            paths.patterns.add(x[at : at + step], out[at : at + step])
        return
    one_hot = np.zeros((leaves * k, x.shape[1]))
    one_hot[np.arange(leaves * k), paths.features.ravel()] = 1.0
    for at in range(0, len(x), step):
        seen = x[at : at + step][:, paths.features]
        met = ((seen > paths.lows) & (seen <= paths.highs)).astype(float)
        total = _by_pattern(met, paths)
        out[at : at + step] += total.reshape(len(total), leaves * k) @ one_hot


def _laid_out(trees: list[np.ndarray], kept: dict[int, list[Paths]]) -> Iterator[list[Paths]]:
    """Paths tree by tree; those of the first trees are kept for the next batch."""
    held = sum(p.size() for groups in kept.values() for p in groups)
    for number, nodes in enumerate(trees):
        groups = kept.get(number)
        if groups is None:
            groups = leaf_paths(nodes)
            size = sum(p.size() for p in groups)
            if held + size <= _KEPT:
                kept[number], held = groups, held + size
        yield groups


def attributions(model: PipelineModel, features: DataFrame, key: str = "nct_id") -> DataFrame:
    """Log-odds attribution of every feature per row, with the common ``base``.

    The attributions of a row and the base add up to its log-odds. What is
    broadcast are the model's nodes, some 40 bytes each.
    """
    spark = features.sparkSession
    trees = tree_nodes(spark, model)
    base = base_value(trees)
    shared = spark.sparkContext.broadcast(trees)
    names = list(FEATURE_COLUMNS)

    def explain(frames):
        kept: dict[int, list[Paths]] = {}
        for frame in frames:
            x = frame[names].to_numpy(dtype=float)
            out = np.zeros_like(x)
            for groups in _laid_out(shared.value, kept):
                for paths in groups:
                    path_attributions(x, paths, out)
            result = pd.DataFrame(out, columns=names)
            result.insert(0, key, frame[key].to_numpy())
            yield result.assign(base=base)

    kind = features.schema[key].dataType.simpleString()
    schema = ", ".join([f"{key} {kind}", *[f"{n} double" for n in names], "base double"])
    rows = features.select(key, *names)
    tasks = min(MOST_TASKS, max(1, -(-rows.count() // TASK_ROWS)))
    return rows.repartition(tasks).mapInPandas(explain, schema)


def mean_attribution(explained: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature, strongest first."""
    means = explained.agg(*[F.avg(F.abs(F.col(n))).alias(n) for n in FEATURE_COLUMNS])
    return means.unpivot([], list(FEATURE_COLUMNS), "feature", "importance").orderBy(
        F.desc("importance"), "feature"
    )
