"""Random forests for several classes: distributed counts, all trees grown together, level by level.

Features are cut into bins once, at quantiles of the training rows by their weights, and rows with the same bins and
label become one cell with their number. A tree takes each row Poisson(1) times, so it takes a cell of
n rows Poisson(n) times: a cell's draws are those of its rows, summed. A pass over the cells counts what
each open node has by (feature, bin, class), one shuffle brings a node's counts together, running sums
over the bins give the gain of every cut, and the driver gets one row a node, its best cut.

Draws go by a cell's hash and counts are integers, so the trees don't depend on partitions or on the
order of rows. As in spark.ml: Gini impurity, counts weighted by class, the square root of the number of
features tried at each node, leaves of one parent that predict the same class joined, and leaves that
vote with their shares of the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomline.operators import boosting
from fathomline.session import cut, importable

#: Cells that are looked at together, cells of a task, and gains that are no more than rounding.
BLOCK, PER_TASK, NOISE = 2048, 16_384, 1e-12
#: Quantiles of a class, which are joined by the classes' weights; accuracy of their sketches.
GRID, ACCURACY = 1000, 20_000


@dataclass(frozen=True)
class Params:
    trees: int = 500
    depth: int = 14
    bins: int = 32
    least_rows: int = 2
    seed: int = 42


@dataclass
class Model:
    """Nodes of all trees, in arrays: the first are the roots, a node's right child comes after its left one."""

    features: list[str]
    edges: list[list[float]]  # of each feature, ascending: bin i holds what is above edge i - 1 and not above edge i
    weights: list[float]  # of each class
    params: Params
    feature: np.ndarray  # -1: a leaf
    edge: np.ndarray
    left: np.ndarray
    counts: np.ndarray  # node, class

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node that each tree has each row of bins (row, feature) end in: tree, row."""
        at = np.repeat(np.arange(self.params.trees), len(bins))
        row = np.tile(np.arange(len(bins)), self.params.trees)
        going = np.arange(len(at))
        while len(going):
            f = self.feature[at[going]]
            going, f = going[f >= 0], f[f >= 0]
            node = at[going]
            at[going] = self.left[node] + (bins[row[going], f] > self.edge[node])
        return at.reshape(self.params.trees, len(bins))

    def votes(self) -> np.ndarray:
        """node, class: a node's weighted shares of the classes."""
        share = self.counts * np.array(self.weights)
        return share / np.maximum(share.sum(1, keepdims=True), 1e-300)


def edges_of(train: DataFrame, features: list[str], label: str, weights: list[float], bins: int) -> list[list[float]]:
    """At most bins - 1 weighted quantiles of each feature, from one aggregation over all rows; the middles between all values, if there are as few."""
    at = [(i + 0.5) / GRID for i in range(GRID)]
    sketches = (F.percentile_approx(F.col(f"`{c}`").cast("double"), at, ACCURACY).alias(f"q{j}") for j, c in enumerate(features))
    classes = train.groupBy(F.col(label).alias("y")).agg(F.count("*").alias("n"), *sketches).collect()  # a row a class
    out = []
    for j in range(len(features)):
        found = [(r[f"q{j}"], r["n"] * weights[r["y"]]) for r in classes if r[f"q{j}"]]
        values, of = np.unique(np.array([x for x, _ in found]).ravel(), return_inverse=True)
        upto = np.bincount(of.ravel(), np.repeat([w for _, w in found], GRID)).cumsum() if found else np.zeros(0)
        middles, edges = (values[1:] + values[:-1]) / 2, []
        if len(values) <= bins:
            edges = middles.tolist()
        else:
            for i, middle in enumerate(middles.tolist()):  # an edge before the value that would lead further away from the next share
                wanted = upto[-1] / bins * (len(edges) + 1)
                if abs(upto[i] - wanted) < abs(upto[i + 1] - wanted):
                    edges.append(middle)
        out.append(edges)
    return out


def cells_of(train: DataFrame, features: list[str], label: str, edges: list[list[float]]) -> DataFrame:
    """bins, y, n, key: the distinct rows of bins and label, in partitions by their number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = boosting.binned([b.column(f"f{j}").to_numpy(zero_copy_only=False) for j in range(len(features))], edges)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in found], pa.binary()), b.column("y")], names=["bins", "y"])

    importable(train.sparkSession)
    chosen = train.select(F.col(label).cast("int").alias("y"), *(F.col(f"`{c}`").cast("double").alias(f"f{j}") for j, c in enumerate(features)))
    counted = cut(chosen.mapInArrow(run, "bins binary, y int").groupBy("bins", "y").agg(F.count("*").alias("n")).withColumn("key", F.xxhash64("bins", "y")))
    tasks = max(1, math.ceil(counted.count() / PER_TASK))
    dealt = counted.rdd.getNumPartitions()
    return counted if tasks == dealt else cut(counted.coalesce(tasks) if tasks < dealt else counted.repartition(tasks, "key"))


def draws(keys: Iterable[int], n: Iterable[int], p: Params) -> np.ndarray:
    """cell, tree: how often a tree takes a cell's rows."""
    return np.array([np.random.default_rng([p.seed, k % 2**64]).poisson(times, p.trees) for k, times in zip(keys, n, strict=True)]).reshape(-1, p.trees)


def _counted(cells: DataFrame, model: Model, open_nodes: np.ndarray, tried: np.ndarray) -> DataFrame:
    """node, feature, bin, n0, n1 .. (of each class), of open nodes and the features tried at each; a node's rows are those of several blocks."""
    features, classes = len(model.features), len(model.weights)
    width = max(map(len, model.edges)) + 1
    place = np.full(len(model.feature), -1)
    place[open_nodes] = np.arange(len(open_nodes))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                bins = np.frombuffer(b"".join(b.column("bins").to_pylist()), np.uint16).reshape(-1, features)
                taken = draws(b.column("key").to_pylist(), b.column("n").to_pylist(), model.params).T
                slot = place[model.leaves(bins)]
                tree, row = np.nonzero((slot >= 0) & (taken > 0))
                slot, taken, y = slot[tree, row], taken[tree, row], b.column("y").to_numpy()[row]
                for j in range(tried.shape[1]):
                    f = tried[slot, j]
                    keys, of = np.unique((slot * features + f) * width + bins[row, f], return_inverse=True)
                    sums = np.bincount(of * classes + y, taken, len(keys) * classes).astype(np.int64).reshape(-1, classes)  # below 2**53: exact
                    columns = [open_nodes[keys // width // features], keys // width % features, keys % width]
                    yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in columns), *(pa.array(sums[:, k]) for k in range(classes))], names=["node", "feature", "bin", *(f"n{k}" for k in range(classes))])

    return cells.mapInArrow(run, "node int, feature int, bin int, " + ", ".join(f"n{k} long" for k in range(classes)))


def best_cuts(counted: DataFrame, weights: list[float], p: Params) -> DataFrame:
    """node, its counts a0, a1 .. and, null if no cut leaves enough rows and gains anything, its cut of the highest gain: feature, bin (they decide ties), counts l0, l1 .. of its left side."""
    classes = range(len(weights))
    sums = counted.repartition("node").groupBy("node", "feature", "bin").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in classes))
    of = W.partitionBy("node", "feature")
    upto = of.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    h = sums.withColumns({f"l{k}": F.sum(f"n{k}").over(upto) for k in classes} | {f"a{k}": F.sum(f"n{k}").over(of) for k in classes})

    def total(values: Iterable[Column]) -> Column:
        first, *more = values
        for x in more:
            first = first + x
        return first

    def impurity(counts: list[Column]) -> Column:
        """Gini times weight."""
        weighted = [c * F.lit(float(w)) for c, w in zip(counts, weights, strict=True)]
        return total(weighted) - F.coalesce(F.try_divide(total(w * w for w in weighted), total(weighted)), F.lit(0.0))

    left, both = [F.col(f"l{k}") for k in classes], [F.col(f"a{k}") for k in classes]
    right = [a - b for a, b in zip(both, left, strict=True)]
    gain = F.try_divide(impurity(both) - impurity(left) - impurity(right), total(c * F.lit(float(w)) for c, w in zip(both, weights, strict=True)))
    order = F.when((total(left) >= p.least_rows) & (total(right) >= p.least_rows) & (gain > NOISE), F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b")))
    best = h.groupBy("node").agg(*(F.max(f"a{k}").alias(f"a{k}") for k in classes), F.max_by(F.struct("feature", "bin", *left), order).alias("best"))
    return best.select("node", *both, "best.*")


def fit(train: DataFrame, features: list[str], label: str, weights: list[float], params: Params | None = None) -> Model:
    """A forest of train's rows: features (numbers or booleans; null is the smallest), label (0 to classes - 1), a weight a class.

    Without rows every tree is an empty leaf, and all classes are alike unlikely. A class without rows has share zero.
    """
    p = params or Params()
    edges = edges_of(train, features, label, weights, p.bins)
    roots = np.arange(p.trees)
    model = Model(list(features), edges, list(weights), p, np.full(p.trees, -1), np.zeros(p.trees, int), np.zeros(p.trees, int), np.zeros((p.trees, len(weights)), np.int64))
    cells = cells_of(train, features, label, edges)
    cuts, open_nodes, tries = [], roots, math.ceil(math.sqrt(len(features)))
    for level in range(p.depth + 1):
        if not len(open_nodes):
            break
        tried = np.random.default_rng([p.seed, level]).random((len(open_nodes), len(features))).argsort(1)[:, :tries]
        # a row a node
        found = best_cuts(_counted(cells, model, open_nodes, tried), weights, p).toArrow().sort_by("node")
        columns = {c: found.column(c).to_numpy() for c in found.column_names if c != "feature"}
        node, of = columns["node"], lambda side, columns=columns: np.stack([columns[f"{side}{k}"] for k in range(len(weights))], 1)
        model.counts[node] = of("a")
        if level == p.depth:
            break
        here = found.column("feature").is_valid().to_numpy()
        node, left = node[here], of("l")[here].astype(np.int64)
        model.feature[node], model.edge[node] = found.column("feature").drop_null().to_numpy(), columns["bin"][here]
        cuts.append(node)
        first = len(model.feature) + 2 * np.arange(len(node))
        model.left[node] = first
        sides = np.stack([left, model.counts[node] - left], 1).reshape(-1, len(weights))
        model.feature, model.edge, model.left = (np.concatenate([a, np.full(len(sides), fill)]) for a, fill in ((model.feature, -1), (model.edge, 0), (model.left, 0)))
        model.counts = np.concatenate([model.counts, sides])
        worth = (sides.sum(1) >= 2 * p.least_rows) & ((sides > 0).sum(1) > 1) & (level + 1 < p.depth)
        open_nodes = np.stack([first, first + 1], 1).reshape(-1)[worth]
    predicted = model.votes().argmax(1)
    for node in reversed(cuts):
        left = model.left[node]
        same = (model.feature[left] < 0) & (model.feature[left + 1] < 0) & (predicted[left] == predicted[left + 1])
        model.feature[node[same]] = -1
    return model


def predict(model: Model, df: DataFrame) -> DataFrame:
    """df with the class probabilities s0.. and y_pred, the first of the most likely classes."""
    names, own = [f"s{k}" for k in range(len(model.weights))], df.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = model.votes()
        for batch in batches:
            bins = boosting.binned([batch.column(f"_f{j}").to_numpy(zero_copy_only=False) for j in range(len(model.features))], model.edges)
            cells, of = np.unique(bins, axis=0, return_inverse=True)
            share = np.zeros((len(cells), len(names)))
            for at in range(0, len(cells), BLOCK):
                for nodes in model.leaves(cells[at:at + BLOCK]):
                    share[at:at + BLOCK] += votes[nodes]
            share = (share / np.maximum(share.sum(1, keepdims=True), 1e-300))[of.reshape(-1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *(pa.array(share[:, k]) for k in range(len(names))), pa.array(share.argmax(1).astype(np.int32))], [*own, *names, "y_pred"])

    importable(df.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    extended = df.select("*", *(F.col(f"`{c}`").cast("double").alias(f"_f{j}") for j, c in enumerate(model.features)))
    return extended.mapInArrow(run, f"{kinds}, {', '.join(f'{c} double' for c in names)}, y_pred int")
