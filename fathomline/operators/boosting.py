"""Gradient-boosted trees for several classes: distributed histograms, leaf-wise growth, early stop.

Features are cut into bins once, at quantiles of the training rows; rows then travel as blocks of
bytes. A boosting round grows one tree a class, all of them together: a pass over the blocks adds up each
row's gradient and Hessian of the softmax loss by (class, node, feature, bin), one aggregation sums the
tasks' histograms, running sums over a feature's bins give the gain of every cut, and the driver gets
one row a node, its best cut. Growth is leaf-wise: the leaf of the highest gain is cut next, until there
are enough leaves. A node's best cut doesn't depend on the order of growth, so each pass looks at
all nodes that the growth may reach next, and a tree needs a pass a level rather than one a leaf.

Gradients are summed as integers, so the trees don't depend on partitions or on the order of sums.
Validation rows are in the same blocks and only count for the loss, by which the rounds stop. Raw
scores are written back to the blocks, in the shared checkpoint folder, every REFRESH rounds.
"""

from __future__ import annotations

import heapq
import json
import random
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomline.session import cut, importable

#: Rows of a block, rounds between writes of the scores, integer steps of a gradient.
BLOCK, REFRESH, STEPS = 4096, 8, 1 << 20
BLOCKS = "id binary, bins binary, y binary, w binary, valid binary, raw binary"
#: The class of the rows that hold the loss instead of a histogram.
LOSS = -1


@dataclass(frozen=True)
class Params:
    """As the classifier of the training scripts has them; subsample takes effect with subsample_freq only (0: every row counts in every round)."""

    rounds: int = 2000
    rate: float = 0.05
    leaves: int = 64
    depth: int = -1
    least_rows: int = 20
    least_hessian: float = 1e-3
    l1: float = 0.0
    l2: float = 0.0
    least_gain: float = 0.0
    subsample: float = 0.9
    subsample_freq: int = 0
    columns: float = 0.9
    bins: int = 255
    patience: int = 100
    seed: int = 42


@dataclass
class Tree:
    """cuts: node -> (feature, bin, left, right), parents before children; values of the leaves, the rate included."""

    cuts: dict[int, tuple[int, int, int, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)
    gains: dict[int, float] = field(default_factory=dict)

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row of bins (row, feature) ends in."""
        at = np.zeros(len(bins), np.int32)
        for node, (feature, edge, left, right) in self.cuts.items():
            here = np.flatnonzero(at == node)
            at[here] = np.where(bins[here, feature] <= edge, left, right)
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        table = np.zeros(max(self.values) + 1)
        table[list(self.values)] = list(self.values.values())
        return table[self.leaf(bins)]


@dataclass
class Model:
    features: list[str]
    classes: int
    edges: list[list[float]]  # of each feature, ascending: bin i holds what is above edge i - 1 and not above edge i
    base: list[float]
    rounds: list[list[Tree]]  # those up to the best round
    best_round: int  # from 1
    history: list[dict[str, float]]  # train and valid loss after each round
    params: Params

    def bins(self, columns: list[np.ndarray]) -> np.ndarray:
        """Nulls are the smallest value."""
        return binned(columns, self.edges)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.tile(np.array(self.base), (len(bins), 1))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                out[:, k] += tree.predict(bins)
        return out

    def importance(self, kind: str = "split") -> dict[str, float]:
        """By feature, how many cuts it makes, or (gain) what they gain."""
        out = dict.fromkeys(self.features, 0.0)
        for tree in (t for trees in self.rounds for t in trees):
            for node, (feature, *_) in tree.cuts.items():
                out[self.features[feature]] += 1 if kind == "split" else tree.gains[node]
        return out

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Model:
        v = json.loads(text)
        whole = lambda d: {int(k): tuple(x) if isinstance(x, list) else x for k, x in d.items()}
        v["rounds"] = [[Tree(*(whole(t[c]) for c in ("cuts", "values", "gains"))) for t in trees] for trees in v["rounds"]]
        return cls(**v | {"params": Params(**v["params"])})


def binned(columns: list[np.ndarray], edges: list[list[float]]) -> np.ndarray:
    """row, column: the bin of each value; NaN (null) is the smallest value."""
    out = np.zeros((len(columns[0]) if columns else 0, len(columns)), np.uint16)
    for j, (x, e) in enumerate(zip(columns, edges, strict=True)):
        out[:, j] = np.searchsorted(np.array(e), np.where(np.isnan(x), -np.inf, x), side="left")
    return out


def softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def mixed(ids: np.ndarray, salt: int) -> np.ndarray:
    """A number from 0 to 1 for each id, for one round."""
    x = ids.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
    for shift in (30, 27):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(11)).astype(float) / 2**53


@dataclass
class Block:
    """A block's rows as arrays."""

    id: np.ndarray
    bins: np.ndarray
    y: np.ndarray
    w: np.ndarray
    valid: np.ndarray
    raw: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, features: int, classes: int) -> Iterator[Block]:
        for r in batch.to_pylist():
            kinds = {"id": np.int64, "bins": np.uint16, "y": np.int8, "w": float, "valid": bool, "raw": float}
            v = {c: np.frombuffer(r[c], k) for c, k in kinds.items()}
            yield cls(v["id"], v["bins"].reshape(-1, features), v["y"], v["w"], v["valid"], v["raw"].reshape(-1, classes))


def edges_of(train: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """At most bins - 1 distinct quantiles of each feature, from one aggregation; every value, if there are as few."""
    at = [i / bins for i in range(1, bins)]
    found = train.agg(*(F.percentile_approx(F.col(f"`{c}`").cast("double"), at, 20_000).alias(str(j)) for j, c in enumerate(features))).first()
    return [sorted(set(found[str(j)] or [])) for j in range(len(features))]


def _blocks(rows: DataFrame, model: Model, label: str, weight: Column, valid: Column, row_id: Column) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                get = lambda c, b=b: b.column(c).to_numpy(zero_copy_only=False)
                bins = model.bins([get(f"f{j}").astype(float) for j in range(len(model.features))])
                raw = np.tile(np.array(model.base), (b.num_rows, 1))
                values = {"id": get("id").astype(np.int64), "bins": bins, "y": get("y").astype(np.int8), "w": get("w").astype(float), "valid": get("valid").astype(bool), "raw": raw}
                yield pa.RecordBatch.from_pydict({c: pa.array([v.tobytes()], pa.binary()) for c, v in values.items()})

    chosen = rows.select(row_id.alias("id"), F.col(label).alias("y"), weight.cast("double").alias("w"), valid.alias("valid"), *(F.col(f"`{c}`").cast("double").alias(f"f{j}") for j, c in enumerate(model.features)))
    return cut(importable(rows.sparkSession) and chosen.mapInArrow(run, BLOCKS))


def _scored(blocks: DataFrame, tail: list[list[Tree]], features: int, classes: int) -> DataFrame:
    """blocks with the scores of some more rounds."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [_raw(b, tail).tobytes() for b in Block.of(batch, features, classes)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(raw, pa.binary())], batch.schema.names)

    return cut(blocks.mapInArrow(run, BLOCKS))


def _raw(block: Block, tail: list[list[Tree]]) -> np.ndarray:
    raw = block.raw.copy()
    for trees in tail:
        for k, tree in enumerate(trees):
            raw[:, k] += tree.predict(block.bins)
    return raw


def gradients(block: Block, raw: np.ndarray, p: Params, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integer gradients and Hessians (row, class) and whether a row counts in this round."""
    share = softmax(raw)
    classes = raw.shape[1]
    g = (share - (block.y[:, None] == np.arange(classes))) * block.w[:, None]
    h = classes / (classes - 1) * share * (1 - share) * block.w[:, None]
    counts = ~block.valid & (block.w > 0)
    if p.subsample_freq:
        counts &= mixed(block.id, p.seed + number // p.subsample_freq) < p.subsample
    return np.rint(g * STEPS).astype(np.int64), np.rint(h * STEPS).astype(np.int64), counts


def _histograms(blocks: DataFrame, tail: list[list[Tree]], growing: list[Tree], wanted: list[tuple[int, int]], columns: list[list[int]], p: Params, number: int, model: Model) -> DataFrame:
    """k, node, feature, bin, g, h, n summed over all rows; and as class LOSS the loss of the model so far: node 0 for training rows and 1 for the others, g the loss, h the weight."""
    features, classes = len(model.features), model.classes
    width = max((len(e) for e in model.edges), default=0) + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, len(wanted), features * width), np.int64)
        loss = np.zeros((2, 2))
        for batch in batches:
            for b in Block.of(batch, features, classes):
                raw = _raw(b, tail)
                own = -np.log(np.maximum(softmax(raw)[np.arange(len(b.y)), b.y], 1e-300)) * b.w
                for v in (0, 1):
                    loss[v] += np.rint(own[b.valid == v] * STEPS).sum(), np.rint(b.w[b.valid == v] * STEPS).sum()
                g, h, counts = gradients(b, raw, p, number)
                ends = [tree.leaf(b.bins) for tree in growing]
                for slot, (k, node) in enumerate(wanted):
                    rows = np.flatnonzero((ends[k] == node) & counts)
                    if len(rows):
                        for f in columns[k]:
                            bins = b.bins[rows, f]
                            at = slice(f * width, (f + 1) * width)
                            # integers below 2**53 are exact in the sums of a block
                            sums[0, slot, at] += np.bincount(bins, g[rows, k], width).astype(np.int64)
                            sums[1, slot, at] += np.bincount(bins, h[rows, k], width).astype(np.int64)
                            sums[2, slot, at] += np.bincount(bins, minlength=width)
        slot, cell = np.nonzero(sums[2])
        k, node = np.array(wanted, np.int32).reshape(-1, 2)[slot].T
        extra = np.array([0, 1], np.int32)
        yield pa.RecordBatch.from_pydict({
            "k": pa.array(np.concatenate([k, np.full(2, LOSS, np.int32)]), pa.int32()), "node": pa.array(np.concatenate([node, extra]), pa.int32()),
            "feature": pa.array(np.concatenate([cell // width, [0, 0]]).astype(np.int32)), "bin": pa.array(np.concatenate([cell % width, [0, 0]]).astype(np.int32)),
            "g": pa.array(np.concatenate([sums[0, slot, cell], loss[:, 0].astype(np.int64)])), "h": pa.array(np.concatenate([sums[1, slot, cell], loss[:, 1].astype(np.int64)])), "n": pa.array(np.concatenate([sums[2, slot, cell], [0, 0]]).astype(np.int64))})

    found = blocks.mapInArrow(run, "k int, node int, feature int, bin int, g long, h long, n long")
    return found.groupBy("k", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))


def best_cuts(histograms: DataFrame, p: Params) -> DataFrame:
    """k, node, its sums g, h, n, and best: its cut of the highest gain (feature and bin decide ties), null if no cut leaves enough on both sides."""
    of = W.partitionBy("k", "node", "feature")
    upto = of.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    left = {f"{c}_left": F.sum(c).over(upto) for c in "ghn"}
    whole = {f"{c}_all": F.sum(c).over(of) for c in "ghn"}
    h = histograms.withColumns(left | whole)

    def score(g: Column, hessian: Column) -> Column:
        shrunk = F.greatest(F.abs(g) / STEPS - p.l1, F.lit(0.0))
        return shrunk * shrunk / (hessian / STEPS + p.l2)

    right = {c: F.col(f"{c}_all") - F.col(f"{c}_left") for c in "ghn"}
    enough = (F.col("n_left") >= p.least_rows) & (right["n"] >= p.least_rows) & (F.col("h_left") >= p.least_hessian * STEPS) & (right["h"] >= p.least_hessian * STEPS) & (F.col("h_left") > 0) & (right["h"] > 0)
    gain = F.when(enough, score(F.col("g_left"), F.col("h_left")) + score(right["g"], right["h"]) - score(F.col("g_all"), F.col("h_all")))
    cutting = F.struct("feature", "bin", gain.alias("gain"), *(F.col(f"{c}_left") for c in "ghn"))
    order = F.when(gain > p.least_gain, F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b")))
    return h.groupBy("k", "node").agg(F.max("g_all").alias("g"), F.max("h_all").alias("h"), F.max("n_all").alias("n"), F.max_by(cutting, order).alias("best"))


class Growth:
    """One tree as it grows. Nodes get their numbers when their parent's best cut is known."""

    def __init__(self, p: Params):
        self.p = p
        self.best: dict[int, dict | None] = {}  # by node: its cut, None if it has none
        self.sums: dict[int, tuple[int, int, int]] = {}
        self.children: dict[int, tuple[int, int]] = {}
        self.depth = {0: 0}

    def take(self, node: int, sums: tuple[int, int, int], best: dict | None) -> None:
        self.sums[node] = sums
        if self.p.depth > 0 and self.depth[node] >= self.p.depth:
            best = None
        self.best[node] = best
        if best:
            left, right = len(self.depth), len(self.depth) + 1
            self.children[node] = left, right
            of_left = (best["g_left"], best["h_left"], best["n_left"])
            for child, s in ((left, of_left), (right, tuple(a - b for a, b in zip(sums, of_left, strict=True)))):
                self.depth[child] = self.depth[node] + 1
                self.sums[child] = s
                if s[2] < 2 * self.p.least_rows:
                    self.best[child] = None

    def chosen(self) -> tuple[list[int], list[int]]:
        """The nodes that are cut, in the order of growth, as far as is known; and those met whose best cut isn't."""
        if 0 not in self.best:
            return [], [0]
        done, unknown, heap = [], [], []

        def meet(node: int) -> None:
            if node not in self.best:
                unknown.append(node)
            elif self.best[node]:
                heapq.heappush(heap, (-self.best[node]["gain"], node))

        meet(0)
        while heap and len(done) + 1 < self.p.leaves:
            node = heapq.heappop(heap)[1]
            done.append(node)
            for child in self.children[node]:
                meet(child)
        return done, unknown

    def tree(self, nodes: Iterable[int]) -> Tree:
        cuts = {n: (self.best[n]["feature"], self.best[n]["bin"], *self.children[n]) for n in nodes}
        ends = {0} if not cuts else {c for n in cuts for c in self.children[n]} - set(cuts)
        values = {}
        for n in ends:
            g, h, _ = self.sums.get(n, (0, 0, 0))
            g, h = g / STEPS, h / STEPS
            shrunk = np.sign(g) * max(abs(g) - self.p.l1, 0.0)
            values[n] = float(-self.p.rate * shrunk / (h + self.p.l2)) if h + self.p.l2 > 0 else 0.0
        return Tree(cuts, values, {n: self.best[n]["gain"] for n in cuts})


def fit(rows: DataFrame, features: list[str], label: str, classes: int, params: Params | None = None, weight: Column | None = None, valid: Column | None = None, row_id: Column | None = None) -> Model:
    """A model of rows: features (numbers or booleans; null is the smallest), label (0 to classes - 1), weight, valid (rows that count for the early stop alone). row_id is what subsampling goes by.

    Without validation rows all rounds are kept. An empty training set gives a model without trees whose
    classes are alike. A class without rows has score zero or nearly so.
    """
    p = params or Params()
    weight, valid, row_id = (F.lit(1.0) if weight is None else weight), (F.lit(False) if valid is None else valid), (F.lit(0) if row_id is None else row_id)
    rows = rows.withColumns({"_w": weight.cast("double"), "_valid": F.coalesce(valid, F.lit(False)), "_id": row_id.cast("long")})
    train = rows.filter(~F.col("_valid"))
    share = {r[label]: r["w"] for r in train.groupBy(label).agg(F.sum("_w").alias("w")).collect()}  # a row a class
    total = sum(share.values())
    base = [float(np.log(max(share.get(k, 0.0) / total, 1e-12))) if total else 0.0 for k in range(classes)]
    model = Model(list(features), classes, edges_of(train, features, p.bins), base, [], 0, [], p)
    if not total:
        return model
    blocks = _blocks(rows, model, label, F.col("_w"), F.col("_valid"), F.col("_id"))
    tail: list[list[Tree]] = []
    grown: list[list[Tree]] = []
    best, best_loss = 0, float("inf")

    def learn(found: list, number: int) -> bool:
        """Notes the loss of the rounds so far; whether they should stop."""
        nonlocal best, best_loss
        loss = {r["node"]: r["g"] / r["h"] if r["h"] else None for r in found if r["k"] == LOSS}
        if number:
            model.history.append({"round": number, "train": loss.get(0), "valid": loss.get(1)})
            if loss.get(1) is not None and loss[1] < best_loss:
                best, best_loss = number, loss[1]
        return loss.get(1) is not None and number - best >= p.patience

    for number in range(p.rounds):
        chooser = random.Random(f"{p.seed}-{number}")
        columns = [sorted(chooser.sample(range(len(features)), max(1, round(p.columns * len(features))))) for _ in range(classes)]
        trees = [Growth(p) for _ in range(classes)]
        first, stop = True, False
        while not stop:
            plans = [t.chosen() for t in trees]
            wanted = [(k, node) for k, (_, unknown) in enumerate(plans) for node in unknown]
            if not wanted:
                break
            growing = [t.tree(done) for t, (done, _) in zip(trees, plans, strict=True)]
            sums = _histograms(blocks, tail, growing, wanted, columns, p, number, model)
            # a row a node and one or two of the loss
            found = best_cuts(sums, p).collect()
            stop = first and learn(found, number)
            first = False
            known = {(r["k"], r["node"]): r for r in found if r["k"] != LOSS}
            for k, node in wanted:
                r = known.get((k, node))
                trees[k].take(node, (r["g"], r["h"], r["n"]) if r else (0, 0, 0), r["best"].asDict() if r and r["best"] else None)
        if stop:
            break
        done = [t.tree(t.chosen()[0]) for t in trees]
        grown.append(done)
        tail.append(done)
        if all(not t.cuts for t in done):
            break  # no cut gains anything any more
        if len(tail) == REFRESH:
            blocks, tail = _scored(blocks, tail, len(features), classes), []
    if len(model.history) < len(grown):  # the last round's loss
        learn(best_cuts(_histograms(blocks, tail, [Tree({}, {0: 0.0})] * classes, [], [[]] * classes, p, len(grown), model), p).collect(), len(grown))
    has_valid = bool(model.history) and model.history[-1]["valid"] is not None
    model.best_round = best if has_valid else len(grown)
    model.rounds = grown[:model.best_round]
    return model


def predict(model: Model, df: DataFrame) -> DataFrame:
    """df with the class probabilities s0.. and y_pred, the first of the most likely classes."""
    names, own = [f"s{k}" for k in range(model.classes)], df.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(f"_f{j}").to_numpy(zero_copy_only=False).astype(float) for j in range(len(model.features))]
            share = softmax(model.raw(model.bins(columns))) if batch.num_rows else np.zeros((0, model.classes))
            kept = [batch.column(c) for c in own]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(share[:, k]) for k in range(model.classes)), pa.array(share.argmax(1).astype(np.int32) if batch.num_rows else [], pa.int32())], [*own, *names, "y_pred"])

    importable(df.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    extended = df.select("*", *(F.col(f"`{c}`").cast("double").alias(f"_f{j}") for j, c in enumerate(model.features)))
    return extended.mapInArrow(run, f"{kinds}, {', '.join(f'{c} double' for c in names)}, y_pred int")
