"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are positives; every other text, labelled or not, is unlabelled: a mixture that
holds toxic ones at the class prior. A linear model over which words a text has is fitted in numpy by
the class-prior-corrected risk  prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)),
stepping back up where the bracket falls below zero (non-negative PU learning). Whole texts are scored.

Positives are at most POSITIVES labelled documents, by the order of a hash. Everything else covers the
whole training fold: the class prior counts all its labels, words are counted in all its documents, and
every one of them is unlabelled text of the fit. Documents with the same words are one weighted row,
such rows are dealt to shards of some SHARD, every shard is fitted by itself, and the weights are
averaged; one shard is the exact fit. Scoring covers every row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_chunks, cut, held_out, table, texts

#: The bounds of what a fit takes: labelled documents, and words of the model.
POSITIVES, MOST_WORDS = 4000, 1024
#: Distinct rows of a shard, about.
SHARD = 20_000
#: Integer steps of a weight in averages.
WEIGHT_STEPS = 1 << 32
#: A word is a feature if it is in that many positives, its rate there exceeds the unlabelled rate by so many standard errors, and
#: by Bayes' rule from the class prior a text with it is toxic with that probability (one unlabelled text more is counted).
LEAST_TEXTS, LEAST_Z, LEAST_POSTERIOR = 3, 4.0, 0.6
STEPS, RATE, SHRINK = 400, 0.1, 5e-3
THRESHOLD = 0.3
#: Lengths of the word beginnings that are features too: a root counts in all its endings.
STEMS = (4, 5, 7)
#: The prior where no label says anything.
DEFAULT_PRIOR = 0.1

_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 48 or 57 < b < 65 or 90 < b < 97 or 122 < b < 128 else b for b in range(256))


def words(text: str) -> set[bytes]:
    """The distinct words of a whole text, ASCII letters in lower case and ASCII punctuation as space, and their beginnings of STEMS bytes, marked by a star."""
    found = set(text.encode().translate(_FOLD).split())
    for n in STEMS:
        found |= {b"*" + w[:n] for w in found if len(w) > n and w[0] != 42}
    return found


def fold(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from."""
    return docs.filter(~held_out("doc_id", 4))


def positives(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """text of at most POSITIVES confirmed toxic documents (an id with several texts: the last by their order), and the class prior over all labels; of the training fold alone."""
    known = fold(labels).filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    chosen = cut(known.filter("toxic = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(POSITIVES))  # small enough to broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    return cut(rows.select("text")), min(max(prior if prior is not None else DEFAULT_PRIOR, 0.01), 0.9)


def word_counts(rows: DataFrame, of: set[bytes] | None = None) -> dict[bytes, int]:
    """In how many rows' texts each word is, and as b" ", which is no word, how many rows there are. of: the only words that count; else all with LEAST_TEXTS. Tasks add up before a row a word leaves them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in texts(batch, "text"):
                seen[b" "] += 1
                seen.update(words(text) if of is None else words(text) & of)
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()), "n": pa.array(seen.values(), pa.int64())})

    counts = rows.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counts.filter(f"n >= {LEAST_TEXTS} OR word = X'20'").collect()}


def choose_words(toxic: DataFrame, unlabelled: DataFrame, prior: float) -> list[bytes]:
    """The words that mark positives, most telling first. Only those of LEAST_TEXTS positives, which are at most POSITIVES, are counted in all unlabelled texts."""
    p = word_counts(toxic)
    n_p = p.pop(b" ", 0)
    if not p:
        return []
    u = word_counts(unlabelled, {*p})
    n_u = u.pop(b" ", 0)
    if not n_u:
        return []
    telling = []
    for word, in_p in p.items():
        in_u = u.get(word, 0)
        both = (in_p + in_u) / (n_p + n_u)
        z = (in_p / n_p - in_u / n_u) / np.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u)) if both < 1 else 0.0
        if z >= LEAST_Z and prior * in_p / n_p >= LEAST_POSTERIOR * (in_u + 1) / n_u:
            telling.append((-z, word))
    return [w for _, w in sorted(telling)[:MOST_WORDS]]


def fit(rows: list[np.ndarray], positive: np.ndarray, n_words: int, prior: float, times: np.ndarray | None = None, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias by the non-negative risk estimator with the logistic loss; rows: each text's word numbers; times: how many texts each row is."""
    weight, bias = np.zeros(n_words), float(np.log(prior / (1 - prior)))
    times = np.ones(len(rows)) if times is None else times
    n_p, n_u = float(times[positive].sum()), float(times[~positive].sum())
    if not n_p or not n_u:
        return weight, bias
    share = times / np.where(positive, n_p, n_u)
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    column = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), size)
    # Adam's running moments, for the weights and (last) the bias
    first, second = np.zeros(n_words + 1), np.zeros(n_words + 1)
    for step in range(1, steps + 1):
        z = bias + np.bincount(row, weight[column], len(rows))
        s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        low = np.logaddexp(0, z) * share  # loss as a negative; its slope is s, and s - 1 as a positive
        excess = low[~positive].sum() - prior * low[positive].sum()
        as_negative = np.where(positive, -prior * s, s) * share
        slope = np.where(positive, prior * (s - 1) * share, 0) + as_negative if excess >= 0 else -as_negative
        gradient = np.append(np.bincount(column, slope[row], n_words) + SHRINK * prior * weight, slope.sum())
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        change = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        weight, bias = weight - change[:-1], bias - change[-1]
    return weight, bias


def _features(rows: DataFrame, chosen: list[bytes]) -> DataFrame:
    """features (the numbers of the chosen words that a text has, ascending) and n, how many texts have just these."""
    number = {w: i for i, w in enumerate(chosen)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            seen.update(tuple(sorted(number[w] for w in words(x) & number.keys())) for x in texts(batch, "text"))
        yield pa.RecordBatch.from_pydict({"features": pa.array(list(seen), pa.list_(pa.int32())), "n": pa.array(seen.values(), pa.int64())})

    return rows.select("text").mapInArrow(run, "features array<int>, n long").groupBy("features").agg(F.sum("n").alias("n"))


def sharded(rows: DataFrame) -> DataFrame:
    """rows(features, n) as shard, features, times: each shard stands for all rows. What is there as often as there are shards is in all of them in equal parts, the rest in one by its hash."""
    shards = max(1, rows.count() // SHARD)
    often = F.col("n") >= shards
    spread = rows.withColumn("shard", F.explode(F.when(often, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(F.pmod(F.xxhash64("features"), F.lit(shards)).cast("int")))))
    return spread.select("shard", "features", F.when(often, F.col("n") / shards).otherwise(F.col("n")).cast("double").alias("times"))


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict[bytes, float], float]:
    """The model: a weight for each chosen word, and the bias."""
    toxic, prior = positives(docs, labels)
    unlabelled = fold(docs)
    chosen = choose_words(toxic, unlabelled, prior)
    if not chosen:
        return {}, float(np.log(prior / (1 - prior)))
    own = sorted((tuple(r["features"]), r["n"]) for r in _features(toxic, chosen).collect())  # POSITIVES rows at most

    def shard(t: pa.Table) -> pa.Table:
        found = sorted(zip(map(tuple, t.column("features").to_pylist()), t.column("times").to_pylist(), strict=True))  # sums don't depend on partitions then
        rows = [np.array(f, np.int64) for f, _ in own + found]
        weight, bias = fit(rows, np.arange(len(rows)) < len(own), len(chosen), prior, np.array([float(n) for _, n in own + found]))
        size = sum(n for _, n in found)
        values = np.rint(np.append(weight, bias) * WEIGHT_STEPS).astype(np.int64)
        return pa.table({"i": pa.array(np.arange(len(values)), pa.int32()), "value": pa.array(values), "size": pa.array(np.full(len(values), size))})

    fitted = sharded(cut(_features(unlabelled, chosen))).groupBy("shard").applyInArrow(shard, "i int, value long, size double")
    mean = fitted.groupBy("i").agg((F.sum(F.col("value") * F.col("size")) / F.sum("size")).alias("value")).collect()  # a row a word
    values = {r["i"]: r["value"] / WEIGHT_STEPS for r in mean}
    return {w: values[i] for i, w in enumerate(chosen)}, values[len(chosen)]


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text); labels: doc_id, toxic; other columns are ignored.

    Null and empty texts get the score of a text without a marking word. A document with several
    labels is toxic if one says so; null labels say nothing; without labels all scores are the
    prior's. Repeated rows score alike, and count again as unlabelled text; long texts are read whole.
    Words that mark positives equally well go by their bytes. An empty table gives none.
    """
    weights, bias = train(docs, labels)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_chunks(batches, "text", 16 << 20):
            z = np.array([sum(sorted(weights[w] for w in words(x) & weights.keys())) for x in texts(batch, "text")], float) + bias
            score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": score, "predicted": (score >= THRESHOLD).astype(np.int32)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", held_out("doc_id", 4).alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op2_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
