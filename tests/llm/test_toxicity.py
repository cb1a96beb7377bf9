"""The estimator in plain loops, word counts and feature rows against brute force, shards, repeated ids."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from tests.conftest import SMALL

from fathomline.llm import toxicity


def by_hand(rows, positive, n_words, prior, times, steps):
    """Non-negative PU learning text by text: the risk, its slope in each weight, and Adam's step."""
    weight, bias = [0.0] * n_words, math.log(prior / (1 - prior))
    n_p = sum(t for t, p in zip(times, positive, strict=True) if p)
    n_u = sum(t for t, p in zip(times, positive, strict=True) if not p)
    m, v = [0.0] * (n_words + 1), [0.0] * (n_words + 1)
    back = 0
    for step in range(1, steps + 1):
        scores = [bias + sum(weight[w] for w in r) for r in rows]
        loss = lambda z: math.log1p(math.exp(z))  # noqa: E731  of a text taken as negative
        excess = sum(t * loss(z) / n_u for z, t, p in zip(scores, times, positive, strict=True) if not p) - prior * sum(t * loss(z) / n_p for z, t, p in zip(scores, times, positive, strict=True) if p)
        back += excess < 0
        g = [toxicity.SHRINK * prior * w for w in weight] + [0.0]
        for r, z, t, p in zip(rows, scores, times, positive, strict=True):
            s = 1 / (1 + math.exp(-z))
            of_negative = -prior * t / n_p * s if p else t / n_u * s  # of what the bracket holds
            of_positive = prior * t / n_p * (s - 1) if p else 0.0
            slope = of_positive + of_negative if excess >= 0 else -of_negative
            for i in [*r, n_words]:
                g[i] += slope
        for i in range(n_words + 1):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g[i], 0.999 * v[i] + 0.001 * g[i] ** 2
            change = toxicity.RATE * (m[i] / (1 - 0.9**step)) / (math.sqrt(v[i] / (1 - 0.999**step)) + 1e-9)
            if i < n_words:
                weight[i] -= change
            else:
                bias -= change
    return weight, bias, back


@pytest.mark.parametrize(("seed", "prior"), [(1, 0.3), (2, 0.05), (3, 0.8)])
def test_equals_plain_loops(seed, prior):
    r = np.random.default_rng(seed)
    rows = [sorted(r.choice(6, r.integers(0, 4), replace=False).tolist()) for _ in range(40)]
    positive, times = r.random(40) < 0.4, r.integers(1, 5, 40).astype(float)
    weight, bias = toxicity.fit([np.array(x, np.int64) for x in rows], positive, 6, prior, times, steps=60)
    expected = by_hand(rows, positive, 6, prior, times, 60)
    np.testing.assert_allclose([*weight, bias], [*expected[0], expected[1]], rtol=1e-7, atol=1e-9)
    assert (expected[2] > 0) == (prior == 0.8)  # a prior that is too high has the bracket negative, and stepped back


def test_times_are_repeats():
    rows = [np.array([0]), np.array([1]), np.array([0, 1]), np.array([], np.int64)]
    positive = np.array([True, False, False, False])
    times = np.array([2.0, 3, 1, 4])
    many = [r for r, t in zip(rows, times, strict=True) for _ in range(int(t))]
    a, b = toxicity.fit(rows, positive, 2, 0.3, times, 50), toxicity.fit(many, np.repeat(positive, times.astype(int)), 2, 0.3, None, 50)
    np.testing.assert_allclose([*a[0], a[1]], [*b[0], b[1]])


def test_words_are_counted_in_the_whole_fold(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    own = {r["doc_id"]: r["text"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    toxic, prior = toxicity.positives(docs, labels)
    known = {r["doc_id"]: r["toxic"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["toxic"] is not None}
    assert prior == pytest.approx(min(max(sum(known.values()) / len(known), 0.01), 0.9))
    assert sorted(r["text"] for r in toxic.collect()) == sorted(own[i] for i, t in known.items() if t == 1)
    p = Counter(w for i, t in known.items() if t == 1 for w in toxicity.words(own[i]))
    u = Counter(w for x in own.values() for w in toxicity.words(x))
    marked = {w for w, n in p.items() if n >= toxicity.LEAST_TEXTS}
    assert toxicity.word_counts(toxic) == {w: p[w] for w in marked} | {b" ": sum(known.values())}
    assert toxicity.word_counts(toxicity.fold(docs), marked) == {w: u[w] for w in marked if u[w] >= toxicity.LEAST_TEXTS} | {b" ": len(own)}
    chosen = sorted(marked)[:30]
    found = {tuple(r["features"]): r["n"] for r in toxicity._features(toxicity.fold(docs), chosen).collect()}
    assert found == Counter(tuple(i for i, w in enumerate(chosen) if w in toxicity.words(x)) for x in own.values())


def test_shards_stand_for_all_rows(spark, monkeypatch):
    rows = spark.createDataFrame([([], 1000), ([1], 7), *(([2, i], 1) for i in range(3, 60))], "features array<int>, n long")
    whole = toxicity.sharded(rows).toPandas()
    assert whole.shard.unique().tolist() == [0]
    monkeypatch.setattr(toxicity, "SHARD", 10)
    found = toxicity.sharded(rows).toPandas()
    assert found.shard.nunique() == 5
    assert found.times.sum() == pytest.approx(whole.times.sum())
    assert (found[found.features.map(len) == 0].times == 200).all()
    assert found[found.features.map(len) == 2].groupby("shard").times.sum().min() >= 3


def test_scores_do_not_depend_on_partitions_or_copies_of_ids(spark, monkeypatch):
    """One id with several texts and labels, rows in any order and number of partitions, several shards."""
    monkeypatch.setattr(toxicity, "SHARD", 40)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(50)]
    rows = [(i // 2 if i < 40 else i, " ".join(rng.choice(words, 20)) + (" vile" if i % 5 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 400, 2)] + [(10, 0), (10, 1), (None, 1)], "doc_id long, toxic int")
    make = lambda part: spark.createDataFrame([rows[i] for i in np.random.default_rng(part).permutation(len(rows))], "doc_id long, text string").repartition(part)
    one, other = (sorted(map(tuple, toxicity.scored(make(part), labels).collect())) for part in (1, 5))
    assert [x[:2] for x in one] == [x[:2] for x in other]
    np.testing.assert_allclose([x[2] for x in one], [x[2] for x in other], rtol=1e-9)


def test_long_words_and_texts(spark):
    """Words of any length count, and texts are read whole."""
    vile = "v" * 5000
    rows = [(i, ("plain text " * (30_000 if i == 3 else 5)) + (vile if i % 4 == 0 else "") + f" w{i}") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 200)], "doc_id long, toxic int")
    found = toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in found if r["held_out"])
