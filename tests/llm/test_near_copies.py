"""Groups of near copies against all pairs' exact likeness."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from fathomline.llm import near_copies

from .conftest import DOCS, ODD
from .test_operators import small  # noqa: F401


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(texts):
    """A group number for each text, from the likeness of all pairs."""
    sets = [frozenset(shingles(x)) for x in texts]
    known = sorted(set(sets), key=len)
    parent = list(range(len(known)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(known):
        for k in range(i):
            y = known[k]
            if len(y) >= 0.8 * len(x) and len(x & y) >= 0.8 * len(x | y):
                parent[root(i)] = root(k)
    place = {x: i for i, x in enumerate(known)}
    return [root(place[x]) for x in sets]


def check(spark, documents, rows):
    labels = brute([t for _, t in rows])
    least = {}
    for (i, _), k in zip(rows, labels, strict=True):
        if i is not None:
            least[k] = min(least.get(k, i), i)
    kept = near_copies.one_of_each(documents(rows)).collect()
    assert len(kept) == len(set(labels))
    assert {r["doc_id"] for r in kept} >= set(least.values())
    label = defaultdict(set)
    for (i, t), k in zip(rows, labels, strict=True):
        label[i, t].add(k)
    assert all(label[r["doc_id"], r["text"]] for r in kept)
    return kept


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def made(seed, bases=12, copies=14):
    rng = random.Random(seed)
    rows = []
    for _ in range(bases):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.choice([5, 9, 30, 80, 300]))]
        rows += [edited(rng, words, rng.choice([0, 0, 1, 1, 2, 3, 5])) for _ in range(copies)]
    passage = " ".join(f"shared{i}" for i in range(60))
    rows += [passage + " " + " ".join(f"own{rng.randrange(10**6)}" for _ in range(rng.choice([4, 10, 100]))) for _ in range(70)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_every_group(spark, documents, seed):
    rows = made(seed)
    assert len(check(spark, documents, rows)[0]) == len(documents(rows).columns)


def test_test_table_and_odd_rows(spark, documents, small):  # noqa: F811
    check(spark, documents, [*small.items(), *ODD])
    none = spark.createDataFrame([], DOCS)
    assert near_copies.one_of_each(none).count() == 0 and near_copies.one_of_each(none).schema == none.schema


def test_sketches_of_blocks(monkeypatch):
    x = near_copies.shingle_sets([" ".join(str(i) for i in range(9000))])[0]
    whole = near_copies.sketch(x)
    monkeypatch.setattr(near_copies, "SHINGLES", 100)
    part = near_copies.sketch(x)
    assert whole[:2] == part[:2] and (whole[2] == part[2]).all()
    assert [len(s) for s in near_copies.shingle_sets(["", "a b", "a b c d e", "a b c d e f", "A b c d e"])] == [0, 1, 1, 2, 1]


def test_distance_leaves_room():
    """Sets alike by 0.8 differ in far fewer bits than DISTANCE, and have a band in common."""
    rng = np.random.default_rng(4)
    apart, shared = [], 0
    for _ in range(300):
        common, own = rng.integers(0, 2**64, 320, dtype=np.uint64), rng.integers(0, 2**64, (2, 40), dtype=np.uint64)
        a, b = (near_copies.sketch(np.unique(np.concatenate([common, o]))) for o in own)
        apart.append(((a[1] ^ b[1]) & (1 << 64) - 1).bit_count())
        shared += bool(set(a[2].tolist()) & set(b[2].tolist()))
    assert shared == 300 and max(apart) <= near_copies.DISTANCE and np.mean(apart) + 3 * np.std(apart) < near_copies.DISTANCE
