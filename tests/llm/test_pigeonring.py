"""near_copies' candidates: starts of the pigeonring's chains against their definition."""

from __future__ import annotations

import random

import numpy as np
import pytest

from fathomline.llm import near_copies

from .test_near_copies import brute, edited, made


def viable(x, y, first):
    """By the definition, over lists of bits: a chain from a segment on that is equal, within its share for each length."""
    width, n = near_copies.WIDTH, near_copies.SEGMENTS
    differ = [int(sum(x[(first + k) % n * width + i] != y[(first + k) % n * width + i] for i in range(width))) for k in range(near_copies.CHAIN)]
    return differ[0] == 0 and all(sum(differ[:k]) <= k * near_copies.RING_DISTANCE / n for k in range(1, near_copies.CHAIN + 1))


def sets_alike(rng, n, common=320, own=40):
    for _ in range(n):
        both = rng.integers(0, 2**64, common, dtype=np.uint64)
        yield [np.unique(np.concatenate([both, rng.integers(0, 2**64, own, dtype=np.uint64)])) for _ in range(2)]


def test_starts_keep_their_budgets():
    rng = np.random.default_rng(5)
    for a, b in sets_alike(rng, 60):
        x, y = near_copies.fingerprint(a).tolist(), near_copies.fingerprint(b).tolist()
        (*_, keys, rest), (*_, other, more) = near_copies.sketch(a), near_copies.sketch(b)
        found = [bool(keys[i] == other[i] and near_copies._near(rest[i:i + 1], more[i:i + 1])[0, 0]) for i in range(near_copies.SEGMENTS)]
        assert found == [viable(x, y, i) for i in range(near_copies.SEGMENTS)] and any(found)


@pytest.mark.parametrize("many", [2048, 64])
def test_groups_of_chains(monkeypatch, many):
    """One group for all that a chain of near ones reaches, whatever the number of members; -1 for those alone."""
    monkeypatch.setattr(near_copies, "MANY", many)
    rng = np.random.default_rng(6)
    bases = rng.integers(-(2**63), 2**63, (12, 2))
    bases &= ~15
    rest = []
    for k, base in enumerate(bases):
        x = base.copy()
        for _ in range(1 + 25 * (k % 4)):  # each differs from the one before in a bit
            rest.append(x.copy())
            x[rng.integers(2)] ^= np.int64(np.uint64(1 << int(rng.integers(4, 64))).view(np.int64))
    order = rng.permutation(len(rest))
    rest = np.array(rest)[order]
    near = near_copies._near(rest, rest)
    assert (near == near.T).all() and near.diagonal().all()
    reach = near.copy()
    while (more := (reach.astype(int) @ reach.astype(int)) > 0).sum() > reach.sum():
        reach = more
    group = near_copies.chained(rest)
    alone = reach.sum(axis=1) == 1
    assert ((group < 0) == alone).all()
    assert ((group[:, None] == group) == reach)[~alone][:, ~alone].all()


def test_alike_texts_share_a_start(spark, documents):
    rng = random.Random(8)
    rows = [t for _, t in made(8)] + [edited(rng, ["a", "b", "c", "d", "e", "f", "g", "h", "i"][:k], 0) for k in range(1, 10)]
    docs = documents(list(enumerate(rows)))
    own = near_copies.sketched(docs).dropDuplicates(["node"])
    shared = near_copies.starts(own).collect()
    node = {r["doc_id"]: r["node"] for r in near_copies.sketched(docs).collect()}
    parent = {n: n for n in node.values()}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    by_key: dict = {}
    for r in shared:
        by_key.setdefault(r["key"], []).append(r)
    for of in by_key.values():
        assert {r["members"] for r in of} == {len(of)} and len(of) > 1
        for r in of:
            parent[root(r["node"])] = root(of[0]["node"])
    labels: dict = {}
    for i, k in enumerate(brute(rows)):
        assert root(node[i]) == labels.setdefault(k, root(node[i]))
