"""Boosted trees against a plain version that grows one leaf at a time, and their early stop."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SMALL

from fathomline.operators import boosting
from fathomline.operators.boosting import STEPS, Params


def table(n, seed=1):
    """Rows of three classes that x0 and x1 tell apart, but for noise; x2 has nulls and few values; a quarter is for validation."""
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 3)), 2)
    x[:, 2] = np.where(r.random(n) < 0.2, np.nan, np.round(x[:, 2]))
    y = np.where(x[:, 0] + 0.3 * r.normal(size=n) > 0.4, 2, np.where(np.abs(x[:, 1]) > 0.8, 1, 0))
    w = np.array([1.0, 2.0, 0.5])[y]
    return x, y, w, np.arange(n) % 4 == 3


def frame(spark, x, y, w, valid, parts):
    rows = [(i, *(None if np.isnan(v) else float(v) for v in x[i]), int(y[i]), float(w[i]), bool(valid[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "id long, x0 double, x1 double, x2 double, y int, w double, valid boolean").repartition(parts)


FEATURES = ["x0", "x1", "x2"]


def fitted(spark, data, p, parts=3, classes=3):
    return boosting.fit(frame(spark, *data, parts), FEATURES, "y", classes, p, F.col("w"), F.col("valid"), F.col("id"))


def by_hand(x, y, w, valid, edges, p, classes):
    """Scores of all rows after each round: gradients row by row, every cut tried, the best leaf cut first."""
    bins = [[sum(e < v for e in es) if v == v else 0 for v, es in zip(row, edges, strict=True)] for row in x]
    total = [sum(w[(y == k) & ~valid]) for k in range(classes)]
    raw = np.tile([np.log(t / sum(total)) for t in total], (len(y), 1))
    after = []
    for number in range(p.rounds):
        columns = [sorted(chooser.sample(range(3), max(1, round(p.columns * 3)))) for chooser in [random.Random(f"{p.seed}-{number}")] for _ in range(classes)]
        share = np.array([np.exp(r - max(r)) / np.exp(r - max(r)).sum() for r in raw])
        rows = [i for i in range(len(y)) if not valid[i] and (not p.subsample_freq or boosting.mixed(np.array([i]), p.seed + number // p.subsample_freq)[0] < p.subsample)]
        step = np.zeros_like(raw)
        for k in range(classes):
            g = {i: round((share[i, k] - (y[i] == k)) * w[i] * STEPS) for i in rows}
            h = {i: round(classes / (classes - 1) * share[i, k] * (1 - share[i, k]) * w[i] * STEPS) for i in rows}
            score = lambda part, g=g, h=h: max(abs(sum(g[i] for i in part)) / STEPS - p.l1, 0.0) ** 2 / (sum(h[i] for i in part) / STEPS + p.l2)

            def best(part, k=k, score=score, columns=columns, h=h):
                found = None
                for f in columns[k]:
                    for b in sorted({bins[i][f] for i in part}):
                        left, right = [i for i in part if bins[i][f] <= b], [i for i in part if bins[i][f] > b]
                        if min(len(left), len(right)) >= p.least_rows and min(sum(h[i] for i in left), sum(h[i] for i in right)) >= max(1, p.least_hessian * STEPS):
                            gain = score(left) + score(right) - score(part)
                            if gain > p.least_gain and (found is None or gain > found[0]):
                                found = gain, f, b
                return found

            leaves = [((), rows, best(rows))]
            while len(leaves) < p.leaves and any(c for _, _, c in leaves):
                at = max((i for i in range(len(leaves)) if leaves[i][2]), key=lambda i: leaves[i][2][0])
                path, part, (_, f, b) = leaves.pop(at)
                for side in (True, False):
                    own = [i for i in part if (bins[i][f] <= b) == side]
                    leaves.append(((*path, (f, b, side)), own, best(own) if p.depth < 0 or len(path) + 1 < p.depth else None))
            for path, part, _ in leaves:
                gs, hs = sum(g[i] for i in part) / STEPS, sum(h[i] for i in part) / STEPS
                value = -p.rate * np.sign(gs) * max(abs(gs) - p.l1, 0.0) / (hs + p.l2)
                for i in range(len(y)):
                    if all((bins[i][f] <= b) == side for f, b, side in path):
                        step[i, k] += value
        raw = raw + step
        after.append(raw.copy())
    return after


@pytest.mark.parametrize("p", [Params(rounds=3, leaves=6, least_rows=5, bins=16, rate=0.3, patience=99), Params(rounds=4, leaves=4, depth=2, least_rows=3, bins=8, l1=0.5, l2=1.0, least_gain=0.1, subsample=0.7, subsample_freq=2, columns=0.6, patience=99)])
def test_equals_the_plain_version(spark, p):
    data = table(260)
    m = fitted(spark, data, p)
    after = by_hand(*data, m.edges, p, 3)
    assert 1 <= m.best_round <= p.rounds
    np.testing.assert_allclose(m.raw(m.bins([data[0][:, j] for j in range(3)])), after[m.best_round - 1], rtol=1e-9, atol=1e-9)
    loss = [-np.average(np.log(boosting.softmax(a)[np.arange(len(a)), data[1]])[data[3]], weights=data[2][data[3]]) for a in after]
    np.testing.assert_allclose([h["valid"] for h in m.history], loss, atol=1e-5)
    assert m.best_round == int(np.argmin(loss)) + 1


def test_partitions_do_not_matter(spark, monkeypatch):
    data, p = table(300, 2), Params(rounds=4, leaves=5, least_rows=5, bins=32, patience=99)
    one = fitted(spark, data, p, 1)
    monkeypatch.setattr(boosting, "BLOCK", 37)
    monkeypatch.setattr(boosting, "REFRESH", 2)
    assert fitted(spark, data, p, 5).to_json() == one.to_json()


def test_early_stop(spark):
    """Labels of validation rows are noise: the first rounds are the best, and so many more as patience allows are tried."""
    x, y, w, valid = table(200, 3)
    y = np.where(valid, np.random.default_rng(0).integers(0, 3, len(y)), y)
    m = fitted(spark, (x, y, w, valid), Params(rounds=30, leaves=8, least_rows=5, bins=16, rate=0.5, patience=2))
    assert len(m.rounds) == m.best_round < 30
    assert len(m.history) == m.best_round + 2
    assert min(m.history, key=lambda h: h["valid"])["round"] == m.best_round


def test_no_validation_keeps_all_rounds(spark):
    x, y, w, valid = table(120, 4)
    m = fitted(spark, (x, y, w, np.zeros(len(y), bool)), Params(rounds=3, leaves=3, least_rows=5, bins=8))
    assert (m.best_round, len(m.rounds), len(m.history)) == (3, 3, 3)
    assert m.history[-1]["train"] < m.history[0]["train"]
    assert all(h["valid"] is None for h in m.history)
    again = boosting.Model.from_json(m.to_json())
    assert again == m
    bins = m.bins([x[:, j] for j in range(3)])
    np.testing.assert_array_equal(again.raw(bins), m.raw(bins))
    assert sum(m.importance().values()) == sum(len(t.cuts) for trees in m.rounds for t in trees)
    assert all(v >= 0 for v in m.importance("gain").values())


def test_predict(spark):
    x, y, w, valid = table(400, 5)
    m = fitted(spark, (x, y, w, valid), Params(rounds=4, leaves=6, least_rows=5, bins=32, rate=0.5, patience=99))
    found = boosting.predict(m, frame(spark, x, y, w, valid, 2)).toPandas().sort_values("id")
    share = boosting.softmax(m.raw(m.bins([x[:, j] for j in range(3)])))
    np.testing.assert_allclose(found[["s0", "s1", "s2"]].to_numpy(), share)
    assert (found.y_pred == share.argmax(1)).all()
    assert (found.y_pred == found.y)[found.valid].mean() > 0.8


def test_odd_inputs(spark):
    """No rows, a class without rows, a feature of nulls alone, one row."""
    none = frame(spark, *table(4), 1).filter("false")
    m = boosting.fit(none, FEATURES, "y", 3, Params(rounds=2))
    assert (m.rounds, m.base) == ([], [0.0, 0.0, 0.0])
    assert boosting.predict(m, none).count() == 0
    one = spark.createDataFrame([(1.0, None, 0.0, 0)], "x0 double, x1 double, x2 double, y int")
    m = boosting.fit(one, FEATURES, "y", 3, Params(rounds=2))
    assert boosting.predict(m, one).first()["y_pred"] == 0
    x, y, w, valid = table(100, 6)
    x[:, 1] = np.nan
    m = fitted(spark, (x, np.minimum(y, 1), w, valid), Params(rounds=2, leaves=3, least_rows=5, bins=8))
    assert m.edges[1] == []
    assert all(r["s2"] < 1e-6 for r in boosting.predict(m, frame(spark, x, y, w, valid, 1)).collect())


@pytest.mark.parametrize(("name", "least"), [("boosted_predict", 0.6), ("boosted_no_aug_predict", 0.0)])
def test_on_documents(spark, name, least):
    """Every row of the table and its augmented copies has its probabilities; learned with augmented rows, held-out ones are found."""
    from fathomline.plans import registry

    found = registry.QUERIES[name](spark, SMALL).toPandas()
    assert not found.duplicated(["doc_id", "is_augmented"]).any()
    assert (~found.is_augmented).sum() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    np.testing.assert_allclose(found[["s0", "s1", "s2"]].sum(axis=1), 1)
    held = found[found.held_out & found.is_augmented]
    assert (held.y_pred == 2).mean() >= least
