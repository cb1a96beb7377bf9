"""The Parzen search: seeded, inside its space, better than random trials on a known surface; its trial table."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SMALL

from fathomline.operators import parzen, search
from fathomline.operators.parzen import Choice, Range

SPACE = {"x": Range(-5.0, 5.0), "rate": Range(1e-4, 1.0, log=True), "leaves": Range(2, 200, whole=True), "depth": Choice((-1, 3, 5, 8))}


def surface(s):
    """Best, 0, at x = 1, rate = 0.01, leaves = 60, depth = 5."""
    return -((s["x"] - 1) ** 2) - (math.log10(s["rate"]) + 2) ** 2 - ((s["leaves"] - 60) / 40) ** 2 - (s["depth"] != 5)


def run(n=80, seed=1, batch=1, startup=parzen.STARTUP):
    return parzen.search(SPACE, lambda many: [surface(s) for s in many], n, batch, seed, startup)


def test_is_seeded_and_inside_the_space():
    found = run()
    assert found == run() != run(seed=2)
    assert [r["trial"] for r in found] == list(range(1, 81))
    assert all(-5 <= r["x"] <= 5 and 1e-4 <= r["rate"] <= 1 and 2 <= r["leaves"] <= 200 and isinstance(r["leaves"], int) and r["depth"] in (-1, 3, 5, 8) for r in found)


@pytest.mark.parametrize("batch", [1, 4])
def test_beats_random_trials(batch):
    """Over seeds, the best of as many trials is closer to the top, and later trials are better than the random start."""
    best = lambda rows: max(r["score"] for r in rows)
    guided = [run(seed=s, batch=batch) for s in range(8)]
    random = [run(seed=s, startup=10**6) for s in range(8)]
    assert np.mean([best(g) for g in guided]) > np.mean([best(r) for r in random]) + 0.05
    assert sum(best(g) > best(r) for g, r in zip(guided, random, strict=True)) >= 6
    assert all(np.mean([r["score"] for r in g[40:]]) > np.mean([r["score"] for r in g[:15]]) for g in guided)


def test_the_start_is_random_and_failures_are_bad():
    assert run(15) == run(15, startup=10**6)
    calls = []

    def fails(settings):
        calls.append(len(settings))
        return [math.nan if s["depth"] == 5 else 0.5 if s["depth"] == 3 else 0.0 for s in settings]

    found = parzen.search(SPACE, fails, 63, batch=4)
    assert calls == [4] * 15 + [3]
    assert {r["score"] for r in found if r["depth"] == 5} <= {None}
    late = [r["depth"] for r in found[30:]]
    assert late.count(3) > late.count(5)


@pytest.mark.parametrize("space", [Range(0.0, 1.0), Range(1.0, 1000.0, log=True), Range(1, 9, whole=True)])
def test_densities_are_densities(space):
    """They integrate to one over the range, wherever trials were, at the ends and on top of each other too."""
    low, high = space.ends
    at = np.linspace(low, high, 4001)
    for seen in ([], [space.low], [space.low, space.low, space.high], [space.outer((low + high) / 2)] * 5):
        d = parzen.Density(space, seen)
        assert np.trapezoid([math.exp(d.log(x)) for x in at], at) == pytest.approx(1, abs=0.01)


def test_good_ones():
    assert [parzen.good_ones(n) for n in (1, 10, 11, 250, 1000)] == [1, 1, 2, 25, 25]


def test_trials_of_the_query(spark):
    """Each trial's score is that of its rule, told from the rows one by one."""
    from fathomline.plans import registry
    from fathomline.sources import tables

    rows = tables.scored(spark, SMALL).toPandas()
    found = registry.QUERIES["parzen_trials"](spark, SMALL).collect()
    assert [r["trial"] for r in found] == list(range(1, 41))
    for r in found:
        s2 = rows.s2 * r["by"] if r["kind"] == "scale" else rows.s2 + r["by"] - 1
        hit = (s2 >= np.maximum(rows.s0, rows.s1)) & (s2 >= r["least"])
        tp = (hit & (rows.y_true == 2)).sum()
        assert r["class_2_f1"] == pytest.approx(2 * tp / (hit.sum() + (rows.y_true == 2).sum()))


def test_cross_validated_search(spark):
    """Fits of a batch side by side; the table is the one that a grid or random search gives."""
    rows = spark.createDataFrame([(i, f"g{i % 12}", ["benign", "benign-encrypted", "ransomware-encrypted"][i % 3], float(i % 3)) for i in range(120)], "doc_id long, group_id string, gt_class string, x double")

    def fit_predict(train, test, setting):
        return test.select(F.element_at(F.create_map(*(F.lit(v) for p in (("benign", 0), ("benign-encrypted", 1), ("ransomware-encrypted", 2)) for v in p)), F.col("gt_class")).alias("y_true"),
                           F.when(F.col("x") >= setting["cut"], 2).otherwise(0).alias("y_pred"))

    folds = search.parzen_cross_validate(rows, {"cut": Range(0.0, 3.0)}, fit_predict, n=6, folds=2, batch=3, startup=4)
    same = search.cross_validate(rows, [{"cut": 1.5}], fit_predict, folds=2)
    assert set(folds.columns) == set(same.columns)
    table = {r["trial"]: r for r in search.trial_table(folds, "class_2_f1").collect()}
    assert sorted(table) == [1, 2, 3, 4, 5, 6]
    for r in folds.collect():  # everything above 2 is missed, all but class 2 above 1 left out, and so on
        assert r["class_2_f1"] == pytest.approx(0.0 if r["cut"] > 2 else 1.0 if r["cut"] > 1 else 2 / 3 if r["cut"] > 0 else 0.5), r["cut"]
