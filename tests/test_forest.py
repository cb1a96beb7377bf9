from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from fathomline.operators import forest, models

NAMES = ["a", "b", "flag"]


@pytest.fixture(scope="module")
def made(spark):
    """1,200 rows: the class goes by two features with noise; one class is rare."""
    r = np.random.default_rng(5)
    rows = []
    for i in range(1200):
        a, b, flag = float(r.normal()), float(r.integers(0, 50)), bool(r.integers(0, 2))
        y = 2 if r.random() < 0.05 else int((a + b / 25 - 1 + r.normal() * 0.4 > 0) != flag)
        rows.append((i, a, b, flag, y, ["benign", "benign-encrypted", "ransomware-encrypted"][y]))
    return spark.createDataFrame(rows, "id long, a double, b double, flag boolean, y int, gt_class string").cache()


def shares(df):
    return np.array([[r["s0"], r["s1"], r["s2"]] for r in df.orderBy("id").collect()])


def test_like_the_library_s_forest(made):
    """The probabilities differ from spark.ml's by no more than those of two of its seeds do, nearly."""
    vectors = models.assembled(made.withColumn("flag", F.col("flag").cast("int")), NAMES)
    theirs = [shares(models.predictions(RandomForestClassifier(labelCol="y", weightCol="class_weight", numTrees=60, maxDepth=8, minInstancesPerNode=2, featureSubsetStrategy="sqrt", seed=seed).fit(vectors), vectors)) for seed in (1, 2)]
    ours = shares(forest.predict(models.random_forest(made, NAMES, 60, 8), made))
    assert np.abs(ours.sum(1) - 1).max() < 1e-9
    assert np.abs(ours - theirs[0]).mean() < 1.4 * np.abs(theirs[1] - theirs[0]).mean()


def test_partitions_decide_nothing(made, monkeypatch):
    expected = shares(forest.predict(models.random_forest(made.coalesce(1), NAMES, 20, 6), made))
    monkeypatch.setattr(forest, "PER_TASK", 100)
    monkeypatch.setattr(forest, "BLOCK", 7)
    assert (shares(forest.predict(models.random_forest(made.orderBy("b").repartition(5), NAMES, 20, 6), made)) == expected).all()


def test_work_goes_by_distinct_rows(spark, made):
    """Twenty times the rows, of the same values: as many cells, with twenty times the rows."""
    many = made.join(spark.range(20).withColumnRenamed("id", "copy"))
    cells = []
    for rows in (made, many):
        edges = forest.edges_of(rows, NAMES, "y", [1.0, 1.0, 7.0], 8)
        assert [len(e) <= 7 for e in edges] == [True] * 3 and edges[2] == [0.5]
        cells.append({r["key"]: r["n"] for r in forest.cells_of(rows, NAMES, "y", [[-1.0, 0.0, 1.0], [10.0, 30.0], [0.5]]).collect()})
    assert sum(cells[0].values()) == 1200 and {k: 20 * n for k, n in cells[0].items()} == cells[1]


def test_a_tree_by_hand(spark):
    """A cut between the classes, leaves of their weighted shares; draws follow Poisson's law."""
    rows = spark.createDataFrame([(i, float(i // 50), int(i >= 100)) for i in range(200)], "id long, x double, y int")
    p = forest.Params(trees=3, depth=5)
    m = forest.fit(rows, ["x"], "y", [1.0, 2.0], p)
    assert m.edges == [[0.5, 1.5, 2.5]] and m.feature.tolist() == [0, 0, 0] + [-1] * 6 and m.edge[:3].tolist() == [1, 1, 1]
    assert m.votes()[3:].tolist() == [[1, 0], [0, 1]] * 3 and m.counts[:3].sum(1).tolist() == m.counts[3:].reshape(3, -1).sum(1).tolist()
    taken = forest.draws(range(300), [40] * 300, forest.Params(trees=50))
    assert abs(taken.mean() - 40) < 0.5 and abs(taken.var() - 40) < 2


def test_joined_leaves_edges_and_no_rows(spark):
    mixed = spark.createDataFrame([(float(i % 2), int(i % 20 == 0)) for i in range(400)], "x double, y int")
    assert (forest.fit(mixed, ["x"], "y", [1.0, 1.0], forest.Params(trees=2)).feature < 0)[:2].all()  # both sides predict class 0
    empty = forest.fit(mixed.limit(0), ["x"], "y", [1.0, 1.0], forest.Params(trees=2))
    assert [(r["s0"], r["s1"], r["y_pred"]) for r in forest.predict(empty, mixed.limit(1)).collect()] == [(0.0, 0.0, 0)]
