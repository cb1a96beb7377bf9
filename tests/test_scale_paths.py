"""Operators that used to need one task or the driver, against plain Python: pages, medians, ranks, running maxima, apportioned splits."""

from __future__ import annotations

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import evaluation, repository, sampling, vectorise
from fathomline.operators.repository import Key, Pages


def sorted_rows(rows, directions):
    """By the fields in turn, null smallest."""
    for i, down in reversed(list(enumerate(directions))):
        rows = sorted(rows, key=lambda r, i=i: (r[i] is not None, r[i] if r[i] is not None else 0), reverse=down)
    return rows


@pytest.mark.parametrize("directions", [(False, True, False), (True, False, True)])
def test_pages_of_ranges(spark, monkeypatch, directions):
    """With many small ranges, ties over them and nulls, every page is the sorted table's, and so is what follows a row."""
    monkeypatch.setattr(Pages, "ROWS", 10)
    r = random.Random(1)
    rows = [(r.choice([None, *range(6)]), r.choice([None, "a", "b", "Ä"]), i) for i in range(333)]
    df = spark.createDataFrame(rows, "a int, b string, c int").repartition(4)
    expected = sorted_rows(rows, directions)
    pages = Pages(df, [Key(F.col(c), d) for c, d in zip("abc", directions, strict=True)])
    assert len(pages.bounds) > 10
    assert sum(pages.sizes) == 333
    for number in (1, 2, 5, 12, 13, 14, 99):
        p = pages.page(number, 25)
        assert (p.page, p.pages, p.total) == (min(number, 14), 14, 333)
        assert [tuple(x) for x in p.items.collect()] == expected[25 * (p.page - 1):25 * p.page]
    for at in (0, 100, 331, 332):
        assert [tuple(x) for x in pages.following(expected[at], 50).collect()] == expected[at + 1:at + 51]


def test_a_page_reads_its_ranges_alone(spark, monkeypatch):
    monkeypatch.setattr(Pages, "ROWS", 50)
    pages = Pages(spark.range(10_000).select(F.col("id").alias("a")), [Key(F.col("a"))])
    limits = [x["a"] for x in pages.rows(9_000, 25).collect()]
    assert limits == list(range(9_000, 9_025))
    rows = pages.rows(9_000, 25)
    offset = int(rows._jdf.queryExecution().optimizedPlan().toString().split("Offset ")[1].split()[0])
    assert offset < 1_000


def test_pages_of_little(spark):
    df = spark.range(3).select(F.col("id").alias("a"))
    assert [x["a"] for x in Pages(df, [Key(F.col("a"), True)]).page(1, 50).items.collect()] == [2, 1, 0]
    assert Pages(df.filter("false"), [Key(F.col("a"))]).page(7, 50).items.count() == 0
    assert repository.page(df, [Key(F.col("a"))], 1, 3).items.count() == 3


COLUMNS = {
    "even": [float(x) for x in range(1000)], "odd": [float(x) for x in range(999)], "ties": [1.0] * 600 + [2.0] * 399, "half": [1.0] * 500 + [2.0] * 500, "nulls": [None] * 998 + [3.0, 5.0], "none": [None] * 1000,
    "wide": [10.0**(x % 300) * (-1) ** x for x in range(1000)], "nan": [float("nan")] * 400 + [float(x) for x in range(600)], "one": [7.0], "heap": [5.0] * 700 + [float(x) for x in range(300)], "two": [0.0] * 3 + [1.0] * 3,
}


@pytest.mark.parametrize("few", [10_000, 30])
def test_medians(spark, monkeypatch, few):
    """Exact with one look at all values and with brackets cut down to a few of them."""
    monkeypatch.setattr(vectorise, "FEW", few)
    r = random.Random(2)
    columns = {c: r.sample(v + [None] * (1000 - len(v)), 1000) for c, v in COLUMNS.items()}
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns)).repartition(3)
    found = vectorise.medians(df, list(columns))
    for c, values in COLUMNS.items():
        known = [v for v in values if v is not None and v == v]
        assert found[c] == (statistics.median(known) if known else None), c


def test_medians_when_the_sketch_is_off(spark, monkeypatch):
    """A sketch of little accuracy gives brackets that miss; the counts tell."""
    monkeypatch.setattr(vectorise, "FEW", 10)
    monkeypatch.setattr(vectorise, "ACCURACY", 2)
    monkeypatch.setattr(vectorise, "MARGIN", 1e-4)
    values = random.Random(3).sample(range(10**6), 801)
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(3)
    assert vectorise.medians(df, ["x"]) == {"x": float(statistics.median(values))}


def test_medians_have_no_task_with_a_column(spark, monkeypatch):
    """Only so many values as FEW are ever gathered."""
    monkeypatch.setattr(vectorise, "FEW", 100)
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_000).cast("double").alias("x"), F.rand(1).alias("y"))
    assert vectorise.medians(df, ["x", "y"])["x"] == 24_999.5


def test_average_ranks_and_running_best(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "RANGES", 7)
    r = random.Random(4)
    rows = [(i, r.choice([0.5, 1.0, 2.0, r.random() * 3])) for i in r.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "trial int, score double").repartition(4)
    places = {v: [i + 1 for i, x in enumerate(sorted(s for _, s in rows)) if x == v] for v in {s for _, s in rows}}
    found = evaluation.average_ranks(df, ["score"]).collect()
    assert {x["trial"]: x["rank_score"] for x in found} == {t: sum(places[s]) / len(places[s]) for t, s in rows}
    best = {x["trial"]: x["best_so_far"] for x in evaluation.running_best(df, "score").collect()}
    assert best == {t: max(s for u, s in rows if u <= t) for t, _ in rows}
    some = spark.createDataFrame([(1, None), (2, 3.0), (3, None), (4, 1.0)], "trial int, score double")
    assert [x["best_so_far"] for x in evaluation.running_best(some, "score").orderBy("trial").collect()] == [None, 3.0, 3.0, 3.0]
    rho = {(x["a"], x["b"]): x["rho"] for x in evaluation.spearman(df, ["trial", "score"]).collect()}
    at = np.argsort(np.argsort([t for t, _ in rows])) + 1.0
    assert rho["trial", "score"] == pytest.approx(np.corrcoef(at, [sum(places[s]) / len(places[s]) for _, s in rows])[0, 1])


def test_apportioned_splits(spark, monkeypatch):
    """Whole groups, shares by signature within a group a range, every class in every split."""
    monkeypatch.setattr(sampling, "RANGE_GROUPS", 64)
    rows = [(f"g{g}", c) for g in range(900) for c in (["a"] if g % 3 else ["a", "b"]) for _ in range(1 + g % 4)] + [("lone1", "c"), ("lone2", "c"), ("lone2", "a"), ("lone3", "a"), ("lone3", "b"), ("lone3", "c")]
    df = spark.createDataFrame(rows, "group_id string, gt_class string").repartition(3)
    found = sampling.apportioned(df)
    split = {x["group_id"]: x["split"] for x in found.collect()}
    assert found.count() == len(split) == len({g for g, _ in rows})
    sampling.check_split(df.join(found, "group_id").filter("gt_class <> 'c'"))  # whose three groups cannot have the shares
    for kind in (lambda g: g % 3, lambda g: not g % 3):
        own = [split[f"g{g}"] for g in range(900) if kind(g)]
        shares = {s: own.count(s) / len(own) for s in ("train", "valid", "test")}
        assert all(abs(shares[s] - sampling.RATIOS[s]) < 0.05 for s in shares)
    assert {split[f"lone{i}"] for i in (1, 2, 3)} == {"train", "valid", "test"}


def test_many_groups_are_not_collected(spark, monkeypatch):
    monkeypatch.setattr(sampling, "MOST_GREEDY", 50)
    monkeypatch.setattr(sampling, "assign_groups", lambda *_: pytest.fail("groups on the driver"))
    df = spark.range(400).select(F.concat(F.lit("g"), (F.col("id") % 100).cast("string")).alias("group_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("gt_class"))
    assert sampling.grouped_split(df, {f"fold_{i}": 0.2 for i in range(5)}).groupBy("split").count().count() == 5
