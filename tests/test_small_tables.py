"""Apportionments as DataFrames against their dictionary forms; ordered distinct; matrices with their sidecars."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from fathomline.operators import bundle, sampling


def test_allocations_as_tables(spark):
    """Many cases in one table each would be another operator: a few, with ties, kinds without rows and odd quotas."""
    r = random.Random(1)
    for fraction in (0.0, 0.1, 0.5, 0.97, 1.0):
        names = [f"k{i}" for i in range(r.randrange(1, 7))]
        capacity = {k: r.choice([0, 1, 5, 40]) for k in names}
        raw = [r.choice([1, 1, 2, 3]) for _ in names]
        quotas = {k: x / sum(raw) for k, x in zip(names, raw, strict=True)}
        kinds = spark.createDataFrame([(k, capacity[k], quotas[k], i) for i, k in enumerate(names)], "kind string, capacity long, quota double, place int").repartition(2)
        found = {x["kind"]: x["allocated"] for x in sampling.allocated(kinds, fraction).collect()}
        assert found == sampling.allocate_by_quota(sampling.target_count(sum(capacity.values()), fraction), quotas, capacity)
        shares = spark.createDataFrame([(k, quotas[k], i) for i, k in enumerate(names)], "kind string, share double, place int")
        total = spark.createDataFrame([(r.randrange(1000),)], "n long")
        found = {x["kind"]: x["allocated"] for x in sampling.remainders(shares, total).collect()}
        assert found == sampling.largest_remainder(total.first()["n"], quotas)


def test_first_of_each(spark):
    rows = [("a", 2, "x"), ("a", 1, "y"), ("a", 1, "z"), (None, 5, None), ("b", None, "n"), ("b", 7, "m")]
    df = spark.createDataFrame(rows, "k string, at int, v string").repartition(3)
    assert {tuple(r) for r in sampling.first_of_each(df, ["k"], "at", "v").collect()} == {("a", 1, "y"), (None, 5, None), ("b", None, "n")}
    assert sampling.first_of_each(df, ["k", "at", "v"]).count() == 6
    assert sampling.first_of_each(df.filter("false"), ["k"], "at").count() == 0


@pytest.mark.parametrize("weights", [None, {"benign": 0.5, "ransomware-encrypted": 2.0}])
def test_matrices_with_sidecars(spark, tmp_path, weights):
    df = spark.range(6).select(F.col("id"), (F.col("id") % 3).cast("int").alias("y"), F.when(F.col("id") < 4, "train").otherwise("test").alias("split"))
    bundle.save_matrix(df, str(tmp_path / "m"), weights=weights)
    rows, labels, found = bundle.load_matrix(spark, str(tmp_path / "m"))
    assert sorted(tuple(r) for r in rows.select("id", "y", "split").collect()) == sorted(tuple(r) for r in df.collect())
    assert labels == {"benign": 0, "benign-encrypted": 1, "ransomware-encrypted": 2}
    assert found == (weights or {})


def test_run_stamps():
    at = datetime.datetime(2026, 1, 2, 3, 4, 5, tzinfo=datetime.timezone(datetime.timedelta(hours=2)))
    assert bundle.run_stamp(at) == "20260102_010405"
    assert len(bundle.run_stamp()) == 15
