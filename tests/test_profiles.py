"""Sliding profiles by sweep line against a window scanned event by event; their plan."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fathomline.operators import profiles

W = 1000
SCHEMA = "event_id int, process_key string, us long, file_path string, predicted_class string, probability double, events_in_window_before string"
KINDS = [profiles.POSITIVE, profiles.POSITIVE, profiles.POSITIVE, "benign", "benign-encrypted", None]


def events(n, seed, span, busy=0.7):
    r = random.Random(seed)
    out = []
    for i in range(n):
        kind = r.choice(KINDS)
        out.append((i, "busy" if r.random() < busy else f"p{r.randrange(4)}", r.randrange(-span // 4, span), r.choice([None, *(f"/f{k}" for k in range(9))]), kind, None if kind is None or r.random() < 0.1 else r.choice([0.1, 0.2, 0.3, 0.6, 0.95]), "x"))
    return out


def by_hand(rows):
    out = {}
    for e in rows:
        window = [o for o in rows if o[1] == e[1] and e[2] - W <= o[2] <= e[2]]
        classified = [o for o in window if o[4] is not None]
        rated = [o[5] for o in window if o[5] is not None]
        so_far = sorted((o for o in classified if (o[2], o[0]) <= (e[2], e[0])), key=lambda o: (o[2], o[0]))
        run = next((i for i, o in enumerate(reversed(so_far)) if o[4] != profiles.POSITIVE), len(so_far))
        hits = sum(o[4] == profiles.POSITIVE for o in window)
        out[e[0]] = (len(window), len(classified), sum(o[4] == "benign" for o in window), sum(o[4] == "benign-encrypted" for o in window), hits, max(rated, default=0.0), sum(rated) / len(rated) if rated else 0.0,
                     sum(o[3] is not None for o in window), len({o[3] for o in window} - {None}), run, hits / len(classified) if classified else 0.0, min(o[2] for o in window))
    return out


COLUMNS = "events_in_window classified_events_count benign_count benign_encrypted_count ransomware_encrypted_count max_ransomware_probability avg_ransomware_probability touched_files touched_files_unique consecutive_ransomware_hits ransomware_ratio window_start_us".split()


@pytest.mark.parametrize(("seed", "span"), [(1, 40_000), (2, 3_000), (3, 200)])
def test_equals_scanned_windows(spark, seed, span):
    """Sparse events, crowded ones, and hundreds at the same times; times before 1970 too."""
    rows = events(300, seed, span)
    found = profiles.profiles(spark.createDataFrame(rows, SCHEMA).repartition(3), W)
    assert found.columns[:7] == SCHEMA.replace(",", "").split()[::2]
    expected = by_hand(rows)
    got = {r["event_id"]: tuple(r[c] for c in COLUMNS) for r in found.collect()}
    assert got.keys() == expected.keys()
    for i, e in expected.items():
        assert got[i] == pytest.approx(e), i


def test_average_is_exact(spark):
    """What comes in and goes out again leaves no trace in sums, so that thresholds hold."""
    rows = [(i, "p", i * 400, "/f", "benign", [0.1, 0.2, 0.3, 0.6, 0.7][i % 5], "x") for i in range(400)] + [(999, "p", 10**6, "/f", "benign", 0.6, "x")]
    found = profiles.profiles(spark.createDataFrame(rows, SCHEMA), W)
    assert found.filter("event_id = 999").first()["avg_ransomware_probability"] == 0.6


def test_one_shuffle_and_no_task_with_a_whole_process(spark):
    """The plan deals by process and span once; a process of 100 times the events has no task with all of them."""
    rows = spark.range(20_000).select(F.col("id").alias("event_id"), F.lit("busy").alias("process_key"), (F.col("id") * 50).alias("us"), F.lit("/f").alias("file_path"), F.lit("benign").alias("predicted_class"), F.lit(0.5).alias("probability"))
    found = profiles.profiles(rows, W)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    dealt = profiles.in_spans(rows, W).repartition(8, "process_key", profiles.SPAN)
    sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8
    assert max(sizes) < 2 * sum(sizes) / 8
    assert dealt.count() <= 1.3 * rows.count()
    largest = profiles.in_spans(rows, W).groupBy("process_key", profiles.SPAN).count().agg(F.max("count")).first()[0]
    assert largest <= (profiles.SPANS + 1) * W // 50 + 2


def test_windowed_count(spark):
    r = random.Random(5)
    rows = [(i, r.choice("ab"), r.randrange(5000), r.choice([True, False, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, key string, us long, yes boolean").repartition(3)
    found = {x["id"]: x["n"] for x in profiles.windowed_count(df, "key", F.col("yes"), 300, "n").collect()}
    assert found == {i: sum(k == o[1] and us - 300 <= o[2] <= us and o[3] is True for o in rows) for i, k, us, _ in rows}


def test_no_rows(spark):
    assert profiles.profiles(spark.createDataFrame([], SCHEMA), W).collect() == []


def test_tasks_are_counted_from_the_events(spark, monkeypatch):
    """The session's number of partitions stays as tables grow: what a task sorts does not grow with them."""
    assert [profiles.tasks(n, 8) for n in (0, 100, 40_000, 400_000, 36_000_000)] == [1, 1, 8, 8, 720]
    monkeypatch.setattr(profiles, "ROWS", 20)
    df = spark.createDataFrame(events(400, 3, 40 * W, busy=0.1), SCHEMA)
    for found in (profiles.profiles(df, W), profiles.windowed_count(df, "process_key", F.lit(True), W, "n")):
        assert found.rdd.getNumPartitions() == 20  # of 4 in the session
