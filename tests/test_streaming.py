"""Streams give what the batch operators give, however the rows are cut into batches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from tests.conftest import SMALL

from fathomline.operators import events, profiles
from fathomline.sources import tables
from fathomline.streaming import pipelines, replay, sinks

HOUR_US = 3_600_000_000
T0 = 1_750_000_000_000_000
SECOND = 1_000_000


@pytest.fixture()
def source(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", pipelines.ROCKSDB)
    e = tables.file_events(spark, SMALL).drop("ts").orderBy("us", "event_id").limit(300)
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    return e, spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))


class Feed:
    """A stream whose batches are given one after the other; each is a run of the query from its checkpoint."""

    def __init__(self, spark, folder, schema, build):
        self.spark, self.folder, self.schema, self.build = spark, folder, schema, build
        self.own = replay.stream_session(spark)
        self.own.conf.set("spark.sql.shuffle.partitions", "2")
        self.seen = 0

    def give(self, rows, state: bool = False):
        """What the batch returns; state: also how many state rows there are afterwards."""
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        stream = self.build(self.own.readStream.schema(self.schema).parquet(f"{self.folder}/in"))
        out = []
        q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{self.folder}/ck").trigger(availableNow=True).foreachBatch(lambda b, _: out.extend(b.collect())).start()
        q.awaitTermination()
        return (out, q.lastProgress["stateOperators"][0]["numRowsTotal"]) if state else out


def run(spark, stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_deduplication(spark, source):
    batch, stream = source
    window = 3 * 86_400_000_000
    found = run(spark, pipelines.deduplicated(stream, window, expire=False), "dedup", "append")
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in events.deduplicate(batch, window).select("event_id", "is_duplicate").collect()}


def test_profiles(spark, source):
    batch, stream = source
    window = 5 * 86_400_000_000
    found = run(spark, pipelines.profiled(stream, window), "profiled", "append").filter("profile_status = 'active'")
    expected = profiles.latest(profiles.with_score(profiles.profiles(batch, window)), "process_key", "us", "event_id")
    names = ["process_key", "events_in_window", "touched_files_unique", "consecutive_ransomware_hits", "suspicion_score"]
    assert {tuple(r) for r in found.select(*names).collect()} == {tuple(r) for r in expected.select(*names).collect()}


def test_windows(spark, source):
    assert run(spark, pipelines.windowed_counts(source[1], "1 day"), "counts", "complete").count() > 0


RAW = "seq bigint, action string, host string, file_keys array<string>, file_path string, us bigint"


def raw_rows(n, seed):
    r = random.Random(seed)
    out = []
    for seq in range(n):
        action = r.choice(["name", "name", "forget", "use", "use", "use", "use"])
        keys = r.choice([None, [], [None], *[[f"k{r.randrange(6)}"]] * 3, *[[f"k{r.randrange(6)}", f"o{r.randrange(4)}"]] * 4, [None, f"k{r.randrange(6)}"]])
        path = f"/p{seq}" if action == "name" and r.random() < 0.9 else r.choice([None, "", f"/own{seq}"]) if action == "use" else None
        out.append((seq, action, "h", keys, path, T0 + seq))
    return out


def names_by_hand(rows, learn):
    names, out = {}, []
    for seq, action, _, keys, path, _ in rows:
        keys = [k for k in keys or [] if k is not None]
        if action == "forget":
            for k in keys:
                names.pop(k, None)
            continue
        if path and (action == "name" or learn):
            names.update(dict.fromkeys(keys, path))
        if action == "use":
            out.append((seq, path or next((names[k] for k in keys if k in names), None)))
    return out


@pytest.mark.parametrize("learn", [False, True])
def test_names_in_any_batches(spark, tmp_path, learn):
    """The batch operator, the stream in several cuts and plain Python agree."""
    rows = raw_rows(160, 3)
    expected = names_by_hand(rows, learn)
    assert sorted(tuple(r) for r in events.correlate(spark.createDataFrame(rows, RAW), learn).select("seq", "resolved_path").collect()) == expected
    for k, cuts in enumerate([[160], [1, 60, 61, 160]]):
        feed, found, at = Feed(spark, f"{tmp_path}/{k}", RAW, lambda s: pipelines.correlated(s, "host", learn)), [], 0
        for end in cuts:
            part = rows[at:end]
            random.Random(end).shuffle(part)  # within a batch rows go by seq
            found += feed.give(part)
            at = end
        assert sorted((r["seq"], r["resolved_path"]) for r in found) == expected


def test_one_identifier(spark, tmp_path):
    rows = [(s, a, k[0] if k else None, p) for s, a, _, k, p, _ in raw_rows(120, 4) if not k or len(k) == 1]
    expected = names_by_hand([(s, a, "h", [k], p, 0) for s, a, k, p in rows], False)
    schema = "seq bigint, action string, file_key string, file_path string"
    assert sorted(tuple(r) for r in events.correlate(spark.createDataFrame(rows, schema)).select("seq", "resolved_path").collect()) == expected
    feed = Feed(spark, str(tmp_path), schema, pipelines.correlated)
    assert sorted((r["seq"], r["resolved_path"]) for at in range(0, len(rows), 40) for r in feed.give(rows[at:at + 40])) == expected


def test_forgotten_names_leave_the_state(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), RAW, lambda s: pipelines.correlated(s, "host"))
    _, held = feed.give([(k, "name", "h", [f"k{k}"], f"/p{k}", 0) for k in range(50)], state=True)
    _, left = feed.give([(100 + k, "forget", "h", [f"k{k}"], None, 0) for k in range(49)], state=True)
    assert held - left == 49
    assert feed.give([(200, "use", "h", ["k3", "k49"], None, 0)])[0]["resolved_path"] == "/p49"


def test_several_identifiers_need_a_scope(spark):
    with pytest.raises(ValueError, match="scope"):
        pipelines.correlated(spark.createDataFrame([], RAW))


EVENT = "event_id string, process_key string, us bigint, file_path string, predicted_class string, probability double"
HIT, GOOD = profiles.POSITIVE, "benign"


def event(name, seconds, kind=HIT, process="p", path="/f", p=0.9):
    return (name, process, T0 + int(seconds * SECOND), path, kind, p)


def test_late_events_are_put_in_order(spark, tmp_path):
    """Hits at +2, then a benign one at +0, then a hit at +1, each a batch: two hits in a row. 40 s later the window is empty but for the new one."""
    feed = Feed(spark, str(tmp_path), EVENT, lambda s: pipelines.profiled(s, 30 * SECOND))
    assert [feed.give([e])[0]["consecutive_ransomware_hits"] for e in (event("late", 2), event("early", 0, GOOD), event("middle", 1))] == [1, 1, 2]
    found = feed.give([event("future", 40, GOOD, p=0.05)])
    assert (found[0]["events_in_window"], found[0]["consecutive_ransomware_hits"], found[0]["profile_status"]) == (1, 0, "active")
    # older than the window: evicted at once
    found = feed.give([event("old", 5)])
    assert (found[0]["events_in_window"], found[0]["last_event_id"]) == (1, "future")


def test_an_event_counts_once(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), EVENT, lambda s: pipelines.profiled(s, 30 * SECOND))
    assert feed.give([event("a", 0), event("a", 0), event("b", 1)])[0]["events_in_window"] == 2
    assert feed.give([event("b", 1), event("c", 1)])[0]["events_in_window"] == 3


def test_silent_processes_expire(spark, tmp_path):
    """State is bounded by those that are not silent; each that falls silent returns one expired profile, unscored."""
    feed = Feed(spark, str(tmp_path), EVENT, lambda s: pipelines.profiled(s, 30 * SECOND, late="1 second"))
    sizes, expired = [], []
    for k in range(4):
        out, size = feed.give([event(f"{k}-{i}-{j}", 100 * k + j, process=f"p{k}-{i}") for i in range(20) for j in range(3)], state=True)
        sizes.append(size)
        expired += [r for r in out if r["profile_status"] == "expired"]
        assert sum(r["profile_status"] == "active" for r in out) == 20
    assert max(sizes) <= 1.2 * sizes[0]
    assert sorted(r["process_key"] for r in expired) == sorted(f"p{k}-{i}" for k in range(3) for i in range(20))
    assert {(r["events_in_window"], r["ransomware_encrypted_count"], r["suspicion_score"], r["decision_reason"], r["threat_level"]) for r in expired} == {(3, 3, 0, None, "low")}


def test_a_process_that_comes_back_has_a_new_profile(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), EVENT, lambda s: pipelines.profiled(s, 30 * SECOND, late="1 second"))
    feed.give([event("a", 0)])
    out = feed.give([event("x", 100, process="other")])
    assert [(r["process_key"], r["profile_status"]) for r in out] == [("other", "active"), ("p", "expired")]
    out = feed.give([event("b", 200)])
    assert {(r["process_key"], r["profile_status"], r["events_in_window"]) for r in out} == {("p", "active", 1), ("other", "expired", 1)}


ACTIVITY = "event_id string, event_type string, process_key string, process_name string, file_path string, file_extension string, file_size bigint, us bigint"


def test_activity_in_any_batches(spark, tmp_path):
    """The ring of times gives the batch window's count, and is gone when the process is silent."""
    r = random.Random(9)
    at = sorted(r.sample(range(0, 30_000), 120))
    rows = [(str(i), r.choice(["modified", "deleted", "created"]), f"p{r.randrange(3)}", "x.exe", f"/d/{i}.txt", r.choice([".txt", ".tmp"]), r.choice([1, 10**9]), T0 + t * 1000) for i, t in enumerate(at)]
    config = events.FilterConfig(activity_us=2 * SECOND, activity_count=3)
    columns = ["event_id", "filter_decision", "filter_reason", "event_priority", "activity"]
    expected = {tuple(x) for x in events.prefilter(spark.createDataFrame(rows, ACTIVITY), config).select(*columns).collect()}
    feed = Feed(spark, str(tmp_path), ACTIVITY, lambda s: pipelines.prefiltered(s, config, "1 second"))
    found = [x for k in (0, 50, 90) for x in feed.give(rows[k:{0: 50, 50: 90, 90: 120}[k]])]
    assert {tuple(x[c] for c in columns) for x in found} == expected
    late = ("z", "modified", "other", "x.exe", "/z.txt", ".txt", 1, T0 + 100 * SECOND)
    _, held = feed.give([late], state=True)
    _, left = feed.give([(*late[:2], "third", *late[3:7], T0 + 200 * SECOND)], state=True)
    assert left <= held <= 6


def test_upserts_survive_a_replayed_batch(spark, tmp_path):
    """A batch that is killed after its write and run again, before or after a fold, changes nothing."""
    t = sinks.UpsertTable(spark, f"{tmp_path}/t", "k", "v")
    assert t.read() is None
    assert t.fold() is None
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int, text string")
    state = lambda: {tuple(r) for r in t.read().collect()}
    t.write(rows(("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")), 0)
    assert state() == {("a", 2, "y"), ("b", 1, "z")}
    t.write(rows(("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")), 0)
    t.write(rows(("b", 0, "later batches win"), ("c", 5, "new")), 1)
    expected = {("a", 2, "y"), ("b", 0, "later batches win"), ("c", 5, "new")}
    assert state() == expected
    assert {tuple(r) for r in t.read(to=0).collect()} == {("a", 2, "y"), ("b", 1, "z")}
    assert t.fold(every=3) is None
    assert t.fold() == 1
    assert (t._folders("batch"), t._folders("snapshot")) == ([], [1])
    t.write(rows(("a", 99, "replayed after the fold")), 1)
    assert state() == expected
    t.write(rows(("a", 0, "n")), 2)
    assert t.fold() == 2
    assert state() == {("a", 0, "n"), ("b", 0, "later batches win"), ("c", 5, "new")}


def test_an_unfinished_snapshot_is_not_read(spark, tmp_path):
    t = sinks.UpsertTable(spark, f"{tmp_path}/t", "k")
    t.write(spark.createDataFrame([("a", 1)], "k string, v int"), 0)
    spark.createDataFrame([("lost", 7)], "k string, v int").write.parquet(f"{tmp_path}/t/snapshot-0")
    (tmp_path / "t/snapshot-0/_SUCCESS").unlink()
    assert [tuple(r) for r in t.read().collect()] == [("a", 1)]
    assert t.fold() == 0
    assert [tuple(r) for r in t.read().collect()] == [("a", 1)]


def test_a_stream_killed_in_its_batch(spark, tmp_path):
    """The batch fails after its rows were written; the rerun writes it again under its number."""
    spark.range(20).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v")).write.parquet(f"{tmp_path}/in")
    own = replay.stream_session(spark)
    stream = lambda: own.readStream.schema("k string, v int").parquet(f"{tmp_path}/in")

    class Dies(sinks.UpsertTable):
        def fold(self, every=1):
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        Dies(own, f"{tmp_path}/t", "k").start(stream(), f"{tmp_path}/ck").awaitTermination()
    t = sinks.UpsertTable(own, f"{tmp_path}/t", "k")
    t.start(stream(), f"{tmp_path}/ck", fold_every=1).awaitTermination()
    assert t.read().count() == 20
    assert t._folders("snapshot") == [0]


def test_stage_changes(spark):
    """One row a stage, each with what was known then; the last equals the staged event."""
    rows = [(1, "pass", True, True, True, True), (2, "pass", True, False, None, None), (3, "drop", None, None, None, None), (4, "pass", False, True, True, True), (5, "context_only", None, None, None, None), (6, "pass", True, True, True, None)]
    staged = events.stages(spark.createDataFrame(rows, "event_id int, filter_decision string, stable boolean, extracted boolean, vectorized boolean, classified boolean"))
    changes = events.stage_changes(staged)
    statuses = ["stabilization_status", "extraction_status", "vectorization_status", "classification_status"]
    by_event = {i: [(r["stage_name"], *(r[c] for c in statuses), r["profiled"]) for r in changes.filter(F.col("event_id") == i).orderBy("stage").collect()] for i in range(1, 7)}
    assert [r[0] for r in by_event[1]] == ["filter", "stabilization", "extraction", "vectorization", "classification"]
    assert by_event[1][1] == ("stabilization", "stable", "pending", "pending", "pending", False)
    assert by_event[2][-1] == ("extraction", "stable", "failed", "skipped", "pending", False)
    assert by_event[2][1] == ("stabilization", "stable", "pending", "pending", "pending", False)
    assert [r[0] for r in by_event[3]] == ["filter"]
    last = profiles.latest(changes, "event_id", "stage").select("event_id", *statuses, "profiled")
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in staged.select("event_id", *statuses, "profiled").collect()}


DEDUP = "event_id bigint, process_key string, file_path string, event_type string, us bigint"


def test_keys_of_a_bucket_are_one_call(spark, tmp_path, monkeypatch):
    """Every key of its own, and all of them are a few calls' and a few state rows; batches see what came before, null keys too."""
    from fathomline.streaming import states

    r = random.Random(5)
    rows = [(i, r.choice([None, "p", "q"]), r.choice([None, "", f"/F{r.randrange(30)}"]), r.choice(["modified", None]), T0 + i * SECOND) for i in range(240)]
    expected = {tuple(x) for x in events.deduplicate(spark.createDataFrame(rows, DEDUP), 20 * SECOND).select("event_id", "is_duplicate").collect()}
    feed = Feed(spark, str(tmp_path), DEDUP, lambda s: pipelines.deduplicated(s, 20 * SECOND, expire=False, buckets=4))
    found = []
    for k in (0, 80, 160):
        part = rows[k:k + 80]
        r.shuffle(part)
        out, held = feed.give(part, state=True)
        found += out
    assert {tuple(x) for x in found} == expected
    assert {d for _, d in expected} == {True, False}
    assert held <= 4
    assert states.BUCKET not in found[0]


def test_silent_keys_leave_their_bucket():
    """Time-to-live is each key's own, though a bucket's keys are one value."""
    from types import SimpleNamespace

    import pandas as pd

    from fathomline.streaming import states

    value = SimpleNamespace(held=None)
    value.exists, value.get, value.update = lambda: value.held is not None, lambda: value.held, lambda v: setattr(value, "held", v)
    d = states.Deduplicator(SECOND, True)
    d.init(SimpleNamespace(getValueState=lambda *_, **__: value))

    def give(now_ms, *rows):
        frame = pd.DataFrame(rows, columns=["event_id", states.KEY, "us"])
        return pd.concat(d.handleInputRows((0,), iter([frame]), SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now_ms)))["is_duplicate"].tolist()

    assert give(0, (0, "a", 0), (1, "b", 0)) == [False, False]
    assert give(3_000, (2, "b", 1)) == [True]
    assert give(4_500, (3, "a", 2), (4, "b", 2)) == [False, True]  # four windows after a's last event
    assert len(states._unpacked(value.held)) == 2


def test_processes_of_a_bucket_do_not_meet(spark, tmp_path):
    """All processes in one bucket or each in its own: the same profiles, active and expired, in the same batches, from a state of a few rows."""
    r = random.Random(7)
    rows = sorted((event(str(i), r.randrange(0, 300_000) / 1000, r.choice([HIT, GOOD, None]), f"p{r.randrange(12)}", f"/f{r.randrange(5)}", r.random()) for i in range(150)), key=lambda e: e[2])
    found = []
    for buckets in (1, 4096):
        feed = Feed(spark, f"{tmp_path}/{buckets}", EVENT, lambda s, n=buckets: pipelines.profiled(s, 10 * SECOND, "1 second", n))
        given = [feed.give(rows[k:k + 50], state=True) for k in (0, 50, 100)]
        found.append([sorted(map(str, out)) for out, _ in given])
        if buckets == 1:
            assert max(held for _, held in given) <= states_of_a_bucket()
    assert found[0] == found[1]
    assert sum("expired" in x for out in found[0] for x in out) > 20


def states_of_a_bucket() -> int:
    from fathomline.streaming import states

    return 2 * states.Profiler.PARTS + 2 + 2  # spans of a window and of those that lag behind, and the timer's two rows


def test_activity_and_names_in_one_bucket(spark, tmp_path):
    """Every process and identifier in one bucket: as the batch operators have it, and a few state rows."""
    r = random.Random(10)
    rows = [(str(i), r.choice(["modified", "deleted"]), r.choice([None, "p", "q", "r"]), "x.exe", f"/d/{i}.txt", ".txt", 1, T0 + i * 300_000) for i in range(90)]
    config = events.FilterConfig(activity_us=2 * SECOND, activity_count=3)
    expected = {(x["event_id"], x["activity"]) for x in events.prefilter(spark.createDataFrame(rows, ACTIVITY), config).collect()}
    feed = Feed(spark, f"{tmp_path}/a", ACTIVITY, lambda s: pipelines.prefiltered(s, config, "1 second", 1))
    given = [feed.give(rows[k:k + 30], state=True) for k in (0, 30, 60)]
    assert {(x["event_id"], x["activity"]) for out, _ in given for x in out} == expected
    assert max(held for _, held in given) <= 3

    rows = [(s, a, k[0] if k else None, p) for s, a, _, k, p, _ in raw_rows(120, 6) if not k or len(k) == 1]
    expected = names_by_hand([(s, a, "h", [k], p, 0) for s, a, k, p in rows], False)
    feed = Feed(spark, f"{tmp_path}/n", "seq bigint, action string, file_key string, file_path string", lambda s: pipelines.correlated(s, buckets=1))
    given = [feed.give(rows[at:at + 40], state=True) for at in range(0, len(rows), 40)]
    assert sorted((x["seq"], x["resolved_path"]) for out, _ in given for x in out) == expected
    assert max(held for _, held in given) <= 1
