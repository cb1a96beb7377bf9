"""Event fields, stages, reasons and stabilisation, with the values that the engine's contract names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fathomline.functions import fields
from fathomline.operators import events, profiles
from fathomline.sources import files


def test_leaves_to_any_depth():
    text = '{"ProviderGuid":"{EDD0}","x":1.50,"a":{"b":{"c":{"d":{"e":{"FileName":"deep","n":null}}}}},"File Name":"later","l":[1,{"k":2.0}],"t":true,"N":"now"}'
    assert fields.leaves(text) == {"providerguid": "{EDD0}", "x": "1.50", "filename": "deep", "n": "now", "l": '[1,{"k":2.0}]', "t": "true"}
    assert fields.leaves('{"a":' * 500 + '{"Leaf":"x"}' + "}" * 500) == {"leaf": "x"}
    for bad in (None, "", "{broken", "[1]", "7", '{"a":' * 100_000):
        assert fields.leaves(bad) == {}


def test_reasons(spark):
    base = {"events_in_window": 1, "classified_events_count": 0, "ransomware_encrypted_count": 0, "ransomware_ratio": 0.0, "max_ransomware_probability": 0.0, "avg_ransomware_probability": 0.0, "touched_files_unique": 1, "consecutive_ransomware_hits": 0}
    hit = base | {"classified_events_count": 1, "ransomware_encrypted_count": 1, "ransomware_ratio": 1.0, "max_ransomware_probability": 0.95, "avg_ransomware_probability": 0.95, "consecutive_ransomware_hits": 1}
    found = [r["decision_reason"] for r in profiles.with_score(spark.createDataFrame([base | {"i": 0}, hit | {"i": 1}])).orderBy("i").collect()]
    assert found == ["no scoring rules matched", "ransomware_encrypted_count>=1 (+25); max_ransomware_probability>=0.92 (+5); max_ransomware_probability>=0.95 (+10)"]


def test_stages_short_circuit(spark):
    rows = [("drop", True, True, True, True), ("context_only", True, True, True, True), ("pass", None, True, True, True), ("pass", True, False, True, True), ("pass", True, True, None, True), ("pass", True, True, True, False), ("pass", True, True, True, True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, filter_decision string, stable boolean, extracted boolean, vectorized boolean, classified boolean")
    found = [tuple(r) for r in events.stages(df).orderBy("i").select("stabilization_status", "extraction_status", "vectorization_status", "classification_status", "profiled").collect()]
    assert found == [("skipped", "skipped", "skipped", "pending", False), ("skipped", "skipped", "skipped", "pending", True), ("failed", "skipped", "skipped", "pending", False), ("stable", "failed", "skipped", "pending", False),
                     ("stable", "success", "failed", "pending", False), ("stable", "success", "success", "failed", False), ("stable", "success", "success", "success", True)]


def test_stabilisation_limits(spark):
    rows = [("a", 1, 5, 1, None), ("a", 2, None, None, "OSError: busy"), ("a", 3, 5, 1, None), ("a", 4, 5, 1, None), ("a", 5, 5, 1, None), ("a", 6, 5, 1, None),
            ("b", 1, None, None, "gone"), ("b", 2, None, None, "gone still"), ("c", 1, 1, 1, None), ("c", 2, 2, 1, None), *(("d", i, 7 if i > 20 else i, 7, None) for i in range(1, 30))]
    df = spark.createDataFrame(rows, "file_path string, attempt int, size int, mtime int, error string")
    found = {r["file_path"]: tuple(r)[1:] for r in events.stabilisation(df).collect()}
    assert found == {"a": (5, 5, "stable", 5, None), "b": (None, 2, "failed", None, "gone still"), "c": (None, 2, "failed", None, "file remained unstable"), "d": (None, 20, "failed", None, "file remained unstable")}
    assert events.stabilisation(df, checks=1).filter("file_path = 'b'").first()["status"] == "failed"


def test_monitored_folders(spark):
    df = spark.createDataFrame([(1, "/a/x.txt"), (2, "/ab/x.txt"), (3, "/a"), (4, "/c/x.txt")], "event_id int, file_path string").selectExpr("*", "'modified' AS event_type", "'.txt' AS file_extension", "1 AS file_size", "'p' AS process_name", "'k' AS process_key", "0 AS us")
    assert {r["event_id"] for r in events.prefilter(df, events.FilterConfig(monitored=("/a",))).collect()} == {1, 3}


def test_events_without_ids_keep_theirs(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"timestamp": "2026-06-18T10:00:00+00:00", "file_path": "/t/a.bin"}\n{"timestamp": "2026-06-18T10:00:00+00:00", "file_path": "/t/b.bin"}\n')
    first, again = ({r["event_id"] for r in files.read_events(spark, str(p)).collect()} for _ in range(2))
    assert first == again and len(first) == 2


def test_binary_payloads(spark):
    r = spark.range(1).select(events.utf16_text(F.encode(F.lit("aé\0b"), "UTF-16LE")).alias("t"), events.pointer(F.lit(48879)).alias("p")).first()
    assert (r["t"], r["p"]) == ("aé", "0xBEEF")


@pytest.mark.parametrize("folder", ["data+set", "a.b(c)"])
def test_class_folders_with_odd_names(spark, tmp_path, folder):
    d = tmp_path / folder / "benign"
    d.mkdir(parents=True)
    (d / "1-png.png").write_bytes(b"x")
    assert [r["path"] for r in files.scan_classes(spark, str(tmp_path / folder)).collect()] == ["benign/1-png.png"]
