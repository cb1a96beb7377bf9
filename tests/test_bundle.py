"""Bundles, searches, augmented rows, configuration checks and the command line."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from fathomline.__main__ import main
from fathomline.operators import bundle, events, extraction, search
from fathomline.operators.vectorise import Vectoriser
from fathomline.sources import files

V = Vectoriser({"flag": False}, {"byte_chi2": 1.0}, {"byte_chi2": 0.5}, {"byte_chi2": 2.0})


def test_bundle_round_trip(tmp_path):
    b = bundle.Bundle.of(V, "1")
    b.save(tmp_path / "b.json")
    assert bundle.Bundle.load(tmp_path / "b.json").vectoriser() == V
    assert main(["check-bundle", str(tmp_path / "b.json")]) == 0
    for change, message in (({"deviations": {"byte_chi2": 0.0}}, "positive"), ({"fills": {}}, "fill values"), ({"labels": ["x"]}, "labels"), ({"kinds": {"flag": "bool", "byte_chi2": "int"}}, "hash"), ({"version": ""}, "version")):
        with pytest.raises(ValueError, match=message):
            bundle.Bundle(**(b.__dict__ | change)).vectoriser()
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError, match="missing"):
        bundle.Bundle.load(tmp_path / "bad.json")


def test_json_has_no_nan(tmp_path):
    bundle.save_json({"a": [float("nan"), 1.0], "b": {"c": float("inf")}}, tmp_path / "m.json")
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": [None, 1.0], "b": {"c": None}}


def test_settings_are_distinct_and_seeded():
    axes = {"a": [1, 2, 3], "b": [1, 2]}
    found = search.random_settings(axes, 4)
    assert found == search.random_settings(axes, 4) and len({tuple(x.items()) for x in found}) == 4
    assert len(search.random_settings(axes, 99)) == 6


def test_cross_validation(spark):
    rows = spark.range(120).select((F.col("id") % 12).cast("string").alias("group_id"), F.element_at(F.array(*map(F.lit, ["benign", "benign-encrypted", "ransomware-encrypted"])), (F.col("id") % 3 + 1).cast("int")).alias("gt_class"), (F.col("id") % 3).cast("int").alias("y_true"))
    folds = search.cross_validate(rows, [{"shift": 0}, {"shift": 1}], lambda train, test, s: test.withColumn("y_pred", ((F.col("y_true") + s["shift"]) % 3).cast("int")), folds=2)
    table = {r["trial"]: r["macro_f1_mean"] for r in search.trial_table(folds, "macro_f1").collect()}
    assert table == {1: 1.0, 2: 0.0}


def test_augmented_rows(spark):
    made = spark.createDataFrame([("1-png-x-aug.png", "header-only", 3.0), ("2-png-aug.png", "intermittent", 1.0)], "name string, algorithm string, byte_chi2 double")
    parents = spark.createDataFrame([("1-png-x.png", "1-png-x"), ("2-png.png", "2-png")], "name string, pair_id string")
    found = {r["path"]: (r["pair_id"], r["aug_parent"], r["aug_encryption"], r["is_augmented"]) for r in extraction.augmented_rows(made, parents).collect()}
    assert found == {"1-png-x-aug.png": ("1-png-x", "1-png-x", "header-only", True), "2-png-aug.png": ("2-png", "2-png", "intermittent", True)}


def test_configuration_is_checked(tmp_path):
    events.check_config(events.FilterConfig())
    for bad in ({"max_size": 0}, {"supported": ("txt",)}, {"supported": (".tmp",)}, {"monitored": ("/a",), "ignored": ("/a",)}):
        with pytest.raises(ValueError):
            events.check_config(events.FilterConfig(**bad))
    (tmp_path / "q.yaml").write_text("q: {A: 0.5, b: 0.5}\nbad: {a: 0.6, b: 0.5}\nodd: {a: x}")
    assert files.read_quotas(tmp_path / "q.yaml", "q") == {"a": 0.5, "b": 0.5}
    for section in ("bad", "odd"):
        with pytest.raises(ValueError):
            files.read_quotas(tmp_path / "q.yaml", section)


def test_sources_are_resolved(spark):
    found = spark.createDataFrame([("a/x.bin",), ("b/y.bin",)], "path string")
    assert {tuple(r) for r in files.resolve(spark.createDataFrame([("a/x.bin",), ("gone/y.bin",)], "path string"), found).collect()} == {("a/x.bin", "a/x.bin"), ("gone/y.bin", "b/y.bin")}
    with pytest.raises(Exception, match="no source file"):
        files.resolve(spark.createDataFrame([("z.bin",)], "path string"), found).collect()
