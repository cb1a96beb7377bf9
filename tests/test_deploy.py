"""Deployments: saved with their model, checked when loaded, the same scores in another session, failures as a status."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from fathomline.operators import boosting, bundle, deploy, repository, vectorise
from fathomline.sources import files

FEATURES = "id long, features map<string,string>, y int"


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 2))
    return spark.createDataFrame([(i, {"flag": "true" if a > 0 else "no", "byte_chi2": str(float(np.exp(a))), "size_bytes": str(float(b)), "unknown": "z"}, int(a > 0.5) + int(b > 0)) for i, (a, b) in enumerate(x)], FEATURES)


@pytest.fixture(scope="module")
def contract(rows):
    wide = rows.select("y", vectorise.to_bool(F.element_at("features", "flag")).alias("flag"), *(F.element_at("features", c).cast("double").alias(c) for c in ("byte_chi2", "size_bytes")))
    return bundle.Bundle.of(vectorise.fit(wide, ["flag"], ["byte_chi2", "size_bytes"], ["byte_chi2", "size_bytes"]), "v7")


@pytest.fixture(scope="module")
def boosted(rows, contract):
    v = deploy.vectorised(rows, contract).select("y", *(F.col("feature_vector")[i].alias(c) for i, c in enumerate(contract.features)))
    return deploy.Deployment(contract, boosting.fit(v, contract.features, "y", 3, boosting.Params(rounds=3, leaves=4, rate=0.5, bins=16)), list(contract.labels))


def results(df):
    return {r["id"]: (r["classification_result"], r["classification_status"], r["classification_error"], r["vectorization_error"]) for r in df.collect()}


def test_the_same_scores_in_another_session(spark, rows, boosted, tmp_path):
    boosted.save(tmp_path / "d")
    here = results(deploy.classified(deploy.vectorised(rows, boosted.bundle), boosted))
    other = spark.newSession()
    again = deploy.Deployment.load(tmp_path / "d")
    there = other.createDataFrame(rows.collect(), FEATURES)
    assert results(deploy.classified(deploy.vectorised(there, again.bundle), again)) == here
    assert all(status == "success" and error is None and r["classifier_version"] == "v7" and sum(r[c] for c in ("benign_probability", "benign_encrypted_probability", "ransomware_encrypted_probability")) == pytest.approx(1) for r, status, error, _ in here.values())


def test_a_pipeline_of_spark_ml(spark, rows, contract, tmp_path):
    """A model of two classes, in an order of its own: probabilities go by label, the third has none."""
    from pyspark.ml.functions import array_to_vector

    v = deploy.vectorised(rows, contract).select(array_to_vector("feature_vector").alias("vector"), (F.col("y") == 0).cast("int").alias("y"))
    d = deploy.Deployment(contract, Pipeline(stages=[LogisticRegression(featuresCol="vector", labelCol="y")]).fit(v), ["ransomware-encrypted", "benign"])
    d.save(tmp_path / "p")
    again = deploy.Deployment.load(tmp_path / "p")
    found = deploy.classified(deploy.vectorised(rows, contract), again)
    assert set(found.columns) == {*rows.columns, "vectorization_error", "vectorization_status", "feature_vector", "classification_result", "classification_error", "classification_status"}
    for r, *_ in results(found).values():
        assert r["benign_encrypted_probability"] == 0
        assert r["predicted_class"] == ("benign" if r["benign_probability"] > 0.5 else "ransomware-encrypted")


def test_failures_are_a_status(spark, boosted):
    odd = spark.createDataFrame([(1, None, 0), (2, {}, 0), (3, {"byte_chi2": "not a number", "flag": "maybe"}, 0), (4, {"size_bytes": "Infinity"}, 0), (5, {"byte_chi2": "NaN"}, 0)], FEATURES)
    found = results(deploy.classified(deploy.vectorised(odd, boosted.bundle), boosted))
    assert [found[i][1] for i in range(1, 6)] == ["pending", "success", "success", "pending", "pending"]
    assert (found[1][3], found[4][3], found[5][3]) == ("features are unavailable", "not finite: size_bytes", "not finite: byte_chi2")
    assert found[2][0] == found[3][0]  # both are filled
    short = deploy.vectorised(odd, boosted.bundle).withColumn("feature_vector", F.array(F.lit(1.0)))
    r, status, error, _ = results(deploy.classified(short, boosted))[1]
    assert (r, status, error) == (None, "failed", "vector has 1 values, the model takes 3")


def test_what_is_wrong_is_told(boosted, tmp_path):
    import dataclasses

    with pytest.raises(ValueError, match="no manifest"):
        deploy.Deployment.load(tmp_path)
    for change, message in (({"classes": ["benign"]}, "number of classes"), ({"classes": ["benign", "x", "y"]}, "known labels"), ({"model": dataclasses.replace(boosted.model, features=["a"])}, "features differ")):
        with pytest.raises(ValueError, match=message):
            dataclasses.replace(boosted, **change).save(tmp_path / "no")
    boosted.save(tmp_path / "d")
    model = json.loads((tmp_path / "d/model.json").read_text())
    (tmp_path / "d/model.json").write_text(json.dumps(model | {"base": [0.0, 0.0, 9.0]}))
    with pytest.raises(ValueError, match="was changed"):
        deploy.Deployment.load(tmp_path / "d")
    (tmp_path / "d/model.json").unlink()
    with pytest.raises(ValueError, match="missing"):
        deploy.Deployment.load(tmp_path / "d")


def test_classes_are_read_below_the_root(spark, tmp_path):
    """Folders above the root, and others of its name, say nothing."""
    root = tmp_path / "benign" / "data" / "data"
    for name in ("benign/1-png.png", "ransomware-encrypted/sub/2-pdf.pdf", "other/benign/3-png.png", "benign-encrypted/data/4-png.png"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x")
    (root / "benign.txt").write_bytes(b"x")
    found = {(r["path"], r["gt_class"]) for r in files.scan_classes(spark, f"{root}/").select("path", "gt_class").collect()}
    assert found == {("benign/1-png.png", "benign"), ("ransomware-encrypted/sub/2-pdf.pdf", "ransomware-encrypted"), ("benign-encrypted/data/4-png.png", "benign-encrypted")}


def test_lookup(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    assert repository.lookup(df, "id", 2) == {"id": 2, "name": None}
    assert repository.lookup(df, "id", 3) is None
