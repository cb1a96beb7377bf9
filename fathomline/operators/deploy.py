"""A fitted model with its contract: saved together, checked when loaded, applied row by row with a status in place of an exception."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.operators import boosting, vectorise
from fathomline.operators.bundle import Bundle

SUCCESS, FAILED, PENDING = "success", "failed", "pending"
# Fixed value: what is said of a row without features.
NO_FEATURES = "features are unavailable"
RESULT = "predicted_class string, benign_probability double, benign_encrypted_probability double, ransomware_encrypted_probability double, classifier_version string"


@dataclass(frozen=True)
class Deployment:
    """bundle: the vectoriser's contract; model: boosted trees over its features, or a pipeline of spark.ml that takes the column `vector` and gives `probability` and `prediction`; classes: what label each of the model's outputs is of."""

    bundle: Bundle
    model: boosting.Model | PipelineModel
    classes: list[str]

    def problems(self) -> list[str]:
        found = self.bundle.problems()
        if sorted(set(self.classes)) != sorted(self.classes) or not set(self.classes) <= set(self.bundle.labels):
            found.append("the model's classes aren't known labels")
        if isinstance(self.model, boosting.Model):
            if self.model.features != self.bundle.features:
                found.append("the model's features differ from the bundle's")
            if self.model.classes != len(self.classes):
                found.append("the model has another number of classes")
        return found

    def save(self, folder: str | Path) -> None:
        """bundle.json, the model, and a manifest with their hashes; a deployment that could not be used isn't saved."""
        if found := self.problems():
            raise ValueError("unusable deployment: " + "; ".join(found))
        folder = Path(folder)
        folder.mkdir(parents=True, exist_ok=True)
        self.bundle.save(folder / "bundle.json")
        kind = "boosted" if isinstance(self.model, boosting.Model) else "pipeline"
        if kind == "boosted":
            (folder / "model.json").write_text(self.model.to_json())
        else:
            self.model.write().overwrite().save((folder / "model").as_uri())
        manifest = {"kind": kind, "classes": self.classes, "bundle": _hash(folder / "bundle.json"), "model": _hash(folder / "model.json") if kind == "boosted" else None}
        (folder / "manifest.json").write_text(json.dumps(manifest, indent=1))

    @classmethod
    def load(cls, folder: str | Path) -> Deployment:
        """The saved deployment; raises if a file is missing or changed, or if the parts don't fit each other."""
        folder = Path(folder)
        if not (folder / "manifest.json").is_file():
            raise ValueError(f"unusable deployment: no manifest in {folder}")
        m = json.loads((folder / "manifest.json").read_text())
        for part in ("bundle", "model"):
            if m[part] and (not (folder / f"{part}.json").is_file() or _hash(folder / f"{part}.json") != m[part]):
                raise ValueError(f"unusable deployment: {part}.json is missing or was changed")
        model = boosting.Model.from_json((folder / "model.json").read_text()) if m["kind"] == "boosted" else PipelineModel.load((folder / "model").as_uri())
        out = cls(Bundle.load(folder / "bundle.json"), model, m["classes"])
        if found := out.problems():
            raise ValueError("unusable deployment: " + "; ".join(found))
        return out


def _hash(path: Path) -> str:
    return hashlib.sha256(path.read_bytes()).hexdigest()


def vectorised(rows: DataFrame, bundle: Bundle, features: str = "features") -> DataFrame:
    """rows(features map<string,string>, ...) with feature_vector, vectorization_status and vectorization_error.

    What can't be read as its kind is filled like what is missing. A row without features fails, and so does
    one with a value that isn't finite, which is named.
    """
    v = bundle.vectoriser()
    missing = F.col(features).isNull()
    raw = {c: vectorise.to_bool(F.element_at(features, c)) if bundle.kinds[c] == "bool" else vectorise.to_number(F.element_at(features, c)) for c in bundle.features}
    own = {c: f"_v_{i}" for i, c in enumerate(bundle.features)}
    prefixed = vectorise.Vectoriser({own[c]: x for c, x in v.booleans.items()}, {own[c]: x for c, x in v.numbers.items()}, {own[c]: x for c, x in v.means.items()}, {own[c]: x for c, x in v.deviations.items()}, own.get(vectorise.LOGGED, ""))
    filled = prefixed.transform(rows.withColumns({own[c]: x for c, x in raw.items()}))
    value = {c: F.col(own[c]).cast("double") for c in bundle.features}
    odd = F.array_compact(F.array(*(F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(c)) for c, x in value.items())))
    error = F.when(missing, F.lit(NO_FEATURES)).when(F.size(odd) > 0, F.concat(F.lit("not finite: "), F.array_join(odd, ", ")))
    out = filled.withColumn("vectorization_error", error).withColumn("vectorization_status", F.when(F.col("vectorization_error").isNull(), SUCCESS).otherwise(FAILED))
    return out.withColumn("feature_vector", F.when(F.col("vectorization_error").isNull(), F.array(*value.values()))).drop(*own.values())


def classified(rows: DataFrame, deployment: Deployment) -> DataFrame:
    """vectorised rows with classification_result, classification_status and classification_error.

    Probabilities go by label: one that the model doesn't know has 0. Rows without a vector stay
    pending; one whose vector has another length than the model's fails.
    """
    labels, classes, n = deployment.bundle.labels, deployment.classes, len(deployment.bundle.features)
    vector = F.col("feature_vector")
    fits = vector.isNotNull() & (F.size(vector) == n)
    safe = F.when(fits, vector).otherwise(F.array_repeat(F.lit(0.0), n))
    if isinstance(deployment.model, boosting.Model):
        columns = {f"_x{i}": F.get(safe, F.lit(i)) for i in range(n)}
        model = boosting.Model(**{**deployment.model.__dict__, "features": list(columns)})
        scored = boosting.predict(model, rows.withColumns(columns)).drop(*columns)
        probabilities = [F.col(f"s{k}") for k in range(model.classes)]
        predicted: Column = F.col("y_pred")
        extra = [f"s{k}" for k in range(model.classes)] + ["y_pred"]
    else:
        from pyspark.ml.functions import array_to_vector

        scored = deployment.model.transform(rows.withColumn("vector", array_to_vector(safe)))
        p = vector_to_array("probability") if isinstance(scored.schema["probability"].dataType, VectorUDT) else F.col("probability")
        probabilities = [F.get(p, F.lit(k)) for k in range(len(classes))]
        predicted = F.col("prediction").cast("int")
        extra = [c for c in scored.columns if c not in rows.columns]
    by_label = {c: F.coalesce(x, F.lit(0.0)) for c, x in zip(classes, probabilities, strict=True)}
    result = F.struct(F.get(F.array(*(F.lit(c) for c in classes)), predicted).alias("predicted_class"), *(by_label.get(label, F.lit(0.0)).alias(f"{label.replace('-', '_')}_probability") for label in labels), F.lit(deployment.bundle.version).alias("classifier_version"))
    error = F.when(vector.isNotNull() & ~fits, F.concat(F.lit("vector has "), F.size(vector).cast("string"), F.lit(f" values, the model takes {n}")))
    status = F.when(vector.isNull(), PENDING).when(fits, SUCCESS).otherwise(FAILED)
    return scored.withColumns({"classification_result": F.when(fits, result), "classification_error": error, "classification_status": status}).drop(*extra)
