"""What a deployment carries: the fitted vectoriser and its contract, checked before use; metrics and artefacts as JSON and Parquet."""

from __future__ import annotations

import datetime
import hashlib
import json
import math
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from fathomline.operators.vectorise import Vectoriser
from fathomline.schema import FEATURES, LABELS, NUMERIC, SCALED


def schema_hash(features: list[str], kinds: dict[str, str]) -> str:
    """SHA-256 of the canonical JSON of names and kinds in order."""
    return hashlib.sha256(json.dumps([[f, kinds[f]] for f in features], separators=(",", ":")).encode()).hexdigest()


@dataclass(frozen=True)
class Bundle:
    version: str
    features: list[str]
    kinds: dict[str, str]
    scaled: list[str]
    labels: list[str]
    fills: dict[str, float | bool]
    means: dict[str, float]
    deviations: dict[str, float]
    schema_sha256: str

    @classmethod
    def of(cls, v: Vectoriser, version: str) -> Bundle:
        features = [*v.booleans, *v.numbers]
        kinds = {c: "bool" for c in v.booleans} | {c: "float" for c in v.numbers}
        return cls(version, features, kinds, list(v.means), list(LABELS), {**v.booleans, **v.numbers}, v.means, v.deviations, schema_hash(features, kinds))

    def problems(self) -> list[str]:
        """What is wrong with the bundle; nothing if it can be used."""
        found = []
        if not self.version:
            found.append("version is empty")
        if len(set(self.features)) != len(self.features):
            found.append("a feature is listed twice")
        if set(self.fills) != set(self.features):
            found.append("fill values don't cover the features")
        if list(self.labels) != list(LABELS):
            found.append("labels differ from the known classes")
        if set(self.means) != set(self.scaled) or set(self.deviations) != set(self.scaled) or not set(self.scaled) <= set(self.features):
            found.append("scaling doesn't cover the scaled features")
        if any(not math.isfinite(x) for x in [*self.means.values(), *self.deviations.values()]) or any(x <= 0 for x in self.deviations.values()):
            found.append("means must be finite and deviations positive")
        if self.schema_sha256 != schema_hash(self.features, self.kinds):
            found.append("the schema's hash doesn't match")
        return found

    def vectoriser(self) -> Vectoriser:
        if found := self.problems():
            raise ValueError("unusable bundle: " + "; ".join(found))
        booleans = {c: bool(self.fills[c]) for c in self.features if self.kinds[c] == "bool"}
        return Vectoriser(booleans, {c: float(self.fills[c]) for c in self.features if c not in booleans}, self.means, self.deviations)

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=1))

    @classmethod
    def load(cls, path: str | Path) -> Bundle:
        values = json.loads(Path(path).read_text())
        names = cls.__dataclass_fields__.keys()
        if values.keys() != names:
            raise ValueError(f"unusable bundle: missing {sorted(names - values.keys())}, unknown {sorted(values.keys() - names)}")
        return cls(**values)


def full_schema_lists() -> tuple[list[str], list[str], list[str]]:
    """Boolean, numeric and scaled features of the whole table, for fit()."""
    return [c for c in NUMERIC if FEATURES[c] == "bool"], [c for c in NUMERIC if FEATURES[c] != "bool"], list(SCALED)


def clean(value):
    """For JSON: NaN and infinities are null."""
    if isinstance(value, dict):
        return {k: clean(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [clean(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def save_json(values: dict, path: str | Path) -> None:
    Path(path).write_text(json.dumps(clean(values), indent=1, sort_keys=True))


def save_matrix(vectors: DataFrame, path: str, label: str = "y", weights: dict[str, float] | None = None) -> None:
    """Vectorised rows as Parquet, by split where there is one, in `data`; beside them, as JSON of a row each, `label_map` (number of each class) and, where given, `class_weights`. All through Spark's writers, so that path may be of any file system."""
    writer = vectors.write.mode("overwrite")
    (writer.partitionBy("split") if "split" in vectors.columns else writer).parquet(f"{path}/data")
    spark = vectors.sparkSession
    spark.createDataFrame(list(enumerate(LABELS)), f"{label} int, gt_class string").coalesce(1).write.mode("overwrite").json(f"{path}/label_map")
    if weights is not None:
        spark.createDataFrame(sorted(weights.items()), "gt_class string, weight double").coalesce(1).write.mode("overwrite").json(f"{path}/class_weights")


def load_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, int], dict[str, float]]:
    """What save_matrix wrote: rows, number by class, weight by class (none where none were given)."""
    labels = {r["gt_class"]: next(v for k, v in r.asDict().items() if k != "gt_class") for r in spark.read.json(f"{path}/label_map").collect()}
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/class_weights")
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    weights = {r["gt_class"]: r["weight"] for r in spark.read.json(f"{path}/class_weights").collect()} if there else {}
    return spark.read.parquet(f"{path}/data"), labels, weights


def run_stamp(at: datetime.datetime | None = None) -> str:
    """A name for a run's folder: UTC date and time to the second, in order as text."""
    return (at or datetime.datetime.now(datetime.UTC)).astimezone(datetime.UTC).strftime("%Y%m%d_%H%M%S")
