"""Classifiers over vectorised rows: random forest (our own, by counts), and one-vs-rest boosted trees and a multilayer perceptron of spark.ml."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators import forest, vectorise
from fathomline.schema import LABELS

SEED = 42


def assembled(df: DataFrame, features: list[str], label: str = "y", weights: bool = True) -> DataFrame:
    """df with a feature vector and, for training, each row's class weight."""
    out = VectorAssembler(inputCols=features, outputCol="features").transform(df)
    if weights:
        w = vectorise.class_weights(df, "gt_class").select("gt_class", F.col("weight").alias("class_weight"))
        out = out.join(F.broadcast(w), "gt_class")  # three rows
    return out


def random_forest(train: DataFrame, features: list[str], trees: int = 500, depth: int = 14) -> forest.Model:
    """spark.ml's forest visits every row for every tree and level; this one counts equal rows once."""
    weights = {r["gt_class"]: r["weight"] for r in vectorise.class_weights(train).collect()}  # three rows
    return forest.fit(train, features, "y", [weights[x] for x in LABELS], forest.Params(trees, depth, seed=SEED))


def boosted(train: DataFrame, rounds: int = 100, rate: float = 0.05, depth: int = 6):
    base = GBTClassifier(labelCol="y", maxIter=rounds, stepSize=rate, maxDepth=depth, subsamplingRate=0.9, seed=SEED)
    return OneVsRest(classifier=base, labelCol="y", weightCol="class_weight").fit(train)


def perceptron(train: DataFrame, n_features: int, hidden: int = 100, rounds: int = 100):
    return MultilayerPerceptronClassifier(labelCol="y", layers=[n_features, hidden, 3], maxIter=rounds, seed=SEED).fit(train)


def predictions(model, df: DataFrame) -> DataFrame:
    """df with y_pred and, where the model gives them, the class probabilities s0..s2 (a class that training lacked has 0)."""
    out = model.transform(df).withColumn("y_pred", F.col("prediction").cast("int"))
    if "probability" in out.columns:
        p = vector_to_array("probability")
        out = out.withColumns({f"s{i}": F.coalesce(F.get(p, F.lit(i)), F.lit(0.0)) for i in range(3)})
    return out.drop("rawPrediction", "probability", "prediction", "features")
