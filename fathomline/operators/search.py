"""Hyper-parameter search: seeded samples of settings or a Parzen search, grouped cross-validation, one table of trials."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators import evaluation, parzen, sampling


def random_settings(axes: dict[str, list], n: int, seed: int = 42) -> list[dict]:
    """n distinct settings (as many as there are, if fewer), drawn with a seed."""
    total = 1
    for values in axes.values():
        total *= len(values)
    out = []
    for k in random.Random(seed).sample(range(total), min(n, total)):
        setting = {}
        for name, values in axes.items():
            k, i = divmod(k, len(values))
            setting[name] = values[i]
        out.append(setting)
    return out


def fold_scores(predicted: DataFrame) -> dict[str, float | None]:
    """macro_f1, class_2_f1, class_2_recall and augmented_recall of a fold's predictions."""
    f1 = {r["label"]: r for r in evaluation.f1_scores(predicted).collect()}
    out = {"macro_f1": sum(r["f1"] for r in f1.values()) / len(f1), "class_2_f1": f1[2]["f1"], "class_2_recall": f1[2]["recall"]}
    if "is_augmented" in predicted.columns:
        out["augmented_recall"] = evaluation.augmented_recall(predicted).first()["augmented_recall"]
    return out


FitPredict = Callable[[DataFrame, DataFrame, dict], DataFrame]


def _fold_rows(split: DataFrame, trial: int, setting: dict, fit_predict: FitPredict, folds: int) -> list[dict]:
    out = []
    for i in range(folds):
        began = time.time()
        train, test = (split.filter(F.col("split") != f"fold_{i}"), split.filter(F.col("split") == f"fold_{i}"))
        scores = fold_scores(fit_predict(train, test, setting))
        out.append({"trial": trial, "fold": i, "elapsed_seconds": time.time() - began} | setting | scores)
    return out


def in_folds(rows: DataFrame, folds: int) -> DataFrame:
    return sampling.grouped_split(rows, {f"fold_{i}": 1 / folds for i in range(folds)}).persist()


def cross_validate(rows: DataFrame, settings: list[dict], fit_predict: FitPredict, folds: int = 5) -> DataFrame:
    """A row per trial and fold: trial, fold, elapsed_seconds, the setting and its scores. rows: group_id, gt_class, ...; whole groups are in a fold. Fits are distributed; trials run one after another."""
    split = in_folds(rows, folds)
    try:
        found = [r for trial, setting in enumerate(settings, 1) for r in _fold_rows(split, trial, setting, fit_predict, folds)]
    finally:
        split.unpersist()
    return rows.sparkSession.createDataFrame(found)


def parzen_cross_validate(rows: DataFrame, space: dict, fit_predict: FitPredict, n: int = 150, folds: int = 5, score: str = "class_2_f1", batch: int = 4, seed: int = 42, startup: int = parzen.STARTUP) -> DataFrame:
    """The table of cross_validate for n settings that a Parzen search chooses by the mean of a score over folds. The settings of a batch are fitted side by side."""
    split = in_folds(rows, folds)
    found: list[dict] = []

    def evaluate(settings: list[dict]) -> list[float | None]:
        first = len(found) // folds + 1
        numbered = list(enumerate(settings, first))
        with ThreadPoolExecutor(batch) as pool:
            parts = list(pool.map(lambda x: _fold_rows(split, *x, fit_predict, folds), numbered))
        for part in parts:
            found.extend(part)
        return [None if any(r[score] is None for r in part) else sum(r[score] for r in part) / folds for part in parts]

    try:
        parzen.search(space, evaluate, n, batch, seed, startup)
    finally:
        split.unpersist()
    return rows.sparkSession.createDataFrame(found)


def trial_table(folds: DataFrame, score: str) -> DataFrame:
    """One row per trial: mean and population deviation of a score over its folds, and its time."""
    s = evaluation.fold_statistics(folds, "trial", score)
    return s.join(folds.groupBy("trial").agg(F.sum("elapsed_seconds").alias("elapsed_seconds")), "trial").withColumnsRenamed({"mean": f"{score}_mean", "std": f"{score}_std"})
