"""Classification metrics, pair consistency, and the tables behind a parameter search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def confusion(rows: DataFrame, n: int = 3) -> DataFrame:
    """y_true, y_pred, n for every cell, empty ones too."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(i, j) for i in range(n) for j in range(n)], "y_true int, y_pred int")
    counts = rows.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    return grid.join(counts, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def f1_scores(rows: DataFrame, n: int = 3) -> DataFrame:
    """label, precision, recall, f1, support; 0 where a denominator is."""
    c = confusion(rows, n)
    labels = c.select(F.explode(F.array("y_true", "y_pred")).alias("label"), "*")
    per = labels.groupBy("label").agg(
        F.max(F.when((F.col("y_true") == F.col("label")) & (F.col("y_pred") == F.col("label")), F.col("n"))).alias("tp"),
        F.sum(F.when((F.col("y_true") != F.col("label")) & (F.col("y_pred") == F.col("label")), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col("y_true") == F.col("label")) & (F.col("y_pred") != F.col("label")), F.col("n")).otherwise(0)).alias("fn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    tp, fp, fn = (F.col(x) for x in ("tp", "fp", "fn"))
    return per.select("label", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"))


def _one_vs_rest(rows: DataFrame, n: int) -> DataFrame:
    """label, score, positive: a row for each class; then distinct thresholds with their counts, so ties are one step."""
    wide = rows.select(F.explode(F.array(*(F.struct(F.lit(i).alias("label"), F.col(f"s{i}").alias("score"), (F.col("y_true") == i).cast("long").alias("positive")) for i in range(n)))).alias("r"))
    return wide.select("r.*").groupBy("label", "score").agg(F.sum("positive").alias("p"), F.count("*").alias("n"))


#: Ranges that scores are cut into for running sums, about.
RANGES = 64


def running(t: DataFrame, keys: list[str], order: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """t with, for each name in sums, the sum of that column over rows of equal keys that come before in order (a number, unique by keys).

    Rows are dealt to ranges of order by quantiles of a pass before, each range sums for itself, and a
    small table of the ranges' totals gives what lies before each: no task has all rows of a key.
    """
    edges = t.approxQuantile(order, [i / RANGES for i in range(1, RANGES)], 0.005)
    cuts = sorted(set(edges))
    number = F.lit(0)
    for c in cuts:
        number = number + F.when(F.col(order) > c, 1).otherwise(0)
    ranged = t.withColumn("_range", -number if descending else number)
    totals = ranged.groupBy(*keys, "_range").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))  # a row a key and range
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(*keys, "_range", *(F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums))
    inside = W.partitionBy(*keys, "_range").orderBy(F.col(order).desc() if descending else F.col(order)).rowsBetween(W.unboundedPreceding, -1)
    ranged = ranged.join(F.broadcast(before), [*keys, "_range"])  # RANGES rows a key
    return ranged.select(*(c for c in t.columns), *((F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_{n}")).alias(n) for n, c in sums.items()))


def roc_auc(rows: DataFrame, n: int = 3) -> DataFrame:
    """label, roc_auc: the chance that a positive outscores a negative, ties half. Distinct scores are summed range by range."""
    neg = F.col("n") - F.col("p")
    t = running(_one_vs_rest(rows, n).withColumn("neg", neg), ["label"], "score", {"below": "neg"})
    t = t.withColumn("beaten", F.col("p") * (F.col("below") + F.col("neg") / 2.0))
    return t.groupBy("label").agg((F.sum("beaten") / (F.sum("p") * F.sum(neg))).alias("roc_auc"))


def average_precision(rows: DataFrame, n: int = 3) -> DataFrame:
    """label, average_precision: sum over thresholds of the step in recall times precision."""
    t = running(_one_vs_rest(rows, n), ["label"], "score", {"above_p": "p", "above_n": "n"}, descending=True)
    t = t.withColumn("precision", (F.col("above_p") + F.col("p")) / (F.col("above_n") + F.col("n")))
    return t.groupBy("label").agg((F.sum(F.col("p") * F.col("precision")) / F.sum("p")).alias("average_precision"))


def augmented_recall(rows: DataFrame) -> DataFrame:
    """n and the share of augmented positives (class 2) that are predicted so; null without any."""
    return rows.filter(F.col("is_augmented") & (F.col("y_true") == 2)).agg(F.count("*").alias("n"), F.avg((F.col("y_pred") == 2).cast("double")).alias("augmented_recall"))


def pair_consistency(rows: DataFrame, strict: bool = True) -> DataFrame:
    """The share of augmented positives predicted so whose source is right too.

    Source: the row that isn't augmented, of class 0 or 1, whose pair_id is the augmented row's
    aug_parent. Strict: a blank parent, one with several sources or none is an error.
    """
    aug = rows.filter(F.col("is_augmented") & (F.col("y_true") == 2)).select(F.trim("aug_parent").alias("aug_parent"), F.col("y_pred").alias("aug_pred"))
    wanted = aug.select(F.col("aug_parent").alias("pair_id")).distinct()
    source = rows.filter(~F.col("is_augmented") & F.col("y_true").isin(0, 1)).join(wanted, "pair_id", "left_semi")
    source = source.groupBy("pair_id").agg(F.count("*").alias("sources"), F.max((F.col("y_pred") == F.col("y_true")).cast("int")).alias("right"))
    joined = aug.join(source, aug.aug_parent == source.pair_id, "left")
    if strict:
        ok = F.when(F.coalesce(F.col("aug_parent"), F.lit("")) == "", F.raise_error(F.lit("an augmented row has no parent"))).when(F.col("sources").isNull(), F.raise_error(F.concat(F.lit("no source for "), F.col("aug_parent")))).when(F.col("sources") > 1, F.raise_error(F.concat(F.lit("several sources for "), F.col("aug_parent")))).otherwise(True)
        joined = joined.filter(ok)
    both = ((F.col("aug_pred") == 2) & (F.col("right") == 1)).cast("double")
    return joined.agg(F.count("*").alias("pairs"), F.avg(F.coalesce(both, F.lit(0.0))).alias("pair_consistency"))


def _ranged(t: DataFrame, order: str) -> DataFrame:
    """t with the number of the range of order, by quantiles of a pass before, that each row is in; nulls are in the first."""
    number = F.lit(0)
    for c in sorted(set(t.approxQuantile(order, [i / RANGES for i in range(1, RANGES)], 0.005))):
        number = number + F.when(F.col(order) > c, 1).otherwise(0)
    return t.withColumn("_range", number)


def running_best(trials: DataFrame, score: str) -> DataFrame:
    """trials with best_so_far, by trial. Each range of trials has a running maximum of its own, and a small table the best of all ranges before."""
    ranged = _ranged(trials, "trial")
    totals = ranged.groupBy("_range").agg(F.max(score).alias("_best"))  # RANGES rows
    before = totals.select("_range", F.max("_best").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)).alias("_best"))
    inside = F.max(score).over(W.partitionBy("_range").orderBy("trial").rowsBetween(W.unboundedPreceding, W.currentRow))
    return ranged.withColumn("_inside", inside).join(F.broadcast(before), "_range").select(*trials.columns, F.greatest("_inside", "_best").alias("best_so_far"))


def best_trial(trials: DataFrame, score: str) -> DataFrame:
    return trials.orderBy(F.col(score).desc_nulls_last(), "trial").limit(1)


def heatmap(trials: DataFrame, row: str, column: str, score: str, rows: list, columns: list) -> DataFrame:
    """Mean score and count by two parameters with fixed axes: empty cells are there, mean null and count 0."""
    spark = trials.sparkSession
    axis = spark.createDataFrame([(x,) for x in rows], f"{row} {trials.schema[row].dataType.simpleString()}")
    wide = trials.groupBy(row).pivot(column, columns).agg(F.avg(score).alias("mean"), F.count(F.lit(1)).alias("n"))
    joined = axis.join(wide, row, "left")
    return joined.select(row, *(F.col(f"`{c}_mean`").alias(f"mean_{c}") for c in columns), *(F.coalesce(F.col(f"`{c}_n`"), F.lit(0)).cast("long").alias(f"n_{c}") for c in columns))


def average_ranks(t: DataFrame, columns: list[str]) -> DataFrame:
    """t with rank_<column> for each: a value's place in order, the mean of the places of equal ones. Distinct values are counted and summed range by range; nulls have no rank."""
    for c in columns:
        values = running(t.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("_value")).agg(F.count("*").alias("_n")), [], "_value", {"_below": "_n"})
        ranks = values.select(F.col("_value").alias(c), (F.col("_below") + (F.col("_n") + 1) / 2.0).alias(f"rank_{c}"))
        t = t.join(ranks, c, "left")
    return t


def spearman(trials: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, rho of each pair of columns: Pearson over average ranks."""
    ranked = average_ranks(trials.select(*columns), columns).select(*(F.col(f"rank_{c}").alias(c) for c in columns))
    pairs = [(a, b) for a in columns for b in columns]
    one = ranked.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    cells = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("rho")) for a, b in pairs)))
    return one.select(cells.alias("r")).select("r.*")


def parameter_grid(spark, axes: dict[str, list]) -> DataFrame:
    """Every combination of a few parameter values, numbered in order."""
    frames = [spark.createDataFrame([(x,) for x in values], [name]).coalesce(1) for name, values in axes.items()]
    grid = reduce(lambda a, b: a.crossJoin(b), frames)  # the product is what is asked for: tens of rows
    return grid.withColumn("trial", F.row_number().over(W.orderBy(*axes)))


def binned(value: Column, edges: list[float]) -> Column:
    """The number of the right-closed bin a value is in, the lowest edge included; null outside."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 1, 0, -1):
        low = value >= edges[0] if i == 1 else value > edges[i - 1]
        out = F.when(low & (value <= edges[i]), i - 1).otherwise(out)
    return out


def fold_statistics(folds: DataFrame, key: str, score: str) -> DataFrame:
    """Mean and population deviation over folds, of finite scores."""
    x = F.when(~F.isnan(score) & (F.abs(F.col(score)) != float("inf")), F.col(score))
    return folds.groupBy(key).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.count("*").alias("folds"))
