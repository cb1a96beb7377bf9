"""Train-only imputation, log and scaling as one fit and a pure Column transform; coercions, labels, class weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.schema import LABELS

# What counts as true and as false, in the feature table and (differently) in the is_augmented mark.
TRUE, FALSE = ("true", "t", "1", "yes", "1.0"), ("false", "f", "0", "no", "", "0.0")
MARK_TRUE = ("true", "1", "yes", "y", "t")
LOGGED = "byte_chi2"
ZERO_FILLED = "pdf_version"


def to_bool(value: Column) -> Column:
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin(*TRUE), True).when(v.isin(*FALSE), False)


def to_number(value: Column) -> Column:
    return F.trim(value.cast("string")).try_cast("double")


def is_marked(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin(*MARK_TRUE), F.lit(False))


def encode_label(label: Column) -> Column:
    """0, 1, 2; an unknown label is an error that names it."""
    out = F.when(label.isNull(), F.raise_error(F.lit("label is null")))
    for i, name in enumerate(LABELS):
        out = out.when(label == name, i)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown label: "), label)))


@dataclass(frozen=True)
class Vectoriser:
    """What a fit has learned from training rows, and its application to any."""

    booleans: dict[str, bool]
    numbers: dict[str, float]
    means: dict[str, float]
    deviations: dict[str, float]
    logged: str = LOGGED

    def transform(self, df: DataFrame) -> DataFrame:
        """df with its features filled, logged, scaled and cast; one projection, no pass over data before it."""
        filled = {c: F.coalesce(F.col(f"`{c}`"), F.lit(v)) for c, v in (self.booleans | self.numbers).items()}
        out = {}
        for c in self.booleans:
            out[c] = filled[c].cast("tinyint")
        for c in self.numbers:
            x = F.log1p(F.greatest(filled[c], F.lit(0.0))) if c == self.logged else filled[c].cast("double")
            out[c] = ((x - self.means[c]) / self.deviations[c] if c in self.means else x).cast("float")
        return df.withColumns(out)


#: Values of a bracket that are looked at one by one; how much wider than the rank a sketch's bracket is; a sketch's accuracy.
FEW, MARGIN, ACCURACY = 10_000, 0.01, 10_000


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The exact median of each column (the mean of the middle two of an even number; None without values; NaN is no value).

    Bracket selection, for all columns together: a quantile sketch gives each a bracket around its
    middle, a pass counts what is below the bracket and in it, and so on inside the bracket until it
    holds one value or few. Each pass is one aggregation of a row; a sketch that is off is seen by
    the counts and the bracket before is cut again, with a margin twice as wide.
    """
    x = {c: F.nullif(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in columns}
    n = df.agg(F.count("*").alias("_n"), *(F.count(x[c]).alias(c) for c in columns)).first()
    found: dict[str, float | None] = {c: None for c in columns if not n[c]}
    low, high = dict.fromkeys(columns, float("-inf")), dict.fromkeys(columns, float("inf"))
    below, inside = dict.fromkeys(columns, 0), {c: n[c] for c in columns}
    margin = dict.fromkeys(columns, MARGIN)
    middle = {c: ((n[c] - 1) // 2, n[c] // 2) for c in columns}  # places of the middle two
    held = {c: F.when((x[c] >= F.lit(low[c])) & (x[c] <= F.lit(high[c])), x[c]) for c in columns}
    while large := [c for c in columns if c not in found and inside[c] > FEW]:
        shares = {c: [max(0.0, (middle[c][0] - below[c]) / inside[c] - margin[c]), min(1.0, (middle[c][1] - below[c]) / inside[c] + margin[c])] for c in large}
        sketch = df.agg(*(F.percentile_approx(held[c], shares[c], ACCURACY).alias(c) for c in large)).first()
        counts = df.agg(*(F.count_if(x[c] < F.lit(sketch[c][0])).alias(f"b_{c}") for c in large), *(F.count_if((x[c] >= F.lit(sketch[c][0])) & (x[c] <= F.lit(sketch[c][1]))).alias(f"i_{c}") for c in large)).first()
        for c in large:
            b, i = counts[f"b_{c}"], counts[f"i_{c}"]
            if b <= middle[c][0] and middle[c][1] < b + i:
                if sketch[c][0] == sketch[c][1]:
                    found[c] = sketch[c][0]
                narrower = i < 0.9 * inside[c]
                low[c], high[c], below[c], inside[c] = *sketch[c], b, i
                held[c] = F.when((x[c] >= F.lit(low[c])) & (x[c] <= F.lit(high[c])), x[c])
                if narrower or c in found:
                    continue
                # so many equal values that no bracket is smaller: what lies at its ends is told apart
                ends = df.agg(F.count_if(x[c] == F.lit(low[c])).alias("l"), F.min(F.when(x[c] > F.lit(low[c]), x[c])).alias("next")).first()
                if middle[c][1] < below[c] + ends["l"]:
                    found[c] = low[c]
                elif middle[c][0] >= below[c] + ends["l"]:
                    low[c], below[c], inside[c] = ends["next"], below[c] + ends["l"], inside[c] - ends["l"]
                    held[c] = F.when((x[c] >= F.lit(low[c])) & (x[c] <= F.lit(high[c])), x[c])
                else:
                    found[c] = (low[c] + ends["next"]) / 2
            else:
                margin[c] *= 2
    if small := [c for c in columns if c not in found]:
        values = df.agg(*(F.array_sort(F.collect_list(held[c])).alias(c) for c in small)).first()  # FEW at most
        for c in small:
            found[c] = (values[c][middle[c][0] - below[c]] + values[c][middle[c][1] - below[c]]) / 2
    return found


def fit(train: DataFrame, booleans: list[str], numbers: list[str], scaled: list[str]) -> Vectoriser:
    """Exact medians and modes of training rows (a tie is false; nothing known is 0 or false), then mean and population deviation after filling and the log. No row leaves the executors, and no task has a column's values."""
    modes = [(F.count_if(F.col(f"`{c}`")) > F.count_if(~F.col(f"`{c}`"))).alias(f"b_{c}") for c in booleans]
    first = train.agg(F.count("*").alias("_n"), *modes).first()
    bools = {c: bool(first[f"b_{c}"]) for c in booleans}
    middles = medians(train, [c for c in numbers if c != ZERO_FILLED])
    fills = {c: float(middles.get(c) or 0.0) for c in numbers}
    values = {}
    for c in scaled:
        x = F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(fills[c]))
        values[c] = F.log1p(F.greatest(x, F.lit(0.0))) if c == LOGGED else x
    second = train.agg(F.count("*").alias("_n"), *(F.avg(x).alias(f"m_{c}") for c, x in values.items()), *(F.stddev_pop(x).alias(f"s_{c}") for c, x in values.items())).first()
    means = {c: float(second[f"m_{c}"] or 0.0) for c in scaled}
    deviations = {c: float(second[f"s_{c}"] or 0.0) or 1.0 for c in scaled}
    return Vectoriser(bools, fills, means, deviations)


def class_weights(rows: DataFrame, label: str = "gt_class") -> DataFrame:
    """label, n, weight = N / (K n) over the classes that occur; 0 for one that doesn't."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    known = rows.sparkSession.createDataFrame([(x,) for x in LABELS], f"{label} string")
    joined = known.join(counts, label, "left").crossJoin(F.broadcast(total))  # three rows and one row
    return joined.select(label, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(F.col("n") > 0, F.col("total") / (F.col("k") * F.col("n"))).otherwise(0.0).alias("weight"))
