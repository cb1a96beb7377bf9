"""Queries over datasets, splits, vectorisation, evaluation and parameter search, with the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomline.operators import evaluation, sampling, vectorise
from fathomline.session import cut
from fathomline.sources import tables

QUERIES, ORACLES = {}, {}
# Quotas per extension and per algorithm of the configured augmentation.
EXTENSION_QUOTAS = {"gzip": 0.15, "tar": 0.15, "rar": 0.15, "png": 0.10, "gif": 0.10, "bin": 0.10, "dll": 0.10, "apk": 0.05, "epub": 0.05, "oxps": 0.05}
ALGORITHM_QUOTAS = {"header-only": 0.5, "intermittent": 0.5}
LANGUAGE_QUOTAS = {"en": 0.5, "de": 0.3, "fr": 0.2}
SEED = 20240101


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_D = f"WITH {tables.DATASET_SQL}"


@query(_D + " SELECT group_id, gt_class, count(*) AS n FROM dataset GROUP BY ALL")
def group_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.dataset(spark, sf_dir).groupBy("group_id", "gt_class").agg(F.count("*").alias("n"))


@query()
def stratified_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.grouped_split(tables.dataset(spark, sf_dir).select("doc_id", "group_id", "gt_class"))


@query()
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.grouped_split(tables.dataset(spark, sf_dir).select("doc_id", "group_id", "gt_class"), {f"fold_{i}": 0.2 for i in range(5)})


@query("""WITH k AS (SELECT p_type AS kind, count(*) AS capacity FROM part GROUP BY 1),
q AS (SELECT kind, capacity, 1.0::DOUBLE / count(*) OVER () AS quota, row_number() OVER (ORDER BY kind) AS pos, round_even(sum(capacity) OVER () * 0.25, 0) AS target FROM k),
d AS (SELECT *, target * quota AS desired, least(capacity, floor(target * quota)) AS got FROM q),
o AS (SELECT *, target - sum(got) OVER () AS rest, coalesce(sum(capacity - got) OVER (ORDER BY desired - floor(desired) DESC, quota DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT kind, (got + greatest(0, least(capacity - got, rest - before)))::BIGINT AS allocated FROM o""")
def quota_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = tables.table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("kind")).agg(F.count("*").alias("capacity"))
    of_all = W.partitionBy()
    kinds = kinds.select("*", (F.lit(1.0) / F.count("*").over(of_all)).alias("quota"), F.row_number().over(of_all.orderBy("kind")).alias("place"))
    return sampling.allocated(kinds, 0.25).select("kind", "allocated")


@query("""WITH n AS (SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'O'), s AS (SELECT unnest(['a', 'b', 'c']) AS algorithm, unnest([0.5::DOUBLE, 0.3, 0.2]) AS share, unnest([1, 2, 3]) AS pos),
x AS (SELECT algorithm, pos, total, total * share AS exact, floor(total * share) AS low FROM s, n), r AS (SELECT *, row_number() OVER (ORDER BY exact - low DESC, pos) AS rk, total - sum(low) OVER () AS rest FROM x)
SELECT algorithm, (low + CASE WHEN rk <= rest THEN 1 ELSE 0 END)::BIGINT AS allocated FROM r""")
def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = tables.table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").agg(F.count("*").alias("n"))
    shares = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3)], "algorithm string, share double, place int")
    return sampling.remainders(shares, total).select("algorithm", "allocated")


@query(_D + """, pool AS (SELECT * FROM dataset WHERE orig_ext IN ('en', 'de', 'fr')),
k AS (SELECT orig_ext, count(*) AS capacity FROM pool GROUP BY 1),
q AS (SELECT *, CASE orig_ext WHEN 'en' THEN 0.5::DOUBLE WHEN 'de' THEN 0.3 ELSE 0.2 END AS quota, CASE orig_ext WHEN 'en' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS pos, round_even(sum(capacity) OVER () * 0.1::DOUBLE, 0) AS target FROM k),
d AS (SELECT *, target * quota AS desired, least(capacity, floor(target * quota)) AS got FROM q),
o AS (SELECT *, target - sum(got) OVER () AS rest, coalesce(sum(capacity - got) OVER (ORDER BY desired - floor(desired) DESC, quota DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
a AS (SELECT orig_ext, got + greatest(0, least(capacity - got, rest - before)) AS allowed FROM o),
r AS (SELECT doc_id, orig_ext, row_number() OVER (PARTITION BY orig_ext ORDER BY md5(doc_id || '-20240101'), doc_id) AS rk FROM pool)
SELECT doc_id, orig_ext FROM r JOIN a USING (orig_ext) WHERE rk <= allowed""")
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.quota_sample(tables.dataset(spark, sf_dir), "doc_id", "orig_ext", LANGUAGE_QUOTAS, 0.1, SEED).select("doc_id", "orig_ext")


@query("""WITH n AS (SELECT count(*) AS total FROM documents), c AS (SELECT total // 2 + total % 2 AS first FROM n),
r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '-20240101'), doc_id) AS place FROM documents) SELECT doc_id, CASE WHEN place <= first THEN 'header-only' ELSE 'intermittent' END AS algorithm FROM r, c""")
def algorithm_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.table(spark, sf_dir, "documents").select("doc_id")
    return sampling.algorithm_plan(d, "doc_id", sampling.largest_remainder(d.count(), ALGORITHM_QUOTAS), SEED)


@query(_D + ", d AS (SELECT doc_id, gt_class, pair_id || '-' || (n_chars // 100) AS pair_id FROM dataset) SELECT doc_id, pair_id FROM d WHERE gt_class IN ('benign', 'benign-encrypted') AND NOT EXISTS (SELECT 1 FROM d x WHERE x.gt_class = 'ransomware-encrypted' AND trim(x.pair_id) = d.pair_id)")
def independent_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.dataset(spark, sf_dir).withColumn("pair_id", F.concat_ws("-", "pair_id", F.expr("n_chars div 100").cast("string")))
    used = d.filter(F.col("gt_class") == "ransomware-encrypted").select(F.trim("pair_id").alias("pair_id")).filter("pair_id <> ''").distinct()
    return d.filter(F.col("gt_class").isin("benign", "benign-encrypted")).join(used, "pair_id", "left_anti").select("doc_id", "pair_id")


@query(_D + ", target AS (SELECT doc_id, gt_class, pair_id FROM dataset), aug AS (SELECT doc_id, 'ransomware-encrypted' AS gt_class, 'header-only' AS aug_encryption FROM dataset WHERE gt_class = 'benign') SELECT * FROM target UNION ALL BY NAME SELECT * FROM aug")
def merge_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.dataset(spark, sf_dir)
    aug = d.filter("gt_class = 'benign'").select("doc_id", F.lit("ransomware-encrypted").alias("gt_class"), F.lit("header-only").alias("aug_encryption"))
    return d.select("doc_id", "gt_class", "pair_id").unionByName(aug, allowMissingColumns=True)


_TEXTS = "(['true', 'T', '1', ' yes ', 'false', 'F', '0', 'no', '', 'maybe', '2'])[doc_id % 11 + 1]"


def _texts() -> F.Column:
    return F.element_at(F.array(*map(F.lit, ["true", "T", "1", " yes ", "false", "F", "0", "no", "", "maybe", "2"])), (F.col("doc_id") % 11 + 1).cast("int"))


@query(f"WITH t AS (SELECT doc_id, lower(trim({_TEXTS})) AS v FROM documents) SELECT doc_id, CASE WHEN v IN ('true', 't', '1', 'yes', '1.0') THEN true WHEN v IN ('false', 'f', '0', 'no', '', '0.0') THEN false END AS value, coalesce(v IN ('true', '1', 'yes', 'y', 't'), false) AS marked FROM t")
def bool_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "documents").select("doc_id", vectorise.to_bool(_texts()).alias("value"), vectorise.is_marked(_texts()).alias("marked"))


@query(f"SELECT doc_id, try_cast(trim({_TEXTS}) AS DOUBLE) AS value FROM documents")
def numeric_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "documents").select("doc_id", vectorise.to_number(_texts()).alias("value"))


#: The split of sampling.apportioned over documents' sources and languages.
_APPORTIONED = _D + """, g AS (SELECT pair_id, string_agg(DISTINCT gt_class, ',' ORDER BY gt_class) AS signature, ('0x' || substr(md5(pair_id), 1, 11))::BIGINT AS h FROM dataset GROUP BY pair_id),
r AS (SELECT *, ((h::HUGEINT * greatest(1, count(*) OVER (PARTITION BY signature) // 1024)) >> 44)::BIGINT AS part FROM g),
placed AS (SELECT *, count(*) OVER (PARTITION BY signature, part) AS n, row_number() OVER (PARTITION BY signature, part ORDER BY h, pair_id) AS place FROM r),
shares AS (SELECT * FROM (VALUES (0, 'train', 700), (1, 'valid', 150), (2, 'test', 150)) t(i, split, share)),
floors AS (SELECT n, i, split, (n - 3) * share % 1000 AS rest, (n - 3) * share // 1000 AS floor FROM (SELECT DISTINCT n FROM placed WHERE n >= 3), shares),
got AS (SELECT n, i, split, 1 + floor + CASE WHEN row_number() OVER (PARTITION BY n ORDER BY rest DESC, i) <= n - 3 - sum(floor) OVER (PARTITION BY n) THEN 1 ELSE 0 END AS got FROM floors),
ends AS (SELECT n, split, got, sum(got) OVER (PARTITION BY n ORDER BY i) AS upto FROM got),
few AS (SELECT pair_id, (['test', 'valid', 'train'])[(row_number() OVER (ORDER BY signature, h, pair_id) - 1) % 3 + 1] AS split FROM placed WHERE n < 3),
splits AS (SELECT pair_id, split FROM placed JOIN ends USING (n) WHERE place > upto - got AND place <= upto UNION ALL SELECT pair_id, split FROM few)"""


@query(_APPORTIONED + " SELECT doc_id, pair_id, split FROM dataset JOIN splits USING (pair_id)")
def apportioned_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("doc_id", "pair_id", "split")


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset with the split of each row's source and language."""
    d = tables.dataset(spark, sf_dir)
    groups = sampling.apportioned(d.select(F.col("pair_id").alias("group_id"), "gt_class"))
    return d.join(groups.withColumnRenamed("group_id", "pair_id"), "pair_id")


@query(_APPORTIONED + ", train AS (SELECT * FROM dataset JOIN splits USING (pair_id) WHERE split = 'train') SELECT coalesce(median(byte_chi2), 0.0) AS byte_chi2, coalesce(median(size_bytes), 0.0) AS size_bytes, count(CASE WHEN flag THEN 1 END) > count(CASE WHEN NOT flag THEN 1 END) AS flag FROM train")
def fill_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectorise.fit(_split(spark, sf_dir).filter("split = 'train'"), ["flag"], ["byte_chi2", "size_bytes"], ["byte_chi2", "size_bytes"])
    return spark.createDataFrame([(v.numbers["byte_chi2"], v.numbers["size_bytes"], v.booleans["flag"])], "byte_chi2 double, size_bytes double, flag boolean")


@query(_APPORTIONED + """, train AS (SELECT * FROM dataset JOIN splits USING (pair_id) WHERE split = 'train'), f AS (SELECT median(byte_chi2) AS mc, median(size_bytes) AS ms, count(CASE WHEN flag THEN 1 END) > count(CASE WHEN NOT flag THEN 1 END) AS mf FROM train),
m AS (SELECT avg(ln(1 + greatest(coalesce(byte_chi2, mc), 0))) AS uc, stddev_pop(ln(1 + greatest(coalesce(byte_chi2, mc), 0))) AS sc, avg(coalesce(size_bytes, ms)) AS us, stddev_pop(coalesce(size_bytes, ms)) AS ss FROM train, f)
SELECT doc_id, coalesce(flag, mf)::INT AS flag, round(((ln(1 + greatest(coalesce(byte_chi2, mc), 0)) - uc) / sc)::FLOAT::DOUBLE, 4) + 0.0 AS byte_chi2, round(((coalesce(size_bytes, ms) - us) / ss)::FLOAT::DOUBLE, 4) + 0.0 AS size_bytes FROM dataset, f, m""")
def vectorize_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _split(spark, sf_dir)
    v = vectorise.fit(d.filter("split = 'train'"), ["flag"], ["byte_chi2", "size_bytes"], ["byte_chi2", "size_bytes"])
    out = v.transform(d)
    return out.select("doc_id", F.col("flag").cast("int").alias("flag"), *((F.round(F.col(c).cast("double"), 4) + 0.0).alias(c) for c in ("byte_chi2", "size_bytes")))


@query(_D + ", c AS (SELECT gt_class, count(*) AS n FROM dataset GROUP BY 1) SELECT gt_class, n, round((sum(n) OVER ()) / (count(*) OVER () * n), 9) AS weight FROM c")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = vectorise.class_weights(tables.dataset(spark, sf_dir))
    return w.filter("n > 0").withColumn("weight", F.round("weight", 9))


@query(_D + " SELECT doc_id, CASE gt_class WHEN 'benign' THEN 0 WHEN 'benign-encrypted' THEN 1 ELSE 2 END AS y FROM dataset")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.dataset(spark, sf_dir).select("doc_id", vectorise.encode_label(F.col("gt_class")).alias("y"))


_S = f"WITH {tables.SCORED_SQL}"


@query(_S + ", g AS (SELECT a::INT AS y_true, b::INT AS y_pred FROM range(3) t(a), range(3) u(b)) SELECT y_true, y_pred, (SELECT count(*) FROM scored s WHERE s.y_true = g.y_true AND s.y_pred = g.y_pred) AS n FROM g")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(tables.scored(spark, sf_dir))


@query(_S + """, k AS (SELECT l::INT AS label, count(CASE WHEN y_true = l AND y_pred = l THEN 1 END) AS tp, count(CASE WHEN y_true <> l AND y_pred = l THEN 1 END) AS fp, count(CASE WHEN y_true = l AND y_pred <> l THEN 1 END) AS fn FROM scored, range(3) t(l) GROUP BY l)
SELECT label, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS "precision", round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1, tp + fn AS support FROM k""")
def f1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = evaluation.f1_scores(tables.scored(spark, sf_dir))
    return f.select("label", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")), "support")


_WIDE = _S + ", wide AS (SELECT 0 AS label, s0 AS score, y_true = 0 AS p FROM scored UNION ALL SELECT 1, s1, y_true = 1 FROM scored UNION ALL SELECT 2, s2, y_true = 2 FROM scored)"


@query(_WIDE + """, r AS (SELECT label, p, rank() OVER (PARTITION BY label ORDER BY score) + (count(*) OVER (PARTITION BY label, score) - 1) / 2.0 AS rk FROM wide),
k AS (SELECT label, sum(CASE WHEN p THEN rk END) AS sr, count(CASE WHEN p THEN 1 END)::DOUBLE AS np, count(CASE WHEN NOT p THEN 1 END)::DOUBLE AS nn FROM r GROUP BY label) SELECT label, round((sr - np * (np + 1) / 2) / (np * nn), 9) AS roc_auc FROM k""")
def roc_auc_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.roc_auc(tables.scored(spark, sf_dir)).select("label", F.round("roc_auc", 9).alias("roc_auc"))


@query(_WIDE + """, t AS (SELECT label, score, count(CASE WHEN p THEN 1 END) AS p, count(*) AS n FROM wide GROUP BY ALL),
c AS (SELECT label, p, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM t WINDOW w AS (PARTITION BY label ORDER BY score DESC)) SELECT label, round(sum(p * (cp / cn)) / sum(p), 9) AS average_precision FROM c GROUP BY label""")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.average_precision(tables.scored(spark, sf_dir)).select("label", F.round("average_precision", 9).alias("average_precision"))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.scored(spark, sf_dir)
    aug = F.col("y_true") == 2
    return s.select(aug.alias("is_augmented"), "y_true", "y_pred", F.when(~aug, F.col("vec_id").cast("string")).alias("pair_id"), F.when(aug, (F.col("vec_id") - F.col("vec_id") % 3).cast("string")).alias("aug_parent"))


_PRED = _S + ", pred AS (SELECT y_true = 2 AS is_augmented, y_true, y_pred, CASE WHEN y_true <> 2 THEN vec_id::VARCHAR END AS pair_id, CASE WHEN y_true = 2 THEN (vec_id - vec_id % 3)::VARCHAR END AS aug_parent FROM scored)"


@query(_PRED + " SELECT count(*) AS n, round(avg(CASE WHEN y_pred = 2 THEN 1.0 ELSE 0.0 END), 9) AS augmented_recall FROM pred WHERE is_augmented AND y_true = 2")
def augmented_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.augmented_recall(_predictions(spark, sf_dir)).select("n", F.round("augmented_recall", 9).alias("augmented_recall"))


@query(_PRED + """, src AS (SELECT pair_id, y_true, y_pred FROM pred WHERE NOT is_augmented AND y_true IN (0, 1))
SELECT count(*) AS pairs, round(avg(CASE WHEN a.y_pred = 2 AND s.y_pred = s.y_true THEN 1.0 ELSE 0.0 END), 9) AS pair_consistency FROM pred a LEFT JOIN src s ON a.aug_parent = s.pair_id WHERE a.is_augmented AND a.y_true = 2""")
def pair_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.pair_consistency(_predictions(spark, sf_dir), strict=False).select("pairs", F.round("pair_consistency", 9).alias("pair_consistency"))


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as trials: depth and rate as parameters, the balance as score."""
    s = tables.table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("trial"), (F.col("s_suppkey") % 4).cast("int").alias("depth"), (F.col("s_nationkey") % 3).cast("int").alias("rate"), F.col("s_acctbal").alias("score"))


_T = "WITH trials AS (SELECT s_suppkey AS trial, (s_suppkey % 4)::INT AS depth, (s_nationkey % 3)::INT AS rate, s_acctbal AS score FROM supplier)"


@query(_T + " SELECT depth, " + ", ".join(f"round(avg(CASE WHEN rate = {i} THEN score END), 6) AS mean_{i}, count(CASE WHEN rate = {i} THEN 1 END) AS n_{i}" for i in range(3)) + " FROM (SELECT depth, rate, score FROM trials UNION ALL SELECT d::INT, NULL, NULL FROM range(5) t(d)) GROUP BY depth")
def trial_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = evaluation.heatmap(_trials(spark, sf_dir), "depth", "rate", "score", list(range(5)), [0, 1, 2])
    return h.select("depth", *(F.round(f"mean_{i}", 6).alias(f"mean_{i}") for i in range(3)), *(f"n_{i}" for i in range(3)))


@query(_T + " SELECT trial, score, max(score) OVER (ORDER BY trial ROWS UNBOUNDED PRECEDING) AS best_so_far FROM trials")
def trial_running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.running_best(_trials(spark, sf_dir).select("trial", "score"), "score")


@query(_T + """, r AS (SELECT rank() OVER (ORDER BY depth) + (count(*) OVER (PARTITION BY depth) - 1) / 2.0 AS depth, rank() OVER (ORDER BY rate) + (count(*) OVER (PARTITION BY rate) - 1) / 2.0 AS rate, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS score FROM trials)
""" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 7) AS rho FROM r" for a in ("depth", "rate", "score") for b in ("depth", "rate", "score")))
def trial_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.spearman(_trials(spark, sf_dir), ["depth", "rate", "score"]).select("a", "b", F.round("rho", 7).alias("rho"))


@query(_T + " SELECT * FROM trials ORDER BY score DESC NULLS LAST, trial LIMIT 1")
def trial_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.best_trial(_trials(spark, sf_dir), "score")


@query("WITH g AS (SELECT leaves::BIGINT AS leaves, depth::BIGINT AS depth, rate FROM unnest([31, 64, 127, 255]) a(leaves), unnest([-1, 8, 12]) b(depth), unnest([0.01::DOUBLE, 0.05, 0.1]) c(rate)) SELECT *, row_number() OVER (ORDER BY leaves, depth, rate)::INT AS trial FROM g")
def param_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.parameter_grid(spark, {"leaves": [31, 64, 127, 255], "depth": [-1, 8, 12], "rate": [0.01, 0.05, 0.1]})


@query(_T + " SELECT trial, CASE WHEN score >= -1000 AND score <= 0 THEN 0 WHEN score > 0 AND score <= 5000 THEN 1 WHEN score > 5000 AND score <= 9000 THEN 2 END AS bin FROM trials")
def param_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trials(spark, sf_dir).select("trial", evaluation.binned(F.col("score"), [-1000.0, 0.0, 5000.0, 9000.0]).alias("bin"))


@query(_T + " SELECT depth, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, count(*) AS folds FROM trials GROUP BY depth")
def fold_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = evaluation.fold_statistics(_trials(spark, sf_dir), "depth", "score")
    return f.select("depth", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "folds")


def _trained(spark: SparkSession, sf_dir: str, fit_predict) -> DataFrame:
    """Predictions for every row; held_out: its group is in none that the model was fitted on. fit_predict: takes vectorised training rows, all rows and the features' names."""
    names = ["flag", "byte_chi2", "size_bytes"]
    d = cut(tables.dataset(spark, sf_dir).withColumn("y", vectorise.encode_label(F.col("gt_class"))))  # narrow rows, read many times
    split = sampling.grouped_split(d, {"train": 0.8, "test": 0.2})
    train = split.filter("split = 'train'").drop("split")
    v = vectorise.fit(train, ["flag"], ["byte_chi2", "size_bytes"], ["byte_chi2", "size_bytes"])
    found = fit_predict(v.transform(train), v.transform(split), names)
    return found.select("doc_id", (F.col("split") == "test").alias("held_out"), "y", "y_pred", "s0", "s1", "s2")


@query()
def rf_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathomline.operators import forest, models

    return _trained(spark, sf_dir, lambda train, rows, names: forest.predict(models.random_forest(train, names), rows))


@query()
def mlp_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathomline.operators import models

    return _trained(spark, sf_dir, lambda train, rows, names: models.predictions(models.perceptron(models.assembled(train, names), len(names)), models.assembled(rows, names, weights=False)))


def _with_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset, and for every benign row a partly encrypted copy: another class, other byte statistics, the group of its parent."""
    d = tables.dataset(spark, sf_dir).withColumn("is_augmented", F.lit(False))
    copies = d.filter("gt_class = 'benign'").withColumns({"gt_class": F.lit("ransomware-encrypted"), "is_augmented": F.lit(True), "byte_chi2": F.col("byte_chi2") / 4, "size_bytes": F.col("size_bytes") + 512})
    return d.unionByName(copies)


def _boosted(spark: SparkSession, sf_dir: str, rounds: int, augmented: bool) -> DataFrame:
    """Predictions for every row of a model that has learned from the training split's rows, with the validation split's (augmented) or without."""
    from fathomline.operators import boosting

    names = ["flag", "byte_chi2", "size_bytes", "n_chars"]
    rows = sampling.grouped_split(_with_augmented(spark, sf_dir).withColumn("y", vectorise.encode_label(F.col("gt_class"))))
    used = rows.filter("split <> 'test'") if augmented else rows.filter("split = 'train' AND NOT is_augmented")
    weights = vectorise.class_weights(used.filter("split = 'train'")).select("gt_class", F.col("weight"))
    used = used.join(F.broadcast(weights), "gt_class")  # three rows
    params = boosting.Params(rounds=rounds, rate=0.3, leaves=8, bins=64, patience=3)
    model = boosting.fit(used, names, "y", 3, params, F.col("weight"), F.col("split") == "valid", F.col("doc_id"))
    found = boosting.predict(model, rows.select("doc_id", "is_augmented", "split", "y", *names))
    return found.select("doc_id", "is_augmented", (F.col("split") == "test").alias("held_out"), "y", "y_pred", "s0", "s1", "s2")


@query()
def boosted_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boosted(spark, sf_dir, 10, True)


@query()
def boosted_no_aug_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boosted(spark, sf_dir, 6, False)


def rule_scores(rows: DataFrame, settings: list[dict]) -> list[float | None]:
    """The F1 of class 2 that each setting's decision rule has over all rows(y_true, s0, s1, s2): one job for all settings, which are few."""
    cases = rows.sparkSession.createDataFrame([(i, s["kind"], float(s["by"]), float(s["least"])) for i, s in enumerate(settings)], "i int, kind string, by double, least double")
    raised = F.when(F.col("kind") == "scale", F.col("s2") * F.col("by")).otherwise(F.col("s2") + F.col("by") - 1)
    hit = (raised >= F.greatest("s0", "s1")) & (raised >= F.col("least"))
    true = F.col("y_true") == 2
    counts = rows.join(F.broadcast(cases)).groupBy("i").agg(F.count_if(hit & true).alias("tp"), F.count_if(hit).alias("hits"), F.count_if(true).alias("n"))
    f1 = {r["i"]: 2 * r["tp"] / (r["hits"] + r["n"]) if r["hits"] + r["n"] else 0.0 for r in counts.collect()}  # a row a setting
    return [f1.get(i) for i in range(len(settings))]


@query()
def parzen_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trials of a search for the rule that tells class 2 best by the scored table's three scores."""
    from fathomline.operators import parzen

    rows = tables.scored(spark, sf_dir).persist()
    try:
        space = {"kind": parzen.Choice(("scale", "shift")), "by": parzen.Range(0.1, 10.0, log=True), "least": parzen.Range(-1.0, 1.0)}
        found = parzen.search(space, lambda settings: rule_scores(rows, settings), 40, batch=5)
    finally:
        rows.unpersist()
    return spark.createDataFrame([(r["trial"], r["kind"], r["by"], r["least"], r["score"]) for r in found], "trial long, kind string, by double, least double, class_2_f1 double")


@query()
def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two forests in three folds of whole groups; each fold's vectoriser is fitted on the others."""
    from fathomline.operators import forest, models, search

    names = ["flag", "byte_chi2", "size_bytes"]

    def fit_predict(train: DataFrame, test: DataFrame, setting: dict) -> DataFrame:
        v = vectorise.fit(train, ["flag"], names[1:], names[1:])
        model = models.random_forest(v.transform(train), names, setting["trees"], setting["depth"])
        return forest.predict(model, v.transform(test)).withColumnRenamed("y", "y_true")

    rows = tables.dataset(spark, sf_dir).withColumn("y", vectorise.encode_label(F.col("gt_class")))
    found = search.cross_validate(rows, [{"trees": 10, "depth": 4}, {"trees": 20, "depth": 6}], fit_predict, folds=3)
    return found.select("trial", "fold", "trees", "depth", "macro_f1", "class_2_f1", "class_2_recall")
