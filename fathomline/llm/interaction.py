"""Filter interaction audit: what each filter removes in every order of filters.

The orders form a trie. A documents' walk down it is the same for all prefixes with the same filters, so
states are the sets of filters applied, and the walk goes depth first: a state's survivors are a
persisted DataFrame, one job counts what each filter not yet applied removes from them, each filter
makes the survivors of a next state, and a state already seen is not walked again. Five filters have 32
states and 80 edges for 120 orders of 5 steps. Only the states on the way down are persisted, at most one a filter.

Texts are read once: what the filters say of a document is a narrow row in the shared checkpoint folder,
so a lost executor costs a filter over such rows again.
"""

from __future__ import annotations

import itertools
import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, small_side, table

LEAST_WORDS, DISTINCT_SHARE, UPPER_SHARE, SYMBOLS = 100, 80, 10, r"[#$%&*|]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Tasks that hold a state's counts, a row a part.
COUNT_TASKS = 4


def conditions(text: Column) -> dict[str, Column]:
    """The failure conditions that look at one text; true removes it."""
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < DISTINCT_SHARE * F.size(words).cast("long"),
        "C": 100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))).cast("long") > UPPER_SHARE * F.length(text).cast("long"),
        "D": text.rlike(SYMBOLS),
    }


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One narrow row per row of docs: part, A to E (true: the filter removes it), good, toxic.

    E compares texts by SHA-256 with the smallest doc_id that has the same; a null doc_id is neither
    smaller nor larger than another, so it neither fails E nor makes others fail. Labels of one doc_id
    count together: good if any row says quality 1, toxic if any says 1.
    """
    text = F.coalesce("text", F.lit(""))
    rows = cut(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), *(c.alias(f) for f, c in conditions(text).items())))
    # a table of its own: broadcast if it is counted to be small, else the join's sides are plain shuffles and a text with very many copies can be split
    first = cut(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marks = marks.filter("good OR toxic")
    no = F.lit(False)
    joined = rows.join(small_side(first), "digest", "left").join(marks, "doc_id", "left")
    return joined.select("part", "A", "B", "C", "D", F.coalesce(F.col("doc_id") > F.col("first"), no).alias("E"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def walk(rows: DataFrame, filters: str) -> DataFrame:
    """part, state (the filters applied, in alphabetical order), n (survivors) and for each filter f not applied removed_f, good_f, toxic_f."""
    states: dict[str, DataFrame] = {}

    def visit(applied: str, survivors: DataFrame) -> None:
        left = [f for f in filters if f not in applied]
        removes = lambda f, also: F.count_if(F.col(f) & F.col(also) if also else F.col(f))
        counts = survivors.groupBy("part").agg(F.count("*").alias("n"), *(removes(f, also).alias(f"{name}_{f}") for f in left for name, also in (("removed", ""), ("good", "good"), ("toxic", "toxic"))))
        absent = [F.lit(None).cast("long").alias(f"{name}_{f}") for f in applied for name in ("removed", "good", "toxic")]
        states[applied] = cut(counts.select("*", F.lit(applied).alias("state"), *absent).coalesce(COUNT_TASKS))
        for f in left:
            after = "".join(sorted(applied + f))
            if after not in states:
                rest = survivors.filter(~F.col(f)).persist(StorageLevel.MEMORY_AND_DISK)
                visit(after, rest)
                rest.unpersist()

    start = rows.persist(StorageLevel.MEMORY_AND_DISK)
    visit("", start)
    start.unpersist()
    parts = next(iter(states.values()))
    for counts in list(states.values())[1:]:
        parts = parts.unionByName(counts)
    return parts


def interactions(rows: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley over judged rows.

    Each part has a row for every order of the filters and step, zeros included, also where no row of
    it is left; no rows give none.
    """
    states = cut(walk(rows, filters))
    size = {f: i for i, f in enumerate(filters)}
    steps = [("".join(order), k + 1, f, "".join(sorted(order[:k])), "".join(sorted(order[:k + 1]))) for order in itertools.permutations(filters) for k, f in enumerate(order)]
    orders = rows.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, before string, after string")

    edge = F.explode(F.array(*(F.struct(F.lit(f).alias("filter"), *(F.col(f"{name}_{f}").alias(to) for name, to in (("removed", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost")))) for f in size)))
    edges = states.select("part", F.col("state").alias("before"), edge.alias("e")).select("part", "before", "e.*").filter("removed IS NOT NULL")
    survivors = states.select("part", F.col("state").alias("after"), F.col("n").alias("kept"))
    # orders that pass an edge: those of what is applied before it times those of what comes after
    n = len(filters)
    ways = F.create_map(*(F.lit(x) for k in range(n) for x in (k, math.factorial(k) * math.factorial(n - 1 - k))))
    others = F.create_map(*(F.lit(x) for f in filters for x in (f, "".join(sorted(set(filters) - {f})))))
    by_filter = edges.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == "", F.col("removed"))).alias("fails"),
        F.coalesce(F.sum(F.when(F.col("before") == others[F.col("filter")], F.col("removed"))), F.lit(0)).alias("unique_fails"),
        F.sum(F.col("removed") * ways[F.length("before")]).alias("shapley"))

    found = by_filter.join(F.broadcast(orders), "filter")  # a row for each part, order and step
    found = found.join(edges, ["part", "before", "filter"], "left").join(survivors, ["part", "after"], "left")
    long = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    removed = long("removed")
    return found.select("part", "filter_order", "step", long("kept").alias("kept"), removed.alias("removed"), (F.col("fails") - removed).cast("long").alias("redundant"), long("unique_fails").alias("unique_fails"),
                        long("good_lost").alias("good_lost"), long("toxic_lost").alias("toxic_lost"), long("shapley").alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """interactions() of docs (doc_id, text, lang) with labels (doc_id, quality, toxic); other columns are ignored.

    Null texts are empty, a null lang is the part of the empty string, repeated rows count again (rows
    of one doc_id with one text don't fail E for each other), labels without a document count nowhere.
    """
    return interactions(judged(docs, labels))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
first AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
judged AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                  CASE WHEN len(words) < {LEAST_WORDS} THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < {DISTINCT_SHARE} * len(words) THEN 'B' ELSE '' END
                  || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > {UPPER_SHARE} * length(text) THEN 'C' ELSE '' END
                  || CASE WHEN regexp_matches(text, '{SYMBOLS}') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails
           FROM d JOIN first USING (text) LEFT JOIN marks USING (doc_id)),
kinds AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM judged GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
           WHERE a.f <> b.f AND a.f <> c.f AND a.f <> d.f AND a.f <> e.f AND b.f <> c.f AND b.f <> d.f AND b.f <> e.f AND c.f <> d.f AND c.f <> e.f AND d.f <> e.f),
steps AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS gone FROM orders, (SELECT unnest(range(1, 6))::INTEGER AS step)),
met AS (SELECT part, filter_order, step, f, fails, n, n_good, n_toxic, contains(fails, f) AS fail, translate(fails, gone, '') <> fails AS earlier FROM kinds, steps),
counted AS (SELECT part, filter_order, step, f,
                   coalesce(sum(n) FILTER (NOT fail AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fail AND NOT earlier), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fail AND earlier), 0)::BIGINT AS redundant,
                   coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails, coalesce(sum(n_good) FILTER (fail AND NOT earlier), 0)::BIGINT AS good_lost, coalesce(sum(n_toxic) FILTER (fail AND NOT earlier), 0)::BIGINT AS toxic_lost
            FROM met GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM counted
"""
