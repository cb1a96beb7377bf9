"""Source divergence audit: how far a language's sources lie apart in words, and which words mark a source.

Plain relational: the terms of each document are exploded and counted by (lang, source, term) with
partial sums before the shuffle, terms in enough documents of their language are kept, every group is
joined with its language's kept terms so that absent terms get their zero, a self-join on (lang, term)
gives the differences between sources, and windows rank what is left.

All arithmetic is exact: counts and shares are integers, the products that could pass 64 bits are
decimals of up to 38 digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

#: Runs of ASCII letters and of anything beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_DOCUMENTS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Groups (lang, source) that are broadcast; more are met in salted joins.
FEW_GROUPS, SALTS = 20_000, 32


def _groups_of(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), df (rows that hold it). Nulls are empty strings; repeated rows count again.

    A row is exploded once: its terms, then its distinct terms, told apart by their position.
    """
    text = F.coalesce("text", F.lit(""))
    # the same for text of ASCII alone, and several times as fast
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    terms = F.regexp_extract_all(folded, F.lit(TERM), 0)
    listed = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), terms.alias("terms"))
    exploded = listed.select("lang", "source", F.size("terms").alias("size"), F.posexplode(F.concat("terms", F.array_distinct("terms"))).alias("at", "term"))
    first = F.col("at") < F.col("size")
    return exploded.groupBy("lang", "source", "term").agg(F.count_if(first).alias("n"), F.count_if(~first).alias("df"))


def _by_lang(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows (lang, term, ...) joined with their language's groups.

    Groups are broadcast if they are counted to be few. More are copied SALTS times and met on
    (lang, salt of the term), so that a language's rows are dealt over as many tasks.
    """
    if groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS:
        return rows.join(F.broadcast(groups), "lang")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")


def _share(n: str, total: str, v: str, smoothing: int, scale: int) -> Column:
    """1 + floor(scale * (n + smoothing) / (total + smoothing * v))."""
    return F.expr(f"1 + ((cast({n} as decimal(18,0)) + {smoothing}) * {scale}) div (cast({total} as decimal(18,0)) + cast({v} as decimal(18,0)) * {smoothing})").cast("long")


def divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, smoothing: int = SMOOTHING, scale: int = SCALE, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank for docs (text, lang, source; other columns are ignored).

    Part `pair`: every other source of the lang, with the sum over its kept terms of the two
    smoothed shares' absolute differences (0 if it keeps none). Part `term`: the top terms whose share
    in the source is above the lang's. Ranks go by value, descending, then by item in UTF-8 order, so
    ties are settled. Null text, lang and source are empty strings; a group without terms has its rows;
    long texts count whole; an empty table gives no rows.
    """
    groups = cut(_groups_of(docs).distinct())
    df = F.sum("df").over(W.partitionBy("lang", "term"))
    kept = cut(term_counts(docs).withColumn("df", df).filter(F.col("df") >= least_documents).drop("df"))
    vocabulary = cut(kept.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")))
    langs = vocabulary.groupBy("lang").agg(F.count("term").alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    sized = cut(groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["v", "lang_total", "total"]))

    every = _by_lang(vocabulary, sized).join(kept, ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", zero))
    dense = cut(every.select("lang", "source", "term", "n", _share("n", "total", "v", smoothing, scale).alias("p"), _share("lang_n", "lang_total", "v", smoothing, scale).alias("q")))

    # one row for two sources is enough: |p - q| is the same from either side
    a = dense.select("lang", "term", "source", "p")
    b = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    sums = a.join(b, ["lang", "term"]).filter("source < item").groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("value"))
    pairs = groups.join(groups.withColumnRenamed("source", "item"), "lang").filter("source < item").join(sums, ["lang", "source", "item"], "left")
    pairs = cut(pairs.select("lang", "source", "item", F.coalesce("value", zero).alias("value")))
    pairs = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    terms = dense.filter("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit(part))
    both = ranked(pairs, "pair").unionByName(ranked(terms, "term").filter(F.col("rank") <= top))
    return both.select("lang", "source", "part", "item", "value", "rank")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS df FROM t GROUP BY ALL),
voc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(df) >= {LEAST_DOCUMENTS}),
gr AS (SELECT DISTINCT lang, source FROM d),
dense AS (SELECT gr.lang, gr.source, voc.term, coalesce(c.n, 0)::HUGEINT AS n, voc.n::HUGEINT AS lang_n
          FROM gr JOIN voc ON voc.lang = gr.lang LEFT JOIN c ON c.lang = gr.lang AND c.source = gr.source AND c.term = voc.term),
size AS (SELECT lang, source, count(*)::HUGEINT AS v, sum(n) AS total, sum(lang_n) AS lang_total FROM dense GROUP BY ALL),
share AS (SELECT lang, source, term, n, 1 + ({SCALE} * (n + {SMOOTHING})) // (total + {SMOOTHING} * v) AS p, 1 + ({SCALE} * (lang_n + {SMOOTHING})) // (lang_total + {SMOOTHING} * v) AS q
          FROM dense JOIN size USING (lang, source)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.value, 0)::BIGINT AS value
          FROM gr a JOIN gr b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
          UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM share WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
