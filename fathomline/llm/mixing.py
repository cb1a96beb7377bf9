"""Mixing sources to target weights.

Documents get hash-random keys; each source's key space is cut into equal ranges, range totals are
prefix-summed, and only the one range per source that the budget ends in is sorted row by row. What
is left is a cut point per source, so the decision for a row needs no shuffle of rows or texts: it
is a join with one row per source, broadcast if these are counted to be few (else AQE's skew join
deals a hot source out).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, small_side, table, word_count

KEY_BITS = 60
#: Rows in a key range, about; the root of the table's rows where that is more, so that neither ranges nor rows in one grow alone.
RANGE_ROWS = 1024


def random_key(doc_id):
    """60 hash bits of the id (null: as the empty text), the same in any engine that has md5."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the order that a source's words are taken in (key, ordinal, size)."""
    doc_id = F.col("doc_id")
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), random_key(doc_id).alias("key"),
                       F.coalesce(doc_id, F.lit(-(2**63))).cast("long").alias("ordinal"))


def source_targets(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """One row per source: source, source_size, n_rows, target.

    Sources weigh weights in turn, by code point with null last. A target above max_epochs times its
    source's size is cut to that and the excess reshared by weight until none is above: with sources
    ordered by cap over weight the capped ones come first, so running sums give the fixpoint at once.
    The windows run over one row per source, not over documents.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * max_epochs)
    everything = W.partitionBy()
    before = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    per = (per.withColumn("total", F.sum("source_size").over(everything))
           .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
           .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    per = per.withColumn("capped", (F.col("total") - F.col("cap_before")) * F.col("weight") > F.col("cap") * F.col("weight_left"))
    left = F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything)
    free = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(everything)
    share = left.cast("double") / free * F.col("weight")
    return per.select("source", "source_size", "n_rows", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def cut_points(rows: DataFrame, **targets) -> DataFrame:
    """source_targets and where each source's budget ends.

    epochs: whole passes. Rows before (cut_key, cut_ordinal, cut_size) are taken once more, rows at
    it give part words each (repeated rows share evenly), rows after it none.
    """
    per = cut(source_targets(rows, **targets))
    budget = F.floor(F.col("target") + 0.5)
    has = F.col("source_size") > 0
    per = per.withColumn("epochs", F.when(has, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    per = per.withColumn("rest", F.when(has, budget - F.col("epochs") * F.col("source_size")).otherwise(0).cast("long"))
    everything = W.partitionBy()
    per_range = F.greatest(F.lit(float(RANGE_ROWS)), F.sqrt(F.sum("n_rows").over(everything).cast("double")))
    per = cut(per.withColumn("ranges", F.ceil(F.col("n_rows") / per_range).cast("long")).withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))))
    ranged = rows.join(small_side(per.select(F.col("source").alias("s"), "sid", "ranges", "rest")), F.col("source").eqNullSafe(F.col("s")))
    ranged = ranged.select("sid", "rest", "key", "ordinal", "size", F.least(F.floor(F.col("key") / float(2**KEY_BITS) * F.col("ranges")), F.col("ranges") - 1).alias("range"))
    totals = ranged.groupBy("sid", "range").agg(F.sum("size").alias("in_range"), F.first("rest").alias("rest"))
    prefix = totals.withColumn("until", F.sum("in_range").over(W.partitionBy("sid").orderBy("range")))
    last = prefix.filter((F.col("rest") > F.col("until") - F.col("in_range")) & (F.col("rest") <= F.col("until")))
    last = cut(last.select("sid", "range", (F.col("until") - F.col("in_range")).alias("before")))
    ties = ranged.join(small_side(last), ["sid", "range"]).groupBy("sid", "key", "ordinal", "size").agg(F.count("*").alias("n"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    upto = F.col("before") + F.sum(F.col("size") * F.col("n")).over(W.partitionBy("sid").orderBy("key", "ordinal", "size"))
    ties = ties.withColumn("upto", upto).withColumn("prior", F.col("upto") - F.col("size") * F.col("n"))
    ends = ties.filter((F.col("rest") > F.col("prior")) & (F.col("rest") <= F.col("upto")))
    ends = ends.select("sid", F.col("key").alias("cut_key"), F.col("ordinal").alias("cut_ordinal"), F.col("size").alias("cut_size"), F.floor((F.col("rest") - F.col("prior")) / F.col("n")).cast("long").alias("part"))
    return cut(per.join(ends, "sid", "left").select(F.col("source").alias("of_source"), "source_size", "target", "epochs", "cut_key", "cut_ordinal", "cut_size", "part"))


def _taken_once_more(prefix: str = ""):
    at = F.struct(*(F.col(f"{prefix}{c}").alias(c) for c in ("key", "ordinal", "size")))
    end = F.struct(*(F.col(f"{prefix}cut_{c}").alias(c) for c in ("key", "ordinal", "size")))
    return F.when(F.col(f"{prefix}cut_key").isNull(), F.lit(0)).when(at < end, F.col(f"{prefix}size")).when(at == end, F.col(f"{prefix}part")).otherwise(0).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs (doc_id, source, text; other columns are ignored).

    A null source is a source of its own; null and empty texts have size 0 and take 0; repeated rows
    are taken alike; an empty table gives none. A source's taken words differ from its rounded target
    by fewer words than there are repeated rows at its cut point. Reruns agree: keys hash ids.
    """
    rows = cut(sized(docs))
    points = cut_points(rows, weights=weights, max_epochs=max_epochs)
    joined = rows.join(small_side(points), F.col("source").eqNullSafe(F.col("of_source")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + _taken_once_more()).alias("taken"))


#: Before the names of helper columns beside those of a table that may have any.
_OWN = "__mix_"


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """The mix itself: rows of docs repeated as often as they are taken whole, and at each source's cut point a row with the first words of its text (space-joined), with docs' columns, whatever their names.

    Null and empty texts have no words and are taken as often as their source's whole passes; a null
    source is one of its own; repeated rows (equal ids and sizes) at a cut point share what is left
    evenly; n_chars, where there is one, is counted anew for cut texts; an empty table gives none.
    """
    points = cut_points(cut(sized(docs)), weights=weights, max_epochs=max_epochs)
    points = points.select(*(F.col(c).alias(_OWN + c) for c in points.columns))
    helpers = sized(docs.limit(0)).columns[2:]  # size, key, ordinal
    own = {"size": word_count(F.col("text")), "key": random_key(F.col("doc_id")), "ordinal": F.coalesce(F.col("doc_id"), F.lit(-(2**63))).cast("long")}
    wide = docs.select("*", *(own[c].alias(_OWN + c) for c in helpers))
    wide = wide.join(small_side(points), F.col("source").eqNullSafe(F.col(_OWN + "of_source"))).withColumn(_OWN + "more", _taken_once_more(_OWN))
    more, size, words = (F.col(_OWN + c) for c in ("more", "size", "words"))
    whole = (F.col(_OWN + "epochs") + F.when((more == size) & (size > 0), 1).otherwise(0)).cast("int")
    part = F.when((more > 0) & (more < size), F.array(more)).otherwise(F.array().cast("array<bigint>"))
    wide = wide.withColumn(_OWN + "words", F.explode(F.concat(F.array_repeat(F.lit(None).cast("bigint"), whole), part)))
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), words.cast("int")), " ")
    wide = wide.withColumn("text", F.when(words.isNull(), F.col("text")).otherwise(first))
    if "n_chars" in docs.columns:
        wide = wide.withColumn("n_chars", F.when(words.isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return wide.select(*(f"`{c}`" for c in docs.columns))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


OP1_SQL = r"""
WITH rows AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key,
         coalesce(doc_id, -9223372036854775808) AS ordinal
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight
  FROM rows GROUP BY source),
run AS (
  SELECT *, source_size * 3 AS cap, sum(source_size) OVER ()::BIGINT AS total,
         coalesce(sum(source_size * 3) OVER before, 0)::BIGINT AS cap_before,
         (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT AS weight_left
  FROM per
  WINDOW before AS (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, (total - cap_before)::HUGEINT * weight > cap::HUGEINT * weight_left AS is_capped FROM run),
targets AS (
  SELECT source, source_size,
         CASE WHEN is_capped THEN cap::DOUBLE
              ELSE (total - sum(CASE WHEN is_capped THEN cap ELSE 0 END) OVER ())::DOUBLE
                   / (sum(CASE WHEN is_capped THEN 0 ELSE weight END) OVER ())::DOUBLE * weight END AS target
  FROM capped),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs,
         CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT % source_size ELSE 0 END AS rest
  FROM targets),
ties AS (SELECT source, key, ordinal, size, count(*) AS n FROM rows GROUP BY ALL),
summed AS (
  SELECT *, (sum(size * n) OVER (PARTITION BY source ORDER BY key, ordinal, size))::BIGINT AS upto FROM ties)
SELECT r.doc_id, r.size, b.source_size, b.target,
       (b.epochs * r.size + CASE WHEN b.rest >= s.upto THEN r.size
                                 WHEN b.rest > s.upto - s.size * s.n THEN (b.rest - (s.upto - s.size * s.n)) // s.n
                                 ELSE 0 END)::BIGINT AS taken
FROM rows r
JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source
JOIN summed s ON r.source IS NOT DISTINCT FROM s.source AND r.key = s.key AND r.ordinal = s.ordinal AND r.size = s.size
"""
