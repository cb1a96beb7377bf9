"""Test-table adapters: the engine's inputs as views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.session import importable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, name, content (UTF-8 bytes of a document), size_bytes."""
    d = table(spark, sf_dir, "documents")
    content = F.encode("text", "UTF-8")
    return d.select(F.col("doc_id").alias("file_id"), F.concat_ws("-", F.col("doc_id").cast("string"), "lang", F.concat("source", F.lit(".txt"))).alias("name"),
                    content.alias("content"), F.octet_length(content).cast("long").alias("size_bytes"))


FILES_SQL = """files AS (SELECT doc_id AS file_id, doc_id || '-' || lang || '-' || source || '.txt' AS name, encode(text) AS content, octet_length(encode(text))::BIGINT AS size_bytes FROM documents)"""


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, gt_class, orig_ext, group_id, pair_id and a few raw features."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    d = d.withColumn("size_bytes", F.octet_length("text").cast("long")).drop("text")  # before the join: no text is shuffled
    gt = F.when(F.col("toxic") == 1, "ransomware-encrypted").when(F.col("quality") == 0, "benign-encrypted").otherwise("benign")
    return d.join(labels, "doc_id", "left").select(
        "doc_id", gt.alias("gt_class"), F.col("lang").alias("orig_ext"), F.col("source").alias("group_id"), F.concat_ws("-", "source", "lang").alias("pair_id"),
        "size_bytes", F.col("n_chars"), (F.col("n_chars") % 3 == 0).alias("flag"),
        F.when(F.col("doc_id") % 7 != 0, F.col("n_chars") / 10.0).alias("byte_chi2"))


DATASET_SQL = """dataset AS (
  SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'ransomware-encrypted' WHEN quality = 0 THEN 'benign-encrypted' ELSE 'benign' END AS gt_class,
         lang AS orig_ext, source AS group_id, source || '-' || lang AS pair_id, octet_length(encode(text))::BIGINT AS size_bytes, n_chars, n_chars % 3 = 0 AS flag,
         CASE WHEN d.doc_id % 7 <> 0 THEN n_chars / 10.0::DOUBLE END AS byte_chi2
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File-activity events: event_id, event_type, ts, us, process_key, process_name, file_path, file_extension, file_size, predicted_class, probability."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    ext = F.element_at(F.array(*map(F.lit, [".pdf", ".txt", ".bin", ".tmp", ".docx"])), (k % 5 + 1).cast("int"))
    kind = F.element_at(F.create_map(*map(F.lit, ["click", "modified", "view", "created", "purchase", "moved", "signup", "deleted", "error", "modified"])), F.col("event_type"))
    pred = F.when(F.col("event_type") == "error", "ransomware-encrypted").when(F.col("event_type") == "view", "benign-encrypted").when(F.col("event_type") != "signup", "benign")
    return e.select(
        "event_id", kind.alias("event_type"), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("user_id").alias("process_key"),
        F.concat(F.lit("proc"), (F.col("user_id") % 20).cast("string"), F.lit(".exe")).alias("process_name"),
        F.concat(F.lit("/d"), (k % 10).cast("string"), F.lit("/f"), k.cast("string"), ext).alias("file_path"), ext.alias("file_extension"),
        F.floor(F.col("value") * 1000).cast("long").alias("file_size"), pred.alias("predicted_class"),
        F.when(pred.isNotNull(), F.least(F.col("value") / 200, F.lit(1.0))).alias("probability"))


FILE_EVENTS_SQL = """raw_events AS (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events),
file_events AS (
  SELECT event_id, CASE event_type WHEN 'click' THEN 'modified' WHEN 'view' THEN 'created' WHEN 'purchase' THEN 'moved' WHEN 'signup' THEN 'deleted' WHEN 'error' THEN 'modified' END AS event_type,
         ts, epoch_us(ts) AS us, user_id AS process_key, 'proc' || (user_id % 20) || '.exe' AS process_name,
         '/d' || (k % 10) || '/f' || k || (['.pdf', '.txt', '.bin', '.tmp', '.docx'])[k % 5 + 1] AS file_path, (['.pdf', '.txt', '.bin', '.tmp', '.docx'])[k % 5 + 1] AS file_extension,
         floor(value * 1000)::BIGINT AS file_size,
         CASE WHEN event_type = 'error' THEN 'ransomware-encrypted' WHEN event_type = 'view' THEN 'benign-encrypted' WHEN event_type <> 'signup' THEN 'benign' END AS predicted_class,
         CASE WHEN event_type <> 'signup' THEN least(value / 200, 1.0) END AS probability
  FROM raw_events)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, y_true (0..2), three class scores s0..s2 and y_pred, their argmax (first of equals)."""
    v = table(spark, sf_dir, "embeddings")
    s = [F.col("embedding")[i].cast("double") for i in range(3)]
    pred = F.when((s[0] >= s[1]) & (s[0] >= s[2]), 0).when(s[1] >= s[2], 1).otherwise(2)
    return v.select("vec_id", (F.col("label") % 3).cast("int").alias("y_true"), *(x.alias(f"s{i}") for i, x in enumerate(s)), pred.alias("y_pred"))


SCORED_SQL = """vs AS (SELECT vec_id, (label % 3)::INT AS y_true, embedding[1]::DOUBLE AS s0, embedding[2]::DOUBLE AS s1, embedding[3]::DOUBLE AS s2 FROM embeddings),
scored AS (SELECT *, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS y_pred FROM vs)"""
