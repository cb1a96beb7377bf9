"""Scans and sinks: contents, datasets as CSV or Parquet, event replays, configuration."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.functions import naming
from fathomline.schema import FEATURE_STRUCT, LABELS, SERVICE
from fathomline.session import importable

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "long": T.LongType()}
DATASET_STRUCT = T.StructType([*(T.StructField(n, _KINDS[k]) for n, k in SERVICE.items()), *FEATURE_STRUCT.fields])
_EVENT_NUMBERS = ("file_size", "process_id", "thread_id")
_EVENT_NAMES = "event_id event_type timestamp file_path file_extension file_size process_id thread_id process_name process_path process_start_time process_key _bad"
EVENT_STRUCT = T.StructType([T.StructField(n, _KINDS["long" if n in _EVENT_NUMBERS else "string"]) for n in _EVENT_NAMES.split()])


def scan(spark: SparkSession, root: str, most_bytes: int | None = None) -> DataFrame:
    """path, size_bytes, modified, content of every file below root. Queries that don't use content don't read it; sizes are pushed into the scan."""
    df = importable(spark).read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if most_bytes is not None:
        df = df.filter(F.col("length") <= most_bytes)
    return df.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "content")


def qualified(spark: SparkSession, path: str) -> str:
    """A path as the file system writes it, so that a scan's paths begin with their root's."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")


def scan_classes(spark: SparkSession, root: str) -> DataFrame:
    """scan() of the class folders right below root, with gt_class and the file name's metadata, paths from root on; files elsewhere are left out."""
    below = F.substring("path", len(qualified(spark, root)) + 2, 2**31 - 1)
    df = scan(spark, root).withColumn("path", below).withColumn("gt_class", F.substring_index("path", "/", 1)).filter(F.col("gt_class").isin(*LABELS) & F.contains("path", F.lit("/")))
    name = naming.basename(F.col("path"))
    df = df.withColumn("m", naming.metadata(name, F.col("gt_class"))).withColumn("group_id", naming.group_id(F.col("m"), name))
    return df.select("path", "gt_class", "m.*", "group_id", naming.pair_id(F.col("group_id"), F.col("m.extra")).alias("pair_id"), "size_bytes", "content")


def resolve(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows(path) with source_path: the file at that path, or else the first of that name; neither is an error."""
    by_path = found.select(F.col("path").alias("p"), F.col("path").alias("exact"))
    by_name = found.groupBy(naming.basename(F.col("path")).alias("n")).agg(F.min("path").alias("named"))
    joined = rows.join(by_path, rows.path == F.col("p"), "left").withColumn("n2", naming.basename(F.col("path"))).join(by_name, F.col("n2") == F.col("n"), "left")
    return joined.withColumn("source_path", F.coalesce("exact", "named", F.raise_error(F.concat(F.lit("no source file for "), F.col("path"))))).drop("p", "exact", "n", "n2", "named")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A dataset's CSV with its fixed schema; empty cells are null."""
    if not path.rstrip("/").endswith(".csv"):
        raise ValueError(f"not a .csv path: {path}")
    return spark.read.schema(schema or DATASET_STRUCT).option("header", True).option("nullValue", "").csv(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """In the given column order, other columns left out, null as an empty cell."""
    df.select(*(f"`{c}`" for c in (columns or df.columns))).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of a replay: JSON lines by suffix .jsonl, else a JSON array or object. Malformed items are an error. An event without an id gets a digest of its fields, the same on every reading; equal events without ids are one."""
    reader = spark.read.schema(EVENT_STRUCT).option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE")
    df = reader.json(path) if path.endswith(".jsonl") else reader.option("multiLine", True).json(path)
    bad = F.when(F.col("_bad").isNotNull(), F.raise_error(F.concat(F.lit("not an event: "), F.col("_bad")))).otherwise(F.coalesce("event_id", F.sha2(F.to_json(F.struct(*(n for n in _EVENT_NAMES.split() if n not in ("event_id", "_bad")))), 256)))
    from fathomline.operators import events as ev

    when = ev.instant(F.col("timestamp"))
    key = F.coalesce("process_key", ev.process_key(F.col("process_id"), ev.instant(F.col("process_start_time")), F.col("process_name")))
    return df.select(bad.alias("event_id"), F.coalesce("event_type", F.lit("modified")).alias("event_type"), when.alias("timestamp"), F.unix_micros(when).alias("us"), "file_path",
                     F.coalesce("file_extension", naming.suffix(F.col("file_path"))).alias("file_extension"), "file_size", "process_id", "process_name", key.alias("process_key"))


def manifest(rows: DataFrame, target: str) -> DataFrame:
    """source_path and where a copy would go; nothing is copied."""
    return rows.select("source_path", F.concat(F.lit(target.rstrip("/") + "/"), naming.basename(F.col("source_path"))).alias("target_path"))


def read_quotas(path: str | Path, section: str, tolerance: float = 1e-9) -> dict[str, float]:
    """A quota section of a YAML file: fractions in 0..1 that sum to one."""
    import yaml

    values = yaml.safe_load(Path(path).read_text())[section]
    if not isinstance(values, dict) or not values:
        raise ValueError(f"{section}: a mapping of quotas is expected")
    for k, v in values.items():
        if isinstance(v, bool) or not isinstance(v, int | float) or not 0 <= v <= 1:
            raise ValueError(f"{section}.{k}: a fraction in 0..1 is expected")
    if abs(sum(values.values()) - 1) > tolerance:
        raise ValueError(f"{section}: quotas sum to {sum(values.values())}, not 1")
    return {str(k).lower(): float(v) for k, v in values.items()}
