"""Event streams: de-duplication, file names, priorities with activity, sliding profiles, windowed counts.

Every function takes and returns a DataFrame, streaming or not started yet; states.py says what each
keeps. On the same rows, cut into batches between two times, results equal the batch operators'.
Sessions need the RocksDB state store (ROCKSDB). buckets: how many groups keys are dealt to; a batch
calls Python once and rewrites the state once for each that it has rows of, and a task holds one at a time. A
stream keeps the number that it starts with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.operators import events, profiles
from fathomline.streaming import states

POSITIVE = profiles.POSITIVE
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 512


def _ddl(df: DataFrame, *names: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)


def bucketed(stream: DataFrame, buckets: int, *keys: Column | str) -> DataFrame:
    """stream with its keys as one text (states.KEY) and a bucket of so many (states.BUCKET), by their hash."""
    texts = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]
    key = texts[0] if len(texts) == 1 else F.to_json(F.array(*texts))
    return stream.withColumn(states.KEY, key).withColumn(states.BUCKET, F.pmod(F.xxhash64(states.KEY), F.lit(buckets)).cast("int"))


def timed(stream: DataFrame, late: str) -> DataFrame:
    """stream with an event time t from us and a watermark that lets rows be so late."""
    return stream.withColumn("t", F.timestamp_micros("us")).withWatermark("t", late)


def deduplicated(stream: DataFrame, window_us: int = 500_000, expire: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """event_id, is_duplicate. stream: process_key, file_path, event_type, event_id, us. expire: keys that fall silent are forgotten after four windows of processing time; leave it off in replays, whose events are older than the clock."""
    keyed = bucketed(stream, buckets, "process_key", F.lower("file_path"), "event_type").select(states.BUCKET, states.KEY, "event_id", "us").groupBy(states.BUCKET)
    return keyed.transformWithStateInPandas(states.Deduplicator(window_us, expire), f"{_ddl(stream, 'event_id')}, is_duplicate boolean", "Append", "ProcessingTime" if expire else "None")


def correlated(raw: DataFrame, scope: str | None = None, learn: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """raw(seq, action, file_key or file_keys, file_path, ...) -> its used events with resolved_path, as events.correlate gives them.

    scope: the column, a machine's name for instance, within which identifiers mean the same; its names are one
    state. Without it identifiers are dealt to buckets, and events have one each (file_key).
    Events without identifier go by the state.
    """
    carried = [c for c in raw.columns if c != "file_keys"]
    if "file_keys" not in raw.columns:
        raw = raw.withColumn("file_keys", F.array("file_key"))
    elif scope is None:
        raise ValueError("events with several identifiers need a scope")
    has_key = F.exists(F.coalesce("file_keys", F.array().cast("array<string>")), lambda k: k.isNotNull())
    keyless = raw.filter(~has_key & ~F.col("action").isin("name", "forget")).select(*carried, F.nullif("file_path", F.lit("")).alias("resolved_path"))
    keyed = raw.filter(has_key).withColumn("file_keys", F.col("file_keys").cast("array<string>"))
    if scope is None:
        keyed = bucketed(keyed, buckets, "file_key").drop(states.KEY)
    found = keyed.groupBy(scope or states.BUCKET).transformWithStateInPandas(states.FileNames(learn, carried, scope is not None), f"{_ddl(raw, *carried)}, resolved_path string", "Append", "None")
    return found.unionByName(keyless)


def prefiltered(stream: DataFrame, config: events.FilterConfig, late: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """events.prefilter over a stream: the decision chain as columns, activity as a keyed ring of times."""
    decided = events.decided(stream, config)
    carried = decided.columns
    rated = timed(bucketed(decided.withColumn("ranked", events.is_ranked()), buckets, "process_key"), late).groupBy(states.BUCKET).transformWithStateInPandas(
        states.Activity(config.activity_us, carried), f"{_ddl(decided, *carried)}, activity long", "Append", "EventTime")
    return events.prioritised(rated, config)


def profiled(stream: DataFrame, window_us: int = 30_000_000, late: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """A profile of each process that a batch has events of, with score, threat level and response; and the EXPIRED profile, which isn't scored, of each that has been silent for a window."""
    schema = (f"{states.KEY} string, last_event_id string, us long, window_start_us long, events_in_window long, classified_events_count long, benign_count long, benign_encrypted_count long, ransomware_encrypted_count long, ransomware_ratio double, "
              "max_ransomware_probability double, avg_ransomware_probability double, touched_files long, touched_files_unique long, consecutive_ransomware_hits long, profile_status string")
    of_window = stream.select("process_key", "us", "event_id", "file_path", "predicted_class", "probability")
    found = timed(bucketed(of_window, buckets, "process_key"), late).groupBy(states.BUCKET).transformWithStateInPandas(states.Profiler(window_us), schema, "Append", "EventTime")
    found = found.select(F.col(states.KEY).cast(stream.schema["process_key"].dataType).alias("process_key"), *(c for c in found.columns if c != states.KEY))
    scored = profiles.with_score(found)
    active = F.col("profile_status") == states.ACTIVE
    scored = scored.withColumn("suspicion_score", F.when(active, F.col("suspicion_score")).otherwise(0)).withColumn("decision_reason", F.when(active, F.col("decision_reason")))
    return profiles.respond(scored)


def windowed_counts(stream: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts per event-time window and type; windows close when the watermark passes them."""
    return timed(stream, late).groupBy(F.window("t", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "w.end", "event_type", "n")
