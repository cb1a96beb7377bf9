"""Streams over stored events, replayed in parts from a checkpoint; the SQL is that of the whole table at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators import events as ev
from fathomline.plans import event_queries as eq
from fathomline.sources import tables
from fathomline.streaming import pipelines, replay

QUERIES, ORACLES = {}, {}
PARTS = 3
LATE = "1 minute"
#: Short enough for processes of the test tables to fall silent.
PROFILE_US = 2 * 3_600_000_000


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.file_events(spark, sf_dir).drop("ts")


@query(eq.ORACLES["file_name_correlation"])
def stream_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = eq.raw_file_events(spark, sf_dir)
    return replay.replayed(raw, replay.by_time(raw, PARTS, "seq"), PARTS, pipelines.correlated).select("seq", "file_key", "resolved_path")


@query("""WITH raw AS (SELECT event_id AS seq, CASE event_type WHEN 'view' THEN 'name' WHEN 'signup' THEN 'forget' ELSE 'use' END AS action, user_id % 7 AS host, [user_id // 7, 1000 + event_id % 20] AS file_keys, CASE WHEN event_type = 'view' THEN '/f' || event_id WHEN event_type = 'purchase' THEN '/own' || event_id END AS file_path FROM events),
each AS (SELECT seq, host, action, file_path, unnest(file_keys) AS file_key, unnest([0, 1]) AS place FROM raw),
lived AS (SELECT *, count(CASE WHEN action = 'forget' THEN 1 END) OVER (PARTITION BY host, file_key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS life FROM each),
known AS (SELECT *, last_value(file_path IGNORE NULLS) OVER (PARTITION BY host, file_key, life ORDER BY seq ROWS UNBOUNDED PRECEDING) AS k FROM lived)
SELECT seq, host, coalesce(any_value(file_path), arg_min(k, place) FILTER (k IS NOT NULL)) AS resolved_path FROM known WHERE action = 'use' GROUP BY seq, host""")
def stream_file_names_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two identifiers an event, names per host, and every path is learned from."""
    raw = eq.raw_file_events(spark, sf_dir)
    raw = raw.select("seq", "action", F.expr("file_key % 7").alias("host"), F.expr("array(file_key div 7, 1000 + seq % 20)").cast("array<string>").alias("file_keys"), "file_path")
    return replay.replayed(raw, replay.by_time(raw, PARTS, "seq"), PARTS, lambda s: pipelines.correlated(s, "host", learn=True)).select("seq", "host", "resolved_path")


@query(eq.ORACLES["event_dedup"])
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return replay.replayed(e, replay.by_time(e, PARTS), PARTS, lambda s: pipelines.deduplicated(s, 3 * eq.DAY_US, expire=False))


@query(eq.ORACLES["event_prefilter"])
def stream_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return replay.replayed(e, replay.by_time(e, PARTS), PARTS, lambda s: pipelines.prefiltered(s, eq.CONFIG, LATE)).select("event_id", "filter_decision", "filter_reason", "event_priority", "activity")


_RUNS = f"""{eq._PROFILE.replace("86400000000", str(PROFILE_US))}, {eq._SCORE},
ends AS (SELECT min(us) AS a, max(us) AS b FROM file_events),
parted AS (SELECT s.*, least({PARTS - 1}, (s.us - a) * {PARTS} // (b - a + 1)) AS part FROM profile_scored s, ends),
marks AS (SELECT part, max(max(us)) OVER (ORDER BY part) // 1000 - 60000 AS mark FROM parted GROUP BY part),
latest AS (SELECT *, row_number() OVER (PARTITION BY process_key, part ORDER BY us DESC, event_id DESC) AS r FROM parted),
seen AS (SELECT * FROM latest WHERE r = 1),
fallen AS (SELECT DISTINCT s.process_key, s.us FROM seen s JOIN marks m ON m.part >= s.part WHERE (s.us + {PROFILE_US}) // 1000 + 1 <= m.mark
           AND NOT EXISTS (SELECT 1 FROM seen o WHERE o.process_key = s.process_key AND o.part > s.part AND o.part <= m.part))"""


@query(f"""WITH {_RUNS}
SELECT process_key, us, 'active' AS profile_status, events_in_window, touched_files_unique, consecutive_ransomware_hits, round(avg_ransomware_probability, 9) AS avg_ransomware_probability, suspicion_score FROM seen
UNION ALL SELECT s.process_key, s.us, 'expired', events_in_window, touched_files_unique, consecutive_ransomware_hits, round(avg_ransomware_probability, 9), 0 FROM seen s JOIN fallen f ON f.process_key = s.process_key AND f.us = s.us""")
def stream_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles after each part, and those of processes that have fallen silent by then."""
    e = _events(spark, sf_dir)
    found = replay.replayed(e, replay.by_time(e, PARTS), PARTS, lambda s: pipelines.profiled(s, PROFILE_US, LATE))
    return found.select("process_key", "us", "profile_status", "events_in_window", "touched_files_unique", "consecutive_ransomware_hits", F.round("avg_ransomware_probability", 9).alias("avg_ransomware_probability"), "suspicion_score")


@query(eq.ORACLES["event_stages"])
def stream_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staged pipeline over a stream: a change after each stage, upserted by event."""

    def build(stream: DataFrame) -> DataFrame:
        n = F.col("event_id")
        done = {"stable": n % 5 != 0, "extracted": n % 7 != 0, "vectorized": n % 11 != 0, "classified": F.col("predicted_class").isNotNull()}
        return ev.stage_changes(ev.stages(pipelines.prefiltered(stream, eq.CONFIG, LATE).withColumns(done)))

    e = _events(spark, sf_dir)
    found = replay.upserted(e, replay.by_time(e, PARTS), PARTS, build, "event_id", "stage")
    return found.select("event_id", "filter_decision", "stabilization_status", "extraction_status", "vectorization_status", "classification_status", "profiled")


@query(f"""WITH {eq._PROFILE}, {eq._SCORE}, r AS (SELECT *, row_number() OVER (PARTITION BY process_key ORDER BY us DESC, event_id DESC) AS r FROM profile_scored)
SELECT process_key, us, events_in_window, suspicion_score FROM r WHERE r = 1""")
def stream_profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of processes that the stream keeps up to date."""
    e = _events(spark, sf_dir)
    active = lambda s: pipelines.profiled(s, eq.DAY_US, LATE).filter(F.col("profile_status") == "active")
    return replay.upserted(e, replay.by_time(e, PARTS), PARTS, active, "process_key", "us").select("process_key", "us", "events_in_window", "suspicion_score")
