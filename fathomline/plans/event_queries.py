"""Queries over file events, process profiles and the stored tables, with the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import naming
from fathomline.operators import events as ev
from fathomline.operators import profiles, repository
from fathomline.sources import tables

QUERIES, ORACLES = {}, {}
DAY_US = 86_400_000_000
CONFIG = ev.FilterConfig(ignored=("/d3",), trusted=("proc7.exe",), max_size=150_000, activity_us=DAY_US, activity_count=2)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_RAW = r"""raw AS (
  SELECT event_id, ts, user_id, (['FileIo/Write', 'FileIo/Rename', 'FileIo/DeletePath', 'FileIo/Create', 'FileIo/OpEnd', ''])[event_id % 6 + 1] AS task, ([16, 26, 27, 30])[event_id % 4 + 1] AS etw_id,
         '\Device\HarddiskVolume2\dir' || (user_id % 5) || '\File' || event_id || '.TXT' AS path FROM events)"""


@query(f"WITH {_RAW}" + r"""
SELECT event_id, CASE WHEN lower(task) LIKE '%delete%' THEN 'deleted' WHEN lower(task) LIKE '%rename%' OR lower(task) LIKE '%move%' THEN 'moved' WHEN lower(task) LIKE '%write%' OR lower(task) LIKE '%modify%' THEN 'modified' WHEN lower(task) LIKE '%create%' THEN 'created'
  ELSE CASE etw_id WHEN 16 THEN 'modified' WHEN 26 THEN 'deleted' WHEN 27 THEN 'moved' WHEN 30 THEN 'created' END END AS event_type,
  replace('D:' || substr(path, 24), '\', '/') AS file_path, '.txt' AS file_extension,
  CASE WHEN event_id % 10 = 0 THEN 'unknown:' || 'proc' ELSE user_id || ':' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') || 'Z' END AS process_key,
  epoch_us(ts) AS us FROM raw""")
def event_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events")
    task = F.element_at(F.array(*map(F.lit, ["FileIo/Write", "FileIo/Rename", "FileIo/DeletePath", "FileIo/Create", "FileIo/OpEnd", ""])), (F.col("event_id") % 6 + 1).cast("int"))
    etw = F.element_at(F.array(*map(F.lit, [16, 26, 27, 30])), (F.col("event_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("\\Device\\HarddiskVolume2\\dir"), (F.col("user_id") % 5).cast("string"), F.lit("\\File"), F.col("event_id").cast("string"), F.lit(".TXT"))
    filetime = ((F.unix_micros(F.col("ts").cast("timestamp")) * 10) + F.lit(116444736000000000)).cast("string")
    pid = F.when(F.col("event_id") % 10 != 0, F.col("user_id"))
    when = ev.instant(filetime)
    clean = naming.normal_path(path, {"\\Device\\HarddiskVolume2": "D:"})
    return e.select("event_id", ev.event_type(task, etw).alias("event_type"), clean.alias("file_path"), naming.suffix(clean).alias("file_extension"), ev.process_key(pid, when, F.lit("proc")).alias("process_key"), F.unix_micros(when).alias("us"))


_DECIDED = f"""{tables.FILE_EVENTS_SQL},
reasoned AS (SELECT *, CASE WHEN event_type = 'deleted' THEN 'delete_event' WHEN file_path = '/d3' OR starts_with(file_path, '/d3/') THEN 'ignored_directory' WHEN lower(file_extension) IN ('.tmp', '.temp', '.swp', '.part', '.crdownload') THEN 'temporary_or_service_file' WHEN lower(process_name) = 'proc7.exe' THEN 'trusted_process' WHEN file_size > 150000 THEN 'file_too_large' END AS r FROM file_events),
decided AS (SELECT *, CASE WHEN r IS NULL THEN 'pass' WHEN r IN ('delete_event', 'file_too_large') THEN 'context_only' ELSE 'drop' END AS filter_decision FROM reasoned),
active AS (SELECT *, count(CASE WHEN filter_decision = 'pass' OR event_type = 'deleted' THEN 1 END) OVER (PARTITION BY process_key ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS activity FROM decided),
marked AS (SELECT *, concat_ws(',', CASE WHEN process_name IS NULL OR lower(process_name) = 'unknown' THEN 'unknown_process' END, CASE WHEN lower(file_extension) NOT IN ('.pdf', '.docx', '.txt', '.bin') THEN 'unusual_extension' END, CASE WHEN activity >= 2 THEN 'high_activity' END) AS marks FROM active),
filtered AS (SELECT *, CASE WHEN filter_decision = 'pass' THEN CASE WHEN marks <> '' THEN 'accepted; priority=' || marks ELSE 'accepted' END ELSE r END AS filter_reason,
  CASE WHEN filter_decision = 'pass' OR event_type = 'deleted' THEN CASE WHEN marks <> '' THEN 'high' ELSE 'normal' END ELSE 'low' END AS event_priority FROM marked)"""


@query(f"WITH {_DECIDED} SELECT event_id, filter_decision, filter_reason, event_priority, activity FROM filtered")
def event_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.prefilter(tables.file_events(spark, sf_dir), CONFIG).select("event_id", "filter_decision", "filter_reason", "event_priority", "activity")


@query(f"""WITH {tables.FILE_EVENTS_SQL}, g AS (SELECT event_id, us - lag(us) OVER (PARTITION BY process_key, lower(file_path), event_type ORDER BY us, event_id) AS gap FROM file_events)
SELECT event_id, coalesce(gap >= 0 AND gap <= 259200000000, false) AS is_duplicate FROM g""")
def event_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.deduplicate(tables.file_events(spark, sf_dir), 3 * DAY_US).select("event_id", "is_duplicate")


@query("""WITH raw AS (SELECT event_id AS seq, CASE event_type WHEN 'view' THEN 'name' WHEN 'signup' THEN 'forget' ELSE 'use' END AS action, user_id AS file_key, CASE WHEN event_type = 'view' THEN '/f' || event_id WHEN event_type = 'purchase' THEN '/own' || event_id END AS file_path FROM events),
lived AS (SELECT *, count(CASE WHEN action = 'forget' THEN 1 END) OVER (PARTITION BY file_key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS life FROM raw),
known AS (SELECT *, last_value(CASE WHEN action = 'name' THEN file_path END IGNORE NULLS) OVER (PARTITION BY file_key, life ORDER BY seq ROWS UNBOUNDED PRECEDING) AS k FROM lived)
SELECT seq, file_key, coalesce(file_path, k) AS resolved_path FROM known WHERE action = 'use'""")
def file_name_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.correlate(raw_file_events(spark, sf_dir)).select("seq", "file_key", "resolved_path")


def raw_file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, action, file_key, file_path, us: events that name a file, forget it, or use it with or without its path."""
    e = tables.table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "view", "name").when(F.col("event_type") == "signup", "forget").otherwise("use")
    path = F.when(F.col("event_type") == "view", F.concat(F.lit("/f"), F.col("event_id").cast("string"))).when(F.col("event_type") == "purchase", F.concat(F.lit("/own"), F.col("event_id").cast("string")))
    return e.select(F.col("event_id").alias("seq"), action.alias("action"), F.col("user_id").alias("file_key"), path.alias("file_path"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


_PROFILE = f"""{tables.FILE_EVENTS_SQL},
runs AS (SELECT *, sum(CASE WHEN predicted_class IS NOT NULL AND predicted_class <> 'ransomware-encrypted' THEN 1 ELSE 0 END) OVER (PARTITION BY process_key ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM file_events),
prof AS (SELECT event_id, process_key, us, count(*) OVER w AS events_in_window, count(predicted_class) OVER w AS classified_events_count,
  count(CASE WHEN predicted_class = 'benign' THEN 1 END) OVER w AS benign_count, count(CASE WHEN predicted_class = 'benign-encrypted' THEN 1 END) OVER w AS benign_encrypted_count,
  count(CASE WHEN predicted_class = 'ransomware-encrypted' THEN 1 END) OVER w AS ransomware_encrypted_count,
  coalesce(max(probability) OVER w, 0) AS max_ransomware_probability, coalesce(avg(probability) OVER w, 0) AS avg_ransomware_probability,
  count(file_path) OVER w AS touched_files, count(DISTINCT file_path) OVER w AS touched_files_unique, greatest(min(us) OVER w, us - 86400000000) AS window_start_us,
  count(CASE WHEN predicted_class = 'ransomware-encrypted' THEN 1 END) OVER w - count(CASE WHEN predicted_class = 'ransomware-encrypted' THEN 1 END) OVER (PARTITION BY process_key, us ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hits_so_far,
  sum(CASE WHEN predicted_class = 'ransomware-encrypted' THEN 1 ELSE 0 END) OVER (PARTITION BY process_key, run ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS streak
  FROM runs WINDOW w AS (PARTITION BY process_key ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)),
profile AS (SELECT *, least(streak, hits_so_far) AS consecutive_ransomware_hits, CASE WHEN classified_events_count > 0 THEN ransomware_encrypted_count / classified_events_count ELSE 0 END AS ransomware_ratio FROM prof)"""
_SCORE = "profile_scored AS (SELECT *, least(100, " + " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for p, c in profiles.RULES) + ")::INT AS suspicion_score FROM profile)"


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.profiles(tables.file_events(spark, sf_dir), DAY_US)


@query(f"WITH {_PROFILE} SELECT event_id, process_key, events_in_window, classified_events_count, benign_count, benign_encrypted_count, ransomware_encrypted_count, round(max_ransomware_probability, 9) AS max_ransomware_probability, round(avg_ransomware_probability, 9) AS avg_ransomware_probability, touched_files, touched_files_unique, round(ransomware_ratio, 9) AS ransomware_ratio, window_start_us FROM profile")
def process_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = {c: F.round(c, 9).alias(c) for c in ("max_ransomware_probability", "avg_ransomware_probability", "ransomware_ratio")}
    names = "event_id process_key events_in_window classified_events_count benign_count benign_encrypted_count ransomware_encrypted_count max_ransomware_probability avg_ransomware_probability touched_files touched_files_unique ransomware_ratio window_start_us".split()
    return _profiles(spark, sf_dir).select(*(r.get(c, F.col(c)) for c in names))


@query(f"WITH {_PROFILE} SELECT event_id, process_key, consecutive_ransomware_hits FROM profile")
def consecutive_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiles(spark, sf_dir).select("event_id", "process_key", "consecutive_ransomware_hits")


@query(f"WITH {_PROFILE}, {_SCORE} SELECT event_id, process_key, suspicion_score FROM profile_scored")
def suspicion_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.with_score(_profiles(spark, sf_dir)).select("event_id", "process_key", "suspicion_score")


@query(f"""WITH {_PROFILE}, {_SCORE}, levels AS (SELECT *, CASE WHEN suspicion_score >= 80 THEN 'critical' WHEN suspicion_score >= 60 THEN 'high' WHEN suspicion_score >= 30 THEN 'medium' ELSE 'low' END AS threat_level FROM profile_scored)
SELECT event_id, process_key, suspicion_score, threat_level, CASE threat_level WHEN 'low' THEN 'log' WHEN 'medium' THEN 'warn' WHEN 'high' THEN 'mark_suspicious' ELSE 'propose_block' END AS requested_action, 'log' AS executed_action FROM levels""")
def threat_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.respond(profiles.with_score(_profiles(spark, sf_dir))).select("event_id", "process_key", "suspicion_score", "threat_level", "requested_action", "executed_action")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_event_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return profiles.latest(e, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.prefilter(tables.file_events(spark, sf_dir), CONFIG)


def _processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last profile of each process, with its score."""
    p = profiles.with_score(_profiles(spark, sf_dir)).withColumn("last_seen", F.col("us"))
    return profiles.latest(p, "process_key", "us", "event_id")


_PROCESSES = f"{_PROFILE}, {_SCORE}, processes AS (SELECT s.*, s.us AS last_seen, e.process_name FROM (SELECT *, row_number() OVER (PARTITION BY process_key ORDER BY us DESC, event_id DESC) AS r FROM profile_scored) s JOIN file_events e USING (event_id) WHERE r = 1)"


@query(f"WITH {_DECIDED} SELECT count(*) AS events, count(CASE WHEN predicted_class = 'ransomware-encrypted' THEN 1 END) AS positives, count(CASE WHEN event_priority = 'high' THEN 1 END) AS high_priority, count(CASE WHEN predicted_class IS NULL THEN 1 END) AS unclassified FROM filtered")
def repo_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.summary(_stored(spark, sf_dir))


@query(f"WITH {tables.FILE_EVENTS_SQL} SELECT DISTINCT file_extension AS value FROM file_events WHERE trim(coalesce(file_extension, '')) <> ''")
def repo_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.distinct_values(tables.file_events(spark, sf_dir), "file_extension", ("file_extension", "event_type", "process_name"))


@query(f"WITH {_DECIDED} SELECT event_id, file_path, process_name, event_type, predicted_class FROM filtered WHERE (contains(lower(file_path), 'f1') OR contains(lower(process_name), 'f1') OR contains(event_id::VARCHAR, 'f1')) AND event_type IN ('modified', 'created') AND event_priority IN ('high')")
def repo_search_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repository.matches("F1", "file_path", "process_name", "event_id") & repository.among("event_type", ["modified", "created"]) & repository.among("event_priority", ["high"]) & repository.among("predicted_class", [])
    return _stored(spark, sf_dir).filter(found).select("event_id", "file_path", "process_name", "event_type", "predicted_class")


@query(f"WITH {_PROCESSES} SELECT process_key, process_name, suspicion_score FROM processes WHERE (contains(lower(process_name), 'oc1') OR contains(process_key::VARCHAR, 'oc1')) AND suspicion_score >= 30")
def repo_search_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _processes(spark, sf_dir).filter(repository.matches("OC1", "process_name", "process_key") & (F.col("suspicion_score") >= 30)).select("process_key", "process_name", "suspicion_score")


@query(f"WITH {tables.FILE_EVENTS_SQL} SELECT event_id, us, file_path FROM file_events ORDER BY us DESC, event_id DESC LIMIT 25 OFFSET 25")
def repo_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.page(tables.file_events(spark, sf_dir), repository.event_order("timestamp_desc"), 2, 25).items.select("event_id", "us", "file_path")


@query(f"WITH {tables.FILE_EVENTS_SQL}, n AS (SELECT count(*) AS n FROM events) SELECT event_id, us, file_path FROM file_events ORDER BY lower(file_path) NULLS FIRST, us DESC, event_id DESC LIMIT 100 OFFSET (SELECT (greatest(1, (n + 99) // 100) - 1) * 100 FROM n)")
def repo_last_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.Pages(tables.file_events(spark, sf_dir), repository.event_order("path_asc")).page(2**31, 100).items.select("event_id", "us", "file_path")


@query(f"WITH {tables.FILE_EVENTS_SQL} SELECT event_id, us FROM file_events ORDER BY us DESC, event_id DESC LIMIT 50 OFFSET 75")
def repo_following(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that follow the third page of 25, by that page's last row alone."""
    pages = repository.Pages(tables.file_events(spark, sf_dir), repository.event_order("timestamp_desc"))
    last = min(pages.page(3, 25).items.select("us", "event_id").collect())
    return pages.following([last["us"], last["event_id"]], 50).select("event_id", "us")


@query(f"WITH {_DECIDED} SELECT event_id, event_priority FROM filtered ORDER BY CASE event_priority WHEN 'high' THEN 3 WHEN 'normal' THEN 2 ELSE 1 END DESC, us DESC, event_id DESC LIMIT 100")
def repo_sort_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.page(_stored(spark, sf_dir), repository.event_order("priority_desc"), 1, 100).items.select("event_id", "event_priority")


@query(f"WITH {_PROCESSES} SELECT e.event_id, e.file_path, p.suspicion_score FROM file_events e LEFT JOIN processes p ON p.process_key = e.process_key")
def repo_process_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, p = tables.file_events(spark, sf_dir), _processes(spark, sf_dir).select("process_key", "suspicion_score")
    return e.join(p, "process_key", "left").select("event_id", "file_path", "suspicion_score")


@query("""WITH o AS (SELECT user_id::VARCHAR AS file_path, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, length(event_type) AS size, length(event_type) AS mtime FROM events),
n AS (SELECT *, CASE WHEN size = lag(size) OVER w AND mtime = lag(mtime) OVER w THEN 0 ELSE 1 END AS fresh FROM o WINDOW w AS (PARTITION BY file_path ORDER BY attempt)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY file_path ORDER BY attempt ROWS UNBOUNDED PRECEDING) AS run FROM n),
l AS (SELECT *, row_number() OVER (PARTITION BY file_path, run ORDER BY attempt) AS length FROM r)
SELECT file_path, min(CASE WHEN length >= 3 THEN attempt END)::INT AS stable_attempt, count(*) AS attempts FROM l GROUP BY file_path""")
def stabilization(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = tables.table(spark, sf_dir, "events")
    o = e.select(F.col("user_id").cast("string").alias("file_path"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("attempt"), F.length("event_type").alias("size"), F.length("event_type").alias("mtime"))
    return ev.stabilise(o)


@query("SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("t", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("start_us"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(us) AS start_us, count(*) AS n FROM s GROUP BY user_id, session""")
def session_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("t", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


@query(r"""WITH raw AS (SELECT event_id, user_id, event_type, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, user_id::VARCHAR AS process_id, CASE WHEN event_id % 2 = 0 THEN 'first' ELSE 'nested' END AS name, k AS value, NULL::VARCHAR AS missing FROM raw""")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathomline.functions import fields

    e = tables.table(spark, sf_dir, "events")
    outer = F.when(F.col("event_id") % 2 == 0, '"File-Name":"first",').otherwise('"FileName":"",')
    text = F.concat(F.lit("{"), outer, F.lit('"Event Header":{"Process Id":'), F.col("user_id").cast("string"), F.lit(',"File Name":"nested","In":'), F.col("props"), F.lit("}}"))
    m = fields.flatten(text)
    return e.select("event_id", *(F.element_at(m, k).alias(a) for k, a in (("processid", "process_id"), ("filename", "name"), ("k", "value"), ("absent", "missing"))))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE true END AS ok, CASE event_id % 3 WHEN 0 THEN '{\"k\":' || json_extract_string(props, '$.k') || '}' WHEN 1 THEN '{broken' END AS value FROM events")
def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathomline.functions import fields

    e = tables.table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, "{broken").otherwise(" ")
    return e.select("event_id", fields.parse_json(text).alias("p")).select("event_id", "p.*")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '—' ELSE printf('%.6f', event_id / 8.0) END AS number, CASE WHEN event_id % 4 = 0 THEN '—' ELSE printf('%.2f', (event_id % 100) / 100.0 * 100) || '%' END AS probability FROM events")
def display_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathomline.functions import fields

    n = F.when(F.col("event_id") % 4 != 0, F.col("event_id"))
    return tables.table(spark, sf_dir, "events").select("event_id", fields.display(n / 8.0, "number").alias("number"), fields.display((n % 100) / 100.0, "probability").alias("probability"))


#: Every customer as a process that starts twice in the events' month.
_LIVES = [("c_custkey % 15", ""), ("15 + c_custkey % 11", "-2")]
_MONTH_US = 1_704_067_200_000_000


@query(f"""WITH p AS ({" UNION ALL ".join(f"SELECT c_custkey AS process_id, c_name || '{end}' AS process_name, c_mktsegment AS process_path, {_MONTH_US} + ({day}) * {DAY_US} AS seen_us FROM customer" for day, end in _LIVES)})
SELECT event_id, coalesce(process_name, 'unknown') AS process_name, process_path FROM (SELECT event_id, user_id, epoch_us(ts) AS us FROM events) e ASOF LEFT JOIN p ON e.user_id = p.process_id AND e.us >= p.seen_us""")
def process_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.table(spark, sf_dir, "customer")
    lives = [c.select(F.col("c_custkey").alias("process_id"), F.concat("c_name", F.lit(end)).alias("process_name"), F.col("c_mktsegment").alias("process_path"), F.lit(None).cast("timestamp").alias("process_start_time"), F.expr(f"{_MONTH_US}L + ({day}) * {DAY_US}L").alias("seen_us")) for day, end in _LIVES]
    e = tables.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("process_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return ev.enrich(e, lives[0].unionByName(lives[1])).select("event_id", "process_name", "process_path")


@query(f"WITH {_DECIDED} SELECT filter_decision, filter_reason, count(*) AS n FROM filtered WHERE filter_decision <> 'pass' GROUP BY ALL")
def rejection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.rejections(_stored(spark, sf_dir))


_REASONS = "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN '{profiles.reason(c)} (+{p})' END" for p, c in profiles.RULES) + ")"


@query(f"WITH {_PROFILE}, {_SCORE} SELECT event_id, process_key, suspicion_score, coalesce(nullif({_REASONS}, ''), 'no scoring rules matched') AS decision_reason FROM profile_scored")
def decision_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.with_score(_profiles(spark, sf_dir)).select("event_id", "process_key", "suspicion_score", "decision_reason")


_STAGED = f"""{_DECIDED}, staged AS (SELECT event_id, filter_decision, filter_decision = 'pass' AS p, event_id % 5 <> 0 AS s, event_id % 7 <> 0 AS x, event_id % 11 <> 0 AS v, predicted_class IS NOT NULL AS c FROM filtered)"""


@query(f"""WITH {_STAGED} SELECT event_id, filter_decision, CASE WHEN NOT p THEN 'skipped' WHEN s THEN 'stable' ELSE 'failed' END AS stabilization_status,
CASE WHEN NOT (p AND s) THEN 'skipped' WHEN x THEN 'success' ELSE 'failed' END AS extraction_status, CASE WHEN NOT (p AND s AND x) THEN 'skipped' WHEN v THEN 'success' ELSE 'failed' END AS vectorization_status,
CASE WHEN NOT (p AND s AND x AND v) THEN 'pending' WHEN c THEN 'success' ELSE 'failed' END AS classification_status, filter_decision = 'context_only' OR (p AND s AND x AND v AND c) AS profiled FROM staged""")
def event_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    e = _stored(spark, sf_dir).withColumns({"stable": n % 5 != 0, "extracted": n % 7 != 0, "vectorized": n % 11 != 0, "classified": F.col("predicted_class").isNotNull()})
    return ev.stages(e).select("event_id", "filter_decision", "stabilization_status", "extraction_status", "vectorization_status", "classification_status", "profiled")


@query(f"""WITH {_DECIDED} SELECT event_id, filter_decision, filter_reason, event_priority FROM (SELECT * FROM filtered) WHERE file_path LIKE '/d1/%' OR file_path LIKE '/d3/%' OR file_path LIKE '/d5/%'""".replace(
    "FROM raw_events),", "FROM raw_events WHERE k % 10 IN (1, 3, 5)),"))
def event_monitored(spark: SparkSession, sf_dir: str) -> DataFrame:
    import dataclasses

    config = dataclasses.replace(CONFIG, monitored=("/d1", "/d3/", "/d5"))
    return ev.prefilter(tables.file_events(spark, sf_dir), config).select("event_id", "filter_decision", "filter_reason", "event_priority")


@query("""WITH o AS (SELECT user_id::VARCHAR AS file_path, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, CASE WHEN event_type <> 'error' THEN length(event_type) END AS size, CASE WHEN event_type = 'error' THEN 'unreadable' END AS error FROM events),
n AS (SELECT *, CASE WHEN size = lag(size) OVER (PARTITION BY file_path ORDER BY attempt) THEN 0 ELSE 1 END AS fresh FROM o),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY file_path ORDER BY attempt ROWS UNBOUNDED PRECEDING) AS run FROM n),
l AS (SELECT *, row_number() OVER (PARTITION BY file_path, run ORDER BY attempt) AS length FROM r WHERE attempt <= 20),
g AS (SELECT file_path, min(CASE WHEN size IS NOT NULL AND length >= 3 THEN attempt END) AS a, max(attempt) AS n, arg_max_null(error, attempt) AS e, arg_min(size, attempt) FILTER (size IS NOT NULL AND length >= 3) AS s FROM l GROUP BY file_path)
SELECT file_path, a::INT AS stable_attempt, coalesce(a, n)::BIGINT AS attempts, CASE WHEN a IS NULL THEN 'failed' ELSE 'stable' END AS status, s::INT AS stable_size, CASE WHEN a IS NULL THEN coalesce(e, 'file remained unstable') END AS error FROM g""")
def stabilization_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = tables.table(spark, sf_dir, "events")
    bad, size = F.col("event_type") == "error", F.length("event_type")
    o = e.select(F.col("user_id").cast("string").alias("file_path"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("attempt"), F.when(~bad, size).alias("size"), F.when(~bad, size).alias("mtime"), F.when(bad, "unreadable").alias("error"))
    return ev.stabilisation(o)


@query("""SELECT event_id, 'Ünï-' || event_type AS name, '0x' || upper(printf('%x', event_id * 4096 + 10)) AS pointer FROM events""")
def binary_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events")
    data = F.encode(F.concat(F.lit("Ünï-"), "event_type", F.lit("\0rest"), F.col("event_id").cast("string")), "UTF-16LE")
    return e.select("event_id", ev.utf16_text(data).alias("name"), ev.pointer(F.col("event_id") * 4096 + 10).alias("pointer"))


@query(r"""SELECT event_id, '{EDD08927-9CC4}' AS guid, 'deep' || event_id AS name, (event_id * 1.5)::DECIMAL(18,1)::VARCHAR AS value, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE '[1,"x"]' END AS mark, CASE WHEN event_id % 3 <> 0 THEN 'here' END AS late FROM events""")
def json_flatten_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves below any number of levels, and values that look like objects."""
    from fathomline.functions import fields

    n = F.col("event_id").cast("string")
    inner = F.concat(F.lit('{"File Name":"deep'), n, F.lit('","value":'), (F.col("event_id") * 1.5).cast("decimal(18,1)").cast("string"), F.lit(',"mark":'), F.when(F.col("event_id") % 2 == 0, "true").otherwise('[1,"x"]'), F.lit("}"))
    for level in "gfedcba":
        inner = F.concat(F.lit(f'{{"{level}":'), inner, F.lit("}"))
    late = F.when(F.col("event_id") % 3 == 0, "null").otherwise('"here"')
    text = F.concat(F.lit('{"ProviderGuid":"{EDD08927-9CC4}","FileName":"","x":'), inner, F.lit(',"Late":'), late, F.lit(',"file_name":"other"}'))
    m = fields.flatten(text)
    return tables.table(spark, sf_dir, "events").select("event_id", *(F.element_at(m, k).alias(a) for k, a in (("providerguid", "guid"), ("filename", "name"), ("value", "value"), ("mark", "mark"), ("late", "late"))))
