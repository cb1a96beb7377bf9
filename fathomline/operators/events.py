"""File-event operators: normalisation, path filters, pre-filter decisions, activity, de-duplication, correlation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomline.functions import naming
from fathomline.operators import profiles

# Numeric event ids and what they mean; temporary-file extensions and name marks.
EVENT_IDS = {16: "modified", 26: "deleted", 27: "moved", 30: "created"}
TEMPORARY_EXTENSIONS = (".tmp", ".temp", ".swp", ".part", ".crdownload")
TEMPORARY_NAMES = ("~$", "~", ".~")


@dataclass(frozen=True)
class FilterConfig:
    ignored: tuple[str, ...] = ()
    monitored: tuple[str, ...] = ()
    trusted: tuple[str, ...] = ()
    supported: tuple[str, ...] = (".pdf", ".docx", ".txt", ".bin")
    max_size: int = 100 * 1024 * 1024
    activity_us: int = 2_000_000
    activity_count: int = 10
    temporary: tuple[str, ...] = field(default=TEMPORARY_EXTENSIONS)
    temporary_names: tuple[str, ...] = TEMPORARY_NAMES


def first_of(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def event_type(task: Column, event_id: Column) -> Column:
    """By words in the task's name, deletes before renames before writes before creates; else by number."""
    t = F.lower(F.coalesce(task, F.lit("")))

    def has(*words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(t, F.lit(w))
        return out

    by_id = F.lit(None).cast("string")
    for n, kind in EVENT_IDS.items():
        by_id = F.when(event_id == n, kind).otherwise(by_id)
    return F.when(has("delete"), "deleted").when(has("rename", "move"), "moved").when(has("write", "modify"), "modified").when(has("create"), "created").otherwise(by_id)


def instant(text: Column) -> Column:
    """A timestamp from ISO text, epoch seconds or a FILETIME number (100 ns since 1601); null if none of them."""
    number = text.try_cast("double")
    filetime = F.timestamp_micros(F.expr("0L") + ((text.try_cast("decimal(20,0)") - F.lit(116444736000000000).cast("decimal(20,0)")) / 10).cast("long"))
    return F.when(number > 1e14, filetime).when(number.isNotNull(), F.timestamp_micros((number * 1e6).cast("long"))).otherwise(F.try_to_timestamp(text))


def utf16_text(data: Column) -> Column:
    """Little-endian UTF-16 up to its first NUL."""
    return F.substring_index(F.decode(data, "UTF-16LE"), "\0", 1)


def pointer(number: Column) -> Column:
    """A number as 0x and upper-case hexadecimal digits."""
    return F.concat(F.lit("0x"), F.hex(number))


def process_key(pid: Column, started: Column, name: Column) -> Column:
    stamp = F.date_format(started, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return F.when(pid.isNotNull(), F.concat(pid.cast("string"), F.lit(":"), F.coalesce(stamp, F.lit("unknown")))).otherwise(F.concat(F.lit("unknown:"), F.coalesce(name, F.lit("unknown"))))


def within(path: Column, folders: tuple[str, ...]) -> Column:
    """Whether a path is one of the folders or below it, by whole components."""
    out = F.lit(False)
    for d in folders:
        out = out | (path == d) | path.startswith(d.rstrip("/") + "/")
    return out


def is_temporary(path: Column, extension: Column, config: FilterConfig) -> Column:
    out, name = F.lower(extension).isin(*config.temporary), F.lower(naming.basename(path))
    for beginning in config.temporary_names:
        out = out | name.startswith(beginning)
    return out


def is_ranked() -> Column:
    """Of decided events: whether it counts as activity and can have a priority above low."""
    return (F.col("filter_decision") == "pass") | (F.col("event_type") == "deleted")


def decided(events: DataFrame, config: FilterConfig) -> DataFrame:
    """events inside the monitored folders, where any are named, with filter_decision and filter_reason: one chain, cheap tests first. Looks at one event at a time."""
    if config.monitored:
        events = events.filter(within(F.col("file_path"), config.monitored))
    size, ext = F.col("file_size"), F.col("file_extension")
    trusted = F.lower(naming.basename(F.col("process_name"))).isin(*config.trusted) if config.trusted else F.lit(False)
    reasoned = events.withColumn("filter_reason", F.when(F.col("event_type") == "deleted", "delete_event").when(within(F.col("file_path"), config.ignored), "ignored_directory")
                                 .when(is_temporary(F.col("file_path"), ext, config), "temporary_or_service_file").when(trusted, "trusted_process").when(size > config.max_size, "file_too_large"))
    return reasoned.withColumn("filter_decision", F.when(F.col("filter_reason").isNull(), "pass").when(F.col("filter_reason").isin("delete_event", "file_too_large"), "context_only").otherwise("drop"))


def prioritised(rated: DataFrame, config: FilterConfig) -> DataFrame:
    """decided events with their activity -> with event_priority, and the marks that raised it in filter_reason."""
    marks = F.array_compact(F.array(
        F.when(F.col("process_name").isNull() | (F.lower("process_name") == "unknown"), "unknown_process"),
        F.when(~F.lower("file_extension").isin(*config.supported), "unusual_extension") if config.supported else F.lit(None).cast("string"), F.when(F.col("activity") >= config.activity_count, "high_activity")))
    passed = F.col("filter_decision") == "pass"
    reason = F.when(passed, F.when(F.size(marks) > 0, F.concat(F.lit("accepted; priority="), F.array_join(marks, ","))).otherwise("accepted")).otherwise(F.col("filter_reason"))
    priority = F.when(is_ranked(), F.when(F.size(marks) > 0, "high").otherwise("normal")).otherwise("low")
    return rated.withColumn("filter_reason", reason).withColumn("event_priority", priority)


def prefilter(events: DataFrame, config: FilterConfig) -> DataFrame:
    """events with filter_decision, filter_reason, event_priority.

    Events outside of the monitored folders, where any are named, are no input and left out. What is
    dropped or too large has low priority; passed and delete events have a high one if anything about
    them is unusual. Activity counts, per process and in the window up to the event's own time, only
    events that pass or delete. One shuffle, by process and span of time.
    """
    rated = profiles.windowed_count(decided(events, config), "process_key", is_ranked(), config.activity_us, "activity")
    return prioritised(rated, config)


def stages(filtered: DataFrame) -> DataFrame:
    """filtered events with the status of each stage after the filter, as the stages before allow.

    filtered: filter_decision; stable (whether the file came to rest), extracted, vectorized, classified
    (whether that stage, if it is reached, succeeds; null counts as a failure). An event that doesn't
    pass skips all; an unstable file skips extraction and vectorising, a failed extraction skips
    vectorising. A stage that isn't reached at all stays pending. profiled: whether the event goes on to
    its process's profile: context events do, and those that were classified.
    """
    passed, ok = F.col("filter_decision") == "pass", {c: F.coalesce(c, F.lit(False)) for c in ("stable", "extracted", "vectorized", "classified")}
    stable = passed & ok["stable"]
    extracted = stable & ok["extracted"]
    vectorized = extracted & ok["vectorized"]

    def status(reached: Column, done: Column, name: str = "success") -> Column:
        return F.when(reached & done, name).when(reached, "failed").otherwise("skipped")

    return filtered.withColumns({
        "stabilization_status": status(passed, ok["stable"], "stable"), "extraction_status": status(stable, ok["extracted"]), "vectorization_status": status(extracted, ok["vectorized"]),
        "classification_status": F.when(vectorized, F.when(ok["classified"], "success").otherwise("failed")).otherwise("pending"),
        "profiled": (F.col("filter_decision") == "context_only") | (vectorized & ok["classified"])})


STAGES = [("filter", None), ("stabilization", "stabilization_status"), ("extraction", "extraction_status"), ("vectorization", "vectorization_status"), ("classification", "classification_status")]


def stage_changes(staged: DataFrame) -> DataFrame:
    """staged events, a row for each stage that an event has gone through: stage (its number, the filter is 0), stage_name, and the statuses as they were then. What comes later is pending; stages that are skipped are told with the stage that has them skipped."""
    skipped = lambda c: F.col(c) == "skipped"
    reached = F.array_compact(F.array(*(F.when(F.lit(True) if c is None else ~skipped(c) & (F.col(c) != "pending"), F.lit(k)) for k, (_, c) in enumerate(STAGES))))
    each = staged.withColumn("stage", F.explode(reached))
    last = F.col("stage") == F.array_max(reached)
    then = {c: F.when((F.col("stage") >= k) | skipped(c) & last, F.col(c)).otherwise("pending") for k, (_, c) in enumerate(STAGES) if c}
    return each.withColumns({"profiled": F.col("profiled") & last, "stage_name": F.get(F.array(*(F.lit(n) for n, _ in STAGES)), F.col("stage")), **then})


def deduplicate(events: DataFrame, window_us: int = 500_000) -> DataFrame:
    """events with is_duplicate: within window_us of the previous event of the same process, path and type, even if that one was a duplicate."""
    w = W.partitionBy("process_key", F.lower("file_path"), "event_type").orderBy("us", "event_id")
    gap = F.col("us") - F.lag("us").over(w)
    return events.withColumn("is_duplicate", F.coalesce((gap >= 0) & (gap <= window_us), F.lit(False)))


def correlate(raw: DataFrame, learn: bool = False) -> DataFrame:
    """raw(seq, action, file_key or file_keys, file_path, ...): its used events, with resolved_path.

    That is the event's own path, or else the path that the latest 'name' event before it has given to its
    identifier, if no 'forget' event came between; of several (file_keys, an array) the first that
    has one. Name and forget events themselves aren't returned. learn: other events' own paths name
    their identifiers too. An event without identifier has its own path only, and shuffles nothing.
    """
    if "file_keys" in raw.columns:
        return _correlate_any(raw, learn)
    used = ~F.col("action").isin("name", "forget")
    keyed = _named(raw.filter("file_key IS NOT NULL"), learn).filter(used).withColumn("resolved_path", first_of(F.col("file_path"), F.col("known"))).drop("known")
    return keyed.unionByName(raw.filter("file_key IS NULL").filter(used).withColumn("resolved_path", first_of(F.col("file_path"))))


def _named(raw: DataFrame, learn: bool) -> DataFrame:
    """raw(seq, action, file_key, file_path, ...) with known: the name that its identifier has by then, its own included."""
    w = W.partitionBy("file_key").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    life = raw.withColumn("life", F.count(F.when(F.col("action") == "forget", 1)).over(w))
    of_life = W.partitionBy("file_key", "life").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    names = F.col("action") != "forget" if learn else F.col("action") == "name"
    return life.withColumn("known", F.last(F.when(names, first_of(F.col("file_path"))), ignorenulls=True).over(of_life)).drop("life")


def _correlate_any(raw: DataFrame, learn: bool) -> DataFrame:
    """correlate for events with several identifiers: each identifier's names apart, then an event's first that has one."""
    each = raw.select("seq", "action", "file_path", F.posexplode("file_keys").alias("place", "file_key")).filter("file_key IS NOT NULL")
    used = ~F.col("action").isin("name", "forget")
    known = _named(each, learn).filter(used).filter("known IS NOT NULL").groupBy("seq").agg(F.min_by("known", "place").alias("known"))
    return raw.filter(used).join(known, "seq", "left").withColumn("resolved_path", first_of(F.col("file_path"), F.col("known"))).drop("known")


def stabilise(observations: DataFrame, checks: int = 3, most_attempts: int = 2**31 - 1) -> DataFrame:
    """observations(file_path, attempt, size, mtime): per file, the first attempt with `checks` equal signatures in a row (null if there is none within most_attempts) and how many attempts there were. An attempt that could not read the file has no signature and ends a run."""
    return stabilisation(observations, checks, most_attempts, keep_all=True).select("file_path", "stable_attempt", "attempts")


def stabilisation(observations: DataFrame, checks: int = 3, most_attempts: int = 20, keep_all: bool = False) -> DataFrame:
    """file_path, stable_attempt, attempts (that were made: none after the stable one, unless keep_all), status (stable or failed), stable_size, error. observations may have an error's text for attempts without signature."""
    w = W.partitionBy("file_path").orderBy("attempt")
    readable = F.col("size").isNotNull() & F.col("mtime").isNotNull()
    same = (F.col("size") == F.lag("size").over(w)) & (F.col("mtime") == F.lag("mtime").over(w))
    runs = observations.withColumn("error", F.col("error") if "error" in observations.columns else F.lit(None).cast("string"))
    runs = runs.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    runs = runs.withColumn("length", F.row_number().over(W.partitionBy("file_path", "run").orderBy("attempt")))
    reached = readable & (F.col("length") >= checks) & (F.col("attempt") <= most_attempts)
    per = runs.groupBy("file_path").agg(
        F.min(F.when(reached, F.col("attempt"))).alias("stable_attempt"), F.count("*").alias("attempts"), F.min_by("size", F.when(reached, F.col("attempt"))).alias("stable_size"),
        F.max_by("error", F.when(F.col("attempt") <= most_attempts, F.col("attempt"))).alias("last_error"))
    stable = F.col("stable_attempt").isNotNull()
    made = F.col("attempts") if keep_all else F.coalesce(F.col("stable_attempt").cast("long"), F.least("attempts", F.lit(most_attempts).cast("long")))
    return per.select("file_path", "stable_attempt", made.alias("attempts"), F.when(stable, "stable").otherwise("failed").alias("status"), F.when(stable, F.col("stable_size")).alias("stable_size"),
                      F.when(~stable, F.coalesce("last_error", F.lit("file remained unstable"))).alias("error"))


def enrich(events: DataFrame, processes: DataFrame) -> DataFrame:
    """events(process_id, us, ...) with the name, path and start of their process as known at the event's time; a process not known by then is named unknown. processes: process_id, process_name, process_path, process_start_time, seen_us.

    A process id's few lives travel as one array, so events join on the id alone, and a busy id's events can be split.
    """
    life = F.struct("seen_us", "process_name", "process_path", "process_start_time")
    lives = processes.groupBy("process_id").agg(F.sort_array(F.collect_list(life)).alias("lives"))
    joined = events.drop("process_name", "process_path", "process_start_time").join(lives, "process_id", "left")
    p = F.get(F.filter("lives", lambda x: x["seen_us"] <= F.col("us")), F.size(F.filter("lives", lambda x: x["seen_us"] <= F.col("us"))) - 1)
    joined = joined.withColumn("p", p)
    return joined.select(*(c for c in joined.columns if c not in ("p", "lives")), F.coalesce("p.process_name", F.lit("unknown")).alias("process_name"), F.col("p.process_path").alias("process_path"), F.col("p.process_start_time").alias("process_start_time"))


def rejections(filtered: DataFrame) -> DataFrame:
    """How many events each reason has kept from being processed."""
    return filtered.filter("filter_decision <> 'pass'").groupBy("filter_decision", "filter_reason").agg(F.count("*").alias("n"))


def check_config(config: FilterConfig) -> None:
    """Raises on settings that contradict each other."""
    if config.max_size <= 0 or config.activity_us <= 0 or config.activity_count <= 0:
        raise ValueError("sizes, windows and counts are positive")
    if any(not e.startswith(".") for e in (*config.supported, *config.temporary)):
        raise ValueError("extensions start with a dot")
    if set(config.supported) & set(config.temporary):
        raise ValueError("an extension is both supported and temporary")
    if set(config.monitored) & set(config.ignored):
        raise ValueError("a folder is both monitored and ignored")
