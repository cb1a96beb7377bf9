"""Per-process sliding profiles, rule scores, threat levels and responses.

Everything that a profile needs is computed after one shuffle, by process and span of time, so that no
task holds more of a busy process than a few windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

POSITIVE = "ransomware-encrypted"

# Points of each rule and its condition on the profile.
RULES: list[tuple[int, str]] = [
    (25, "ransomware_encrypted_count >= 1"), (20, "ransomware_encrypted_count >= 2"), (15, "ransomware_encrypted_count >= 3"),
    (20, "ransomware_ratio >= 0.5 AND classified_events_count >= 2"), (15, "ransomware_ratio >= 0.8 AND classified_events_count >= 3"),
    (15, "consecutive_ransomware_hits >= 2"), (15, "consecutive_ransomware_hits >= 3"),
    (5, "max_ransomware_probability >= 0.92"), (10, "max_ransomware_probability >= 0.95"),
    (10, "avg_ransomware_probability >= 0.6 AND classified_events_count >= 2"), (15, "avg_ransomware_probability >= 0.8 AND classified_events_count >= 3"),
    (10, "events_in_window >= 5"), (10, "events_in_window >= 10"), (15, "events_in_window >= 20"),
    (10, "touched_files_unique >= 3"), (10, "touched_files_unique >= 5"), (15, "touched_files_unique >= 10"),
    (15, "ransomware_encrypted_count >= 1 AND touched_files_unique >= 5"), (15, "ransomware_encrypted_count >= 2 AND touched_files_unique >= 5"),
]
# Least score of each level, and what is requested at it.
LEVELS = [("critical", 80), ("high", 60), ("medium", 30), ("low", 0)]
ACTIONS = {"low": "log", "medium": "warn", "high": "mark_suspicious", "critical": "propose_block"}


# Fixed value: the reason where no rule holds.
NO_RULE = "no scoring rules matched"


def reason(condition: str) -> str:
    """A rule's condition as it is told."""
    return condition.replace(" >= ", ">=").replace(" AND ", " and ")


#: Windows that a span of time has: a span's events travel together, with those of the window before it.
SPANS = 4
DEAL, SPAN, OWN, STEP, AT, END = "_deal", "_span", "_own", "_step", "_at", "_end"


def in_spans(events: DataFrame, window_us: int, spans: int = SPANS) -> DataFrame:
    """events(us, ...) by spans of so many windows: SPAN is a span's start, and an event is also in the next span, not as its OWN, if it is in the window of that span's first moment. So a key's events can be dealt by (key, SPAN)."""
    width = spans * window_us
    start = F.col("us") - F.pmod(F.col("us"), F.lit(width))
    after = start + width
    spread = events.withColumn(SPAN, F.explode(F.when(F.col("us") >= after - window_us, F.array(start, after)).otherwise(F.array(start))))
    return spread.withColumn(OWN, F.col(SPAN) == start)


#: Events of a task, about, once they are dealt by span; and below how many each it isn't worth another task.
ROWS, FEWEST = 50_000, 5_000


def tasks(events: int, cores: int) -> int:
    """How many tasks so many events are dealt to: one a ROWS, or a core each if there are enough."""
    return max(1, -(-events // ROWS), min(cores, events // FEWEST))


def dealt(events: DataFrame, key: str, window_us: int) -> DataFrame:
    """events in spans, shuffled by key and span to a number of tasks that is counted from events. What a task sorts is so many events, however large the table: a session's number of shuffle partitions stays the same as tables grow, and tasks would grow."""
    n = tasks(events.count(), events.sparkSession.sparkContext.defaultParallelism)
    # by one column, which windows have among theirs: of keys that are the same in all rows the plan drops some
    return in_spans(events, window_us).withColumn(DEAL, F.xxhash64(key, SPAN)).repartition(n, DEAL)


def stepped(spread: DataFrame, window_us: int) -> DataFrame:
    """Each event as two steps of a sweep line: STEP 1 where it comes into windows, AT its time, and -1 where it is out of them, just after a window. Running sums of STEP by AT count the events of the window before each. END is the last moment of what the step ends: a window for -1."""
    steps = spread.withColumn(STEP, F.explode(F.array(F.lit(1), F.lit(-1))))
    out = F.when(F.col(STEP) == 1, 0).otherwise(window_us)
    return steps.withColumn(END, F.col("us") + out).withColumn(AT, F.when(F.col(STEP) == 1, F.col("us")).otherwise(F.col("us") + window_us + 1))


def windowed_count(events: DataFrame, key: str, what: Column, window_us: int, name: str) -> DataFrame:
    """events with the number of those of their key, in the window up to their own time, of which what is true. One shuffle by key and span, one running sum."""
    swept = stepped(dealt(events.withColumn(name, F.coalesce(what, F.lit(False)).cast("long")), key, window_us), window_us)
    upto = W.partitionBy(DEAL, key, SPAN).orderBy(AT).rangeBetween(W.unboundedPreceding, W.currentRow)
    found = swept.withColumn(name, F.sum(F.col(name) * F.col(STEP)).over(upto))
    return found.filter((F.col(STEP) == 1) & F.col(OWN)).drop(DEAL, SPAN, OWN, STEP, AT, END)


def profiles(events: DataFrame, window_us: int = 30_000_000) -> DataFrame:
    """events(process_key, event_id, us, file_path, predicted_class, probability) with the profile of their process over the window up to their own time.

    A window holds every event at or after (time - window_us), those of the same time included.
    consecutive_ransomware_hits is the run of positive classified events that ends here, by time and
    event_id, as far as it lies in the window; unclassified events neither end nor lengthen it.
    Ratios are 0 where nothing is classified.

    All measures are running sums over a sweep line, so an event costs the same however many its window
    has: a file counts from an event that none of its own was a window before, to the end of a window
    that none follows in; the largest and first of a window are those of its parts in two blocks of a
    window's length. Events are dealt by process and span of time, and only one shuffle is needed.
    """
    pred, path = F.col("predicted_class"), F.col("file_path")
    hit = F.when(pred == POSITIVE, 1).otherwise(0)
    of_path = W.partitionBy(DEAL, "process_key", SPAN, "file_path").orderBy("us", "event_id")
    order = W.partitionBy(DEAL, "process_key", SPAN).orderBy("us", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    of_run = W.partitionBy(DEAL, "process_key", SPAN, "_run").orderBy("us", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    e = dealt(events, "process_key", window_us).withColumns({"_before": F.lag("us").over(of_path), "_next": F.lead("us").over(of_path)})
    e = e.withColumn("_run", F.sum(F.when(pred.isNotNull() & (pred != POSITIVE), 1).otherwise(0)).over(order))
    e = stepped(e.withColumn("_streak", F.sum(hit).over(of_run)), window_us)

    step, coming = F.col(STEP), F.col(STEP) == 1
    far = lambda other, gap: F.col(other).isNull() | (gap > window_us)
    file_step = F.when(path.isNull(), 0).when(coming, far("_before", F.col("us") - F.col("_before")).cast("int")).otherwise(-far("_next", F.col("_next") - F.col("us")).cast("int"))
    by_row = W.partitionBy(DEAL, "process_key", SPAN).orderBy(AT, STEP, "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    by_time = W.partitionBy(DEAL, "process_key", SPAN).orderBy(AT).rangeBetween(W.unboundedPreceding, W.currentRow)
    e = e.withColumn("_hits", F.sum(step * hit).over(by_row))

    def n(condition: Column) -> Column:
        return F.sum(F.when(condition, step).otherwise(0)).over(by_time)

    e = e.withColumns({
        "events_in_window": n(F.lit(True)), "classified_events_count": n(pred.isNotNull()), "benign_count": n(pred == "benign"), "benign_encrypted_count": n(pred == "benign-encrypted"), "ransomware_encrypted_count": n(pred == POSITIVE),
        "touched_files": n(path.isNotNull()), "touched_files_unique": F.sum(file_step).over(by_time),
        # sums of decimals, for what is added comes out again without a trace
        "_rated": n(F.col("probability").isNotNull()), "_total": F.sum(F.col("probability").cast("decimal(20,18)") * step).over(by_time)})

    # a window is a block's part up to here and the block before's from a window before: whose ends are not before here
    block = F.col(END) - F.pmod(F.col(END), F.lit(window_us))
    e = e.withColumn("_block", block)
    here = W.partitionBy(DEAL, "process_key", SPAN, "_block").orderBy(END).rangeBetween(W.unboundedPreceding, W.currentRow)
    back = W.partitionBy(DEAL, "process_key", SPAN, "_block").orderBy(F.desc(END)).rangeBetween(W.unboundedPreceding, W.currentRow)
    both = lambda f, c: (f(F.when(coming, F.col(c))).over(here), f(F.when(~coming, F.col(c))).over(back))
    e = e.withColumns({"_largest": F.greatest(*both(F.max, "probability")), "_first": F.least(*both(F.min, "us"))}).filter(coming & F.col(OWN))
    return e.select(
        *events.columns, *(F.col(c) for c in ("events_in_window", "classified_events_count", "benign_count", "benign_encrypted_count", "ransomware_encrypted_count")),
        F.coalesce("_largest", F.lit(0.0)).alias("max_ransomware_probability"), F.when(F.col("_rated") > 0, F.col("_total").cast("double") / F.col("_rated")).otherwise(0.0).alias("avg_ransomware_probability"),
        "touched_files", "touched_files_unique", F.least("_streak", "_hits").alias("consecutive_ransomware_hits"),
        F.when(F.col("classified_events_count") > 0, F.col("ransomware_encrypted_count") / F.col("classified_events_count")).otherwise(0.0).alias("ransomware_ratio"),
        F.greatest("_first", F.col("us") - window_us).alias("window_start_us"))


def with_score(profile: DataFrame) -> DataFrame:
    """Adds suspicion_score: the points of all rules that hold, 100 at most; and decision_reason: these rules with their points, in order."""
    total, reasons = F.lit(0), []
    for points, condition in RULES:
        total = total + F.when(F.expr(condition), points).otherwise(0)
        reasons.append(F.when(F.expr(condition), f"{reason(condition)} (+{points})"))
    why = F.concat_ws("; ", *reasons)
    return profile.withColumn("suspicion_score", F.least(total, F.lit(100))).withColumn("decision_reason", F.when(why == "", NO_RULE).otherwise(why))


def threat_level(score: Column) -> Column:
    out = F.when((score < 0) | (score > 100) | score.isNull(), F.raise_error(F.lit("score outside 0..100")))
    for name, least in LEVELS:
        out = out.when(score >= least, name)
    return out


def requested_action(level: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair)), level)


def respond(scored: DataFrame) -> DataFrame:
    """Adds threat_level, requested_action and executed_action; what is executed is a log entry, always."""
    return (scored.withColumn("threat_level", threat_level(F.col("suspicion_score"))).withColumn("requested_action", requested_action(F.col("threat_level")))
            .withColumn("executed_action", F.lit("log")).withColumn("response_status", F.lit("completed")))


def latest(changes: DataFrame, key: str, *version: str) -> DataFrame:
    """The last version of each key's row: upsert as append and latest-wins. Nothing but one row per key and task is shuffled."""
    rest = [c for c in changes.columns if c != key]
    best = changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("r"))
    return best.select(key, *(F.col(f"r.{c}").alias(c) for c in rest))
