"""Grouped splits, quotas, apportionment and byte-range plans."""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RATIOS = {"train": 0.70, "valid": 0.15, "test": 0.15}
LEAST_GROUPS, MOST_DRIFT = 3, 0.20
# Bytes of header, chunk and stride of the encryption plans.
KIB, MIB = 1024, 1024 * 1024
HEADER, BIG_HEADER, BIG_FILE, CHUNK, STRIDE, SMALL_FILE = 16 * KIB, 64 * KIB, 20 * MIB, 32 * KIB, 64 * KIB, 10 * MIB


def assign_groups(counts: dict[str, dict[str, int]], ratios: dict[str, float]) -> dict[str, str]:
    """group -> split for counts[group][class], whole groups only.

    First every class with LEAST_GROUPS groups gets one of its groups into each split; then the
    remaining groups, those of many classes and rows first, go where the fullest of the group's
    targets, then their mean, then the split's total would be lowest (ties by the split's name).
    All orders are total, so the result depends on counts alone.
    """
    rows = {g: sum(c.values()) for g, c in counts.items()}
    classes = sorted({k for c in counts.values() for k in c})
    class_total = {k: sum(c.get(k, 0) for c in counts.values()) for k in classes}
    everything = sum(rows.values())
    have: dict[str, dict[str, int]] = {s: defaultdict(int) for s in ratios}
    filled = dict.fromkeys(ratios, 0)
    placed: dict[str, str] = {}
    order = sorted(counts, key=lambda g: (-len(counts[g]), -rows[g], g))

    def place(group: str, split: str) -> None:
        placed[group] = split
        filled[split] += rows[group]
        for k, n in counts[group].items():
            have[split][k] += n

    for k in classes:
        of_class = sorted((g for g in counts if k in counts[g]), key=lambda g: (-len(counts[g]), rows[g], g))
        if len(of_class) < LEAST_GROUPS:
            continue
        for s in ratios:
            free = next((g for g in of_class if g not in placed), None)
            if not have[s][k] and free is not None:
                place(free, s)

    def fullness(group: str, split: str) -> tuple[float, float, float, str]:
        total = (filled[split] + rows[group]) / max(1.0, ratios[split] * everything)
        fills = [total, *((have[split][k] + n) / max(1.0, ratios[split] * class_total[k]) for k, n in counts[group].items())]
        return max(fills), sum(fills) / len(fills), total, split

    for g in order:
        if g not in placed:
            place(g, min(fullness(g, s) for s in ratios)[3])
    return placed


#: Groups that the greedy rule takes, one after the other, on the driver; more are apportioned.
MOST_GREEDY = 10_000
#: Groups of a hash range, about; bits of a group's hash.
RANGE_GROUPS, HASH_BITS = 1024, 44


def apportioned(rows: DataFrame, ratios: dict[str, float] | None = None) -> DataFrame:
    """group_id and split of rows(group_id, gt_class, ...), any number of groups, without looking at one after the other.

    Groups of one signature, the classes that they have, are alike; a signature's groups are cut into
    ranges of their hash, and each range is dealt out by hash: one group to each split, then the
    splits' shares of the rest, what is left going to the largest remainders (the first split at
    a tie). Ranges with fewer groups than splits are dealt out together, round the splits from the last
    to the first, by signature and hash. Only small numbers of groups, not groups, have a table for
    all ranges. Ratios count in thousandths.
    """
    ratios = ratios or RATIOS
    names, s = list(ratios), len(ratios)
    per_group = rows.groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_set("gt_class")), ",").alias("signature"))
    h = F.conv(F.substring(F.md5("group_id"), 1, HASH_BITS // 4), 16, 10).cast("long")
    hashed = per_group.withColumn("h", h)
    of_signature = hashed.groupBy("signature").agg(F.greatest(F.lit(1), F.expr(f"count(*) div {RANGE_GROUPS}")).alias("ranges"))  # a row a signature
    ranged = hashed.join(of_signature, "signature").withColumn("range", F.shiftright(F.col("h") * F.col("ranges"), HASH_BITS))
    part = W.partitionBy("signature", "range")
    placed = ranged.withColumn("n", F.count("*").over(part)).withColumn("place", F.row_number().over(part.orderBy("h", "group_id")))

    spark = rows.sparkSession
    shares = spark.createDataFrame([(i, name, round(1000 * r)) for i, (name, r) in enumerate(ratios.items())], "i int, split string, share long")
    sizes = placed.filter(F.col("n") >= s).select("n").distinct()  # some 2 * RANGE_GROUPS values at most
    of_size = W.partitionBy("n")
    dealt = sizes.join(F.broadcast(shares)).withColumn("rest", (F.col("n") - s) * F.col("share"))
    dealt = dealt.withColumn("floor", F.expr("rest div 1000")).withColumn("left", F.col("n") - s - F.sum("floor").over(of_size))
    dealt = dealt.withColumn("got", 1 + F.col("floor") + (F.row_number().over(of_size.orderBy(F.desc(F.col("rest") % 1000), "i")) <= F.col("left")).cast("int"))
    dealt = dealt.withColumn("upto", F.sum("got").over(of_size.orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow))).select("n", "split", (F.col("upto") - F.col("got")).alias("after"), "upto")
    many = placed.join(F.broadcast(dealt), "n").filter((F.col("place") > F.col("after")) & (F.col("place") <= F.col("upto")))
    few = placed.filter(F.col("n") < s).withColumn("at", F.row_number().over(W.orderBy("signature", "h", "group_id")) - 1)  # fewer than splits a range
    turn = F.get(F.array(*(F.lit(x) for x in reversed(names))), F.col("at") % s)
    return many.select("group_id", "split").unionByName(few.select("group_id", turn.alias("split")))


def grouped_split(rows: DataFrame, ratios: dict[str, float] | None = None) -> DataFrame:
    """rows(group_id, gt_class, ...) with their split. Up to MOST_GREEDY groups are placed by the greedy rule from their counts; more are apportioned, and none of them reaches the driver."""
    ratios = ratios or RATIOS
    if rows.select("group_id").distinct().limit(MOST_GREEDY + 1).count() > MOST_GREEDY:
        return rows.join(apportioned(rows, ratios), "group_id")
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for r in rows.groupBy("group_id", "gt_class").count().collect():
        counts[r["group_id"]][r["gt_class"]] = r["count"]
    placed = assign_groups(counts, ratios)
    pairs = rows.sparkSession.createDataFrame(sorted(placed.items()) or [], "group_id string, split string")
    return rows.join(pairs, "group_id")


def check_split(rows: DataFrame, ratios: dict[str, float] | None = None) -> None:
    """Raises unless no group is in two splits, classes with enough groups are in every split, and class shares don't drift."""
    ratios = ratios or RATIOS
    if rows.groupBy("group_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").limit(1).count():
        raise ValueError("a group is in more than one split")
    of: dict[str, dict[str, int]] = defaultdict(dict)
    for r in rows.groupBy("split", "gt_class").count().collect():
        of[r["gt_class"]][r["split"]] = r["count"]
    groups = {r["gt_class"]: r["n"] for r in rows.groupBy("gt_class").agg(F.count_distinct("group_id").alias("n")).collect()}
    for k, splits in of.items():
        if groups[k] >= LEAST_GROUPS and set(splits) != set(ratios):
            raise ValueError(f"class {k} is missing from a split")
        total = sum(splits.values())
        if groups[k] >= LEAST_GROUPS and any(abs(splits[s] / total - ratios[s]) > MOST_DRIFT for s in ratios):
            raise ValueError(f"class {k} drifts from its ratio")


def target_count(total: int, fraction: float) -> int:
    """fraction of total, half rounded to even; at least one where either allows any."""
    if total <= 0 or fraction <= 0:
        return 0
    return max(1, min(total, round(total * fraction)))


def allocate_by_quota(target: int, quotas: dict[str, float], capacity: dict[str, int]) -> dict[str, int]:
    """Floors of the quotas' shares, then all that is left to the first in order of fraction and quota that has room, and so on; then by room."""
    desired = {k: target * q for k, q in quotas.items()}
    got = {k: min(capacity.get(k, 0), math.floor(d)) for k, d in desired.items()}
    place = {k: i for i, k in enumerate(quotas)}

    def hand_out(order: list[str]) -> None:
        for k in order:
            left = target - sum(got.values())
            if left <= 0:
                return
            got[k] += min(capacity.get(k, 0) - got[k], left)

    hand_out(sorted(quotas, key=lambda k: (-(desired[k] - math.floor(desired[k])), -quotas[k], place[k])))
    hand_out(sorted(quotas, key=lambda k: (-(capacity.get(k, 0) - got[k]), -quotas[k], place[k])))
    return got


def largest_remainder(total: int, shares: dict[str, float]) -> dict[str, int]:
    """Whole numbers that sum to total: floors, and one more each for the largest fractions (ties in given order)."""
    exact = {k: total * s for k, s in shares.items()}
    got = {k: math.floor(x) for k, x in exact.items()}
    place = {k: i for i, k in enumerate(shares)}
    for k in sorted(shares, key=lambda k: (-(exact[k] - got[k]), place[k]))[: max(0, total - sum(got.values()))]:
        got[k] += 1
    return got


def allocated(kinds: DataFrame, fraction: float) -> DataFrame:
    """kinds(kind, capacity, quota, place) with allocated, what allocate_by_quota gives each of target_count's rows: floors of the quotas' shares, then what is left, in order of fraction, quota and place, as far as each has room. Windows run over a row a kind."""
    every = W.partitionBy()
    total = F.sum("capacity").over(every)
    target = F.when((total > 0) & (F.lit(fraction) > 0), F.greatest(F.lit(1.0), F.least(total.cast("double"), F.bround(total * F.lit(fraction), 0)))).otherwise(0.0)
    d = kinds.withColumn("_target", target).withColumn("_desired", F.col("_target") * F.col("quota"))
    d = d.withColumn("_got", F.least(F.col("capacity"), F.floor("_desired"))).withColumn("_room", F.col("capacity") - F.col("_got"))
    turn = every.orderBy((F.col("_desired") - F.floor("_desired")).desc(), F.desc("quota"), "place").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("_target") - F.sum("_got").over(every) - F.coalesce(F.sum("_room").over(turn), F.lit(0))
    more = F.greatest(F.lit(0.0), F.least(F.col("_room").cast("double"), left))
    return d.withColumn("allocated", (F.col("_got") + more).cast("long")).select(*kinds.columns, "allocated")


def remainders(shares: DataFrame, total: DataFrame) -> DataFrame:
    """shares(..., share, place) with allocated, what largest_remainder gives each of total's (one row) n: floors, and one more each for the largest fractions. Windows run over a row a share."""
    d = shares.join(F.broadcast(total)).withColumn("_exact", F.col("n") * F.col("share"))  # one row
    d = d.withColumn("_low", F.floor("_exact")).withColumn("_rest", F.col("n") - F.sum("_low").over(W.partitionBy()))
    rank = F.row_number().over(W.partitionBy().orderBy((F.col("_exact") - F.col("_low")).desc(), "place"))
    return d.withColumn("allocated", (F.col("_low") + (rank <= F.col("_rest")).cast("int")).cast("long")).select(*shares.columns, "allocated")


def first_of_each(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key in order, which has to be total for the same result every time: a distinct that says which row stays. Rows are combined in tasks before they are shuffled; a null key is a key."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")) if rest else rows.select(*keys).distinct()
    return best.select(*(c if c in keys else F.col(f"_r.{c}").alias(c) for c in rows.columns))


def hash_order(key: Column, seed: int) -> Column:
    """A seeded shuffle's order, the same in any engine that has md5."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")))


def quota_sample(pool: DataFrame, key: str, kind: str, quotas: dict[str, float], fraction: float, seed: int) -> DataFrame:
    """pool rows picked by quota per kind in seeded order; rows of other kinds fill up where quotas run out of rows.

    A row's place is its rank within its hash prefix plus the sizes of its kind's prefixes before, so
    no task ranks all rows of a kind, and prefixes that lie beyond the quota aren't ranked at all.
    """
    pool = pool.filter(F.col(kind).isin(*quotas))
    capacity = {r[kind]: r["count"] for r in pool.groupBy(kind).count().collect()}
    target = target_count(sum(capacity.values()), fraction)
    got = allocate_by_quota(target, quotas, capacity)
    allowed = pool.sparkSession.createDataFrame(list(got.items()), f"{kind} string, allowed long")
    placed = pool.withColumn("_h", hash_order(F.col(key), seed)).withColumn("_p", F.substring("_h", 1, 3))
    sizes = placed.groupBy(kind, "_p").agg(F.count("*").alias("_n"))  # 4096 prefixes a kind at most
    earlier = W.partitionBy(kind).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select(kind, "_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")).join(F.broadcast(allowed), kind).filter("_before < allowed")
    placed = placed.join(F.broadcast(before), [kind, "_p"]).withColumn("_rank", F.row_number().over(W.partitionBy(kind, "_p").orderBy("_h", key)) + F.col("_before"))
    return placed.filter("_rank <= allowed").drop("_rank", "allowed", "_h", "_p", "_before")


def algorithm_plan(rows: DataFrame, key: str, counts: dict[str, int], seed: int) -> DataFrame:
    """rows with an algorithm each: consecutive stretches of the seeded order, as long as counts say.

    A row's place is its rank within its hash prefix plus the sizes of the prefixes before it, so no
    window runs over all rows at once.
    """
    h = hash_order(F.col(key), seed)
    placed = rows.withColumn("_h", h).withColumn("_p", F.substring("_h", 1, 3))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))  # 4096 prefixes at most
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    placed = placed.join(F.broadcast(before), "_p").withColumn("_place", F.row_number().over(W.partitionBy("_p").orderBy("_h", key)) + F.col("_before"))
    at, out = 0, F.lit(None).cast("string")
    for name, n in counts.items():
        out = F.when((F.col("_place") > at) & (F.col("_place") <= at + n), name).otherwise(out)
        at += n
    return placed.withColumn("algorithm", out).filter("algorithm IS NOT NULL").drop("_h", "_p", "_before", "_place")


def byte_ranges(size: Column, mode: Column) -> Column:
    """array<struct<start,length>>: which byte ranges a plan covers. Nothing is read or written; this only describes."""
    header = F.least(size, F.when(size > BIG_FILE, F.lit(BIG_HEADER)).otherwise(F.lit(HEADER))).cast("long")

    def pair(start: Column, length: Column) -> Column:
        return F.struct(start.cast("long").alias("start"), length.cast("long").alias("length"))

    def steps(first: Column) -> Column:
        starts = F.when(size > first, F.sequence(first.cast("long"), size - 1, F.lit(STRIDE).cast("long"))).otherwise(F.array().cast("array<bigint>"))
        return F.transform(starts, lambda s: pair(s, F.least(F.lit(CHUNK).cast("long"), size - s)))

    head = F.when(size > 0, F.array(pair(F.lit(0), header))).otherwise(F.array().cast("array<struct<start:bigint,length:bigint>>"))
    full = F.when(size > 0, F.array(pair(F.lit(0), size))).otherwise(F.array().cast("array<struct<start:bigint,length:bigint>>"))
    hybrid = F.concat(head, steps(header))
    return (F.when(mode == "header-only", head).when(mode == "intermittent", steps(F.lit(STRIDE))).when(mode == "hybrid", hybrid)
            .when(mode == "adaptive", F.when(size <= SMALL_FILE, full).otherwise(hybrid)).when(mode == "full", full).otherwise(F.raise_error(F.lit("unknown mode"))))
