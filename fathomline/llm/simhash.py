"""SimHash near-duplicates by pigeonring filtering.

Fingerprints that differ in at most 2 of 64 bits are cut into a ring of 5 segments. By the pigeonring
principle some segment starts a chain whose cumulative differences over l segments stay within
l * 2 / 5 for every l: the first two segments must be equal, three or four may differ in one bit.
So candidates share two neighbouring segments (about 26 bits); the longer chains prune them before
the full comparison. Only distinct fingerprints take part, so copies cost nothing.

A value of two segments that more than HOT_MEMBERS fingerprints share is not paired: there, each
fingerprint emits itself and its 64 one-bit neighbours. Two fingerprints differ in at most 2 bits
exactly if they share such a neighbour, those that share one all do, and a neighbour has at most 65,
so linking them to their smallest loses no link and never lists a group's pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_chunks, cut, small_side, table, texts
from .components import components

SEED, SHINGLE, DISTANCE = 42, 3, 2
#: The ring: widths of consecutive segments, lowest bits first.
RING = (13, 13, 13, 13, 12)
HOT_MEMBERS = 48
COUNT_BLOCK = 1 << 16


def fingerprint(text: str) -> int:
    """The contract's fingerprint as a signed 64-bit number: bit k is set if over half the shingles' hashes have it."""
    words = text.encode().lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        end = np.cumsum(size) - 1
        start = (end - size + 1)[: len(words) - SHINGLE + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(start, end[SHINGLE - 1:].tolist(), strict=True)]
    values = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), COUNT_BLOCK):
        block = values[at:at + COUNT_BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values)).view(">i8")[0])


def fingerprints(docs: DataFrame, column: str = "fingerprint") -> DataFrame:
    """docs and a bigint column with each text's fingerprint (null and empty texts: 0)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_chunks(batches, "text", 16 << 20):
            values = pa.array([fingerprint(x) for x in texts(batch, "text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.LongType())]))


def _mask(ring: tuple[int, ...], segments: Iterable[int]) -> int:
    value = sum(((1 << ring[i]) - 1) << sum(ring[:i]) for i in segments)
    return value - (1 << 64) if value >> 63 else value


def chain(ring: tuple[int, ...], first: int, length: int) -> int:
    """The bits of so many consecutive segments from one on, around the ring."""
    return _mask(ring, ((first + k) % len(ring) for k in range(length)))


def within(differ: Column, ring: tuple[int, ...], distance: int, first: int, least: int = 1) -> Column:
    """Whether chains from a segment on keep their budgets, shortest first; the last is the full comparison. differ: two fingerprints' differing bits; chains shorter than least are known to."""
    found = F.lit(True)
    for n in range(least, len(ring) + 1):
        found = found & (F.bit_count(differ.bitwiseAND(F.lit(chain(ring, first, n)))) <= n * distance // len(ring))
    return found


def links(prints: DataFrame) -> DataFrame:
    """prints(fp) distinct bigints -> (a, b): links whose components are those of all pairs within DISTANCE."""
    m = len(RING)
    equal = next(n for n in range(1, m + 1) if (n + 1) * DISTANCE // m > 0)  # segments whose budget is 0
    rotations = F.explode(F.array(*(F.struct(F.lit(i).alias("turn"), F.col("fp").bitwiseAND(F.lit(chain(RING, i, equal))).alias("part")) for i in range(m))))
    placed = cut(prints.select("fp", rotations.alias("r")).select("fp", "r.turn", "r.part"))
    crowd = placed.groupBy("turn", "part").agg(F.count("*").alias("members")).filter("members > 1")
    placed = cut(placed.join(crowd, ["turn", "part"]))

    few = placed.filter(F.col("members") <= HOT_MEMBERS)
    a, b = few.alias("a"), few.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))

    viable = F.lit(False)
    for i in range(m):
        viable = viable | ((F.col("a.turn") == i) & within(differ, RING, DISTANCE, i, equal + 1))
    pairs = a.join(b, (F.col("a.turn") == F.col("b.turn")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.fp") < F.col("b.fp")) & viable)
    pairs = pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    many = placed.filter(F.col("members") > HOT_MEMBERS).select("fp").distinct()
    near = F.explode(F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)))))
    hubs = many.select("fp", near.alias("hub")).groupBy("hub").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = hubs.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(prints: DataFrame) -> DataFrame:
    """prints(doc_id, fingerprint) -> a row per distinct fingerprint: fp, component_id, the smallest doc_id in its component (null only if all are null), and head, whether fp is the smallest fingerprint in the component that this doc_id has."""
    own = cut(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("doc")))
    linked = cut(components(links(own.select("fp"))))
    labelled = own.join(linked, own.fp == linked.node, "left").select("fp", "doc", F.coalesce("label", "fp").alias("label"))
    heads = labelled.groupBy("label").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "fp")).alias("h"))
    heads = heads.select("label", F.col("h.doc").alias("component_id"), F.col("h.fp").alias("head_fp"))
    return cut(cut(labelled).join(small_side(cut(heads)), "label").select("fp", "component_id", (F.col("fp") == F.col("head_fp")).alias("head")))


def simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs (doc_id, text; other columns are ignored).

    Texts without words have fingerprint zero and are linked like any other; repeated rows and copies
    share a component; an empty table gives none.
    """
    prints = cut(fingerprints(docs.select("doc_id", "text")).select("doc_id", "fingerprint"))
    found = near_duplicates(prints)
    joined = prints.join(found, prints.fingerprint == found.fp)
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stand for their component of op5's links: its smallest doc_id, once.

    Texts without words are one component, or linked like any other; rows of equal doc_id and
    fingerprint are one; null ids stand only for components that have no others; other columns stay
    as they are; an empty table gives none. near_copies.one_of_each takes likeness of 0.8 instead.
    """
    named = docs.columns
    carried = fingerprints(docs, "__fingerprint")
    found = near_duplicates(cut(carried.select("doc_id", F.col("__fingerprint").alias("fingerprint"))))
    heads = found.filter("head").select(F.col("fp").alias("__fp"), F.col("component_id").alias("__head"))
    stay = carried.join(heads, (F.col("__fingerprint") == F.col("__fp")) & F.col("doc_id").eqNullSafe(F.col("__head")), "left_semi")
    return stay.dropDuplicates(["__fingerprint", "doc_id"]).select(*named)


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash(table(spark, sf_dir, "documents"))
