"""Document fingerprints by winnowing.

Rolling hashes of all k-grams of a text's bytes; in every window of WINDOW consecutive ones the
smallest is chosen, the rightmost of equals, and kept with its position. Two texts that share
WINDOW + GRAM - 1 bytes share a chosen hash, and its positions say where.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import rolling
from .common import cut, mix64, table

GRAM, WINDOW = 24, 16
#: A key is the hash's upper bits and, below them, a position counted backwards, so that of equal hashes the rightmost is smallest.
_PLACE_BITS = 24
_PLACES = np.uint64((1 << _PLACE_BITS) - 1)
#: Texts are hashed in blocks of so many bytes, overlapping by a window.
BLOCK = 1 << 21


def _chosen(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of a block's minima, in order of position."""
    n = len(block) - GRAM + 1
    prefix = rolling.Prefix(rolling.BYTE_VALUE[block])
    at = np.arange(n)
    key = (mix64(prefix.hashes(at, at + GRAM)) & ~_PLACES) | (_PLACES - at.astype(np.uint64))
    width, least = 1, key
    while 2 * width <= min(WINDOW, n):  # minima of windows of 2, 4, ...
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < min(WINDOW, n):
        gap = min(WINDOW, n) - width
        least = np.minimum(least[:-gap], least[gap:])
    kept = np.concatenate([[True], least[1:] != least[:-1]])
    least = least[kept]
    return least >> np.uint64(_PLACE_BITS), (_PLACES - (least & _PLACES)).astype(np.int64)


def fingerprint(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (40 bits) and byte positions of a text's chosen k-grams. A text shorter than a k-gram has one, of all its bytes; an empty one none."""
    if not data:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    raw = np.frombuffer(data, np.uint8)
    if len(raw) < GRAM:
        p = rolling.Prefix(rolling.BYTE_VALUE[raw])
        return mix64(p.hashes(np.array([0]), np.array([len(raw)]))) >> np.uint64(_PLACE_BITS), np.zeros(1, np.int64)
    if len(raw) <= BLOCK:
        return _chosen(raw)
    hashes, places, last = [], [], -1
    step = BLOCK - GRAM - WINDOW + 2  # as many windows as a block has
    for start in range(0, len(raw) - GRAM - WINDOW + 2, step):
        h, p = _chosen(raw[start:start + BLOCK])
        new = p + start > last  # chosen positions never go back
        hashes.append(h[new])
        places.append(p[new] + start)
        last = max(last, int(p[-1]) + start)
    return np.concatenate(hashes), np.concatenate(places)


def digest(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """All hashes and positions of a fingerprint in 32 hex digits."""
    return hashlib.blake2b(np.stack([print_[0], print_[1].astype(np.uint64)]).astype("<u8").tobytes(), digest_size=16).hexdigest()


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The share of both texts' distinct hashes that both have; 1 if neither has any."""
    x, y = np.unique(a[0]), np.unique(b[0])
    both = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - both
    return both / union if union else 1.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, hashes array<bigint>, positions array<bigint> (bytes) for each row of docs (doc_id, text; other columns are ignored). Null is the empty text: empty arrays; repeated rows give repeated rows, long texts are taken whole; an empty table gives none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [fingerprint((x or "").encode()) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "hashes": pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64())), "positions": pa.array([p for _, p in found], pa.list_(pa.int64()))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, hashes array<bigint>, positions array<bigint>")


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_fingerprints long"


class _Paired:
    """Collects result rows of documents and their successors."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, text: str, own, after: str, next_) -> None:
        n, half = len(text), len(text) // 2
        changed = (text[: n - half] + after[:half]).encode()
        new = own if changed == text.encode() else fingerprint(changed)
        self.rows.append((n, hashlib.sha256(changed).hexdigest(), digest(own), digest(new), likeness(own, new), likeness(own, next_), len(own[0])))

    def arrays(self) -> list[pa.Array]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        found = [pa.array([r[i] for r in self.rows], k) for i, k in enumerate(kinds)]
        self.rows = []
        return found


def _print(text: str):
    return fingerprint(text.encode())


def edited(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text; other columns are ignored) its fingerprint, its edited text's, and how alike they and the next document's are.

    The edited text has its last half replaced by as much of the next document's start. "Next" is by
    descending doc_id, rows of equal id by a hash of their texts, null ids last; after the last row
    comes the first, so a single row follows itself. Null texts are empty; an empty table gives none.

    One range shuffle puts neighbours together, and partitions are read in order, a document at a
    time. Only each partition's last document has its successor elsewhere: those rows are kept aside
    and joined with the next partition's first.
    """
    down = F.coalesce(-F.col("doc_id"), F.lit(2**63 - 1))
    text = F.coalesce("text", F.lit(""))
    placed = docs.select("doc_id", text.alias("text"), down.alias("down"), F.xxhash64(text).alias("tie"))
    placed = placed.repartitionByRange("down", "tie").sortWithinPartitions("down", "tie").select("doc_id", "text", F.spark_partition_id().cast("long").alias("part"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, rows, ids = None, _Paired(), []

        def sent(role: str, part: int, doc_ids: list, held: list, rows: _Paired) -> pa.RecordBatch:
            n = len(doc_ids)
            values = rows.arrays() if role == "whole" else [pa.nulls(n, t) for t in [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]]
            names = [x.split()[0] for x in _RESULT.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([role] * n), pa.array([part] * n, pa.int64()), pa.array(doc_ids, id_type), pa.array(held, pa.string()), *values], names=["role", "part", "doc_id", "text", *names])

        for batch in batches:
            id_type, part = batch.column("doc_id").type, batch.column("part")[0].as_py()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = _print(text)
                if before is None:
                    yield sent("first", part, [doc_id], [text], rows)
                else:
                    rows.add(before[1], before[2], text, own)
                    ids.append(before[0])
                before = (doc_id, text, own)
                if len(ids) >= 4096:
                    yield sent("whole", part, ids, [None] * len(ids), rows)
                    ids = []
        if before is not None:
            if ids:
                yield sent("whole", part, ids, [None] * len(ids), rows)
            yield sent("last", part, [before[0]], [before[1]], rows)

    found = cut(placed.mapInArrow(run, f"role string, part long, doc_id {kind}, text string, {_RESULT}"))
    results = [x.split()[0] for x in _RESULT.split(", ")]
    # One row per partition, without texts: which partition follows which.
    parts = found.filter("role = 'first'").select("part")
    order = W.orderBy("part")
    follows = parts.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(W.partitionBy())).alias("next"))
    starts = found.filter("role = 'first'").select(F.col("part").alias("next"), F.col("text").alias("after"))
    ends = found.filter("role = 'last'").select("doc_id", "text", "part").join(follows, "part").join(starts, "next")

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _Paired()
            for text, after in zip(batch.column("text").to_pylist(), batch.column("after").to_pylist(), strict=True):
                rows.add(text, _print(text), after, _print(after))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *rows.arrays()], names=["doc_id", *results])

    rest = ends.select("doc_id", "text", "after").mapInArrow(finish, f"doc_id {kind}, {_RESULT}")
    return found.filter("role = 'whole'").select("doc_id", *results).unionByName(rest)


def op10_winnow_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(table(spark, sf_dir, "documents"))
