"""Byte statistics of file contents, one pass per file in Arrow batches.

A 256-bin histogram per file (numpy bincount) gives every measure, so no row per byte is ever made and
nothing is shuffled: cost is linear in bytes and a task holds a batch of contents at most.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

EDGE = 32 * 1024
FIELDS = ("size_bytes", "log_size", "entropy_global", "min_entropy_global", "entropy_head", "entropy_tail", "byte_chi2", "ic_index")


def entropy(counts: np.ndarray) -> float | None:
    n = counts.sum()
    if not n:
        return None
    p = counts[counts > 0] / n
    return float(-(p * np.log2(p)).sum()) + 0.0


def statistics(data: bytes) -> dict[str, float | int | None]:
    """All measures of one content; those of an empty one are null but for its size. Index of coincidence needs two bytes."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    out: dict[str, float | int | None] = dict.fromkeys(FIELDS) | {"size_bytes": n, "log_size": float(np.log10(n + 1))}
    if n:
        counts = np.bincount(raw, minlength=256).astype(np.float64)
        out["entropy_global"] = entropy(counts)
        out["min_entropy_global"] = float(-np.log2(counts.max() / n)) + 0.0
        out["entropy_head"], out["entropy_tail"] = (entropy(np.bincount(x, minlength=256)) for x in (raw[:EDGE], raw[-EDGE:]))
        expected = n / 256
        out["byte_chi2"] = float(((counts - expected) ** 2 / expected).sum())
        if n > 1:
            out["ic_index"] = float((counts * (counts - 1)).sum() / (n * (n - 1.0)))
    return out


def byte_statistics(files: DataFrame, key: str = "file_id") -> DataFrame:
    """key and FIELDS for each row of files (key, content); a null content counts as empty."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(x.as_buffer() if x.is_valid else b"") for x in batch.column("content")]
            columns = [pa.array([f[c] for f in found], pa.int64() if c == "size_bytes" else pa.float64()) for c in FIELDS]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], names=[key, *FIELDS])

    return files.select(key, "content").mapInArrow(run, f"{key} {kind}, size_bytes long, " + ", ".join(f"{c} double" for c in FIELDS[1:]))
