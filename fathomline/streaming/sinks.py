"""A latest-wins table that a stream upserts into.

Changes are appended as they come: batch N of a query is a folder of its own, written whole again if the
batch is, so a replayed batch changes nothing. Now and then the changes are folded: the latest row of
each key up to some batch becomes a snapshot, folded from the snapshot before and the batches since.
A snapshot counts when it is complete (Spark's _SUCCESS), readers take the newest one and the batches
after it, and folders that it makes useless go only afterwards; so an end at any moment loses nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fathomline.operators import profiles

BATCH, SNAPSHOT = "batch", "snapshot"


class UpsertTable:
    """The table at path, one row a key. version: columns whose largest values win within a batch; between batches the later one wins."""

    def __init__(self, spark: SparkSession, path: str, key: str, *version: str):
        self.spark, self.path, self.key, self.version = spark, path.rstrip("/"), key, version

    def _folders(self, kind: str) -> list[int]:
        """Numbers of the complete folders of a kind, in order; the file system is the path's own."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = (re.fullmatch(rf"{kind}-(\d+)", s.getPath().getName()) for s in fs.listStatus(root))
        return sorted(n for n in (int(m[1]) for m in found if m) if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}-{n}/_SUCCESS")))

    def _drop(self, kind: str, number: int) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}-{number}")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def write(self, rows: DataFrame, number: int) -> None:
        """Adds batch `number`, or writes it again. A batch that a snapshot has taken in already is left out: it was complete."""
        done = self._folders(SNAPSHOT)
        if not done or number > done[-1]:
            rows.write.mode("overwrite").parquet(f"{self.path}/{BATCH}-{number}")

    def _changes(self, after: int, to: int | None = None) -> DataFrame | None:
        """Rows of the batches (after, to], with their number."""
        parts = [self.spark.read.parquet(f"{self.path}/{BATCH}-{n}").withColumn("_batch", F.lit(n)) for n in self._folders(BATCH) if n > after and (to is None or n <= to)]
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p, allowMissingColumns=True)
        return out

    def read(self, to: int | None = None) -> DataFrame | None:
        """The latest row of each key, up to a batch if one is given; None before the first batch."""
        done = [n for n in self._folders(SNAPSHOT) if to is None or n <= to]
        changes = self._changes(done[-1] if done else -1, to)
        if done:
            base = self.spark.read.parquet(f"{self.path}/{SNAPSHOT}-{done[-1]}")
            changes = base.withColumn("_batch", F.lit(-1)) if changes is None else changes.unionByName(base.withColumn("_batch", F.lit(-1)), allowMissingColumns=True)
        return changes if changes is None else profiles.latest(changes, self.key, "_batch", *self.version).drop("_batch")

    def fold(self, every: int = 1) -> int | None:
        """Makes a snapshot up to the last batch if at least `every` batches have come since the last one, then drops what it has taken in. Returns its number."""
        done, batches = self._folders(SNAPSHOT), self._folders(BATCH)
        last = done[-1] if done else -1
        new = [n for n in batches if n > last]
        if len(new) < every or not new:
            return None
        self.read(new[-1]).write.mode("overwrite").parquet(f"{self.path}/{SNAPSHOT}-{new[-1]}")
        for n in batches:
            if n <= new[-1]:
                self._drop(BATCH, n)
        for n in done:
            self._drop(SNAPSHOT, n)
        return new[-1]

    def start(self, stream: DataFrame, checkpoint: str, fold_every: int = 20, **trigger) -> StreamingQuery:
        """Upserts the stream's rows; the checkpoint's batch numbers are the folders'."""

        def upsert(batch: DataFrame, number: int) -> None:
            self.write(batch, number)
            self.fold(fold_every)

        return stream.writeStream.outputMode("append").foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
