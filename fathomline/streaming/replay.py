"""Stored rows as a stream: cut into batches, each of which is one run of the query from its checkpoint."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fathomline.session import shared_folder
from fathomline.streaming.pipelines import ROCKSDB
from fathomline.streaming.sinks import UpsertTable


def by_time(rows: DataFrame, parts: int, us: str = "us") -> Column:
    """The number of the part, of so many of equal time, that a row's time is in: rows of one time are in one part."""
    first, last = rows.agg(F.min(us), F.max(us)).first()
    if first is None:
        return F.lit(0)
    return F.least(F.lit(parts - 1), F.floor((F.col(us) - F.lit(first)) * parts / F.lit(last - first + 1)).cast("int"))


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of the same application with the RocksDB state store and a state partition a core (a stream keeps the number that it starts with)."""
    own = spark.newSession()
    for k, v in (("spark.sql.streaming.stateStore.providerClass", ROCKSDB), ("spark.sql.shuffle.partitions", str(min(200, max(2, spark.sparkContext.defaultParallelism)))), ("spark.sql.session.timeZone", "UTC")):
        own.conf.set(k, v)
    return own


def _runs(rows: DataFrame, part: Column, parts: int, folder: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Each part of rows is written, read as a stream from there and worked off by one run of the query that start() starts."""
    own = stream_session(rows.sparkSession)
    numbered = rows.withColumn("_part", part)
    for k in range(parts):
        numbered.filter(F.col("_part") == k).drop("_part").write.mode("append").parquet(f"{folder}/in")
        start(own.readStream.schema(rows.schema).parquet(f"{folder}/in")).awaitTermination()


def replayed(rows: DataFrame, part: Column, parts: int, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All that build(stream) returns over the parts of rows, appended. Each part is one run of the query, which ends, and starts again from its checkpoint for the next."""
    folder = f"{shared_folder(rows.sparkSession)}/replay-{uuid.uuid4().hex}"
    schemas = []

    def start(stream: DataFrame) -> StreamingQuery:
        found = build(stream)
        schemas.append(found.schema)
        return found.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{folder}/out")

    _runs(rows, part, parts, folder, start)
    return rows.sparkSession.read.schema(schemas[0]).parquet(f"{folder}/out")


def upserted(rows: DataFrame, part: Column, parts: int, build: Callable[[DataFrame], DataFrame], key: str, *version: str, fold_every: int = 2) -> DataFrame:
    """The latest row of each key of what build(stream) returns over the parts of rows, from an UpsertTable."""
    folder = f"{shared_folder(rows.sparkSession)}/replay-{uuid.uuid4().hex}"
    # the batch function runs in the stream's session: rows are read back in the caller's
    _runs(rows, part, parts, folder, lambda stream: UpsertTable(stream.sparkSession, f"{folder}/table", key, *version).start(build(stream), f"{folder}/checkpoint", fold_every))
    return UpsertTable(rows.sparkSession, f"{folder}/table", key, *version).read()
