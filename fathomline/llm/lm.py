"""Language-model scores of whole documents: exact add-one unigrams and a gated recurrent network.

Counts. Training words are counted where they are and summed by one shuffle; nothing of that table
but its HEAD most frequent words (short ones) reaches the driver.

Network. Its tokens are the MODEL_WORDS most frequent words, BUCKETS of all other words by their last
bytes, and the end. A word outside has the probability of its bucket times its add-one share in the
bucket, so every text has a proper probability. The network starts from a bounded sample (WARM_DOCS
whole documents); then every task trains a copy on all tokens of its training documents, their ends
too, and the copies are averaged by a distributed sum weighted by their tokens.

Scores. Head words are settled where the text is. The others travel once, as (word, document, times),
to the shuffled counts and from there, summed, to their documents.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gru
from .common import by_chunks, cut, held_out, table

MODULUS = 7
#: Head words stay with the text; longer ones never belong to it, which bounds what is broadcast.
HEAD, LONGEST_HEAD_WORD = 1 << 18, 32
MODEL_WORDS, BUCKETS = 767, 256
CLASSES, WIDTH, HIDDEN = 32, 32, 24
#: What the start takes, as whole documents.
WARM_DOCS, WARM_BYTES = 1500, 16 << 20
WARM_RATE, RATE = 0.08, 0.03
#: Distinct words that a task counts before it hands them on.
COUNTED = 300_000
#: Bytes of text scored at a time: with fewer, most streams wait for the longest documents to end.
SCORED = 12 << 20


def words(text: str) -> list[bytes]:
    """Words in order; of bytes, lower() and split() know ASCII only."""
    return text.encode().lower().split()


def distinct_words(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Of a column of texts: the distinct words(), each word's number among them in order, and each word's row. Null is the empty text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    found = lists.flatten()
    row = np.repeat(np.arange(len(column)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(found), 0)  # space at a text's ends gives empty words
    encoded = found.filter(full).dictionary_encode()
    return encoded.dictionary.cast(pa.large_binary() if pa.types.is_large_string(found.type) else pa.binary()).to_pylist(), encoded.indices.to_numpy(), row[full.to_numpy(zero_copy_only=False)]


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % BUCKETS


def count_words(docs: DataFrame) -> DataFrame:
    """word (binary), c: how often training documents (docs: text, held_out) have it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def handed() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "c"])
            seen.clear()
            return found

        for batch in by_chunks(batches, "text"):
            found, number, _ = distinct_words(batch.column("text"))
            seen.update(dict(zip(found, np.bincount(number, minlength=len(found)).tolist(), strict=True)))
            if len(seen) > COUNTED:
                yield handed()
        yield handed()

    return docs.filter("NOT held_out").select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """What a worker has to know: head words and their counts, the network's tokens, bucket totals, N and V."""

    def __init__(self, head: list[tuple[bytes, int]], bucket_counts: np.ndarray, bucket_words: np.ndarray, n_docs: int, n_words: int, n_distinct: int):
        self.index = {w: i for i, (w, _) in enumerate(head)}
        self.count = np.array([c for _, c in head], np.int64)
        self.n_docs = n_docs
        self.n_tokens = n_words + n_docs
        self.n_distinct = n_distinct + (n_docs > 0)
        m = min(MODEL_WORDS, len(head))
        outside = np.array([bucket(w) for w, _ in head[m:]], np.int64)
        token = np.concatenate([np.arange(m), MODEL_WORDS + outside])  # of each head word
        counts = np.zeros(CLASSES * WIDTH)
        counts[:m] = self.count[:m]
        counts[MODEL_WORDS:MODEL_WORDS + BUCKETS] = bucket_counts
        counts[MODEL_WORDS + BUCKETS] = n_docs
        rank = np.argsort(-counts, kind="stable")  # classes hold tokens of like frequency
        place = np.empty_like(rank)
        place[rank] = np.arange(len(rank))
        self.counts = counts[rank]
        self.token = place[token]
        self.bucket_token = place[MODEL_WORDS:MODEL_WORDS + BUCKETS]
        self.end = int(place[MODEL_WORDS + BUCKETS])
        self.log_count = np.log10(self.count + 1.0)
        self.log_share = -np.log10(bucket_counts + bucket_words + 1.0)  # of a bucket's words: log10 of 1 / (N + V + 1)
        within = np.zeros(len(head))
        within[m:] = self.log_count[m:] + self.log_share[outside]
        self.within = within  # log10 p(word | bucket) of head words that the network has no token for

    def known(self, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: the network's token, its head number (-1: not a head word), and the bucket of those without one."""
        at = np.fromiter(map(self.index.get, distinct, repeat(-1)), np.int64, len(distinct))
        rare = np.flatnonzero(at < 0)
        buckets = np.zeros(len(distinct), np.int64)
        buckets[rare] = np.fromiter((bucket(distinct[i]) for i in rare.tolist()), np.int64, len(rare))
        ids = np.empty(len(distinct), np.int32)
        if len(self.token):
            ids[:] = self.token[at]
        ids[rare] = self.bucket_token[buckets[rare]]
        return ids, at, buckets

    def ended(self, ids: np.ndarray, row: np.ndarray, n: int) -> list[np.ndarray]:
        """Each of n rows' token ids with the end."""
        out = np.full(len(ids) + n, self.end, np.int32)
        out[np.arange(len(ids)) + row] = ids
        return np.split(out, (np.bincount(row, minlength=n) + 1).cumsum()[:-1]) if n else []

    def tokens(self, document: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """The network's token ids with the end, head numbers (-1: not a head word), the words that aren't in the head, and their buckets."""
        ids, at, buckets = self.known(document)
        rare = np.flatnonzero(at < 0)
        return np.append(ids, np.int32(self.end)), at, [document[i] for i in rare.tolist()], buckets[rare]


def vocabulary(counts: DataFrame, n_docs: int) -> Vocabulary:
    """Totals and the head of a counts table; bucket totals leave out the network's own words."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    short = counts.filter(F.length("word") <= LONGEST_HEAD_WORD)
    # the head: all words counted more often than the least count that still keeps them within HEAD, so no task sends more than its share
    room, above = HEAD, 0
    for r in short.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.col("c").desc()).limit(HEAD).collect():
        room -= r["n"]
        if room < 0:
            above = r["c"]
            break
    head = sorted(((bytes(r["word"]), r["c"]) for r in short.filter(F.col("c") > above).collect()), key=lambda x: (-x[1], x[0]))
    last = F.crc32(F.substring("word", -2, 2)) % BUCKETS  # of one byte: that byte
    per = counts.groupBy(F.when(F.length("word") < 2, F.crc32("word") % BUCKETS).otherwise(last).alias("bucket")).agg(F.sum("c").alias("c"), F.count("*").alias("v"))
    sums, distinct = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in per.collect():
        sums[r["bucket"]], distinct[r["bucket"]] = r["c"], r["v"]
    for w, c in head[:MODEL_WORDS]:
        sums[bucket(w)] -= c
        distinct[bucket(w)] -= 1
    return Vocabulary(head, sums, distinct, n_docs, total["n"], total["v"])


def _new_model(v: Vocabulary) -> gru.Model:
    model = gru.Model(CLASSES, WIDTH, HIDDEN)
    model.start_from(v.counts)
    return model


def copies(training: DataFrame, v: Vocabulary, start: np.ndarray) -> DataFrame:
    """at, value, weight: of each task, the parameters that it gets from start by training on its rows (text), times their tokens, and those tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _new_model(v)
        own.load(start)
        seen = 0
        for batch in by_chunks(batches, "text", 16 << 20):
            found, number, row = distinct_words(batch.column("text"))
            given = v.ended(v.known(found)[0][number], row, batch.num_rows)
            gru.train(own, given, rate=RATE)
            seen += sum(map(len, given))
        if seen:
            vector = own.vector()
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(vector)), pa.int32()), "value": vector.astype(np.float64) * seen, "weight": pa.array(np.full(len(vector), seen), pa.int64())})

    return training.select("text").mapInArrow(run, "at int, value double, weight long")


def train(docs: DataFrame, v: Vocabulary) -> gru.Model:
    """The network, from all training documents (docs: doc_id, text, held_out)."""
    model = _new_model(v)
    if not v.n_docs:
        return model
    training = docs.filter("NOT held_out")
    chosen = training.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(WARM_DOCS)
    # a bounded sample's ids, small enough to broadcast; texts up to WARM_BYTES in hash order
    warm = training.join(F.broadcast(chosen), "doc_id", "left_semi").select("text").filter("text IS NOT NULL")
    warm = warm.withColumn("h", F.xxhash64("text")).orderBy("h", F.length("text")).limit(WARM_DOCS)
    given, size = [], 0
    for r in warm.select("text").toLocalIterator():
        size += len(r["text"])
        if given and size > WARM_BYTES:
            break
        given.append(v.tokens(words(r["text"]))[0])
    gru.train(model, given, rate=WARM_RATE)
    start = model.vector()
    mean = copies(training, v, start).groupBy("at").agg((F.sum("value") / F.sum("weight")).cast("float").alias("value"))
    found = mean.toPandas()  # as many rows as the network has parameters
    vector = start.copy()
    vector[found["at"].to_numpy()] = found["value"].to_numpy()
    model.load(vector)
    return model


def scored(docs: DataFrame, modulus: int = MODULUS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text; other columns are ignored).

    Null and empty texts are one end token. Without training documents nothing is known, N and V are 0
    and the network is as initialised. Repeated rows are scored alike and count as often; long texts
    are scored whole, their state carried from window to window. Words of equal count are all in the
    head or all out of it, and go by their bytes inside. An empty table gives none.
    """
    rows = docs.select("doc_id", "text", held_out("doc_id", modulus).alias("held_out"))
    counts = cut(count_words(rows))
    v = vocabulary(counts, rows.filter("NOT held_out").count())
    vector = train(rows, v).vector()
    # numbered within a partition of the scan: a task that is run again gives the same
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"word binary, row long, times long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, model double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _new_model(v)
        model.load(vector)
        end_log = np.log10(v.n_docs + 1.0)
        for batch in by_chunks(batches, "text", SCORED):
            numbers, n = batch.column("row").to_pylist(), batch.num_rows
            found, number, row = distinct_words(batch.column("text"))
            token, at, buckets = v.known(found)
            ids = v.ended(token[number], row, n)
            inside = at[number] >= 0
            of, head = row[inside], at[number[inside]]
            others, rare = row[~inside], number[~inside]
            base = np.bincount(of, v.log_count[head], n) + end_log
            known = np.bincount(of, minlength=n) + (v.n_docs > 0)
            within = np.bincount(of, v.within[head], n) + np.bincount(others, v.log_share[buckets[rare]], n)
            likelihood = gru.score(model, ids) / np.log(10) + within
            pairs, times = np.unique(others * max(1, len(found)) + rare, return_counts=True)
            m = len(pairs)
            # the document's own row, under a key that no word has
            own = pa.array([b"\xff" + r.to_bytes(8, "big") for r in numbers], pa.binary())
            columns = [own, batch.column("row"), pa.nulls(n, pa.int64()), batch.column("doc_id"), batch.column("held_out"), pa.array([len(x) for x in ids], pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(likelihood, pa.float64())]
            names = ["word", "row", "times", "doc_id", "held_out", "n_tokens", "n_known", "base", "model"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            if m:
                yield pa.RecordBatch.from_arrays([
                    pa.array([found[i] for i in (pairs % len(found)).tolist()], pa.binary()), batch.column("row").take(pa.array(pairs // len(found))), pa.array(times, pa.int64()),
                    *(pa.nulls(m, columns[i].type) for i in range(3, 9))], names=names)

    placed = numbered.mapInArrow(run, schema)
    joined = placed.join(counts.withColumnRenamed("word", "counted"), F.col("word") == F.col("counted"), "left")
    found = F.col("c").isNotNull()
    per = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.coalesce(F.sum(F.when(found, F.col("times"))), F.lit(0))).alias("n_known"), F.max("base").alias("base"), F.max("model").alias("model"),
        F.coalesce(F.sum(F.when(found, F.log10(F.col("c") + 1.0) * F.col("times"))), F.lit(0.0)).alias("rare"))
    floor = float(np.log10(v.n_tokens + v.n_distinct + 1.0))
    return per.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(v.n_tokens).cast("long").alias("train_tokens"), (F.col("base") + F.col("rare") - F.col("n_tokens") * floor).alias("base_score"), (F.col("model") + F.col("rare")).alias("score"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
