"""Byte-level BPE encoding and decoding with recursive DuckDB queries, partition by partition.

Encoding splits texts by the vocabulary's pattern; the distinct pieces of a block of texts become
token-position rows. A recursive query joins neighbouring tokens with the merge table, contracts each
piece's leftmost pair of minimum rank, and stops where no piece has a pair left.

The query's first SELECT reads a row a byte, joins each two neighbours with what the vocabulary says of
such two, and contracts those that are sure. A pair of rank r is sure if all tokens that
end with the byte before it make tokens above r, or none, with its first byte, those that begin with the
byte after it do so with its second, and the pair's own token is part of tokens above r only. So nothing
touches the pair until r, when it is contracted, and its token made early takes part in nothing before r.
This holds for any vocabulary, and sure pairs never overlap.

Contracting takes as many steps as a piece has merges, so pieces longer than SHORT bytes are cut, the parts
encoded by that query side by side, and neighbours joined level by level: the tokens around a cut are
encoded anew as a piece of their own, and of more and more tokens until the outermost ones come out
as they were. This is exact where every token's own bytes encode to it (so for every trained
vocabulary; sound() looks): then tokens are the encoding of their bytes if and only if each two
neighbours are the encoding of theirs, and all neighbours are seen to be. It also means that a merge
never makes a pair of lower rank than its own (what lies between two ends that nothing has crossed is
contracted as if it stood alone, and a token of lower rank would have been made by then); so around
cuts that need many tokens, as in long runs, all separate occurrences of the minimum pair contract in
a step. Other vocabularies get the leftmost rule for pieces of any length.

Decoding joins ids with the vocabulary in order of position; a text's bytes are its stretch of that column.

What a task has found out about a piece it remembers, up to a bound, so text is whole but work isn't
repeated. DuckDB runs inside the worker on one thread, in memory, on blocks of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import by_chunks, give_back, table, texts

SHORT = 40
#: Pieces and bytes per recursive query, tokens per decoding query, pieces remembered.
QUERY_PIECES, QUERY_BYTES, DECODE_TOKENS, REMEMBERED = 60_000, 1 << 18, 1 << 18, 200_000

#: Where a recursive query begins: the rows of positions, a byte's token each, joined with what the vocabulary says of it and the next one, sure pairs contracted.
_START = """
  SELECT piece, pos, CASE WHEN taken THEN sure ELSE id END, false
  FROM (SELECT *, lag(taken) OVER w AS gone
        FROM (SELECT piece, pos, id, sure, sure IS NOT NULL AND coalesce(sure < lag(before) OVER w, true) AND coalesce(sure < lead(after) OVER w, true) AS taken
              FROM (SELECT piece, pos, id, CASE WHEN lead(piece) OVER w = piece THEN lead(id) OVER w END AS next FROM positions WINDOW w AS (ORDER BY pos)) p
              LEFT JOIN pairs_of_bytes v ON v.a = p.id AND v.b = p.next
              WINDOW w AS (ORDER BY pos))
        WINDOW w AS (ORDER BY pos))
  WHERE gone IS NOT TRUE
"""

_LEFTMOST = f"""
WITH RECURSIVE step(piece, pos, id, done) AS ({_START}
  UNION ALL
  (WITH pairs AS MATERIALIZED (
     SELECT n.piece, n.pos, n.id, n.next_pos, m.rank, m.rank::BIGINT * 2147483648 + n.pos AS pair
     FROM (SELECT piece, pos, id, CASE WHEN lead(piece) OVER w = piece THEN lead(id) OVER w END AS after, lead(pos) OVER w AS next_pos
           FROM step WHERE NOT done WINDOW w AS (ORDER BY pos)) n
     LEFT JOIN merges m ON m.a = n.id AND m.b = n.after),
   least AS (SELECT piece, min(pair) AS best, arg_min(next_pos, pair) AS gone FROM pairs WHERE pair IS NOT NULL GROUP BY piece)
   SELECT p.piece, p.pos, CASE WHEN p.pair = l.best THEN p.rank ELSE p.id END, l.best IS NULL
   FROM pairs p LEFT JOIN least l ON l.piece = p.piece
   WHERE l.gone IS NULL OR p.pos <> l.gone))
SELECT piece, id FROM step WHERE done ORDER BY pos
"""

#: The same, but every second of each run of neighbouring occurrences of the minimum pair is contracted with its successor.
_EVERYWHERE = f"""
WITH RECURSIVE step(piece, pos, id, done) AS ({_START}
  UNION ALL
  SELECT piece, pos, CASE WHEN taken THEN rank ELSE id END, best IS NULL
  FROM (SELECT *, coalesce(lag(taken) OVER (PARTITION BY piece ORDER BY place), false) AS gone
        FROM (SELECT *, coalesce(rank = best AND (place - max(CASE WHEN rank IS DISTINCT FROM best THEN place ELSE 0 END) OVER (PARTITION BY piece ORDER BY place)) % 2 = 1, false) AS taken
              FROM (SELECT *, min(rank) OVER (PARTITION BY piece) AS best
                    FROM (SELECT n.piece, n.pos, n.id, n.place, m.rank
                          FROM (SELECT piece, pos, id, lead(id) OVER w AS after, row_number() OVER w AS place FROM step WHERE NOT done WINDOW w AS (PARTITION BY piece ORDER BY pos)) n
                          LEFT JOIN merges m ON m.a = n.id AND m.b = n.after))))
  WHERE NOT gone)
SELECT piece, id FROM step WHERE done ORDER BY pos
"""

_DECODE = "SELECT bytes FROM ids JOIN vocabulary USING (id) ORDER BY pos"

#: Above every rank.
NONE = np.iinfo(np.int32).max

#: What sound() has found, by the vocabulary's path.
_sound: dict[str, bool] = {}


class Coder:
    """One vocabulary in one DuckDB connection."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.name = ranks_path
        self.bytes_of: dict[int, bytes] = {}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bytes_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})
        self.db.execute("SET preserve_insertion_order = false")
        rows = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        a, b, r = (pa.array(x, pa.int32()) for x in zip(*rows, strict=True))
        merges = pa.table({"a": a, "b": b, "rank": r})  # noqa: F841  DuckDB reads these by name
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        vocabulary = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "bytes": pa.array(list(self.ranks), pa.binary())})  # noqa: F841
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")
        part = np.full(max(self.ranks.values()) + 1, NONE, np.int32)  # the least rank that a token is part of
        np.minimum.at(part, a.to_numpy(), r.to_numpy())
        np.minimum.at(part, b.to_numpy(), r.to_numpy())
        # by two bytes: their rank where it may be sure, and the least rank that the second has with a token ending in the first, the first with one beginning with the second
        sure, before, after = (np.full(1 << 16, NONE, np.int32) for _ in range(3))
        for t, i in self.ranks.items():
            if len(t) == 2 and part[i] > i:
                sure[t[0] << 8 | t[1]] = i
            if len(t) > 1 and t[:-1] in self.ranks:
                k = t[-2] << 8 | t[-1]
                before[k] = min(i, before[k])
            if len(t) > 1 and t[1:] in self.ranks:
                k = t[0] << 8 | t[1]
                after[k] = min(i, after[k])
        k = np.flatnonzero(np.minimum(np.minimum(sure, before), after) < NONE)
        pairs = pa.table({"a": self.bytes_id[k >> 8], "b": self.bytes_id[k & 255]} | {n: pa.array(x[k], mask=x[k] == NONE) for n, x in (("sure", sure), ("before", before), ("after", after))})  # noqa: F841
        self.db.execute("CREATE TABLE pairs_of_bytes AS SELECT * FROM pairs")

    def positions(self, data: list[bytes]) -> pa.Table:
        """The tokens of the pieces' bytes one after the other: piece, pos, id."""
        raw = np.frombuffer(b"".join(data), np.uint8)
        piece = np.repeat(np.arange(len(data), dtype=np.int32), np.fromiter(map(len, data), np.int64, len(data)))
        return pa.table({"piece": piece, "pos": np.arange(len(raw), dtype=np.int32), "id": self.bytes_id[raw]})

    def _query(self, data: list[bytes], sql: str) -> list[bytes]:
        positions = self.positions(data)  # noqa: F841
        found = self.db.execute(sql).fetchnumpy()
        ids = found["id"].astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(found["piece"], minlength=len(data))) * 4).tolist()
        return [ids[at:end] for at, end in zip([0, *ends], ends, strict=False)]

    def contracted(self, data: list[bytes], sql: str) -> list[bytes]:
        """The ids of each piece's bytes, by queries of bounded size (a piece larger than that has one of its own)."""
        out, at = [], 0
        while at < len(data):
            end, size = at, 0
            while end < len(data) and end - at < QUERY_PIECES and (end == at or size + len(data[end]) <= QUERY_BYTES):
                size += len(data[end])
                end += 1
            out += self._query(data[at:end], sql)
            at = end
        return out

    def sound(self) -> bool:
        """Whether the bytes of every token encode to it."""
        if self.name not in _sound:
            many = list(self.ranks)
            _sound[self.name] = self.contracted(many, _LEFTMOST) == [self.ranks[x].to_bytes(4, "little") for x in many]
        return _sound[self.name]

    def long(self, data: bytes) -> bytes:
        """The ids of a piece of any length."""
        if not self.sound():
            return self.contracted([data], _LEFTMOST)[0]
        parts = [np.frombuffer(x, "<u4") for x in self.contracted([data[i:i + SHORT] for i in range(0, len(data), SHORT)], _LEFTMOST)]
        if not self.bytes_of:
            self.bytes_of = {i: t for t, i in self.ranks.items()}
        while len(parts) > 1:
            joined = parts[::2]
            open_, k = range(len(parts) // 2), 4
            while open_:
                around = [b"".join(map(self.bytes_of.__getitem__, [*parts[2 * i][-k:].tolist(), *parts[2 * i + 1][:k].tolist()])) for i in open_]
                few, many = [x for x in around if len(x) <= 4 * SHORT], [x for x in around if len(x) > 4 * SHORT]
                found = iter(self.contracted(few, _LEFTMOST)), iter(self.contracted(many, _EVERYWHERE))
                again = []
                for i, x in zip(open_, around, strict=True):
                    new, a, b = np.frombuffer(next(found[len(x) > 4 * SHORT]), "<u4"), parts[2 * i], parts[2 * i + 1]
                    if (k >= len(a) or new[0] == a[-k]) and (k >= len(b) or new[-1] == b[k - 1]):
                        joined[i] = np.concatenate([a[:-k], new, b[k:]])
                    else:
                        again.append(i)
                open_, k = again, 4 * k
            parts = joined
        return parts[0].tobytes()

    def learn(self, pieces: Iterable[str]) -> None:
        """Encodes the pieces that aren't known yet."""
        short: dict[str, bytes] = {}
        for p in pieces:
            data = p.encode()
            if (whole := self.ranks.get(data)) is not None:
                self.known[p] = whole.to_bytes(4, "little")
            elif len(data) <= SHORT:
                short[p] = data
            else:
                self.known[p] = self.long(data)
        self.known.update(zip(short, self.contracted(list(short.values()), _LEFTMOST), strict=True))

    def encode(self, batch: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        split = [self.split(x) for x in batch]
        if len(self.known) > REMEMBERED:  # what isn't met again until the next time is forgotten
            self.known, self.older = {}, self.known
        missing = set().union(*split) - self.known.keys()
        met = missing & self.older.keys()
        self.known.update((p, self.older[p]) for p in met)
        self.learn(missing - met)
        known = self.known.__getitem__
        return [b"".join(map(known, x)) for x in split]

    def decode(self, batch: list[bytes]) -> list[bytes]:
        """The bytes that each list of ids stands for."""
        out = [b""] * len(batch)
        flat = np.frombuffer(b"".join(batch), "<u4").astype(np.int32)
        start = np.cumsum([0] + [len(x) // 4 for x in batch])
        for lo in range(0, len(flat), DECODE_TOKENS):  # a text may come in parts
            part = flat[lo:lo + DECODE_TOKENS]
            ids = pa.table({"pos": np.arange(len(part), dtype=np.int32), "id": part})  # noqa: F841
            column = self.db.sql(_DECODE).to_arrow_table().column("bytes").combine_chunks()
            first, last = np.searchsorted(start, lo, "right") - 1, np.searchsorted(start, lo + len(part))
            bounds = np.clip(start[first:last + 1] - lo, 0, len(part)).astype(np.int32)
            for k, x in enumerate(pc.binary_join(pa.ListArray.from_arrays(bounds, column), pa.scalar(b"", column.type)).to_pylist(), first):
                out[k] += x
        return out


_coders: dict[tuple[str, str], Coder] = {}
BLOCK = 2 << 20


def coder(ranks_path: str, pattern: str) -> Coder:
    """The task's coder for a vocabulary, made once."""
    if (ranks_path, pattern) not in _coders:
        _coders[ranks_path, pattern] = Coder(ranks_path, pattern)
    return _coders[ranks_path, pattern]


def _released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Workers outlive tasks: what a task has built is given back when it ends."""
    try:
        yield from batches
    finally:
        for c in _coders.values():
            c.db.close()
        _coders.clear()
        give_back()


def encoded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers) for each row of docs (doc_id, text; other columns are ignored). Null texts are empty: no ids; repeated rows stay; an empty table gives none. ranks_path is read on every worker."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_chunks(batches, "text", BLOCK):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": pa.array(coder(ranks_path, pattern).encode(texts(batch, "text")), pa.binary())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda x: _released(run(x)), f"doc_id {kind}, ids binary")


def decoded(ids: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, bytes (binary) for each row of ids (doc_id, ids as encoded() has them); a null ids column is empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_chunks(batches, "ids", BLOCK):
            given = [x or b"" for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "bytes": pa.array(coder(ranks_path, pattern).decode(given), pa.binary())})

    kind = ids.schema["doc_id"].dataType.simpleString()
    return ids.select("doc_id", "ids").mapInArrow(lambda x: _released(run(x)), f"doc_id {kind}, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, where asked for, the ids themselves (as encoded() has them): encodes, then decodes those ids, in one pass over docs (doc_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_chunks(batches, "text", BLOCK):
            c = coder(ranks_path, pattern)
            ids = c.encode(texts(batch, "text"))
            back = c.decode(ids)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in back]} | ({"ids": pa.array(ids, pa.binary())} if with_ids else {}))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda x: _released(run(x)), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)


def op9_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
