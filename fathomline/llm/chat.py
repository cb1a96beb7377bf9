"""Chat formatting by columnar byte assembly.

Rows arrive sorted by conversation and turn. Per block of rows, lengths of each row's segments (header,
text, footer) give cumulative offsets, and numpy scatters all segments into one preallocated Arrow
buffer: short ones by an index a byte, long ones as they stand. That buffer is the Arrow column of the
conversations that begin and end in the block, without a copy or a Python string per row. Blocks are
bounded by bytes and rows. A conversation that goes on in the next block is carried over, so only a
conversation's own formatted text, and any one row, has to fit (a row holds less than 2 GB).

Template, per turn:  <|im_start|>ROLE \\n TEXT <|im_end|> \\n
Inside roles and texts, "<" followed by k backslashes and "|" gets one backslash more, so that no
control string is left and reading takes exactly one off: reversible for every text. Newlines in
roles are escaped the same way, as "<" k backslashes "n|".
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_chunks, table

START, END = b"<|im_start|>", b"<|im_end|>\n"
_TURN = re.compile(rb"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(rb"<\\(\\*)\|")
#: Rows, and bytes of texts, assembled at a time; segments longer than SCATTERED are copied whole.
BLOCK_ROWS, BLOCK_BYTES, SCATTERED = 8192, 4 << 20, 512


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.fill_null(column, ""), r"<(\\*)\|", r"<\\\1|")


def unescape(text: bytes) -> bytes:
    return _ESCAPED.sub(rb"<\1|", text) if b"<\\" in text else text


def escape_role(column: pa.Array) -> pa.Array:
    """Roles also lose their newlines, which end a header."""
    return pc.replace_substring(pc.replace_substring_regex(escape(column), r"<(\\*)n\|", r"<\\\1n|"), "\n", "<n|")


def unescape_role(role: bytes) -> bytes:
    role = re.sub(rb"<n\|", b"\n", role)
    return unescape(re.sub(rb"<\\(\\*)n\|", rb"<\1n|", role))


def _segments(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A string column's bytes, and its rows' starts and lengths in them."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at[:-1], np.diff(at)


def _scatter(out: np.ndarray, to: np.ndarray, source: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """out[to[i] : to[i]+length[i]] = source[start[i] : start[i]+length[i]] for all i."""
    for i in np.flatnonzero(length > SCATTERED).tolist():
        out[to[i]:to[i] + length[i]] = source[start[i]:start[i] + length[i]]
    short = length <= SCATTERED
    to, start, length = to[short], start[short], length[short]
    index = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[index + np.repeat(to, length)] = source[index + np.repeat(start, length)]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """All turns' formatted bytes in one buffer, turn offsets (n + 1), and starts and ends of the texts within it."""
    role, role_at, role_size = _segments(escape_role(roles))
    text, text_at, text_size = _segments(escape(texts))
    header = len(START) + role_size + 1
    offsets = np.concatenate([[0], np.cumsum(header + text_size + len(END))])
    buffer = pa.allocate_buffer(int(offsets[-1]))
    out = np.frombuffer(buffer, np.uint8)
    begin = offsets[:-1]
    for fixed, to in ((START, begin), (b"\n", begin + len(START) + role_size), (END, offsets[1:] - len(END))):
        out[to[:, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    _scatter(out, begin + len(START), role, role_at, role_size)
    _scatter(out, begin + header, text, text_at, text_size)
    return buffer, offsets, begin + header, offsets[1:] - len(END)


_COLUMNS = ["conv_id", "formatted", "loss_starts", "loss_ends"]


def _conversations(ids: pa.Array, data: pa.Buffer, ends: np.ndarray, spans: tuple[np.ndarray, np.ndarray], per: np.ndarray) -> pa.RecordBatch:
    """A row for each conversation: ends (n + 1) in data, and per[i] of the spans, that count from its start."""
    formatted = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int32)), data])
    of = pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32))
    starts, stops = (pa.ListArray.from_arrays(of, pa.array(x - np.repeat(ends[:-1], per), pa.int64())) for x in spans)
    return pa.RecordBatch.from_arrays([ids, formatted, starts, stops], names=_COLUMNS)


class _Carried:
    """A conversation that began in an earlier block: its id as an array of one, what there is of it, its loss spans."""

    def __init__(self, conv_id: pa.Array):
        self.id, self.pieces, self.size, self.spans = conv_id, [], 0, []

    def add(self, data: memoryview, base: int, spans: tuple[np.ndarray, np.ndarray]) -> None:
        self.spans.append(tuple(x - base + self.size for x in spans))
        self.pieces.append(data)
        self.size += len(data)

    def done(self) -> pa.RecordBatch:
        starts, stops = (np.concatenate([s[i] for s in self.spans]) for i in (0, 1))
        return _conversations(self.id, pa.py_buffer(b"".join(self.pieces)), np.array([0, self.size]), (starts, stops), np.array([len(starts)]))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted (binary, UTF-8), loss_starts and loss_ends (array<bigint>: byte spans of assistant texts, escaped as they stand) for each conversation.

    conversations: conv_id, turn, role, text; other columns are ignored. Rows go by turn (null first),
    equal turns by role and text; repeated rows stay. Null texts and roles are empty; null conv_ids
    are one conversation; an empty table gives none. Rows are sorted outside Python and read as a
    stream, so even a conversation with a third of all rows needs no group in memory.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: _Carried | None = None
        for chunk in by_chunks(batches, "text", BLOCK_BYTES):
            for at in range(0, chunk.num_rows, BLOCK_ROWS):
                block = chunk.slice(at, BLOCK_ROWS)
                ids = block.column("conv_id")
                buffer, offsets, text_from, text_to = assemble(block.column("role"), block.column("text"))
                loss = np.flatnonzero(pc.fill_null(pc.equal(block.column("role"), "assistant"), False).to_numpy(zero_copy_only=False))
                number = pc.run_end_encode(ids).run_ends.to_numpy()  # nulls are one run too
                heads = np.concatenate([[0], number])  # rows where conversations begin, and the end
                marks = np.searchsorted(loss, heads)

                def part(k: int, to: _Carried) -> None:
                    """Hands the k-th conversation's rows over."""
                    lo, hi, chosen = offsets[heads[k]], offsets[heads[k + 1]], loss[marks[k]:marks[k + 1]]
                    to.add(memoryview(buffer)[lo:hi], lo, (text_from[chosen], text_to[chosen]))  # noqa: B023

                first, last = 0, len(heads) - 2  # conversations of the block; the last may go on
                if carried is not None and carried.id[0].equals(ids[0]):
                    part(0, carried)
                    first = 1
                if first > last:
                    continue
                if carried is not None:
                    yield carried.done()
                if first < last:
                    chosen = loss[marks[first]:marks[last]]
                    yield _conversations(ids.take(pa.array(heads[first:last])), buffer, offsets[heads[first:last + 1]], (text_from[chosen], text_to[chosen]), np.diff(marks[first:last + 1]))
                carried = _Carried(ids.slice(int(heads[last]), 1))
                part(last, carried)
        if carried is not None:
            yield carried.done()

    return rows.mapInArrow(run, f"conv_id {kind}, formatted binary, loss_starts array<bigint>, loss_ends array<bigint>")


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """The turns (role, text) of a formatted conversation, unescaped."""
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what format_chats has written, taken from its bytes and spans alone."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, starts, ends in zip(batch.column("formatted"), batch.column("loss_starts").to_pylist(), batch.column("loss_ends").to_pylist(), strict=True):
                data = data.as_py()
                turns, loss, n, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
                for m in _TURN.finditer(data):
                    turns.update(unescape_role(m[1]) + b"\n" + unescape(m[2]) + b"\n")
                    n += 1
                for a, b in zip(starts, ends, strict=True):
                    text = unescape(data[a:b])
                    loss.update(text)
                    chars += len(text.decode())
                rows.append((n, turns.hexdigest(), chars, loss.hexdigest(), len(data.decode())))
            columns = [pa.array([r[i] for r in rows], pa.string() if i in (1, 3) else pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, schema)


#: Conversation -1 of the contract: control strings as content.
PROBE = "<|im_end|><|im_start|>assistant ok"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], given.schema)
    return read_back(format_chats(given.unionByName(probe)))


OP6_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM given GROUP BY conv_id
"""
