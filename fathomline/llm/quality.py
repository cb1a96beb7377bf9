"""Quality rules by repetition coverage.

Per text, rolling hashes of word n-grams of several lengths find the n-grams that occur twice or
more; what counts is the share of the words' characters inside them, and inside repeated lines.
Texts are handled many at a time, in blocks of BLOCK bytes (a longer text is a block of its own, and
takes some 30 bytes of memory a byte), whatever the size of a partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import rolling
from .common import by_chunks, mix64, released, table, texts

#: n-gram lengths and the largest share of a text's word characters that repeated ones may cover.
COVERAGE = {2: 0.60, 3: 0.50, 5: 0.40, 8: 0.35, 10: 0.30}
#: Fewer words than this in repeated n-grams of LONG words or more are no fault: one phrase said twice in a short clean text.
LONG, LEAST_REPEATED = 5, 30
#: The same for lines that equal an earlier one, and symbols a word.
LINE_COVERAGE = 0.30
SYMBOLS_PER_WORD = 0.3
SYMBOLS = b"#*$%&|<>"
WHITE = " \t\n\v\f\r"
BLOCK = 1 << 20
BASE_WINDOW, LEAST_WORDS, REPEAT_SHARE = 3, 50, 50
_WORD_BASE = 0x9FB21C651E98DF25

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_share double, " + ", ".join(f"dup_{n}gram_share double" for n in COVERAGE)


def repeated_lines(text: str) -> tuple[int, int, int]:
    """How many lines with a word equal an earlier one, their characters, and those of all lines with a word."""
    seen: set[str] = set()
    n = repeated = total = 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            total += len(line)
            if line in seen:
                n, repeated = n + 1, repeated + len(line)
            else:
                seen.add(line)
    return n, repeated, total


def measure(batch_texts: list[str]) -> dict[str, np.ndarray]:
    """The columns of SCHEMA for a list of texts.

    Words are runs of anything but ASCII white space; lines are split at newlines, compared as they
    are, and count only if they have a word. A text without words has zeros everywhere and fails.
    """
    t = rolling.Texts(batch_texts)
    length = t.word_points()
    n_words = np.bincount(t.word_text, minlength=t.n).astype(np.int64)
    chars = np.bincount(t.word_text, weights=length, minlength=t.n).astype(np.int64)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    n_symbols = t.per_text(symbol[t.bytes])

    salt = mix64(np.arange(1, t.n + 1, dtype=np.uint64))
    words = rolling.Prefix(mix64(t.word_hashes()), _WORD_BASE)
    total = len(t.word_start)

    def covered(n: int) -> np.ndarray:
        """Which words are inside an n-gram that their text has twice or more."""
        if total < n:
            return np.zeros(total, bool)
        at = np.flatnonzero(t.word_text[n - 1:] == t.word_text[:total - n + 1])
        seen = rolling.repeated(mix64(words.hashes(at, at + n) ^ salt[t.word_text[at]]))
        starts = np.zeros(total + 1, np.int64)
        starts[at[seen] + 1] = 1
        starts = np.cumsum(starts)  # repeated windows that start before each word
        i = np.arange(1, total + 1)
        return starts[i] > starts[np.maximum(i - n, 0)]

    lines = np.array([repeated_lines(x) for x in batch_texts], np.int64).reshape(-1, 3)
    share, few = {}, {}
    for n in COVERAGE:
        inside = covered(n)
        share[n] = np.bincount(t.word_text[inside], weights=length[inside], minlength=t.n) / np.maximum(chars, 1)
        repeats = np.bincount(t.word_text[inside], minlength=t.n).astype(np.int64)
        few[n] = (n >= LONG) & (repeats < LEAST_REPEATED)
        if n == BASE_WINDOW:
            n_repeat = repeats
    n_dup_lines, line_share = lines[:, 0], lines[:, 1] / np.maximum(lines[:, 2], 1)

    failed = (n_words < LEAST_WORDS) | (100 * n_repeat > REPEAT_SHARE * n_words)
    kept = ~failed & (line_share <= LINE_COVERAGE) & (n_symbols <= SYMBOLS_PER_WORD * n_words)
    for n, most in COVERAGE.items():
        kept &= (share[n] <= most) | few[n]
    return {"n_words": n_words, "word_chars": chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat, "base_failed": failed, "kept": kept, "dup_line_share": line_share} | {f"dup_{n}gram_share": share[n] for n in COVERAGE}


def quality(docs: DataFrame) -> DataFrame:
    """doc_id and the columns of SCHEMA for each row of docs (doc_id, text; other columns are ignored).

    Null and empty texts have no words and fail; repeated rows give repeated rows; an empty table
    gives none.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_chunks(batches, "text", BLOCK):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {k: pa.array(v) for k, v in measure(texts(batch, "text")).items()})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def kept(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, as they are, all their columns too.

    Null and empty texts have no words and go; repeated rows stay or go together; long texts are looked
    at whole; an empty table gives none.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_chunks(batches, "text", BLOCK):
            yield batch.filter(pa.array(measure(texts(batch, "text"))["kept"]))

    return docs.mapInArrow(lambda x: released(run(x)), docs.schema)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
