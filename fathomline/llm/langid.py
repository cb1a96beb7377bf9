"""Language ID by unigram piece models whose segmentations are summed over.

Pieces are the tokens of a fixed public byte-level vocabulary; every language has its own probabilities
of them. A text's units are its runs of letters in lower case, each after a space. A unit's probability
in a language is the sum over all its segmentations into pieces of the product of the pieces'
probabilities, which the forward algorithm gives in one pass over its bytes; a text's is the product of
its units', and the prediction is the language of the highest posterior.

Probabilities are learned by expectation maximisation: each task runs forward and backward over the
distinct units of its training documents and emits expected piece counts by language, which are summed
over tasks. No text is shuffled; what reaches the driver is a number for each piece and language.
Counts leave tasks as integers, so sums don't depend on their order.
"""

from __future__ import annotations

import base64
import functools
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import count, groupby
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_chunks, held_out, released, table, texts

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Letters of a unit: longer runs of letters are several units. So a unit has at most 1 + 4 * LETTERS bytes.
LETTERS = 12
ROUNDS = 2
#: The share of a piece's probability in a language that comes from its share in all languages: what so many pieces would have beside the language's own, but LEAST_SHARE at least. UNIFORM of that is dealt evenly.
BACKGROUND, LEAST_SHARE, UNIFORM = 200.0, 1e-3, 0.05
#: A unit's probability is held times this for each byte. With the shares above no unit's number gets out of a double's range, however much is learned from.
PER_BYTE = 4096.0
#: Bytes of text handled at a time, numbers of a forward pass held at a time, distinct units remembered.
BLOCK, CELLS, REMEMBERED = 4 << 20, 1 << 20, 300_000
#: Integer steps of an expected count.
STEPS = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


@functools.cache
def unit_pattern(last: int) -> re.Pattern[str]:
    """A letter and up to LETTERS - 1 letters or marks after it, as Unicode has them, for text without characters beyond last. Classes of few and low characters are the faster ones."""

    def ranges(kinds: str) -> str:
        runs = groupby((c for c in range(last + 1) if unicodedata.category(chr(c))[0] in kinds), key=lambda c, n=count(): c - next(n))
        ends = [(x[0], x[-1]) for x in map(list, (r for _, r in runs))]
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ends)

    return re.compile(f"[{ranges('L')}][{ranges('LM')}]{{0,{LETTERS - 1}}}")


def units(text: str) -> list[str]:
    text = text.lower()
    last = 0x7F if text.isascii() else 0xFFFF if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else sys.maxunicode
    return unit_pattern(last).findall(text)


class Known(dict):
    """Numbers units as they are met."""

    def __init__(self) -> None:
        super().__init__()
        self.names: list[str] = []

    def __missing__(self, unit: str) -> int:
        self.names.append(unit)
        self[unit] = n = len(self)
        return n

    def of(self, many: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, many), np.int64, len(many))


class Pieces:
    """The vocabulary's pieces by a hash of their bytes, as far as a unit can hold them."""

    BITS = 18
    MASK = np.uint64((1 << BITS) - 1)

    def __init__(self, tokens: list[bytes]):
        self.tokens = [t for t in tokens if len(t) <= 1 + 4 * LETTERS]
        self.longest = max(map(len, self.tokens))
        keys = np.array([self._key(t) for t in self.tokens], np.uint64)
        # tables by some of a key's bits; keys that meet another one in a table are in the next
        self.tables: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []
        left = np.arange(len(keys))
        while len(left):
            shift = np.uint64(64 - self.BITS - 7 * len(self.tables))
            slot = (keys[left] >> shift & self.MASK).astype(np.int64)
            first = np.unique(slot, return_index=True)[1]
            key, piece = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, -1, np.int32)
            key[slot[first]], piece[slot[first]] = keys[left[first]], left[first]
            self.tables.append((shift, key, piece))
            left = np.delete(left, first)

    @staticmethod
    def _key(token: bytes) -> int:
        h = 0
        for b in token:
            h = (h * int(_BASE) + int(_BYTE[b])) % 2**64
        return h

    def __len__(self) -> int:
        return len(self.tokens)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The piece of each hash, -1 where there is none."""
        out = np.full(len(keys), -1, np.int32)
        for shift, key, piece in self.tables:
            slot = (keys >> shift & self.MASK).astype(np.int64)
            same = key[slot] == keys
            out[same] = piece[slot[same]]
        return out


@functools.cache
def pieces(path: str) -> Pieces:
    with open(path, "rb") as f:
        return Pieces([base64.b64decode(x.split()[0]) for x in f])


class Lattice:
    """All pieces in all places of many units, which come longest first. Arcs run from one byte position of a unit to a later one."""

    def __init__(self, coded: list[bytes], vocabulary: Pieces):
        self.size = np.fromiter(map(len, coded), np.int64, len(coded))
        self.n, self.width = len(coded), int(self.size[0])
        inside = np.arange(self.width) < self.size[:, None]
        values = np.zeros((self.n, self.width), np.uint64)
        values[inside] = _BYTE[np.frombuffer(b"".join(coded), np.uint8)]
        self.arcs: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # from, to, units, pieces
        for i in range(self.width):
            h = np.zeros(self.n, np.uint64)
            for j in range(i + 1, min(self.width, i + vocabulary.longest) + 1):
                reach = int(np.searchsorted(-self.size, -j, side="right"))  # so many units have j bytes
                h = h[:reach] * _BASE + values[:reach, j - 1]
                found = vocabulary.find(h)
                unit = np.flatnonzero(found >= 0)
                if len(unit):
                    self.arcs.append((i, j, unit, found[unit]))

    def forward(self, p: list[np.ndarray]) -> np.ndarray:
        """p (the pieces' probabilities by arc: unit, or unit and language) -> the sum over segmentations of what is before each position (position, unit, ...)."""
        a = np.zeros((self.width + 1, self.n, *p[0].shape[1:]))
        a[0] = 1
        for (i, j, unit, _), q in zip(self.arcs, p, strict=True):
            a[j, unit] += a[i, unit] * q
        return a

    def backward(self, p: list[np.ndarray]) -> np.ndarray:
        """The same of what is behind each position."""
        b = np.zeros((self.width + 1, self.n, *p[0].shape[1:]))
        b[self.size, np.arange(self.n)] = 1
        for (i, j, unit, _), q in zip(reversed(self.arcs), reversed(p), strict=True):
            b[i, unit] += b[j, unit] * q
        return b

    def total(self, a: np.ndarray) -> np.ndarray:
        """The sum over all segmentations of whole units (unit, ...)."""
        return a[self.size, np.arange(self.n)]

    def expected(self, p: np.ndarray, lang: np.ndarray, weight: np.ndarray, into: np.ndarray) -> None:
        """Adds each piece's expected count to into (piece, language): each unit is of one language and so often there."""
        by_arc = [p[piece, lang[unit]] for _, _, unit, piece in self.arcs]
        a, b = self.forward(by_arc), self.backward(by_arc)
        w = weight / self.total(a)
        share = np.concatenate([a[i, unit] * q * b[j, unit] * w[unit] for (i, j, unit, _), q in zip(self.arcs, by_arc, strict=True)])
        cell = np.concatenate([piece * into.shape[1] + lang[unit] for _, _, unit, piece in self.arcs])
        into += np.bincount(cell, share, into.size).reshape(into.shape)


def lattices(names: list[str], vocabulary: Pieces, langs: int) -> Iterator[tuple[np.ndarray, Lattice]]:
    """Lattices of units of about equal length, with the units' places in names; a pass over one holds CELLS numbers at most, or those of one unit."""
    coded = [b" " + x.encode("utf-8", "replace") for x in names]
    order = sorted(range(len(coded)), key=lambda i: -len(coded[i]))
    at = 0
    while at < len(order):
        n = max(1, CELLS // ((len(coded[order[at]]) + 1) * langs))
        yield np.array(order[at:at + n]), Lattice([coded[i] for i in order[at:at + n]], vocabulary)
        at += n


def scaled(p: np.ndarray, vocabulary: Pieces) -> np.ndarray:
    return p * PER_BYTE ** np.array([len(t) for t in vocabulary.tokens], float)[:, None]


def log_likelihoods(names: list[str], p: np.ndarray, vocabulary: Pieces) -> np.ndarray:
    """The log probability of each unit in each language (unit, language). p is scaled."""
    out = np.zeros((len(names), p.shape[1]))
    for at, lattice in lattices(names, vocabulary, p.shape[1]):
        z = lattice.total(lattice.forward([p[piece] for *_, piece in lattice.arcs]))
        out[at] = np.log(z) - lattice.size[:, None] * np.log(PER_BYTE)
    return out


def expected_counts(batches: Iterable[pa.RecordBatch], langs: list[str], p: np.ndarray, vocabulary: Pieces) -> np.ndarray:
    """Expected piece counts (piece, language) of batches (text, lang). p is scaled."""
    into = np.zeros((len(vocabulary), len(langs)))
    place = {lang: k for k, lang in enumerate(langs)}
    known, weight = Known(), np.zeros((0, len(langs)))

    def spend() -> None:
        unit, lang = np.nonzero(weight)  # most units are of one language
        times = weight[unit, lang]
        for at, lattice in lattices([known.names[i] for i in unit], vocabulary, 1):
            lattice.expected(p, lang[at], times[at], into)

    for batch in by_chunks(batches, "text", BLOCK):
        keys = [known.of(units(text)) * len(langs) + place[lang] for lang, text in zip(batch.column("lang").to_pylist(), texts(batch, "text"), strict=True)]
        weight = np.concatenate([weight, np.zeros((len(known) - len(weight), len(langs)))])
        weight += np.bincount(np.concatenate(keys), minlength=weight.size).reshape(weight.shape)
        if len(known) > REMEMBERED:
            spend()
            known, weight = Known(), np.zeros((0, len(langs)))
    spend()
    return into


class Model(NamedTuple):
    langs: list[str]  # by code point
    prior: np.ndarray  # log share of documents
    p: np.ndarray  # (piece, language)
    path: str


def maximised(c: np.ndarray) -> np.ndarray:
    """Probabilities (piece, language) from expected counts: no piece has probability zero."""
    pooled = (1 - UNIFORM) * c.sum(1) / max(c.sum(), 1) + UNIFORM / len(c)
    n = c.sum(0)
    share = np.maximum(BACKGROUND / (n + BACKGROUND), LEAST_SHARE)
    p = (1 - share) * c / np.maximum(n, 1) + share * pooled[:, None]
    return p / p.sum(0)


def fit(docs: DataFrame, path: str = VOCABULARY, rounds: int = ROUNDS) -> Model:
    """The model of all rows of docs (text, lang) that have both. Repeated rows count again; without rows there are no languages."""
    rows = docs.select("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect())  # a row a language
    langs, n = [x for x, _ in sizes], np.array([x for _, x in sizes], float)
    size = len(pieces(path))
    p = np.full((size, len(langs)), 1 / size)
    for _ in range(rounds if langs else 0):
        p = maximised(_expected(rows, langs, p, path))
    return Model(langs, np.log(n / max(n.sum(), 1)), p, path)


def _expected(rows: DataFrame, langs: list[str], p: np.ndarray, path: str) -> np.ndarray:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(path)
        found = np.rint(expected_counts(batches, langs, scaled(p, vocabulary), vocabulary) * STEPS).astype(np.int64)
        piece, lang = np.nonzero(found)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(piece, pa.int32()), "k": pa.array(lang, pa.int32()), "n": pa.array(found[piece, lang])})

    sums = rows.mapInArrow(lambda x: released(run(x)), "piece int, k int, n bigint").groupBy("piece", "k").agg(F.sum("n").alias("n")).toArrow()  # a row for each piece and language
    c = np.zeros(p.shape)
    c[sums["piece"].to_numpy(), sums["k"].to_numpy()] = sums["n"].to_numpy() / STEPS
    return c


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (the posterior of lang_pred, 0 to 1) for each row of docs (doc_id, text; other columns are ignored).

    Texts that are null or have no letter are `und` with score 0, and so are all if the model has no
    languages. Equal posteriors go to the first language by code point; repeated rows get equal
    results; long texts are read whole; an empty table gives no rows.
    """
    langs, prior, p, path = model

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(path)
        q = scaled(p, vocabulary)
        known, ll = Known(), np.zeros((0, len(langs)))
        for batch in by_chunks(batches, "text", BLOCK):
            found = [known.of(units(x)) if langs else np.zeros(0, np.int64) for x in texts(batch, "text")]
            ll = np.concatenate([ll, log_likelihoods(known.names[len(ll):], q, vocabulary)])
            doc, unit = np.repeat(np.arange(len(found)), [len(x) for x in found]), np.concatenate(found)
            total = np.stack([np.bincount(doc, ll[unit, k], len(found)) for k in range(len(langs))], 1) + prior if langs else np.zeros((len(found), 1))
            best = total.argmax(1)
            score = 1 / np.exp(total - total.max(1)[:, None]).sum(1)
            named = np.array([len(x) > 0 for x in found])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array([langs[b] if x else "und" for b, x in zip(best, named, strict=True)], pa.string()), "score": pa.array(np.where(named, score, 0.0))})
            if len(known) > REMEMBERED:
                known, ll = Known(), np.zeros((0, len(langs)))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda x: released(run(x)), f"doc_id {kind}, lang_pred string, score double")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out("doc_id", 4)))
    return predict(docs, model).select("doc_id", held_out("doc_id", 4).alias("held_out"), "lang_pred", "score")
