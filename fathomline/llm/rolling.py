"""Rolling hashes over many texts at once, in numpy.

A sequence's hash is its polynomial in 64-bit wrapping arithmetic: with prefix sums P of
value[i] * B**i, the hash of [s, e) is (P[e] - P[s]) * B**-s, so that any number of windows of any
lengths cost a gather each. Bytes get random 64-bit values. In such arithmetic only long sequences of
a special build collide (of 1,024 items or so), so none longer than LONGEST is hashed by it: longer
words get a cryptographic hash.
"""

from __future__ import annotations

import hashlib

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x5851F42D4C957F2D
_powers: dict[int, np.ndarray] = {}
LONGEST = 64
#: Bytes whose prefix sums are held at a time.
BLOCK = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), at least, kept for the next call."""
    found = _powers.get(base)
    if found is None or len(found) < n:
        found = np.full(max(1 << 16, 1 << (n - 1).bit_length() if n <= 1 << 20 else n + n // 8), base, np.uint64)
        found[0] = 1
        np.cumprod(found, out=found)
        _powers[base] = found
    return found[:n]


class Prefix:
    """Prefix sums of a sequence of 64-bit values; hashes(s, e) for arrays of starts and ends."""

    def __init__(self, values: np.ndarray, base: int = BASE):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(base, len(values)), out=self.sums[1:])
        self.back = powers(pow(base, -1, 2**64), len(values) + 1)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


class Texts:
    """The bytes of many texts, each closed by a newline, and where their words are."""

    def __init__(self, texts: list[str] | list[bytes]):
        parts = [x if isinstance(x, bytes) else x.encode() for x in texts]
        self.n = len(parts)
        size = np.fromiter(map(len, parts), np.int64, self.n) + 1
        self.starts = np.concatenate([[0], np.cumsum(size)])  # of each text, and the end
        self.bytes = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8) if self.n else np.zeros(0, np.uint8)
        edge = np.diff((~WHITE[self.bytes]).view(np.int8), prepend=0, append=0)
        self.word_start, self.word_end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.word_text = np.repeat(np.arange(self.n), np.diff(np.searchsorted(self.word_start, self.starts)))

    def word_hashes(self) -> np.ndarray:
        """A hash of each word's bytes, block by block."""
        out = np.empty(len(self.word_start), np.uint64)
        for at in range(0, len(self.bytes), BLOCK):
            i, k = np.searchsorted(self.word_start, [at, at + BLOCK])
            block = self.bytes[at:at + BLOCK + LONGEST]  # a word that goes on behind it is whole, or long
            start = self.word_start[i:k] - at
            out[i:k] = Prefix(BYTE_VALUE[block]).hashes(start, np.minimum(self.word_end[i:k] - at, start + LONGEST))
        for i in np.flatnonzero(self.word_end - self.word_start > LONGEST).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.bytes[self.word_start[i]:self.word_end[i]].tobytes(), digest_size=8).digest(), "little")
        return out

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many of the flagged bytes each text has."""
        return np.add.reduceat(flags, self.starts[:-1], dtype=np.int64) if self.n else np.zeros(0, np.int64)

    def word_points(self) -> np.ndarray:
        """Code points of each word."""
        if not len(self.word_start):
            return np.zeros(0, np.int64)
        return np.add.reduceat((self.bytes & 0xC0) != 0x80, np.stack([self.word_start, self.word_end], 1).ravel(), dtype=np.int64)[::2]
