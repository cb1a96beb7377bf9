"""BPE of pieces of any length, and of vocabularies whose tokens can't all be made."""

from __future__ import annotations

import base64
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomline.llm import bpe

from .test_operators import RANKS

rng = random.Random(11)


def ids(encoding, text):
    return np.array(encoding.encode_ordinary(text), "<u4").tobytes()


@pytest.fixture(scope="module")
def known():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(RANKS, public_tokenizers.PATTERN)


def pick(alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


KINDS = [pick("abcdefghijklmnopqrstuvwxyz", 40_000), "a" * 30_001, "ab" * 9_999, "abcabd" * 4_000, pick("ab", 30_000), pick("éèaeço", 20_000), pick(["the", "and", "ing", "tion", "un"], 9_000),
         "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(9_000)), pick("ABCDabcd", 30_000), "-" * 7_777 + "=" * 8_888, "\n" * 9_999]


@pytest.mark.parametrize("text", KINDS, ids=range(len(KINDS)))
def test_long_pieces_equal_tiktoken(coder, known, text):
    assert coder.sound() and coder.encode([text])[0] == ids(known, text)


def test_two_megabytes_in_one_piece(coder, known):
    text = pick("abcdefghijklmnopqrstuvwxyz", 2_000_000)
    began = time.time()
    found = coder.encode([text])[0]
    assert time.time() - began < 60 and found == ids(known, text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet="abet hin", max_size=90), st.text(alphabet="aé漢\n", max_size=60)), max_size=4), st.sampled_from([1, 2, 3, 7]))
def test_any_cut(coder, known, texts, short):
    coder.known, coder.older = {}, {}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(bpe, "SHORT", short)
        assert coder.encode(texts) == [ids(known, x) for x in texts]


def leftmost(ranks, data):
    """The rule as it is stated."""
    parts = [data[i:i + 1] for i in range(len(data))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not pairs:
            return [ranks[x] for x in parts]
        i = min(pairs)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_a_vocabulary_with_tokens_out_of_order(tmp_path):
    """Here a merge makes a pair of lower rank than its own, so only the leftmost rule will do."""
    extra = [b"ab", b"bc", b"bcd", b"abcd", b"abc", b"cda", b"dab"]
    ranks = {bytes([i]): i for i in range(256)} | {t: 256 + i for i, t in enumerate(extra)}
    path = tmp_path / "odd.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for t, i in ranks.items()))
    c = bpe.Coder(str(path), r"\S+|\s+")
    assert not c.sound()
    texts = [pick("abcd", 300) for _ in range(9)] + ["abcd" * 50]
    assert [np.frombuffer(x, "<u4").tolist() for x in c.encode(texts)] == [leftmost(ranks, x.encode()) for x in texts]
    assert c.decode(c.encode(texts)) == [x.encode() for x in texts]


def odd_vocabulary(folder, extra):
    ranks = {bytes([i]): i for i in range(256)} | {t: 256 + i for i, t in enumerate(extra)}
    path = folder / f"odd-{rng.random()}.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for t, i in ranks.items()))
    return ranks, bpe.Coder(str(path), r"\S+|\s+")


def test_sure_pairs_start_contracted(coder, known):
    """The query's first SELECT leaves fewer rows than bytes, and each one's token is still bytes of its piece."""
    pieces = [pick(["the", "and", "ing", "tion", "un", "er", "ou", "es"], 4).encode() for _ in range(2_000)] + [b"q", b"qu", b"\xff"]
    positions = coder.positions(pieces)  # noqa: F841  the query reads it by name
    assert positions.num_rows == sum(map(len, pieces))
    start = dict(zip(("piece", "pos", "id", "done"), map(list, zip(*sorted(coder.db.sql(bpe._START).fetchall(), key=lambda r: r[1]), strict=True)), strict=True))
    assert len(start["id"]) < 0.8 * sum(map(len, pieces)) and start["pos"] == sorted(start["pos"])
    if not coder.bytes_of:
        coder.bytes_of = {i: t for t, i in coder.ranks.items()}
    assert b"".join(coder.bytes_of[i] for i in start["id"]) == b"".join(pieces)
    assert coder.contracted(pieces[:-1], bpe._LEFTMOST) == [ids(known, x.decode()) for x in pieces[:-1]]


@pytest.mark.parametrize("seed", range(25))
def test_sure_pairs_in_any_vocabulary(tmp_path, seed):
    """Ranks in random order, tokens that no merge makes: the start never changes what the leftmost rule gives."""
    r = random.Random(seed)
    extra = list({"".join(r.choice("abcde") for _ in range(r.choice([2, 2, 2, 3, 3, 4, 5]))).encode() for _ in range(r.choice([4, 12, 40]))})
    r.shuffle(extra)
    if not any(len(x) == 2 for x in extra):
        extra.append(b"ab")
    ranks, c = odd_vocabulary(tmp_path, list(dict.fromkeys(extra)))
    data = ["".join(r.choice("abcdef") for _ in range(r.randrange(1, 30))).encode() for _ in range(300)]
    found = [np.frombuffer(x, "<u4").tolist() for x in c.contracted(data, bpe._LEFTMOST)]
    assert found == [leftmost(ranks, x) for x in data]


def test_texts_across_decoding_queries(coder, monkeypatch):
    """A text may begin and end anywhere in a query's tokens, or fill several; empty ones lie anywhere."""
    batch = ["", "one two", "", "", "three four five six seven", "é漢", "", "x", ""]
    encoded = coder.encode(batch)
    for n in (1, 2, 3, 5, 100):
        monkeypatch.setattr(bpe, "DECODE_TOKENS", n)
        assert coder.decode(encoded) == [x.encode() for x in batch]
    assert coder.decode([]) == [] and coder.decode([b"", b""]) == [b"", b""]
