"""Language ID: the forward algorithm and expected counts against all segmentations, held-out accuracy, odd rows."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from tests.conftest import SMALL

from fathomline.llm import langid, registry
from fathomline.llm.common import held_out


def segmentations(unit: bytes, pieces: dict[bytes, int]):
    if not unit:
        yield []
    for j in range(1, len(unit) + 1):
        if unit[:j] in pieces:
            for rest in segmentations(unit[j:], pieces):
                yield [pieces[unit[:j]], *rest]


@pytest.fixture(scope="module")
def vocabulary():
    return langid.pieces(langid.VOCABULARY)


@pytest.fixture(scope="module")
def p(vocabulary):
    found = np.random.default_rng(5).random((len(vocabulary), 3)) ** 4 + 1e-9
    return found / found.sum(0)


UNITS = ["a", "the", "straße", "ñ", "mente", "nation", "漢字", "é" * 4]


def test_forward_sums_all_segmentations(vocabulary, p):
    pieces = {t: i for i, t in enumerate(vocabulary.tokens)}
    found = langid.log_likelihoods(UNITS, langid.scaled(p, vocabulary), vocabulary)
    for unit, ll in zip(UNITS, found, strict=True):
        every = list(segmentations(b" " + unit.encode(), pieces))
        assert every
        np.testing.assert_allclose(ll, np.log(sum(np.prod(p[s], axis=0) for s in every)), rtol=1e-9)


def test_expected_counts_by_all_segmentations(vocabulary, p):
    pieces = {t: i for i, t in enumerate(vocabulary.tokens)}
    lang, weight = np.array([0, 1, 2, 2, 1, 0, 1, 0]), np.array([1.0, 2, 3, 1, 5, 1, 1, 2])
    expected = np.zeros_like(p)
    for unit, k, w in zip(UNITS, lang, weight, strict=True):
        every = list(segmentations(b" " + unit.encode(), pieces))
        chance = np.array([np.prod(p[s, k]) for s in every])
        for s, c in zip(every, chance / chance.sum(), strict=True):
            for piece, n in Counter(s).items():
                expected[piece, k] += n * c * w
    found = np.zeros_like(p)
    for at, lattice in langid.lattices(UNITS, vocabulary, 1):
        lattice.expected(langid.scaled(p, vocabulary), lang[at], weight[at], found)
    np.testing.assert_allclose(found, expected, rtol=1e-8, atol=1e-12)


def test_every_piece_is_found(vocabulary):
    keys = np.array([vocabulary._key(t) for t in vocabulary.tokens], np.uint64)
    assert (vocabulary.find(keys) == np.arange(len(keys))).all()
    assert (vocabulary.find(keys + np.uint64(1)) == -1).all()


def test_small_blocks_give_the_same(vocabulary, p, monkeypatch):
    whole = langid.log_likelihoods(UNITS, langid.scaled(p, vocabulary), vocabulary)
    monkeypatch.setattr(langid, "CELLS", 40)
    np.testing.assert_allclose(langid.log_likelihoods(UNITS, langid.scaled(p, vocabulary), vocabulary), whole)


def test_no_unit_vanishes(vocabulary):
    """However much was learned: the least likely bytes in the longest unit, and the most likely pieces, have finite logarithms and counts."""
    c = np.zeros((len(vocabulary), 2))
    c[vocabulary.tokens.index(b" "), 0] = 1e15
    c[vocabulary.tokens.index(b"a"), 1] = 1e15
    p = langid.scaled(langid.maximised(c), vocabulary)
    rare = ["\U00020000" * langid.LETTERS, "a" * langid.LETTERS, "z" * langid.LETTERS]
    assert np.isfinite(langid.log_likelihoods(rare, p, vocabulary)).all()
    into = np.zeros_like(p)
    for at, lattice in langid.lattices(rare * 2, vocabulary, 1):
        lattice.expected(p, np.array([0, 0, 0, 1, 1, 1])[at], np.ones(6)[at], into)
    assert np.isfinite(into).all()
    bytes_in = [len(t) for t in vocabulary.tokens]
    assert (into * np.array(bytes_in)[:, None]).sum() == pytest.approx(2 * sum(1 + len(x.encode()) for x in rare))


def test_units():
    assert langid.units("Ein-Wort, 3 x² _É_ ́a") == ["ein", "wort", "x", "é", "a"]
    assert langid.units("क्षि") == ["क्षि"]
    assert "".join(langid.units("ab" * 50_001)) == "ab" * 50_001
    assert langid.units("12 ½ ² ! ́ Ⅷ") == []


def test_rounds_never_lower_the_likelihood(spark):
    """Expectation maximisation, but for the small smoothing."""
    docs = spark.createDataFrame([(x, "en") for x in ("the cat sat on the mat", "a hat that the cat had", "that is that")] + [("el gato que come", "es"), ("que si que no", "es")], "text string, lang string")
    vocabulary = langid.pieces(langid.VOCABULARY)
    total = []
    for rounds in (1, 2, 4):
        m = langid.fit(docs, rounds=rounds)
        ll = langid.log_likelihoods(langid.units("the cat sat on the mat a hat that the cat had that is that"), langid.scaled(m.p, vocabulary), vocabulary)
        total.append(ll[:, m.langs.index("en")].sum())
    assert total[0] < total[1] <= total[2] + 0.5


ODD = [(1, "the cat sat on the mat and the hat", "en"), (1, "the cat sat on the mat and the hat", "en"), (2, None, "en"), (3, "", "es"), (4, "12 345 !?", "es"), (5, "el gato se sienta en la estera", "es"), (6, "que el gato", None),
       (None, "the hat", "en"), (7, "the hat " * 40_000, None), (8, "x" * 300_000, "en"), (9, "no lang \x00 \U0001F600 é", "")]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 1.0, "x", True) for r in ODD], "doc_id bigint, text string, lang string, score double, lang_pred string, held_out boolean").repartition(3)
    model = langid.fit(docs)
    assert model.langs == ["", "en", "es"]
    found = langid.predict(docs, model).collect()
    assert len(found) == len(ODD)
    by_id = {r["doc_id"]: r for r in found}
    assert {i: by_id[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 6, 7, None)} == {1: "en", 2: "und", 3: "und", 4: "und", 5: "es", 6: "es", 7: "en", None: "en"}
    assert all(0 <= r["score"] <= 1 and math.isfinite(r["score"]) for r in found)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id bigint, text string, lang string")
    model = langid.fit(docs)
    assert model.langs == []
    assert {r["lang_pred"] for r in langid.predict(docs, model).collect()} == {"und"}
    assert langid.predict(docs.filter("false"), langid.fit(docs.filter("false"))).count() == 0


def test_equal_languages_go_by_code_point(spark):
    docs = spark.createDataFrame([(1, "one text", "zz"), (2, "one text", "aa")], "doc_id bigint, text string, lang string")
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(docs)).collect()} == {"aa"}


def test_query_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = registry.QUERIES["op11_language_id"](spark, SMALL)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    both = found.join(docs.select("doc_id", "lang", held_out("doc_id", 4).alias("expected")), "doc_id").toPandas()
    assert len(both) == docs.count()
    assert (both.held_out == both.expected).all()
    assert both.held_out.sum() > 20
    assert (both.lang == both.lang_pred)[both.held_out].mean() > 0.97
