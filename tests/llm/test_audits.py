"""Source divergence and filter interaction against brute force and SQL, on odd tables too."""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter, defaultdict

import pytest
from tests.conftest import SMALL, rows

from fathomline.llm import divergence, interaction, registry

DOCS = "doc_id bigint, text string, lang string, source string, value int, n bigint, term string, rank int, part string"


def made(spark, found):
    """documents (doc_id, text, lang, source) with columns whose names clash with results'."""
    return spark.createDataFrame([(*r, 1, 2, "x", 3, "y") for r in found], DOCS).repartition(3)


@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_filter_interactions"])
def test_matches_sql(spark, duck, name):
    found, expected = registry.QUERIES[name](spark, SMALL), duck.sql(registry.ORACLES[name])
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR"}
    assert {c: kinds[t] for c, t in found.dtypes} == dict(zip(expected.columns, map(str, expected.types), strict=True))
    assert rows(found.toPandas()) == rows(expected.df())


ODD = [(1, "Alpha beta beta", "en", "a"), (1, "Alpha beta beta", "en", "a"), (2, None, "en", "b"), (3, "ALPHA ÄÄ gamma1gamma", "en", None), (4, "beta Ä alpha", "en", ""), (5, "x", None, None),
       (None, "alpha", "en", "b"), (7, "nul \x00 alpha beta", "en", "c"), (8, "", "de", "a"), (9, "one two", "de", "b"), (10, "alpha " * 20_000, "en", "c"), (11, "tie tie", "fr", "a"), (12, "eit tie eit", "fr", "a")]


def by_hand(docs, least, top):
    term = re.compile(divergence.TERM)
    fold = str.maketrans(divergence.UPPER, divergence.LOWER)
    docs = [((t or "").translate(fold), lang or "", s or "") for _, t, lang, s in docs]
    count, df, groups = defaultdict(Counter), defaultdict(Counter), {(lang, s) for _, lang, s in docs}
    for text, lang, s in docs:
        words = term.findall(text)
        count[lang, s].update(words)
        count[lang].update(words)
        df[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in df[lang].items() if n >= least]
        v = len(kept)

        def shares(key, kept=kept, v=v):
            n = sum(count[key][t] for t in kept)
            return {t: 1 + (10**9 * (count[key][t] + 5)) // (n + 5 * v) for t in kept}

        p = {g: shares(g) for g in groups if g[0] == lang}
        q = shares(lang)
        for g in p:
            pairs = [(o[1], sum(abs(p[g][t] - p[o][t]) for t in kept)) for o in p if o != g]
            terms = [(t, p[g][t] - q[t]) for t in kept if count[g][t] and p[g][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(*g, part, item, value, i + 1) for i, (item, value) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("least", "top"), [(1, 50), (2, 1), (3, 50), (99, 50)])
def test_divergence_by_hand(spark, least, top):
    found = divergence.divergence(made(spark, ODD), least, top=top)
    assert sorted(map(tuple, found.collect())) == by_hand(ODD, least, top)


def test_divergence_with_many_groups(spark, monkeypatch):
    """Groups that are too many for a broadcast meet their terms in salted joins."""
    monkeypatch.setattr(divergence, "FEW_GROUPS", 2)
    found = divergence.divergence(made(spark, ODD), 1)
    assert sorted(map(tuple, found.collect())) == by_hand(ODD, 1, 50)


def test_divergence_is_exact_beyond_64_bits(spark):
    """Counts whose product with the scale passes 2**63."""
    n, total, v = 9_300_000_000, 9_999_999_999_999, 12_345
    row = spark.createDataFrame([(n, total, v)], "n bigint, total bigint, v bigint")
    assert row.select(divergence._share("n", "total", "v", 5, 10**9)).first()[0] == 1 + (10**9 * (n + 5)) // (total + 5 * v)


def test_empty_tables(spark):
    none = made(spark, ODD).filter("false")
    assert divergence.divergence(none).collect() == []
    assert interaction.audit(none, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect() == []


WORDS = " ".join(f"w{i}" for i in range(100))
FILTERED = [(3, WORDS, "en", "s"), (2, WORDS, "en", "s"), (2, WORDS, "en", "s"), (9, WORDS, "fr", "s"), (None, WORDS, "fr", "s"), (4, None, None, None), (5, "", None, "s"), (6, "a b a b a b " * 60 + "#", "en", "s"),
            (7, WORDS.upper(), "fr", "s"), (8, "short", "es", "s"), (8, WORDS + " $", "es", "s"), (10, "X " * 30_000, "es", "s"), (11, "Z" * 60 + " " + WORDS + " é漢", "es", "s")]
LABELS = [(2, 1, 0), (6, 0, 1), (6, 1, 0), (7, None, 1), (8, 1, 1), (99, 1, 1), (None, 1, 1), (11, 0, None)]


def interactions_by_hand(docs, labels):
    """Each order walked from the top, document by document."""
    judged = []
    for doc_id, text, lang, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
                 "E": doc_id is not None and any((o[1] or "") == text and o[0] is not None and o[0] < doc_id for o in docs)}
        own = [x for x in labels if doc_id is not None and x[0] == doc_id]
        judged.append((lang or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, removed_by = [], Counter()
    for part in {j[0] for j in judged}:
        mine = [j for j in judged if j[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [j for j in left if j[1][f]]
                left = [j for j in left if not j[1][f]]
                removed_by[part, f] += len(gone)
                fail = [j for j in mine if j[1][f]]
                out.append([part, "".join(order), k + 1, len(left), len(gone), len(fail) - len(gone), sum(sum(j[1].values()) == 1 for j in fail), sum(j[2] for j in gone), sum(j[3] for j in gone)])
    return sorted((*r, removed_by[r[0], r[1][r[2] - 1]]) for r in out)


def test_interactions_by_hand(spark):
    labels = spark.createDataFrame([(*x, "z") for x in LABELS], "doc_id bigint, quality int, toxic int, part string")
    found = interaction.audit(made(spark, FILTERED), labels)
    assert sorted(map(tuple, found.collect())) == interactions_by_hand(FILTERED, LABELS)


def test_each_state_is_walked_once(spark):
    judged = interaction.judged(made(spark, FILTERED), spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int"))
    states = [r["state"] for r in interaction.walk(judged, "ABCDE").filter("part = 'en'").collect()]
    assert len(states) == len(set(states)) <= 2**5
    assert sum(math.comb(5, k) for k in range(6)) == 2**5
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_three_filters(spark):
    """The general operator takes any filters."""
    judged = spark.createDataFrame([("p", True, False, True, False, False), ("p", False, True, True, True, False), ("p", False, False, False, True, True)], "part string, X boolean, Y boolean, Z boolean, good boolean, toxic boolean")
    found = {(r["filter_order"], r["step"]): r for r in interaction.interactions(judged, "XYZ").collect()}
    assert len(found) == 18
    assert [found["ZXY", k]["kept"] for k in (1, 2, 3)] == [1, 1, 1]
    assert [found["XYZ", k]["removed"] for k in (1, 2, 3)] == [1, 1, 0]
    assert found["XYZ", 3]["redundant"] == 2
    assert found["XYZ", 2]["good_lost"] == 1
    assert sum(found["XYZ", k]["shapley"] for k in (1, 2, 3)) == 6 * 2
