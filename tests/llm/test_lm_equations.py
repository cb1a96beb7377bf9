"""op8's score, recomputed in plain Python from its equations: gates, class-factored softmax, carried state, words inside their bucket."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from fathomline.llm import gru, lm


def log_p(m, ids):
    """Natural log-likelihood of one document, token by token and unit by unit."""
    H, out = m.hidden, 0.0
    E, U, Wc, bc, Wo, bo = (np.asarray(getattr(m, k), float).tolist() for k in m.NAMES)
    h = [0.0] * H
    for x in ids:
        klass, place = divmod(int(x), m.width)
        z = [bc[k] + sum(h[j] * Wc[j][k] for j in range(H)) for k in range(m.classes)]
        out += z[klass] - math.log(sum(map(math.exp, z)))
        z = [bo[klass][i] + sum(h[j] * Wo[klass][j][i] for j in range(H)) for i in range(m.width)]
        out += z[place] - math.log(sum(map(math.exp, z)))
        a = [E[x][i] + sum(h[j] * U[j][i] for j in range(H)) for i in range(2 * H)]
        h = [h[i] + (math.tanh(a[H + i]) - h[i]) / (1 + math.exp(-a[i])) for i in range(H)]
    return out


def filled(m, seed):
    r = np.random.default_rng(seed)
    m.load(r.normal(size=len(m.vector())) * 0.4)
    return m


@pytest.mark.parametrize("streams", [1, 3, 256])
def test_scores_follow_the_equations(streams):
    """Documents of one token to several windows, side by side in any number of streams."""
    m, r = filled(gru.Model(3, 4, 5), 1), np.random.default_rng(2)
    docs = [r.integers(0, 12, n).astype(np.int32) for n in (1, 2, 63, 64, 65, 200, 7, 1, 130)]
    np.testing.assert_allclose(gru.score(m, docs, streams), [log_p(m, d) for d in docs], rtol=1e-5)


def by_hand(rows, m):
    """doc_id -> score: the network's tokens, and for what it has no token for the add-one share of the word in its bucket."""
    fold = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    split = lambda t: (t or "").encode().lower().split()
    count = Counter(w for t in fold for w in split(t))
    own = sorted(count, key=lambda w: (-count[w], w))[:lm.MODEL_WORDS]
    totals, distinct = [0] * lm.BUCKETS, [0] * lm.BUCKETS
    for w, c in count.items():
        if w not in own:
            totals[lm.bucket(w)] += c
            distinct[lm.bucket(w)] += 1
    names = [*own, *[None] * (lm.MODEL_WORDS - len(own)), *range(lm.BUCKETS), "end"]
    size = [count[w] if isinstance(w, bytes) else 0 if w is None else len(fold) if w == "end" else totals[w] for w in names] + [0] * (lm.CLASSES * lm.WIDTH - len(names))
    order = sorted(range(len(size)), key=lambda i: -size[i])
    number = {names[i]: at for at, i in enumerate(order) if i < len(names) and names[i] is not None}
    out = {}
    for i, t in rows:
        ids, inside = [], 0.0
        for w in split(t):
            b = lm.bucket(w)
            ids.append(number[w] if w in number else number[b])
            if w not in number:
                inside += math.log10((count[w] + 1) / (totals[b] + distinct[b] + 1))
        out[i] = log_p(m, [*ids, number["end"]]) / math.log(10) + inside
    return out


@pytest.mark.parametrize(("head", "own"), [(1 << 18, 40), (20, 5), (0, 767)])
def test_the_operators_scores(spark, monkeypatch, head, own):
    """Whatever part of the words the network knows, and whatever part travels to its counts, the score is the same formula."""
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "MODEL_WORDS", min(own, head) if head < own else own)
    r = np.random.default_rng(3)
    words = [f"W{i}" for i in range(150)]
    rows = [(i, " ".join(r.choice(words, r.integers(0, 60), p=np.arange(150, 0, -1) / 11325))) for i in range(40)] + [(100, None), (101, ""), (102, "x" * 500 + " never seen"), (103, "w1 " * 150)]
    made = filled(gru.Model(lm.CLASSES, lm.WIDTH, lm.HIDDEN), 4)
    monkeypatch.setattr(lm, "train", lambda docs, v: made)
    found = {x["doc_id"]: x["score"] for x in lm.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    expected = by_hand(rows, made)
    assert found.keys() == expected.keys()
    for i, e in expected.items():
        assert found[i] == pytest.approx(e, rel=1e-4), i
