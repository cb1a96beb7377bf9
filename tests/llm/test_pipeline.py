"""run() against the same stages in plain Python."""

from __future__ import annotations

import hashlib
from collections import Counter

import corpus_pipeline
import numpy as np

from fathomline.llm import pii, quality

from .test_near_copies import brute
from .test_operators import RANKS, SMALL, base, words


def good(text):
    """The quality verdict from the text's n-grams as tuples of words."""
    w = words(text)
    n_words, chars, symbols, _, repeats = base(text)
    lines = [x for x in text.split("\n") if words(x)]
    again = sum(len(x) for i, x in enumerate(lines) if x in lines[:i])
    if n_words < 50 or 2 * repeats > n_words or symbols > 0.3 * n_words or again > 0.3 * sum(map(len, lines)):
        return False
    for n, most in quality.COVERAGE.items():
        grams = Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
        inside = {k for i in range(len(w) - n + 1) if grams[tuple(w[i:i + n])] > 1 for k in range(i, i + n)}
        if sum(len(w[k]) for k in inside) > most * chars and (n < 5 or len(inside) >= 30):
            return False
    return True


def test_stages_keep_documents_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_run(spark):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = [r for r in rows if good(r["text"])]
    labels = brute([r["text"] for r in rows])
    least = {}
    for r, k in zip(rows, labels, strict=True):
        least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    rows = [r for r, k in zip(rows, labels, strict=True) if r["doc_id"] == least[k]]
    p = pii.Pseudonyms()
    for r in rows:
        r["text"] = p.replace(r["text"])
    # the mix: sources by code point weigh 1, 2, 3; rows in the order of their keys
    names = sorted({r["source"] for r in rows})
    sizes = {s: sum(len(words(r["text"])) for r in rows if r["source"] == s) for s in names}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped: set = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        scale = left / sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and scale * weight[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    expected: Counter = Counter()
    for s in names:
        budget = int((3 * sizes[s] if s in capped else scale * weight[s]) + 0.5)
        epochs, rest = divmod(budget, sizes[s])
        of = [r for r in rows if r["source"] == s]
        for r in sorted(of, key=lambda r: (int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16), r["doc_id"])):
            w = words(r["text"])
            more = max(0, min(len(w), rest))
            rest -= more
            copies = [r["text"]] * (epochs + (more == len(w))) + ([" ".join(w[:more])] if 0 < more < len(w) else [])
            for t in copies:
                ids = np.array(enc.encode_ordinary(t), "<u4").tobytes()
                expected[r["doc_id"], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    found = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found) == expected
    for r in found:
        assert len(r["ids"]) == 4 * r["n_tokens"] and hashlib.sha256(r["ids"]).hexdigest() == r["ids_sha256"]
