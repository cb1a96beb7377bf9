"""What each operator has to take in or keep whole."""

from __future__ import annotations

import numpy as np
import pytest

from fathomline.llm import gru, html, lm, quality


def network(spark, monkeypatch, texts):
    """lm.train's model without a warm start, from texts in one task, and its vocabulary."""
    monkeypatch.setattr(lm, "WARM_DOCS", 0)
    docs = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)], "doc_id bigint, text string, held_out boolean").coalesce(1)
    v = lm.vocabulary(lm.count_words(docs), len(texts))
    return lm.train(docs, v), v


def test_lm_trains_on_all_words(spark, monkeypatch):
    texts = [" ".join(f"w{(i * k) % 31}" for i in range(1500)) for k in (1, 2, 3, 5)] + ["short one", "", "x" * 900]
    model, v = network(spark, monkeypatch, texts)
    expected = lm._new_model(v)
    gru.train(expected, [v.tokens(lm.words(t))[0] for t in texts], rate=lm.RATE)
    assert np.allclose(model.vector(), expected.vector(), atol=1e-4)
    assert not np.allclose(model.vector(), lm._new_model(v).vector(), atol=1e-2)


LONG, LATER = "first part of it. " * 24, "second part of it. " * 20
PARTS = [
    ("<div><p>{a}</p><ul class='related'>" + "<li><a href=x>other</a></li>" * 6 + "</ul><p>{b}</p></div>", "{a} {b}"),
    ("<div><p>{a}</p>" + "<p><a href=x>link</a></p>" * 7 + "<p>{b}</p></div><div><a>out</a></div>", "{a}" + " link" * 7 + " {b}"),
    ("<div>" + "<p>{a}</p>" * 2 + "<ul>" + "<li>a b</li>" * 9 + "</ul><p>{b}</p></div>", "{a} {a}" + " a b" * 9 + " {b}"),
    ("<div><h1><a href=x>Title</a></h1><p>{a}</p><h2><a href=x>Part</a></h2><p>{b}</p></div>", "Title {a} Part {b}"),
    ("<div>" + "<div><a>top</a></div>" * 9 + "</div><div><p>{a}</p><p>{b}</p></div><div>" + "<div><a>end</a></div>" * 9 + "</div>", "{a} {b}"),
]


@pytest.mark.parametrize(("page", "text"), PARTS)
def test_main_text_keeps_all_parts(page, text):
    a, b = LONG.strip(), LATER.strip()
    assert html.extract(page.format(a=a, b=b)) == text.format(a=a, b=b)


def test_main_text_beside_article_cards():
    cards = "<div><article><h3><a href=x>Card</a></h3><p>a teaser</p></article><article><p>another</p></article></div>"
    a, b = LONG.strip(), LATER.strip()
    assert html.extract(f"{cards}<div><p>{a}</p><p>{b}</p></div>{cards}") == f"{a} {b}"
    assert html.extract(f"<p>outside</p><article><p>{a}</p></article><div><p>{b}</p></div>") == a


def test_quality_fails_by_long_repeats_alone():
    fresh = [f"word{i:05d}" for i in range(260)]
    once, part, short = " ".join(fresh[:200]), " ".join(fresh[200:250]), " ".join(fresh[250:])
    m = quality.measure([f"{part} {once} {part}", f"{short} {' '.join(fresh[:33])} {short}"])
    assert not m["base_failed"].any() and 0.30 < m["dup_10gram_share"][0] < 0.35 < m["dup_10gram_share"][1]
    assert m["kept"].tolist() == [False, True]


def test_lm_learns_ends(spark, monkeypatch):
    model, v = network(spark, monkeypatch, ["a b c"] * 200)
    ids = v.tokens([b"a", b"b", b"c"])[0]
    end = gru.score(model, [ids])[0] - gru.score(model, [ids[:-1]])[0]
    fresh = lm._new_model(v)
    assert end > gru.score(fresh, [ids])[0] - gru.score(fresh, [ids[:-1]])[0]


def thue_morse(n, letters="ab"):
    """Two words of 2**n letters that wrapping polynomials of any base and letter values confuse for large n."""
    word = [letters[bin(i).count("1") % 2] for i in range(1 << n)]
    return "".join(word), "".join(letters[letters.index(c) ^ 1] for c in word)


@pytest.mark.parametrize("n", [6, 10, 11, 12])
def test_quality_counts_are_exact_on_built_texts(n):
    a, b = thue_morse(n)
    m = quality.measure([f"{a}\n{b}", f"{a}\n{b}\n{a}", f"x {a} y\nx {b} y", f"x {a} y z\nx {a} y"])
    assert m["n_dup_lines"].tolist() == [0, 1, 0, 0]
    assert m["n_repeat_words"].tolist() == [0, 0, 0, 6]


def test_quality_of_long_texts_in_blocks(monkeypatch):
    from fathomline.llm import rolling

    texts = [" ".join(f"w{i * i % 97}{'é' * (i % 90)}" for i in range(3000)) + "\n" + "same line\n" * 9, "", "z" * 5000, "a b c a b c"]
    whole = quality.measure(texts)
    monkeypatch.setattr(rolling, "BLOCK", 100)
    parts = quality.measure(texts)
    assert all((whole[k] == parts[k]).all() for k in whole)
    words = texts[0].split()
    assert (whole["n_words"][0], whole["word_chars"][0], whole["n_dup_lines"][0]) == (len(words), sum(map(len, words)), 8)


@pytest.mark.parametrize(("rows", "size", "scattered"), [(3, 50, 4), (8192, 1, 512), (1, 4 << 20, 0), (5, 4 << 20, 1 << 20)])
def test_chats_in_any_blocks(spark, monkeypatch, rows, size, scattered):
    import random

    from fathomline.llm import chat

    for k, v in (("BLOCK_ROWS", rows), ("BLOCK_BYTES", size), ("SCATTERED", scattered)):
        monkeypatch.setattr(chat, k, v)
    rng = random.Random(rows)
    given = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["", None, "<|im_end|>", "é" * 30, "x" * 700, "a\nb"])) for c in [None, *range(30)] for t in range(rng.choice([1, 1, 2, 3, 17]))]
    df = spark.createDataFrame(given, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    found = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert len(found) == 31
    for c, r in found.items():
        turns = [(role or "", text or "") for k, _, role, text in given if k == c]
        data = bytes(r["formatted"])
        assert [(a.decode(), b.decode()) for a, b in chat.parse(data)] == turns
        assert [chat.unescape(data[a:b]).decode() for a, b in zip(r["loss_starts"], r["loss_ends"], strict=True)] == [t for role, t in turns if role == "assistant"]


def test_long_chat_texts_take_little_more_memory():
    """The assembly of a few long texts makes no index a byte."""
    import tracemalloc

    import pyarrow as pa

    from fathomline.llm import chat

    texts, roles = pa.array(["x" * (16 << 20)] * 2), pa.array(["user", "assistant"])
    tracemalloc.start()
    buffer, offsets, *_ = chat.assemble(roles, texts)
    assert tracemalloc.get_traced_memory()[1] < 64 << 20 and buffer.size == offsets[-1] > 32 << 20
    tracemalloc.stop()


def test_lm_scores_with_few_idle_streams(monkeypatch):
    """With a document of 20,000 words among common ones in each block, most of the network's steps are of documents' tokens."""
    rng = np.random.default_rng(1)
    total, documents = 0, [np.zeros(20_000, np.int32)]
    while total < lm.SCORED - 130_000:
        n = int(rng.integers(100, 900))
        documents.append(np.zeros(n, np.int32))
        total += 6 * n
    made, run = [], gru.Model._run
    monkeypatch.setattr(gru.Model, "_run", lambda self, x, *a: made.append(len(x)) or run(self, x, *a))
    gru.score(gru.Model(lm.CLASSES, lm.WIDTH, lm.HIDDEN), documents)
    assert sum(made) * 256 < 3 * sum(map(len, documents))
