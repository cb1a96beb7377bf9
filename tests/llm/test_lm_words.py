from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fathomline.llm import lm

TEXTS = ["A b  a\n\x0bB", None, "", " \t\n", "É\x1ce x\x00y\x85z\xa0w a", " lead", "trail\r\f", "漢字 \U0001F600 漢字 漢", "a" * 5000 + " a"]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_distinct_words_are_the_words(kind):
    """A block's words, split and numbered as columns, are those of each text by itself; a slice's too."""
    for texts, column in ((TEXTS, pa.array(TEXTS, kind)), (TEXTS[2:7], pa.array(TEXTS, kind).slice(2, 5)), ([], pa.array([], kind)), ([None], pa.array([None], kind))):
        found, number, row = lm.distinct_words(column)
        assert len(set(found)) == len(found)
        assert [[found[k] for k in number[row == i]] for i in range(len(texts))] == [lm.words(t or "") for t in texts]


@pytest.mark.parametrize("head", [0, 2, 9])
def test_blocks_give_the_tokens_of_their_texts(head):
    counts = Counter(w for t in TEXTS for w in lm.words(t or ""))
    v = lm.Vocabulary(counts.most_common()[:head], np.ones(lm.BUCKETS), np.ones(lm.BUCKETS), 9, 99, 20)
    found, number, row = lm.distinct_words(pa.array(TEXTS))
    ids = v.ended(v.known(found)[0][number], row, len(TEXTS))
    assert [x.tolist() for x in ids] == [v.tokens(lm.words(t or ""))[0].tolist() for t in TEXTS]
    assert v.ended(np.zeros(0, np.int32), np.zeros(0, np.int64), 0) == []


def test_a_common_word_is_looked_up_once_a_block(monkeypatch):
    """Half a million words, four of them distinct: the vocabulary is asked four times."""
    asked = []
    v = lm.Vocabulary([(b"a", 9), (b"b", 8)], np.ones(lm.BUCKETS), np.ones(lm.BUCKETS), 9, 99, 20)
    own = lm.Vocabulary.known
    monkeypatch.setattr(lm.Vocabulary, "known", lambda self, words: asked.append(len(words)) or own(self, words))
    start = lm._new_model(v).vector()
    taken = []
    monkeypatch.setattr(lm.gru, "train", lambda model, documents, rate: taken.extend(documents))

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return list(run([pa.RecordBatch.from_pydict({"text": ["a b c d " * 1250] * 100})]))

    lm.copies(Rows(), v, start)
    assert asked == [4] and sum(map(len, taken)) == 500_100
