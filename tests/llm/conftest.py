from __future__ import annotations

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of (doc_id, text[, source]) rows, with columns whose names clash with results'."""

    def make(rows, extra: bool = True):
        df = spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], DOCS)
        if extra:
            df = df.selectExpr("*", "1 AS size", "'x' AS fingerprint", "2 AS n_words", "3 AS held_out", "4 AS row", "5 AS key", "6 AS score", "7 AS c", "8 AS word")
        return df.repartition(3)

    return make


#: Nulls, empty and blank texts, ties and repeated rows.
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (4, "a"), (5, "word " * 3000), (None, "no id here at all"), (None, None), (6, "é漢 \U0001F600 \x00 x")]
