"""Mixed documents under any column names, and the shared folder."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

from fathomline.llm import common, mixing

from .conftest import DOCS


def test_clashing_columns_and_empty_tables(documents):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(i % 9)) or None, f"s{i % 3}" if i % 11 else None) for i in range(60)] + [(7, "a b c", "s1")] * 3
    wide, plain = documents(rows), documents(rows, extra=False)
    wide = wide.selectExpr("*", "1 AS cut_key", "2 AS part", "3 AS more", "4 AS epochs", "5 AS words", "6 AS of_source", "7 AS ordinal", "8 AS `a.b`")
    found = mixing.mixed_documents(wide)
    assert found.columns == wide.columns and found.limit(1).first()["a.b"] == 8
    keys = ["doc_id", "text", "source", "n_chars"]
    assert Counter(map(tuple, found.select(*keys).collect())) == Counter(map(tuple, mixing.mixed_documents(plain).select(*keys).collect()))
    taken = defaultdict(int)
    for r in mixing.mix(wide).collect():
        taken[r["doc_id"]] += r["taken"]
    out = Counter()
    for r in found.collect():
        out[r["doc_id"]] += len((r["text"] or "").split())
        assert r["n_chars"] == len(r["text"] or "")
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in out.items() if v}
    none = plain.limit(0)
    assert mixing.mixed_documents(none).count() == 0 == mixing.mix(none).count() and mixing.mixed_documents(none).schema == none.schema


def test_all_weightless(spark):
    docs = spark.createDataFrame([(1, None, "e", "s", 0), (2, "", "e", None, 0)], DOCS)
    assert mixing.mixed_documents(docs).count() == 0 and {r["taken"] for r in mixing.mix(docs).collect()} == {0}


def test_no_local_folder_on_a_cluster():
    class Session:
        class conf:
            @staticmethod
            def get(name, default):
                return None

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session)
