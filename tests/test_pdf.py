from __future__ import annotations

import math

import pytest

from fathomline.functions.parsers import pdf


@pytest.mark.parametrize(("table", "objects"), [
    (b"xref\n0 6\n0000000000 65535 f \n0000000009 00000 n \n", 65541), (b"xref\n0 1\nf", 1), (b"xref\n0 0\nx", 0), (b"xref\n7 x", None), (b"/Type /XRef /Size 12", 12), (b"/Type /XRef", None)])
def test_object_estimate(table, objects):
    body = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\n" + b"\n" * 40
    data = body + table + b" " * 200 + b"\ntrailer <</Root 1 0 R>>\nstartxref\n" + str(len(body)).encode() + b"\n%%EOF"
    found = pdf.structure(data)
    assert found["pdf_xref_ok"] and found["pdf_obj_count_est"] == math.log1p(1 if objects is None else objects)
