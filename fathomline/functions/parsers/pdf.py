"""PDF trailer, cross references and encryption dictionaries."""

from __future__ import annotations

import math
import re

KIB = 1024
START_WINDOW, XREF_WINDOW, ROOT_WINDOW = 256 * KIB, 4096, 128 * KIB
ENCRYPT_TAIL, ENCRYPT_HEAD, BEFORE, AFTER = 256 * KIB, 1024 * KIB, 2 * KIB, 8 * KIB


def _version(data: bytes) -> float | None:
    m = re.match(rb"\d\.\d", data[5:8])
    return float(m.group()) if data.startswith(b"%PDF-") and m else None


def _start(data: bytes) -> tuple[bool, int | None]:
    """Whether the last startxref is there, and the number after it."""
    tail = data[-START_WINDOW:]
    at = tail.rfind(b"startxref")
    if at < 0:
        return False, None
    m = re.search(rb"\d+", tail[at + 9:at + 9 + 64])
    return True, int(m.group()) if m else None


def _xref(data: bytes, offset: int) -> tuple[bool, int | None]:
    """Whether a cross reference (table or stream) is at the offset, and how many objects it names."""
    window = data[max(0, offset - 16):max(0, offset - 16) + XREF_WINDOW]
    if b"xref" in window[:128]:
        # the second of each pair of numbers that stand right after the word: of a table's head, and of its first entry too, up to that entry's letter
        run = re.search(rb"(?i)xref\s+([\d\s]+)", window)
        second = run[1].split()[1::2] if run else []
        return True, sum(map(int, second)) if second else None
    if b"/Type" in window and b"/XRef" in window:
        m = re.search(rb"/Size\s+(\d+)", window)
        return True, int(m[1]) if m else None
    return False, None


def structure(data: bytes) -> dict | None:
    found, offset = _start(data)
    xref_ok, objects = _xref(data, offset) if offset is not None and offset < len(data) else (False, None)
    tail = data[-START_WINDOW:]
    trailer = b"trailer" in tail
    end = data[-ROOT_WINDOW:]
    root, ids = b"/Root" in end, b"/ID" in end
    if objects is None:
        limit = min(max(len(data) // 4096, 512), 4096) * KIB
        part = data if len(data) <= 2 * limit else data[:limit] + data[-limit:]
        objects = len(re.findall(rb"\b\d+\s+\d+\s+obj\b", part))
    header = data.startswith(b"%PDF-")
    trailer_ok = (trailer or xref_ok) and root
    ok = header and found and (xref_ok or trailer)
    return {"pdf_has_trailer": trailer, "pdf_startxref_found": found, "pdf_xref_ok": xref_ok, "pdf_obj_count_est": math.log1p(objects), "pdf_ids_present": ids, "pdf_root_present": root,
            "pdf_trailer_ok": trailer_ok, "pdf_version": _version(data), "parser_ok": ok, "structure_consistent": ok and xref_ok and root}


def encryption(data: bytes) -> dict | None:
    """/Encrypt in the tail or else the head; its filter and metadata mark near it, or else anywhere."""
    at = data.rfind(b"/Encrypt", max(0, len(data) - ENCRYPT_TAIL))
    if at < 0:
        at = data.find(b"/Encrypt", 0, ENCRYPT_HEAD)
    if at < 0:
        return {"pdf_encrypt_dict_present": False, "pdf_encrypt_filter": None, "pdf_encrypt_metadata": None}
    near = data[max(0, at - BEFORE):at + AFTER]
    name = re.search(rb"/Filter\s*/(Standard|[A-Za-z.]+)", near) or re.search(rb"/Filter\s*/(Standard)", data)
    meta = re.search(rb"/EncryptMetadata\s+(true|false)", near) or re.search(rb"/EncryptMetadata\s+(true|false)", data)
    return {"pdf_encrypt_dict_present": True, "pdf_encrypt_filter": name[1].decode("latin-1") if name else None, "pdf_encrypt_metadata": meta[1] == b"true" if meta else None}
