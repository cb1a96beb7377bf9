"""MP4 boxes."""

from __future__ import annotations

MOST_BOXES = 100_000


def _boxes(data: bytes, start: int, end: int):
    """(type, content start, content end) of the boxes in a range; size 1 means a 64-bit size follows, 0 means to the end."""
    at = start
    for _ in range(MOST_BOXES):
        if at + 8 > end:
            return
        size, kind, head = int.from_bytes(data[at:at + 4], "big"), data[at + 4:at + 8], 8
        if size == 1:
            if at + 16 > end:
                return
            size, head = int.from_bytes(data[at + 8:at + 16], "big"), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            return
        yield kind, at + head, at + size
        at += size


def mp4(data: bytes) -> dict | None:
    seen = set()
    for kind, lo, hi in _boxes(data, 0, len(data)):
        seen.add(kind)
        if kind == b"moov":
            for _ in _boxes(data, lo, hi):
                pass
    ftyp, moov, mdat = (k in seen for k in (b"ftyp", b"moov", b"mdat"))
    tree = len(data) >= 8
    return {"mp4_ftyp_present": ftyp, "mp4_moov_present": moov, "mp4_mdat_present": mdat, "mp4_box_tree_ok": tree, "parser_ok": ftyp and tree and (moov or mdat), "structure_consistent": ftyp and tree and moov and mdat}
