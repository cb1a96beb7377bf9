"""PNG and JPEG structure."""

from __future__ import annotations

import struct

PNG_MAGIC, MOST_CHUNKS, MOST_STEPS = b"\x89PNG\r\n\x1a\n", 100_000, 200_000
# JPEG markers without a length, and those that start a frame.
BARE = {*range(0xD0, 0xD8), 0x01, 0xD8}
FRAMES = set(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}


def png(data: bytes) -> dict | None:
    """Walks chunks (length, type, data, crc) until IEND or one that doesn't fit."""
    header = data.startswith(PNG_MAGIC)
    chunks = idat = 0
    ihdr = iend = False
    at = len(PNG_MAGIC)
    while header and chunks < MOST_CHUNKS and at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + size > len(data):
            break
        ihdr |= chunks == 0 and kind == b"IHDR" and size == 13
        idat += kind == b"IDAT"
        chunks += 1
        at += 12 + size
        if kind == b"IEND":
            iend = True
            break
    ok = header and ihdr and chunks >= 2
    return {"png_header_ok": header, "png_ihdr_ok": ihdr, "png_chunks_count": chunks, "png_idat_count": idat, "png_end_iend_ok": iend, "parser_ok": ok, "structure_consistent": ok and idat >= 1 and iend}


def jpeg(data: bytes) -> dict | None:
    """Walks markers from SOI to the scan or the end; a bad length ends the walk."""
    header = data.startswith(b"\xff\xd8")
    sof = sos = exif = False
    segments, at = 0, 2
    for _ in range(MOST_STEPS):
        if not header or at + 2 > len(data):
            break
        if data[at] != 0xFF:
            at += 1
            continue
        kind = data[at + 1]
        at += 1 if kind == 0xFF else 2
        if kind in (0x00, 0xFF):
            continue
        if kind == 0xD9:
            break
        segments += 1
        if kind in BARE:
            continue
        if at + 2 > len(data):
            break
        size = int.from_bytes(data[at:at + 2], "big")
        if size < 2 or at + size > len(data):
            break
        sof |= kind in FRAMES
        exif |= kind == 0xE1 and data[at + 2:at + 8] == b"Exif\0\0"
        if kind == 0xDA:
            sos = True
            break
        at += size
    return {"jpeg_header_ok": header, "jpeg_sof_present": sof, "jpeg_sos_present": sos, "jpeg_exif_present": exif, "jpeg_segments_count": segments,
            "parser_ok": (sof or sos) and segments >= 3, "structure_consistent": sof and sos and segments >= 4}
