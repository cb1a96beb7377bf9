"""gzip, RAR, ZIP and 7z containers."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

KIB = 1024
# Gzip flag bits, RAR block types, ZIP record signatures and methods, 7z property ids.
FHCRC, FEXTRA, FNAME, FCOMMENT = 0x02, 0x04, 0x08, 0x10
RAR4, RAR5 = b"Rar!\x1a\x07\x00", b"Rar!\x1a\x07\x01\x00"
RAR_MAIN, RAR_FILE, RAR_END, RAR_ADD_SIZE = 0x73, 0x74, 0x7B, 0x8000
EOCD, CENTRAL, EOCD_WINDOW = b"PK\x05\x06", b"PK\x01\x02", 65_558
AES_EXTRA, AES_METHOD = 0x9901, 99
SEVEN_MAGIC = b"7z\xbc\xaf\x27\x1c"
K_END, K_HEADER, K_ARCHIVE, K_ADDITIONAL, K_MAIN, K_FILES, K_ENCODED = 0x00, 0x01, 0x02, 0x03, 0x04, 0x05, 0x17
SEVEN_AES = bytes.fromhex("06F10701")


def gzip(data: bytes) -> dict | None:
    """The fixed header and its optional fields, in the first 64 KiB."""
    data = data[:64 * KIB]
    out = dict.fromkeys(("gzip_header_ok", "gzip_mtime_present", "gzip_name_present", "parser_ok", "structure_consistent"), False)
    if len(data) < 10 or data[:3] != b"\x1f\x8b\x08":
        return out
    flags, at, named, ok = data[3], 10, False, True
    if flags & FEXTRA:
        ok = at + 2 <= len(data)
        at += 2 + (int.from_bytes(data[at:at + 2], "little") if ok else 0)
        ok = ok and at <= len(data)
    for flag in (FNAME, FCOMMENT):
        if ok and flags & flag:
            end = data.find(b"\0", at)
            ok = end >= 0
            named |= ok and flag == FNAME and end > at
            at = end + 1
    if ok and flags & FHCRC:
        ok = at + 2 <= len(data)
    return {"gzip_header_ok": ok, "gzip_mtime_present": data[4:8] != b"\0\0\0\0", "gzip_name_present": named, "parser_ok": ok, "structure_consistent": ok}


def rar(data: bytes) -> dict | None:
    if data.startswith(RAR5):
        size, kind = (int.from_bytes(data[8:12], "little"), data[12]) if len(data) > 12 else (0, 0)
        sane = 0 < size < 65_536 and 1 <= kind <= 0x7F
        return {"rar_header_ok": True, "rar_main_header_flags_ok": sane, "rar_file_records_count": 0, "rar_version_5": True, "parser_ok": True, "structure_consistent": sane}
    header = data.startswith(RAR4)
    main, files, end, at = False, 0, False, len(RAR4)
    while header and at + 7 <= len(data):
        _, kind, flags, size = struct.unpack_from("<HBHH", data, at)
        extra = int.from_bytes(data[at + 7:at + 11], "little") if flags & RAR_ADD_SIZE or kind == RAR_FILE else 0
        if size < 7 or at + size > len(data):
            break
        main |= kind == RAR_MAIN
        files += kind == RAR_FILE
        end |= kind == RAR_END
        at += size + extra
        if end:
            break
    ok = header and main
    return {"rar_header_ok": header, "rar_main_header_flags_ok": main, "rar_file_records_count": files, "rar_version_5": False, "parser_ok": ok, "structure_consistent": ok and files >= 1}


def _eocd(data: bytes) -> tuple[int, int, int, int, int] | None:
    """Where the end record is, its entries, and the directory's size, offset and comment length."""
    lo = max(0, len(data) - EOCD_WINDOW)
    at = data.rfind(EOCD, lo)
    if at < 0 or at + 22 > len(data):
        return None
    entries, size, offset, comment = struct.unpack_from("<HIIH", data, at + 10)
    return at, entries, size, offset, comment


def _central(data: bytes, offset: int, entries: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """flags, method, crc, name, extra of the directory's records."""
    at = offset
    for _ in range(entries):
        if data[at:at + 4] != CENTRAL or at + 46 > len(data):
            return
        flags, method = struct.unpack_from("<HH", data, at + 8)
        crc = int.from_bytes(data[at + 16:at + 20], "little")
        n, e, c = struct.unpack_from("<HHH", data, at + 28)
        yield flags, method, crc, data[at + 46:at + 46 + n], data[at + 46 + n:at + 46 + n + e]
        at += 46 + n + e + c


def zip_structure(data: bytes) -> dict | None:
    end = _eocd(data)
    if end is None:
        return None
    at, entries, size, offset, comment = end
    records = list(_central(data, offset, entries))
    n = len(records)
    offset_ok = offset + size <= at
    cd_ok = n == entries and (n > 0 or entries == 0)
    utf8 = round(sum(bool(r[0] & 0x800) for r in records) / n, 6) if n else 0.0
    with_crc = round(sum(r[2] != 0 for r in records) / n, 6) if n else 0.0
    ok = cd_ok and offset_ok and n >= 1
    return {"zip_central_dir_ok": cd_ok, "zip_cd_offset_ok": offset_ok, "zip_entry_count": n, "zip_has_content_types": any(r[3] == b"[Content_Types].xml" for r in records), "zip_comment_len": comment,
            "zip_names_utf8_fraction": utf8, "zip_crc_present_fraction": with_crc, "parser_ok": ok, "structure_consistent": ok and with_crc >= 0.65}


def zip_encryption(data: bytes) -> dict | None:
    end = _eocd(data)
    records = list(_central(data, end[3], end[1])) if end else []
    methods, locked = set(), 0
    for flags, method, _, _, extra in records:
        if not flags & 1:
            continue
        locked += 1
        at, aes = 0, method == AES_METHOD
        while at + 4 <= len(extra):
            kind, size = struct.unpack_from("<HH", extra, at)
            aes |= kind == AES_EXTRA
            at += 4 + size
        methods.add("AES" if aes else "ZipCrypto")
    name = None if not methods else "Mixed" if len(methods) > 1 else methods.pop()
    return {"zip_any_entry_encrypted": locked > 0, "zip_all_headers_encrypted": bool(records) and locked == len(records), "zip_encryption_method": name}


class _Cursor:
    """Reads 7z's numbers; running off the end is a ValueError."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("7z header is cut short")
        self.at += n
        return self.data[self.at - n:self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        """The first byte's leading ones say how many little-endian bytes follow; its other bits are the top ones."""
        first, value = self.byte(), 0
        for i in range(8):
            if not first & (0x80 >> i):
                return value + ((first & ((0x80 >> i) - 1)) << (8 * i))
            value += self.byte() << (8 * i)
        return value


def _seven_header(data: bytes) -> tuple[dict, bytes | None]:
    """The signature header's tests, and the next header's bytes if they are there."""
    out = dict.fromkeys(("7zip_start_header_crc_valid", "7zip_next_header_layout_valid", "7zip_next_header_crc_valid", "7zip_header_marker_valid", "7zip_header_sections_valid"), False)
    if len(data) < 32 or not data.startswith(SEVEN_MAGIC):
        return out, None
    start_crc, = struct.unpack_from("<I", data, 8)
    offset, size, crc = struct.unpack_from("<QQI", data, 12)
    out["7zip_start_header_crc_valid"] = zlib.crc32(data[12:32]) == start_crc
    out["7zip_next_header_layout_valid"] = size > 0 and 32 + offset + size <= len(data)
    if not out["7zip_next_header_layout_valid"]:
        return out, None
    header = data[32 + offset:32 + offset + size]
    out["7zip_next_header_crc_valid"] = zlib.crc32(header) == crc
    out["7zip_header_marker_valid"] = header[:1] in (bytes([K_HEADER]), bytes([K_ENCODED]))
    return out, header


def _skip_digests(c: _Cursor, n: int) -> None:
    if c.byte():
        known = n
    else:
        bits = c.take((n + 7) // 8)
        known = sum(bin(b).count("1") for b in bits)
    c.take(4 * known)


def _skip_streams(c: _Cursor) -> None:
    """A streams section: pack info, folders, substreams, up to its end mark."""
    folders = 0
    per_folder: list[int] = []
    while (kind := c.number()) != K_END:
        if kind == 0x06:
            c.number()
            n = c.number()
            while (k := c.number()) != K_END:
                if k == 0x09:
                    for _ in range(n):
                        c.number()
                elif k == 0x0A:
                    _skip_digests(c, n)
                else:
                    raise ValueError("unknown pack property")
        elif kind == 0x07:
            if c.number() != 0x0B:
                raise ValueError("folders expected")
            folders = c.number()
            if c.byte():
                c.number()
            outs = 0
            for _ in range(folders):
                outs += _skip_folder(c)
            if c.number() != 0x0C:
                raise ValueError("sizes expected")
            for _ in range(outs):
                c.number()
            while (k := c.number()) != K_END:
                if k != 0x0A:
                    raise ValueError("unknown folder property")
                _skip_digests(c, folders)
            per_folder = [1] * folders
        elif kind == 0x08:
            while (k := c.number()) != K_END:
                if k == 0x0D:
                    per_folder = [c.number() for _ in range(folders)]
                elif k == 0x09:
                    for n in per_folder:
                        for _ in range(max(0, n - 1)):
                            c.number()
                elif k == 0x0A:
                    _skip_digests(c, sum(per_folder))
                else:
                    raise ValueError("unknown substream property")
        else:
            raise ValueError("unknown stream section")


def _skip_folder(c: _Cursor, found: list[bytes] | None = None) -> int:
    """A folder's coders; the number of its output streams."""
    ins = outs = 0
    for _ in range(c.number()):
        flags = c.byte()
        method = c.take(flags & 0x0F)
        if found is not None:
            found.append(method)
        a, b = (c.number(), c.number()) if flags & 0x10 else (1, 1)
        ins, outs = ins + a, outs + b
        if flags & 0x20:
            c.take(c.number())
    for _ in range(outs - 1):
        c.number(), c.number()
    packed = ins - (outs - 1)
    if packed > 1:
        for _ in range(packed):
            c.number()
    return outs


def _sections_valid(header: bytes) -> bool:
    """Whether sections come in order and nothing but zeros follows."""
    c = _Cursor(header)
    try:
        kind = c.byte()
        if kind == K_ENCODED:
            _skip_streams(c)
            return not any(header[c.at:])
        section = c.number()
        if section == K_ARCHIVE:
            while c.number() != K_END:
                c.take(c.number())
            section = c.number()
        for expected in (K_ADDITIONAL, K_MAIN):
            if section == expected:
                _skip_streams(c)
                section = c.number()
        if section == K_FILES:
            c.number()
            while c.number() != K_END:
                c.take(c.number())
            section = c.number()
        return section == K_END and not any(header[c.at:])
    except (ValueError, IndexError):
        return False


def seven_zip(data: bytes) -> dict | None:
    out, header = _seven_header(data)
    out["7zip_header_sections_valid"] = bool(header) and out["7zip_header_marker_valid"] and _sections_valid(header)
    ok = out["7zip_start_header_crc_valid"] and out["7zip_next_header_layout_valid"] and out["7zip_next_header_crc_valid"] and out["7zip_header_marker_valid"]
    return out | {"parser_ok": ok, "structure_consistent": ok and out["7zip_header_sections_valid"]}


def seven_zip_encryption(data: bytes) -> dict | None:
    """An AES coder in the header; an encoded header with one hides the names too."""
    _, header = _seven_header(data)
    aes = header is not None and SEVEN_AES in header
    encoded = header is not None and header[:1] == bytes([K_ENCODED])
    return {"7zip_needs_password": False, "7zip_aes_method_present": aes, "7zip_names_hidden_likely": aes and encoded}
