"""OLE2 compound files and OOXML packages."""

from __future__ import annotations

import io
import struct
import zipfile
from xml.etree import ElementTree

OLE_MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
# Special sector numbers, directory entry layout and kinds, streams of the office applications.
END_OF_CHAIN, FREE, MOST_SECTORS = 0xFFFFFFFE, 0xFFFFFFFF, 200_000
ENTRY, KINDS = 128, {0, 1, 2, 5}
DOCUMENT_STREAMS = {"worddocument": "doc", "workbook": "xls", "book": "xls", "powerpoint document": "ppt"}
EXPECTED = {"worddocument", "workbook", "powerpoint document"}
SUMMARY = "\x05summaryinformation"
FIB_ENCRYPTED, FIB_RESERVED, XLS_FILEPASS, XLS_FILESHARING, PPT_ENCRYPTED_USER, PPT_CRYPT = 0x0100, 0x0800, 0x2F, 0x5B, 0xF3D1C4DF, 0x2F14
CORE_PARTS = ("word/document.xml", "xl/workbook.xml", "ppt/presentation.xml")
MOST_RELATIONS = 21


class Compound:
    """Sector chains and the directory of an OLE2 file."""

    def __init__(self, data: bytes):
        if len(data) < 512 or not data.startswith(OLE_MAGIC):
            raise ValueError("not a compound file")
        self.data = data
        self.size = 1 << struct.unpack_from("<H", data, 0x1E)[0]
        self.first_dir, = struct.unpack_from("<I", data, 0x30)
        self.cutoff, self.first_mini, self.n_mini, self.first_difat, self.n_difat = struct.unpack_from("<5I", data, 0x38)
        sectors = [s for s in struct.unpack_from("<109I", data, 0x4C) if s < END_OF_CHAIN - 1]
        at, seen = self.first_difat, 0
        while at < END_OF_CHAIN - 1 and seen < self.n_difat and seen < MOST_SECTORS:
            block = self.sector(at)
            numbers = struct.unpack(f"<{len(block) // 4}I", block[: len(block) // 4 * 4])
            sectors += [s for s in numbers[:-1] if s < END_OF_CHAIN - 1]
            at, seen = (numbers[-1] if numbers else END_OF_CHAIN), seen + 1
        fat = b"".join(self.sector(s) for s in sectors[:MOST_SECTORS])
        self.fat = struct.unpack(f"<{len(fat) // 4}I", fat[: len(fat) // 4 * 4])
        self.entries = self._directory()
        self.mini = b""

    def sector(self, n: int) -> bytes:
        return self.data[(n + 1) * self.size:(n + 2) * self.size]

    def chain(self, first: int) -> tuple[bytes, bool]:
        """A chain's bytes, and whether it ends as it should."""
        out, at, seen = [], first, set()
        while at < len(self.fat) and at not in seen and len(out) < MOST_SECTORS:
            seen.add(at)
            out.append(self.sector(at))
            at = self.fat[at]
        return b"".join(out), at == END_OF_CHAIN

    def _directory(self) -> list[tuple[str, int, int, int]]:
        raw, self.dir_ok = self.chain(self.first_dir)
        found = []
        for at in range(0, len(raw) - ENTRY + 1, ENTRY):
            n, kind = struct.unpack_from("<HB", raw, at + 0x40)
            if kind not in KINDS:
                self.dir_ok = False
                break
            if kind:
                name = raw[at:at + max(0, min(n, 64) - 2)].decode("utf-16-le", "replace")
                start, = struct.unpack_from("<I", raw, at + 0x74)
                size, = struct.unpack_from("<I", raw, at + 0x78)
                found.append((name, kind, start, size))
        return found

    def stream(self, wanted: str) -> bytes | None:
        root = next((e for e in self.entries if e[1] == 5), None)
        for name, kind, start, size in self.entries:
            if kind == 2 and name.lower() == wanted:
                if size >= self.cutoff or root is None:
                    return self.chain(start)[0][:size]
                table, _ = self.chain(self.first_mini)
                links = struct.unpack(f"<{len(table) // 4}I", table[: len(table) // 4 * 4])
                store, _ = self.chain(root[2])
                out, at, seen = [], start, set()
                while at < len(links) and at not in seen:
                    seen.add(at)
                    out.append(store[at * 64:(at + 1) * 64])
                    at = links[at]
                return b"".join(out)[:size]
        return None


def ole2(data: bytes) -> dict | None:
    if not data.startswith(OLE_MAGIC) or len(data) < 512:
        return None
    c = Compound(data)
    names = {e[0].lower() for e in c.entries if e[1] == 2}
    root = any(e[1] == 5 for e in c.entries)
    streams = sum(e[1] == 2 for e in c.entries)
    fat_ok, dir_ok = bool(c.fat), c.dir_ok and bool(c.entries)
    mini_ok = c.first_mini < END_OF_CHAIN - 1 and c.chain(c.first_mini)[1]
    expected, summary = bool(names & EXPECTED), SUMMARY in names
    ok = dir_ok and root and fat_ok and streams >= 1
    return {"ole_dir_ok": dir_ok, "ole_stream_count": streams, "ole_fat_ok": fat_ok, "ole_mini_fat_ok": mini_ok, "ole_root_entry_present": root, "ole_summaryinfo_present": summary,
            "ole_expected_streams_present": expected, "parser_ok": ok, "structure_consistent": ok and (expected or summary) and (mini_ok or streams <= 1)}


def _package_kind(info: bytes) -> str:
    major, minor = struct.unpack_from("<HH", info, 0) if len(info) >= 4 else (0, 0)
    return "Agile" if (major, minor) == (4, 4) else "Extensible" if minor == 3 else "Standard" if minor == 2 else "Unknown"


def _records(book: bytes) -> dict[int, int]:
    """The first 16 KiB's record types, and the size of the first of each."""
    at, found = 0, {}
    while at + 4 <= min(len(book), 16 * 1024):
        kind, size = struct.unpack_from("<HH", book, at)
        found.setdefault(kind, size)
        at += 4 + size
    return found


def ole2_encryption(data: bytes) -> dict | None:
    """Encryption and write-protection marks, by the application whose streams are there.

    Present: an encrypted package, the document's flag, a workbook's password record or a presentation's
    crypt token. Valid: what has to come with that mark does.
    """
    c = Compound(data)
    names = [e[0].lower() for e in c.entries if e[1] == 2]
    package, info = any(n.endswith("encryptedpackage") for n in names), any(n.endswith("encryptioninfo") for n in names)
    family = next((DOCUMENT_STREAMS[n] for n in names if n in DOCUMENT_STREAMS), "ooxml" if package else None)
    locked = valid = guarded = False
    if family == "ooxml":
        locked, valid = True, info
    elif family == "doc":
        fib = c.stream("worddocument") or b""
        flags = struct.unpack_from("<H", fib, 10)[0] if len(fib) >= 12 else 0
        locked, guarded = bool(flags & FIB_ENCRYPTED), bool(flags & FIB_RESERVED)
        valid = locked and ("1table" if flags & 0x0200 else "0table") in names
    elif family == "xls":
        records = _records(c.stream("workbook") or c.stream("book") or b"")
        locked, guarded = XLS_FILEPASS in records, XLS_FILESHARING in records
        valid = records.get(XLS_FILEPASS, 0) >= 4
    elif family == "ppt":
        user = c.stream("current user") or b""
        token = len(user) >= 16 and struct.unpack_from("<I", user, 12)[0] == PPT_ENCRYPTED_USER
        record = struct.pack("<H", PPT_CRYPT) in (c.stream("powerpoint document") or b"")
        locked, valid = token or record, token and record
    return {"encrypted_package_present": package, "ooxml_encryption_info_present": info, "ooxml_encryption_type": _package_kind(c.stream("encryptioninfo") or b"") if info else None,
            "ole_format_family": family, "ole_encryption_present": locked, "ole_encryption_struct_valid": valid, "ole_write_protection_present": guarded}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def is_package(data: bytes) -> bool:
    """Whether a ZIP holds content types and a relationship part, as office packages do."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = set(z.namelist())
    except Exception:  # noqa: BLE001
        return False
    return "[Content_Types].xml" in names and any(n.endswith(".rels") for n in names)


def _resolve(base: str, target: str) -> str:
    parts = [] if target.startswith("/") else [p for p in base.split("/") if p]
    for p in target.replace("\\", "/").split("/"):
        if p == "..":
            parts = parts[:-1]
        elif p not in ("", "."):
            parts.append(p)
    return "/".join(parts).lower()


def ooxml(data: bytes) -> dict | None:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        lower = {n.lower() for n in names}
        detected = "[Content_Types].xml" in names
        core = any(p in lower for p in CORE_PARTS)
        types_ok = rels_ok = False
        relations = 0
        if detected:
            try:
                root = ElementTree.fromstring(z.read("[Content_Types].xml"))
                overrides = {o.get("PartName", "").lstrip("/").lower() for o in root if _local(o.tag) == "Override"}
                types_ok = _local(root.tag) == "Types" and bool(overrides & set(CORE_PARTS))
            except (ElementTree.ParseError, KeyError, zipfile.BadZipFile):
                types_ok = False
        for n in names:
            if not n.lower().endswith(".rels"):
                continue
            try:
                root = ElementTree.fromstring(z.read(n))
            except (ElementTree.ParseError, KeyError, zipfile.BadZipFile):
                continue
            if _local(root.tag) != "Relationships":
                continue
            base = n.rpartition("_rels/")[0]
            for r in root:
                relations = min(relations + 1, MOST_RELATIONS)
                if r.get("TargetMode", "").lower() != "external" and r.get("Type", "").endswith("/officeDocument"):
                    rels_ok |= _resolve(base, r.get("Target", "")) in lower
    ok = detected and types_ok and (core or rels_ok)
    return {"ooxml_detected": detected, "ooxml_coreparts_present": core, "ooxml_rel_count": relations, "ooxml_pkg_ok": detected and core, "ooxml_content_types_valid": types_ok,
            "ooxml_relationships_graph_valid": rels_ok, "parser_ok": ok, "structure_consistent": ok and core and rels_ok}
