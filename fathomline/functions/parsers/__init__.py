"""Format parsers: bytes -> feature dict. Each is total: bad input gives its defaults or None (not applicable), never an exception that ends a job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from . import archives, images, media, office, pdf

Parser = Callable[[bytes], dict | None]


@dataclass(frozen=True)
class ParserSpec:
    """A family's structural parser, and the one that looks for encryption where the structure is sound."""

    family: str
    structure: Parser
    encryption: Parser | None = None


#: The extension point: a family is added by adding its spec (and its columns to the schema).
REGISTRY: dict[str, ParserSpec] = {
    s.family: s
    for s in (
        ParserSpec("gzip", archives.gzip), ParserSpec("jpeg", images.jpeg), ParserSpec("png", images.png), ParserSpec("mp4", media.mp4),
        ParserSpec("ole2", office.ole2, office.ole2_encryption), ParserSpec("ooxml", office.ooxml), ParserSpec("pdf", pdf.structure, pdf.encryption),
        ParserSpec("rar", archives.rar), ParserSpec("zip", archives.zip_structure, archives.zip_encryption), ParserSpec("7zip", archives.seven_zip, archives.seven_zip_encryption),
    )
}


def parse(family: str, data: bytes) -> dict:
    """The family's columns. A parser that fails or finds the file isn't its own leaves parser_ok and structure_consistent null."""
    spec = REGISTRY.get(family)
    if spec is None:
        return {}
    try:
        found = spec.structure(data)
    except Exception:  # noqa: BLE001  damaged files are data here, not errors
        found = None
    if found is None:
        return {}
    if spec.encryption and found.get("parser_ok") is True:
        try:
            found |= spec.encryption(data) or {}
        except Exception:  # noqa: BLE001
            pass
    return found
