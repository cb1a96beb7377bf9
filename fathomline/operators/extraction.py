"""The 85-column feature row of each content: sniff, structure, encryption and byte statistics in one Arrow pass.

A content crosses to Python once and never meets a shuffle; what comes back is the fixed row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from fathomline.functions import bytestats, parsers, sniff
from fathomline.functions.parsers import office
from fathomline.schema import FEATURES

EDGE = 16 * 1024
_ARROW = {"int": pa.int64(), "float": pa.float64(), "bool": pa.bool_(), "str": pa.string()}
_SQL = {"int": "long", "float": "double", "bool": "boolean", "str": "string"}


def _known(data: bytes) -> str | None:
    for family, prefixes in sniff.MAGICS:
        if data.startswith(tuple(prefixes)):
            return family
    return "mp4" if data[4:8] == b"ftyp" else None


def _package(data: bytes) -> str:
    return "ooxml" if office.is_package(data) else "zip"


def format_family(data: bytes) -> str:
    if found := _known(data):
        return found
    if data.startswith(sniff.SEVEN_ZIP):
        return "7zip"
    return _package(data) if data.startswith(tuple(sniff.ZIP)) else "other"


def magic_family(data: bytes) -> str:
    if found := _known(data):
        return found
    if data.startswith(tuple(sniff.ZIP)):
        return _package(data)
    if data.startswith((b"GIF87a", b"GIF89a")):
        return "gif"
    riff = data[8:12] if data.startswith(b"RIFF") else b""
    if riff == b"WEBP":
        return "webp"
    if data.startswith(b"ID3") or (len(data) > 1 and data[0] == 0xFF and data[1] & 0xE0 == 0xE0):
        return "mp3"
    if riff == b"WAVE":
        return "wav"
    for family, prefixes in sniff.OTHER_MAGICS:
        if data.startswith(tuple(prefixes)):
            return family
    if data[sniff.TAR_AT:sniff.TAR_AT + len(sniff.TAR)] == sniff.TAR:
        return "tar"
    if data.startswith(b"MZ"):
        return "pe"
    if data.startswith(b"\x7fELF"):
        return "elf"
    return "7zip" if data.startswith(sniff.SEVEN_ZIP) else "unknown"


def fallback_family(data: bytes) -> str:
    """For contents without a magic: marks of a PDF or a package anywhere in head and tail; both is an error."""
    ends = data[:EDGE] + data[-EDGE:]
    as_pdf = b"%PDF-" in data[:EDGE] or (b"startxref" in ends and b"%%EOF" in ends)
    as_package = office.is_package(data)
    return "error" if as_pdf and as_package else "pdf" if as_pdf else "ooxml" if as_package else "other"


def feature_row(data: bytes, fallback: bool = True) -> dict:
    """Exactly the schema's columns; what doesn't apply is None."""
    family, magic = format_family(data), magic_family(data)
    magic_ok = magic != "unknown"
    used = fallback and not magic_ok
    second = fallback_family(data) if used else None
    effective = second if family == "other" and second is not None else family
    found = bytestats.statistics(data) | {"magic_ok": magic_ok, "format_family": family, "magic_family": magic, "fallback_used": used, "fallback_format_family": second} | parsers.parse(effective, data)
    return {c: found.get(c) for c in FEATURES}


def features(files: DataFrame, key: str, fallback: bool = True, most_bytes: int | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """key, the carried columns and the 85 features for each row of files (key, content, ...). A null content counts as empty; contents over most_bytes, where given, are left out before they are read."""
    if most_bytes is not None:
        files = files.filter(f"length(content) <= {most_bytes}")
    own = [key, *carried]
    kinds = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in own)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                rows = [feature_row(x or b"", fallback) for x in batch.column("content").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *(pa.array([r[c] for r in rows], _ARROW[k]) for c, k in FEATURES.items())], names=[*own, *FEATURES])

    return files.select(*own, "content").mapInArrow(run, f"{kinds}, " + ", ".join(f"`{c}` {_SQL[k]}" for c, k in FEATURES.items()))


def augmented_rows(features_of_augmented: DataFrame, parents: DataFrame) -> DataFrame:
    """Dataset rows of augmented contents: features_of_augmented(name, algorithm, features...) under the ransomware naming with the mark taken off, and the pair_id of the file each comes from (parents: name, pair_id)."""
    from pyspark.sql import functions as F

    from fathomline.functions import naming

    m = features_of_augmented.withColumn("_m", naming.parts(F.col("name"), naming.RANSOMWARE_NAME)).withColumn("extra", naming.strip_aug(F.col("_m.extra")))
    m = m.withColumn("group_id", naming.group_id(F.col("_m"), F.col("name")))
    m = m.withColumns({"sequence_id": F.col("_m.sequence_id"), "orig_ext": F.col("_m.orig_ext"), "curr_ext": F.col("_m.curr_ext"), "pair_id": naming.pair_id(F.col("group_id"), F.col("extra")),
                       "gt_class": F.lit("ransomware-encrypted"), "is_augmented": F.lit(True), "aug_encryption": F.col("algorithm")})
    source = parents.select(naming.add_aug(F.col("name")).alias("_of"), F.col("pair_id").alias("aug_parent"))
    return m.join(source, m.name == F.col("_of"), "left").withColumnRenamed("name", "path").drop("_m", "_of", "algorithm")
