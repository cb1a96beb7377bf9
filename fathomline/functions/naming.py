"""File-name metadata, group and pair ids, augmentation markers: pure Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a file name's parts must look like.
DEFAULT_NAME = r"(?s)^([^-]+)-([^-.]+)(?:[-.](.*))?\.([^.]+)$"
RANSOMWARE_NAME = r"(?s)^([^-]+)-([^-.]+)(?:-([^.]+))?\.(.+)$"
NUMBER = r"^\s*[+-]?\d+\s*$"
AUG_MARK = r"(?i)\b-?aug\b"


def parts(name: Column, pattern: str) -> Column:
    """struct(sequence_id, orig_ext, extra, curr_ext); all null unless the name has that form and starts with a number."""
    first = F.regexp_extract(name, pattern, 1)
    number = F.when(first.rlike(NUMBER), F.trim(first)).try_cast("int")
    ok = number.isNotNull()
    return F.struct(number.alias("sequence_id"), *(F.when(ok, F.regexp_extract(name, pattern, i)).alias(c) for i, c in ((2, "orig_ext"), (3, "extra"), (4, "curr_ext"))))


def metadata(name: Column, gt_class: Column) -> Column:
    """Encrypted-by-ransomware files carry everything after the first dot as their present extension."""
    return F.when(gt_class == "ransomware-encrypted", parts(name, RANSOMWARE_NAME)).otherwise(parts(name, DEFAULT_NAME))


def group_id(meta: Column, name: Column) -> Column:
    return F.coalesce(F.concat(meta["sequence_id"].cast("string"), F.lit("-"), meta["orig_ext"]), name)


def pair_id(group: Column, extra: Column) -> Column:
    return F.when(F.coalesce(extra, F.lit("")) != "", F.concat(group, F.lit("-"), extra)).otherwise(group)


def strip_aug(extra: Column) -> Column:
    """extra without its augmentation mark: no dashes at the ends, single ones inside."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(extra, AUG_MARK, ""), "^-+|-+$", ""), "-{2,}", "-")


def add_aug(name: Column) -> Column:
    return F.regexp_replace(name, r"(\.[^.]+)$", "-aug$1")


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]+)$", 1))


def normal_path(path: Column, devices: dict[str, str]) -> Column:
    """Windows paths: NT prefixes off, devices to drives, forward slashes."""
    p = F.regexp_replace(path, r"^\\(?:\?\?|\\\?)\\", "")
    p = F.when(p.startswith("\\Device\\Mup\\"), F.concat(F.lit("\\\\"), F.substring(p, 13, 1 << 20))).otherwise(p)
    for device, drive in devices.items():
        p = F.when(p.startswith(device + "\\"), F.concat(F.lit(drive), F.substring(p, len(device) + 1, 1 << 20))).otherwise(p)
    return F.replace(p, F.lit("\\"), F.lit("/"))
