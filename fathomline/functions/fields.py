"""Loose records: flattening JSON events, tolerant JSON reading, display text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NO_KEY = re.compile("[^A-Za-z0-9_]")


def normal_key(key: Column) -> Column:
    """Keys are compared by their letters, digits and underscores, in lower case."""
    return F.lower(F.regexp_replace(key, "[^A-Za-z0-9_]", ""))


class _Number(str):
    """A number as it is written."""


def _written(value) -> str:
    if isinstance(value, _Number):
        return value
    if isinstance(value, list):
        return "[" + ",".join(map(_written, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{_written(k)}:{_written(v)}" for k, v in value.items()) + "}"
    return json.dumps(value, ensure_ascii=False)


def leaves(text: str | None) -> dict[str, str | None]:
    """A JSON object's leaves under normal keys, to any depth that the JSON reader takes, as text: numbers as they are written, lists as JSON."""
    try:
        source = json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_Number) if text else None
    except (ValueError, RecursionError):
        return {}
    found: dict[str, str | None] = {}
    stack = [iter(source.items())] if isinstance(source, dict) else []
    while stack:
        for key, value in stack[-1]:
            if isinstance(value, dict):
                stack.append(iter(value.items()))  # opened in place; the rest of this level comes after it
                break
            name = _NO_KEY.sub("", key).lower()
            if found.get(name) in (None, ""):
                found[name] = value if value is None or isinstance(value, str) else _written(value)
        else:
            stack.pop()
    return found


def _leaves(text: pd.Series) -> pd.Series:
    return text.map(leaves)


def flatten(text: Column) -> Column:
    """map<string,string> of a JSON object's leaves under normal keys. Nested objects are opened in place, depth first; of equal keys the first that isn't empty wins; malformed text gives an empty map. Depth is unbounded, which no built-in expression can follow, so texts go through Python in Arrow batches."""
    return F.pandas_udf(_leaves, T.MapType(T.StringType(), T.StringType()))(text)


def parse_json(text: Column) -> Column:
    """struct(ok, value): the payload as canonical JSON; nothing is fine and null; malformed text is not ok and comes back as it is."""
    parsed = F.try_parse_json(text)
    empty = text.isNull() | (F.trim(text) == "")
    return F.struct((empty | parsed.isNotNull()).alias("ok"), F.when(empty, F.lit(None).cast("string")).when(parsed.isNotNull(), F.to_json(parsed)).otherwise(text).alias("value"))


def display(value: Column, kind: str = "text") -> Column:
    """Text for people: numbers with six decimals, probabilities as percent, nothing as a dash."""
    shown = {"number": F.format_string("%.6f", value.cast("double")), "probability": F.concat(F.format_string("%.2f", value.cast("double") * 100), F.lit("%"))}.get(kind, value.cast("string"))
    return F.when(value.isNull(), F.lit("—")).otherwise(shown)
