"""The runtime's settings: a YAML file by sections, every key with its kind and default in one table, rules across sections, and the engine's own configurations made of them."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from fathomline.operators import events


class ConfigurationError(ValueError):
    """Names the section and key that is wrong."""


KINDS = ("created", "modified", "moved", "deleted")
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


def _number(least: int) -> Callable[[str, Any, Path], int]:
    def read(name: str, value: Any, _: Path) -> int:
        try:
            found = int(value, 0) if isinstance(value, str) else int(value)
        except (TypeError, ValueError):
            raise ConfigurationError(f"{name} is no integer: {value!r}") from None
        if found < least:
            raise ConfigurationError(f"{name} has to be at least {least}, not {found}")
        return found

    return read


def _flag(name: str, value: Any, _: Path) -> bool:
    return bool(value)


def _text(name: str, value: Any, _: Path) -> str:
    return str(value)


def _place(name: str, value: Any, base: Path) -> str:
    """Relative to the settings' folder; a URI stays as it is."""
    text = str(value)
    return text if "://" in text else os.path.normpath(base / Path(text).expanduser())


def _listed(each: Callable[[str, Any, Path], Any]) -> Callable[[str, Any, Path], tuple]:
    def read(name: str, value: Any, base: Path) -> tuple:
        if not isinstance(value, list | tuple):
            raise ConfigurationError(f"{name} has to be a list")
        return tuple(each(f"{name}[{i}]", x, base) for i, x in enumerate(value))

    return read


def _kind(name: str, value: Any, _: Path) -> str:
    if str(value).lower() not in KINDS:
        raise ConfigurationError(f"{name} is no event type: {value!r}")
    return str(value).lower()


def _numbered(name: str, value: Any, base: Path) -> dict[int, str]:
    if not isinstance(value, dict):
        raise ConfigurationError(f"{name} has to be a mapping")
    return {_number(0)(f"{name}: {k!r}", k, base): _kind(f"{name}[{k}]", v, base) for k, v in value.items()}


def _extension(name: str, value: Any, _: Path) -> str:
    text = str(value).strip().lower()
    return text if text.startswith(".") else f".{text}"


def _process(name: str, value: Any, _: Path) -> str:
    return str(value).strip().replace("\\", "/").rpartition("/")[2].lower()


def _lower(name: str, value: Any, _: Path) -> str:
    return str(value).lower()


NEEDED = object()
# The names of sections and keys, and their defaults. Beside each, what reads it.
TABLE: dict[str, dict[str, tuple[Callable[[str, Any, Path], Any], Any]]] = {
    "monitor": {
        "monitored_directories": (_listed(_place), NEEDED), "ignored_directories": (_listed(_place), ()), "etw_enabled": (_flag, True), "directory_fallback_enabled": (_flag, False), "system_logger_mode": (_flag, True),
        "allowed_event_types": (_listed(_kind), KINDS), "dedup_window_ms": (_number(1), 500), "provider_name": (_text, "Microsoft-Windows-Kernel-File"), "provider_guid": (_text, "{EDD08927-9CC4-4E65-B970-C2560FB5C289}"),
        "provider_any_keywords": (_number(0), 0x1E90), "event_id_map": (_numbered, events.EVENT_IDS)},
    "filters": {
        "trusted_processes": (_listed(_process), ()), "supported_extensions": (_listed(_extension), ()), "ignored_extensions": (_listed(_extension), events.TEMPORARY_EXTENSIONS), "temporary_name_prefixes": (_listed(_lower), events.TEMPORARY_NAMES),
        "max_file_size_bytes": (_number(1), 100 * 1024 * 1024), "activity_window_seconds": (_number(1), 2), "high_activity_threshold": (_number(1), 10)},
    "stabilization": {"interval_ms": (_number(1), 250), "stable_checks": (_number(1), 3), "max_attempts": (_number(1), 20)},
    "processing": {"queue_size": (_number(1), 1024), "workers": (_number(1), 2), "extraction_fallback": (_flag, True)},
    "scoring": {"window_seconds": (_number(1), 30)},
    "storage": {"path": (_place, NEEDED)},
    "model": {"bundle_path": (_place, NEEDED)},
    "logging": {"path": (_place, "logs"), "level": (lambda n, v, b: str(v).upper(), "INFO"), "max_bytes": (_number(1), 5 * 1024 * 1024), "backup_count": (_number(0), 3)},
}


def _inside(path: str, folders: tuple[str, ...]) -> bool:
    return any(path == d or path.startswith(d.rstrip("/") + "/") for d in folders)


def _unwatched(s: dict[str, dict[str, Any]], section: str) -> bool:
    """Whether what is written there makes no events of its own."""
    at = s[section]["path"]
    return not _inside(at, s["monitor"]["monitored_directories"]) or _inside(at, s["monitor"]["ignored_directories"])


#: What has to hold across keys, and what is said if it doesn't.
RULES: list[tuple[Callable[[dict[str, dict[str, Any]]], bool], str]] = [
    (lambda s: bool(s["monitor"]["monitored_directories"]), "monitor.monitored_directories is empty"),
    (lambda s: bool(s["monitor"]["allowed_event_types"]), "monitor.allowed_event_types is empty"),
    (lambda s: s["monitor"]["etw_enabled"] or s["monitor"]["directory_fallback_enabled"], "monitor.etw_enabled and monitor.directory_fallback_enabled are both off: there is no source"),
    (lambda s: s["stabilization"]["stable_checks"] <= s["stabilization"]["max_attempts"], "stabilization.stable_checks is above stabilization.max_attempts"),
    (lambda s: s["logging"]["level"] in LEVELS, "logging.level isn't known"),
    (lambda s: not os.path.isfile(s["logging"]["path"]), "logging.path is a file, not a folder"),
    (lambda s: _unwatched(s, "storage"), "storage.path is in a monitored directory that monitor.ignored_directories doesn't leave out"),
    (lambda s: _unwatched(s, "logging"), "logging.path is in a monitored directory that monitor.ignored_directories doesn't leave out"),
]


@dataclass(frozen=True)
class Settings:
    """values: by section and key, all of TABLE."""

    values: dict[str, dict[str, Any]]

    def __getitem__(self, name: str) -> Any:
        """`section.key`."""
        section, key = name.split(".")
        return self.values[section][key]

    @property
    def filters(self) -> events.FilterConfig:
        f = self.values["filters"]
        return events.FilterConfig(
            ignored=self["monitor.ignored_directories"], monitored=self["monitor.monitored_directories"], trusted=f["trusted_processes"], supported=f["supported_extensions"], max_size=f["max_file_size_bytes"],
            activity_us=f["activity_window_seconds"] * 1_000_000, activity_count=f["high_activity_threshold"], temporary=f["ignored_extensions"], temporary_names=f["temporary_name_prefixes"])

    @property
    def dedup_us(self) -> int:
        return self["monitor.dedup_window_ms"] * 1000

    @property
    def profile_us(self) -> int:
        return self["scoring.window_seconds"] * 1_000_000


def read(values: object, base: Path) -> Settings:
    """Settings of a YAML file's contents. Unknown sections and keys are errors, for they are misspelt ones; null is a key that isn't there."""
    if not isinstance(values, dict):
        raise ConfigurationError("the settings have to be a mapping of sections")
    if unknown := sorted({*values} - {*TABLE}, key=str):
        raise ConfigurationError(f"unknown section: {unknown[0]}")
    out: dict[str, dict[str, Any]] = {}
    for section, keys in TABLE.items():
        given = values.get(section)
        given = {} if given is None else given
        if not isinstance(given, dict):
            raise ConfigurationError(f"{section} has to be a mapping")
        if unknown := sorted({*given} - {*keys}, key=str):
            raise ConfigurationError(f"unknown key: {section}.{unknown[0]}")
        out[section] = {}
        for key, (reader, default) in keys.items():
            value = given.get(key)
            if value in (None, ""):
                if default is NEEDED:
                    raise ConfigurationError(f"{section}.{key} is missing")
                value = default
            out[section][key] = reader(f"{section}.{key}", value, base)
    for holds, message in RULES:
        if not holds(out):
            raise ConfigurationError(message)
    return Settings(out)


def load(path: str | Path) -> Settings:
    """The settings of a file; paths in it are relative to its folder."""
    import yaml

    at = Path(path).expanduser().resolve()
    if not at.is_file():
        raise ConfigurationError(f"no settings at {at}")
    try:
        values = yaml.safe_load(at.read_text(encoding="utf-8"))
    except yaml.YAMLError as e:
        raise ConfigurationError(f"{at} is no YAML: {e}") from None
    return read({} if values is None else values, at.parent)
