"""Settings: defaults, kinds, rules across sections, and what the engine makes of them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fathomline.__main__ import main
from fathomline.operators import events
from fathomline.sources import settings

LEAST = {"monitor": {"monitored_directories": ["/data", "more"]}, "storage": {"path": "out/db"}, "model": {"bundle_path": "s3://b/model"}}


def changed(**sections):
    return {**LEAST, **{s: {**LEAST.get(s, {}), **keys} if isinstance(keys, dict) else keys for s, keys in sections.items()}}


def test_defaults(tmp_path):
    s = settings.read(LEAST, tmp_path)
    assert s["monitor.monitored_directories"] == ("/data", str(tmp_path / "more"))
    assert (s["storage.path"], s["model.bundle_path"], s["logging.path"]) == (str(tmp_path / "out/db"), "s3://b/model", str(tmp_path / "logs"))
    assert (s.dedup_us, s.profile_us, s["stabilization.max_attempts"], s["monitor.provider_any_keywords"]) == (500_000, 30_000_000, 20, 7824)
    assert s["monitor.event_id_map"] == events.EVENT_IDS
    f = s.filters
    assert (f.max_size, f.activity_us, f.activity_count, f.temporary, f.supported) == (100 * 1024 * 1024, 2_000_000, 10, events.TEMPORARY_EXTENSIONS, ())


def test_values_are_normalised(tmp_path):
    s = settings.read(changed(filters={"trusted_processes": ["C:\\Windows\\Backup.EXE", " tar "], "supported_extensions": ["PDF", ".txt"], "temporary_name_prefixes": ["TMP-"], "max_file_size_bytes": "0x10"}, monitor={"event_id_map": {"5": "Moved"}, "allowed_event_types": ["Created"]}), tmp_path)
    assert (s.filters.trusted, s.filters.supported, s.filters.temporary_names, s.filters.max_size) == (("backup.exe", "tar"), (".pdf", ".txt"), ("tmp-",), 16)
    assert (s["monitor.event_id_map"], s["monitor.allowed_event_types"]) == ({5: "moved"}, ("created",))


@pytest.mark.parametrize(("values", "message"), [
    ([1], "mapping of sections"), ({**LEAST, "montior": {}}, "unknown section: montior"), (changed(filters={"max_size": 1}), "unknown key: filters.max_size"), (changed(monitor="x"), "monitor has to be a mapping"),
    ({**LEAST, "storage": {}}, "storage.path is missing"), (changed(monitor={"monitored_directories": None}), "monitored_directories is missing"), (changed(monitor={"monitored_directories": []}), "monitored_directories is empty"),
    (changed(monitor={"monitored_directories": "/data"}), "has to be a list"), (changed(monitor={"allowed_event_types": []}), "allowed_event_types is empty"), (changed(monitor={"allowed_event_types": ["read"]}), "no event type: 'read'"),
    (changed(monitor={"etw_enabled": False}), "no source"), (changed(monitor={"event_id_map": [1]}), "event_id_map has to be a mapping"), (changed(monitor={"dedup_window_ms": 0}), "dedup_window_ms has to be at least 1"),
    (changed(scoring={"window_seconds": "soon"}), "window_seconds is no integer"), (changed(stabilization={"stable_checks": 21}), "above stabilization.max_attempts"), (changed(logging={"level": "loud"}), "logging.level"),
    (changed(logging={"backup_count": -1}), "backup_count has to be at least 0"), (changed(storage={"path": "/data/db"}), "storage.path is in a monitored"), (changed(logging={"path": "/data/logs"}), "logging.path is in a monitored")])
def test_what_is_wrong_is_named(tmp_path, values, message):
    with pytest.raises(settings.ConfigurationError, match=message):
        settings.read(values, tmp_path)


def test_ignored_folders_may_hold_output(tmp_path):
    settings.read(changed(monitor={"ignored_directories": ["/data/own"]}, storage={"path": "/data/own/db"}, logging={"path": "/data/own"}), tmp_path)


def test_files(tmp_path, capsys):
    at = tmp_path / "s.yaml"
    at.write_text("monitor: {monitored_directories: [watched]}\nstorage: {path: db}\nmodel: {bundle_path: m}\nfilters:\n")
    assert settings.load(at)["monitor.monitored_directories"] == (str(tmp_path / "watched"),)
    assert main(["check-settings", str(at)]) == 0
    (tmp_path / "logs").write_text("x")
    for text, message in (("monitor: [", "no YAML"), ("", "missing"), (at.read_text(), "logging.path is a file")):
        at.write_text(text)
        assert main(["check-settings", str(at)]) == 1
        assert message in capsys.readouterr().out
    assert main(["check-settings", str(tmp_path / "none")]) == 1


def test_the_engine_filters_by_them(spark, tmp_path):
    s = settings.read(changed(filters={"temporary_name_prefixes": ["Draft-"], "trusted_processes": ["ok.exe"]}, monitor={"ignored_directories": ["/data/skip"]}), tmp_path)
    rows = [(1, "/data/a.txt", "x"), (2, "/data/draft-a.txt", "x"), (3, "/data/skip/a.txt", "x"), (4, "/else/a.txt", "x"), (5, "/data/a.tmp", "x"), (6, "/data/a.txt", "/bin/OK.exe")]
    df = spark.createDataFrame(rows, "event_id int, file_path string, process_name string").withColumns({"event_type": F.lit("modified"), "process_key": F.lit("p"), "file_extension": F.regexp_extract("file_path", r"(\.\w+)$", 1), "file_size": F.lit(1), "us": F.col("event_id").cast("long")})
    found = {r["event_id"]: r["filter_reason"].partition(";")[0] for r in events.prefilter(df, s.filters).collect()}
    assert found == {1: "accepted", 2: "temporary_or_service_file", 3: "ignored_directory", 5: "temporary_or_service_file", 6: "trusted_process"}
