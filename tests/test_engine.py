"""Rules, limits and edge cases of single operators."""

from __future__ import annotations

import gzip as gz
import io
import json
import struct
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomline import schema
from fathomline.functions import bytestats, naming, parsers
from fathomline.operators import evaluation, events, extraction, profiles, repository, sampling, vectorise
from fathomline.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# --- scores, levels, responses


def profile(spark, **values):
    base = {"events_in_window": 1, "classified_events_count": 0, "ransomware_encrypted_count": 0, "ransomware_ratio": 0.0, "max_ransomware_probability": 0.0, "avg_ransomware_probability": 0.0, "touched_files_unique": 1, "consecutive_ransomware_hits": 0}
    return spark.createDataFrame([base | values])


def test_one_positive_event_scores_forty(spark):
    r = profiles.respond(profiles.with_score(profile(spark, classified_events_count=1, ransomware_encrypted_count=1, ransomware_ratio=1.0, max_ransomware_probability=0.95, avg_ransomware_probability=0.95, consecutive_ransomware_hits=1))).first()
    assert (r["suspicion_score"], r["threat_level"], r["requested_action"], r["executed_action"]) == (40, "medium", "warn", "log")


def test_score_is_capped(spark):
    r = profiles.with_score(profile(spark, events_in_window=99, classified_events_count=9, ransomware_encrypted_count=9, ransomware_ratio=1.0, max_ransomware_probability=1.0, avg_ransomware_probability=1.0, touched_files_unique=50, consecutive_ransomware_hits=9)).first()
    assert r["suspicion_score"] == 100


@pytest.mark.parametrize(("score", "level"), [(0, "low"), (29, "low"), (30, "medium"), (59, "medium"), (60, "high"), (79, "high"), (80, "critical"), (100, "critical")])
def test_levels(spark, score, level):
    assert one(spark, profiles.threat_level(F.lit(score))) == level


def test_level_outside_range_is_an_error(spark):
    with pytest.raises(Exception, match="score outside"):
        one(spark, profiles.threat_level(F.lit(101)))


def made(spark, rows):
    return spark.createDataFrame([(str(i), "p", int(us * 1e6), f"/f{i}", c, p) for i, (us, c, p) in enumerate(rows)], "event_id string, process_key string, us long, file_path string, predicted_class string, probability double")


def test_consecutive_hits_and_eviction(spark):
    R, B = "ransomware-encrypted", "benign"
    found = {r["event_id"]: r for r in profiles.profiles(made(spark, [(2, R, 0.9), (0, B, 0.1), (1, R, 0.9), (40, B, 0.1)])).collect()}
    assert found["0"]["consecutive_ransomware_hits"] == 2
    assert (found["3"]["events_in_window"], found["3"]["consecutive_ransomware_hits"]) == (1, 0)


def test_unclassified_events_do_not_end_a_streak(spark):
    R = "ransomware-encrypted"
    found = {r["event_id"]: r["consecutive_ransomware_hits"] for r in profiles.profiles(made(spark, [(0, R, 0.9), (1, None, None), (2, R, 0.9)])).collect()}
    assert found["2"] == 2


def test_latest_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, v int, s string")
    assert {tuple(r) for r in profiles.latest(df, "k", "v").collect()} == {("a", 2, "y"), ("b", 1, None)}


# --- events


def test_filter_decisions(spark):
    config = events.FilterConfig(ignored=("/skip",), trusted=("trusted.exe",), supported=(".txt",), max_size=4, activity_count=2)
    given_ = [("1", "deleted", "/a/x.tmp", ".tmp", 1, "p.exe"), ("2", "modified", "/skip/a.txt", ".txt", 1, "p.exe"), ("3", "modified", "/skipped/a.txt", ".txt", 1, "p.exe"), ("4", "modified", "/a/~$a.txt", ".txt", 1, "p.exe"),
              ("5", "modified", "/a/b.txt", ".txt", 1, "Trusted.EXE"), ("6", "modified", "/a/b.txt", ".txt", 9, "p.exe"), ("7", "modified", "/a/b.bin", ".bin", 1, "unknown")]
    df = spark.createDataFrame([(i, t, p, e, s, n, f"k{i}", 0) for i, t, p, e, s, n in given_], "event_id string, event_type string, file_path string, file_extension string, file_size long, process_name string, process_key string, us long")
    found = {r["event_id"]: (r["filter_decision"], r["filter_reason"], r["event_priority"]) for r in events.prefilter(df, config).collect()}
    assert found == {"1": ("context_only", "delete_event", "high"), "2": ("drop", "ignored_directory", "low"), "3": ("pass", "accepted", "normal"), "4": ("drop", "temporary_or_service_file", "low"),
                     "5": ("drop", "trusted_process", "low"), "6": ("context_only", "file_too_large", "low"), "7": ("pass", "accepted; priority=unknown_process,unusual_extension", "high")}


def test_duplicates_chain(spark):
    df = spark.createDataFrame([(i, "p", "/A" if i else "/a", "modified", us) for i, us in enumerate([0, 400_000, 1_100_000])], "event_id int, process_key string, file_path string, event_type string, us long")
    assert [r["is_duplicate"] for r in events.deduplicate(df).orderBy("event_id").collect()] == [False, True, False]


def test_correlation_forgets(spark):
    df = spark.createDataFrame([(1, "name", "k", "/a"), (2, "use", "k", None), (3, "forget", "k", None), (4, "use", "k", None), (5, "use", "k", "/own")], "seq int, action string, file_key string, file_path string")
    assert [r["resolved_path"] for r in events.correlate(df).orderBy("seq").collect()] == ["/a", None, "/own"]


def test_event_type_and_instants(spark):
    assert one(spark, events.event_type(F.lit("Rename then Delete"), F.lit(16))) == "deleted"
    assert one(spark, events.event_type(F.lit(""), F.lit(27))) == "moved"
    assert one(spark, F.unix_micros(events.instant(F.lit("116444736000000000")))) == 0
    assert one(spark, F.unix_micros(events.instant(F.lit("1.5")))) == 1_500_000
    assert one(spark, F.unix_micros(events.instant(F.lit("1970-01-01T00:00:01Z")))) == 1_000_000
    assert one(spark, events.instant(F.lit("nonsense"))) is None


def test_stabilisation(spark):
    df = spark.createDataFrame([("f", i, s, s) for i, s in enumerate([1, 2, 2, 2, 3], 1)] + [("g", 1, 1, 1)], "file_path string, attempt int, size int, mtime int")
    assert {r["file_path"]: r["stable_attempt"] for r in events.stabilise(df).collect()} == {"f": 4, "g": None}


def test_replay(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text(json.dumps([{"event_type": "modified", "timestamp": "2026-06-18T10:00:00+00:00", "file_path": "/t/sample.bin", "process_id": 10, "process_name": "sample.exe"}]))
    r = files.read_events(spark, str(p)).first()
    assert r["process_key"] == "10:unknown" and r["event_id"] and r["file_extension"] == ".bin"


# --- repository


def test_pages_are_clamped(spark):
    p = repository.page(spark.range(26), [repository.Key(F.col("id"))], 9, 25)
    assert (p.total, p.page, p.pages, p.items.count()) == (26, 2, 2, 1)
    assert repository.page(spark.range(0), [repository.Key(F.col("id"))], 3, 7).pages == 1


def test_search_folds_ascii_only(spark):
    df = spark.createDataFrame([("ÄB",), ("äb",), ("xÄb",)], "c string")
    assert [r["c"] for r in df.filter(repository.matches("Äb", "c")).collect()] == ["ÄB", "xÄb"]


def test_search_takes_wildcards_literally(spark):
    df = spark.createDataFrame([("a%b",), ("axb",), (None,)], "c string")
    assert [r["c"] for r in df.filter(repository.matches("A%B", "c")).collect()] == ["a%b"]
    assert df.filter(repository.matches("", "c")).count() == 3
    with pytest.raises(ValueError):
        repository.distinct_values(df, "c", ())


# --- sampling


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(0, 40), min_size=1), st.integers(0, 200))
def test_quota_allocation_sums(capacity, target):
    got = sampling.allocate_by_quota(target, dict.fromkeys(capacity, 1 / len(capacity)), capacity)
    assert sum(got.values()) == min(target, sum(capacity.values()))
    assert all(got[k] <= capacity[k] for k in capacity)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1000), st.lists(st.integers(1, 9), min_size=1, max_size=6))
def test_largest_remainder_sums(total, shares):
    got = sampling.largest_remainder(total, {str(i): s / sum(shares) for i, s in enumerate(shares)})
    assert abs(sum(got.values()) - total) == 0


def test_target_count():
    assert [sampling.target_count(5, 0.5), sampling.target_count(7, 0.5), sampling.target_count(3, 0.01), sampling.target_count(0, 0.5)] == [2, 4, 1, 0]


def test_grouped_split(spark):
    df = spark.createDataFrame([(f"g{i % 40}", c) for i in range(400) for c in [schema.LABELS[(i % 40) % 3]]], "group_id string, gt_class string")
    split = sampling.grouped_split(df)
    sampling.check_split(split)
    assert split.count() == 400
    assert {r["split"] for r in split.select("split").distinct().collect()} == {"train", "valid", "test"}


def test_byte_ranges(spark):
    def ranges(size, mode):
        return [tuple(x) for x in one(spark, sampling.byte_ranges(F.lit(size).cast("long"), F.lit(mode)))]

    K = 1024
    assert ranges(10, "header-only") == [(0, 10)]
    assert ranges(21 * K * K, "header-only") == [(0, 64 * K)]
    assert ranges(64 * K, "intermittent") == []
    assert ranges(130 * K, "intermittent") == [(64 * K, 32 * K), (128 * K, 2 * K)]
    assert ranges(20 * K, "hybrid") == [(0, 16 * K), (16 * K, 4 * K)]
    assert ranges(5, "adaptive") == [(0, 5)] and ranges(0, "full") == []


# --- vectorising and evaluation


def test_vectoriser(spark):
    v = vectorise.Vectoriser({"flag": False}, {"byte_chi2": 0.0, "pdf_version": 0.0}, {"byte_chi2": -10.0}, {"byte_chi2": 1.0})
    r = v.transform(spark.createDataFrame([(3.0, None, None)], "byte_chi2 double, flag boolean, pdf_version double")).first()
    assert (round(r["byte_chi2"], 5), r["flag"], r["pdf_version"]) == (11.38629, 0, 0.0)


def test_fit_ties_and_nulls(spark):
    v = vectorise.fit(spark.createDataFrame([(True, 1.0, None), (False, 1.0, None)], "b boolean, c double, d double"), ["b"], ["c", "d"], ["c", "d"])
    assert v.booleans == {"b": False} and v.numbers == {"c": 1.0, "d": 0.0} and v.deviations == {"c": 1.0, "d": 1.0}


def test_unknown_label_is_named(spark):
    with pytest.raises(Exception, match="unknown label: odd"):
        one(spark, vectorise.encode_label(F.lit("odd")))


def test_pair_consistency_guards(spark):
    kind = "is_augmented boolean, y_true int, y_pred int, pair_id string, aug_parent string"
    good = [(True, 2, 2, None, "a"), (False, 0, 0, "a", None), (True, 2, 1, None, "b"), (False, 1, 1, "b", None)]
    assert evaluation.pair_consistency(spark.createDataFrame(good, kind)).first()["pair_consistency"] == 0.5
    for bad, message in (([(True, 2, 2, None, "z")], "no source"), ([(True, 2, 2, None, " ")], "no parent"), ([(True, 2, 2, None, "a"), (False, 0, 0, "a", None), (False, 0, 0, "a", None)], "several sources")):
        with pytest.raises(Exception, match=message):
            evaluation.pair_consistency(spark.createDataFrame(bad, kind)).collect()


# --- names, bytes, parsers


def test_names(spark):
    m = one(spark, naming.parts(F.lit("12-png-x.y.png"), naming.DEFAULT_NAME))
    assert tuple(m) == (12, "png", "x.y", "png")
    m = one(spark, naming.parts(F.lit("12-png-x.png.locked"), naming.RANSOMWARE_NAME))
    assert tuple(m) == (12, "png", "x", "png.locked")
    assert tuple(one(spark, naming.parts(F.lit("n-png.png"), naming.DEFAULT_NAME))) == (None,) * 4
    assert [one(spark, naming.strip_aug(F.lit(x))) for x in ("x-aug", "aug", "a-aug-b")] == ["x", "", "a-b"]
    assert one(spark, naming.add_aug(F.lit("1-png-x.png"))) == "1-png-x-aug.png"
    assert one(spark, naming.normal_path(F.lit("\\??\\C:\\a\\b"), {})) == "C:/a/b"


def test_byte_statistics_limits():
    uniform, constant = bytestats.statistics(bytes(range(256))), bytestats.statistics(b"a" * 1000)
    assert (uniform["entropy_global"], uniform["byte_chi2"], uniform["ic_index"]) == (8.0, 0.0, 0.0)
    assert (constant["entropy_global"], constant["min_entropy_global"], constant["ic_index"]) == (0.0, 0.0, 1.0)
    assert bytestats.statistics(b"")["entropy_global"] is None and bytestats.statistics(b"x")["ic_index"] is None


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


PNG = b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", b"\0" * 13) + _chunk(b"IDAT", b"abc") + _chunk(b"IEND", b"")
JPEG = b"\xff\xd8" + b"\xff\xe1\x00\x08Exif\0\0" + b"\xff\xc0\x00\x04ab" + b"\xff\xda\x00\x02"
MP4 = b"\0\0\0\x10ftypisom\0\0\0\0" + b"\0\0\0\x08moov" + b"\0\0\0\x08mdat"
RAR4 = b"Rar!\x1a\x07\x00" + struct.pack("<HBHH", 0, 0x73, 0, 7) + struct.pack("<HBHHI", 0, 0x74, 0, 11, 0) + struct.pack("<HBHH", 0, 0x7B, 0, 7)
RAR5 = b"Rar!\x1a\x07\x01\x00" + struct.pack("<IB", 10, 1) + b"\0" * 8


def seven(header: bytes) -> bytes:
    tail = struct.pack("<QQI", 0, len(header), zlib.crc32(header))
    return b"7z\xbc\xaf\x27\x1c\0\4" + struct.pack("<I", zlib.crc32(tail)) + tail + header


def zipped(*names: str, content: str = "hello") -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n in names:
            z.writestr(n, content)
    return b.getvalue()


def ole(name: str = "WordDocument") -> bytes:
    def entry(n, kind, start, size):
        raw = n.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HB", len(raw), kind) + b"\0" * 49 + struct.pack("<IQ", start, size)

    header = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 22 + struct.pack("<HH", 9, 6)
    header = header.ljust(0x30, b"\0") + struct.pack("<I", 1) + b"\0" * 4 + struct.pack("<5I", 0, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    fat = struct.pack("<128I", 0xFFFFFFFD, 0xFFFFFFFE, 0xFFFFFFFE, *[0xFFFFFFFF] * 125)
    stream = struct.pack("<5HH", 0, 0, 0, 0, 0, 0x0100).ljust(512, b"\0")
    return header + fat + (entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry(name, 2, 2, 512)).ljust(512, b"\0") + stream


@pytest.mark.parametrize(("family", "data"), [("png", PNG), ("jpeg", JPEG), ("mp4", MP4), ("rar", RAR4), ("rar", RAR5), ("7zip", seven(b"\x01\x00")), ("zip", zipped("a")), ("gzip", gz.compress(b"x")), ("ole2", ole())])
def test_sound_files(family, data):
    r = extraction.feature_row(data)
    assert r["format_family"] == family and r["parser_ok"] is True and list(r) == list(schema.FEATURES)


@pytest.mark.parametrize(("family", "data"), [("png", PNG[:-20]), ("jpeg", b"\xff\xd8\xff"), ("mp4", MP4[:12]), ("rar", RAR4[:9]), ("7zip", seven(b"\x01\x00")[:-1]), ("gzip", b"\x1f\x8b\x08"), ("ole2", ole()[:600])])
def test_damaged_files(family, data):
    r = extraction.feature_row(data)
    assert r["format_family"] == family and r["structure_consistent"] in (False, None)


@settings(max_examples=150, deadline=None)
@given(st.sampled_from([PNG, JPEG, MP4, RAR4, seven(b"\x01\x00"), zipped("a", "b"), ole(), gz.compress(b"abc")]), st.integers(0, 600), st.integers(0, 255), st.integers(1, 700))
def test_parsers_never_raise(data, at, value, cut):
    data = bytearray(data)
    data[at % len(data)] = value
    for x in (bytes(data), bytes(data[:cut])):
        for family in parsers.REGISTRY:
            parsers.parse(family, x)
        extraction.feature_row(x)


def test_encryption_marks():
    data = bytearray(zipped("a"))
    at = data.index(b"PK\x01\x02")
    data[at + 8] |= 1
    assert parsers.parse("zip", bytes(data))["zip_encryption_method"] == "ZipCrypto"
    found = extraction.feature_row(ole())
    assert (found["ole_format_family"], found["ole_encryption_present"], found["ole_encryption_struct_valid"]) == ("doc", True, False)
    pdf = b"%PDF-1.4\ntrailer << /Root 1 0 R /Encrypt 2 0 R >> /Filter /Standard /EncryptMetadata false\nstartxref\n0\n%%EOF"
    assert parsers.parse("pdf", pdf)["pdf_encrypt_filter"] == "Standard"


def test_scan_and_csv(spark, tmp_path):
    for name, folder in (("1-png-a.png", "benign"), ("2-png-a.png.lock", "ransomware-encrypted"), ("x.txt", "else")):
        (tmp_path / "set" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "set" / folder / name).write_bytes(PNG)
    found = files.scan_classes(spark, str(tmp_path / "set"))
    assert {(r["path"], r["gt_class"], r["group_id"], r["pair_id"], r["curr_ext"]) for r in found.collect()} == {
        ("benign/1-png-a.png", "benign", "1-png", "1-png-a", "png"), ("ransomware-encrypted/2-png-a.png.lock", "ransomware-encrypted", "2-png", "2-png-a", "png.lock")}
    rows_ = extraction.features(found, "path")
    schema.require_exact(rows_.drop("path"))
    wide = found.drop("content", "size_bytes").join(rows_, "path").withColumns({"is_augmented": F.lit(False), "aug_encryption": F.lit(None).cast("string"), "aug_parent": F.lit(None).cast("string")})
    order = [*schema.SERVICE, *schema.FEATURES]
    files.write_csv(wide, str(tmp_path / "d.csv"), order)
    back = files.read_csv(spark, str(tmp_path / "d.csv"))
    assert back.columns == order and back.filter("png_idat_count = 1 AND zip_entry_count IS NULL").count() == 2
    with pytest.raises(RuntimeError):
        schema.require_exact(back)


def test_metadata_scan_leaves_contents_unread(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    plan = files.scan(spark, str(tmp_path), 10).select("path", "size_bytes")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan and "PushedFilters: [IsNotNull(length), LessThanOrEqual(length,10)]" in plan
