"""Queries over file contents and names, with the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import bytestats, naming, sniff
from fathomline.operators import sampling
from fathomline.sources import tables

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_HISTOGRAM = f"""WITH {tables.FILES_SQL},
bytes AS (SELECT file_id, unnest(regexp_extract_all(hex(content), '..')) AS h FROM files),
hist AS (SELECT file_id, h, count(*)::DOUBLE AS n FROM bytes GROUP BY ALL),
total AS (SELECT file_id, sum(n) AS t FROM hist GROUP BY file_id)
"""


@query(_HISTOGRAM + "SELECT file_id, round(-sum(n / t * log2(n / t)), 8) + 0.0 AS entropy_global FROM hist JOIN total USING (file_id) GROUP BY file_id")
def byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytestats.byte_statistics(tables.files(spark, sf_dir).filter("size_bytes > 0")).select("file_id", (F.round("entropy_global", 8) + 0.0).alias("entropy_global"))


@query(_HISTOGRAM + "SELECT file_id, round(-log2(max(n) / max(t)), 8) + 0.0 AS min_entropy_global FROM hist JOIN total USING (file_id) GROUP BY file_id")
def byte_min_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytestats.byte_statistics(tables.files(spark, sf_dir).filter("size_bytes > 0")).select("file_id", (F.round("min_entropy_global", 8) + 0.0).alias("min_entropy_global"))


@query(_HISTOGRAM + "SELECT file_id, round(sum((n - t / 256) * (n - t / 256) / (t / 256)) + (256 - count(*)) * max(t) / 256, 5) AS byte_chi2 FROM hist JOIN total USING (file_id) GROUP BY file_id")
def byte_chi2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytestats.byte_statistics(tables.files(spark, sf_dir).filter("size_bytes > 0")).select("file_id", F.round("byte_chi2", 5).alias("byte_chi2"))


@query(_HISTOGRAM + "SELECT file_id, round(sum(n * (n - 1)) / (max(t) * (max(t) - 1)), 9) AS ic_index FROM hist JOIN total USING (file_id) WHERE t > 1 GROUP BY file_id")
def byte_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytestats.byte_statistics(tables.files(spark, sf_dir).filter("size_bytes > 1")).select("file_id", F.round("ic_index", 9).alias("ic_index"))


@query(f"""WITH {tables.FILES_SQL},
ends AS (SELECT file_id, 'head' AS part, substr(hex(content), 1, 65536) AS h FROM files UNION ALL SELECT file_id, 'tail', right(hex(content), 65536) FROM files),
hist AS (SELECT file_id, part, b, count(*)::DOUBLE AS n FROM (SELECT file_id, part, unnest(regexp_extract_all(h, '..')) AS b FROM ends) GROUP BY ALL),
total AS (SELECT file_id, part, sum(n) AS t FROM hist GROUP BY ALL),
e AS (SELECT file_id, part, round(-sum(n / t * log2(n / t)), 8) + 0.0 AS e FROM hist JOIN total USING (file_id, part) GROUP BY ALL)
SELECT h.file_id, h.e AS entropy_head, t.e AS entropy_tail FROM e h JOIN e t ON h.file_id = t.file_id AND h.part = 'head' AND t.part = 'tail'""")
def byte_entropy_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bytestats.byte_statistics(tables.files(spark, sf_dir).filter("size_bytes > 0"))
    return s.select("file_id", *((F.round(c, 8) + 0.0).alias(c) for c in ("entropy_head", "entropy_tail")))


@query(f"WITH {tables.FILES_SQL} SELECT file_id, size_bytes, round(log10(size_bytes + 1), 9) AS log_size FROM files")
def file_size_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.files(spark, sf_dir).select("file_id", "size_bytes", F.round(F.log10(F.col("size_bytes") + 1), 9).alias("log_size"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.table(spark, sf_dir, "documents")
    extra = F.when(F.col("doc_id") % 3 == 0, F.lit("-x-aug")).when(F.col("doc_id") % 3 == 1, F.lit("-aug")).otherwise("")
    first = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("n"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    return d.select("doc_id", F.concat(first, F.lit("-"), F.col("lang"), extra, F.lit("."), F.col("source"), F.when(F.col("doc_id") % 4 == 0, ".locked").otherwise("")).alias("name"))


_NAMES = """names AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'n' ELSE '' END || doc_id || '-' || lang || CASE doc_id % 3 WHEN 0 THEN '-x-aug' WHEN 1 THEN '-aug' ELSE '' END || '.' || source || CASE WHEN doc_id % 4 = 0 THEN '.locked' ELSE '' END AS name FROM documents)"""
_PARTS = r"""parts AS (SELECT doc_id, name, {0}
  CASE WHEN regexp_matches(regexp_extract(name, p, 1), '^\s*[+-]?\d+\s*$') THEN trim(regexp_extract(name, p, 1))::INT END AS sequence_id, p FROM (SELECT *, '{1}' AS p FROM names)),
meta AS (SELECT doc_id, name, sequence_id, CASE WHEN sequence_id IS NOT NULL THEN regexp_extract(name, '{1}', 2) END AS orig_ext, CASE WHEN sequence_id IS NOT NULL THEN regexp_extract(name, '{1}', 3) END AS extra,
  CASE WHEN sequence_id IS NOT NULL THEN regexp_extract(name, '{1}', 4) END AS curr_ext FROM (SELECT doc_id, name, CASE WHEN regexp_matches(regexp_extract(name, '{1}', 1), '^\s*[+-]?\d+\s*$') THEN trim(regexp_extract(name, '{1}', 1))::INT END AS sequence_id FROM names))"""


def _meta_sql(pattern: str) -> str:
    return "WITH " + _NAMES + ",\n" + _PARTS[_PARTS.index("meta AS"):].format("", pattern) + """
SELECT doc_id, sequence_id, orig_ext, extra, curr_ext, coalesce(sequence_id || '-' || orig_ext, name) AS group_id,
       coalesce(sequence_id || '-' || orig_ext, name) || CASE WHEN coalesce(extra, '') <> '' THEN '-' || extra ELSE '' END AS pair_id FROM meta"""


def _with_meta(names: DataFrame, pattern: str) -> DataFrame:
    m = names.withColumn("m", naming.parts(F.col("name"), pattern)).withColumn("group_id", naming.group_id(F.col("m"), F.col("name")))
    return m.select("doc_id", "m.*", "group_id", naming.pair_id(F.col("group_id"), F.col("m.extra")).alias("pair_id"))


@query(_meta_sql(naming.DEFAULT_NAME))
def filename_metadata_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_meta(_names(spark, sf_dir), naming.DEFAULT_NAME)


@query(_meta_sql(naming.RANSOMWARE_NAME))
def filename_metadata_ransomware(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_meta(_names(spark, sf_dir), naming.RANSOMWARE_NAME)


@query("WITH " + _NAMES + r""", extras AS (SELECT doc_id, name, regexp_extract(name, '(?s)^([^-]+)-([^-.]+)(?:-([^.]+))?\.(.+)$', 3) AS extra FROM names)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(extra, '(?i)\b-?aug\b', '', 'g'), '^-+|-+$', '', 'g'), '-{2,}', '-', 'g') AS stripped, regexp_replace(name, '(\.[^.]+)$', '-aug\1') AS marked FROM extras""")
def strip_aug_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _names(spark, sf_dir)
    return n.select("doc_id", naming.strip_aug(F.regexp_extract("name", naming.RANSOMWARE_NAME, 3)).alias("stripped"), naming.add_aug(F.col("name")).alias("marked"))


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic contents: one of the known magics by id, then the text."""
    magics = F.array(*(F.lit(bytearray(b)) for b in sniff.SAMPLES))
    d = tables.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.element_at(magics, (F.col("doc_id") % len(sniff.SAMPLES) + 1).cast("int")), F.encode("text", "UTF-8")).alias("content"))


_HEADS = "heads AS (SELECT doc_id, ([" + ", ".join(f"'{b.hex().upper()}'" for b in sniff.SAMPLES) + f"])[doc_id % {len(sniff.SAMPLES)} + 1] || hex(encode(text)) AS h FROM documents)"
_MAGIC = "CASE " + " ".join(f"WHEN h LIKE '{p}%' THEN '{f}'" for p, f in [
    ("255044462D", "pdf"), ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg"), ("1F8B", "gzip"), ("D0CF11E0A1B11AE1", "ole2"), ("526172211A0700", "rar"), ("526172211A070100", "rar")]) + """
 WHEN substr(h, 9, 8) = '66747970' THEN 'mp4' WHEN h LIKE '504B0304%' OR h LIKE '504B0506%' OR h LIKE '504B0708%' THEN 'zip' WHEN h LIKE '474946383761%' OR h LIKE '474946383961%' THEN 'gif'
 WHEN h LIKE '52494646%' AND substr(h, 17, 8) = '57454250' THEN 'webp' WHEN h LIKE '494433%' OR (h LIKE 'FF%' AND substr(h, 3, 1) IN ('E', 'F')) THEN 'mp3' WHEN h LIKE '52494646%' AND substr(h, 17, 8) = '57415645' THEN 'wav'
 WHEN h LIKE '664C6143%' THEN 'flac' WHEN h LIKE '425A68%' THEN 'bzip2' WHEN h LIKE '04224D18%' THEN 'lz4' WHEN h LIKE '28B52FFD%' THEN 'zstd' WHEN h LIKE '53514C69746520666F726D6174203300%' THEN 'sqlite'
 WHEN substr(h, 515, 10) = '7573746172' THEN 'tar' WHEN h LIKE '4D5A%' THEN 'pe' WHEN h LIKE '7F454C46%' THEN 'elf' WHEN h LIKE '377ABCAF271C%' THEN '7zip' ELSE 'unknown' END"""


@query(f"WITH {_HEADS} SELECT doc_id, {_MAGIC} AS magic_family FROM heads")
def magic_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heads(spark, sf_dir).select("doc_id", sniff.magic_family(F.col("content")).alias("magic_family"))


@query()
def crc_header_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC-32 of each content's bytes 12..31, as an archive's start header has it."""
    f = tables.files(spark, sf_dir)
    return f.select("file_id", F.crc32(F.substring("content", 13, 20)).alias("header_crc"))


@query()
def parse_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 85 features of synthetic contents."""
    from fathomline.operators import extraction

    return extraction.features(_heads(spark, sf_dir), "doc_id")


@query("""WITH files AS (SELECT doc_id, n_chars * 1000 AS size, (['header-only', 'intermittent', 'hybrid', 'adaptive', 'full'])[doc_id % 5 + 1] AS mode FROM documents),
h AS (SELECT *, least(size, CASE WHEN size > 20971520 THEN 65536 ELSE 16384 END) AS header FROM files),
r AS (
  SELECT doc_id, mode, 0 AS start, header AS length FROM h WHERE size > 0 AND (mode IN ('header-only', 'hybrid') OR mode = 'adaptive' AND size > 10485760)
  UNION ALL SELECT doc_id, mode, 0, size FROM h WHERE size > 0 AND (mode = 'full' OR mode = 'adaptive' AND size <= 10485760)
  UNION ALL SELECT doc_id, mode, s, least(32768, size - s) FROM (SELECT *, unnest(generate_series(CASE WHEN mode = 'intermittent' THEN 65536 ELSE header END, size - 1, 65536)) AS s FROM h WHERE mode IN ('intermittent', 'hybrid') OR mode = 'adaptive' AND size > 10485760))
SELECT doc_id, mode, start::BIGINT AS start, length::BIGINT AS length FROM r""")
def encryption_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes = F.array(*map(F.lit, ["header-only", "intermittent", "hybrid", "adaptive", "full"]))
    d = tables.table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 1000).alias("size"), F.element_at(modes, (F.col("doc_id") % 5 + 1).cast("int")).alias("mode"))
    return d.select("doc_id", "mode", F.explode(sampling.byte_ranges(F.col("size"), F.col("mode"))).alias("r")).select("doc_id", "mode", "r.start", "r.length")
