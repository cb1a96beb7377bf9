"""A training corpus from documents, in five stages; each is written as Parquet and read again by the next.

quality rules drop repetitive, short and symbol-laden texts; SimHash keeps one document of each group
of near copies (sets of five-word shingles alike by 0.8 or more); personal data gets format-preserving pseudonyms; sources are mixed to their target
weights (rows are repeated, and cut at a source's budget); what is left is encoded with a public
byte-level BPE vocabulary and decoded again; the last stage returns the ids, their number, and digests
of them and of the decoded bytes. All stages but the last return documents' columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fathomline.llm import bpe, mixing, near_copies, pii, quality
from fathomline.llm.common import DOCUMENT_COLUMNS, shared_folder, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs.select(*DOCUMENT_COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_of_each(docs.select(*DOCUMENT_COLUMNS))


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(docs.select(*DOCUMENT_COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs.select(*DOCUMENT_COLUMNS))


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("pii_pseudonyms", pii_pseudonyms),
    ("mix_sources", mix_sources),
    ("bpe_round_trip", bpe_round_trip),
]

#: Rolling-hash coverage, SimHash components, Feistel networks and BPE aren't SQL: tests/llm holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over sf_dir's documents. What they hand on lies in the cluster's shared folder (spark.checkpoint.dir)."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
