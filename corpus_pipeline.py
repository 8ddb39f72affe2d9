"""Corpus pipeline: toxicity filter, exact dedup, near dedup, redaction, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet and read back as the next one's ``docs``. All but the last return the
columns of ``documents``.

Defined cases, for every stage: null and empty texts, and texts of white
space, are clean, have no copies but each other (exact dedup), no near copies
and no personal data, and pack as their end id; of repeated rows with one
doc_id and text the exact dedup keeps one; rows without a doc_id are kept by
all filters unless their text is a copy; an empty table stays empty; extra
columns, also ones called like a stage's own, pass through up to the packing,
which drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillroll.llm import exact_refine, ffd_pack, pii_crf, superminhash, toxic_segments
from tillroll.llm.common import cut_lineage, ship_package, small_batches


def _prepare(spark: SparkSession) -> None:
    """The package for the workers, and batches that leave them room beside a full heap."""
    ship_package(spark)
    small_batches(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below 0.5; the scorer is fitted on the labels of ``sf_dir``."""
    _prepare(spark)
    return toxic_segments.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of identical texts: the largest doc_id."""
    _prepare(spark)
    return exact_refine.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the smallest doc_id."""
    _prepare(spark)
    return superminhash.keep_one_per_group(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets."""
    _prepare(spark)
    return pii_crf.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 tokens."""
    _prepare(spark)
    return ffd_pack.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: Toxicity, PII and packing have no SQL equivalent; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))  # drop_intermediates deletes it
    return STAGES[-1][1](spark, docs, sf_dir)
