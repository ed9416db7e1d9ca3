"""Corpus preparation in stages, each over all that the one before kept.

Order: language ID, MinHash near-duplicates, PII masking, packing. ``run`` applies the
stages to the documents table, each written as Parquet into the shared folder and read
again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import langid, neardup, packing, pii
from siftwell.llm.catalog import public_file
from siftwell.llm.common import fresh_dir, removed, small_batches, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is recognised, with lang set to it."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    return langid.label(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8)."""
    small_batches(spark)
    return neardup.deduplicated(docs.select(*COLUMNS))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data in text masked and n_chars counted anew."""
    small_batches(spark)
    return pii.redact(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of at most 2048 tokens."""
    small_batches(spark)
    return packing.pack(docs, public_file("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("mask_pii", mask_pii),
    ("pack", pack),
]

#: Byte context trees and byte-pair ids aren't expressible in SQL; the stages are
#: tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents").select(*COLUMNS), None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            removed(spark, before)
        before = path
    return docs
