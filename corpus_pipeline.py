"""A training corpus from raw documents: five stages, each over all that the one before kept.

Every stage takes whole texts and keeps the columns of documents, whatever their names.  In all of
them an empty table gives an empty table, a null text counts as an empty one, a very long text is
worked on as a whole, and rows are rows: repeated or null doc_ids lose nothing but copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sembra.llm import decontaminate, packing, quality, secrets, simhash
from sembra.llm.common import materialise, table
from sembra.llm.tokens import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified cutoffs keep.

    Null and empty texts have no 50 words and go.  A null language is a stratum of its own; labels of
    documents that aren't there are ignored, and without labels the base rules alone decide.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (64-bit fingerprints linked at 3 bits or fewer) one row.

    It is the one with the least doc_id, nulls last; rows equal in doc_id and text are copies, and
    unrelated texts under one doc_id, or none, all stay.  Near copies that differ in more bits stay too.
    """
    return simhash.first_of_each_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item or a part of one; an empty benchmark keeps all."""
    return decontaminate.matches(docs, table(spark, sf_dir, "benchmark"), keep_rows=True)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by [REDACTED]; n_chars follows the text, other columns stay as they are."""
    return secrets.redact(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length; an empty text is its end token alone."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("packing", packed_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage but the last is written to the shared folder and read again."""
    at = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        at = materialise(stage(spark, at, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, at, sf_dir)
