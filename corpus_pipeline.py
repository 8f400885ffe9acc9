"""A training-data pipeline over ``documents``: five stages, each one of the corpus operators.

Each stage takes (spark, docs, sf_dir) and works on what its predecessor kept; its result is written as Parquet in the
shared folder and read again, so a lost executor costs no stage before. All stages but the last return the columns of
``documents``. An empty table stays empty in every stage; columns of ``docs`` beyond those of ``documents`` are passed on,
also where they are called like a column that an operator uses inside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import decontam, exact_dedup, language, mixing, simhash
from ledgerlens.llm.common import materialize, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text no language explains. A null or letterless text has no evidence of its own and goes by its
    metadata, or by the most frequent language: it stays, and so do documents declared in a language of too few documents for
    a class. Without a labelled document all texts with letters go."""
    return language.keep_known(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) keeps the row with the largest doc_id. A null text counts as empty and null ids are
    below all others; of rows that repeat an id and text one stays."""
    return exact_dedup.keep_one(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity of 0.8 or more) keeps the one with the smallest doc_id.
    Null texts count as empty, and empty texts are equal. Rows without an id all stay; rows that repeat an id with
    another text are documents of their own."""
    return simhash.keep_first(docs, shingle=5, similarity=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. Null and empty texts hold none; rows are judged one by one, whatever
    their ids are; items without an id or text are passed over."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives every source the same share by Poisson replication, and shuffles globally. A null source is a source of its
    own; rows that repeat an id, or have none, get equal counts."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing_to_weights),
]

#: SQL expresses neither the language model nor the fingerprints; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
