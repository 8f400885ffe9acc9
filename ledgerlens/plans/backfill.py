"""Jobs: transcript files to evidence, evidence to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.redact import Pattern
from ..operators import chain
from ..schemas import RAW_EVENT
from ..sources import evidence, transcripts
from .projection import project


def backfill(spark: SparkSession, root: str, store: str, now: int, excluded: tuple[str, ...] = (), create: bool = False) -> DataFrame:
    """Appends what is new below ``root`` to the evidence at ``store``, sealed, and returns the report: files, lines,
    stored, duplicates. Running it again adds nothing. The new part is written beside the store first, since it is read
    from the store's own state."""
    if create:
        spark.createDataFrame([], RAW_EVENT).write.parquet(store)
    stored = spark.read.schema(RAW_EVENT).parquet(store)
    lines = transcripts.ranged_lines(spark, root, excluded, stored)
    added = evidence.append(stored, lines, "transcript", now)
    # Sealing goes on from the stored heads: only the last sealed row of each chain takes part.
    heads = stored.join(chain.heads(stored).select("lane", "source_ref", "head"), ["lane", "source_ref"]).filter("chain_sha256 = head").drop("head")
    sealed = chain.seal(heads.select(*added.columns).unionByName(added)).join(added.select("id"), "id", "left_semi")
    part = f"{store.rstrip('/')}-part-{now}"
    sealed.write.parquet(part)
    new = spark.read.schema(RAW_EVENT).parquet(part)
    report = evidence.ingest_report(lines, new)
    row = report.first()  # before the store changes, which the report reads
    new.write.mode("append").parquet(store)
    return spark.createDataFrame([row], report.schema)


def rebuild(spark: SparkSession, store: str, out: str, patterns: list[Pattern] | None = None) -> None:
    """Derives all tables from the evidence anew, both lanes at once, below ``out``, a new place for each rebuild."""
    for name, table in project(spark.read.schema(RAW_EVENT).parquet(store), patterns).items():
        table.write.parquet(f"{out}/{name}")
