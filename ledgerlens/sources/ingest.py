"""Idempotent ingest in batches, without reading the evidence again.

Beside the evidence stands a table of content digests, partitioned by their first digits and by batch. A batch reads the
partitions of its own digests only, and two columns of them. All that a batch writes lies in partitions of its name, which
a replay overwrites with the same rows under the same ids: it ignores the digests that it wrote itself, and starts at the
id where the batches before it ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import evidence

ROW = "id long, lane string, source_ref string, source_offset long, content_sha256 string, ingested_at long, body string, chain_sha256 string, batch string"
DIGEST = "content_sha256 string, prefix string, batch string"
DIGITS = 2
HEAD = "last_id long, rows long, seq long, batch string"


def create(spark: SparkSession, path: str) -> None:
    for name, schema in (("evidence", ROW), ("digests", DIGEST), ("heads", HEAD)):
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}")


def _table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")


def stored(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "evidence", ROW)


def digests(spark: SparkSession, path: str, prefixes: list[str]) -> DataFrame:
    """The digests of these prefixes: the partition filter is static, so nothing else is listed or read."""
    return _table(spark, path, "digests", DIGEST).filter(F.col("prefix").isin(*prefixes) if prefixes else F.lit(False))


def _overwrite(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def ingest(rows: DataFrame, path: str, lane: str, now: int, seq: int, redact=None, digits: int = DIGITS) -> DataFrame:
    """Stores what is new in rows(source_ref, body[, source_offset]) as batch ``lane-seq`` and gives the rows it holds; batches of
    all lanes share one order of ``seq``, and only the last one may be replayed. The driver gets the prefixes (256 of two ``digits``, which stay the same for a store) and one id."""
    spark = rows.sparkSession
    batch = f"{lane}-{seq}"
    fresh = evidence.prepared(rows, lane, now, redact).withColumn("prefix", F.left("content_sha256", F.lit(digits))).persist()
    prefixes = [r["prefix"] for r in fresh.select("prefix").distinct().collect()]
    known = digests(spark, path, prefixes).filter(F.col("batch") != batch).select("content_sha256")
    before = _table(spark, path, "heads", HEAD).filter(F.col("seq") < seq).agg(F.coalesce(F.max("last_id"), F.lit(0))).first()[0]
    added = evidence.numbered(evidence.new_rows(fresh.drop("prefix"), known), before).withColumn("batch", F.lit(batch))
    _overwrite(added, f"{path}/evidence", "batch")
    held = stored(spark, path).filter(F.col("batch") == batch)
    # The digests follow the evidence: a batch that stopped between the two is replayed, and finds itself unknown.
    named = held.select("content_sha256", F.left("content_sha256", F.lit(digits)).alias("prefix"), "batch")
    _overwrite(named.repartition("prefix"), f"{path}/digests", "prefix", "batch")
    head = held.agg(F.coalesce(F.max("id"), F.lit(before)).alias("last_id"), F.count("*").alias("rows")).select("last_id", "rows", F.lit(seq).cast("long").alias("seq"), F.lit(batch).alias("batch"))
    _overwrite(head, f"{path}/heads", "batch")
    fresh.unpersist()
    return held


def ingesting(path: str, lane: str, clock: Callable[[], int], after: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function. ``after`` sees the rows that the batch holds, on a replay the same ones."""

    def run(batch: DataFrame, batch_id: int) -> None:
        held = ingest(batch, path, lane, clock(), batch_id)
        if after is not None:
            after(held, batch_id)

    return run
