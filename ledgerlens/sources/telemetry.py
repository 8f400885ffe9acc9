"""Telemetry export requests as one record a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EXPORT_REQUEST, LOG_RECORD


def requests(spark: SparkSession, path: str) -> DataFrame:
    """(source_ref, body): one export request in JSON a line."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("source_ref"), F.col("value").alias("body"))


def records(found: DataFrame) -> DataFrame:
    """(source_ref, body): each log record as JSON. Requests that don't parse have none."""
    parsed = found.select("source_ref", F.from_json("body", EXPORT_REQUEST).alias("r"))
    scopes = parsed.select("source_ref", F.explode("r.resourceLogs").alias("x")).select("source_ref", F.explode("x.scopeLogs").alias("x"))
    each = scopes.select("source_ref", F.explode("x.logRecords").alias("record"))
    return each.select("source_ref", F.to_json("record").alias("body"))


def parsed(evidence: DataFrame) -> DataFrame:
    """Evidence rows of the lane -> (id, record fields)."""
    rows = evidence.filter("lane = 'otlp'").select("id", F.from_json("body", LOG_RECORD).alias("r"))
    return rows.filter("r IS NOT NULL").select("id", "r.*")
