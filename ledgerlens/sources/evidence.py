"""The evidence store: append with content dedup, scans and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def prepared(rows: DataFrame, lane: str, now: int, redact=None) -> DataFrame:
    """rows(source_ref, body[, source_offset]) as evidence, redacted first if asked for, without ids."""
    body: Column = redact(F.col("body")) if redact else F.col("body")
    offset = F.col("source_offset") if "source_offset" in rows.columns else F.lit(None)
    out = rows.select(F.lit(lane).alias("lane"), "source_ref", offset.cast("long").alias("source_offset"), body.alias("body"))
    return out.select("lane", "source_ref", "source_offset", F.sha2(F.col("body").cast("binary"), 256).alias("content_sha256"), F.lit(now).cast("long").alias("ingested_at"), "body")


def new_rows(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """The first row of each content that is nowhere in the store. Which row is first is decided on hashes and places; the
    bodies take part in one join only."""
    place = F.struct("source_ref", "source_offset")
    first = rows.groupBy("content_sha256").agg(F.min(place).alias("place"))
    wanted = first.join(stored.select("content_sha256"), "content_sha256", "left_anti").select(F.col("content_sha256").alias("h"), "place")
    found = rows.join(wanted, (F.col("content_sha256") == F.col("h")) & place.eqNullSafe(F.col("place"))).drop("h", "place")
    return found.dropDuplicates(["content_sha256"])


def numbered(rows: DataFrame, after: int) -> DataFrame:
    """Adds ids after ``after`` in order of source and offset: counts by source give each one's first id, and a source's
    rows are numbered within it."""
    counts = rows.groupBy("lane", "source_ref").agg(F.count("*").alias("n"))
    begin = counts.withColumn("begin", F.sum("n").over(W.orderBy("lane", "source_ref").rowsBetween(W.unboundedPreceding, -1)))
    begin = begin.select("lane", "source_ref", F.coalesce("begin", F.lit(0)).alias("begin"))
    w = W.partitionBy("lane", "source_ref").orderBy("source_offset", "content_sha256")
    out = rows.join(begin, ["lane", "source_ref"]).withColumn("id", F.col("begin") + F.row_number().over(w) + after)
    return out.select("id", "lane", "source_ref", "source_offset", "content_sha256", "ingested_at", "body", F.lit(None).cast("string").alias("chain_sha256"))


def append(stored: DataFrame, rows: DataFrame, lane: str, now: int, redact=None) -> DataFrame:
    """Rows to append to the store."""
    last = stored.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return numbered(new_rows(prepared(rows, lane, now, redact), stored), last)


def ingest_report(rows: DataFrame, added: DataFrame) -> DataFrame:
    """files, lines, stored, duplicates."""
    seen = rows.agg(F.count_distinct("source_ref").alias("files"), F.count("*").alias("lines"))
    return seen.crossJoin(added.agg(F.count("*").alias("stored"))).withColumn("duplicates", F.col("lines") - F.col("stored"))


def scan(stored: DataFrame, lane: str | None = None, after: int | None = None) -> DataFrame:
    out = stored.filter(F.col("lane") == lane) if lane else stored
    out = out.filter(F.col("id") > after) if after is not None else out
    return out.orderBy("id")


def counters(stored: DataFrame) -> DataFrame:
    return stored.groupBy("lane").agg(F.count("*").alias("events"), F.max("id").alias("last_id"), F.max("source_offset").alias("last_offset"))


def source_record(stored: DataFrame, message_uuid: str | None, tool_use_id: str) -> DataFrame:
    """The transcript row of a call: the lowest id whose body has the message's uuid, else the call's id."""
    rows = stored.filter("lane = 'transcript'")
    by_uuid = F.col("body").contains(f'"uuid":"{message_uuid}"') if message_uuid else F.lit(False)
    found = rows.filter(by_uuid | F.col("body").contains(tool_use_id)).withColumn("rank", F.when(by_uuid, 0).otherwise(1))
    return found.orderBy("rank", "id").limit(1).drop("rank")


def source_records(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """wanted(tool_use_id, message_uuid) -> (tool_use_id, evidence_id) for all calls at once: the lowest transcript row with
    the message's uuid, else the lowest that has the call's id as a whole JSON text; null if none. Each body is read
    once; of its texts only those that somebody asks for are shuffled."""
    rows = stored.filter("lane = 'transcript'")
    uuids = F.transform(F.regexp_extract_all("body", F.lit('"uuid":"([^"]*)"'), F.lit(1)), lambda u: F.struct(u.alias("key"), F.lit(0).alias("rank")))
    texts = F.transform(F.regexp_extract_all("body", F.lit(r'"([^"\\]+)"'), F.lit(1)), lambda t: F.struct(t.alias("key"), F.lit(1).alias("rank")))
    keys = rows.select("id", F.explode(F.array_distinct(F.concat(uuids, texts))).alias("k")).select("id", "k.*")
    asks = wanted.select("tool_use_id", F.explode(F.array(
        F.struct(F.col("message_uuid").alias("key"), F.lit(0).alias("rank")), F.struct(F.col("tool_use_id").alias("key"), F.lit(1).alias("rank")),
    )).alias("k")).select("tool_use_id", "k.*").filter("key IS NOT NULL")
    least = keys.join(asks.select("key", "rank").distinct(), ["key", "rank"], "left_semi").groupBy("key", "rank").agg(F.min("id").alias("id"))
    best = asks.join(least, ["key", "rank"]).groupBy("tool_use_id").agg(F.min_by("id", "rank").alias("evidence_id"))
    return wanted.select("tool_use_id").join(best, "tool_use_id", "left")
