"""Live ingestion: both lanes as file streams, idempotent appends, recomputed keys, alerts, a streaming histogram."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import inherit_modes, last_known, merge_lanes, mode_changes
from ..operators.rules import Rule, alerts, matched_rules
from ..sources import evidence, telemetry
from ..sources.ranges import RANGE_BYTES, LineSource


def transcript_stream(spark: SparkSession, root: str, files_per_trigger: int = 1000) -> DataFrame:
    """Lines of closed transcript segments that land below ``root``. A file stream reads a file once: growing files are
    landed in closed segments, or read by tail_stream()."""
    rows = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", files_per_trigger).text(root)
    return rows.select(F.col("_metadata.file_path").alias("source_ref"), F.col("value").alias("body")).filter(F.trim("body") != "")


def tail_stream(spark: SparkSession, root: str, range_bytes: int = RANGE_BYTES, suffix: str = ".jsonl") -> DataFrame:
    """Lines of files that grow below ``root``, with their byte offsets: each trigger reads what has been completed since."""
    spark.dataSource.register(LineSource)
    return spark.readStream.format("byte_ranges").option("rangeBytes", range_bytes).option("suffix", suffix).load(root)


def telemetry_stream(spark: SparkSession, landing: str, files_per_trigger: int = 1000) -> DataFrame:
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(landing)
    return telemetry.records(rows.select(F.col("_metadata.file_path").alias("source_ref"), F.col("value").alias("body")))


def deduplicated(rows: DataFrame) -> DataFrame:
    """Content dedup in the stream's own state, which grows with the distinct contents; appending() keeps none."""
    return rows.withColumn("content_sha256", F.sha2(F.col("body").cast("binary"), 256)).dropDuplicates(["content_sha256"])


def appending(store: str, lane: str, clock: Callable[[], int], after: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: appends the batch's new contents to the evidence at ``store``. Running a batch again adds
    nothing, whatever arrives late or twice. ``after`` sees the rows that were added."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = spark.read.parquet(store)
        offsets = batch if "source_offset" in batch.columns else batch.withColumn("source_offset", F.lit(None).cast("long"))
        added = evidence.append(stored, offsets, lane, clock()).persist()
        added.write.mode("append").parquet(store)
        if after is not None:
            after(added, batch_id)
        added.unpersist()

    return run


def observed(rows: DataFrame, name: str) -> DataFrame:
    """The rows, with counters that every trigger reports (StreamingQueryProgress.observedMetrics): records, bytes and
    records that aren't JSON."""
    size = F.coalesce(F.sum(F.octet_length("body").cast("long")), F.lit(0))
    return rows.observe(name, F.count(F.lit(1)).alias("records"), size.alias("bytes"), F.count_if(F.try_parse_json("body").isNull()).alias("unparsable"))


def touched(added_facts: DataFrame, all_facts: DataFrame, key: str) -> DataFrame:
    """All facts of the keys that a batch touched: merging them again gives those keys' rows, in any order of arrival."""
    return all_facts.join(added_facts.select(key).distinct(), key, "left_semi")


def merged_stream(facts: DataFrame) -> DataFrame:
    """The two lanes' merge as a streaming aggregation in update mode: either lane may come first, and the row is the batch
    merge's of the facts so far. What a call takes over from its session and agent is in streaming.state."""
    return merge_lanes(facts)


#: What ``answering_modes`` takes: a call's fact (mode is its own), or a record that shows its session's mode.
MODE_MESSAGE = "what string, id long, session_id string, tool_use_id string, at long, mode string"


def answering_modes(spark: SparkSession, store: str, out: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over MODE_MESSAGE rows: the mode of each call as of its time, as the batch operators give it over all
    messages so far. A trigger stores its messages and answers the sessions that it touched again, by shuffles and with no state of
    single keys, into a folder of its own: (tool_use_id, permission_mode), where a call's newest batch holds. A replay overwrites both."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
        every = spark.read.schema(f"{MODE_MESSAGE}, batch long").option("basePath", store).parquet(store)
        facts = every.filter("what = 'call'").select("id", "tool_use_id", "session_id", F.col("at").alias("called_at"), F.col("mode").alias("permission_mode"), "batch")
        calls = facts.groupBy("tool_use_id").agg(*[last_known(c) for c in ("session_id", "called_at", "permission_mode")], F.min("id").alias("row_seq"), F.max("batch").alias("batch"))
        seen = every.filter("what = 'seen'").select("id", "session_id", "mode", F.lit("").alias("trigger"), F.col("at").alias("ts"), "batch")
        sessions = calls.union(seen.select(F.lit(None), "session_id", F.lit(None), F.lit(None), F.lit(None), "batch")).filter(F.col("batch") == batch_id)
        sessions = sessions.filter("session_id IS NOT NULL").select("session_id").distinct()
        mine = lambda df: df.drop("batch").join(sessions, "session_id", "left_semi")
        told = inherit_modes(mine(calls), mode_changes(mine(seen)))
        told.select("tool_use_id", "permission_mode").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return run


#: Ids that one notification holds at most.
NOTICE_IDS = 200


def alerting(sink: str, rules: list[Rule]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over enriched calls: writes what to notify about to a folder of the batch's own, in files of at
    most NOTICE_IDS rows. A replay overwrites that folder, so a batch's alerts are there once."""

    def run(batch: DataFrame, batch_id: int) -> None:
        told = alerts(matched_rules(batch, rules), rules).withColumn("batch", F.lit(batch_id))
        told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", NOTICE_IDS).partitionBy("batch").parquet(sink)

    return run


def histogram_stream(calls: DataFrame, width: str = "1 hour", watermark: str | None = None) -> DataFrame:
    """Tumbling windows over called_at (ms). Weeks start on Mondays. Without a watermark any lateness is merged and state
    is kept for every window; with one, later rows are dropped and state is bounded."""
    timed = calls.withColumn("at", F.timestamp_millis("called_at"))
    timed = timed.withWatermark("at", watermark) if watermark else timed
    start = "4 days" if width in ("1 week", "7 days") else None
    window = F.window("at", width, startTime=start) if start else F.window("at", width)
    return timed.groupBy(window.alias("w")).agg(
        F.count("*").alias("calls"), F.count_if(F.col("success") == F.lit(False)).alias("failures"), F.count_if(F.col("decision") == "reject").alias("refusals")
    ).select(F.unix_millis("w.start").alias("bucket_start"), "calls", "failures", "refusals")


def carried_modes(seen: DataFrame, before: DataFrame) -> DataFrame:
    """(session_id, mode) after a batch: the batch's last mode, else the one carried from before."""
    now = seen.filter("mode IS NOT NULL").groupBy("session_id").agg(F.max_by("mode", "id").alias("new"))
    return before.join(now, "session_id", "full").select("session_id", F.coalesce("new", "mode").alias("mode"))
