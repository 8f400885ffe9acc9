"""Aggregations over calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MINUTE, HOUR, DAY, WEEK = 60_000, 3_600_000, 86_400_000, 604_800_000
#: Epoch days start on a Thursday; three days on, weeks start on Mondays.
WEEK_PHASE = 3 * DAY
MOST_BUCKETS = 60


def count(frame: DataFrame) -> DataFrame:
    return frame.agg(F.count("*").alias("calls"))


def span(frame: DataFrame) -> DataFrame:
    return frame.agg(F.min("called_at").alias("first_at"), F.max("called_at").alias("last_at"))


def width_for(span_ms: Column) -> Column:
    """The narrowest of minute, hour and day of which MOST_BUCKETS cover the span, else a week."""
    out = F.when(span_ms <= MINUTE * MOST_BUCKETS, F.lit(MINUTE))
    for width in (HOUR, DAY):
        out = out.when(span_ms <= width * MOST_BUCKETS, F.lit(width))
    return out.otherwise(F.lit(WEEK)).cast("long")


def bucket_index(ms: Column, width: Column, offset_min: int = 0) -> Column:
    """Floor of the shifted time over the width, also for negative times."""
    shifted = ms + F.lit(offset_min * MINUTE).cast("long") + F.when(width == WEEK, F.lit(WEEK_PHASE)).otherwise(F.lit(0)).cast("long")
    return ((shifted - F.pmod(shifted, width)) / width).cast("long")


def bucket_start(index: Column, width: Column, offset_min: int = 0) -> Column:
    phase = F.when(width == WEEK, F.lit(WEEK_PHASE)).otherwise(F.lit(0)).cast("long")
    return index * width - F.lit(offset_min * MINUTE).cast("long") - phase


def histogram(frame: DataFrame, width: int | None = None, offset_min: int = 0) -> DataFrame:
    """(bucket_start, width, calls, failures, refusals), empty buckets too. Calls without a time are in none."""
    timed = frame.filter("called_at IS NOT NULL").select("called_at", "success", "decision")
    bounds = span(timed)
    chosen = F.lit(width).cast("long") if width else width_for(F.col("last_at") - F.col("first_at"))
    one = bounds.filter("first_at IS NOT NULL").withColumn("width", chosen)
    rows = timed.crossJoin(F.broadcast(one))  # one row
    counted = (
        rows.groupBy(bucket_index(F.col("called_at"), F.col("width"), offset_min).alias("b"))
        .agg(
            F.count("*").alias("calls"),
            F.count_if(F.col("success") == F.lit(False)).alias("failures"),
            F.count_if(F.col("decision") == "reject").alias("refusals"),
        )
    )
    at = lambda c: bucket_index(F.col(c), F.col("width"), offset_min)
    whole = one.select("width", F.explode(F.sequence(at("first_at"), at("last_at"))).alias("b"))
    return (
        whole.join(counted, "b", "left")
        .fillna(0, ["calls", "failures", "refusals"])
        .select(bucket_start(F.col("b"), F.col("width"), offset_min).alias("bucket_start"), "width", "calls", "failures", "refusals")
        .orderBy("bucket_start")
    )


def facet(frame: DataFrame, column: str) -> DataFrame:
    """Distinct values; null is none."""
    return frame.filter(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def tool_facet(calls: DataFrame) -> DataFrame:
    return calls.filter("tool_name IS NOT NULL").groupBy("tool_name").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "tool_name")


def facets(frame: DataFrame) -> dict[str, DataFrame]:
    names = ("project_path", "decision_source", "permission_mode", "agent_name")
    return {"tool_name": tool_facet(frame), **{n: facet(frame, n) for n in names if n in frame.columns}}


def totals(calls: DataFrame, sessions: DataFrame, requests: DataFrame, prompts: DataFrame, raw: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    parts = [
        calls.agg(F.count("*").alias("calls"), F.min("called_at").alias("first_at"), F.max("called_at").alias("last_at")),
        sessions.agg(F.count("*").alias("sessions")),
        requests.agg(F.count("*").alias("requests"), zero("cost_usd_micros"), zero("input_tokens"), zero("output_tokens")),
        prompts.agg(F.count("*").alias("prompts")),
        raw.agg(F.count("*").alias("events")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # each is one row
    return out


def tool_usage(calls: DataFrame, percents: tuple[int, ...] = (50, 95)) -> DataFrame:
    """Per tool: calls, failures and nearest-rank percentiles of the duration. Durations are counted by value first, so a
    busy tool's window partition has a row for each different duration and not for each call."""
    base = calls.groupBy("tool_name").agg(F.count("*").alias("calls"), F.count_if(F.col("success") == F.lit(False)).alias("failures"))
    by_value = calls.filter("duration_ms IS NOT NULL").groupBy("tool_name", "duration_ms").agg(F.count("*").alias("k"))
    w = W.partitionBy("tool_name")
    ranked = by_value.select(
        "tool_name", "duration_ms",
        F.sum("k").over(w.orderBy("duration_ms").rowsBetween(W.unboundedPreceding, W.currentRow)).alias("upto"),
        F.sum("k").over(w).alias("n"),
    )
    # The smallest value with rank ceil(n * p / 100) or more at or before it.
    at = lambda p: F.min(F.when(F.col("upto") >= F.expr(f"(n * {p} + 99) div 100"), F.col("duration_ms"))).alias(f"p{p}_ms")
    durations = ranked.groupBy("tool_name").agg(*map(at, percents)).withColumnRenamed("tool_name", "t")
    out = base.join(durations, F.col("tool_name").eqNullSafe(F.col("t")), "left").drop("t")
    return out.orderBy(F.desc("calls"), "tool_name")


def ingest_summary(raw: DataFrame) -> DataFrame:
    lane = lambda name: F.count_if(F.col("lane") == name).alias(f"{name}_events")
    files = F.count_distinct(F.when(F.col("lane") == "transcript", F.col("source_ref"))).alias("files")
    return raw.agg(files, lane("transcript"), lane("otlp"), F.max("ingested_at").alias("last_ingest"))


def events_since(raw: DataFrame, ms: int) -> DataFrame:
    return raw.filter(F.col("ingested_at") >= ms).agg(F.count("*").alias("events"))


def sessions_list(sessions: DataFrame, limit: int | None = None) -> DataFrame:
    out = sessions.orderBy(F.desc_nulls_last("last_seen"), "session_id")
    return out.limit(limit) if limit else out


def size_words(n: Column) -> Column:
    """A number of bytes in the units that a person reads; halves go to the even digit."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for power, unit, digits in ((1, "KiB", 1), (2, "MiB", 1)):
        out = out.when(n < 1024 ** (power + 1), F.format_string(f"%.{digits}f {unit}", F.bround(n / 1024**power, digits)))
    return out.otherwise(F.format_string("%.2f GiB", F.bround(n / 1024**3, 2)))


def start_of_day(ms: Column, offset_ms: int = 0) -> Column:
    """The last local midnight at or before a time, for a zone so far east of UTC."""
    return ms - F.pmod(ms + offset_ms, F.lit(DAY))
