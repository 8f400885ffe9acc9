"""Completeness: what both lanes saw, and where only one did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schemas import OTLP, TRANSCRIPT


def has(bit: int) -> Column:
    return F.col("provenance").bitwiseAND(bit) != 0


def lane_word() -> Column:
    return F.when(has(TRANSCRIPT) & has(OTLP), "both").when(has(TRANSCRIPT), "transcript").when(has(OTLP), "otlp")


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def reconcile(calls: DataFrame) -> DataFrame:
    counted = calls.agg(
        F.count_if(has(TRANSCRIPT) & has(OTLP)).alias("both"),
        F.count_if(has(TRANSCRIPT) & ~has(OTLP)).alias("transcript_only"),
        F.count_if(~has(TRANSCRIPT) & has(OTLP)).alias("otlp_only"),
        F.count_if(F.col("decision") == "reject").alias("rejected"),
    )
    return counted.withColumn("both_ratio", ratio(F.col("both"), F.col("both") + F.col("transcript_only") + F.col("otlp_only")))


def completeness(calls: DataFrame, requests: DataFrame) -> DataFrame:
    """Sessions, those with an undecided call, calls with a time, requests. Calls without a session count in none."""
    by_session = calls.filter("session_id IS NOT NULL").groupBy("session_id").agg(F.count_if(~has(OTLP)).alias("undecided"))
    return (
        by_session.agg(F.count("*").alias("sessions"), F.count_if(F.col("undecided") > 0).alias("sessions_undecided"))
        .crossJoin(calls.agg(F.count("called_at").alias("timed_calls")))
        .crossJoin(requests.agg(F.count("*").alias("requests")))
    )


def session_completeness(calls: DataFrame, sessions: DataFrame, limit: int | None = 50) -> DataFrame:
    """The least complete sessions first."""
    by = calls.filter("session_id IS NOT NULL").groupBy("session_id").agg(
        F.count("*").alias("calls"),
        F.count_if(has(OTLP)).alias("decided"),
        F.count_if(F.col("decision") == "reject").alias("rejected"),
        F.min("called_at").alias("first_at"),
        F.max("called_at").alias("last_at"),
    )
    out = by.join(sessions.select("session_id", "project_path"), "session_id", "left").withColumn("ratio", ratio(F.col("decided"), F.col("calls")))
    out = out.orderBy("ratio", F.desc("calls"), "session_id")
    return out.limit(limit) if limit else out


def gaps(calls: DataFrame, limit: int | None = 20) -> DataFrame:
    """Runs of calls, in order of time, that the telemetry lane did not see.

    A run is the calls with equally many decided ones before them. That count is a prefix sum over a range partitioning:
    a window within each range and one small row for each range, so no task holds the whole order.
    """
    timed = calls.filter("called_at IS NOT NULL").select("called_at", "row_seq", "session_id", has(OTLP).cast("long").alias("seen"))
    # The hour is a range: all rows of an hour are together, and hours are ordered.
    timed = timed.withColumn("hour", F.expr("(called_at - pmod(called_at, 3600000L)) div 3600000L"))
    hours = timed.groupBy("hour").agg(F.sum("seen").alias("n"))
    # A two-level running sum: days of hours, then hours within days.
    day = F.expr("(hour - pmod(hour, 24L)) div 24L")
    days = hours.groupBy(day.alias("day")).agg(F.sum("n").alias("d"))
    before_day = days.select("day", (F.sum("d").over(W.orderBy("day")) - F.col("d")).alias("before_day"))
    before = hours.withColumn("day", day).join(before_day, "day").select(
        "hour", (F.col("before_day") + F.sum("n").over(W.partitionBy("day").orderBy("hour")) - F.col("n")).alias("before")
    )
    inside = F.sum("seen").over(W.partitionBy("hour").orderBy("called_at", "row_seq").rowsBetween(W.unboundedPreceding, W.currentRow))
    runs = timed.withColumn("inside", inside).join(before, "hour").withColumn("run", F.col("before") + F.col("inside"))
    out = (
        runs.filter("seen = 0")
        .groupBy("run")
        .agg(F.min("called_at").alias("from_at"), F.max("called_at").alias("to_at"), F.count("*").alias("calls"), F.count_distinct("session_id").alias("sessions"))
        .drop("run")
        .withColumn("duration_ms", F.col("to_at") - F.col("from_at"))
        .orderBy(F.desc("calls"), "from_at")
    )
    return out.limit(limit) if limit else out
