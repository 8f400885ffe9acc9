"""Retention: which sessions go, what that frees, and the rewritten tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


@dataclass(frozen=True)
class Scope:
    """Exactly one of these is set."""

    before: int | None = None
    fit_bytes: int | None = None
    session_id: str | None = None
    project_path: str | None = None

    def __post_init__(self) -> None:
        if sum(v is not None for v in (self.before, self.fit_bytes, self.session_id, self.project_path)) != 1:
            raise ValueError("a scope has exactly one condition")


def _age() -> F.Column:
    return F.coalesce("last_seen", "first_seen", F.lit(0).cast("long"))


def evidence_bytes(sessions: DataFrame, raw: DataFrame) -> DataFrame:
    """(session_id, events, bytes) of each session's transcript: evidence is summed by path before the join."""
    by_path = raw.filter("lane = 'transcript'").groupBy(F.col("source_ref").alias("transcript_path")).agg(
        F.count("*").alias("events"), F.sum(F.octet_length("body").cast("long")).alias("bytes")
    )
    return sessions.select("session_id", "transcript_path").join(by_path, "transcript_path").select("session_id", "events", "bytes")


def fit_cutoff(sessions: DataFrame, raw: DataFrame, cap: int) -> DataFrame:
    """(cutoff): sessions older than it go, oldest first, until what is left fits; null if all fits already."""
    sized = sessions.join(evidence_bytes(sessions, raw), "session_id", "left").select("session_id", _age().alias("age"), F.coalesce("bytes", F.lit(0)).alias("bytes"))
    # One row for each age; a session's age decides, so equal ages go together.
    by_age = sized.groupBy("age").agg(F.sum("bytes").alias("bytes"))
    day = F.expr("age div 86400000L")
    days = by_age.groupBy(day.alias("day")).agg(F.sum("bytes").alias("d"))
    upto = days.select("day", (F.sum("d").over(W.orderBy("day")) - F.col("d")).alias("before"))
    running = by_age.withColumn("day", day).join(upto, "day").withColumn("gone", F.col("before") + F.sum("bytes").over(W.partitionBy("day").orderBy("age")))
    whole = by_age.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("whole"))
    enough = running.crossJoin(F.broadcast(whole)).filter(F.col("whole") - F.col("gone") <= cap)
    return enough.agg(F.min("age").alias("age"), F.max("whole").alias("whole")).select(F.when(F.col("whole") > cap, F.col("age") + 1).alias("cutoff"))


def doomed(sessions: DataFrame, raw: DataFrame, scope: Scope) -> DataFrame:
    if scope.before is not None:
        return sessions.filter(_age() < scope.before)
    if scope.session_id is not None:
        return sessions.filter(F.col("session_id") == scope.session_id)
    if scope.project_path is not None:
        return sessions.filter(F.col("project_path") == scope.project_path)
    return sessions.crossJoin(F.broadcast(fit_cutoff(sessions, raw, scope.fit_bytes))).filter(_age() < F.col("cutoff")).drop("cutoff")


def preview(sessions: DataFrame, calls: DataFrame, raw: DataFrame, scope: Scope) -> DataFrame:
    """(session_id, project_path, last_seen, calls, events, bytes) of the sessions that would go, oldest first."""
    n = calls.groupBy("session_id").agg(F.count("*").alias("calls"))
    out = doomed(sessions, raw, scope).join(n, "session_id", "left").join(evidence_bytes(sessions, raw), "session_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("session_id", "project_path", "last_seen", zero("calls"), zero("events"), zero("bytes")).orderBy("last_seen", "session_id")


def otlp_older(raw: DataFrame, cutoff: int) -> DataFrame:
    return raw.filter(F.col("lane") == "otlp").filter(F.col("ingested_at") < cutoff)


def preview_totals(sessions: DataFrame, calls: DataFrame, raw: DataFrame, scope: Scope) -> DataFrame:
    """One row; telemetry rows older than the cutoff count too."""
    rows = preview(sessions, calls, raw, scope)
    sums = rows.agg(F.count("*").alias("sessions"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("calls", "events", "bytes")])
    otlp = otlp_older(raw, scope.before).agg(F.count("*").alias("otlp_events")) if scope.before is not None else rows.limit(1).agg(F.lit(0).cast("long").alias("otlp_events"))
    return sums.crossJoin(otlp)


def hole(raw: DataFrame, removed: DataFrame) -> DataFrame:
    """(first_id, last_id, chain_before): the removed ids' bounds and the chain value just before them."""
    ends = removed.agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    before = raw.select("id", "chain_sha256").crossJoin(F.broadcast(ends)).filter(F.col("id") < F.col("first_id")).agg(F.max_by("chain_sha256", "id").alias("chain_before"))
    return ends.crossJoin(before)


def purge(tables: dict[str, DataFrame], scope: Scope, now: int) -> dict[str, DataFrame]:
    """New versions of ``tables`` (session, tool_call, file_change, api_request, prompt, permission_mode_change, raw_event)
    without what the scope covers, and ``deletion``, the row to append to that ledger. The other ledgers stay as they
    are. Write all of them to a new place before the old one is replaced."""
    sessions, raw = tables["session"], tables["raw_event"]
    gone = doomed(sessions, raw, scope).select("session_id", "transcript_path")
    ids = gone.select("session_id")
    paths = gone.filter("transcript_path IS NOT NULL").select(F.col("transcript_path").alias("source_ref")).distinct()
    removed = raw.filter("lane = 'transcript'").join(paths, "source_ref", "left_semi")
    if scope.before is not None:
        removed = removed.unionByName(otlp_older(raw, scope.before).select(*removed.columns))
    out = {k: v.join(ids, "session_id", "left_anti") for k, v in tables.items() if "session_id" in v.columns}
    if "file_change" in tables:
        calls = tables["tool_call"].join(ids, "session_id", "left_semi").select("tool_use_id")
        out["file_change"] = tables["file_change"].join(calls, "tool_use_id", "left_anti")
    out["raw_event"] = raw.join(removed.select("id"), "id", "left_anti")
    words = next(f"{k}={v}" for k, v in vars(scope).items() if v is not None)
    n_calls = tables["tool_call"].join(ids, "session_id", "left_semi").agg(F.count("*").alias("calls"))
    n_events = removed.agg(F.count("*").alias("events"), F.coalesce(F.sum(F.octet_length("body").cast("long")), F.lit(0)).alias("bytes"))
    out["deletion"] = (
        ids.agg(F.count("*").alias("sessions")).crossJoin(n_calls).crossJoin(n_events).crossJoin(hole(raw, removed))
        .select(F.lit(now).alias("id"), F.lit(now).alias("at"), F.lit(words).alias("scope"), "sessions", "calls", "events", "bytes", "first_id", "last_id", "chain_before")
    )
    return out


def deletions(ledger: DataFrame) -> DataFrame:
    return ledger.orderBy(F.desc("at"), F.desc("id"))
