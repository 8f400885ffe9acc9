"""Derived tables as aggregations over facts in evidence order.

Every merge is tolerant of order: the last known value of a column is its value at the greatest evidence id where it
is known, so a table is one grouping, and rebuilding it gives the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def last_known(column: str, order: str = "id") -> Column:
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order))).alias(column)


def first_known(column: str, order: str = "id") -> Column:
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col(order))).alias(column)


SESSION_LAST = ("project_path", "transcript_path", "cwd", "git_branch", "cc_version", "entrypoint", "agent_name", "slug")
#: Columns that either lane may write: the later writer wins.
SHARED = ("session_id", "prompt_id", "message_uuid", "tool_name", "tool_kind", "mcp_server", "mcp_tool", "called_at", "success")
TRANSCRIPT_ONLY = ("parent_uuid", "is_sidechain", "agent_id", "agent_name", "completed_at", "result_json", "result_text", "result_size", "permission_mode")
OTLP_ONLY = ("duration_ms", "error_type", "decision", "decision_source")
#: What the calls' facts are merged for first, in narrow rows: who is named how, and which mode holds.
THIN = ("id", "tool_use_id", "bit", "session_id", "called_at", "agent_id", "agent_name", "permission_mode")
#: The transcript has them in full, so its value wins over telemetry's.
INPUTS = ("input_json", "input_summary", "target_path")


def merge_sessions(facts: DataFrame) -> DataFrame:
    """facts(id, session columns, relocated_cwd): one row for each session; a relocation has the last word on its place."""
    merged = facts.filter("session_id IS NOT NULL").groupBy("session_id").agg(
        *[last_known(c) for c in SESSION_LAST],
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        last_known("relocated_cwd"),
    )
    moved = lambda c: F.coalesce("relocated_cwd", c).alias(c)
    return merged.withColumn("project_path", moved("project_path")).withColumn("cwd", moved("cwd")).drop("relocated_cwd")


def merge_lanes(facts: DataFrame) -> DataFrame:
    """facts(id, tool_use_id, bit, tool_call columns) of both lanes -> one row for each call. One grouping of the union
    of both lanes; never a join that could repeat rows. A lane may be absent, and so may columns."""
    columns = [c for c in (*SHARED, *TRANSCRIPT_ONLY, *OTLP_ONLY, "named") if c in facts.columns]
    inputs = [c for c in INPUTS if c in facts.columns]
    own = lambda c, bit: F.when(F.col("bit") == bit, F.col(c))
    prepared = facts
    for c in inputs:
        prepared = prepared.withColumn(f"{c}_t", own(c, 1)).withColumn(f"{c}_o", own(c, 2))
    merged = prepared.groupBy("tool_use_id").agg(
        *[last_known(c) for c in columns],
        *[last_known(f"{c}_t") for c in inputs],
        *[first_known(f"{c}_o") for c in inputs],
        F.bit_or("bit").alias("provenance"),
        F.min("id").alias("row_seq"),
    )
    for c in inputs:
        merged = merged.withColumn(c, F.coalesce(f"{c}_t", f"{c}_o")).drop(f"{c}_t", f"{c}_o")
    return merged


def merge_transcript(facts: DataFrame) -> DataFrame:
    return merge_lanes(facts.filter("bit = 1"))


def merge_otlp(facts: DataFrame) -> DataFrame:
    return merge_lanes(facts.filter("bit = 2"))


def merge_requests(facts: DataFrame) -> DataFrame:
    """The first row stays; only cost and duration are filled or changed by later ones."""
    later = ("cost_usd_micros", "duration_ms")
    kept = [c for c in facts.columns if c not in ("id", "request_id", *later)]
    first = F.min_by(F.struct(*kept), "id").alias("x")
    return facts.groupBy("request_id").agg(first, *[last_known(c) for c in later]).select("request_id", "x.*", *later)


def merge_prompts(facts: DataFrame) -> DataFrame:
    last = ("session_id", "ts", "prompt_length", "command_name")
    return facts.groupBy("prompt_id").agg(*[last_known(c) for c in last], first_known("command_source"))


def mode_changes(seen: DataFrame) -> DataFrame:
    """seen(id, session_id, mode, trigger, ts): rows where a session's mode differs from the one before, in evidence order;
    the first has no from_mode. Evidence order is by session, whose records are one file's."""
    w = W.partitionBy("session_id").orderBy("id")
    known = seen.filter("session_id IS NOT NULL AND mode IS NOT NULL").withColumn("from_mode", F.lag("mode").over(w))
    return known.filter(~F.col("mode").eqNullSafe(F.col("from_mode"))).select("id", "session_id", "from_mode", F.col("mode").alias("to_mode"), "trigger", "ts")


def mode_at_record(records: DataFrame) -> DataFrame:
    """records(id, session_id, mode): adds ``mode_now``, the last mode seen up to each record."""
    w = W.partitionBy("session_id").orderBy("id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return records.withColumn("mode_now", F.when(F.col("session_id").isNotNull(), F.last("mode", ignorenulls=True).over(w)))


def mode_at_use(seen: DataFrame, uses: DataFrame) -> DataFrame:
    """seen(id, session_id, mode), uses(id, session_id, tool_use_id) -> facts (id, tool_use_id, bit, permission_mode): the last
    mode that the session's records up to the call's own name. Calls without one have no such fact."""
    marks = seen.filter("session_id IS NOT NULL AND mode IS NOT NULL").select("session_id", "id", F.lit(0).alias("is_use"), F.lit(None).cast("string").alias("tool_use_id"), "mode")
    asked = uses.filter("session_id IS NOT NULL").select("session_id", "id", F.lit(1).alias("is_use"), "tool_use_id", F.lit(None).cast("string").alias("mode"))
    w = W.partitionBy("session_id").orderBy("id", "is_use").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = marks.unionByName(asked).withColumn("permission_mode", F.last("mode", ignorenulls=True).over(w))
    return found.filter("is_use = 1 AND permission_mode IS NOT NULL").select("id", "tool_use_id", F.lit(1).alias("bit"), "permission_mode")


def last_known_mode(changes: DataFrame, calls: DataFrame) -> DataFrame:
    """(session_id, mode): the newest change's, else the newest call's."""
    change = changes.filter("to_mode IS NOT NULL").groupBy("session_id").agg(F.max_by("to_mode", F.struct("ts", "id")).alias("a"))
    call = calls.filter("permission_mode IS NOT NULL").groupBy("session_id").agg(F.max_by("permission_mode", F.struct("called_at", "row_seq")).alias("b"))
    return change.join(call, "session_id", "full").select("session_id", F.coalesce("a", "b").alias("mode"))


def inherited_modes(calls: DataFrame, changes: DataFrame) -> DataFrame:
    """(tool_use_id, row_seq, inherited) of the calls without a mode whose session has changes: the latest change at or before
    the call, else the session's first one.

    The as-of join is a union of both sides and a window over (session, time) that carries the last mode on; calls without
    a time come before all changes.
    """
    none = F.lit(None).cast("string")
    first = changes.filter("to_mode IS NOT NULL").groupBy("session_id").agg(F.min_by("to_mode", "id").alias("first_mode"))
    asked = calls.filter("permission_mode IS NULL AND session_id IS NOT NULL").select("session_id", F.col("called_at").alias("at"), F.lit(1).alias("is_call"), F.col("row_seq").alias("seq"), "tool_use_id", none.alias("mode"))
    marks = changes.filter("to_mode IS NOT NULL AND ts IS NOT NULL").select("session_id", F.col("ts").alias("at"), F.lit(0).alias("is_call"), F.col("id").alias("seq"), none.alias("tool_use_id"), F.col("to_mode").alias("mode"))
    w = W.partitionBy("session_id").orderBy(F.asc_nulls_first("at"), "is_call", "seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    line = asked.join(first, "session_id").unionByName(marks, allowMissingColumns=True).withColumn("as_of", F.last("mode", ignorenulls=True).over(w))
    return line.filter("is_call = 1").select("tool_use_id", F.col("seq").alias("row_seq"), F.coalesce("as_of", "first_mode").alias("inherited"))


def inherit_modes(calls: DataFrame, changes: DataFrame) -> DataFrame:
    """Fills permission_mode as of each call."""
    out = calls.join(inherited_modes(calls, changes).drop("row_seq"), "tool_use_id", "left")
    return out.withColumn("permission_mode", F.coalesce("permission_mode", "inherited")).select(*calls.columns)


def agent_types(spawned: DataFrame, results: DataFrame, named: DataFrame) -> DataFrame:
    """(agent_id, agent_type): what a spawning call (id, tool_use_id, subagent_type) asked for, joined to its result
    (tool_use_id, agent_id), and types that records (id, agent_id, agent_type) state themselves; the last one holds."""
    asked = spawned.filter("subagent_type IS NOT NULL").join(results.filter("agent_id IS NOT NULL"), "tool_use_id")
    every = asked.select("id", "agent_id", F.col("subagent_type").alias("agent_type")).unionByName(named.filter("agent_id IS NOT NULL AND agent_type IS NOT NULL").select("id", "agent_id", "agent_type"))
    return every.groupBy("agent_id").agg(F.max_by("agent_type", "id").alias("agent_type"))


def _peers(calls: DataFrame) -> DataFrame:
    return calls.filter("agent_id IS NOT NULL AND agent_name IS NOT NULL").groupBy("agent_id").agg(F.min_by("agent_name", "row_seq").alias("peer"))


def agent_names(calls: DataFrame, types: DataFrame) -> DataFrame:
    """(tool_use_id, row_seq, named) of the calls that name_agents gives another name than they have."""
    known = types.join(_peers(calls), "agent_id", "full")
    out = calls.filter("agent_id IS NOT NULL").join(known, "agent_id").withColumn("named", F.coalesce("agent_type", "agent_name", "peer"))
    return out.filter(~F.col("named").eqNullSafe(F.col("agent_name"))).select("tool_use_id", "row_seq", "named")


def complete_lanes(facts: DataFrame, thin: DataFrame, types: DataFrame, changes: DataFrame) -> DataFrame:
    """merge_lanes, with agents named and modes inherited; ``thin`` is merge_lanes of the THIN columns, written. Names and
    modes are told by narrow rows and come back as facts of their calls, so wide rows take part in one grouping and no join."""
    kept = thin.filter("permission_mode IS NOT NULL").select("tool_use_id", "row_seq", "permission_mode")
    modes = kept.unionByName(inherited_modes(thin, changes).withColumnRenamed("inherited", "permission_mode"))
    late = union_facts(modes, agent_names(thin, types)).withColumnRenamed("row_seq", "id")
    merged = merge_lanes(union_facts(facts.drop("permission_mode"), late))
    return merged.withColumn("agent_name", F.coalesce("named", "agent_name")).drop("named")


def name_agents(calls: DataFrame, types: DataFrame) -> DataFrame:
    """A known type overrides; else a missing name is taken from the agent's first named call."""
    peers = _peers(calls)
    out = calls.join(types, "agent_id", "left").join(peers, "agent_id", "left")
    return out.withColumn("agent_name", F.coalesce("agent_type", "agent_name", "peer")).select(*calls.columns)


def union_facts(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
