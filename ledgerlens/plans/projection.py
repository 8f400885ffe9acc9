"""Evidence to derived tables, both lanes at once: rebuilding is the same as projecting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import telemetry as T
from ..functions.redact import Pattern, redacted, redacted_json
from ..operators import merge as M
from ..schemas import ENVELOPE
from ..sources import telemetry as telemetry_source
from ..staging import materialize, whole_variants

KNOWN_RECORDS = ("assistant", "user", "agent-name", "relocated", "permission-mode")


def envelopes(evidence: DataFrame) -> DataFrame:
    """Transcript rows with their envelope's fields; ``parsable`` is false for lines that aren't JSON objects."""
    rows = evidence.filter("lane = 'transcript'").select("id", "source_ref", "body")
    # JSON text that begins with a brace is an object: its kind as a variant would take a schema of the whole line.
    good = F.try_parse_json("body").isNotNull() & F.ltrim("body", F.lit(" \t\r\n")).startswith("{")
    out = rows.withColumn("parsable", F.coalesce(good, F.lit(False))).withColumn("e", F.when(F.col("parsable"), F.from_json("body", ENVELOPE, {"mode": "PERMISSIVE"})))
    out = out.select("id", "source_ref", "parsable", "body", "e.*").withColumn("ts", N.timestamp_ms(F.col("timestamp"))).withColumn("content", F.col("message.content"))
    answered = (F.col("type") == "user") & F.col("toolUseResult").isNotNull()
    # What is under the key "data" in the result says so in the line, or has escapes in it.
    named = F.col("body").contains('"data"') | F.col("body").contains("\\u")
    elidable = F.coalesce(F.when(answered & named, N.elidable(F.to_json("toolUseResult"))), F.lit(False))
    return out.withColumn("ref", F.when(answered, N.result_reference(F.col("content")))).withColumn("elidable", elidable).drop("body")


def transcript_facts(records: DataFrame) -> dict[str, DataFrame]:
    good = records.filter("parsable")
    sessions = good.filter("sessionId IS NOT NULL").select(
        "id", F.col("sessionId").alias("session_id"), F.coalesce("relocatedCwd", "cwd").alias("project_path"), F.col("source_ref").alias("transcript_path"),
        F.coalesce("relocatedCwd", "cwd").alias("cwd"), F.col("gitBranch").alias("git_branch"), F.col("version").alias("cc_version"), "entrypoint",
        F.col("agentName").alias("agent_name"), "slug", F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"), F.col("relocatedCwd").alias("relocated_cwd"),
    )
    seen = good.select("id", F.col("sessionId").alias("session_id"), F.col("permissionMode").alias("mode"), F.coalesce("type", F.lit("")).alias("trigger"), "ts")
    moded = M.mode_at_record(good.withColumnRenamed("sessionId", "session_id").withColumnRenamed("permissionMode", "mode"))
    used = N.tool_uses(moded.filter("type = 'assistant'"))
    v = F.col("use_input")
    uses = used.select(
        "id", F.col("use_id").alias("tool_use_id"), F.lit(1).alias("bit"), "session_id", F.col("promptId").alias("prompt_id"), F.col("uuid").alias("message_uuid"),
        F.col("parentUuid").alias("parent_uuid"), F.col("isSidechain").alias("is_sidechain"), F.col("agentId").alias("agent_id"), F.col("attributionAgent").alias("agent_name"),
        F.col("use_name").alias("tool_name"), N.tool_kind(F.col("use_name")).alias("tool_kind"), N.mcp_server(F.col("use_name")).alias("mcp_server"),
        N.mcp_tool(F.col("use_name")).alias("mcp_tool"), F.col("ts").alias("called_at"), F.coalesce(F.to_json(v), F.lit("null")).alias("input_json"),
        N.input_summary(F.col("use_name"), v).alias("input_summary"), N.target_path(F.col("use_name"), v).alias("target_path"), F.col("mode_now").alias("permission_mode"),
        N.string_at(v, "$.subagent_type").alias("subagent_type"),
    )
    r, wrong, kind = F.col("toolUseResult"), F.col("ref.is_error"), F.col("kind")
    results = good.filter("ref IS NOT NULL").withColumn("kind", N.variant_kind(r)).select(
        "id", F.col("ref.tool_use_id").alias("tool_use_id"), F.lit(1).alias("bit"), F.col("sessionId").alias("session_id"), F.col("agentId").alias("agent_id"),
        F.col("ts").alias("completed_at"), F.to_json(r).alias("result_json"), "elidable", N.result_text(r, kind).alias("result_text"),
        N.result_success(r, wrong, kind).alias("success"), N.string_at(r, "$.agentId").alias("spawned_agent"), r.alias("result"),
    )
    return {"sessions": sessions, "modes": seen, "uses": uses, "results": results}


def facts_of(evidence: DataFrame, patterns: list[Pattern] | None = None) -> dict[str, DataFrame]:
    """What each record states, row by row, with secrets redacted where ``patterns`` are given: no fact looks at another
    record, so facts of a part of the evidence are that part of the facts. Each lane's records are parsed once and written:
    nine tables of facts are read from them."""
    text = (lambda c: redacted(F.col(c), patterns)) if patterns else F.col
    body = (lambda c: redacted_json(F.col(c), patterns)) if patterns else F.col
    # Contents are looked at for calls; what a result answers is told already.
    records = envelopes(evidence).drop("message").withColumn("content", F.when(F.col("type") == "assistant", F.col("content")))
    with whole_variants(evidence.sparkSession):
        t = transcript_facts(materialize(records, "projection-records"))
    events = materialize(T.common(telemetry_source.parsed(evidence)).withColumn("class", T.event_class()), "projection-events")
    clean = lambda df: df.withColumn("input_json", body("input_json")).withColumn("input_summary", text("input_summary")).withColumn("target_path", text("target_path"))
    # Only results that may hold long binary data go through Python.
    whole, elidable = t["results"].filter("NOT elidable"), t["results"].filter("elidable").withColumn("result_json", N.elided(F.col("result_json")))
    results = whole.unionByName(elidable).drop("elidable").withColumn("result_json", body("result_json")).withColumn("result_text", text("result_text"))
    results = results.withColumn("result_size", F.octet_length("result_json").cast("long")).withColumn("result_json", N.by_reference(F.col("result_json")))
    changes = N.file_changes(t["results"].select(F.struct("session_id", "tool_use_id").alias("ref"), "result"), "ref")
    return {
        "session": M.union_facts(t["sessions"], T.session_facts(events)),
        "mode": t["modes"],
        "told_mode": T.mode_facts(events),
        "use": clean(t["uses"].drop("permission_mode")),
        "result": results.drop("result"),
        "asked": clean(T.call_facts(events)),
        "change": changes.select("tool_use_id.session_id", "tool_use_id.tool_use_id", *[c for c in changes.columns if c != "tool_use_id"]),
        "request": T.request_facts(events),
        "prompt": T.prompt_facts(events),
    }


def tables_of(facts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The derived tables of these facts."""
    uses, results = facts["use"], facts["result"]
    told = M.union_facts(uses.drop("subagent_type"), results.drop("spawned_agent"), facts["asked"])
    # The mode at a call's record is one more fact of the record.
    thin = M.merge_lanes(M.union_facts(told, M.mode_at_use(facts["mode"], uses)).select(*M.THIN))
    changes = M.mode_changes(facts["mode"]).unionByName(facts["told_mode"])
    spawned = uses.filter("tool_kind = 'agent'").select("id", "tool_use_id", "subagent_type")
    answers = results.select("tool_use_id", F.col("spawned_agent").alias("agent_id"))
    named = uses.select("id", "agent_id", F.col("agent_name").alias("agent_type"))
    return {
        "session": M.merge_sessions(facts["session"]),
        "tool_call": M.complete_lanes(told, materialize(thin, "projection-calls"), M.agent_types(spawned, answers, named), changes),
        "file_change": facts["change"].drop("session_id"),
        "api_request": M.merge_requests(facts["request"]),
        "prompt": M.merge_prompts(facts["prompt"]),
        "permission_mode_change": changes,
    }


def project(evidence: DataFrame, patterns: list[Pattern] | None = None) -> dict[str, DataFrame]:
    """All derived tables of the evidence, from both lanes, with secrets redacted where ``patterns`` are given. Facts that
    several tables, or several steps of one, are derived from are written first."""
    facts = facts_of(evidence, patterns)
    shared = ("mode", "told_mode", "use", "result")
    return tables_of(facts | {k: materialize(facts[k], f"projection-{k}") for k in shared})


def transcript_counters(evidence: DataFrame) -> DataFrame:
    """records, sessions, tool uses and results, unknown and unparsable records."""
    records = envelopes(evidence)
    known = F.col("type").isin(*KNOWN_RECORDS)
    unanswered = (F.col("type") == "user") & F.col("toolUseResult").isNull()
    blocks = F.filter(N.blocks_of(F.col("content")), lambda b: (N.string_at(b, "$.type") == "tool_use") & N.string_at(b, "$.id").isNotNull() & N.string_at(b, "$.name").isNotNull())
    return records.agg(
        F.count_if("parsable").alias("records"),
        F.count_distinct("sessionId").alias("sessions"),
        F.coalesce(F.sum(F.when(F.col("type") == "assistant", F.size(blocks))), F.lit(0)).alias("tool_uses"),
        F.count_if((F.col("type") == "user") & F.col("toolUseResult").isNotNull() & N.result_reference(F.col("content")).isNotNull()).alias("tool_results"),
        F.count_if(F.col("parsable") & (~F.coalesce(known, F.lit(False)) | unanswered)).alias("unknown_records"),
        F.count_if(~F.col("parsable")).alias("unparsable"),
    )
