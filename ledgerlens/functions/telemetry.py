"""From telemetry log records to facts, as Columns over the attribute list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import normalize as N

#: Fixed value: the prefix of qualified event names.
PREFIX = "claude_code."
NANOS = 1_000_000
PARAMETER_KEYS = ("full_command", "bash_command", "skill_name", "subagent_type", "description")


def attribute(key: str, attributes: str = "attributes") -> Column:
    """The value struct of the first attribute with this key."""
    return F.get(attributes, (F.array_position(F.col(f"{attributes}.key"), key) - 1).cast("int"))["value"]


def string(key: str) -> Column:
    return F.nullif(attribute(key)["stringValue"], F.lit(""))


def integer(key: str) -> Column:
    v = attribute(key)
    return F.coalesce(v["intValue"].try_cast("long"), v["doubleValue"].try_cast("long"), v["stringValue"].try_cast("long"))


def floating(key: str) -> Column:
    v = attribute(key)
    return F.coalesce(v["doubleValue"], v["intValue"].try_cast("double"), v["stringValue"].try_cast("double"))


def boolean(key: str) -> Column:
    v = attribute(key)
    text = F.when(v["stringValue"].isin("true", "True", "1"), True).when(v["stringValue"].isin("false", "False", "0"), False)
    return F.coalesce(v["boolValue"], text, v["intValue"].try_cast("long") != 0)


def strings(key: str) -> Column:
    v = attribute(key)
    listed = F.array_compact(F.transform(v["arrayValue"]["values"], lambda x: x["stringValue"]))
    return F.coalesce(listed, F.when(v["stringValue"].isNotNull(), F.array(v["stringValue"])))


def json_value(key: str) -> Column:
    return F.try_parse_json(attribute(key)["stringValue"])


def common(records: DataFrame) -> DataFrame:
    """records(id, attributes, body, eventName, ...) -> with event_name, session and time."""
    name = F.coalesce(string("event.name"), F.nullif("eventName", F.lit("")), F.nullif("body.stringValue", F.lit("")), F.lit(""))
    bare = F.when(name.startswith(PREFIX), F.substring(name, len(PREFIX) + 1, 1 << 20)).otherwise(name)
    nanos = lambda c: F.expr(f"CASE WHEN try_cast({c} AS BIGINT) > 0 THEN try_cast({c} AS BIGINT) div {NANOS} END")
    return records.select(
        "id",
        "attributes",
        bare.alias("event_name"),
        string("session.id").alias("session_id"),
        string("prompt.id").alias("prompt_id"),
        string("message.uuid").alias("message_uuid"),
        string("app.version").alias("app_version"),
        F.get(strings("workspace.host_paths"), F.lit(0)).alias("workspace_path"),
        F.coalesce(nanos("timeUnixNano"), nanos("observedTimeUnixNano"), N.timestamp_ms(string("event.timestamp"))).alias("ts"),
        integer("event.sequence").alias("sequence"),
    )


def event_class() -> Column:
    """The event's class over a common() frame; records that miss their key are ``other``."""
    name = F.col("event_name")
    request = F.coalesce(string("request_id"), string("client_request_id"), F.col("message_uuid"))
    prompt = F.coalesce("prompt_id", "message_uuid")
    return (
        F.when((name == "tool_result") & string("tool_use_id").isNotNull(), "tool_result")
        .when((name == "tool_decision") & string("tool_use_id").isNotNull(), "tool_decision")
        .when(name.isin("api_request", "api_error") & request.isNotNull(), "api_request")
        .when((name == "user_prompt") & prompt.isNotNull(), "prompt")
        .when(name == "permission_mode_changed", "mode_change")
        .when(name.isin("session.count", "session_start"), "session_seen")
        .otherwise("other")
    )


def call_facts(events: DataFrame) -> DataFrame:
    """Facts of results and decisions: who decided, how it ended, what was asked for."""
    params, raw, given = F.col("params"), F.col("raw"), F.col("given")
    source = string("tool_source")
    server = F.coalesce(N.string_at(params, "$.mcp_server_name"), string("mcp_server_scope"))
    kind = F.coalesce(
        F.when(source.isin("mcp", "sdk_host_builtin_mcp"), "mcp").when(source == "builtin", "builtin"), F.when(server.isNotNull(), "mcp")
    )
    tool = F.coalesce(string("tool_name"), F.lit(""))
    from_params = F.coalesce(*[N.string_at(params, f"$.{k}") for k in PARAMETER_KEYS], N.generic_summary(params))
    is_result = F.col("class") == "tool_result"
    decision = F.when(is_result, "accept").otherwise(string("decision"))
    rows = events.filter(F.col("class").isin("tool_result", "tool_decision"))
    # Columns of their own, so that each text is parsed once for all that is read from it.
    rows = rows.withColumn("params", json_value("tool_parameters")).withColumn("raw", string("tool_input")).withColumn("given", F.try_parse_json("raw"))
    return rows.select(
        "id", "session_id", "prompt_id", "message_uuid",
        string("tool_use_id").alias("tool_use_id"),
        F.lit(2).alias("bit"),
        string("tool_name").alias("tool_name"),
        kind.alias("tool_kind"),
        server.alias("mcp_server"),
        N.string_at(params, "$.mcp_tool_name").alias("mcp_tool"),
        F.col("ts").alias("called_at"),
        F.when(is_result, integer("duration_ms")).alias("duration_ms"),
        F.when(is_result, string("error_type")).alias("error_type"),
        decision.alias("decision"),
        F.when(is_result, string("decision_source")).otherwise(F.coalesce(string("source"), string("decision_source"))).alias("decision_source"),
        F.when(is_result, boolean("success")).when(decision == "reject", False).alias("success"),
        F.coalesce(raw, F.to_json(params)).alias("input_json"),
        F.when(raw.isNotNull(), N.input_summary(tool, given)).otherwise(from_params).alias("input_summary"),
        F.when(raw.isNotNull(), N.target_path(tool, given)).otherwise(N.generic_target(params)).alias("target_path"),
    )


def request_facts(events: DataFrame) -> DataFrame:
    cost = F.coalesce(integer("cost_usd_micros"), F.round(floating("cost_usd") * 1_000_000).cast("long"))
    return events.filter("class = 'api_request'").select(
        "id",
        F.coalesce(string("request_id"), string("client_request_id"), "message_uuid").alias("request_id"),
        "session_id", "prompt_id",
        string("model").alias("model"),
        cost.alias("cost_usd_micros"),
        *[integer(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "duration_ms")],
        *[string(c).alias(c) for c in ("speed", "effort", "query_source")],
        string("agent.name").alias("agent_name"),
        "ts",
    )


def prompt_facts(events: DataFrame) -> DataFrame:
    """Length and command of prompts; their text is never read."""
    return events.filter("class = 'prompt'").select(
        "id", F.coalesce("prompt_id", "message_uuid").alias("prompt_id"), "session_id", "ts",
        integer("prompt_length").alias("prompt_length"), string("command_name").alias("command_name"), string("command_source").alias("command_source"),
    )


def mode_facts(events: DataFrame) -> DataFrame:
    return events.filter("class = 'mode_change'").select(
        "id", "session_id", string("from_mode").alias("from_mode"), string("to_mode").alias("to_mode"), string("trigger").alias("trigger"), "ts"
    )


def session_facts(events: DataFrame) -> DataFrame:
    return events.filter("session_id IS NOT NULL").select(
        "id", "session_id", F.col("workspace_path").alias("project_path"), F.col("app_version").alias("cc_version"), F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen")
    )


def counters(events: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(F.col("class") == c).alias(f"{c}s")
    rejected = F.count_if((F.col("class") == "tool_decision") & (string("decision") == "reject")).alias("rejections")
    return events.agg(F.count("*").alias("records"), *map(n, ("tool_result", "tool_decision", "api_request", "prompt", "other")), rejected)
