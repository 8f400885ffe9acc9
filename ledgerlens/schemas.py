"""Schemas, in DDL, of evidence, of the tables derived from it, of the ledgers and of the two input lanes."""

from __future__ import annotations

TRANSCRIPT, OTLP = 1, 2  # bits of provenance


RAW_EVENT = (
    "id long, lane string, source_ref string, source_offset long, content_sha256 string, ingested_at long, body string, chain_sha256 string"
)
SESSION = (
    "session_id string, project_path string, transcript_path string, cwd string, git_branch string, cc_version string, "
    "entrypoint string, agent_name string, slug string, first_seen long, last_seen long"
)
TOOL_CALL = (
    "tool_use_id string, session_id string, prompt_id string, message_uuid string, parent_uuid string, is_sidechain boolean, "
    "agent_id string, agent_name string, tool_name string, tool_kind string, mcp_server string, mcp_tool string, called_at long, "
    "completed_at long, input_json string, input_summary string, target_path string, result_json string, result_text string, "
    "result_size long, success boolean, duration_ms long, error_type string, decision string, decision_source string, "
    "permission_mode string, provenance int, row_seq long"
)
FILE_CHANGE = "tool_use_id string, file_path string, lines_added long, lines_removed long, patch_json string"
API_REQUEST = (
    "request_id string, session_id string, prompt_id string, model string, cost_usd_micros long, input_tokens long, "
    "output_tokens long, cache_read_tokens long, cache_creation_tokens long, duration_ms long, speed string, effort string, "
    "query_source string, agent_name string, ts long"
)
PROMPT = "prompt_id string, session_id string, ts long, prompt_length long, command_name string, command_source string"
MODE_CHANGE = "id long, session_id string, from_mode string, to_mode string, trigger string, ts long"
SIGHTING = "rule_id string, fingerprint string, tool_use_id string, first_seen long"
DISMISSAL = "rule_id string, note string, at long, restored boolean"
DELETION = (
    "id long, at long, scope string, sessions long, calls long, events long, bytes long, first_id long, last_id long, chain_before string"
)
VERDICT = (
    "tool_use_id string, model_fp string, prompt_fp string, status string, score int, category string, summary string, "
    "is_destructive boolean, violates_sandbox boolean, ms long, at long"
)

#: One transcript line. Fields whose shape varies are variants.
ENVELOPE = (
    "type string, uuid string, parentUuid string, sessionId string, promptId string, timestamp string, cwd string, "
    "gitBranch string, version string, isSidechain boolean, entrypoint string, slug string, permissionMode string, "
    "agentId string, attributionAgent string, agentName string, relocatedCwd string, "
    "message struct<role: string, content: variant>, toolUseResult variant"
)

_VALUE = (
    "stringValue: string, intValue: string, doubleValue: double, boolValue: boolean, "
    "arrayValue: struct<values: array<struct<stringValue: string>>>"
)
_RECORD = (
    f"attributes: array<struct<key: string, value: struct<{_VALUE}>>>, body: struct<stringValue: string>, eventName: string, "
    "timeUnixNano: string, observedTimeUnixNano: string"
)
#: One telemetry log record, and an export request of them.
LOG_RECORD = f"struct<{_RECORD}>"
EXPORT_REQUEST = (f"resourceLogs array<struct<scopeLogs: array<struct<logRecords: array<struct<{_RECORD}>>>>>>")
