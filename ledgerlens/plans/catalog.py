"""Queries over the given tables, and the same in SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize, redact, search
from ..operators import chain, filters, merge, metrics, retention, rules, verdicts, verify
from ..operators.filters import CallFilter, Lens
from ..sources import evidence, export
from ..staging import materialize
from . import reads
from . import testviews as tv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
RULES = tuple(rules.load_rules())
PAIR = ("m1", "p1")
SINCE = 1_704_067_200_000
#: Four weeks of evidence are kept.
CUTOFF_SQL = "(SELECT max(last_seen) - 2419200000 FROM s)"
FIT_BYTES = 100_000
OVERLAY = """
[[pattern]]
id = "spaced-token"
regex = '(?:token|secret|api_key) = "([0-9a-f]{40})"'
needs = ['token = "', 'secret = "', 'api_key = "']
group = 1
"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            body = sql if sql.lstrip().upper().startswith("WITH") else f"{tv.sql_prefix()}\n{sql.lstrip()}"
            ORACLE_SQL[name] = body
        return f

    return add


def _more(ctes: str, body: str) -> str:
    """The prefix with more common tables."""
    return f"{tv.sql_prefix()},\n{ctes}\n{body}"


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    return merge.mode_changes(tv.mode_records(spark, sf))


#: What rules and reads over the frame look at.
_NARROW = ("tool_use_id", "row_seq", "session_id", "user_id", "called_at", "tool_name", "tool_kind", "input_summary", "target_path", "success", "decision", "decision_source", "permission_mode", "agent_id", "provenance")


def _frame(spark: SparkSession, sf: str) -> DataFrame:
    """The enriched calls. Sessions, first calls and refusals all come from the calls, which are written once."""
    calls = materialize(tv.calls(spark, sf).select(*_NARROW), "frame-calls")
    return rules.enriched(calls, tv.sessions_of(calls), _changes(spark, sf))


def _matched(spark: SparkSession, sf: str) -> DataFrame:
    return rules.matched_rules(_frame(spark, sf), list(RULES))


# --- the rules in SQL

_MC = """mc AS (SELECT * FROM (SELECT *, lag(mode) OVER (PARTITION BY session_id ORDER BY id) AS from_mode FROM mr) x WHERE mode IS DISTINCT FROM from_mode)"""
_FR = """fr AS (SELECT tc.*, s.cwd AS session_cwd, s.project_path,
  EXISTS (SELECT 1 FROM mc WHERE mc.session_id = tc.session_id AND mc.from_mode IS NOT NULL) AS mode_changed,
  coalesce(tc.session_id IS NOT NULL AND row_number() OVER (PARTITION BY tc.session_id ORDER BY tc.called_at ASC NULLS FIRST, tc.row_seq) = 1, false) AS is_first,
  EXISTS (SELECT 1 FROM tc r WHERE r.decision = 'reject' AND r.session_id = tc.session_id AND r.tool_name = tc.tool_name AND r.called_at <= tc.called_at
    AND r.tool_use_id <> tc.tool_use_id AND least(length(r.input_summary), length(tc.input_summary)) >= 8
    AND (starts_with(r.input_summary, tc.input_summary) OR starts_with(tc.input_summary, r.input_summary)))
    AND tc.decision IS DISTINCT FROM 'reject' AND tc.input_summary IS NOT NULL AS is_retry
  FROM tc LEFT JOIN s ON s.session_id = tc.session_id)"""


def _sql_rule(rule: rules.Rule) -> str:
    m, parts = rule.match, []
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    for values, name in ((m.tools, "tool_name"), (m.kinds, "tool_kind"), (m.decisions, "decision"), (m.decision_sources, "decision_source"), (m.permission_modes, "permission_mode")):
        if values:
            parts.append(f"{name} IN ({', '.join(map(quote, values))})")
    if m.success is not None:
        parts.append(f"success = {m.success}")
    if m.main_thread is not None:
        parts.append(f"agent_id IS {'' if m.main_thread else 'NOT '}NULL")
    looked = "split_part(input_summary, chr(10), 1)" if m.first_line else "input_summary"
    if m.summary_contains:
        parts.append("(" + " OR ".join(f"contains(lower({looked}), {quote(x.lower())})" for x in m.summary_contains) + ")")
    if m.summary_glob:
        parts.append("(" + " OR ".join(f"{looked} GLOB {quote(x)}" for x in m.summary_glob) + ")")
    if m.path_glob:
        parts.append("(" + " OR ".join(f"target_path GLOB {quote(x)}" for x in m.path_glob) + ")")
    if m.outside_cwd:
        parts.append("NOT (starts_with(target_path, session_cwd || '/') OR target_path = session_cwd)")
    if m.mode_changed:
        parts.append("mode_changed")
    parts += {"session": ["is_first"], "retry_after_refusal": ["is_retry"]}.get(rule.scope, [])
    return f"coalesce({' AND '.join(parts)}, false)"


_HITS = "hit AS (" + " UNION ALL ".join(f"SELECT tool_use_id, session_id, project_path, called_at, {k} AS pos, '{r.id}' AS rule_id, '{r.severity}' AS severity FROM fr WHERE {_sql_rule(r)}" for k, r in enumerate(RULES)) + ")"
_RULES_SQL = f"{_MC}, {_FR}, {_HITS}"


# --- timeline, filters, paging


@query("timeline_page", _more(f"{_MC}, {_FR}", f"""
SELECT tool_use_id, session_id, project_path, tool_name, input_summary, called_at, provenance FROM fr
WHERE called_at >= {SINCE} AND agent_id IS NULL ORDER BY called_at DESC NULLS LAST, row_seq DESC LIMIT 100"""))
def timeline_page(spark: SparkSession, sf: str) -> DataFrame:
    found = reads.plain_page(tv.calls(spark, sf), tv.sessions(spark, sf), Lens(CallFilter(since=SINCE, main_thread=True)))
    return found.select("tool_use_id", "session_id", "project_path", "tool_name", "input_summary", "called_at", "provenance")


@query("timeline_count", f"SELECT count(*) AS calls FROM tc WHERE called_at >= {SINCE} AND agent_id IS NULL")
def timeline_count(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.count(filters.matching(tv.calls(spark, sf), CallFilter(since=SINCE, main_thread=True)))


@query("filter_session_unknown", "SELECT tool_use_id, decision FROM tc WHERE session_id IS NULL AND decision = 'reject' AND success = false")
def filter_session_unknown(spark: SparkSession, sf: str) -> DataFrame:
    found = filters.matching(tv.calls(spark, sf), CallFilter(session_unknown=True, decision="reject", success=False))
    return found.select("tool_use_id", "decision")


@query("filter_lane_and_outcome", "SELECT tool_use_id, provenance FROM tc WHERE provenance = 3 AND success = true AND is_sidechain = true")
def filter_lane_and_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return filters.matching(tv.calls(spark, sf), CallFilter.outcome("ok", provenance=3, is_sidechain=True)).select("tool_use_id", "provenance")


@query("filter_rejected", "SELECT tool_use_id, tool_name FROM tc WHERE decision = 'reject'")
def filter_rejected(spark: SparkSession, sf: str) -> DataFrame:
    return filters.matching(tv.calls(spark, sf), CallFilter.outcome("refused")).select("tool_use_id", "tool_name")


@query("filter_severity_high", _more(_RULES_SQL, "SELECT DISTINCT tool_use_id, tool_name FROM hit JOIN tc USING (tool_use_id) WHERE severity = 'high'"))
def filter_severity_high(spark: SparkSession, sf: str) -> DataFrame:
    found = filters.matching(_frame(spark, sf), Lens(CallFilter(severity="high"), rules=RULES))
    return found.select("tool_use_id", "tool_name")


@query("filter_rule_id", _more(_RULES_SQL, "SELECT tool_use_id, called_at FROM hit WHERE rule_id = 'secrets-read'"))
def filter_rule_id(spark: SparkSession, sf: str) -> DataFrame:
    return filters.matching(_frame(spark, sf), Lens(CallFilter(rule_id="secrets-read"), rules=RULES)).select("tool_use_id", "called_at")


@query("filter_model_score", "SELECT tool_use_id, tool_name FROM tc WHERE tool_use_id IN (SELECT tool_use_id FROM v WHERE status = 'ok' AND score >= 4)")
def filter_model_score(spark: SparkSession, sf: str) -> DataFrame:
    lens = Lens(CallFilter(score=">=4"), verdicts=tv.verdicts(spark, sf), model_fp=PAIR[0], prompt_fp=PAIR[1])
    return filters.matching(tv.calls(spark, sf), lens).select("tool_use_id", "tool_name")


@query("filter_intent", "SELECT tool_use_id, tool_name FROM tc WHERE tool_use_id IN (SELECT tool_use_id FROM v WHERE contains(' ' || summary || ' ', ' summary ') AND contains(' ' || summary || ' ', ' 1'))")
def filter_intent(spark: SparkSession, sf: str) -> DataFrame:
    lens = Lens(CallFilter(intent="summary 1"), verdicts=tv.verdicts(spark, sf), model_fp=PAIR[0], prompt_fp=PAIR[1])
    return filters.matching(tv.calls(spark, sf), lens).select("tool_use_id", "tool_name")


_TOK = "' ' || array_to_string(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' '"


@query("search_and_prefix", _more(
    "t AS (SELECT tool_use_id, " + ", ".join(f"coalesce({_TOK.format(c)}, ' ') AS {c}" for c in ("tool_name", "input_summary", "target_path")) + " FROM tc)",
    "SELECT tool_use_id FROM t WHERE " + " AND ".join("(" + " OR ".join(f"contains({c}, '{n}')" for c in ("tool_name", "input_summary", "target_path")) + ")" for n in (" rm ", " rf ", " bui"))))
def search_and_prefix(spark: SparkSession, sf: str) -> DataFrame:
    calls = tv.calls(spark, sf)
    return calls.filter(search.condition("rm rf bui", ("tool_name", "input_summary", "target_path"))).select("tool_use_id")


@query("search_documents", f"WITH t AS (SELECT doc_id, lang, {_TOK.format('strip_accents(text)')} AS x FROM documents) SELECT doc_id, lang FROM t WHERE contains(x, ' that ') AND contains(x, ' the an')")
def search_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.filter(search.condition("that the-an", ("text",))).select("doc_id", "lang")


@query("search_index_ids", f"WITH t AS (SELECT doc_id, {_TOK.format('strip_accents(text)')} AS x FROM documents) SELECT doc_id AS id FROM t WHERE contains(x, ' was is ') AND contains(x, ' th')")
def search_index_ids(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    index = search.inverted_index(docs, "doc_id", ("text",))
    return search.search_index(materialize(index.hint("rebalance", "token").sortWithinPartitions("token"), "search-index"), "was-is th")


@query("snippets")
def snippets(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    found = rows.filter(search.condition("the and", ("text",)))
    return found.select("conv_id", "turn", search.snippet(F.col("text"), "the and").alias("snippet"))


# --- aggregates


def _hist_sql(width: int, offset: int, phase: int) -> str:
    ix = lambda c: f"CAST(floor(({c} + {offset * 60000} + {phase})::DOUBLE / {width}) AS BIGINT)"
    return f"""
SELECT b * {width} - {offset * 60000} - {phase} AS bucket_start, {width}::BIGINT AS width, count(tool_use_id) AS calls,
  count(*) FILTER (success = false) AS failures, count(*) FILTER (decision = 'reject') AS refusals
FROM (SELECT unnest(generate_series((SELECT min({ix('called_at')}) FROM tc), (SELECT max({ix('called_at')}) FROM tc))) AS b) g
LEFT JOIN (SELECT *, {ix('called_at')} AS cb FROM tc WHERE called_at IS NOT NULL) x ON x.cb = g.b GROUP BY b"""


@query("histogram_hour", _hist_sql(metrics.HOUR, 120, 0))
def histogram_hour(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.histogram(tv.calls(spark, sf), metrics.HOUR, offset_min=120)


@query("histogram_week", _hist_sql(metrics.WEEK, 0, metrics.WEEK_PHASE))
def histogram_week(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.histogram(tv.calls(spark, sf), metrics.WEEK)


@query("histogram_auto", _hist_sql(metrics.DAY, 0, 0))
def histogram_auto(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.histogram(tv.calls(spark, sf))


@query("facets_tools", "SELECT tool_name, count(*) AS calls FROM tc GROUP BY tool_name")
def facets_tools(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.tool_facet(tv.calls(spark, sf))


@query("facets_modes", "SELECT DISTINCT permission_mode FROM tc WHERE permission_mode IS NOT NULL")
def facets_modes(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.facet(tv.calls(spark, sf), "permission_mode")


@query("tool_usage", """
SELECT c.tool_name, c.calls, c.failures, p.p50_ms, p.p95_ms FROM (SELECT tool_name, count(*) AS calls, count(*) FILTER (success = false) AS failures FROM tc GROUP BY 1) c
LEFT JOIN (SELECT tool_name, max(duration_ms) FILTER (rn <= (n * 50 + 99) // 100) AS p50_ms, max(duration_ms) FILTER (rn <= (n * 95 + 99) // 100) AS p95_ms
  FROM (SELECT tool_name, duration_ms, row_number() OVER (PARTITION BY tool_name ORDER BY duration_ms) AS rn, count(*) OVER (PARTITION BY tool_name) AS n FROM tc WHERE duration_ms IS NOT NULL) GROUP BY 1) p
USING (tool_name)""")
def tool_usage(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.tool_usage(tv.calls(spark, sf))


@query("span", "SELECT min(called_at) AS first_at, max(called_at) AS last_at FROM tc")
def span(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.span(tv.calls(spark, sf))


@query("lane_reconcile", """
SELECT *, \"both\"::DOUBLE / (\"both\" + transcript_only + otlp_only) AS both_ratio FROM (SELECT count(*) FILTER (provenance = 3) AS \"both\", count(*) FILTER (provenance = 1) AS transcript_only,
  count(*) FILTER (provenance = 2) AS otlp_only, count(*) FILTER (decision = 'reject') AS rejected FROM tc)""")
def lane_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    return verify.reconcile(tv.calls(spark, sf))


@query("session_completeness", """
SELECT session_id, x.calls, decided, rejected, first_at, last_at, project_path, decided::DOUBLE / calls AS ratio FROM (
  SELECT session_id, count(*) AS calls, count(*) FILTER (provenance & 2 <> 0) AS decided, count(*) FILTER (decision = 'reject') AS rejected, min(called_at) AS first_at, max(called_at) AS last_at
  FROM tc WHERE session_id IS NOT NULL GROUP BY 1) x LEFT JOIN s USING (session_id) ORDER BY ratio, calls DESC, session_id LIMIT 50""")
def session_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return verify.session_completeness(tv.calls(spark, sf), tv.sessions(spark, sf))


@query("completeness", """
SELECT (SELECT count(*) FROM s) AS sessions, (SELECT count(DISTINCT session_id) FROM tc WHERE session_id IS NOT NULL AND provenance & 2 = 0) AS sessions_undecided,
  (SELECT count(called_at) FROM tc) AS timed_calls, (SELECT count(*) FROM v) AS requests""")
def completeness(spark: SparkSession, sf: str) -> DataFrame:
    return verify.completeness(tv.calls(spark, sf), tv.verdicts(spark, sf))


@query("capture_gaps", """
SELECT min(called_at) AS from_at, max(called_at) AS to_at, count(*) AS calls, count(DISTINCT session_id) AS sessions, max(called_at) - min(called_at) AS duration_ms FROM (
  SELECT *, row_number() OVER (ORDER BY called_at, row_seq) - row_number() OVER (PARTITION BY provenance & 2 ORDER BY called_at, row_seq) AS run FROM tc WHERE called_at IS NOT NULL)
WHERE provenance & 2 = 0 GROUP BY run""")
def capture_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return verify.gaps(tv.calls(spark, sf), limit=None)


@query("totals", """
SELECT (SELECT count(*) FROM tc) AS calls, (SELECT min(called_at) FROM tc) AS first_at, (SELECT max(called_at) FROM tc) AS last_at, (SELECT count(*) FROM s) AS sessions,
  (SELECT count(*) FROM orders) AS requests, (SELECT sum(CAST(round(o_totalprice * 100) AS BIGINT)) FROM orders)::BIGINT AS cost_usd_micros, (SELECT sum(o_custkey) FROM orders)::BIGINT AS input_tokens,
  (SELECT sum(o_orderkey) FROM orders)::BIGINT AS output_tokens, (SELECT count(*) FROM conversations) AS prompts, (SELECT count(*) FROM raw) AS events""")
def totals(spark: SparkSession, sf: str) -> DataFrame:
    requests = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cost_usd_micros"), F.col("o_custkey").alias("input_tokens"), F.col("o_orderkey").alias("output_tokens")
    )
    return metrics.totals(tv.calls(spark, sf), tv.sessions(spark, sf), requests, spark.read.parquet(f"{sf}/conversations.parquet"), tv.raw_events(spark, sf))


@query("ingest_summary", "SELECT count(DISTINCT source_ref) FILTER (lane = 'transcript') AS files, count(*) FILTER (lane = 'transcript') AS transcript_events, count(*) FILTER (lane = 'otlp') AS otlp_events, max(ingested_at) AS last_ingest FROM raw")
def ingest_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.ingest_summary(tv.raw_events(spark, sf))


@query("events_since", f"SELECT count(*) AS events FROM raw WHERE ingested_at >= {SINCE}")
def events_since(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.events_since(tv.raw_events(spark, sf), SINCE)


@query("evidence_counters", "SELECT lane, count(*) AS events, max(id) AS last_id, max(source_offset) AS last_offset FROM raw GROUP BY lane")
def evidence_counters(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.counters(tv.raw_events(spark, sf))


@query("sessions_list", "SELECT session_id, project_path, last_seen FROM s ORDER BY last_seen DESC NULLS LAST, session_id LIMIT 100")
def sessions_list(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.sessions_list(tv.sessions(spark, sf), 100).select("session_id", "project_path", "last_seen")


# --- risk


@query("matched_rules", _more(_RULES_SQL, "SELECT tool_use_id, string_agg(rule_id, ',' ORDER BY pos) AS rules FROM hit GROUP BY 1"))
def matched_rules(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(spark, sf).filter(F.size("rule_ids") > 0).select("tool_use_id", F.array_join("rule_ids", ",").alias("rules"))


@query("worst_severity", _more(_RULES_SQL, "SELECT tool_use_id, CASE max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'info' END AS severity FROM hit GROUP BY 1"))
def worst_severity(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(spark, sf).filter("severity IS NOT NULL").select("tool_use_id", "severity")


@query("rule_rollup", _more(_RULES_SQL, """SELECT rule_id, project_path, count(*) AS calls, count(DISTINCT session_id) AS sessions, min(called_at) AS first_at, max(called_at) AS last_at FROM hit GROUP BY 1, 2"""))
def rule_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rules.rule_project_rollup(_matched(spark, sf))


@query("findings", _more(_RULES_SQL, "SELECT r.rule_id, count(hit.rule_id) AS calls, min(called_at) AS first_at, max(called_at) AS last_at, count(hit.rule_id) FILTER (project_path IS NULL) AS unattributed FROM ("
  + " UNION ALL ".join(f"SELECT '{r.id}' AS rule_id" for r in RULES) + ") r LEFT JOIN hit ON hit.rule_id = r.rule_id GROUP BY 1"))
def findings(spark: SparkSession, sf: str) -> DataFrame:
    return rules.evaluate(_matched(spark, sf), list(RULES)).select("rule_id", "calls", "first_at", "last_at", "unattributed")


@query("severity_posture", _more(_RULES_SQL, "SELECT project_path, " + ", ".join(f"count(DISTINCT tool_use_id) FILTER (severity = '{x}') AS {x}" for x in rules.SEVERITIES) + ", string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS project_rules FROM hit GROUP BY 1"))
def severity_posture(spark: SparkSession, sf: str) -> DataFrame:
    return rules.posture(_matched(spark, sf), list(RULES)).withColumn("project_rules", F.array_join("project_rules", ","))


@query("severity_totals", _more(_RULES_SQL, "SELECT " + ", ".join(f"count(DISTINCT tool_use_id) FILTER (severity = '{x}') AS {x}" for x in rules.SEVERITIES) + " FROM hit"))
def severity_totals(spark: SparkSession, sf: str) -> DataFrame:
    return rules.severity_totals(_matched(spark, sf), list(RULES))


@query("retry_after_refusal", _more(f"{_MC}, {_FR}", "SELECT tool_use_id FROM fr WHERE is_retry"))
def retry_after_refusal(spark: SparkSession, sf: str) -> DataFrame:
    return rules.retries(tv.calls(spark, sf))


@query("first_call_of_session", _more(f"{_MC}, {_FR}", "SELECT session_id, tool_use_id FROM fr WHERE is_first"))
def first_call_of_session(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(spark, sf).filter("is_first_in_session").select("session_id", "tool_use_id")


@query("outside_cwd", _more(_RULES_SQL, "SELECT tool_use_id FROM hit WHERE rule_id = 'write-outside-the-working-directory'"))
def outside_cwd(spark: SparkSession, sf: str) -> DataFrame:
    rule = next(r for r in RULES if r.match.outside_cwd)
    return _frame(spark, sf).filter(rules.compile_rule(rule)).select("tool_use_id")


@query("rule_calls_page", _more(_RULES_SQL, "SELECT tool_use_id, h.called_at FROM hit h JOIN tc USING (tool_use_id) WHERE rule_id = 'mcp-tool-usage' ORDER BY h.called_at DESC NULLS LAST, row_seq DESC LIMIT 100"))
def rule_calls_page(spark: SparkSession, sf: str) -> DataFrame:
    rule = next(r for r in RULES if r.id == "mcp-tool-usage")
    return rules.rule_calls(_frame(spark, sf), rule).select("tool_use_id", "called_at")


@query("sightings_insert", _more(_RULES_SQL, "SELECT h.rule_id, f.fp AS fingerprint, tool_use_id, 7::BIGINT AS first_seen FROM hit h JOIN (VALUES " + ", ".join(f"('{r.id}', '{rules.fingerprint(r)}')" for r in RULES) + ") f(rule_id, fp) ON f.rule_id = h.rule_id WHERE tool_use_id NOT IN (SELECT tool_use_id FROM tc WHERE row_seq < 500)"))
def sightings_insert(spark: SparkSession, sf: str) -> DataFrame:
    matched = _matched(spark, sf)
    empty = spark.createDataFrame([], "rule_id string, fingerprint string, tool_use_id string, first_seen long")
    ledger = rules.new_sightings(matched.filter("row_seq < 500"), list(RULES), empty, 1)
    return rules.new_sightings(matched, list(RULES), ledger, 7)


@query("alerts", _more(_RULES_SQL, "SELECT tc.tool_use_id, tc.session_id, tool_name, input_summary, tc.called_at, CASE WHEN decision = 'reject' THEN 'refused' ELSE title END AS alert FROM tc LEFT JOIN (SELECT tool_use_id, min(pos) AS pos FROM hit WHERE severity = 'high' GROUP BY 1) h USING (tool_use_id) LEFT JOIN (VALUES "
  + ", ".join("({}, '{}')".format(k, r.title.replace("'", "''")) for k, r in enumerate(RULES)) + ") n(pos, title) ON n.pos = h.pos WHERE decision = 'reject' OR title IS NOT NULL"))
def alerts(spark: SparkSession, sf: str) -> DataFrame:
    return rules.alerts(_matched(spark, sf), list(RULES))


# --- merges


@query("mode_change_events", _more(_MC, "SELECT id, session_id, from_mode, mode AS to_mode, \"trigger\", ts FROM mc"))
def mode_change_events(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf)


@query("mode_asof", _more(_MC, """SELECT tool_use_id, coalesce(permission_mode,
  (SELECT mc.mode FROM mc WHERE mc.session_id = tc.session_id AND mc.ts <= tc.called_at ORDER BY mc.ts DESC, mc.id DESC LIMIT 1),
  (SELECT mc.mode FROM mc WHERE mc.session_id = tc.session_id ORDER BY mc.id LIMIT 1)) AS permission_mode FROM tc"""))
def mode_asof(spark: SparkSession, sf: str) -> DataFrame:
    return merge.inherit_modes(tv.calls(spark, sf), _changes(spark, sf)).select("tool_use_id", "permission_mode")


@query("mode_at_record", """SELECT id, session_id, last_value(CASE WHEN id % 3 = 0 THEN mode END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS mode_now FROM mr""")
def mode_at_record(spark: SparkSession, sf: str) -> DataFrame:
    rows = tv.mode_records(spark, sf).withColumn("mode", F.when(F.col("id") % 3 == 0, F.col("mode")))
    return merge.mode_at_record(rows).select("id", "session_id", "mode_now")


def _lane_facts(spark: SparkSession, sf: str) -> DataFrame:
    c = tv.calls(spark, sf)
    t = c.filter("provenance <> 2").select((F.col("row_seq") * 2).alias("id"), "tool_use_id", F.lit(1).alias("bit"), "session_id", "tool_name", "called_at", "success", "input_summary", "agent_id", "permission_mode")
    o = c.filter("provenance >= 2").select((F.col("row_seq") * 2 + 1).alias("id"), "tool_use_id", F.lit(2).alias("bit"), "session_id", "tool_name", F.col("called_at") + 5, F.lit(None).cast("boolean").alias("success"), F.lit("telemetry").alias("input_summary"), "decision", "decision_source", "duration_ms")
    return merge.union_facts(t, o.withColumnRenamed("(called_at + 5)", "called_at"))


@query("two_lane_merge", """SELECT tool_use_id, session_id, tool_name, called_at + CASE WHEN provenance >= 2 THEN 5 ELSE 0 END AS called_at, CASE WHEN provenance <> 2 THEN success END AS success,
  CASE WHEN provenance <> 2 THEN coalesce(input_summary, CASE WHEN provenance = 3 THEN 'telemetry' END) ELSE 'telemetry' END AS input_summary, CASE WHEN provenance <> 2 THEN agent_id END AS agent_id,
  CASE WHEN provenance >= 2 THEN decision END AS decision, CASE WHEN provenance >= 2 THEN duration_ms END AS duration_ms, provenance, row_seq * 2 + CASE WHEN provenance = 2 THEN 1 ELSE 0 END AS row_seq FROM tc""")
def two_lane_merge(spark: SparkSession, sf: str) -> DataFrame:
    facts = _lane_facts(spark, sf)
    for c in ("target_path", "input_json"):
        facts = facts.withColumn(c, F.lit(None).cast("string"))
    return merge.merge_lanes(facts).select("tool_use_id", "session_id", "tool_name", "called_at", "success", "input_summary", "agent_id", "decision", "duration_ms", "provenance", "row_seq")


@query("session_merge", """SELECT session_id, arg_max(input_summary, row_seq) FILTER (input_summary IS NOT NULL) AS slug, arg_max(permission_mode, row_seq) FILTER (permission_mode IS NOT NULL) AS git_branch,
  min(called_at) AS first_seen, max(called_at) AS last_seen FROM tc WHERE session_id IS NOT NULL GROUP BY 1""")
def session_merge(spark: SparkSession, sf: str) -> DataFrame:
    c = tv.calls(spark, sf)
    facts = c.select(F.col("row_seq").alias("id"), "session_id", F.col("input_summary").alias("slug"), F.col("permission_mode").alias("git_branch"), F.col("called_at").alias("first_seen"), F.col("called_at").alias("last_seen"), *[F.lit(None).cast("string").alias(x) for x in ("project_path", "transcript_path", "cwd", "cc_version", "entrypoint", "agent_name", "relocated_cwd")])
    return merge.merge_sessions(facts).select("session_id", "slug", "git_branch", "first_seen", "last_seen")


@query("agent_spread", """SELECT tool_use_id, CASE WHEN agent_id IS NULL THEN CASE WHEN row_seq % 3 = 0 THEN tool_name END ELSE coalesce(CASE WHEN row_seq % 3 = 0 THEN tool_name END,
  arg_min(tool_name, row_seq) FILTER (row_seq % 3 = 0) OVER (PARTITION BY agent_id)) END AS agent_name FROM tc""")
def agent_spread(spark: SparkSession, sf: str) -> DataFrame:
    c = tv.calls(spark, sf).withColumn("agent_name", F.when(F.col("row_seq") % 3 == 0, F.col("tool_name")))
    none = spark.createDataFrame([], "agent_id string, agent_type string")
    return merge.name_agents(c, none).select("tool_use_id", "agent_name")


# --- evidence, chain, retention


@query("content_hash", "SELECT doc_id, sha256(text) AS content_sha256 FROM documents")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", chain.content_sha256(F.col("text")).alias("content_sha256"))


@query("evidence_dedup", "SELECT sha256(text) AS content_sha256, arg_min(source, (source, doc_id)) AS source_ref, min((source, doc_id))[2] AS source_offset FROM documents GROUP BY 1")
def evidence_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("source_ref"), F.col("doc_id").alias("source_offset"), F.col("text").alias("body"))
    empty = spark.createDataFrame([], "content_sha256 string")
    found = evidence.new_rows(evidence.prepared(docs, "transcript", 1), empty)
    return found.select("content_sha256", "source_ref", "source_offset")


@query("chain_digest", "SELECT id, sha256(concat_ws(chr(10), lane, source_ref, coalesce(CAST(source_offset AS STRING), '-'), CAST(ingested_at AS STRING), content_sha256)) AS digest FROM raw")
def chain_digest(spark: SparkSession, sf: str) -> DataFrame:
    return tv.raw_events(spark, sf).select("id", chain.row_digest().alias("digest"))


def _sealed(spark: SparkSession, sf: str) -> DataFrame:
    return chain.seal(tv.raw_events(spark, sf).withColumn("chain_sha256", F.lit(None).cast("string")))


@query("chain_seal", f"""WITH RECURSIVE {tv.sql_prefix().strip()[4:]},
d AS (SELECT id, lane, source_ref, sha256(concat_ws(chr(10), lane, source_ref, coalesce(CAST(source_offset AS STRING), '-'), CAST(ingested_at AS STRING), content_sha256)) AS digest,
  row_number() OVER (PARTITION BY lane, source_ref ORDER BY id) AS n FROM raw WHERE lane = 'transcript'),
c AS (SELECT id, lane, source_ref, n, sha256('{chain.GENESIS}' || chr(10) || digest) AS chain_sha256 FROM d WHERE n = 1
  UNION ALL SELECT d.id, d.lane, d.source_ref, d.n, sha256(c.chain_sha256 || chr(10) || d.digest) FROM c JOIN d ON d.lane = c.lane AND d.source_ref = c.source_ref AND d.n = c.n + 1)
SELECT id, chain_sha256 FROM c""")
def chain_seal(spark: SparkSession, sf: str) -> DataFrame:
    return _sealed(spark, sf).filter("lane = 'transcript'").select("id", "chain_sha256")


@query("chain_verify", "SELECT id, 'body' AS kind, false AS explained FROM raw WHERE id % 97 = 0")
def chain_verify(spark: SparkSession, sf: str) -> DataFrame:
    edited = _sealed(spark, sf).withColumn("body", F.when(F.col("id") % 97 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    none = spark.createDataFrame([], "chain_before string")
    return chain.verify(edited, none)


_RAW_BYTES = "SELECT source_ref, count(*) AS events, sum(strlen(body))::BIGINT AS bytes FROM raw WHERE lane = 'transcript' GROUP BY 1"


def _cutoff(spark: SparkSession, sf: str) -> int:
    return tv.sessions(spark, sf).agg(F.max("last_seen")).first()[0] - 2_419_200_000


@query("retention_before", f"""SELECT s.session_id, s.project_path, s.last_seen, coalesce(c.calls, 0) AS calls, coalesce(b.events, 0) AS events, coalesce(b.bytes, 0) AS bytes FROM s
LEFT JOIN (SELECT session_id, count(*) AS calls FROM tc GROUP BY 1) c USING (session_id) LEFT JOIN ({_RAW_BYTES}) b ON b.source_ref = s.transcript_path WHERE coalesce(s.last_seen, s.first_seen, 0) < {CUTOFF_SQL} + 2419200000""")
def retention_before(spark: SparkSession, sf: str) -> DataFrame:
    return retention.preview(tv.sessions(spark, sf), tv.calls(spark, sf), tv.raw_events(spark, sf), retention.Scope(before=_cutoff(spark, sf) + 2_419_200_000))


@query("retention_fit", f"""SELECT min(age) + 1 AS cutoff FROM (SELECT age, sum(bytes) OVER (ORDER BY age) AS gone, sum(bytes) OVER () AS whole FROM
  (SELECT coalesce(last_seen, first_seen, 0) AS age, sum(coalesce(bytes, 0)) AS bytes FROM s LEFT JOIN ({_RAW_BYTES}) b ON b.source_ref = s.transcript_path GROUP BY 1)) WHERE whole - gone <= {FIT_BYTES} AND whole > {FIT_BYTES}""")
def retention_fit(spark: SparkSession, sf: str) -> DataFrame:
    return retention.fit_cutoff(tv.sessions(spark, sf), tv.raw_events(spark, sf), FIT_BYTES)


@query("retention_purge", "SELECT tool_use_id FROM tc WHERE session_id IS NULL OR session_id NOT IN (SELECT session_id FROM s WHERE project_path = '/work/p3')")
def retention_purge(spark: SparkSession, sf: str) -> DataFrame:
    tables = {"session": tv.sessions(spark, sf), "tool_call": tv.calls(spark, sf), "raw_event": tv.raw_events(spark, sf).withColumn("chain_sha256", F.lit(None).cast("string"))}
    return retention.purge(tables, retention.Scope(project_path="/work/p3"), 1)["tool_call"].select("tool_use_id")


# --- verdicts

_SEEN_SQL = "SELECT tool_use_id FROM hit"


def _sightings(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(spark, sf).filter(F.size("rule_ids") > 0).select("tool_use_id")


@query("pending_verdicts", _more(_RULES_SQL, f"SELECT tool_use_id, called_at FROM tc WHERE tool_name = 'Bash' AND input_summary <> '' AND tool_use_id NOT IN ({_SEEN_SQL}) AND tool_use_id NOT IN (SELECT tool_use_id FROM v)"))
def pending_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.pending(tv.calls(spark, sf), _sightings(spark, sf), tv.verdicts(spark, sf), *PAIR).select("tool_use_id", "called_at")


@query("verdict_progress", _more(_RULES_SQL, f"""SELECT eligible, examined, failed, mean_ms, greatest(eligible - examined, 0) AS queued FROM
  (SELECT count(*) AS eligible FROM tc WHERE tool_name = 'Bash' AND input_summary <> '' AND tool_use_id NOT IN ({_SEEN_SQL})),
  (SELECT count(*) AS examined, count(*) FILTER (status = 'failed') AS failed, CAST(round(avg(ms)) AS BIGINT) AS mean_ms FROM v)"""))
def verdict_progress(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.progress(tv.calls(spark, sf), _sightings(spark, sf), tv.verdicts(spark, sf), *PAIR)


@query("score_tallies", "SELECT score, count(*) AS calls FROM v WHERE status = 'ok' GROUP BY 1")
def score_tallies(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.tallies(tv.verdicts(spark, sf), *PAIR)


@query("top_scored", "SELECT v.tool_use_id, score, category, project_path, called_at FROM v LEFT JOIN tc USING (tool_use_id) LEFT JOIN s ON s.session_id = tc.session_id WHERE status = 'ok' AND score >= 4 ORDER BY score DESC, called_at DESC NULLS LAST, v.tool_use_id LIMIT 20")
def top_scored(spark: SparkSession, sf: str) -> DataFrame:
    found = verdicts.top_scored(tv.verdicts(spark, sf), tv.calls(spark, sf), tv.sessions(spark, sf), *PAIR)
    return found.select("tool_use_id", "score", "category", "project_path", "called_at")


@query("second_opinion", _more(_RULES_SQL, f"""SELECT tool_use_id, CASE WHEN status = 'ok' THEN 'verdict' WHEN status = 'failed' THEN 'failed'
  WHEN tool_name = 'Bash' AND input_summary <> '' AND tool_use_id NOT IN ({_SEEN_SQL}) THEN 'pending' ELSE 'not eligible' END AS opinion FROM tc LEFT JOIN v USING (tool_use_id)"""))
def second_opinion(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.second_opinion(tv.calls(spark, sf), _sightings(spark, sf), tv.verdicts(spark, sf), *PAIR).select("tool_use_id", "opinion")


#: Answers of many shapes made from the labels: right ones, wrong types, missing fields, no object.
_ANSWER = """CASE doc_id % 13 WHEN 0 THEN 'no object' WHEN 1 THEN '{ends nowhere' WHEN 2 THEN '{not json}'
  ELSE 'so: {"intent_summary":' || CASE doc_id % 13 WHEN 3 THEN '7' WHEN 4 THEN '"  "' ELSE '"  summary ' || CAST(doc_id % 50 AS STRING) || ' "' END
  || CASE doc_id % 13 WHEN 5 THEN '' WHEN 6 THEN ',"category":"read-only"' ELSE ',"category":"' || CASE WHEN toxic = 1 THEN 'filesystem' ELSE 'read' END || '"' END
  || CASE doc_id % 13 WHEN 7 THEN ',"risk_score":"4"' WHEN 8 THEN ',"risk_score":9' ELSE ',"risk_score":' || CAST(1 + doc_id % 5 AS STRING) END
  || CASE doc_id % 13 WHEN 9 THEN '' ELSE ',"is_destructive":' || CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END END
  || CASE doc_id % 13 WHEN 10 THEN ',"violates_sandbox":"no"' ELSE ',"violates_sandbox":false' END || '} done' END"""


@query("verdict_validate", """WITH a AS (SELECT doc_id, toxic, doc_id % 13 AS c FROM labels),
r AS (SELECT *, CASE WHEN c IN (0, 1) THEN 'the model emitted no JSON object' WHEN c = 2 THEN 'not valid JSON' WHEN c = 3 THEN '`intent_summary` is not a string' WHEN c = 4 THEN 'the intent summary is empty'
  WHEN c = 5 THEN 'missing the field `category`' WHEN c = 6 THEN 'category `read-only` is not one this schema defines' WHEN c = 7 THEN '`risk_score` is not a whole number' WHEN c = 8 THEN 'risk_score is 9, and the scale is 1 to 5'
  WHEN c = 9 THEN 'missing the field `is_destructive`' WHEN c = 10 THEN '`violates_sandbox` is not true or false' END AS error FROM a)
SELECT doc_id, CASE WHEN error IS NULL THEN 'ok' ELSE 'failed' END AS status, error, CASE WHEN error IS NULL THEN CAST(1 + doc_id % 5 AS INT) END AS score, CASE WHEN error IS NULL THEN CASE WHEN toxic = 1 THEN 'filesystem' ELSE 'read' END END AS category,
  CASE WHEN error IS NULL THEN 'summary ' || CAST(doc_id % 50 AS STRING) END AS summary, CASE WHEN error IS NULL THEN toxic = 1 END AS is_destructive, CASE WHEN error IS NULL THEN false END AS violates_sandbox FROM r""")
def verdict_validate(spark: SparkSession, sf: str) -> DataFrame:
    answers = spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id", f"{_ANSWER} AS answer")
    return verdicts.validate(answers).drop("answer")


@query("prompt_render", """WITH c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN 'COMMAND>>> ' || text ELSE '<<<COMMAND ' || text END AS t FROM documents),
r AS (SELECT doc_id, replace(replace(t, 'COMMAND>>>', 'COMMAND>_>'), '<<<COMMAND', '<_<COMMAND') AS t FROM c)
SELECT doc_id, sha256('Judge:' || chr(10) || '<<<COMMAND' || chr(10) || CASE WHEN length(t) > 2000 THEN left(t, 2000) || chr(10) || '… (truncated)' ELSE t END || chr(10) || 'COMMAND>>>') AS prompt_sha256 FROM r""")
def prompt_render(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("COMMAND>>> "), "text")).otherwise(F.concat(F.lit("<<<COMMAND "), "text"))
    prompt = verdicts.render(text, f"Judge:\n{verdicts.OPEN}\n", f"\n{verdicts.CLOSE}")
    return docs.select("doc_id", F.sha2(prompt.cast("binary"), 256).alias("prompt_sha256"))


# --- redaction, normalization, exports


@query("redact_text", """WITH r AS (SELECT doc_id, regexp_replace(text, '((?:token|secret|api_key) = \")[0-9a-f]{40}\"', '\\1[redacted: spaced-token]\"', 'g') AS redacted FROM documents)
SELECT doc_id, sha256(redacted) AS redacted_sha256 FROM r""")
def redact_text(spark: SparkSession, sf: str) -> DataFrame:
    patterns, _ = redact.load_patterns(OVERLAY)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", F.sha2(redact.redacted(F.col("text"), patterns).cast("binary"), 256).alias("redacted_sha256"))


@query("redaction_report")
def redaction_report(spark: SparkSession, sf: str) -> DataFrame:
    patterns, _ = redact.load_patterns(OVERLAY)
    return redact.redaction_report(spark.read.parquet(f"{sf}/documents.parquet"), ("text",), patterns)


@query("tool_identity", "SELECT tool_use_id, CASE WHEN starts_with(tool_name, 'mcp__') THEN 'mcp' ELSE 'builtin' END AS kind, CASE WHEN starts_with(tool_name, 'mcp__') THEN 'svc' END AS server, CASE WHEN starts_with(tool_name, 'mcp__') THEN 'op' END AS tool FROM tc")
def tool_identity(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("tool_name")
    return tv.calls(spark, sf).select("tool_use_id", normalize.tool_kind(n).alias("kind"), normalize.mcp_server(n).alias("server"), normalize.mcp_tool(n).alias("tool"))


@query("summaries", "WITH t AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS x FROM documents) SELECT doc_id, CASE WHEN length(x) > 500 THEN left(x, 500) || '…' ELSE x END AS summary FROM t")
def summaries(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", normalize.truncated(F.col("text")).alias("summary"))


@query("patch_lines", """SELECT 'd' || CAST(doc_id AS STRING) AS tool_use_id, pos - 1 AS pos, CASE (pos - 1) % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' ELSE 'same' END AS kind,
  CASE WHEN (pos - 1) % 3 <> 0 THEN 10 + (pos - 1) - ((pos - 1) + 2) // 3 END AS old_line, CASE WHEN (pos - 1) % 3 <> 1 THEN 20 + (pos - 1) - ((pos - 1) + 1) // 3 END AS new_line
  FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)""")
def patch_lines(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sign = lambda i: F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit(" ")), i % 3 + 1)
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(sign(i), x))
    hunk = F.struct(F.lit(10).alias("oldStart"), F.lit(1).alias("oldLines"), F.lit(20).alias("newStart"), F.lit(1).alias("newLines"), lines.alias("lines"))
    changes = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("tool_use_id"), F.lit("f").alias("file_path"), F.to_json(F.array(hunk)).alias("patch_json"))
    return normalize.patch_lines(changes).select("tool_use_id", F.col("pos").cast("long").alias("pos"), "kind", "old_line", "new_line")


@query("export_csv", """SELECT concat_ws(',', coalesce(CAST(called_at AS STRING), ''), '"' || coalesce(session_id, '') || '"', '"' || tool_name || '"', coalesce(CAST(success AS STRING), ''), coalesce(CAST(duration_ms AS STRING), ''),
  '"' || coalesce(decision, '') || '"', '"' || coalesce(decision_source, '') || '"', '"' || CASE provenance WHEN 3 THEN 'both' WHEN 1 THEN 'transcript' WHEN 2 THEN 'otel' ELSE 'none' END || '"',
  '"' || coalesce(target_path, '') || '"', '"' || replace(coalesce(input_summary, ''), '"', '""') || '"') AS value FROM tc""")
def export_csv(spark: SparkSession, sf: str) -> DataFrame:
    return export.csv_lines(tv.calls(spark, sf))


@query("export_markdown", r"""SELECT '| ' || concat_ws(' | ', coalesce(strftime(make_timestamp(called_at * 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN called_at % 1000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(called_at % 1000 AS STRING), 3, '0'), '0') END || 'Z', ''), tool_name,
  CASE WHEN decision = 'reject' THEN 'refused' WHEN success THEN 'ok' WHEN NOT success THEN 'failed' ELSE '' END, coalesce(CAST(duration_ms AS STRING) || ' ms', ''), coalesce(decision_source, ''),
  CASE provenance WHEN 3 THEN 'both' WHEN 1 THEN 'transcript' ELSE 'otel' END, coalesce(replace(replace(replace(coalesce(input_summary, target_path), '\', '\\'), '|', '\|'), chr(10), ' '), '')) || ' |' AS value FROM tc""")
def export_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return export.markdown_lines(tv.calls(spark, sf))


@query("export_json", "SELECT '{' || concat_ws(',', " + ", ".join(f"'\"{c}\":' || to_json({c})" for c in tv.CALL_COLUMNS) + ") || '}' AS value FROM tc")
def export_json(spark: SparkSession, sf: str) -> DataFrame:
    return export.json_lines(tv.calls(spark, sf))
