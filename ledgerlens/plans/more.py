"""Queries over reads and helpers that no other query shows, and the same in SQL for comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize, redact
from ..operators import filters, merge, metrics, rules, verdicts
from ..schemas import SIGHTING
from ..staging import materialize
from . import catalog, reads
from . import testviews as tv
from .catalog import query

#: Tools with the JSON keys of their inputs: the first key holds the document's mark.
_TOOLS = (
    ("Write", ("file_path",)), ("NotebookEdit", ("notebook_path",)), ("WebSearch", ("query",)), ("Glob", ("pattern", "path")), ("Grep", ("pattern",)),
    ("Agent", ("description", "subagent_type")), ("Task", ("prompt",)), ("Skill", ("skill",)), ("Unheard", ("zzz",)),
)


@query("tool_inputs", """WITH d AS (SELECT doc_id, doc_id % 9 AS t, 'mark ' || doc_id AS mark FROM documents)
SELECT doc_id, CASE WHEN t IN (5, 6) THEN 'agent' WHEN t = 7 THEN 'skill' ELSE 'builtin' END AS kind, CASE WHEN t = 8 THEN '{"zzz":"' || mark || '"}' ELSE mark END AS summary,
  CASE WHEN t IN (0, 1, 7) THEN mark WHEN t IN (3, 5) THEN 'second' END AS target FROM d""")
def tool_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Kind, summary and target of inputs of the tools that the events don't have, and of an unknown one."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.concat(F.lit("mark "), F.col("doc_id").cast("string")).alias("mark"))
    of = lambda keys: F.to_json(F.struct(*[(F.col("mark") if k == 0 else F.lit("second")).alias(n) for k, n in enumerate(keys)]))
    number = F.col("doc_id") % len(_TOOLS)
    pick = lambda values: reduce(lambda out, kv: F.when(number == kv[0], kv[1]).otherwise(out), enumerate(values), F.lit(None).cast("string"))
    made = docs.select("doc_id", pick([F.lit(n) for n, _ in _TOOLS]).alias("tool"), F.try_parse_json(pick([of(k) for _, k in _TOOLS])).alias("v"))
    tool, v = F.col("tool"), F.col("v")
    return made.select("doc_id", normalize.tool_kind(tool).alias("kind"), normalize.input_summary(tool, v).alias("summary"), normalize.target_path(tool, v).alias("target"))


@query("facets_all", catalog._more(catalog._MC, """SELECT DISTINCT 'project_path' AS facet, project_path AS value FROM tc JOIN s USING (session_id) WHERE project_path IS NOT NULL UNION ALL
SELECT DISTINCT 'decision_source', decision_source FROM tc WHERE decision_source IS NOT NULL UNION ALL SELECT DISTINCT 'permission_mode', permission_mode FROM tc WHERE permission_mode IS NOT NULL UNION ALL
SELECT DISTINCT 'agent_name', agent_id FROM tc WHERE agent_id IS NOT NULL UNION ALL SELECT DISTINCT 'tool_name', tool_name FROM tc"""))
def facets_all(spark: SparkSession, sf: str) -> DataFrame:
    frame = catalog._frame(spark, sf).withColumn("agent_name", F.col("agent_id"))
    found = metrics.facets(frame)
    return reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("facet"), F.col(n).alias("value")) for n, df in found.items()])


_REPLACED = catalog.RULES[0]
_USER_RULES = f"""
[[rule]]
id = "{_REPLACED.id}"
title = "replaced"
explanation = "x"
severity = "low"
scope = "{_REPLACED.scope}"
match = {{ tools = ["Bash"], summary_contains = ["docker"] }}
[[rule]]
id = "own-rule"
title = "own"
explanation = "x"
severity = "high"
scope = "{_REPLACED.scope}"
match = {{ tools = ["Read"], success = false }}
"""


@query("user_rules", f"""SELECT '{_REPLACED.id}' AS rule_id, count(*) AS calls, {len(catalog.RULES) + 1} AS rules FROM tc WHERE tool_name = 'Bash' AND contains(input_summary, 'docker')
UNION ALL SELECT 'own-rule', count(*), {len(catalog.RULES) + 1} FROM tc WHERE tool_name = 'Read' AND success = false""")
def user_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A user's rules: one takes a built-in rule's place, one is new."""
    every = rules.load_rules(_USER_RULES)
    matched = rules.matched_rules(catalog._frame(spark, sf), [r for r in every if r.id in (_REPLACED.id, "own-rule")])
    return matched.select(F.explode("rule_ids").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("calls")).withColumn("rules", F.lit(len(every)))


@query("page_after_row", catalog._more("n AS (SELECT tool_use_id, row_number() OVER (ORDER BY called_at DESC NULLS LAST, row_seq DESC) AS n FROM tc)", "SELECT tool_use_id FROM n WHERE n BETWEEN 151 AND 250"))
def page_after_row(spark: SparkSession, sf: str) -> DataFrame:
    """A hundred calls after the 150th newest."""
    calls = materialize(tv.calls(spark, sf).select("tool_use_id", "called_at", "row_seq"), "calls")
    last = filters.page(calls, 1, 149).first()
    return filters.page_after(calls, last["called_at"], last["row_seq"]).select("tool_use_id") if last else calls.select("tool_use_id").limit(0)


@query("calls_by_ids", "SELECT tool_use_id, called_at FROM tc WHERE tool_use_id IN (SELECT tool_use_id FROM v WHERE status = 'failed')")
def calls_by_ids(spark: SparkSession, sf: str) -> DataFrame:
    return filters.by_ids(tv.calls(spark, sf), tv.verdicts(spark, sf).filter("status = 'failed'")).select("tool_use_id", "called_at")


@query("risk_review_totals", catalog.ORACLE_SQL["severity_totals"])
def risk_review_totals(spark: SparkSession, sf: str) -> DataFrame:
    """The review's totals, of one pass of all rules that its four parts share."""
    none = spark.createDataFrame([], "rule_id string, note string, at long, restored boolean")
    return reads.risk_review(catalog._frame(spark, sf), list(catalog.RULES), spark.createDataFrame([], SIGHTING), none)["totals"]


@query("reviewed", "SELECT count(*) > 0 AS ever FROM labels")
def reviewed(spark: SparkSession, sf: str) -> DataFrame:
    ledger = spark.read.parquet(f"{sf}/labels.parquet")
    return spark.createDataFrame([(rules.ever_reviewed(ledger),)], "ever boolean")


@query("redacted_json_bodies", catalog.ORACLE_SQL["redact_text"])
def redacted_json_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """The documents' texts inside JSON bodies: what a body says after redaction is the redacted text."""
    patterns, _ = redact.load_patterns(catalog.OVERLAY)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    body = redact.redacted_json(F.to_json(F.struct(F.struct("text").alias("a"), F.array("text").alias("b"))), patterns)
    return docs.select("doc_id", F.sha2(F.get_json_object(body, "$.a.text").cast("binary"), 256).alias("redacted_sha256"))


_AROUND = redact.AROUND
catalog.ORACLE_SQL["redaction_report"] = f"""WITH m AS (SELECT text, regexp_extract(text, '(?:token|secret|api_key) = "[0-9a-f]{{40}}"', 0) AS m FROM documents),
p AS (SELECT text, strpos(text, m) - 1 + length(m) - 41 AS s FROM m WHERE m <> ''),
x AS (SELECT substr(text, greatest(0, s - {_AROUND}) + 1, s + 40 + {_AROUND} - greatest(0, s - {_AROUND})) AS c FROM p)
SELECT 'text' AS field, 'spaced-token' AS pattern, (SELECT count(*) FROM x) AS rows, (SELECT list(c ORDER BY c) FROM (SELECT DISTINCT c FROM x ORDER BY c LIMIT 4)) AS examples WHERE (SELECT count(*) FROM x) > 0"""


@query("spawned_agents", """SELECT agent_id, arg_max(agent_type, id) AS agent_type FROM (SELECT row_seq AS id, 'agent_' || CAST(user_id % 5 AS STRING) AS agent_id, 'kind ' || tool_name AS agent_type FROM tc WHERE tool_name IN ('WebFetch', 'Edit')
  UNION ALL SELECT row_seq, agent_id, 'named ' || CAST(user_id AS STRING) FROM tc WHERE agent_id IS NOT NULL AND success = false) GROUP BY 1""")
def spawned_agents(spark: SparkSession, sf: str) -> DataFrame:
    """Types of agents: what the calls that made them asked for, and what records state; the last word holds."""
    calls = tv.calls(spark, sf)
    some = calls.filter("tool_name IN ('WebFetch', 'Edit')")
    spawned = some.select(F.col("row_seq").alias("id"), "tool_use_id", F.concat(F.lit("kind "), "tool_name").alias("subagent_type"))
    results = some.select("tool_use_id", F.expr("'agent_' || CAST(user_id % 5 AS STRING)").alias("agent_id"))
    named = calls.filter("success = false").select(F.col("row_seq").alias("id"), "agent_id", F.concat(F.lit("named "), F.col("user_id").cast("string")).alias("agent_type"))
    return merge.agent_types(spawned, results, named)


def _length(prompts: list[str]) -> list[str]:
    return [str(len(p)) for p in prompts]


@query("scored_prompts", "SELECT tool_use_id, CAST(length(input_summary) + 2 AS STRING) AS answer FROM tc WHERE tool_name = 'Bash'")
def scored_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """A scorer's answers, here each prompt's length."""
    calls = tv.calls(spark, sf).filter("tool_name = 'Bash'")
    return verdicts.score(calls.select("tool_use_id", F.concat(F.lit("<"), "input_summary", F.lit(">")).alias("prompt")), _length).select("tool_use_id", "answer")


@query("search_calls", catalog._more("zz AS (SELECT 1)", f"SELECT tool_use_id FROM tc WHERE contains({catalog._TOK.format('input_summary')}, ' hard ') AND contains({catalog._TOK.format('input_summary')}, ' hea') ORDER BY called_at DESC NULLS LAST, row_seq DESC LIMIT 100"))
def search_calls(spark: SparkSession, sf: str) -> DataFrame:
    frame = tv.calls(spark, sf).select(*catalog._NARROW).withColumn("result_text", F.lit(None).cast("string"))
    return reads.search_calls(frame, "hard hea").select("tool_use_id")
