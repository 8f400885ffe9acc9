"""Queries over what is kept in step with its source: the saved index, rules and sightings, purged snapshots, chain
segments; and the same in SQL for comparison."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import search, search_store
from ..operators import metrics, retention, rule_ledger, rules, segments
from ..operators.filters import CallFilter, Lens
from ..sources import evidence, export, ingest, snapshots
from ..staging import materialize, shared_dir
from . import catalog, lanes, ledgers, reads, reproject
from . import testviews as tv
from .catalog import query

_OLD = "was is then "


@query("search_saved_ids", f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR doc_id % 3 = 0 THEN text ELSE '{_OLD}' || text END AS text FROM documents WHERE doc_id % 7 <> 0),
t AS (SELECT doc_id, {catalog._TOK.format('strip_accents(text)')} AS x FROM d) SELECT doc_id AS id FROM t WHERE contains(x, ' was is ') AND contains(x, ' th')""")
def search_saved_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The documents' index after changes: every third text was another one, every fifth document is new, every seventh goes."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    name, n = f"documents_{uuid.uuid4().hex}", F.col("doc_id")
    store = lambda df: (df, name, "doc_id", ("text",))
    search_store.create(*store(docs.filter(n % 5 != 0).withColumn("text", F.concat(F.lit(_OLD), "text"))))
    changed = docs.filter(((n % 5 == 0) | (n % 3 == 0)) & (n % 7 != 0))
    search_store.change(name, changed, "doc_id", ("text",), 1, docs.filter(n % 7 == 0))
    return search_store.find(spark, name, "was-is th")


# --- chain segments

_DIGEST = "sha256(concat_ws(chr(10), lane, source_ref, coalesce(CAST(source_offset AS STRING), '-'), CAST(ingested_at AS STRING), content_sha256))"
_SEGMENTS = f"""seg AS (SELECT id // {segments.SEGMENT} AS number, list({_DIGEST} ORDER BY id) AS ds FROM raw GROUP BY 1),
h AS (SELECT number, list_reduce(list_prepend('{segments.START}', ds), lambda a, x: sha256(a || chr(10) || x)) AS head, len(ds)::BIGINT AS rows FROM seg)"""


@query("segment_heads", catalog._more(_SEGMENTS, "SELECT number, head, rows FROM h"))
def segment_heads(spark: SparkSession, sf: str) -> DataFrame:
    return segments.heads(tv.raw_events(spark, sf))


@query("segment_root", f"""WITH RECURSIVE {tv.sql_prefix().strip()[4:]},
{_SEGMENTS},
lv AS (SELECT 0 AS level, number, head AS digest FROM h
  UNION ALL SELECT any_value(level) + 1, number // {segments.FAN}, sha256(string_agg(CAST(number AS STRING) || ':' || digest, chr(10) ORDER BY number)) FROM lv GROUP BY number // {segments.FAN} HAVING (SELECT max(number) FROM lv) > 0)
SELECT arg_max(digest, level) AS root, max(level) + 1 AS levels, true AS matches FROM lv""")
def segment_root(spark: SparkSession, sf: str) -> DataFrame:
    """The root over all evidence, and whether one kept before is still right."""
    nodes = segments.tree(tv.raw_events(spark, sf))
    kept = segments.root(nodes).first()
    return segments.root(nodes).crossJoin(segments.head_matches(nodes, kept["root"] if kept else ""))


# --- rules


@query("rules_in_steps", catalog._more(catalog._RULES_SQL, "SELECT rule_id, tool_use_id FROM hit"))
def rules_in_steps(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger after two runs: over the first half of the evidence, then over what has come since."""
    calls = materialize(tv.calls(spark, sf).select(*catalog._NARROW), "frame-calls")
    path, top = f"{shared_dir(spark)}/rule-ledger-{uuid.uuid4().hex}", calls.agg(F.max("row_seq")).first()[0] or 0
    rule_ledger.create(spark, path)
    for upto in (top // 2, top):
        rule_ledger.run(calls, tv.sessions_of(calls), catalog._changes(spark, sf), list(catalog.RULES), path, upto)
    return rule_ledger.matches(spark, path).select("rule_id", "tool_use_id")


# --- snapshots


def _snapshot(spark: SparkSession, sf: str) -> str:
    root = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    calls = tv.calls(spark, sf)
    tables = {
        "session": tv.sessions(spark, sf), "tool_call": calls, "file_change": calls.filter("target_path IS NOT NULL").select("tool_use_id", F.col("target_path").alias("path")),
        "permission_mode_change": catalog._changes(spark, sf), "raw_event": tv.raw_events(spark, sf).withColumn("chain_sha256", F.lit(None).cast("string")),
    }
    snapshots.create(spark, root, tables)
    snapshots.purge(spark, root, retention.Scope(project_path=ledgers.GONE_PROJECT), 1)
    return root


@query("snapshot_purge", catalog.ORACLE_SQL["purged_tables"] + "\nUNION ALL SELECT 'deletion', 1")
def snapshot_purge(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each table after a purge has swapped the snapshot."""
    root = _snapshot(spark, sf)
    manifest = snapshots.current(spark, root)
    count = lambda name: snapshots.read(spark, root, name, manifest=manifest).agg(F.count("*").alias("rows_left")).select(F.lit(name).alias("name"), "rows_left")
    return reduce(DataFrame.unionByName, map(count, sorted(manifest["folders"])))


@query("snapshot_deletions", catalog.ORACLE_SQL["purge_deletion"])
def snapshot_deletions(spark: SparkSession, sf: str) -> DataFrame:
    """The deletions ledger as the snapshot has it, newest first."""
    found = retention.deletions(snapshots.read(spark, _snapshot(spark, sf), "deletion"))
    return found.select("scope", "sessions", "calls", "events", "bytes", "first_id", "last_id")


# --- evidence of calls, fragments, timelines with text, exports


@query("source_of_calls", lanes._over("SELECT tool_use_id, event_id * 8 AS evidence_id FROM b WHERE provenance <> 2").lstrip())
def source_of_calls(spark: SparkSession, sf: str) -> DataFrame:
    """From calls to the transcript lines that made them: half of them by their message, the others by their own id."""
    message = F.when(F.col("k") % 2 == 0, F.concat(F.lit("u-"), F.col("event_id").cast("string")))
    calls = lanes._base(spark, sf).select("tool_use_id", message.alias("message_uuid"))
    return evidence.source_records(calls, lanes.transcript(spark, sf)).filter("evidence_id IS NOT NULL")


_TERM = "CASE WHEN lower(x) = 'the' THEN 0 WHEN starts_with(lower(x), 'and') THEN 1 END"
_NEAR = f"list_filter(list_transform(w[i:i + {search.FRAGMENT - 1}], lambda x: {_TERM}), lambda y: y IS NOT NULL)"


@query("fragments", f"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS w FROM conversations),
p AS (SELECT conv_id, turn, w, i FROM t, unnest(range(1, len(w) + 1)) AS u(i) WHERE list_transform([w[i]], lambda x: {_TERM})[1] IS NOT NULL),
b AS (SELECT * FROM (SELECT *, len(list_distinct({_NEAR})) AS d, len({_NEAR}) AS n FROM p) QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY d DESC, n DESC, i) = 1)
SELECT conv_id, turn, CASE WHEN i > 1 THEN '…' ELSE '' END || array_to_string(list_transform(w[i:i + {search.FRAGMENT - 1}], lambda x: CASE WHEN {_TERM} IS NULL THEN x ELSE chr(1) || x || chr(2) END), ' ')
  || CASE WHEN i + {search.FRAGMENT - 1} < len(w) THEN '…' ELSE '' END AS fragment FROM b""")
def fragments(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", search.fragment(F.col("text"), "the and").alias("fragment"))
    return rows.filter("fragment IS NOT NULL")


_BRANCH = "'branch' || CAST(CAST(substr(session_id, 6) AS INT) % 4 AS STRING)"


@query("timeline_search", catalog._more(f"""{catalog._MC}, {catalog._FR},
x AS (SELECT *, CASE WHEN session_id IS NOT NULL THEN {_BRANCH} END AS git_branch, regexp_extract_all(input_summary, '[\\p{{L}}\\p{{N}}]+') AS w FROM fr WHERE contains(coalesce({catalog._TOK.format('input_summary')}, ''), ' force '))""",
  f"""SELECT tool_use_id, called_at, project_path, git_branch, CASE WHEN list_position(w, 'force') > 1 THEN '…' ELSE '' END || chr(1) || 'force' || chr(2) ||
  CASE WHEN list_position(w, 'force') < len(w) THEN ' ' || array_to_string(w[list_position(w, 'force') + 1:list_position(w, 'force') + {search.FRAGMENT - 1}], ' ') ELSE '' END AS snippet FROM x ORDER BY called_at DESC NULLS LAST, row_seq DESC LIMIT 100"""))
def timeline_search(spark: SparkSession, sf: str) -> DataFrame:
    """A page of the calls that a text finds, with their session's branch and the text's best fragment. The fragments here
    are short, so they reach the text's end."""
    calls = materialize(tv.calls(spark, sf).select(*catalog._NARROW), "frame-calls")
    sessions = tv.sessions_of(calls).withColumn("git_branch", F.expr(_BRANCH.replace("substr", "substring")))
    frame = rules.enriched(calls, sessions, catalog._changes(spark, sf)).withColumn("result_text", F.lit(None).cast("string"))
    found = reads.timeline_rows(frame, Lens(CallFilter(text="force ")))
    return found.select("tool_use_id", "called_at", "project_path", "git_branch", "snippet")


@query("export_csv_file", f"""{tv.sql_prefix()},
o AS (SELECT value, row_number() OVER (ORDER BY called_at DESC NULLS LAST, row_seq DESC) AS line FROM (SELECT called_at, row_seq, {catalog.ORACLE_SQL['export_csv'].rsplit('SELECT ', 1)[1].rsplit(' FROM tc', 1)[0]} FROM tc))
SELECT 0::BIGINT AS line, 'called_at,session_id,tool_name,success,duration_ms,decision,decision_source,lanes,target_path,input_summary' AS value UNION ALL SELECT line, value FROM o WHERE line <= 500""".lstrip())
def export_csv_file(spark: SparkSession, sf: str) -> DataFrame:
    """The file's lines: the header, then the newest 500 calls."""
    return export.file_lines(tv.calls(spark, sf), "csv", 500)


_MD_ROWS = catalog.ORACLE_SQL["export_markdown"].rsplit("SELECT ", 1)[1].rsplit(" FROM tc", 1)[0]
_MD_LINES = ["# export", "", "Exported 2023-11-14T22:13:20Z.", "", *export.MD_HEAD]


@query("export_markdown_file", f"""{tv.sql_prefix()},
o AS (SELECT value, row_number() OVER (ORDER BY called_at DESC NULLS LAST, row_seq DESC) AS line FROM (SELECT called_at, row_seq, {_MD_ROWS} FROM tc)),
n AS (SELECT count(*) AS n FROM o WHERE line <= 100)
SELECT {1 - len(_MD_LINES)} + i AS line, h AS value FROM (SELECT unnest(range(0, {len(_MD_LINES)})) AS i, unnest([{', '.join("'" + h + "'" for h in _MD_LINES)}]) AS h) UNION ALL SELECT line, value FROM o WHERE line <= 100
UNION ALL SELECT n + 1, '' FROM n UNION ALL SELECT n + 2, n || ' {export.MD_NOTE}' FROM n""".lstrip())
def export_markdown_file(spark: SparkSession, sf: str) -> DataFrame:
    return export.file_lines(tv.calls(spark, sf), "markdown", 100, now=1_700_000_000_000)


def _size_sql(n: str) -> str:
    units = "".join(f" WHEN {n} < {1024 ** (p + 1)} THEN printf('%.1f {u}', {n} / {1024**p}.0)" for p, u in ((1, "KiB"), (2, "MiB")))
    return f"CASE WHEN {n} < 1024 THEN {n} || ' B'{units} ELSE printf('%.2f GiB', {n} / {1024**3}.0) END"


@query("byte_sizes", f"SELECT doc_id, {_size_sql('strlen(text)')} AS size FROM documents WHERE text IS NOT NULL")
def byte_sizes(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("text IS NOT NULL")
    return docs.select("doc_id", metrics.size_words(F.octet_length("text").cast("long")).alias("size"))


@query("today", catalog._more("n AS (SELECT max(called_at) AS now FROM tc)", f"SELECT count(*) AS calls, any_value(now - (now + {metrics.HOUR}) % {metrics.DAY}) AS since FROM tc, n WHERE called_at >= now - (now + {metrics.HOUR}) % {metrics.DAY}"))
def today(spark: SparkSession, sf: str) -> DataFrame:
    """Calls since the local midnight (an hour east of UTC) before the newest call."""
    calls = tv.calls(spark, sf)
    since = calls.agg(metrics.start_of_day(F.max("called_at"), metrics.HOUR).alias("since"))
    return calls.join(F.broadcast(since), F.col("called_at") >= F.col("since")).agg(F.count("*").alias("calls"), F.first("since").alias("since"))


@query("ingested_batches", "SELECT sha256(text) AS content_sha256, 'otlp-' || min(CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END) AS batch FROM documents GROUP BY 1")
def ingested_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Contents by the batch that brought them: half of the documents, then all of them, twice."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("source").alias("source_ref"), F.col("doc_id").alias("source_offset"), F.col("text").alias("body"))
    path = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    ingest.create(spark, path)
    ingest.ingest(docs.filter("doc_id % 2 = 0"), path, "otlp", 1, 0, digits=1)
    for _ in range(2):
        ingest.ingest(docs, path, "otlp", 2, 1, digits=1)
    return ingest.stored(spark, path).select("content_sha256", "batch")


# --- tables kept in step with the evidence


@query("reprojected_calls", catalog.ORACLE_SQL["projected_calls"])
def reprojected_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of both lanes whose evidence came in two batches that split most sessions and calls."""
    path = f"{shared_dir(spark)}/projected-{uuid.uuid4().hex}"
    reproject.create(spark, path, 8)
    for k in range(2):
        own = lambda n: F.pmod(F.xxhash64(n), F.lit(2)) == k  # noqa: B023,E731
        reproject.apply(lanes.transcript(spark, sf, own).unionByName(lanes.telemetry_calls(spark, sf, own)), path, str(k))
    found = reproject.read(spark, path, "tool_call")
    return found.select("tool_use_id", "provenance", "tool_name", "success", "decision", "duration_ms", "result_text", "input_summary", "agent_name", "row_seq")
