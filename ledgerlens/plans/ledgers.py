"""Queries over evidence lines, chains, purges and ledgers, and the same in SQL for comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import search
from ..operators import chain, merge, retention, rules, verdicts
from ..sources import evidence, transcripts
from . import catalog
from . import testviews as tv
from .catalog import query

#: Rows up to this id were read before.
READ_UPTO = 1000
GONE_PROJECT = "/work/p3"
HIGHLIGHTED = "the an"


# --- evidence lines

_LINES_SQL = """d AS (SELECT 'doc_' || doc_id AS source_ref, doc_id, string_split(text, chr(10)) AS cut, strlen(text) AS size FROM documents WHERE text <> ''),
p AS (SELECT source_ref, doc_id, size, len(cut) AS n, unnest(range(0, len(cut))) AS line_no, unnest(cut) AS raw FROM d),
o AS (SELECT *, coalesce(sum(strlen(raw) + 1) OVER (PARTITION BY source_ref ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS source_offset FROM p WHERE line_no < n - 1),
l AS (SELECT source_ref, doc_id, size, line_no, source_offset, rtrim(raw, chr(13)) AS body FROM o WHERE trim(rtrim(raw, chr(13))) <> '')"""


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as transcript files: each text is a file's bytes."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").filter("text IS NOT NULL")
    content = F.col("text").cast("binary")
    return rows.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source_ref"), "doc_id", F.octet_length(content).cast("long").alias("length"), content.alias("content"))


@query("line_offsets", f"WITH {_LINES_SQL} SELECT source_ref, line_no, source_offset, sha256(body) AS content_sha256 FROM l")
def line_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return transcripts.lines(_files(spark, sf)).select("source_ref", F.col("line_no").cast("long").alias("line_no"), "source_offset", chain.content_sha256(F.col("body")).alias("content_sha256"))


@query("resumed_lines", f"""WITH {_LINES_SQL},
st AS (SELECT source_ref, max(source_offset + CASE WHEN doc_id % 10 = 0 THEN 1000000 ELSE 0 END) AS last FROM l WHERE line_no <= doc_id % 4 GROUP BY 1)
SELECT l.source_ref, line_no, source_offset FROM l LEFT JOIN st USING (source_ref) WHERE source_offset >= CASE WHEN last > size THEN 0 ELSE coalesce(last, 0) END""")
def resumed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Some first lines of each file are stored; every tenth file was longer then."""
    found = _files(spark, sf)
    every = transcripts.lines(found)
    number = F.substring_index("source_ref", "_", -1).cast("long")
    stored = every.filter(F.col("line_no") <= number % 4).select(
        F.lit("transcript").alias("lane"), "source_ref", (F.col("source_offset") + F.when(number % 10 == 0, 1_000_000).otherwise(0)).alias("source_offset")
    )
    return transcripts.resume(every, found, stored).select("source_ref", F.col("line_no").cast("long").alias("line_no"), "source_offset")


@query("scan_after", f"SELECT id, source_ref, content_sha256 FROM raw WHERE lane = 'otlp' AND id > {READ_UPTO}")
def scan_after(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.scan(tv.raw_events(spark, sf), "otlp", READ_UPTO).select("id", "source_ref", "content_sha256")


@query("project_hints", "SELECT session_id, replace(replace(project_path, '/', '-'), '-', '/') AS hint FROM s")
def project_hints(spark: SparkSession, sf: str) -> DataFrame:
    return tv.sessions(spark, sf).select("session_id", transcripts.project_hint(F.translate("project_path", "/", "-")).alias("hint"))


@query("highlighted", f"SELECT doc_id, sha256(regexp_replace(text, '(?i)({'|'.join(sorted(HIGHLIGHTED.split(), key=len, reverse=True))})', chr(1) || '\\1' || chr(2), 'g')) AS marked_sha256 FROM documents")
def highlighted(spark: SparkSession, sf: str) -> DataFrame:
    marked = search.highlight(F.col("text"), HIGHLIGHTED)
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.sha2(marked.cast("binary"), 256).alias("marked_sha256"))


# --- modes


@query("last_known_mode", catalog._more(catalog._MC, """SELECT session_id, coalesce(a, b) AS mode FROM
  (SELECT session_id, mode AS a FROM mc WHERE mode IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC NULLS LAST, id DESC) = 1) FULL JOIN
  (SELECT session_id, permission_mode AS b FROM tc WHERE permission_mode IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY called_at DESC NULLS LAST, row_seq DESC) = 1) USING (session_id)"""))
def last_known_mode(spark: SparkSession, sf: str) -> DataFrame:
    return merge.last_known_mode(catalog._changes(spark, sf), tv.calls(spark, sf))


# --- chains

_CHAIN_CTES = catalog.ORACLE_SQL["chain_seal"].rsplit("SELECT id, chain_sha256 FROM c", 1)[0]


@query("chain_heads", f"""{_CHAIN_CTES}
SELECT c.lane, c.source_ref, arg_max(chain_sha256, id) FILTER (id % 5 <> 0) AS head, count(*) FILTER (id % 5 <> 0) AS sealed, count(*) FILTER (id % 5 = 0) AS unsealed FROM c GROUP BY 1, 2""")
def chain_heads(spark: SparkSession, sf: str) -> DataFrame:
    """Heads of the transcripts' chains, every fifth row not sealed."""
    raw = tv.raw_events(spark, sf).filter("lane = 'transcript'").withColumn("chain_sha256", F.lit(None).cast("string"))
    sealed = chain.seal(raw)
    return chain.heads(sealed.withColumn("chain_sha256", F.when(F.col("id") % 5 != 0, F.col("chain_sha256"))))


@query("chain_verdict", "SELECT count(*) AS breaks, count(*) AS unexplained, CASE WHEN count(*) = 0 THEN 'intact' ELSE 'unexplained' END AS verdict FROM raw WHERE id % 97 = 0")
def chain_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return chain.verdict(catalog.QUERIES["chain_verify"](spark, sf))


# --- purges


def _purged(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    calls = tv.calls(spark, sf)
    tables = {
        "session": tv.sessions(spark, sf),
        "tool_call": calls,
        "file_change": calls.filter("target_path IS NOT NULL").select("tool_use_id", F.col("target_path").alias("path")),
        "permission_mode_change": catalog._changes(spark, sf),
        "raw_event": tv.raw_events(spark, sf).withColumn("chain_sha256", F.lit(None).cast("string")),
    }
    return retention.purge(tables, retention.Scope(project_path=GONE_PROJECT), 1)


_GONE = f"g AS (SELECT session_id, transcript_path FROM s WHERE project_path = '{GONE_PROJECT}'), rm AS (SELECT * FROM raw WHERE lane = 'transcript' AND source_ref IN (SELECT transcript_path FROM g))"


@query("purged_tables", catalog._more(f"{catalog._MC}, {_GONE}", """SELECT 'session' AS name, count(*) AS rows_left FROM s WHERE session_id NOT IN (SELECT session_id FROM g)
UNION ALL SELECT 'tool_call', count(*) FROM tc WHERE session_id IS NULL OR session_id NOT IN (SELECT session_id FROM g)
UNION ALL SELECT 'file_change', count(*) FROM tc WHERE target_path IS NOT NULL AND (session_id IS NULL OR session_id NOT IN (SELECT session_id FROM g))
UNION ALL SELECT 'permission_mode_change', count(*) FROM mc WHERE session_id NOT IN (SELECT session_id FROM g)
UNION ALL SELECT 'raw_event', count(*) FROM raw WHERE id NOT IN (SELECT id FROM rm)"""))
def purged_tables(spark: SparkSession, sf: str) -> DataFrame:
    left = {k: v for k, v in _purged(spark, sf).items() if k != "deletion"}
    return reduce(DataFrame.unionByName, [v.agg(F.count("*").alias("rows_left")).select(F.lit(k).alias("name"), "rows_left") for k, v in left.items()])


@query("purge_deletion", catalog._more(_GONE, f"""SELECT 'project_path={GONE_PROJECT}' AS scope, (SELECT count(*) FROM g) AS sessions, (SELECT count(*) FROM tc WHERE session_id IN (SELECT session_id FROM g)) AS calls,
  count(*) AS events, coalesce(sum(strlen(body)), 0)::BIGINT AS bytes, min(id) AS first_id, max(id) AS last_id FROM rm"""))
def purge_deletion(spark: SparkSession, sf: str) -> DataFrame:
    return _purged(spark, sf)["deletion"].select("scope", "sessions", "calls", "events", "bytes", "first_id", "last_id")


@query("retention_totals", catalog._more(f"old AS (SELECT * FROM s WHERE coalesce(last_seen, first_seen, 0) < {catalog.CUTOFF_SQL})", f"""SELECT (SELECT count(*) FROM old) AS sessions,
  (SELECT count(*) FROM tc WHERE session_id IN (SELECT session_id FROM old)) AS calls,
  (SELECT count(*) FROM raw WHERE lane = 'transcript' AND source_ref IN (SELECT transcript_path FROM old)) AS events,
  (SELECT coalesce(sum(strlen(body)), 0)::BIGINT FROM raw WHERE lane = 'transcript' AND source_ref IN (SELECT transcript_path FROM old)) AS bytes,
  (SELECT count(*) FROM raw WHERE lane = 'otlp' AND ingested_at < {catalog.CUTOFF_SQL}) AS otlp_events"""))
def retention_totals(spark: SparkSession, sf: str) -> DataFrame:
    return retention.preview_totals(tv.sessions(spark, sf), tv.calls(spark, sf), tv.raw_events(spark, sf), retention.Scope(before=catalog._cutoff(spark, sf)))


# --- ledgers


@query("live_dismissals", """WITH x AS (SELECT 'rule_' || doc_id % 40 AS rule_id, 'note ' || doc_id AS note, doc_id AS "at", quality = 0 AS restored FROM labels)
SELECT rule_id, note, "at" FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY "at" DESC) = 1) WHERE NOT restored""")
def live_dismissals(spark: SparkSession, sf: str) -> DataFrame:
    """labels as the dismissals ledger: quality 0 restores a rule."""
    rows = spark.read.parquet(f"{sf}/labels.parquet")
    ledger = rows.selectExpr("'rule_' || CAST(doc_id % 40 AS STRING) AS rule_id", "'note ' || CAST(doc_id AS STRING) AS note", "doc_id AS at", "quality = 0 AS restored")
    return rules.live_dismissals(ledger)


@query("first_sightings", catalog._more(catalog._RULES_SQL, "SELECT h.rule_id, f.fp AS fingerprint, min(coalesce(h.called_at, 0)) AS first_seen, count(*) AS calls FROM hit h JOIN (VALUES "
  + ", ".join(f"('{r.id}', '{rules.fingerprint(r)}')" for r in catalog.RULES) + ") f(rule_id, fp) ON f.rule_id = h.rule_id GROUP BY 1, 2"))
def first_sightings(spark: SparkSession, sf: str) -> DataFrame:
    """Of a ledger that has each call's matches as seen when it was made, written before rules had fingerprints."""
    seen = catalog._matched(spark, sf).select(F.explode("rule_ids").alias("rule_id"), F.lit("").alias("fingerprint"), "tool_use_id", F.coalesce("called_at", F.lit(0).cast("long")).alias("first_seen"))
    return rules.first_sightings(rules.adopted(seen, list(catalog.RULES)))


@query("verdict_record", f"""{tv.sql_prefix()}
SELECT tool_use_id, CASE WHEN "at" % 3 = 0 THEN 'failed' ELSE status END AS status, CASE WHEN "at" % 3 = 0 THEN NULL ELSE score END AS score, CASE WHEN "at" % 3 = 0 THEN "at" + 1 ELSE "at" END AS "at" FROM v""")
def verdict_record(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the calls were examined once more and failed; a row of an earlier time changes nothing."""
    ledger = tv.verdicts(spark, sf)
    third = F.col("at") % 3 == 0
    again = ledger.filter((F.col("at") % 3) < 2).withColumn("status", F.lit("failed")).withColumn("score", F.lit(None).cast("int"))
    again = again.withColumn("at", F.when(third, F.col("at") + 1).otherwise(F.col("at") - 1))
    return verdicts.record(ledger, again).select("tool_use_id", "status", "score", "at")
