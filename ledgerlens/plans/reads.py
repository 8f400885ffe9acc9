"""Composite reads: timeline rows, one call in detail, the completeness report, the risk review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import search
from ..operators import filters, rules, verdicts, verify
from ..operators.filters import Lens
from ..sources import transcripts
from ..staging import materialize


def timeline_rows(frame: DataFrame, lens: Lens, changes: DataFrame | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of calls with snippet, size of the change, verdict and risk. The page's narrow keys are chosen first; only
    its rows are decorated."""
    found = filters.page(filters.matching(frame, lens), limit, offset)
    if lens.rules is not None:
        found = rules.matched_rules(found, list(lens.rules), set(lens.dismissed))
    if lens.filter.text:
        found = found.withColumn("snippet", F.coalesce(*[search.fragment(F.col(f), lens.filter.text) for f in reversed(search.CALL_FIELDS)]))
    if changes is not None:
        sums = changes.groupBy("tool_use_id").agg(F.sum("lines_added").alias("lines_added"), F.sum("lines_removed").alias("lines_removed"))
        found = found.join(sums, "tool_use_id", "left")
    if lens.verdicts is not None:
        own = lens.pair().select("tool_use_id", F.when(F.col("status") == "ok", F.col("score")).alias("score"), F.col("summary").alias("intent"))
        found = found.join(own, "tool_use_id", "left")
    return found.orderBy(F.desc_nulls_last("called_at"), F.desc("row_seq"))


def plain_page(calls: DataFrame, sessions: DataFrame, lens: Lens, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of calls with their session's place, for filters that need no other table: the page is chosen among the
    calls alone, and its few rows look their sessions up."""
    found = filters.page(filters.matching(calls, lens), limit, offset)
    placed = found.join(sessions.select("session_id", "project_path"), "session_id", "left")
    return placed.orderBy(F.desc_nulls_last("called_at"), F.desc("row_seq"))


def search_calls(frame: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """A blank query finds nothing."""
    if not search.terms(query):
        return frame.limit(0).withColumn("snippet", F.lit(None).cast("string"))
    return timeline_rows(frame, Lens(filters.CallFilter(text=query)), limit=limit)


def call_details(frame: DataFrame, all_rules: list[rules.Rule], sightings: DataFrame, ledger: DataFrame, model_fp: str, prompt_fp: str) -> DataFrame:
    """An enriched() frame with what one call's pane shows, for all calls at once: rule_ids, titles and severity of the rules
    that match, the opinion's state and the verdict."""
    matched = rules.matched_rules(frame, all_rules)
    told = verdicts.second_opinion(frame.select("tool_use_id", "tool_name", "input_summary"), sightings, ledger, model_fp, prompt_fp).select("tool_use_id", "opinion")
    own = verdicts.pair_of(ledger, model_fp, prompt_fp).filter("status = 'ok'")
    own = own.select("tool_use_id", "score", "category", F.col("summary").alias("intent"), verdicts.DESTRUCTIVE, verdicts.SANDBOX)
    return matched.join(told, "tool_use_id", "left").join(own, "tool_use_id", "left")


def call_detail(
    tool_use_id: str, frame: DataFrame, changes: DataFrame, all_rules: list[rules.Rule], sessions: DataFrame, sightings: DataFrame, ledger: DataFrame, model_fp: str, prompt_fp: str
) -> dict[str, DataFrame]:
    """One call: itself with rules, opinion and verdict, its session and its file changes."""
    one = F.col("tool_use_id") == tool_use_id
    call = frame.filter(one)
    return {
        "call": call_details(call, all_rules, sightings.filter(one), ledger.filter(one), model_fp, prompt_fp),
        "session": sessions.join(call.select("session_id"), "session_id", "left_semi"),
        "files": changes.filter(one),
    }


def source_lines(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """wanted(tool_use_id, evidence_id) with the evidence rows' lane, source, line number and body. Lines are counted in
    narrow rows of the wanted sources only."""
    rows = stored.select("id", "lane", "source_ref", "source_offset")
    sources = rows.join(wanted.select(F.col("evidence_id").alias("id")), "id", "left_semi").select("source_ref").distinct()
    counted = transcripts.line_number(rows.filter("lane = 'transcript'").join(sources, "source_ref", "left_semi")).select("id", "line_no")
    found = wanted.join(stored.select(F.col("id").alias("evidence_id"), "lane", "source_ref", "body"), "evidence_id")
    return found.join(counted.withColumnRenamed("id", "evidence_id"), "evidence_id", "left")


def completeness_report(calls: DataFrame, sessions: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    return {
        "header": verify.completeness(calls, requests),
        "lanes": verify.reconcile(calls),
        "sessions": verify.session_completeness(calls, sessions),
        "gaps": verify.gaps(calls),
    }


def risk_review(frame: DataFrame, all_rules: list[rules.Rule], sightings: DataFrame, dismissals: DataFrame) -> dict[str, DataFrame]:
    """Findings, posture and totals over one written pass of all rules."""
    gone = rules.dismissed_ids(dismissals)
    matched = rules.matched_rules(frame, all_rules).select("tool_use_id", "session_id", "project_path", "called_at", "rule_ids")
    matched = materialize(matched, "risk-review")
    return {
        "findings": rules.evaluate(matched, all_rules, gone),
        "projects": rules.posture(matched, all_rules, gone),
        "totals": rules.severity_totals(matched, all_rules, gone),
        "first_seen": rules.first_sightings(sightings),
    }
