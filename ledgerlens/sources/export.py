"""Exports of calls: JSON lines, a JSON array, CSV and Markdown, one text row for each call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.verify import OTLP, TRANSCRIPT, has

# The CSV's columns, the Markdown table's head, the words for lanes.
CSV_COLUMNS = ("called_at", "session_id", "tool_name", "success", "duration_ms", "decision", "decision_source", "lanes", "target_path", "input_summary")
MD_HEAD = ("| Time (UTC) | Tool | Result | Duration | Decision | Lanes | Summary |", "|---|---|---|---|---|---|---|")
BOTH, TRANSCRIPT_ONLY, OTLP_ONLY, NEITHER = "both", "transcript", "otel", "none"
_BARE = ("called_at", "success", "duration_ms")


def stamp(ms: Column) -> Column:
    """RFC 3339 in UTC; a fraction without its last zeros."""
    whole = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss")
    part = F.regexp_replace(F.concat(F.lit("."), F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0")), r"\.?0+$", "")
    return F.concat(whole, part, F.lit("Z"))


def lanes() -> Column:
    return F.when(has(TRANSCRIPT) & has(OTLP), BOTH).when(has(TRANSCRIPT), TRANSCRIPT_ONLY).when(has(OTLP), OTLP_ONLY).otherwise(NEITHER)


def outcome() -> Column:
    return F.when(F.col("decision") == "reject", "refused").when(F.col("success"), "ok").when(~F.col("success"), "failed").otherwise("")


def json_lines(calls: DataFrame) -> DataFrame:
    return calls.select(F.to_json(F.struct(*calls.columns)).alias("value"))


def json_array(calls: DataFrame) -> DataFrame:
    """One row with a JSON array; for small results."""
    listed = F.array_sort(F.collect_list(F.struct(F.coalesce(-F.col("called_at"), F.lit(1 << 62)).alias("k"), (-F.col("row_seq")).alias("s"), F.to_json(F.struct(*calls.columns)).alias("v"))))
    return calls.agg(F.concat(F.lit("["), F.array_join(F.transform(listed, lambda x: x["v"]), ","), F.lit("]")).alias("value"))


def csv_lines(calls: DataFrame, *keep: str) -> DataFrame:
    """Texts always quoted, nulls too, and quotes doubled; numbers and booleans bare, nulls empty."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    value = lambda c: lanes() if c == "lanes" else F.col(c)
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in _BARE else quote(value(c)) for c in CSV_COLUMNS]
    return calls.select(*keep, F.concat_ws(",", *cells).alias("value"))


def md_cell(text: Column) -> Column:
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.coalesce(F.translate(escaped, "\r\n", "  "), F.lit(""))


def markdown_lines(calls: DataFrame, *keep: str) -> DataFrame:
    took = F.concat(F.col("duration_ms").cast("string"), F.lit(" ms"))
    told = F.coalesce("input_summary", "target_path")
    cells = (stamp(F.col("called_at")), md_cell(F.col("tool_name")), outcome(), took, md_cell(F.col("decision_source")), lanes(), md_cell(told))
    return calls.select(*keep, F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c, F.lit("")) for c in cells]), F.lit(" |")).alias("value"))


# Fixed value: what a Markdown export says about lanes.
MD_NOTE = (
    "calls. **Lanes** is how completely each call was observed: `both` is the full record; `transcript` means no decision, duration or cost "
    "was ever recorded for it; `otel` means no transcript body was written."
)


def file_lines(calls: DataFrame, kind: str, limit: int, title: str = "# export", now: int = 0) -> DataFrame:
    """(line, value) of an export file, ``csv`` or ``markdown``: what stands before the rows has lines up to 0, the newest
    ``limit`` calls follow in order. The calls are cut to the limit before they are numbered, so one task gets no more."""
    newest = calls.orderBy(F.desc_nulls_last("called_at"), F.desc("row_seq")).limit(limit)
    order = W.orderBy(F.desc_nulls_last("called_at"), F.desc("row_seq"))
    numbered = newest.withColumn("line", F.row_number().over(order).cast("long"))
    lines = {"csv": csv_lines, "markdown": markdown_lines}[kind]
    rows = lines(numbered, "line")
    spark = calls.sparkSession
    fixed = lambda values: spark.createDataFrame([(k - len(values) + 1, v) for k, v in enumerate(values)], "line long, value string")
    if kind == "csv":
        return fixed([",".join(CSV_COLUMNS)]).unionByName(rows)
    said = F.lit(now).cast("long")
    head = fixed([title, "", "", "", *MD_HEAD]).withColumn("value", F.when(F.col("line") == -3, F.concat(F.lit("Exported "), stamp(said), F.lit("."))).otherwise(F.col("value")))
    note = numbered.agg(F.count("*").alias("n")).select((F.col("n") + 2).alias("line"), F.concat(F.col("n").cast("string"), F.lit(f" {MD_NOTE}")).alias("value"))
    blank = note.select((F.col("line") - 1).alias("line"), F.lit("").alias("value"))
    return head.unionByName(rows).unionByName(blank).unionByName(note)


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    lines.write.mode(mode).text(path)
