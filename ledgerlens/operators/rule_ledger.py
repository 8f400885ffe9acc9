"""Rules evaluated once for each call: a ledger of matches with a watermark for each rule's fingerprint.

A run matches the calls that have come since a rule's watermark, and the other calls of their sessions, since first calls,
retries and changes of mode depend on the session. A rule whose conditions change has a new fingerprint, and so no
watermark: it alone is matched over all calls.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import materialize
from .rules import Rule, enriched, fingerprint, matched_rules

MATCH = "rule_id string, fingerprint string, tool_use_id string, upto long, matched boolean"
WATERMARK = "fingerprint string, upto long, calls long"


def create(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], MATCH).write.parquet(f"{path}/matches")
    spark.createDataFrame([], WATERMARK).write.parquet(f"{path}/watermarks")


def matches(spark: SparkSession, path: str) -> DataFrame:
    """(rule_id, fingerprint, tool_use_id, upto): what matches now, by each fingerprint's latest word on a call."""
    rows = spark.read.schema(MATCH).parquet(f"{path}/matches").groupBy("rule_id", "fingerprint", "tool_use_id")
    last = rows.agg(F.max_by("matched", "upto").alias("matched"), F.max("upto").alias("upto"))
    return last.filter("matched").drop("matched")


def watermarks(spark: SparkSession, path: str) -> dict[str, int]:
    """For the driver: one number for each fingerprint."""
    rows = spark.read.schema(WATERMARK).parquet(f"{path}/watermarks").groupBy("fingerprint").agg(F.max("upto"))
    return dict(map(tuple, rows.collect()))


def touched(calls: DataFrame, changes: DataFrame, after: int, seq: str) -> DataFrame:
    """The calls since ``after`` and all calls of their sessions, and of sessions whose mode has changed since."""
    if after < 0:
        return calls
    new = calls.filter(F.col(seq) > after)
    sessions = new.select("session_id").union(changes.filter(F.col("id") > after).select("session_id")).filter("session_id IS NOT NULL").distinct()
    return calls.join(sessions, "session_id", "left_semi").select(*calls.columns).union(new.filter("session_id IS NULL"))


def run(calls: DataFrame, sessions: DataFrame, changes: DataFrame, rules: list[Rule], path: str, upto: int, seq: str = "row_seq") -> int:
    """Brings the ledger at ``path`` up to evidence ``upto``; how many calls were looked at. ``seq`` is the evidence id that last
    touched a call: where calls change, pass that and not the first one. The matches are written before the watermarks, so
    a run that stopped halfway is done again with the same result."""
    spark = calls.sparkSession
    known = watermarks(spark, path)
    groups: dict[int, list[Rule]] = defaultdict(list)
    for r in rules:
        groups[known.get(fingerprint(r), -1)].append(r)
    looked = 0
    for after, some in groups.items():
        if after >= upto:
            continue
        asked = touched(calls.filter(F.col(seq) <= upto), changes.filter(F.col("id") <= upto), after, seq)
        asked = materialize(asked, "rule-calls")
        own = changes.filter(F.col("id") <= upto)
        frame = enriched(asked, sessions, own if after < 0 else own.join(asked.select("session_id").distinct(), "session_id", "left_semi"))
        prints = F.create_map(*[F.lit(x) for r in some for x in (r.id, fingerprint(r))])
        now = matched_rules(frame, some).select(F.explode("rule_ids").alias("rule_id"), "tool_use_id")
        now = now.select("rule_id", prints[F.col("rule_id")].alias("fingerprint"), "tool_use_id").withColumn("matched", F.lit(True))
        now = materialize(now, "rule-matches")
        before = matches(spark, path).filter(F.col("fingerprint").isin(*[fingerprint(r) for r in some])).join(asked.select("tool_use_id"), "tool_use_id", "left_semi")
        key = ["rule_id", "fingerprint", "tool_use_id"]
        over = before.join(now, key, "left_anti").select(*key, F.lit(False).alias("matched"))
        fresh = now.join(before, key, "left_anti").unionByName(over)
        fresh = materialize(fresh.select(*key, F.lit(upto).cast("long").alias("upto"), "matched"), "rule-fresh")
        fresh.write.mode("append").parquet(f"{path}/matches")
        n = asked.count()
        looked += n
        marks = [(fingerprint(r), upto, n) for r in some]
        spark.createDataFrame(marks, WATERMARK).coalesce(1).write.mode("append").parquet(f"{path}/watermarks")
    return looked
