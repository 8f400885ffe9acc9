"""A model's second opinions: which calls to ask about, the prompt, the answers and their ledger."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Categories, the block's markers and what stands for them inside, the mark of a cut, limits, fields.
CATEGORIES = ("read", "search", "build", "test", "vcs", "package", "network", "filesystem", "process", "config", "other")
OPEN, CLOSE = "<<<COMMAND", "COMMAND>>>"
SAFE_OPEN, SAFE_CLOSE = "<_<COMMAND", "COMMAND>_>"
CUT = "\n… (truncated)"
MOST_COMMAND, MOST_SUMMARY = 2000, 200
LEAST_SCORE, MOST_SCORE = 1, 5
SUMMARY, CATEGORY, SCORE, DESTRUCTIVE, SANDBOX = "intent_summary", "category", "risk_score", "is_destructive", "violates_sandbox"


def eligible(calls: DataFrame, sightings: DataFrame) -> DataFrame:
    """Shell calls with a command that no rule has examined."""
    shell = calls.filter("tool_name = 'Bash' AND input_summary IS NOT NULL AND input_summary <> ''")
    return shell.join(sightings.select("tool_use_id").distinct(), "tool_use_id", "left_anti")


def pair_of(verdicts: DataFrame, model_fp: str, prompt_fp: str) -> DataFrame:
    return verdicts.filter((F.col("model_fp") == model_fp) & (F.col("prompt_fp") == prompt_fp))


def pending(calls: DataFrame, sightings: DataFrame, verdicts: DataFrame, model_fp: str, prompt_fp: str, limit: int | None = None) -> DataFrame:
    """Eligible calls that this pair has not answered, oldest first."""
    rest = eligible(calls, sightings).join(pair_of(verdicts, model_fp, prompt_fp).select("tool_use_id"), "tool_use_id", "left_anti")
    rest = rest.orderBy(F.asc_nulls_first("called_at"), "row_seq")
    return rest.limit(limit) if limit else rest


def safe_command(command: Column) -> Column:
    """The command as it stands in its block: the block's markers are broken up, then it is cut to MOST_COMMAND characters,
    which a mark says."""
    safe = F.replace(F.replace(command, F.lit(CLOSE), F.lit(SAFE_CLOSE)), F.lit(OPEN), F.lit(SAFE_OPEN))
    return F.when(F.char_length(safe) > MOST_COMMAND, F.concat(F.left(safe, F.lit(MOST_COMMAND)), F.lit(CUT))).otherwise(safe)


def render(command: Column, prefix: str, suffix: str) -> Column:
    """The prompt around safe_command(). ``prefix`` ends with the opening marker and a line end, ``suffix`` begins with a
    line end and the closing marker."""
    return F.concat(F.lit(prefix), safe_command(command), F.lit(suffix))


def prompt_fingerprint(prefix: str, suffix: str, grammar: str) -> str:
    return hashlib.sha256(b"\0".join(x.encode() for x in (prefix, suffix, grammar))).hexdigest()


def score(prompts: DataFrame, scorer: Callable[[list[str]], list[str]]) -> DataFrame:
    """prompts(tool_use_id, prompt) -> (tool_use_id, answer, ms). ``scorer`` answers a list of prompts; it runs in the
    tasks, an Arrow batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for pdf in batches:
            began = time.monotonic()
            answers = scorer(pdf["prompt"].tolist())
            each = int((time.monotonic() - began) * 1000 / max(len(pdf), 1))
            yield pd.DataFrame({"tool_use_id": pdf["tool_use_id"], "answer": answers, "ms": each})

    return prompts.select("tool_use_id", "prompt").mapInPandas(run, "tool_use_id string, answer string, ms long")


def validate(answers: DataFrame) -> DataFrame:
    """Adds status (``ok`` or ``failed``), error, score, category, summary, is_destructive and violates_sandbox from the
    answer's outermost braces. Fields are looked at in the order summary, category, score, the two booleans; the
    first that is wrong is the error."""
    body = F.regexp_extract("answer", r"(?s)\{.*\}", 0)
    at = lambda key: F.try_variant_get("v", f"$.{key}", "variant")
    get = lambda key, kind: F.try_variant_get("v", f"$.{key}", kind)
    kind = lambda key: F.coalesce(F.schema_of_variant(at(key)), F.lit("VOID"))
    out = answers.withColumn("v", F.when(body != "", F.try_parse_json(body)))
    summary = F.regexp_replace(get(SUMMARY, "string"), r"^\s+|\s+$", "")
    error = F.when(F.coalesce(body, F.lit("")) == "", "the model emitted no JSON object").when(F.col("v").isNull(), "not valid JSON")
    for key, wanted, words, wrong in (
        (SUMMARY, "STRING", "a string", ((summary == "", F.lit("the intent summary is empty")),)),
        (CATEGORY, "STRING", "a string", ((~get(CATEGORY, "string").isin(*CATEGORIES), F.concat(F.lit("category `"), get(CATEGORY, "string"), F.lit("` is not one this schema defines"))),)),
        (SCORE, "BIGINT", "a whole number", ((~get(SCORE, "long").between(LEAST_SCORE, MOST_SCORE), F.concat(F.lit("risk_score is "), get(SCORE, "string"), F.lit(", and the scale is 1 to 5"))),)),
        (DESTRUCTIVE, "BOOLEAN", "true or false", ()),
        (SANDBOX, "BOOLEAN", "true or false", ()),
    ):
        error = error.when(at(key).isNull(), f"missing the field `{key}`").when(kind(key) != wanted, f"`{key}` is not {words}")
        for condition, text in wrong:
            error = error.when(condition, text)
    out = out.withColumn("error", error)
    good = lambda c: F.when(F.col("error").isNull(), c)
    return (
        out.withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("failed"))
        .withColumn("score", good(get(SCORE, "int")))
        .withColumn("category", good(get(CATEGORY, "string")))
        .withColumn("summary", good(F.left(summary, F.lit(MOST_SUMMARY))))
        .withColumn(DESTRUCTIVE, good(get(DESTRUCTIVE, "boolean")))
        .withColumn(SANDBOX, good(get(SANDBOX, "boolean")))
        .drop("v")
    )


def record(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """The ledger with ``rows``: the latest row of each (call, model, prompt) holds."""
    keys = ("tool_use_id", "model_fp", "prompt_fp")
    rest = [c for c in ledger.columns if c not in keys]
    every = ledger.unionByName(rows.select(*ledger.columns))
    return every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "at").alias("x")).select(*keys, "x.*")


def progress(calls: DataFrame, sightings: DataFrame, verdicts: DataFrame, model_fp: str, prompt_fp: str) -> DataFrame:
    """eligible, examined, failed, queued (never below 0) and the rounded mean ms."""
    n = eligible(calls, sightings).agg(F.count("*").alias("eligible"))
    own = pair_of(verdicts, model_fp, prompt_fp).agg(
        F.count("*").alias("examined"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(F.avg("ms")).cast("long").alias("mean_ms")
    )
    return n.crossJoin(own).withColumn("queued", F.greatest(F.col("eligible") - F.col("examined"), F.lit(0).cast("long")))


def tallies(verdicts: DataFrame, model_fp: str, prompt_fp: str) -> DataFrame:
    ok = pair_of(verdicts, model_fp, prompt_fp).filter("status = 'ok'")
    return ok.groupBy("score").agg(F.count("*").alias("calls")).orderBy(F.desc("score"))


def top_scored(verdicts: DataFrame, calls: DataFrame, sessions: DataFrame, model_fp: str, prompt_fp: str, least: int = 4, limit: int = 20) -> DataFrame:
    """The worst verdicts; the ledger outlives calls, so the joins are left joins."""
    ok = pair_of(verdicts, model_fp, prompt_fp).filter("status = 'ok'").filter(F.col("score") >= least)
    seen = calls.select("tool_use_id", "session_id", "called_at", "input_summary")
    out = ok.join(seen, "tool_use_id", "left").join(sessions.select("session_id", "project_path"), "session_id", "left")
    return out.orderBy(F.desc("score"), F.desc_nulls_last("called_at"), "tool_use_id").limit(limit)


def second_opinion(calls: DataFrame, sightings: DataFrame, verdicts: DataFrame, model_fp: str, prompt_fp: str) -> DataFrame:
    """calls with opinion: ``verdict``, ``failed``, ``pending`` or ``not eligible``."""
    own = pair_of(verdicts, model_fp, prompt_fp).select("tool_use_id", "status")
    could = eligible(calls, sightings).select("tool_use_id", F.lit(True).alias("could"))
    joined = calls.join(own, "tool_use_id", "left").join(could, "tool_use_id", "left")
    word = F.when(F.col("status") == "ok", "verdict").when(F.col("status") == "failed", "failed").when(F.col("could"), "pending").otherwise("not eligible")
    return joined.withColumn("opinion", word).drop("status", "could")
