"""Risk rules as data, compiled to Columns over one enriched frame of calls.

All rules are evaluated in one pass: each is a boolean column, a call's matches are an array of rule ids, and the
rollups explode that array. Nothing is evaluated per rule.
"""

from __future__ import annotations

import hashlib
import re
import string
import tomllib
from dataclasses import dataclass, field, fields
from functools import reduce
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEVERITIES = ("info", "low", "medium", "high")
SCOPES = ("call", "session", "retry_after_refusal")
#: A refused command and its retry agree at least this far.
LEAST_PREFIX = 8
_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
#: Substrings are compared without case in A-Z only.
_ASCII = str.maketrans(_UPPER, _LOWER)


@dataclass(frozen=True)
class Match:
    tools: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    decisions: tuple[str, ...] = ()
    decision_sources: tuple[str, ...] = ()
    permission_modes: tuple[str, ...] = ()
    success: bool | None = None
    main_thread: bool | None = None
    first_line: bool = False
    summary_contains: tuple[str, ...] = ()
    summary_glob: tuple[str, ...] = ()
    path_glob: tuple[str, ...] = ()
    outside_cwd: bool = False
    mode_changed: bool = False


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    severity: str
    scope: str = "call"
    explanation: str = ""
    match: Match = field(default_factory=Match)

    def __post_init__(self) -> None:
        if self.severity not in SEVERITIES or self.scope not in SCOPES:
            raise ValueError(f"rule {self.id}: unknown severity or scope")


def parse_rules(text: str) -> list[Rule]:
    known = {f.name for f in fields(Match)}
    out = []
    for raw in tomllib.loads(text).get("rule", []):
        match = raw.pop("match", {})
        if unknown := set(match) - known:
            raise ValueError(f"rule {raw.get('id')}: unknown conditions {sorted(unknown)}")
        out.append(Rule(**raw, match=Match(**{k: tuple(v) if isinstance(v, list) else v for k, v in match.items()})))
    return out


def load_rules(user_toml: str | None = None) -> list[Rule]:
    """Built-in rules; a user's rule replaces the one with its id in place, or is appended."""
    rules = {r.id: r for r in parse_rules(resources.files(__package__).joinpath("rules.toml").read_text())}
    rules |= {r.id: r for r in parse_rules(user_toml or "")}
    return list(rules.values())


def glob_regex(patterns: tuple[str, ...]) -> str:
    """Anchored, case-sensitive ``*``, ``?``, ``[...]`` and ``[^...]`` patterns as one regular expression."""

    def one(glob: str) -> str:
        out, k = "", 0
        while k < len(glob):
            c = glob[k]
            close = glob.find("]", k + 2 if glob[k + 1 : k + 2] != "^" else k + 3) if c == "[" else -1
            if close > 0:
                body = glob[k + 1 : close]
                negated = body.startswith("^")
                inner = re.sub(r"([\\\[\]&~^])", r"\\\1", body[1:] if negated else body)
                out += f"[{'^' if negated else ''}{inner}]"
                k = close
            else:
                out += ".*" if c == "*" else "." if c == "?" else re.sub(r"([^\w\s])", r"\\\1", c)
            k += 1
        return out

    return f"(?s)^(?:{'|'.join(map(one, patterns))})$"


def compile_rule(rule: Rule, strict_cwd: bool = True) -> Column:
    """The rule as a boolean Column over an enriched() frame; unknown is no match. ``strict_cwd=False`` takes any
    target that starts with the directory's text as inside it."""
    m, c = rule.match, F.col
    parts: list[Column] = []
    for values, name in (
        (m.tools, "tool_name"),
        (m.kinds, "tool_kind"),
        (m.decisions, "decision"),
        (m.decision_sources, "decision_source"),
        (m.permission_modes, "permission_mode"),
    ):
        if values:
            parts.append(c(name).isin(*values))
    if m.success is not None:
        parts.append(c("success") == m.success)
    if m.main_thread is not None:
        parts.append(c("agent_id").isNull() if m.main_thread else c("agent_id").isNotNull())
    looked = F.substring_index("input_summary", "\n", 1) if m.first_line else c("input_summary")
    if m.summary_contains:
        parts.append(reduce(Column.__or__, (F.translate(looked, _UPPER, _LOWER).contains(x.translate(_ASCII)) for x in m.summary_contains)))
    if m.summary_glob:
        parts.append(looked.rlike(glob_regex(m.summary_glob)))
    if m.path_glob:
        parts.append(c("target_path").rlike(glob_regex(m.path_glob)))
    if m.outside_cwd:
        inside = F.startswith(c("target_path"), c("session_cwd"))
        if strict_cwd:
            below = F.startswith(c("target_path"), F.concat(F.rtrim("session_cwd", F.lit("/")), F.lit("/")))
            inside = below | (c("target_path") == c("session_cwd"))
        parts.append(~inside)
    if m.mode_changed:
        parts.append(c("mode_changed"))
    if not parts:
        return F.lit(False)
    if rule.scope == "session":
        parts.append(c("is_first_in_session"))
    if rule.scope == "retry_after_refusal":
        parts.append(c("is_retry"))
    return F.coalesce(reduce(Column.__and__, parts), F.lit(False))


def describe(m: Match) -> list[str]:
    """A phrase for each condition."""
    out = []
    for values, words in (
        (m.tools, "the tool is"),
        (m.kinds, "the tool kind is"),
        (m.decisions, "the decision was"),
        (m.decision_sources, "the decision came from"),
        (m.permission_modes, "the permission mode was"),
    ):
        if values:
            out.append(f"{words} {', '.join(values)}")
    if m.success is not None:
        out.append(f"the call {'succeeded' if m.success else 'failed'}")
    if m.main_thread is not None:
        out.append("the call was on the main thread" if m.main_thread else "the call was made by a subagent")
    looked = "the command's first line" if m.first_line else "the command"
    for values, words in (
        (m.summary_contains, f"{looked} contains any of:"),
        (m.summary_glob, f"{looked} matches any of:"),
        (m.path_glob, "the target path matches any of:"),
    ):
        if values:
            out.append(f"{words} {', '.join(values)}")
    if m.first_line and not (m.summary_contains or m.summary_glob):
        out.append("only the command's first line is looked at")
    if m.outside_cwd:
        out.append("the call wrote outside its session's working directory")
    if m.mode_changed:
        out.append("the session's permission mode changed while it was running")
    return out or ["nothing — this rule states no conditions and matches nothing"]


def fingerprint(rule: Rule) -> str:
    """First 16 hex digits of SHA-256 over scope and conditions; titles and severities don't count. The layout is a fixed
    format, so recorded sightings stay comparable."""
    m = rule.match
    optional = lambda v: "None" if v is None else f"Some({str(v).lower()})"
    scope = "".join(w.capitalize() for w in rule.scope.split("_"))
    values = (
        ("scope", scope), ("tools", m.tools), ("kinds", m.kinds), ("decisions", m.decisions), ("sources", m.decision_sources),
        ("modes", m.permission_modes), ("success", optional(m.success)), ("main_thread", optional(m.main_thread)),
        ("first_line", m.first_line), ("contains", m.summary_contains), ("glob", m.summary_glob),
        ("path_glob", m.path_glob), ("outside_cwd", m.outside_cwd), ("mode_changed", m.mode_changed),
    )
    spell = lambda v: "\x1f".join(v) if isinstance(v, tuple) else str(v).lower() if isinstance(v, bool) else v
    return hashlib.sha256("\n".join(f"{k}={spell(v)}" for k, v in values).encode()).hexdigest()[:16]


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(k, r.id, r.title, r.explanation, r.severity, SEVERITIES.index(r.severity), r.scope, fingerprint(r), describe(r.match)) for k, r in enumerate(rules)]
    return spark.createDataFrame(
        rows,
        "position int, rule_id string, title string, explanation string, severity string, severity_rank int, scope string, "
        "fingerprint string, conditions array<string>",
    )


# --- the frame that rules look at


def retries(calls: DataFrame) -> DataFrame:
    """tool_use_id of calls that went through after a like one was refused in the session: same tool, refused at the same
    time or before, and one summary a prefix of the other with LEAST_PREFIX characters or more. Those characters are then
    equal, which makes them a join key: a session with many refusals is not compared pair by pair."""
    head = F.left("input_summary", F.lit(LEAST_PREFIX))
    long = calls.filter(F.char_length("input_summary") >= LEAST_PREFIX)
    refused = long.filter(F.col("decision") == "reject").select(
        "session_id", "tool_name", head.alias("head"), F.col("tool_use_id").alias("r_id"), F.col("called_at").alias("r_at"), F.col("input_summary").alias("r_summary")
    )
    ran = long.filter(~F.col("decision").eqNullSafe("reject")).select(
        "session_id", "tool_name", head.alias("head"), "tool_use_id", "called_at", "input_summary"
    )
    like = F.startswith("input_summary", "r_summary") | F.startswith("r_summary", "input_summary")
    found = ran.join(
        refused,
        (ran["session_id"] == refused["session_id"])
        & (ran["tool_name"] == refused["tool_name"])
        & (ran["head"] == refused["head"])
        & (F.col("r_at") <= F.col("called_at"))
        & (F.col("r_id") != F.col("tool_use_id"))
        & like,
        "left_semi",
    )
    return found.select("tool_use_id").distinct()


def enriched(calls: DataFrame, sessions: DataFrame, changes: DataFrame) -> DataFrame:
    """Calls with session_cwd, project_path (and git_branch if the sessions have it), mode_changed, is_first_in_session and is_retry. First calls come from a
    grouped minimum that is combined before the shuffle, so a session with very many calls is no window partition."""
    s = sessions.select("session_id", F.col("cwd").alias("session_cwd"), "project_path", *[c for c in ("git_branch",) if c in sessions.columns])
    changed = changes.filter("from_mode IS NOT NULL").select("session_id").distinct().withColumn("mode_changed", F.lit(True))
    first = (
        calls.filter("session_id IS NOT NULL")
        .groupBy("session_id")
        .agg(F.min(F.struct("called_at", "row_seq"))["row_seq"].alias("first_seq"))
    )
    retry = retries(calls).withColumn("is_retry", F.lit(True))
    facts = s.join(changed, "session_id", "full").join(first, "session_id", "full")
    return (
        calls.join(facts, "session_id", "left")
        .join(retry, "tool_use_id", "left")
        .withColumn("mode_changed", F.coalesce("mode_changed", F.lit(False)))
        .withColumn("is_retry", F.coalesce("is_retry", F.lit(False)))
        .withColumn("is_first_in_session", F.coalesce(F.col("row_seq") == F.col("first_seq"), F.lit(False)))
        .drop("first_seq")
    )


def matched_rules(frame: DataFrame, rules: list[Rule], dismissed: set[str] = frozenset()) -> DataFrame:
    """Adds ``rule_ids`` (those of live rules that match, in the rules' order), ``severity`` (the worst, or null) and
    ``titles`` (by severity, then title)."""
    live = [r for r in rules if r.id not in dismissed]
    worst = lambda r: -SEVERITIES.index(r.severity)
    ids = F.array_compact(F.array(*[F.when(compile_rule(r), F.lit(r.id)) for r in live])) if live else F.array().cast("array<string>")
    out = frame.withColumn("rule_ids", ids)
    has = lambda r: F.array_contains("rule_ids", r.id)
    by = sorted(live, key=lambda r: (worst(r), r.title))
    severity = F.coalesce(*[F.when(has(r), F.lit(r.severity)) for r in by], F.lit(None).cast("string"))
    titles = F.array_compact(F.array(*[F.when(has(r), F.lit(r.title)) for r in by])) if by else F.array().cast("array<string>")
    return out.withColumn("severity", severity).withColumn("titles", titles)


def matches(frame: DataFrame, tool_use_id: str, rule: Rule) -> bool:
    """Whether one rule matches one call."""
    return not frame.filter(F.col("tool_use_id") == tool_use_id).filter(compile_rule(rule)).isEmpty()


def rule_calls(frame: DataFrame, rule: Rule, limit: int = 100, offset: int = 0) -> DataFrame:
    """A rule's calls, newest first."""
    found = frame.filter(compile_rule(rule))
    return found.orderBy(F.desc_nulls_last("called_at"), F.desc("row_seq")).offset(offset).limit(limit)


# --- rollups


def rule_project_rollup(matched: DataFrame) -> DataFrame:
    """(rule_id, project_path): calls, sessions, first and last time. One grouping for all rules."""
    return (
        matched.select("tool_use_id", "session_id", "project_path", "called_at", F.explode("rule_ids").alias("rule_id"))
        .groupBy("rule_id", "project_path")
        .agg(
            F.count("*").alias("calls"),
            F.count_distinct("session_id").alias("sessions"),
            F.min("called_at").alias("first_at"),
            F.max("called_at").alias("last_at"),
        )
    )


def evaluate(matched: DataFrame, rules: list[Rule], dismissed: set[str] = frozenset()) -> DataFrame:
    """A finding for every rule, also without a match; by severity, then calls (both descending), then id. ``matched``
    comes from matched_rules() over all rules, dismissed ones too."""
    rolled = (
        rule_project_rollup(matched)
        .groupBy("rule_id")
        .agg(
            F.sum("calls").alias("calls"),
            F.sum("sessions").alias("sessions"),
            F.min("first_at").alias("first_at"),
            F.max("last_at").alias("last_at"),
            F.sum(F.when(F.col("project_path").isNull(), F.col("calls")).otherwise(0)).alias("unattributed"),
            F.sum(F.when(F.col("project_path").isNotNull(), 1).otherwise(0)).alias("projects"),
        )
    )
    frame = rules_frame(matched.sparkSession, rules)
    zero = {k: 0 for k in ("calls", "sessions", "unattributed", "projects")}
    return (
        frame.join(rolled, "rule_id", "left")
        .fillna(zero)
        .withColumn("dismissed", F.col("rule_id").isin(*dismissed) if dismissed else F.lit(False))
        .orderBy(F.desc("severity_rank"), F.desc("calls"), "rule_id")
    )


def posture(matched: DataFrame, rules: list[Rule], dismissed: set[str] = frozenset()) -> DataFrame:
    """project x severity: distinct calls that some live rule of the severity matches, the project's rules, worst first
    (unattributed last). A row is a call, so counting rows counts calls once."""
    live = {x: [r.id for r in rules if r.severity == x and r.id not in dismissed] for x in SEVERITIES}
    listed = lambda ids: F.array(*map(F.lit, ids)) if ids else F.array().cast("array<string>")
    any_of = lambda ids: F.arrays_overlap("rule_ids", listed(ids)) if ids else F.lit(False)
    known = [i for ids in live.values() for i in ids]
    # One grouping: a project's sets of rules are few, and their union is bounded by the number of rules.
    sets = F.collect_set(F.array_intersect("rule_ids", listed(known)))
    out = matched.groupBy("project_path").agg(
        *[F.count_if(any_of(live[s])).alias(s) for s in SEVERITIES], F.array_sort(F.array_distinct(F.flatten(sets))).alias("project_rules")
    )
    out = out.filter(F.size("project_rules") > 0)
    by = [F.desc(s) for s in reversed(SEVERITIES)]
    return out.orderBy(*by, F.col("project_path").isNull(), "project_path")


def severity_totals(matched: DataFrame, rules: list[Rule], dismissed: set[str] = frozenset()) -> DataFrame:
    """Distinct calls by severity, the column sums of posture(): severities overlap, so there is no grand total."""
    live = {x: [r.id for r in rules if r.severity == x and r.id not in dismissed] for x in SEVERITIES}
    any_of = lambda ids: F.arrays_overlap("rule_ids", F.array(*map(F.lit, ids))) if ids else F.lit(False)
    return matched.agg(*[F.count_if(any_of(live[s])).alias(s) for s in SEVERITIES])


# --- ledgers


def new_sightings(matched: DataFrame, rules: list[Rule], ledger: DataFrame, now: int, dismissed: set[str] = frozenset()) -> DataFrame:
    """Rows to append to the sightings ledger: live matches that aren't in it under the rule's present fingerprint."""
    frame = rules_frame(matched.sparkSession, [r for r in rules if r.id not in dismissed]).select("rule_id", "fingerprint")
    seen = matched.select("tool_use_id", F.explode("rule_ids").alias("rule_id")).join(F.broadcast(frame), "rule_id")
    fresh = seen.join(ledger, ["rule_id", "fingerprint", "tool_use_id"], "left_anti")
    return fresh.select("rule_id", "fingerprint", "tool_use_id", F.lit(now).cast("long").alias("first_seen"))


def adopted(ledger: DataFrame, rules: list[Rule]) -> DataFrame:
    """The ledger with the fingerprint of today's rule in rows that were written without one."""
    frame = rules_frame(ledger.sparkSession, rules).select("rule_id", F.col("fingerprint").alias("fp"))
    joined = ledger.join(F.broadcast(frame), "rule_id", "left")
    fp = F.when(F.col("fingerprint") == "", F.coalesce("fp", "fingerprint")).otherwise(F.col("fingerprint"))
    return joined.select("rule_id", fp.alias("fingerprint"), "tool_use_id", "first_seen").groupBy("rule_id", "fingerprint", "tool_use_id").agg(F.min("first_seen").alias("first_seen"))


def first_sightings(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("rule_id", "fingerprint").agg(F.min("first_seen").alias("first_seen"), F.count("*").alias("calls"))


def ever_reviewed(ledger: DataFrame) -> bool:
    return not ledger.isEmpty()


def live_dismissals(ledger: DataFrame) -> DataFrame:
    """The latest row of each rule, without those that restore it. Dismissing and restoring append rows."""
    latest = ledger.groupBy("rule_id").agg(F.max_by(F.struct("note", "at", "restored"), "at").alias("x"))
    return latest.filter("NOT x.restored").select("rule_id", "x.note", "x.at")


def dismissed_ids(ledger: DataFrame) -> set[str]:
    """For the driver: as many ids as there are rules."""
    return {r["rule_id"] for r in live_dismissals(ledger).collect()}


def alerts(calls: DataFrame, rules: list[Rule]) -> DataFrame:
    """What to notify about: a refusal first, else the first high rule that matches."""
    high = [r for r in rules if r.severity == "high"]
    title = F.coalesce(*[F.when(F.array_contains("rule_ids", r.id), F.lit(r.title)) for r in high], F.lit(None).cast("string"))
    text = F.when(F.col("decision") == "reject", F.lit("refused")).otherwise(title)
    return calls.withColumn("alert", text).filter("alert IS NOT NULL").select("tool_use_id", "session_id", "tool_name", "input_summary", "called_at", "alert")
