"""One filter specification for pages, counts and histograms."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import search
from .rules import Rule, compile_rule

_SPANS = {"m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}
_COMPARE = {">=": Column.__ge__, ">": Column.__gt__, "<=": Column.__le__, "<": Column.__lt__, "=": Column.__eq__}
LANES = {"transcript": 1, "otlp": 2, "both": 3}


def relative_time(text: str, now: int) -> int:
    """``30m``, ``24h``, ``7d`` or ``2w`` before ``now``, in epoch milliseconds."""
    found = re.fullmatch(r"(\d+)([mhdw])", text.strip())
    if not found:
        raise ValueError(f"not a length of time: {text!r}")
    return now - int(found[1]) * _SPANS[found[2]]


def score_condition(text: str) -> Column:
    """``>=4``, ``<2``, ``=3`` or ``3`` over the column ``score``."""
    found = re.fullmatch(r"\s*(>=|<=|>|<|=)?\s*([1-5])\s*", text)
    if not found:
        raise ValueError(f"not a comparison with a score from 1 to 5: {text!r}")
    return _COMPARE[found[1] or "="](F.col("score"), F.lit(int(found[2])))


@dataclass(frozen=True)
class CallFilter:
    session_id: str | None = None
    session_unknown: bool = False
    project_path: str | None = None
    tool_name: str | None = None
    decision: str | None = None
    decision_source: str | None = None
    permission_mode: str | None = None
    agent_id: str | None = None
    success: bool | None = None
    is_sidechain: bool | None = None
    main_thread: bool | None = None
    provenance: int | None = None
    since: int | None = None
    until: int | None = None
    text: str | None = None
    severity: str | None = None
    rule_id: str | None = None
    intent: str | None = None
    score: str | None = None

    @classmethod
    def outcome(cls, word: str, **more) -> CallFilter:
        """``ok``, ``failed`` or ``refused``."""
        set_ = {"ok": {"success": True}, "failed": {"success": False}, "refused": {"decision": "reject"}}
        if word not in set_:
            raise ValueError(f"unknown outcome: {word!r}")
        return cls(**set_[word], **more)


@dataclass(frozen=True)
class Lens:
    """A filter with what its rule and verdict parts refer to."""

    filter: CallFilter = field(default_factory=CallFilter)
    rules: tuple[Rule, ...] | None = None
    dismissed: frozenset[str] = frozenset()
    verdicts: DataFrame | None = None
    model_fp: str | None = None
    prompt_fp: str | None = None

    def pair(self) -> DataFrame:
        if self.verdicts is None or self.model_fp is None or self.prompt_fp is None:
            raise ValueError("a filter on verdicts takes the verdicts, a model and a prompt")
        return self.verdicts.filter((F.col("model_fp") == self.model_fp) & (F.col("prompt_fp") == self.prompt_fp))


def matching(frame: DataFrame, lens: Lens | CallFilter) -> DataFrame:
    """The rows of an enriched() frame that the filter lets through. Plain predicates reach the scan; verdicts are semi-
    joined, so a second verdict can't repeat a call."""
    lens = Lens(lens) if isinstance(lens, CallFilter) else lens
    f, out = lens.filter, frame
    for name in ("session_id", "project_path", "tool_name", "decision", "decision_source", "permission_mode", "agent_id", "success", "is_sidechain", "provenance"):
        if (value := getattr(f, name)) is not None:
            out = out.filter(F.col(name) == value)
    if f.session_unknown:
        out = out.filter("session_id IS NULL")
    if f.main_thread is not None:
        out = out.filter("agent_id IS NULL" if f.main_thread else "agent_id IS NOT NULL")
    if f.since is not None:
        out = out.filter(F.col("called_at") >= f.since)
    if f.until is not None:
        out = out.filter(F.col("called_at") <= f.until)
    if f.text and (condition := search.condition(f.text, search.CALL_FIELDS)) is not None:
        out = out.filter(condition)
    if f.severity is not None or f.rule_id is not None:
        if lens.rules is None:
            raise ValueError("a filter on findings takes the rules")
        live = [r for r in lens.rules if r.id not in lens.dismissed]
        for some in ([r for r in live if r.severity == f.severity] if f.severity else None, [r for r in live if r.id == f.rule_id] if f.rule_id else None):
            if some is not None:
                hit = F.lit(False)
                for r in some:
                    hit = hit | compile_rule(r)
                out = out.filter(hit)
    if f.intent and (condition := search.condition(f.intent, ("summary",))) is not None:
        out = out.join(lens.pair().filter(condition).select("tool_use_id"), "tool_use_id", "left_semi")
    if f.score is not None:
        condition = score_condition(f.score)
        out = out.join(lens.pair().filter("status = 'ok'").filter(condition).select("tool_use_id"), "tool_use_id", "left_semi")
    return out


def page(frame: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first; calls without a time last."""
    return frame.orderBy(F.desc_nulls_last("called_at"), F.desc("row_seq")).offset(offset).limit(limit)


def page_after(frame: DataFrame, called_at: int, row_seq: int, limit: int = 100) -> DataFrame:
    """The page after a given row: no rows are skipped over, however deep it is."""
    older = (F.col("called_at") < called_at) | ((F.col("called_at") == called_at) & (F.col("row_seq") < row_seq)) | F.col("called_at").isNull()
    return page(frame.filter(older), limit)


def by_ids(frame: DataFrame, ids: DataFrame) -> DataFrame:
    return frame.join(ids.select("tool_use_id"), "tool_use_id", "left_semi")
