"""Redaction of secrets: patterns as data, applied in one pass over the original text."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from importlib import resources

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..staging import materialize, text_batches

#: Characters of a text shown on each side of a hit.
AROUND = 100
_MARKER = re.compile(r"\[redacted: [a-z0-9-]+\]")


#: Letters that match i, s and k where a pattern ignores case, and that lower() does not turn into those.
_FOLDED, _PLAIN = "\u0131\u0130\u017f\u212a", "iisk"
_UNFOLD = str.maketrans(_FOLDED, _PLAIN)


@dataclass(frozen=True)
class Pattern:
    """``needs``: strings of which each match contains one (in small letters if the pattern ignores case). Texts without any
    are passed over by a look that needs no regular expression; empty means that every text is searched."""

    id: str
    regex: str
    title: str = ""
    group: int = 0
    needs: tuple[str, ...] = ()


def load_patterns(user_toml: str | None = None) -> tuple[list[Pattern], list[str]]:
    """(patterns, ids of those that don't compile, which are left out); a user's pattern replaces the one of its id."""
    texts = (resources.files(__package__).joinpath("redact.toml").read_text(), user_toml or "")
    found = [p for text in texts for p in tomllib.loads(text).get("pattern", [])]
    rows = {p["id"]: Pattern(**{**p, "needs": tuple(p.get("needs", ()))}) for p in found}
    good, bad = [], []
    for p in rows.values():
        try:
            re.compile(p.regex)
            good.append(p)
        except re.error:
            bad.append(p.id)
    return good, bad


class Redactor:
    """Spans of earlier patterns are theirs; markers of an earlier pass stay as they are, so redacting twice is redacting
    once."""

    def __init__(self, patterns: list[Pattern]):
        self.patterns = [(p.id, re.compile(p.regex), p.group, p.needs) for p in patterns]

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        taken = [(m.start(), m.end(), "") for m in _MARKER.finditer(text)]
        low = None
        for id_, regex, group, needs in self.patterns:
            # A look for the strings that a match contains is much faster than the pattern.
            folds = needs and regex.flags & re.IGNORECASE
            if folds and low is None:
                low = text.translate(_UNFOLD).lower()
            if needs and not any(x in (low if folds else text) for x in needs):
                continue
            for m in regex.finditer(text):
                s, e = m.span(group) if group <= regex.groups and m.start(group) >= 0 else m.span()
                if not any(s < te and ts < e for ts, te, _ in taken):
                    taken.append((s, e, id_))
        return sorted(t for t in taken if t[2])

    def text(self, text: str) -> str:
        out, at = [], 0
        for s, e, id_ in self.spans(text):
            out += [text[at:s], f"[redacted: {id_}]"]
            at = e
        return "".join([*out, text[at:]])

    def values(self, value: object) -> object:
        """Every string in a JSON value; keys stay."""
        if isinstance(value, str):
            return self.text(value)
        if isinstance(value, list):
            return [self.values(v) for v in value]
        if isinstance(value, dict):
            return {k: self.values(v) for k, v in value.items()}
        return value

    def json(self, text: str) -> str:
        try:
            value = json.loads(text)
        except ValueError:
            return self.text(text)
        return json.dumps(self.values(value), ensure_ascii=False, separators=(",", ":"))


def _udf(apply: Callable[[str], str]) -> Callable[[Column], Column]:
    text_batches(SparkSession.active())

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else apply(t))

    return run


def may_match(text: Column, patterns: list[Pattern]) -> Column:
    """False only where no pattern matches: none of the strings that the patterns need is in the text."""
    if not all(p.needs for p in patterns):
        return F.lit(True)
    folds = {p.id: bool(re.compile(p.regex).flags & re.IGNORECASE) for p in patterns}
    plain = sorted({x for p in patterns if not folds[p.id] for x in p.needs})
    folded = sorted({x for p in patterns if folds[p.id] for x in p.needs})
    low = F.lower(F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.translate(text, _FOLDED, _PLAIN)))
    tests = [text.contains(x) for x in plain]
    if folded:
        # A lambda's variable holds the small letters: a filter would make them anew for each string.
        tests.append(F.exists(F.array(low), lambda t: reduce(Column.__or__, [t.contains(x) for x in folded])))
    return reduce(Column.__or__, tests, F.lit(False))


def redacted(text: Column, patterns: list[Pattern]) -> Column:
    """Only texts that may match leave the JVM; the others are themselves."""
    return F.coalesce(_udf(Redactor(patterns).text)(F.when(may_match(text, patterns), text)), text)


def redacted_json(text: Column, patterns: list[Pattern]) -> Column:
    return _udf(Redactor(patterns).json)(text)


def redaction_report(frame: DataFrame, columns: tuple[str, ...], patterns: list[Pattern], examples: int = 4) -> DataFrame:
    """(field, pattern, rows, examples): rows that would change, with the least few of the places: the pattern's first span in
    a text, with up to AROUND characters before and after."""
    redactor = Redactor(patterns)

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for f, t in zip(pdf["field"], pdf["text"], strict=True):
                first = {i: (s, e) for s, e, i in reversed(redactor.spans(t))}
                rows += [(f, i, t[max(0, s - AROUND) : e + AROUND]) for i, (s, e) in sorted(first.items())]
            yield pd.DataFrame(rows, columns=["field", "pattern", "text"])

    long = frame.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in columns])).alias("x"))
    texts = long.select("x.field", "x.text").filter("text IS NOT NULL").filter(may_match(F.col("text"), patterns))
    # The texts are searched once: what was found is small, and is read twice.
    text_batches(frame.sparkSession)
    found = materialize(texts.mapInPandas(hits, "field string, pattern string, text string"), "redaction-hits")
    # A grouped count, and a top-k of each group that keeps k rows on the map side too.
    counted = found.groupBy("field", "pattern").agg(F.count("*").alias("rows"))
    distinct = found.select("field", "pattern", "text").distinct()
    ranked = distinct.withColumn("n", F.row_number().over(W.partitionBy("field", "pattern").orderBy("text"))).filter(F.col("n") <= examples)
    shown = ranked.groupBy("field", "pattern").agg(F.array_sort(F.collect_list("text")).alias("examples"))
    return counted.join(shown, ["field", "pattern"]).orderBy("field", F.desc("rows"), "pattern")
