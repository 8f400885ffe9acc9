"""Literal full-text search: AND of terms, each a phrase within one field, the last one a prefix."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import text_batches

CALL_FIELDS = ("tool_name", "input_summary", "target_path", "result_text")
MARK_OPEN, MARK_CLOSE, MORE = "\x01", "\x02", "…"
#: Letters beyond those that folded_native() folds as fold_text() does.
_NOT_NATIVE = r"[^\u0000-\u00ff\u2010-\u205e]"
_WORD = r"[\p{L}\p{N}\p{Co}]+"


def fold_text(text: str) -> str:
    plain = unicodedata.normalize("NFD", text.lower())
    return "".join(c for c in plain if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def _fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else fold_text(t))


def folded(text: Column) -> Column:
    """Case and diacritics folded. A UDF is evaluated for every row, so texts of ASCII, Latin-1 and general punctuation, the usual,
    go to it as nulls."""
    text_batches(SparkSession.active())
    ascii_only = F.octet_length(text) == F.char_length(text)
    other = ~ascii_only & text.rlike(_NOT_NATIVE)
    native = F.when(ascii_only, F.lower(text)).when(~other, folded_native(text))
    return F.when(other, _fold(F.when(other, text))).otherwise(native)


def token_text(text: Column, fold: bool = True) -> Column:
    """`` a b c ``: the tokens between single spaces, for phrase tests by substring."""
    base = folded(text) if fold else F.lower(text)
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(base, F.lit(_WORD), F.lit(0)), " "), F.lit(" "))


def terms(query: str) -> list[list[str]]:
    """Tokens of each term; terms without any are dropped."""
    found = (re.findall(r"[^\W_]+", fold_text(t)) for t in query.split())
    return [t for t in found if t]


def condition(query: str, fields: tuple[str, ...], fold: bool = True) -> Column | None:
    """The search as a Column, or None for a query without terms (no filter)."""
    wanted = terms(query)
    if not wanted:
        return None
    last = len(wanted) - 1
    needles = [f" {' '.join(t)}{'' if k == last else ' '}" for k, t in enumerate(wanted)]
    # One text of all fields: a line end between them, which no needle holds, keeps phrases within a field.
    text = F.concat_ws("\n", *[token_text(F.col(f), fold) for f in fields])
    return reduce(Column.__and__, (text.contains(n) for n in needles))


def snippet(text: Column, query: str, around: int = 5) -> Column:
    """Tokens around the first match, the matching ones marked; null without a match."""
    wanted = [w for t in terms(query) for w in t]
    if not wanted:
        return F.lit(None).cast("string")
    tokens = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    pattern = "^(?:" + "|".join([*wanted[:-1], wanted[-1] + ".*"]) + ")$"
    hit = lambda x: F.lower(x).rlike(pattern)
    flags = F.transform(tokens, hit)
    first = F.array_position(flags, True)
    begin = F.greatest(first - around, F.lit(1))
    marked = F.transform(F.slice(tokens, begin.cast("int"), 2 * around + 1), lambda x: F.when(hit(x), F.concat(F.lit(MARK_OPEN), x, F.lit(MARK_CLOSE))).otherwise(x))
    body = F.concat(F.when(begin > 1, MORE).otherwise(""), F.array_join(marked, " "), F.when(begin + 2 * around < F.size(tokens), MORE).otherwise(""))
    return F.when(first > 0, body)


#: Tokens of a fragment.
FRAGMENT = 10


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used: a lambda's variable holds it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def fragment(text: Column, query: str, width: int = FRAGMENT) -> Column:
    """The best ``width`` tokens of a text: those that hold most different terms, then most matching tokens, then the first;
    matching tokens are marked, and ``…`` stands where tokens are left out. Null without a match."""
    wanted = [w for t in terms(query) for w in t]
    if not wanted:
        return F.lit(None).cast("string")

    def term(low: Column) -> Column:
        found = F.when(low.startswith(wanted[-1]), len(wanted) - 1)
        for k in range(len(wanted) - 2, -1, -1):
            found = F.when(low == wanted[k], k).otherwise(found)
        return found

    def score(marks: Column, i: Column) -> Column:
        near = F.filter(F.transform(F.slice(marks, i + 1, F.lit(width)), lambda m: m["t"]), lambda t: t.isNotNull())
        return _once(near, lambda near: F.struct(F.size(F.array_distinct(near)).alias("d"), F.size(near).alias("n"), (-i).alias("i")))

    def shown(marks: Column, best: Column) -> Column:
        window = F.transform(F.slice(marks, best + 1, F.lit(width)), lambda m: F.when(m["t"].isNotNull(), F.concat(F.lit(MARK_OPEN), m["x"], F.lit(MARK_CLOSE))).otherwise(m["x"]))
        return F.concat(F.when(best > 0, MORE).otherwise(""), F.array_join(window, " "), F.when(best + width < F.size(marks), MORE).otherwise(""))

    def found(marks: Column) -> Column:
        # Only windows that begin at a match can be best: moving a window up to its first match loses nothing.
        spots = F.filter(F.transform(marks, lambda m, i: F.when(m["t"].isNotNull(), i)), lambda i: i.isNotNull())
        return _once(-F.array_max(F.transform(spots, lambda i: score(marks, i)))["i"], lambda best: F.when(best.isNotNull(), shown(marks, best)))

    tokens = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    marks = F.transform(tokens, lambda x: F.struct(x.alias("x"), _once(folded_native(x), term).alias("t")))
    return _once(marks, found)


#: Latin letters with marks and what they are without, in the same order.
_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_BARE = "aaaaaaceeeeiiiinooooouuuuyy"


def folded_native(text: Column) -> Column:
    """Case and the marks of Latin-1 letters folded without Python."""
    return F.translate(F.lower(text), _MARKED, _BARE)


def highlight(text: Column, query: str) -> Column:
    """Each term's literal occurrences marked, in either case."""
    words = sorted((re.escape(t) for t in query.split()), key=len, reverse=True)
    return F.regexp_replace(text, f"(?i)({'|'.join(words)})", f"{MARK_OPEN}$1{MARK_CLOSE}") if words else text


def inverted_index(frame: DataFrame, id_col: str = "tool_use_id", fields: tuple[str, ...] = CALL_FIELDS) -> DataFrame:
    """(token, field, id, pos): written bucketed by token, searches read only their terms."""
    each = [
        frame.select(F.col(id_col).alias("id"), F.lit(f).alias("field"), F.posexplode(F.regexp_extract_all(folded(F.col(f)), F.lit(_WORD), F.lit(0))).alias("pos", "token"))
        for f in fields
    ]
    return reduce(DataFrame.unionByName, each).select("token", "field", "id", "pos")


def search_index(index: DataFrame, query: str) -> DataFrame:
    """Distinct ids for the query: a phrase's tokens meet on (id, field, place - offset), terms on the id."""
    found = None
    wanted = terms(query)
    for k, tokens in enumerate(wanted):
        part = None
        for n, token in enumerate(tokens):
            prefix = k == len(wanted) - 1 and n == len(tokens) - 1
            test = F.startswith("token", F.lit(token)) if prefix else F.col("token") == token
            rows = index.filter(test)
            # The place matters within a phrase only: of a frequent word, ids are far fewer than places.
            rows = rows.select("id").distinct() if len(tokens) == 1 else rows.select("id", "field", (F.col("pos") - n).alias("at")).distinct()
            part = rows if part is None else part.join(rows, ["id", "field", "at"], "left_semi")
        ids = part.select("id").distinct()
        found = ids if found is None else found.join(ids, "id", "left_semi")
    return found if found is not None else index.select("id").limit(0)
