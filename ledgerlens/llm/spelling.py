"""Spelling variants: words at one edit from a much more frequent word, found through a reduced alphabet.

Letters are hashed to a few symbols. For each word the whole one-edit neighbourhood of its reduced form (the form itself,
and each deletion, replacement and insertion over the symbols) meets the reduced vocabulary in one equi-join; two words at
one edit always meet, since an edit of letters is an edit of symbols or none. What meets is verified on the words themselves.

A reduced form is a sum of one 64-bit number for each place and symbol, so a neighbour's form comes from sums over the
parts before and after the edit. Equal sums of different forms only add candidates. Neighbours that are no word's form, which most
are, go by a bitmap of the vocabulary's forms before they are shuffled. Forms that very many words share
are met in a second join, over an alphabet in which every letter is its own symbol.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_checked, materialize, text_batches

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Every so manieth occurrence by hash loses a code point.
ODDITY = 97
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
SYMBOLS = 16
#: Words of one reduced form from which they are met letter by letter.
CROWD = 512
#: Counts that a task holds before it hands them on, and symbols of words that it takes at once.
HELD_WORDS, HELD_SYMBOLS = 200_000, 1 << 16
#: Bits of a filter of forms are two to this power at most (32 MB).
MOST_BITS = 28
LETTERS = [chr(c) for c in (*range(0x61, 0x7B), *range(0x41, 0x5B), *range(0xC0, 0x100))]


def occurrences(doc_id: int | None, text: str | None) -> Iterator[tuple[str, int]]:
    """The text's words with their counts; a run whose hash with the id is a multiple of ODDITY lacks one code point."""
    if not text:
        return
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # lower() of bytes is A-Z only
    head = b"" if doc_id is None else str(doc_id).encode()
    for run, n in Counter(RUN.findall(low)).items():
        h = zlib.crc32(head + b":" + run.encode())
        if not h % ODDITY:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for word, n in occurrences(doc_id, text):
                if len(word) >= LEAST_LENGTH:
                    held[word] += n
            if len(held) > HELD_WORDS:
                yield out()
                held.clear()
    if held:
        yield out()


def vocabulary(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, n) of all texts, counted in each task before the shuffle."""
    text_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("text <> ''")
    return texts.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(f"n >= {LEAST_COUNT}")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _values(place: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The number of each symbol at its place."""
    return _mix(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + symbol.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))


def reduced(words: np.ndarray, symbols: int) -> np.ndarray:
    """words: rows of code points -> rows of symbols; with 0 symbols each code point stays."""
    return _mix(words.astype(np.uint64) + np.uint64(0x5BD1E995)) % np.uint64(symbols) if symbols else words.astype(np.uint64)


def alphabet(symbols: int) -> np.ndarray:
    return np.arange(symbols, dtype=np.uint64) if symbols else np.array([ord(c) for c in LETTERS], np.uint64)


def form(rows: np.ndarray) -> np.ndarray:
    return _values(np.arange(rows.shape[1])[None, :], rows).sum(1, dtype=np.uint64)


def neighbourhood(rows: np.ndarray, signs: np.ndarray) -> Iterator[np.ndarray]:
    """rows (words x length) of symbols -> arrays (words x some) of the forms within one edit of each row."""
    n, size = rows.shape
    place = np.arange(size)[None, :]
    zero = np.zeros((n, 1), np.uint64)
    here = _values(place, rows)
    before = np.concatenate((zero, np.cumsum(here, 1, dtype=np.uint64)), 1)
    after = lambda shift: np.concatenate((np.cumsum(_values(place + shift, rows)[:, ::-1], 1, dtype=np.uint64)[:, ::-1], zero), 1)
    left, right = after(-1), after(1)
    whole = before[:, -1:]
    yield np.concatenate((whole, before[:, :-1] + left[:, 1:]), 1)
    for s in signs:
        at = _values(np.arange(size + 1)[None, :], np.array([[s]]))
        yield np.concatenate((whole - here + at[:, :-1], before + at + right), 1)


class Filter:
    """A bitmap of the forms that some words have: a form that is not in it is nobody's. Of a size that is bounded, whatever
    the number of words: beyond it more forms pass in vain."""

    def __init__(self, own: DataFrame, most_bits: int = MOST_BITS) -> None:
        """own(form): a written table. What comes to the driver is at most the bitmap."""
        self.bits = min(max(own.count() * 64, 1 << 16).bit_length(), most_bits)
        top = F.shiftrightunsigned("form", 64 - self.bits)
        slots = own.groupBy(F.shiftrightunsigned(top, 6).alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), top.bitwiseAND(63).cast("int"))).alias("set"))
        found = slots.toArrow()
        self.words = np.zeros(1 << (self.bits - 6), np.uint64)
        self.words[found.column("slot").to_numpy()] = found.column("set").to_numpy().view(np.uint64)

    def __call__(self, forms: np.ndarray) -> np.ndarray:
        top = forms >> np.uint64(64 - self.bits)
        return (self.words[top >> np.uint64(6)] >> (top & np.uint64(63))) & np.uint64(1) > 0


def _by_length(batches: Iterator[pa.RecordBatch], symbols: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """(words, rows of symbols): words of one length together, about HELD_SYMBOLS symbols at once."""
    held: dict[int, list[str]] = {}

    def out(size: int) -> tuple[list[str], np.ndarray]:
        words = held.pop(size)
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        return words, reduced(points.reshape(len(words), size), symbols)

    for b in batches:
        for word in b.column("word").to_pylist():
            words = held.setdefault(len(word), [])
            words.append(word)
            if len(words) * len(word) > HELD_SYMBOLS:
                yield out(len(word))
    for size in list(held):
        yield out(size)


def _own(batches: Iterator[pa.RecordBatch], symbols: int) -> Iterator[pa.RecordBatch]:
    """word -> (form, word)."""
    for words, rows in _by_length(batches, symbols):
        yield pa.RecordBatch.from_arrays([pa.array(form(rows).view(np.int64)), pa.array(words)], ["form", "word"])


def _around(batches: Iterator[pa.RecordBatch], symbols: int, taken: Filter) -> Iterator[pa.RecordBatch]:
    """word -> (form, word): the forms within one edit that somebody may have, each once."""
    for words, rows in _by_length(batches, symbols):
        met = []
        for forms in neighbourhood(rows, alphabet(symbols)):
            row, column = np.nonzero(taken(forms))
            met.append(np.stack((forms[row, column], row.astype(np.uint64))))
        pairs = np.concatenate(met, 1)
        pairs = pairs[:, np.lexsort(pairs)]
        new = np.ones(pairs.shape[1], bool)
        new[1:] = (pairs[:, 1:] != pairs[:, :-1]).any(0)
        forms, row = pairs[:, new]
        yield pa.RecordBatch.from_arrays([pa.array(forms.view(np.int64)), pa.array(words).take(pa.array(row))], ["form", "word"])


def near_words(words: DataFrame, symbols: int = SYMBOLS, crowd: int = CROWD) -> DataFrame:
    """words(word, ...): a written table -> (a, b): words at exactly one edit, both ways round."""
    pick = words.select("word")
    row = "form long, word string"
    own = materialize(pick.mapInArrow(partial(_own, symbols=symbols), row), "op11-forms")
    busy = materialize(own.groupBy("form").count().filter(F.col("count") > crowd).select("form"), "op11-busy")
    around = pick.mapInArrow(partial(_around, symbols=symbols, taken=Filter(own)), row)

    def met(sources: DataFrame, targets: DataFrame) -> DataFrame:
        """Pairs of one form are verified where they meet, and only the near ones move on."""
        long, other = F.char_length("a"), F.char_length("b")
        # The rest after the first difference must agree; for short words Spark's own distance is as good and faster.
        differ = F.zip_with(F.split("a", ""), F.split("b", ""), lambda x, y: ~x.eqNullSafe(y))
        at = F.array_position(differ, True).cast("int")
        rest = lambda c, skip: F.substr(F.col(c), at + skip)
        linear = (at > 0) & (rest("a", (long >= other).cast("int")) == rest("b", (other >= long).cast("int")))
        near = (F.abs(long - other) <= 1) & F.when(long <= 64, F.levenshtein("a", "b", 1) == 1).otherwise(linear)
        return sources.toDF("form", "a").join(targets.toDF("form", "b").hint("shuffle_hash"), "form").filter(near).select("a", "b")

    if busy.isEmpty():
        return met(around, own).distinct()
    around = materialize(around, "op11-around")
    pairs = met(around, join_checked(own, busy, ["form"], "left_anti", "op11-busy"))
    # Words in or next to a busy form, letter by letter: a form is then shared by equal words only.
    inside = join_checked(own, busy, ["form"], "left_semi", "op11-busy").select("word")
    beside = join_checked(around, busy, ["form"], "left_semi", "op11-busy").select("word").distinct()
    exact = materialize(inside.mapInArrow(partial(_own, symbols=0), row), "op11-letters")
    return pairs.union(met(beside.mapInArrow(partial(_around, symbols=0, taken=Filter(exact)), row), exact)).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """forms(word, form) -> (word, root): each word with a form, and the end of its chain. A chain is followed in doubling
    steps; its counts at least double from word to word, so six steps end any chain of counts that fit a long."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "op11-roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = materialize(join_checked(at, on, ["root"], "left", "op11-next"), "op11-roots")
        if at.filter("next IS NOT NULL").isEmpty():
            return at.select("word", "root")
        at = at.select("word", F.coalesce("next", "root").alias("root"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", symbols: int = SYMBOLS, crowd: int = CROWD) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row for each word of LEAST_LENGTH code points and LEAST_COUNT occurrences.

    Words are the runs of letters (a-z, A-Z, and U+00C0 to U+00FF as they are, signs among them included) with A-Z
    lower-cased; a run whose CRC-32 with its document's id is a multiple of ODDITY loses one code point first (a null id counts as
    an empty one). A word's form is its near word of the largest count, the first in code-point order of equals, if that is RATIO
    times its own; else null. Null and empty texts have no words; repeated rows count each time; words of any
    length take part; other columns are ignored; an empty table gives no rows.
    """
    words = materialize(vocabulary(docs, id_col, text_col), "op11-words")
    pairs = near_words(words, symbols, crowd)
    best = F.min_by(F.struct("word", "n"), F.struct((-F.col("n")).alias("less"), F.col("word"))).alias("top")
    near = pairs.join(words.withColumnRenamed("word", "b"), "b").select("a", F.col("b").alias("word"), "n")
    near = near.groupBy("a").agg(F.count("*").alias("n_near"), best)
    rows = words.join(near.withColumnRenamed("a", "word"), "word", "left")
    good = F.col("top.n") >= RATIO * F.col("n")
    rows = materialize(
        rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                    F.when(good, F.col("top.word")).alias("form"), F.when(good, F.col("top.n")).alias("form_n")),
        "op11-near",
    )
    ends = roots(rows.filter("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
