"""Secret scans.

Fixed patterns find the base spans. Two character Markov models, one of random strings and one of ordinary
identifiers, are trained from labelled samples; a long token that no base span touches is added where its log-likelihood
ratio for each transition is high enough.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

#: Fixed patterns. ASCII letters in either case for the first one's names.
ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

KINDS = ("assign", "access", "hex", "markov")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
WORD = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{6,}")
LEAST_TOKEN = 20
#: The models are trained on the tokens of about so many documents.
SAMPLE_DOCS = 20_000
#: Natural-log ratio for each transition from which a token counts as random. Chosen on planted tokens: identifiers joined
#: from the corpus's words stayed below 1.7, 97 % or more of random tokens lay above; other words can lie above too.
THRESHOLD = 2.0
BACK_OFF = 20.0
#: Shares of the back-off: a random string may use any character of its alphabet alike, an ordinary one may repeat one.
EVEN, REPEAT = 0.5, 0.2
#: An ordinary pair of small letters counts so much for the same pair in capitals: names are written in capitals too.
CAPITALS = 0.05
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1
_CODE = np.full(128, len(ALPHABET), np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) by start and kind; the span of a match is the whole match."""
    found = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(x in low for x in NAMES):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    # A run of 24 or more is the whole leftmost match of [0-9a-f]+, since a match starts where a run does.
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)] if _has_run(text) else []
    return sorted(found)


def _has_run(text: str) -> bool:
    return max(map(len, text.split()), default=0) >= LEAST_TOKEN


def transitions(token: str) -> np.ndarray:
    """Codes of a token's character pairs; the pair into its first character is from the end state."""
    code = _CODE[np.frombuffer(token.encode("ascii"), np.uint8)]
    return np.concatenate(([len(ALPHABET)], code[:-1])) * STATES + code


class Markov:
    """Log-likelihood ratios of character pairs, random over ordinary."""

    def __init__(self, random: np.ndarray, ordinary: np.ndarray):
        logs = []
        # Pairs back off to single characters, so a rare state says what its class says. The samples of random strings have
        # few alphabets (mostly hexadecimal): of the others the even share knows.
        others = (EVEN, np.full((STATES, STATES), 1 / STATES)), (REPEAT, np.eye(STATES))
        in_capitals = np.zeros((STATES, STATES))
        in_capitals[:26, :26] = CAPITALS * ordinary.reshape(STATES, STATES)[26:52, 26:52]
        for counts, (share, other) in zip((random, ordinary + in_capitals.ravel()), others, strict=True):
            pairs = counts.reshape(STATES, STATES)
            single = (pairs.sum(axis=0) + 0.5) / (pairs.sum() + 0.5 * STATES)
            back = (1 - share) * single + share * other
            logs.append(np.log((pairs + BACK_OFF * back) / (pairs.sum(axis=1, keepdims=True) + BACK_OFF)).ravel())
        self.trained = bool(random.sum() and ordinary.sum())
        self.ratio = logs[0] - logs[1]

    def score(self, token: str) -> float:
        return float(self.ratio[transitions(token)].mean())


def labelled_tokens(text: str) -> Iterator[tuple[bool, str]]:
    """(random, token): the values in base spans are the random strings, shorter tokens outside the ordinary ones. Long
    tokens outside are what is to be judged: they have no label."""
    base = base_spans(text)
    for start, kind, end in base:
        value = ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]
        yield True, "".join(c for c in value if c in ALPHABET)
    for m in WORD.finditer(text):
        if m.end() - m.start() < LEAST_TOKEN and not any(s < m.end() and m.start() < e for s, _, e in base):
            yield False, m[0]


def train(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Markov:
    """Counted by Spark over a sample of about ``sample_docs`` documents, picked by a hash of the text."""
    texts = docs.select(F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    n = texts.count()
    if n > sample_docs:
        texts = texts.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(sample_docs / n * (1 << 30)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, STATES * STATES), np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                for kind in (False, True):
                    own = [transitions(t) for is_random, t in labelled_tokens(text) if is_random is kind and t]
                    if own:
                        sums[int(kind)] += np.bincount(np.concatenate(own), minlength=STATES * STATES)
        kind, pair = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(pair), pa.array(sums[kind, pair])], ["kind", "pair", "n"])

    rows = texts.mapInArrow(count, "kind long, pair long, n long").groupBy("kind", "pair").agg(F.sum("n").alias("n"))
    sums = np.zeros((2, STATES * STATES))
    for r in rows.collect():  # two small tables
        sums[r["kind"], r["pair"]] = r["n"]
    return Markov(sums[1], sums[0])


def spans(text: str, model: Markov, threshold: float = THRESHOLD) -> list[Span]:
    base = base_spans(text)
    if not model.trained or not _has_run(text):
        return base
    more = []
    for m in TOKEN.finditer(text):
        free = not any(s < m.end() and m.start() < e for s, _, e in base)
        if free and model.score(m[0]) >= threshold:
            more.append((m.start(), 3, m.end()))
    return sorted(base + more)


def joined(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: Markov | None = None,
    threshold: float = THRESHOLD,
    sample_docs: int = SAMPLE_DOCS,
) -> DataFrame:
    """One row for each row of ``docs``: (id_col, n_assign, n_access, n_hex, base_sha256, n_markov, spans).

    Places count code points, ends are exclusive. A null text counts as empty; ids may be null or repeated (rows are judged
    one by one). Without a labelled sample of both classes only base spans are found. Other columns are ignored.
    """
    text_batches(docs.sparkSession)
    model = model or train(docs, text_col, sample_docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = base.select(
        F.col("id").alias(id_col),
        *[F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.lit("").alias("base_sha256"),
        F.lit(0).cast("long").alias("n_markov"),
        F.lit("").alias("spans"),
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in b.column(1).to_pylist():
                found = spans(text or "", shared.value, threshold)
                own = [x for x in found if x[1] < 3]
                for k in range(3):
                    out[k].append(sum(x[1] == k for x in own))
                out[3].append(hashlib.sha256(joined(own).encode()).hexdigest())
                out[4].append(len(found) - len(own))
                out[5].append(joined(found))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], schema.names
            )

    return base.mapInArrow(run, schema)
