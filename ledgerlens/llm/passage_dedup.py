"""Substring dedup over words: removes every word that a window of LENGTH words covers which also starts earlier.

The corpus is sharded by content: each window belongs to its least gram of GRAM words (by a hash, the leftmost of equals), and
neighbouring windows of one gram are a *run*. Equal windows so share a gram, wherever they are.

1. Runs are found in each text. Those whose gram occurs once are done. Equal runs, told by 128 bits of SHA-256, become one
   with its first place and the number of its copies, before anything is shuffled by gram.
2. The words of each different run are fetched, dealt by gram, and a shard of them gets an FM-index (``fm_index``). The
   runs are streamed through it by backward search; where a match reaches LENGTH words, the earliest suffix of its interval
   says whether the window starts earlier elsewhere.
3. The answers go back to all copies of each run; spans are merged by text and cut out.

A gram with very many different runs is dealt window by window, so no shard holds a common gram's runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_checked, join_groups, materialize, release, text_batches
from .fm_index import FMIndex

LENGTH, GRAM = 20, 4
#: Words whose runs are found at once, about; bits of a place among them.
PIECE, PLACE_BITS = 1 << 17, 20
#: Different runs of a gram from which it is dealt window by window.
HOT = 4096
#: Words of a shard, unless one gram has more.
SHARD = 1 << 16
NULL_ID = -(1 << 63)

Arrays = list[np.ndarray]


class _Hashes(dict):
    """Hashes of words, each computed once while the table stays small."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 19:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, 11)
        return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def runs_of(word: np.ndarray, cuts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the gram, first window, last window) of each run in a sequence of word hashes; windows cross no cut."""
    n = len(word) - length + 1
    if len(word) >> PLACE_BITS:
        raise ValueError("a piece is too long for its places")
    grams = word[: len(word) - gram + 1].copy()
    for k in range(1, gram):
        grams = _mix(grams) + word[k : len(word) - gram + 1 + k]
    grams = _mix(grams)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    wide, goal = 1, length - gram + 1
    while wide < goal:
        by = min(wide, goal - wide)
        least = np.minimum(least[:-by], least[by:])
        wide += by
    chosen = (least & low).astype(np.int64)
    inside = np.ones(n, bool)
    for c in cuts[1:-1].tolist():
        inside[max(0, c - length + 1) : c] = False
    new = np.ones(n, bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    keep = inside[first]
    return grams[chosen[first[keep]]], first[keep], last[keep]


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[bytes], list[int], list[int], list[int]]]:
    """(words, cuts, text numbers, offsets): short texts together, long ones in parts that overlap by a window."""
    words, cuts, who, at = [], [0], [], []
    for k, text in enumerate(texts):
        own = text.split()
        for off in range(0, len(own) - length + 1, PIECE):
            words += own[off : off + PIECE + length - 1]
            cuts.append(len(words))
            who.append(k)
            at.append(off)
            if len(words) >= PIECE:
                yield words, cuts, who, at
                words, cuts, who, at = [], [0], [], []
    if who:
        yield words, cuts, who, at


_RUN = "key long, r1 long, r2 long, id long, t long, start long, n int"


def _find(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """id, t, text -> runs: their gram, their digest, and their place in words."""
    known = _Hashes()
    for b in batches:
        ids, ts = b.column(0).to_numpy(), b.column(1).to_numpy()
        for words, cuts, who, at in _pieces(b.column(2).to_pylist(), length):
            hashed = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            cut = np.array(cuts)
            key, first, last = runs_of(hashed, cut, length, gram)
            body = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            begins = np.concatenate(([0], ends[:-1] + 1))
            spans = zip(begins[first].tolist(), ends[last + length - 1].tolist(), strict=True)
            sha = hashlib.sha256
            digest = np.frombuffer(b"".join([sha(body[a:z]).digest()[:16] for a, z in spans]), "<i8").reshape(-1, 2)
            spot = np.searchsorted(cut, first, side="right") - 1
            doc = np.array(who)[spot]
            start = first - cut[spot] + np.array(at)[spot]
            n = (last - first + 1).astype(np.int32)
            columns = [key.view(np.int64), digest[:, 0], digest[:, 1], ids[doc], ts[doc], start, n]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in _RUN.split(", ")])


_BODY = "key long, r1 long, r2 long, occ long, id long, t long, start long, no int, body binary"
_BODY_KINDS = [*[pa.int64()] * 7, pa.int32(), pa.binary()]


def _fetch(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """id, t, text, runs -> the words of each run; for hot ones of each window, dealt by its own hash, with its number."""
    names = [c.split()[0] for c in _BODY.split(", ")]
    for b in batches:
        out: list[tuple] = []
        size = 0
        for id_, t, text, runs in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            words = text.split()
            for r in runs:
                a, n = r["start"], r["n"]
                if r["hot"]:
                    bodies = [b" ".join(words[s : s + length]) for s in range(a, a + n)]
                    out += [(xxhash.xxh64_intdigest(x, 5) - (1 << 63), r["r1"], r["r2"], r["occ"], id_, t, a + k, k, x) for k, x in enumerate(bodies)]
                else:
                    bodies = [b" ".join(words[a : a + n + length - 1])]
                    out.append((r["key"], r["r1"], r["r2"], r["occ"], id_, t, a, -1, bodies[0]))
                size += sum(map(len, bodies))
            if size > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _BODY_KINDS, strict=True)], names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _BODY_KINDS, strict=True)], names)


_ANSWER = "r1 long, r2 long, occ long, id long, t long, start long, taken array<int>"
_ANSWER_KINDS = [*[pa.int64()] * 6, pa.list_(pa.int32())]


def _answers(rows: list[list], bodies: list[bytes], length: int) -> pa.RecordBatch:
    """Runs in the order of gram and place -> which of their windows start earlier in another run."""
    known: dict[bytes, int] = {}
    split = [x.split() for x in bodies]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.fromiter((known.setdefault(w, len(known) + 1) for x in split for w in x), np.int64, int(sizes.sum()))
    index = FMIndex(flat, sizes, len(known))
    matched, low = index.matching_statistics(flat, sizes, length)
    begin = np.cumsum(sizes) - sizes
    long = np.flatnonzero(matched >= length)
    run = np.searchsorted(begin, long, side="right") - 1
    shift = long - begin[run]
    taken = index.earliest(low[long], length) != index.begin[run] + shift
    of, values = run[taken], shift[taken].astype(np.int32)
    offsets = np.searchsorted(of, np.arange(len(sizes) + 1)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
    columns = [pa.array(c, k) for c, k in zip(rows, _ANSWER_KINDS[:-1], strict=True)]
    return pa.RecordBatch.from_arrays([*columns, lists], [c.split()[0] for c in _ANSWER.split(", ")])


def _index(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Runs sorted by gram and place -> answers; whole grams share a shard."""
    keys, rows, bodies = [], [[] for _ in range(6)], []
    for b in _with_end(batches):
        if b is not None:
            keys += b.column("key").to_pylist()
            for held, name in zip(rows, ("r1", "r2", "occ", "id", "t", "start"), strict=True):
                held += b.column(name).to_pylist()
            bodies += b.column("body").to_pylist()
            if len(bodies) * (length + length // 2) < SHARD:
                continue
        done = len(keys) if b is None else next((k for k in range(len(keys) - 1, -1, -1) if keys[k] != keys[-1]), -1) + 1
        if done:
            yield _answers([r[:done] for r in rows], bodies[:done], length)
            keys, rows, bodies = keys[done:], [r[done:] for r in rows], bodies[done:]


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, t, text, spans -> the kept words and the counts."""
    for b in batches:
        sizes, removed, kept = [], [], []
        for text, spans in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            words = text.split()
            sizes.append(len(words))
            if spans:
                gone = np.zeros(len(words) + 1, np.int64)
                at = np.array([(x["start"], x["end"]) for x in spans], np.int64)
                np.add.at(gone, at[:, 0], 1)
                np.add.at(gone, at[:, 1], -1)
                words = [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
            removed.append(sizes[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_words", "n_removed", "kept"]
        )


def duplicate_spans(base: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """base(id long, t long, text binary) -> (id, t, start, end) in words: spans that cover the copies, not yet merged."""
    found = materialize(base.mapInArrow(partial(_find, length=length, gram=gram), _RUN), "op12-found")
    shared = materialize(found.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1"), "op12-grams")
    runs = materialize(join_groups(found, shared, "key", "many", [], ["id", "start"]), "op12-runs")
    release(found)  # the longest of these tables
    first = F.min(F.struct("id", "t", "start")).alias("first")
    kinds = runs.groupBy("key", "r1", "r2").agg(first, F.count("*").alias("occ"), F.first("n").alias("n"))
    kinds = materialize(kinds.select("key", "r1", "r2", "first.*", "occ", "n"), "op12-kinds")
    busy = kinds.groupBy("key").count().filter(F.col("count") > hot).select("key", F.lit(True).alias("busy"))
    kinds = join_checked(kinds, busy, ["key"], "left", "op12-busy").withColumn("hot", F.coalesce("busy", F.lit(False)))
    wanted = kinds.groupBy("id", "t").agg(F.collect_list(F.struct("key", "r1", "r2", "occ", "start", "n", "hot")).alias("runs"))
    texts = base.join(wanted.hint("shuffle_hash"), ["id", "t"]).select("id", "t", "text", "runs")
    bodies = texts.mapInArrow(partial(_fetch, length=length), _BODY)
    if kinds.filter("hot").isEmpty():
        answers = indexed(bodies, length)
    else:
        bodies = materialize(bodies, "op12-bodies")
        answers = indexed(bodies.filter("no < 0"), length).unionByName(_by_window(bodies.filter("no >= 0"), length))
    answers = materialize(answers, "op12-answers")
    names = ["r2", "id", "t", "start", "taken"]
    groups = answers.filter("occ > 1 OR size(taken) > 0").select("r1", "occ", *[F.col(c).alias(f"g_{c}") for c in names])
    met = join_groups(runs, materialize(groups, "op12-groups"), "r1", "occ", [f"g_{c}" for c in names], ["id", "start"]).filter("r2 = g_r2")
    own = (F.col("id") == F.col("g_id")) & (F.col("t") == F.col("g_t")) & (F.col("start") == F.col("g_start"))
    whole = F.array(F.struct(F.col("start").alias("start"), (F.col("start") + F.col("n") + length - 1).alias("end")))
    some = F.transform("g_taken", lambda k: F.struct((F.col("start") + k).alias("start"), (F.col("start") + k + length).alias("end")))
    return met.select("id", "t", F.inline(F.when(own, some).otherwise(whole)))


def indexed(bodies: DataFrame, length: int) -> DataFrame:
    dealt = bodies.repartition("key").sortWithinPartitions("key", "id", "t", "start", "r1", "r2")
    return dealt.mapInArrow(partial(_index, length=length), _ANSWER)


def _by_window(bodies: DataFrame, length: int) -> DataFrame:
    """The windows of hot grams: equal ones become one before they are dealt; the answers go back to their runs."""
    body = F.sha2("body", 256)
    half = lambda k: F.conv(F.substring(body, 1 + 15 * k, 15), 16, 10).cast("long")
    windows = bodies.select("r1", "r2", "occ", "id", "t", "start", "no", "key", half(0).alias("w1"), half(1).alias("w2"), "body")
    one = windows.groupBy("key", "w1", "w2").agg(F.min(F.struct("id", "t", "start", "body")).alias("o"), F.count("*").alias("occ"))
    ones = one.select("key", F.col("w1").alias("r1"), F.col("w2").alias("r2"), "occ", "o.*")
    answers = indexed(ones, length).select(F.col("r1").alias("w1"), "occ", *[F.col(c).alias(f"g_{c}") for c in ("r2", "id", "t", "start")])
    answers = materialize(answers, "op12-windows")
    met = join_groups(windows.drop("key", "body"), answers.withColumnRenamed("occ", "many"),
                      "w1", "many", ["g_r2", "g_id", "g_t", "g_start"], ["r1", "no"]).filter("w2 = g_r2")
    earlier = ~((F.col("id") == F.col("g_id")) & (F.col("t") == F.col("g_t")) & (F.col("start") == F.col("g_start")))
    runs = met.groupBy("r1", "r2", "occ", "id", "t").agg(F.min(F.col("start") - F.col("no")).alias("start"), F.collect_list(F.when(earlier, F.col("no"))).alias("taken"))
    return runs.select("r1", "r2", "occ", "id", "t", "start", "taken")


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row for each row of ``docs``: (id_col, n_words, n_removed, kept binary: the kept words joined by one space).

    Words are cut at the ASCII white space and stay as they are; a null text has none. An earlier place is one of a smaller id, or
    in the same document an earlier start. Null ids are the smallest (and so is the least long, which comes out as null). Rows that
    repeat an id and a text are one document and give the same row; of one id's different texts that with the smaller hash
    is the earlier. Texts shorter than a window stay whole; other columns are ignored; an empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    base = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    # The text's hash is needed only to tell apart rows that share an id.
    shared = base.groupBy("id").count().filter("count > 1").limit(1)
    alone = shared.isEmpty()
    base = base.select("id", (F.lit(0).cast("long") if alone else F.xxhash64("text")).alias("t"), "text")
    once = base if alone else base.dropDuplicates(["id", "t"])
    spans = duplicate_spans(once, length, gram, hot).groupBy("id", "t").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    cut = base.join(spans.hint("shuffle_hash"), ["id", "t"], "left").select("id", "t", "text", "spans")
    out = cut.mapInArrow(_cut, "id long, n_words long, n_removed long, kept binary")
    return out.select(F.nullif("id", F.lit(NULL_ID)).alias(id_col), "n_words", "n_removed", "kept")


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, CAST(i AS BIGINT) AS i, array_to_string(w[i:i + 19], ' ') AS s
  FROM words, unnest(generate_series(1, len(w) - 19)) AS u(i)
), copies AS (
  SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, p FROM copies, unnest(generate_series(i, i + 19)) AS u(p)
), per_doc AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
), placed AS (
  SELECT doc_id, p, w[p] AS word FROM words, unnest(generate_series(1, len(w))) AS u(p)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(len(d.ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM words w LEFT JOIN per_doc d USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
