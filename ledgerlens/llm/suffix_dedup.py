"""Suffix-array dedup: removes every byte that a 100-byte string covers which also starts earlier in the corpus.

The suffix array is dealt out in buckets. Each 100-byte window belongs to the bucket of its least 24-byte gram (by a
hash; the leftmost of equals), so equal windows share a bucket and neighbouring windows mostly share a gram: an
*anchor* with the run of windows that chose it.

1. Anchors are found in each text and dealt by gram with half of the SHA-256 of the run's bytes. Runs with the same gram
   and the same digest are copies of the first of them; that is settled in the map task where both are at hand, else in
   the bucket. A run whose gram no other bytes share is done.
2. The bytes of the runs that are left are dealt by gram, and their windows are put in order by deep-shallow sorting;
   windows after the first in a group of equal ones are copies. A gram with very many different runs is dealt
   window by window instead, so no bucket holds a common gram's runs.
3. The spans of the copies are gathered by text, merged, and cut out.
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

from .common import materialize, text_batches
from .suffix_sort import sort_windows

LENGTH, GRAM = 100, 24
#: Windows whose anchors are found at once.
PIECE = 1 << 18
#: Bits of a place in a piece, which is shorter than twice PIECE and a window.
PLACE_BITS = 20
#: Different runs of a gram from which it is dealt window by window.
HOT = 4096
#: Runs that are sorted at once, unless one gram has more.
SORT_RUNS = 16_384
#: Stands for a null id, which sorts first.
NULL_ID = -(1 << 63)

Arrays = list[np.ndarray]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes at each place but the last GRAM - 1."""
    n = len(data) - GRAM + 1
    word = [np.ndarray(n, "<u8", data, offset=k, strides=(1,)).astype(np.uint64) for k in range(0, GRAM, 8)]
    x = word[0] * np.uint64(0x9E3779B97F4A7C15)
    for w in word[1:]:
        x = ((x ^ (x >> np.uint64(29))) + w) * np.uint64(0xC2B2AE3D27D4EB4F)
    return _mixed(x)


def anchors(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the gram, first window, last window) of each anchor; a window crosses none of the ``cuts``."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    whole = gram_hashes(data)
    if len(data) >> PLACE_BITS:
        raise ValueError("a piece is too long for its places")
    # As many bits in every piece: equal windows then choose the same gram wherever they are.
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (whole & ~low) | np.arange(len(whole), dtype=np.uint64)
    wide, goal = 1, LENGTH - GRAM + 1
    while wide * 2 <= goal:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if goal > wide:
        least = np.minimum(least[: len(least) - (goal - wide)], least[goal - wide :])
    gram = (least & low).astype(np.int64)
    inside = np.ones(n, bool)
    for c in cuts[1:-1].tolist():
        inside[max(0, c - LENGTH + 1) : c] = False
    new = np.ones(n, bool)
    new[1:] = (gram[1:] != gram[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [n])) - 1
    keep = inside[first]
    return whole[gram[first[keep]]], first[keep], last[keep]


def _pieces(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, list[int], list[int]]]:
    """(bytes, cuts, text numbers, offsets): short texts together, long ones in parts that overlap by a window."""
    data, cuts, who, at = [], [0], [], []
    for k, text in enumerate(texts):
        for off in range(0, max(len(text) - LENGTH + 1, 0), PIECE):
            part = text[off : off + PIECE + LENGTH - 1]
            data.append(part)
            cuts.append(cuts[-1] + len(part))
            who.append(k)
            at.append(off)
            if cuts[-1] >= PIECE:
                yield b"".join(data), np.array(cuts), who, at
                data, cuts, who, at = [], [0], [], []
    if who:
        yield b"".join(data), np.array(cuts), who, at


def merged(doc: Arrays, start: np.ndarray, end: np.ndarray) -> tuple[Arrays, np.ndarray, np.ndarray]:
    """Spans by text and place, overlapping and adjoining ones joined."""
    if not len(start):
        return doc, start, end
    by = np.lexsort((start, *doc[::-1]))
    doc, start, end = [d[by] for d in doc], start[by], end[by]
    other = np.concatenate(([True], np.any([d[1:] != d[:-1] for d in doc], axis=0)))
    number = np.cumsum(other)
    # Ends grow within a text only; the text's number keeps the running maximum apart.
    big = int(end.max()) + 1
    reach = np.maximum.accumulate(number * big + end) - number * big
    new = other.copy()
    new[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    final = np.concatenate((first[1:], [len(start)])) - 1
    return [d[first] for d in doc], start[first], reach[final]


_ROW = "kind byte, key long, run long, run2 long, id long, t long, start long, end long"
_NAMES = ["kind", "key", "run", "run2", "id", "t", "start", "end"]
SPAN, RUN, HOT_RUN = 0, 1, 2


def _batch(kind: int, key, run, run2, id_, t, start, end) -> pa.RecordBatch:
    columns = [np.full(len(start), kind, np.int8), key, run, run2, id_, t, start, end]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _NAMES)


def _spans(doc: Arrays, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    doc, start, end = merged(doc, start, end)
    if len(start):
        none = np.zeros(len(start), np.int64)
        yield _batch(SPAN, doc[0] ^ doc[1], none, none, *doc, start, end)  # the key only spreads them


def _settle(rows: Arrays) -> tuple[Arrays, np.ndarray]:
    """rows (key, run, run2, id, t, start, end), sorted: (firsts of equal runs, which of the others are copies)."""
    same = np.zeros(len(rows[0]), bool)
    same[1:] = np.all([r[1:] == r[:-1] for r in rows[:3]], axis=0)
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    self_ = np.all([r == r[first] for r in rows[3:6]], axis=0)
    return [r[~same] for r in rows], same & ~self_


def run_digests(data: bytes, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """128 bits of the SHA-256 of each run's bytes, as two longs: nobody can make different runs that agree in it."""
    sha = hashlib.sha256
    parts = [sha(data[a : z + LENGTH]).digest()[:16] for a, z in zip(first.tolist(), last.tolist(), strict=True)]
    return np.frombuffer(b"".join(parts), "<i8").reshape(-1, 2)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, t, text -> the batch's anchors, first runs only, and the spans of the others."""
    for b in batches:
        ids, ts = b.column(0).to_numpy(), b.column(1).to_numpy()
        texts = [x.as_py() for x in b.column(2)]
        parts: list[Arrays] = []
        for data, cuts, who, at in _pieces(texts):
            key, first, last = anchors(np.frombuffer(data, np.uint8), cuts)
            spot = np.searchsorted(cuts, first, side="right") - 1
            runs = run_digests(data, first, last)
            start = first - cuts[spot] + np.array(at)[spot]
            doc = np.array(who)[spot]
            parts.append([key.view(np.int64), runs[:, 0], runs[:, 1], ids[doc], ts[doc], start, start + (last - first) + LENGTH])
        if not parts:
            continue
        rows = [np.concatenate(c) for c in zip(*parts, strict=True)]
        by = np.lexsort(rows[5::-1])
        rows = [r[by] for r in rows]
        firsts, copy = _settle(rows)
        yield from _spans([rows[3][copy], rows[4][copy]], rows[5][copy], rows[6][copy])
        yield _batch(RUN, *firsts)


def _match(batches: Iterator[pa.RecordBatch], most: int = HOT) -> Iterator[pa.RecordBatch]:
    """Anchors sorted by key, run and place -> spans of copies, and the runs that share a gram with other bytes."""
    held: Arrays = [np.empty(0, np.int64)] * 7
    hot_key = None
    for b in _with_end(batches):
        if b is not None:
            rows = [b.column(c).to_numpy() for c in _NAMES]
            span = rows[0] == SPAN
            if span.any():
                yield _batch(SPAN, *(r[span] for r in rows[1:]))
            held = [np.concatenate((h, r[~span])) for h, r in zip(held, rows[1:], strict=True)]
        if not len(held[0]):
            continue
        firsts, copy = _settle(held)
        yield from _spans([held[3][copy], held[4][copy]], held[5][copy], held[6][copy])
        key = firsts[0]
        done = len(key) if b is None else int(np.searchsorted(key, key[-1]))
        number = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        size = np.bincount(number)[number]
        hot = (size > most) | (key == hot_key if hot_key is not None else False)
        if b is not None and hot[-1]:  # of a common gram only the last run is held
            done = len(key) - 1
            hot_key = int(key[-1])
        for kind, some in ((RUN, (size > 1) & ~hot), (HOT_RUN, hot)):
            some = some & (np.arange(len(key)) < done)
            if some.any():
                none = np.zeros(int(some.sum()), np.int64)  # the digests have done their work
                yield _batch(kind, key[some], none, none, *(f[some] for f in firsts[3:]))
        held = [f[done:] for f in firsts]


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


_TEXT_ROW = "kind byte, key long, id long, t long, start long, end long, body binary"


def _text_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int8(), *[pa.int64()] * 5, pa.binary())
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["kind", "key", "id", "t", "start", "end", "body"]
    )


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, t, text, runs -> the runs' bytes by gram; windows of common grams by their own hash, each at most once from
    a batch."""
    for b in batches:
        out: list[tuple] = []
        windows: dict[bytes, list[tuple]] = {}
        for id_, t, text, runs in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            for r in runs:
                if r["kind"] == RUN:
                    out.append((RUN, r["key"], id_, t, r["start"], r["end"], text[r["start"] : r["end"]]))
                    continue
                for s in range(r["start"], r["end"] - LENGTH + 1):
                    windows.setdefault(text[s : s + LENGTH], []).append((id_, t, s))
        for body, places in windows.items():
            first = min(places)
            key = xxhash.xxh64_intdigest(body, 2) - (1 << 63)
            out.append((RUN, key, *first, first[2] + LENGTH, body))
            out += [(SPAN, p[0] ^ p[1], *p, p[2] + LENGTH, None) for p in places if p != first]
        if out:
            yield _text_batch(out)


def _sorted_spans(ids, ts, starts, bodies: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The windows of the runs in order, and the spans of all but the first in each group of equal ones."""
    data = b"".join(bodies)
    size = np.fromiter(map(len, bodies), np.int64, len(bodies))
    begin = np.cumsum(size) - size
    n = size - LENGTH + 1
    row = np.repeat(np.arange(len(bodies)), n)
    shift = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    order, group = sort_windows(data, begin[row] + shift, LENGTH)
    row, place = row[order], starts[row[order]] + shift[order]
    by = np.lexsort((place, ts[row], ids[row], group))
    row, place, group = row[by], place[by], group[by]
    first = np.maximum.accumulate(np.where(np.concatenate(([True], group[1:] != group[:-1])), np.arange(len(group)), 0))
    itself = (ids[row] == ids[row[first]]) & (ts[row] == ts[row[first]]) & (place == place[first])
    copy = ~itself
    yield from _spans([ids[row[copy]], ts[row[copy]]], place[copy], place[copy] + LENGTH)


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by key -> spans. Whole keys are sorted together."""
    held: Arrays = [np.empty(0, np.int64)] * 4
    bodies: list[bytes] = []
    for b in _with_end(batches):
        if b is not None:
            rows = [b.column(c).to_numpy() for c in ("kind", "key", "id", "t", "start", "end")]
            span = rows[0] == SPAN
            if span.any():
                yield from _spans([rows[2][span], rows[3][span]], rows[4][span], rows[5][span])
            held = [np.concatenate((h, r[~span])) for h, r in zip(held, rows[1:5], strict=True)]
            bodies += [x for x in b.column("body").to_pylist() if x is not None]
            if len(bodies) < SORT_RUNS:
                continue
        done = len(bodies) if b is None else int(np.searchsorted(held[0], held[0][-1]))
        if done:
            yield from _sorted_spans(held[1][:done], held[2][:done], held[3][:done], bodies[:done])
            held, bodies = [h[done:] for h in held], bodies[done:]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, t, text, spans -> the kept bytes and the counts."""
    for b in batches:
        rows = []
        for text, spans in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            kept, at, removed, n = [], 0, 0, 0
            if spans:
                arr = np.array([(x["start"], x["end"]) for x in spans], np.int64)
                _, starts, ends = merged([np.zeros(len(arr), np.int64)], arr[:, 0], arr[:, 1])
                n = len(starts)
                for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                    kept.append(text[at:s])
                    removed += e - s
                    at = e
            kept.append(text[at:])
            rows.append((len(text), removed, n, b"".join(kept)))
        sizes, removed, n, body = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, n)), pa.array(body, pa.binary())],
            ["id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def duplicate_spans(base: DataFrame, hot: int = HOT) -> DataFrame:
    """base(id long, t long, text binary) -> (id, t, start, end): spans that cover the copies, not yet merged."""
    found = base.mapInArrow(_find, _ROW).repartition("key").sortWithinPartitions("key", "run", "run2", "id", "t", "start")
    found = materialize(found.mapInArrow(partial(_match, most=hot), _ROW), "op1-runs")
    runs = (
        found.filter(f"kind <> {SPAN}")
        .groupBy("id", "t")
        .agg(F.collect_list(F.struct("kind", "key", "start", "end")).alias("runs"))
        .hint("shuffle_hash")
    )
    texts = base.join(runs, ["id", "t"]).select("id", "t", "text", "runs").mapInArrow(_fetch, _TEXT_ROW)
    windows = texts.repartition("key").sortWithinPartitions("key").mapInArrow(_sort, _ROW)
    spans = ["id", "t", "start", "end"]
    return found.filter(f"kind = {SPAN}").select(*spans).union(windows.select(*spans))


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT
) -> DataFrame:
    """One row for each row of ``docs``: (id_col, n_bytes, n_removed, n_spans, kept binary).

    Texts are UTF-8 bytes; a null text is empty. An earlier place is one of a smaller id, or in the same document an
    earlier start. Null ids are the smallest (and so is the least long, which comes out as null). Rows that repeat an id and
    a text are one document and give the same row; of one id's different texts that with the smaller hash is the
    earlier. Other columns are ignored; an empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    base = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    # The text's hash is needed only to tell apart rows that share an id.
    shared = base.groupBy("id").count().filter("count > 1").limit(1)
    t = F.lit(0).cast("long") if shared.isEmpty() else F.xxhash64("text")
    base = base.select("id", t.alias("t"), "text")
    gathered = (
        duplicate_spans(base, hot).groupBy("id", "t").agg(F.collect_list(F.struct("start", "end")).alias("spans")).hint("shuffle_hash")
    )
    cut = base.join(gathered, ["id", "t"], "left").select("id", "t", "text", "spans")
    out = cut.mapInArrow(_cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(F.nullif("id", F.lit(NULL_ID)).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")
