"""Benchmark decontamination by SimHash over item-sized windows.

For each benchmark item, windows of the item's number of words slide over every text, word by word. Windows that could
reach the similarity are fingerprinted; an index of Hamming blocks gives every item whose fingerprint lies within
the radius; the exact similarity of the weighted shingles (how often each occurs) decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches
from .simhash import bits_apart, fingerprint
from .words import shingle_hashes, words_of

SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints are cut into BLOCKS blocks; within RADIUS bits some block differs in INDEX_FLIPS + PROBE_FLIPS bits at
#: most, which the index and the probe flip between them. Items have few shingles, so a similarity of 0.8 can cost
#: more than a third of the bits.
BLOCKS, BLOCK_BITS, RADIUS, INDEX_FLIPS, PROBE_FLIPS = 4, 16, 23, 2, 3
#: Items that are held in memory at once; a larger benchmark takes several passes.
ITEMS_AT_ONCE = 20_000
#: Bytes of text that are hashed at once.
PIECE = 1 << 20

_FACTOR = 0x9E3779B97F4A7C15


def _flips(most: int) -> np.ndarray:
    sums = (sum(1 << k for k in at) for n in range(most + 1) for at in combinations(range(BLOCK_BITS), n))
    return np.array(list(sums), np.int64)


@lru_cache(1)
def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += np.uint64(32)
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return lower, space


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor modulo 2^64 and of its inverse."""
    up = np.full(n, _FACTOR, np.uint64)
    down = np.full(n, pow(_FACTOR, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def quick_hashes(data: np.ndarray, cuts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the shingles of ``size`` words of many texts at once; ``cuts``: where each text starts in
    ``data`` and where the last ends. A sieve only: equal shingles have equal hashes."""
    lower, space = _byte_tables()
    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    if not len(data):
        return none
    inside = ~space[data]
    # A word starts where the byte before is white space or of another text.
    edge = np.zeros(len(data) + 1, bool)
    edge[cuts] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    if len(starts) < size:
        return none
    up, down = _powers(max(PIECE, 1 << int(len(data)).bit_length()))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((lower[data] + np.uint64(1)) * up[: len(data)], dtype=np.uint64)))
    word = _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    text = np.searchsorted(cuts, starts, side="right") - 1
    n = len(word) - size + 1
    whole = np.zeros(n, np.uint64)
    for k in range(size):
        whole = whole * np.uint64(_FACTOR) + word[k : k + n]
    same = text[:n] == text[size - 1 :]
    return whole[same], text[:n][same]


class Index:
    """A block of benchmark items, ready for lookup in a task."""

    def __init__(self, items: list[tuple[int, str]], shingle: int, similarity: float):
        self.shingle, self.similarity = shingle, similarity
        self.ids, self.lengths, self.sets, prints, quick = [], [], [], [], {}
        owners: dict[int, list[int]] = {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            hashes = shingle_hashes(words, shingle)
            at = len(self.ids)
            self.ids.append(item_id)
            self.lengths.append(len(words))
            self.sets.append(np.unique(hashes, return_counts=True))
            prints.append(fingerprint(hashes))
            for h in self.sets[-1][0].tolist():
                owners.setdefault(h, []).append(at)
            data = np.frombuffer(b" ".join(words), np.uint8)
            size = min(shingle, len(words))
            quick.setdefault(size, []).append(quick_hashes(data, np.array([0, len(data)]), size)[0])
        self.prints = np.array(prints, np.int64)
        self.owners = owners
        self.known = np.array(sorted(owners), np.uint64)
        self.quick = {k: np.unique(np.concatenate(v)) for k, v in quick.items()}
        # A window has an item's number of words, so each length has blocks of its own.
        self.blocks = {}
        lengths = np.array(self.lengths, np.int64)
        flips = _flips(INDEX_FLIPS)
        for length in sorted(set(self.lengths)):
            own = np.flatnonzero(lengths == length)
            blocks = []
            for b in range(BLOCKS):
                key = (self._block(self.prints[own], b)[:, None] ^ flips).ravel()
                order = np.argsort(key, kind="stable")
                blocks.append((key[order], np.repeat(own, len(flips))[order]))
            self.blocks[length] = blocks

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        return (prints.view(np.uint64) >> np.uint64(b * BLOCK_BITS)).astype(np.int64) & ((1 << BLOCK_BITS) - 1)

    def sieve(self, texts: list[bytes]) -> np.ndarray:
        """Places of the texts that hold some shingle of some item. The others are at similarity 0 to all items."""
        hit = np.zeros(len(texts), bool)
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= PIECE):
                size += len(texts[end])
                end += 1
            if size > 4 * PIECE:  # one long text: looked at in full
                hit[at] = True
            else:
                data = np.frombuffer(b"".join(texts[at:end]), np.uint8)
                cuts = np.cumsum([0, *map(len, texts[at:end])])
                for length, known in self.quick.items():
                    found, text = quick_hashes(data, cuts, length)
                    place = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    hit[at + text[known[place] == found]] = True
            at = end
        return np.flatnonzero(hit)

    def near(self, prints: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item): all pairs with items of ``length`` words whose fingerprints differ in RADIUS bits at most."""
        pairs, flips = [], _flips(PROBE_FLIPS)
        for b, (keys, items) in enumerate(self.blocks[length]):
            probe = self._block(prints, b)[:, None] ^ flips
            lo, hi = np.searchsorted(keys, probe, "left"), np.searchsorted(keys, probe, "right")
            n = (hi - lo).ravel()
            window = np.repeat(np.repeat(np.arange(len(prints)), len(flips)), n)
            place = np.repeat(lo.ravel() - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pairs.append(window * len(self.ids) + items[place])
        both = np.unique(np.concatenate(pairs))
        window, item = both // len(self.ids), both % len(self.ids)
        close = bits_apart(prints[window], self.prints[item]) <= RADIUS
        return window[close], item[close]

    def matches(self, text: str) -> list[tuple[int, float, int, int]]:
        """(item_id, similarity, first word, words) of the best window for each item that the text holds."""
        words = words_of(text)
        hashes = shingle_hashes(words, self.shingle)
        place = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        hit = self.known[place] == hashes if len(self.known) and len(hashes) else np.zeros(len(hashes), bool)
        best: dict[int, tuple[float, int, int]] = {}
        lengths = {self.lengths[i] for h in np.unique(hashes[hit]).tolist() for i in self.owners[h]}
        # A text or item of fewer words than a shingle is one shingle, met by windows of that many words.
        for length in sorted(lengths | {n for n in self.lengths if n < self.shingle and n <= len(words)}):
            own = min(self.shingle, length)
            h = hashes if own == self.shingle or len(words) <= own else shingle_hashes(words, own)
            wide = max(1, min(length, len(words)) - own + 1)
            of_item = max(1, length - own + 1)
            good = hit if h is hashes else np.isin(h, self.known)
            seen = np.concatenate(([0], np.cumsum(good)))
            # Similarity s of weighted sets of a and b shingles takes (a + b) * s / (1 + s) shared ones.
            least = (wide + of_item) * self.similarity / (1 + self.similarity) - 1e-9
            starts = np.flatnonzero(seen[wide:] - seen[:-wide] >= least)
            for k in range(0, len(starts), 4096):
                some = starts[k : k + 4096]
                span = h[some[0] : some[-1] + wide]
                bits = np.unpackbits(span.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)))
                over = 2 * (sums[some - some[0] + wide] - sums[some - some[0]]) > wide
                prints = np.packbits(over, axis=1, bitorder="little").view(np.int64).ravel()
                for w, i in zip(*self.near(prints, length), strict=True):
                    start = int(some[w])
                    found = self._similarity(h[start : start + wide], i)
                    if found >= self.similarity and (i not in best or found > best[i][0]):
                        best[i] = (found, start, min(length, len(words)))
        return sorted((self.ids[i], *v) for i, v in best.items())

    def _similarity(self, window: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity: the shared counts over the larger ones."""
        mine, n = np.unique(window, return_counts=True)
        theirs, m = self.sets[item]
        _, x, y = np.intersect1d(mine, theirs, assume_unique=True, return_indices=True)
        both = int(np.minimum(n[x], m[y]).sum())
        return both / (int(n.sum()) + int(m.sum()) - both)


def indexes(benchmark: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> list[Index]:
    """The benchmark in blocks of about ITEMS_AT_ONCE items at most; one block for the usual benchmark."""
    text_batches(benchmark.sparkSession)
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter("id IS NOT NULL AND text IS NOT NULL").distinct()
    parts = -(-rows.count() // ITEMS_AT_ONCE)
    block = F.pmod(F.xxhash64("id", "text"), F.lit(max(parts, 1)))
    found = []
    for k in range(parts):
        items = [(r["id"], r["text"]) for r in rows.filter(block == k).orderBy("id", "text").collect()]
        found.append(Index(items, shingle, similarity))
    return [x for x in found if x.ids]


def _found(index: Index, texts: list[str | None]) -> Iterator[tuple[int, list]]:
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    for k in index.sieve(raw).tolist():
        if got := index.matches(texts[k]):
            yield k, got


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """(id_col, item_id_col, similarity, first_word, n_words): for each document and item that it holds, the best window.

    Words are lower-cased (A-Z) and cut at ASCII white space. Null or empty texts and items match nothing, nor do items
    without an id; a null document id is kept in the result. Rows that repeat an id are rows of their own. Items of fewer
    words than a shingle are matched as one shingle. Other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = base.select(
        F.col("id").alias(id_col),
        F.lit(0).cast("long").alias(item_id_col),
        F.lit(0.0).alias("similarity"),
        F.lit(0).cast("long").alias("first_word"),
        F.lit(0).cast("long").alias("n_words"),
    ).schema
    spark = docs.sparkSession
    out = spark.createDataFrame([], schema)
    for index in indexes(benchmark, item_id_col, item_text_col, shingle, similarity):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(k, *x) for k, got in _found(shared.value, b.column(1).to_pylist()) for x in got]
                at, item, score, first, n = zip(*rows, strict=True) if rows else ([], [], [], [], [])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(at, pa.int64())),
                        pa.array(item, pa.int64()),
                        pa.array(score, pa.float64()),
                        pa.array(first, pa.int64()),
                        pa.array(n, pa.int64()),
                    ],
                    schema.names,
                )

        out = out.union(base.mapInArrow(run, schema))
    return out


def _holder(shared) -> Callable:
    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        found = {k for k, _ in _found(shared.value, [t if isinstance(t, str) else None for t in texts])}
        return pd.Series([k in found for k in range(len(texts))], dtype=bool)

    return holds


def clean_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item: contaminated() as a filter, without a shuffle."""
    for index in indexes(benchmark, item_id_col, item_text_col, shingle, similarity):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        docs = docs.filter(~_holder(shared)(F.col(text_col).cast("string")))
    return docs
