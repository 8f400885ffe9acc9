"""SimHash near-dedup with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments. Errors are shared out by the pigeonhole principle: with at most two
differing bits one segment is equal and the next differs in two bits at most; with at most five, two segments differ in
two bits at most each. A segment that may differ in two bits is decoded to nearby Golay codewords, whose indices are
keys. Fingerprints that share a key meet, are compared bit by bit, and leave a minimum spanning forest of the links
within the radius: as many rows as fingerprints, the same components, and no pair list.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_checked, join_groups, materialize, release, text_batches
from .components import components
from .golay import keys as golay_keys
from .words import shingle_hashes, word_hashes, words_of

#: (shift, bits) of the segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
PAIRS = ((0, 1), (1, 2), (2, 0))
#: Of up to SMALL texts that share a shingle all pairs are listed; of up to LISTED, those of texts that are not joined yet;
#: larger groups are compared in blocks of CROWD_BLOCK.
SMALL, LISTED, CROWD_BLOCK = 16, 256, 128
#: Shingles in COMMON or more of a sample of about SAMPLE_DOCS texts come last in the order that prefixes are cut from.
#: Any order finds every pair, so the sample changes the work and not the result.
SAMPLE_DOCS, COMMON = 20_000, 3
#: Bits of the table that marks crowded shingles, whose size is fixed. Others that share a bit with one are marked too.
SLOTS = 1 << 25
#: Columns of shingles multiplied at once when a block is compared.
COLUMNS = 8192
#: Larger groups of fingerprints are cut further before their links are sought.
FOREST = 4096
#: Hashes summed at once, which bounds the memory for a very long text.
BLOCK = 1 << 16


def bit_counts(hashes: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[k : k + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64) if weights is None else weights[k : k + BLOCK] @ bits
    return total


def fingerprint(hashes: np.ndarray, weights: np.ndarray | None = None) -> int:
    """Bits that are set in over half of the hashes (by weight), as a signed 64-bit number; 0 for no hashes."""
    whole = len(hashes) if weights is None else int(weights.sum())
    over = 2 * bit_counts(hashes, weights) > whole
    return int(np.packbits(over, bitorder="little").view(np.int64)[0])


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of signed 64-bit numbers (bitwise_count would count those of a negative number's magnitude)."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def shingle_print(size: int) -> Callable[[str | None], int]:
    return lambda text: fingerprint(shingle_hashes(words_of(text), size))


def word_print(text: str | None) -> int:
    """Weighs words by length, so that the short words that all texts of a language share count little: an
    edit that breaks five shingles of five words moves this fingerprint by one word's share only."""
    return words_fingerprint(words_of(text))


def words_fingerprint(words: list[bytes]) -> int:
    return fingerprint(word_hashes(words), np.fromiter((min(len(w), 12) ** 2 for w in words), np.int64, len(words)))


def prints(docs: DataFrame, make: Callable[[str | None], int]) -> DataFrame:
    """docs(id, text) -> (id, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [make(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], ["id", "fp"])

    return docs.select("id", "text").mapInArrow(run, docs.select("id", F.lit(0).cast("long").alias("fp")).schema)


def _keys(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the fingerprints: for radius 2 an equal segment and the next one's codewords, beyond that the
    codewords of two segments (whole up to radius 5)."""
    parts = [(fps.view(np.uint64) >> np.uint64(s)).astype(np.int64) & ((1 << n) - 1) for s, n in SEGMENTS]
    coded = [golay_keys(p, n) for p, (_, n) in zip(parts, SEGMENTS, strict=True)]
    rows, found = [], []
    for tag, (x, y) in enumerate(PAIRS):
        row, near = coded[y]
        if radius <= 2:
            rows.append(row)
            found.append((tag << 60) | (parts[x][row] << 12) | near)
            continue
        row_x, near_x = coded[x]
        count = np.bincount(row_x, minlength=len(fps))
        first = np.cumsum(count) - count
        times = count[row]
        left = np.repeat(first[row] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        rows.append(np.repeat(row, times))
        found.append((tag << 60) | (near_x[left] << 12) | np.repeat(near, times))
    return np.concatenate(rows), np.concatenate(found)


def _forest(nodes: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Prim's minimum spanning forest of the links within ``radius``, at most one link for each node."""
    away = bits_apart(fps, fps[0]).astype(np.int16)
    parent = np.zeros(len(nodes), np.int64)
    away[0] = 999
    out = np.ones(len(nodes), bool)
    out[0] = False
    child, by = [], []
    for _ in range(len(nodes) - 1):
        k = int(np.where(out, away, 998).argmin())
        if away[k] <= radius:
            child.append(k)
            by.append(parent[k])
        out[k] = False
        now = bits_apart(fps, fps[k])
        closer = out & (now < away)
        away[closer] = now[closer]
        parent[closer] = k
    return nodes[child], nodes[by]


def _large_forest(nodes: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what all links within ``radius`` join. The bits that vary in the group are dealt to ``radius`` + 1
    parts: two fingerprints within the radius agree in one of them, so only groups with an equal part are compared."""
    varying = int(np.bitwise_or.reduce((fps ^ fps[0]).view(np.uint64)))
    bits = [b for b in range(64) if varying >> b & 1]
    child, by = [nodes[:0]], [nodes[:0]]
    for k in range(radius + 1):
        part = fps.view(np.uint64) & np.uint64(sum(1 << b for b in bits[k :: radius + 1]))
        order = np.argsort(part, kind="stable")
        ends = np.flatnonzero(np.diff(part[order])) + 1
        for rows in np.split(order, ends):
            x, y = _forest(nodes[rows], fps[rows], radius)
            child.append(x)
            by.append(y)
    return np.concatenate(child), np.concatenate(by)


def _met(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray, radius: int) -> pa.RecordBatch:
    """The forests' links of whole groups, the arrays sorted by key."""
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.concatenate((start, [len(keys)])))
    two = start[size == 2]
    two = two[bits_apart(fps[two], fps[two + 1]) <= radius]
    a, b = [nodes[two]], [nodes[two + 1]]
    for s, n in zip(start[size > 2], size[size > 2], strict=True):
        forest = _large_forest if n > FOREST and radius <= 5 else _forest
        x, y = forest(nodes[s : s + n], fps[s : s + n], radius)
        a.append(x)
        b.append(y)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def links(points: DataFrame, radius: int) -> DataFrame:
    """points(node long, fp long) -> distinct (a, b): links within ``radius`` bits that join the same components as
    all links do. For a radius up to 5 none is missed; beyond that those are found whose two segments differ in two
    bits at most each."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, fps = b.column("node").to_numpy(), b.column("fp").to_numpy()
            for k in range(0, len(nodes), 4096):
                row, key = _keys(fps[k : k + 4096], radius)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(nodes[k + row]), pa.array(fps[k + row])], ["key", "node", "fp"]
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for b in batches:
            held = [np.concatenate((h, b.column(c).to_numpy())) for h, c in zip(held, ("key", "node", "fp"), strict=True)]
            last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if last:
                yield _met(*(h[:last] for h in held), radius)
                held = [h[last:] for h in held]
        if len(held[0]):
            yield _met(*held, radius)

    dealt = points.select("node", "fp").mapInArrow(deal, "key long, node long, fp long")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def fingerprint_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2
) -> DataFrame:
    """One row for each row of ``docs``: (id_col, fingerprint, component_id).

    Fingerprints link when at most ``radius`` (up to 5) bits differ; component_id is the smallest id that can be
    reached. A null text counts as empty: fingerprint zero, linked like any other. Null ids are passed over when
    the smallest is sought (null where a component has no other). Rows that repeat an id are rows of their own. Other
    columns are ignored; an empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    if not 0 <= radius <= 5:
        raise ValueError("no link is missed only for a radius from 0 to 5")
    rows = prints(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), shingle_print(shingle))
    rows = materialize(rows, "op7-prints")
    # Equal fingerprints are one node from here on, however many rows have them.
    points = rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    found = components(links(points.select(F.col("fp").alias("node"), "fp"), radius))
    rooted = points.join(found, points["fp"] == found["node"], "left").select(
        "fp", "least", "n", F.coalesce("root", "fp").alias("root")
    )
    rooted = materialize(rooted, "op7-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("fps"))
    named = join_groups(rooted, materialize(least, "op7-least"), "root", "fps", ["component_id"], ["fp"])
    # All empty texts have one fingerprint: the rows of such large groups are dealt by id.
    named = materialize(named.select("fp", "n", "component_id"), "op7-named")
    return join_groups(rows, named, "fp", "n", ["component_id"], ["id"]).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """docs(id, text) -> (id, shingles): the distinct hashes of the text's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                sets = [np.unique(shingle_hashes(words_of(t.as_py()), size)).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    return docs.select("id", "text").mapInArrow(run, "id long, shingles array<long>")


def _cut_sets(docs: DataFrame, size: int) -> DataFrame:
    """docs(id, text) -> (node, cut, shingles): the distinct hashes of the shingles, and those cut to 16 bits, sorted,
    repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                sets = [np.unique(shingle_hashes(words_of(t.as_py()), size)) for t in part.column(1)]
                cuts = pa.array([np.sort(x.astype(np.uint16)).tobytes() for x in sets], pa.binary())
                whole = pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), cuts, whole], ["node", "cut", "shingles"])

    return docs.select("id", "text").mapInArrow(run, "node long, cut binary, shingles array<long>")


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - both
    return F.when(whole == 0, 1.0).otherwise(both / whole)


def _common(docs: DataFrame, size: int) -> np.ndarray:
    """Shingles in COMMON or more of a sample of docs(id, text)."""
    n = docs.count()
    some = docs.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < min(int(SAMPLE_DOCS / max(n, 1) * (1 << 30)), 1 << 30))
    often = shingle_sets(some, size).select(F.explode("shingles").alias("h")).groupBy("h").count().filter(f"count >= {COMMON}")
    return np.sort(np.array([r["h"] for r in often.select("h").collect()], np.int64).view(np.uint64))


def _slots(rows: DataFrame) -> np.ndarray:
    """A table of SLOTS bits with those of rows(h) set."""
    slot = rows.select(F.col("h").bitwiseAND(F.lit(SLOTS - 1)).alias("slot"))
    bit = F.expr("bit_or(shiftleft(1L, cast(slot & 63L AS int)))")
    words = slot.groupBy(F.shiftright("slot", 6).alias("word")).agg(bit.alias("bits")).toArrow()
    table = np.zeros(SLOTS >> 6, np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return table


def _marked(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(SLOTS - 1)
    return (table[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _prefixes(docs: DataFrame, size: int, similarity: float, common: np.ndarray, crowded: np.ndarray) -> DataFrame:
    """docs(id, text) -> (node, n, same, fp, prefix): how many distinct shingles a text has, a digest of them all, its word
    fingerprint, and so many of the first shingles in a fixed order that two texts of the similarity have one of them in
    common: their first common shingle leaves no more than the dissimilar part before it. The order is by hash, with the
    common shingles and those of the table ``crowded`` last. A text without words has the one shingle 0."""
    shared = docs.sparkSession.sparkContext.broadcast((common, crowded if crowded.any() else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, crowded = shared.value
        for b in (b.slice(k, 1024) for b in batches for k in range(0, b.num_rows, 1024)):
            counts, same, fps, prefix = [], [], [], []
            for t in b.column(1):
                words = words_of(t.as_py())
                hashes = np.unique(shingle_hashes(words, size))
                counts.append(len(hashes))
                fps.append(words_fingerprint(words))
                same.append(hashlib.md5(hashes.tobytes()).digest())
                last = np.isin(hashes, common, assume_unique=True) if len(common) else np.zeros(len(hashes), bool)
                if crowded is not None:
                    last |= _marked(crowded, hashes)
                # The small number keeps a product just above a whole one from cutting a shingle off.
                most = len(hashes) - math.ceil(similarity * len(hashes) - 1e-6) + 1
                ordered = np.concatenate((hashes[~last], hashes[last]))[:most] if len(hashes) else np.zeros(1, np.uint64)
                prefix.append(ordered.view(np.int64))
            columns = [b.column(0), pa.array(counts, pa.int64()), pa.array(same, pa.binary()), pa.array(fps, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "same", "fp", "prefix"])

    return docs.select("id", "text").mapInArrow(run, "node long, n long, same binary, fp long, prefix array<long>")


def _block_links(nodes: np.ndarray, roots: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join all roots that near copies join, by the exact similarity of every pair of a block (sides all 0) or
    of two blocks (sides 0 and 1)."""
    sizes = np.array([len(x) for x in sets])
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    rank = np.cumsum(count > 1) - 1
    row, column = row[count[at] > 1], rank[at[count[at] > 1]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for k in range(0, int(rank[-1]) + 1 if len(rank) else 0, COLUMNS):
        part = (column >= k) & (column < k + COLUMNS)
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[row[part], column[part] - k] = 1
        both += held @ held.T
    whole = sizes[:, None] + sizes[None, :] - both.astype(np.int64)
    near = (both.astype(np.float64) / np.maximum(whole, 1) >= similarity) & (roots[:, None] != roots[None, :])
    if sides.any():
        near &= sides[:, None] != sides[None, :]
    top = {int(r): int(r) for r in roots}

    def find(k: int) -> int:
        while top[k] != k:
            top[k] = k = top[top[k]]
        return k

    out = []
    for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        x, y = find(int(roots[i])), find(int(roots[j]))
        if x != y:
            top[x] = y
            out.append((int(nodes[i]), int(nodes[j])))
    return out


def _most_similar() -> Callable[[Column, Column], Column]:
    """An upper bound of the similarity: as many shingles in common as cut hashes, each as often as in both."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16)
            (u, m), (v, n) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
            _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
            both = int(np.minimum(m[i], n[j]).sum())
            whole = len(x) + len(y) - both
            out.append(both / whole if whole else 1.0)
        return pd.Series(out, dtype=float)

    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of sets(node, cut, shingles) that have at least the similarity. Those that cannot have it by their
    cut hashes, a quarter of the bytes, are passed over first."""
    one, two = sets.select(F.col("node").alias("a"), F.col("cut").alias("x")), sets.select(F.col("node").alias("b"), F.col("cut").alias("y"))
    could = pairs.join(one, "a").join(two, "b").filter(_most_similar()(F.col("x"), F.col("y")) >= similarity - 1e-9).select("a", "b")
    could = materialize(could, "near-candidates")
    ends = could.select(F.col("a").alias("node")).union(could.select("b")).distinct()
    left = join_checked(sets.select("node", "shingles"), ends, ["node"], "left_semi", "near-candidate-ends")
    one, two = left.withColumnRenamed("node", "a").withColumnRenamed("shingles", "x"), left.withColumnRenamed("node", "b").withColumnRenamed("shingles", "y")
    return could.join(one, "a").join(two, "b").filter(jaccard(F.col("x"), F.col("y")) >= similarity).select("a", "b")


def _near_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b) for rows(h, node, root, n, pos): the pairs of texts of different roots that share a shingle. From the first common shingle on, what is left of either text bounds what they have in common."""
    left = F.col("n") - F.col("pos")
    one = rows.select("h", F.col("node").alias("a"), F.col("root").alias("r"), F.col("n").alias("n1"), left.alias("left1"))
    two = rows.select("h", F.col("node").alias("b"), F.col("root").alias("s"), F.col("n").alias("n2"), left.alias("left2"))
    enough = F.least("left1", "left2") >= similarity / (1 + similarity) * (F.col("n1") + F.col("n2")) - 1e-6
    met = one.join(two, (one["h"] == two["h"]) & (F.col("a") < F.col("b")) & (F.col("r") != F.col("s")) & enough)
    return met.select("a", "b")


def _some_partner(similarity: float) -> Column:
    """Whether what is left of a text from its first common shingle on is enough for the smallest text of the group."""
    return F.col("n") - F.col("pos") >= similarity / (1 + similarity) * (F.col("n") + F.col("least_n")) - 1e-6


def _of_roots(rows: DataFrame) -> DataFrame:
    """(h, size, least_n) for rows(h, root, n): the groups whose texts are not all joined yet."""
    groups = rows.groupBy("h").agg(F.count("*").alias("size"), F.min("n").alias("least_n"), F.min("root").alias("r"), F.max("root").alias("s"))
    return groups.filter("r <> s").drop("r", "s")


def _by_size(rows: DataFrame, similarity: float) -> DataFrame:
    """(h, node, root, n, pos, size, least_n) for rows(h, node, root, n, pos): the groups split by size. Near copies' sizes are
    at most one class apart, so each row goes to its class and the next, where it meets all that it can be a near copy of.
    Groups of one root are left out."""
    width = math.log(1 / similarity) + 1e-6
    own = F.floor(F.ln("n") / width)
    dealt = rows.filter("n > 0").select("node", "root", "n", "pos", F.col("h").alias("h0"), F.explode(F.array(own, own + 1)).alias("c"))
    dealt = dealt.select(F.xxhash64("h0", "c").alias("h"), "node", "root", "n", "pos")
    groups = _of_roots(dealt)
    held = join_groups(dealt, materialize(groups, "near-sizes"), "h", "size", ["size", "least_n"], ["node"])
    return held.filter(_some_partner(similarity))


def _rare_first(base: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(h, node, n, pos) for sets(node, shingles): prefixes as in _prefixes(), in an order that puts the shingles that few
    of these texts hold first. Shingles of one text only take their places and are left out."""
    each = sets.select("node", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("h"))
    often = materialize(each.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"), "near-often")
    held = join_groups(each, often, "h", "df", ["df"], ["node"])
    ordered = held.groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "h"))).alias("o"))
    alone = F.col("n") - F.size("o")
    most = F.col("n") - F.ceil(similarity * F.col("n") - 1e-6) + 1 - alone
    cut = ordered.select("node", "n", alone.alias("alone"), F.slice("o", F.lit(1), F.greatest(most, F.lit(0)).cast("int")).alias("o"))
    each = cut.select("node", "n", "alone", F.posexplode("o").alias("at", "x"))
    return each.select(F.col("x.h").alias("h"), "node", "n", (F.col("alone") + F.col("at")).cast("long").alias("pos"))


def _crowd_links(crowd: DataFrame, sure: DataFrame, base: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b) for crowd(node, root), the texts of large groups: links that join all that near copies among them join.

    The texts get new prefixes, rarest shingles first. A copy of a text that was edited apart from others begins with
    shingles of its own, so what groups are left hold texts that differ little. Each group's hub, the text with
    the fewest rarer shingles, is compared with the others of other roots. In groups of up to LISTED the pairs of texts
    that are not joined by then are listed; larger ones are dealt out in blocks, by components of shared shingles, and
    every two blocks of a component are compared together.
    """
    texts = join_checked(base, crowd.select(F.col("node").alias("id")), ["id"], "left_semi", "near-crowd-nodes")
    sets = materialize(_cut_sets(texts, shingle), "near-crowd-shingles")
    rows = materialize(join_checked(_rare_first(base, sets, similarity), crowd, ["node"], "inner", "near-crowd-roots"), "near-rare")
    hub = F.min(F.struct("pos", "node", "n", "root")).alias("hub")
    groups = materialize(_of_roots(rows).join(rows.groupBy("h").agg(hub), "h"), "near-rare-shared")
    rows = join_groups(rows, groups, "h", "size", ["least_n", "hub"], ["node"]).filter(_some_partner(similarity))
    rows = materialize(rows, "near-rare-held")
    left = F.least(F.col("n") - F.col("pos"), F.col("hub.n") - F.col("hub.pos"))
    enough = (F.col("root") != F.col("hub.root")) & (left >= similarity / (1 + similarity) * (F.col("n") + F.col("hub.n")) - 1e-6)
    hubs = rows.filter(enough).select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))
    found = materialize(_verified(hubs.distinct(), sets, similarity), "near-hubs")
    joined = components(sure.union(found))

    rows = rows.select("h", "node", "n", "pos").join(joined, "node", "left")
    rows = materialize(rows.withColumn("root", F.coalesce("root", "node")), "near-crowd")
    split = rows.groupBy("h").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.min("node").alias("least"), F.count("*").alias("size"))
    split = materialize(split.filter("r <> s").select("h", "least", "size"), "near-split")
    left = materialize(join_groups(rows, split, "h", "size", ["least", "size"], ["node"]), "near-left")
    listed = _near_pairs(left.filter(F.col("size") <= LISTED), similarity).distinct()
    found = found.union(materialize(_verified(listed, sets, similarity), "near-listed"))
    left = materialize(left.filter(F.col("size") > LISTED).select("node", "root", "least").distinct(), "near-large")
    if left.isEmpty():
        return found
    parts = components(left.select(F.col("node").alias("a"), F.col("least").alias("b")))
    nodes = left.select("node", "root").distinct().join(parts.withColumnRenamed("root", "part"), "node", "left")
    nodes = materialize(nodes.withColumn("part", F.coalesce("part", "node")), "near-parts")
    sizes = materialize(nodes.groupBy("part").agg(F.count("*").alias("size"), F.expr(f"count(*) div {CROWD_BLOCK} + 1").alias("blocks")), "near-sizes")
    placed = join_groups(nodes, sizes, "part", "size", ["blocks"], ["node"])
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = placed.select("node", "root", "part", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("node", "root", "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        sets = [np.asarray(x, np.int64) for x in pdf["shingles"]]
        found = _block_links(pdf["node"].to_numpy(), pdf["root"].to_numpy(), pdf["side"].to_numpy(), sets, similarity)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return found.union(dealt.join(sets.select("node", "shingles"), "node").groupBy("part", "i", "j").applyInPandas(compare, "a long, b long"))


def _labelled(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column]:
    """((key, id, text), the id's Column): id is a node's number, one for each id and text. Where no id is repeated it is
    the id itself; else a hash of both, with a seed under which no two nodes share a number. Rows without an id have
    none."""
    text_batches(docs.sparkSession)
    key, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(key.alias("key"), text.alias("text")).filter("key IS NOT NULL")
    if base.groupBy("key").count().filter("count > 1").isEmpty():
        return base.select("key", F.col("key").alias("id"), "text"), key
    base = base.distinct()
    for seed in range(64):
        number = lambda k, t, seed=seed: F.xxhash64(F.lit(seed), k, t)
        rows = base.select("key", number(F.col("key"), F.col("text")).alias("id"), "text")
        if rows.groupBy("id").count().filter("count > 1").isEmpty():
            return rows, F.when(key.isNotNull(), number(key, text))
    raise ValueError("no seed tells all rows apart")


def _print_links(points: DataFrame, base: DataFrame, shingle: int, similarity: float, radius: int) -> DataFrame:
    """(a, b) for points(node, n, fp), all texts: near copies among those that Golay keys of the word fingerprints link within
    ``radius`` bits. Equal fingerprints are one node, however many texts have them, and each of these is compared with the
    first. Pairs that cannot be near copies by their numbers of shingles are passed over."""
    nodes = materialize(points.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("size")), "near-points")
    met = links(nodes.select(F.col("least").alias("node"), "fp"), radius)
    alike = join_groups(points.select("node", "fp"), nodes.filter("size > 1"), "fp", "size", ["least"], ["node"]).filter("node <> least")
    pairs = met.union(alike.select(F.col("least").alias("a"), F.col("node").alias("b")))
    one, two = points.select(F.col("node").alias("a"), F.col("n").alias("n1")), points.select(F.col("node").alias("b"), F.col("n").alias("n2"))
    sized = pairs.join(one, "a").join(two, "b").filter(F.least("n1", "n2") >= similarity * F.greatest("n1", "n2") - 1e-6)
    pairs = materialize(sized.select("a", "b"), "near-printed")
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = materialize(_cut_sets(join_checked(base, ends, ["id"], "left_semi", "near-printed-ends"), shingle), "near-printed-shingles")
    found = materialize(_verified(pairs, sets, similarity), "near-print-links")
    release(sets)
    return found


def _shared(rooted: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For rooted(node, root, n, prefix): the pairs (a, b) of groups of up to SMALL texts that share a shingle, the rows of
    larger groups, and the shingles (h) that over SMALL texts share. Groups whose texts are all joined are left out."""
    each = rooted.select("node", "root", "n", F.posexplode("prefix").alias("pos", "h"))
    held = join_groups(each, materialize(_of_roots(each), "near-shared"), "h", "size", ["size", "least_n"], ["node"])
    held = materialize(held.filter(_some_partner(similarity)), "near-held")
    large = held.filter(F.col("size") > SMALL)
    sized = materialize(_by_size(large, similarity), "near-sized")
    columns = ["h", "node", "root", "n", "pos"]
    small = held.filter(F.col("size") <= SMALL).select(columns).union(sized.filter(F.col("size") <= SMALL).select(columns))
    return _near_pairs(small, similarity), sized.filter(F.col("size") > SMALL), large.select("h").distinct()


def _near_links(base: DataFrame, shingle: int, similarity: float, radius: int) -> DataFrame:
    """(a, b) for base(id, text) with distinct ids: links that join all that near copies join. The fingerprints of all texts
    link first (_print_links()); shared shingles of the prefixes then find the pairs that those left apart."""
    common, crowded = _common(base, shingle), np.zeros(SLOTS >> 6, np.uint64)
    points = materialize(_prefixes(base, shingle, similarity, common, crowded), "near-prefixes")
    groups = points.groupBy("same").agg(F.min("node").alias("least"), F.count("*").alias("size")).filter("size > 1")
    equal = join_groups(points.select("node", "same"), materialize(groups, "near-same"), "same", "size", ["least"], ["node"])
    equal = materialize(equal.filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")), "near-equal")
    single = join_checked(points.drop("same"), equal.select(F.col("a").alias("node")), ["node"], "left_anti", "near-others")
    printed = _print_links(single.select("node", "n", "fp"), base, shingle, similarity, radius)
    rooted = join_checked(single.drop("fp"), components(printed), ["node"], "left", "near-roots")
    rooted = rooted.select("node", F.coalesce("root", "node").alias("root"), "n", "prefix")
    # Two near copies meet in a small group, or both are in the crowd of large ones: only the crowd needs another order,
    # in which the shingles of its groups come last. It ends when the crowd is no longer halved.
    pairs, before = None, None
    while True:
        small, sized, large = _shared(rooted, similarity)
        pairs = small if pairs is None else pairs.union(small)
        crowd = materialize(sized.select("node", "root").distinct(), "near-crowded")
        texts = crowd.count()
        if not texts or (before is not None and 2 * texts > before):
            break
        before = texts
        crowded = crowded | _slots(large)
        again = join_checked(base, crowd.select(F.col("node").alias("id")), ["id"], "left_semi", "near-crowd-texts")
        again = _prefixes(again, shingle, similarity, common, crowded).select("node", "n", "prefix")
        rooted = materialize(join_checked(again, crowd, ["node"], "inner", "near-crowd-roots").select("node", "root", "n", "prefix"), "near-again")
    pairs = materialize(pairs.distinct(), "near-pairs")
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = materialize(_cut_sets(join_checked(base, ends, ["id"], "left_semi", "near-ends"), shingle), "near-shingles")
    sure = materialize(_verified(pairs, sets, similarity).union(printed).union(equal), "near-sure")
    if not texts:
        return sure
    return sure.union(_crowd_links(crowd, sure, base, shingle, similarity))


def _members(base: DataFrame, shingle: int, similarity: float, radius: int) -> DataFrame:
    """(id, key, root) for base(key, id, text): all nodes of groups but each group's first by (key, id), with its key."""
    found = materialize(components(_near_links(base.select("id", "text"), shingle, similarity, radius)), "near-found")
    whole = found.union(found.select(F.col("root").alias("node"), "root")).distinct().toDF("id", "group")
    named = join_checked(base.select("id", "key"), whole, ["id"], "inner", "near-whole")
    named = materialize(named, "near-named")
    first = named.groupBy("group").agg(F.min(F.struct("key", "id")).alias("first"), F.count("*").alias("size"))
    placed = join_groups(named, materialize(first, "near-firsts"), "group", "size", ["first"], ["id"])
    return placed.filter(F.col("id") != F.col("first.id")).select("id", "key", F.col("first.key").alias("root"))


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    radius: int = 9,
) -> DataFrame:
    """(node, root): the ids of documents that are near copies of an earlier one, with the smallest id of their group.

    A link is a pair whose full sets of ``shingle``-word shingles have a Jaccard similarity of at least ``similarity``; groups
    are the components of all links. Texts with equal sets are one from the start. No link is missed: the others are
    found by a common shingle of their prefixes (_prefixes()), all pairs of groups of up to SMALL texts and, in
    _crowd_links(), those of larger ones. Rows without an id are in no group; rows that repeat an id with another text are
    documents of their own, rows that repeat both are one. A null text counts as empty: empty texts are equal. Other
    columns are ignored; an empty table gives no rows.
    """
    base, _ = _labelled(docs, id_col, text_col)
    return _members(base, shingle, similarity, radius).select(F.col("key").alias("node"), "root")


def keep_first(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 9
) -> DataFrame:
    """The rows of ``docs``, all columns, without the near copies of an earlier document (near_groups()). Of rows that
    repeat an id and text one stays at most; rows without an id all stay."""
    base, number = _labelled(docs, id_col, text_col)
    node, gone_node = fresh(docs, "node"), fresh(docs, "near_copy")
    gone = _members(base, shingle, similarity, radius).select(F.col("id").alias(gone_node))
    if base.select("id").filter("id <> key").isEmpty():
        return join_checked(docs, gone, number == F.col(gone_node), "left_anti", "near-copies")
    left = join_checked(docs.withColumn(node, number), gone, F.col(node) == F.col(gone_node), "left_anti", "near-copies")
    named = left.filter(F.col(node).isNotNull()).dropDuplicates([node])
    return named.union(left.filter(F.col(node).isNull())).drop(node)
