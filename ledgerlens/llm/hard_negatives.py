"""Hard-negative mining: for anchors and their best positives, the best rows of other labels in a window of scores.

Scores are inner products of vectors scaled and rounded down to integers, so they are exact. The rows are indexed by a
GNAT (``gnat.Tree``): split points from at most SAMPLE rows, every row dealt to its leaf, ranges gathered over all rows.
A leaf is cut in blocks of about BLOCK rows. A search has two steps: a query first meets the block it lies in
itself, which bounds the score its answers have at least; then all blocks of the leaves that the bounded window's
annulus can't rule out are scored row by row, so the answers are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_batches
from .gnat import Tree

#: Rows from which split points are chosen, the tree's width and most levels: at most FANOUT ** LEVELS leaves.
SAMPLE, FANOUT, LEVELS = 4096, 16, 3
#: Rows of a block, about.
BLOCK = 4096
SCALE = 256
TOP = (1 << 63) - 1
#: Sums under this are exact in floating point.
EXACT = 1 << 53

_PLACED = "kind byte, uid long, id long, label long, vec binary, leaf int, node int, child int, point int, low double, high double"
_STREAM = "leaf int, block int, kind byte, uid long, id long, label long, vec binary, uids array<long>, labels array<long>, win_of array<int>, win_no array<int>, win_low array<long>, win_high array<long>"
ROW, RANGE, QUERY = 0, 1, 2
_NAMES = [c.split()[0] for c in _STREAM.split(", ")]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products as longs; those beyond a long are the least or largest long."""
    top = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if top < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
    return np.clip(whole(a) @ whole(b).T, -TOP - 1, TOP).astype(np.int64)


def _matrix(parts: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(parts), "<f8").reshape(-1, dim)


def _vectors(batches: Iterator[pa.RecordBatch], dim: int, scale: int) -> Iterator[pa.RecordBatch]:
    """uid, id, label, vec list -> vec as rounded doubles, shorter ones filled up with zeros; unfit rows go."""
    for b in batches:
        lists = b.column("vec")
        sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, np.int64)
        flat = lists.flatten()
        values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        full = np.zeros((len(sizes), dim))
        full[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
        with np.errstate(over="ignore", invalid="ignore"):
            full = np.floor(full * scale) + 0.0
        fit = np.isfinite(full).all(1)
        if flat.null_count:
            fit &= np.bincount(np.repeat(np.arange(len(sizes)), sizes)[flat.is_null().to_numpy(zero_copy_only=False)], minlength=len(sizes)) == 0
        keep = pa.array(fit)
        body = pa.array([r.tobytes() for r in full[fit]], pa.binary())
        yield pa.RecordBatch.from_arrays([*(b.column(c).filter(keep) for c in ("uid", "id", "label")), body], ["uid", "id", "label", "vec"])


def _place(batches: Iterator[pa.RecordBatch], tree: Tree, dim: int) -> Iterator[pa.RecordBatch]:
    """Rows with their leaf, then the ranges of all rows of the task."""
    names = [c.split()[0] for c in _PLACED.split(", ")]
    kinds = [pa.int8(), *[pa.int64()] * 3, pa.binary(), *[pa.int32()] * 4, *[pa.float64()] * 2]
    none = lambda n, k: pa.nulls(n, kinds[k])
    for b in batches:
        n = b.num_rows
        leaf = tree.place(_matrix(b.column("vec").to_pylist(), dim))
        row = [pa.array(np.full(n, ROW, np.int8)), *(b.column(c) for c in ("uid", "id", "label", "vec")), pa.array(leaf.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([*row, *(none(n, k) for k in range(6, 11))], names)
    found = list(zip(*tree.ranges(), strict=True))
    if found:
        n = len(found[0])
        of = [pa.array(c, k) for c, k in zip(found, kinds[6:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, RANGE, np.int8)), *(none(n, k) for k in range(1, 6)), *of], names)


def _packed(leaf: int, block: int, rows: np.ndarray, uids: list, labels: list, vectors: np.ndarray, windows: list) -> dict:
    flat = [(k, w["no"], w["low"], w["high"]) for k, r in enumerate(rows.tolist()) for w in windows[r]]
    of, no, low, high = zip(*flat, strict=True) if flat else ((), (), (), ())
    return {
        "leaf": leaf, "block": block, "kind": QUERY, "vec": vectors[rows].tobytes(), "uids": [uids[r] for r in rows.tolist()],
        "labels": [labels[r] for r in rows.tolist()], "win_of": of, "win_no": no, "win_low": low, "win_high": high,
    }


_TYPES = [pa.int32(), pa.int32(), pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 2, *[pa.list_(pa.int32())] * 2, *[pa.list_(pa.int64())] * 2]
_SCHEMA = pa.schema(list(zip(_NAMES, _TYPES, strict=True)))


def _route(batches: Iterator[pa.RecordBatch], tree: Tree, blocks: dict[int, int], dim: int, home: bool) -> Iterator[pa.RecordBatch]:
    """Queries (uid, label, vec, leaf, block, windows) -> packs of queries for each block they have to meet."""
    for b in batches:
        uids, labels, windows = (b.column(c).to_pylist() for c in ("uid", "label", "windows"))
        vectors = _matrix(b.column("vec").to_pylist(), dim)
        if home:
            at = np.array([b.column("leaf").to_numpy(), b.column("block").to_numpy()], np.int64).T
            spots = {(int(x), int(y)): np.flatnonzero((at == (x, y)).all(1)) for x, y in np.unique(at, axis=0)}
        else:
            least = np.array([min((w["low"] for w in ws), default=TOP) for ws in windows], np.float64)
            most = np.array([max((w["high"] for w in ws), default=-TOP) for ws in windows], np.float64)
            leaves = tree.search(vectors, least, most)
            spots = {(x, y): rows for x, rows in leaves.items() for y in range(blocks.get(x, 0))}
        out = [_packed(x, y, rows, uids, labels, vectors, windows) for (x, y), rows in spots.items()]
        for k in range(0, len(out), 64):
            yield pa.RecordBatch.from_pylist(out[k : k + 64], _SCHEMA)


def _best(found: np.ndarray, score: np.ndarray, ids: np.ndarray, uids: np.ndarray, most: int) -> np.ndarray:
    if len(found) > most:
        bar = np.partition(score[found], len(found) - most)[len(found) - most]
        found = found[score[found] >= bar]
    return found[np.lexsort((uids[found], ids[found], -score[found].astype(np.float64)))][:most] if len(found) else found


def _scan(batches: Iterator[pa.RecordBatch], dim: int, same: bool, most: int) -> Iterator[pa.RecordBatch]:
    """Rows and query packs sorted by block, rows first -> each window's ``most`` best rows of the block."""
    key, vecs, meta = None, [], []
    for b in batches:
        out: list[tuple] = []
        columns = [b.column(c).to_pylist() for c in _NAMES]
        for leaf, block, kind, uid, id_, label, vec, uids, labels, of, no, low, high in zip(*columns, strict=True):
            if (leaf, block) != key:
                key, vecs, meta, held = (leaf, block), [], [], None
            if kind == ROW:
                vecs.append(vec)
                meta.append((uid, TOP if id_ is None else id_, label))
                continue
            if not vecs:
                continue
            if held is None:
                held = _matrix(vecs, dim), *np.array(meta, np.int64).T
            rows, row_uid, row_id, row_label = held
            score = scores(_matrix([vec], dim), rows)
            for q, w, a, z in zip(of, no, low, high, strict=True):
                right = (row_label == labels[q]) & (row_uid != uids[q]) if same else row_label != labels[q]
                for k in _best(np.flatnonzero(right & (score[q] >= a) & (score[q] <= z)), score[q], row_id, row_uid, most).tolist():
                    out.append((uids[q], w, int(score[q, k]), int(row_uid[k]), meta[k][1]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["uid", "no", "score", "found", "found_id"])


def _search(rows: DataFrame, queries: DataFrame, tree: Tree, blocks: dict[int, int], dim: int, same: bool, most: int, home: bool) -> DataFrame:
    """-> (uid, no, rank, score, found, found_id): each window's best rows; ``home`` looks in the query's block only."""
    packs = queries.select("uid", "label", "vec", "leaf", "block", "windows").mapInArrow(
        partial(_route, tree=tree, blocks=blocks, dim=dim, home=home), _STREAM
    )
    both = rows.select("leaf", "block", F.lit(ROW).cast("byte").alias("kind"), "uid", "id", "label", "vec")
    both = both.unionByName(packs, allowMissingColumns=True).repartition("leaf", "block").sortWithinPartitions("leaf", "block", "kind")
    found = both.mapInArrow(partial(_scan, dim=dim, same=same, most=most), "uid long, no long, score long, found long, found_id long")
    order = Window.partitionBy("uid", "no").orderBy(F.desc("score"), "found_id", "found")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def _windows(no: Column | str, low: Column, high: Column) -> Column:
    return F.sort_array(F.collect_list(F.struct(F.col(no).alias("no") if isinstance(no, str) else no.alias("no"), low.alias("low"), high.alias("high"))))


def mine(
    rows: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int] = (30, 90),
    scale: int = SCALE,
    fanout: int = FANOUT,
    block: int = BLOCK,
    levels: int | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``anchors`` holds.

    A row's score is its inner product with the anchor after each component x has become floor(scale * x). An anchor's
    positives are its ``positives`` best other rows of the same label; for each, the ``negatives`` best rows of other labels whose
    score is ``window`` hundredths of the positive's. Ties go by the smaller id; null ids come last and are given out as
    null. Rows with a null label, a null vector or a null or non-finite component (before or after scaling) take no part; shorter vectors are
    filled up with zeros. Repeated rows are rows of their own, so a copy of an anchor may be its positive. Other
    columns are ignored; without anchors or rows there are no results.
    """
    spark = rows.sparkSession
    text_batches(spark)
    base = rows.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(anchors, F.lit(False)).alias("anchor"),
    ).filter("label IS NOT NULL AND vec IS NOT NULL")
    base = materialize(base, "op13-base")  # fixes the rows' numbers
    count, dim = base.agg(F.count("*"), F.max(F.size("vec"))).first()
    dim = max(dim or 0, 1)
    fit = base.select("uid", "id", "label", "vec").mapInArrow(partial(_vectors, dim=dim, scale=scale), "uid long, id long, label long, vec binary")
    sample = fit.select("vec", F.xxhash64("id", "vec").alias("h")).orderBy("h").limit(SAMPLE).select("vec").toArrow().column("vec").to_pylist()
    if levels is None:
        levels = next((n for n in range(1, LEVELS) if count <= BLOCK * FANOUT**n), LEVELS)
    tree = Tree(_matrix(sample, dim), fanout, levels)
    placed = materialize(fit.mapInArrow(partial(_place, tree=tree, dim=dim), _PLACED), "op13-placed")
    # As many as the tree has parts, whatever the rows are.
    ranges = placed.filter(f"kind = {RANGE}").groupBy("node", "child", "point").agg(F.min("low"), F.max("high"))
    tree.widen(map(tuple, ranges.collect()))
    sizes = placed.filter(f"kind = {ROW}").groupBy("leaf").count()
    blocks = {r["leaf"]: -(-r["count"] // block) for r in sizes.collect()}
    of_leaf = F.element_at(F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv]), F.col("leaf")) if blocks else F.lit(1)
    indexed = placed.filter(f"kind = {ROW}").select(
        "uid", "id", "label", "vec", "leaf", F.pmod(F.xxhash64("uid"), of_leaf.cast("long")).cast("int").alias("block")
    )
    asking = indexed.join(base.filter("anchor").select("uid"), "uid", "left_semi")
    search = partial(_search, indexed, tree=tree, blocks=blocks, dim=dim)

    whole = F.array(F.struct(F.lit(0).alias("no"), F.lit(-TOP).alias("low"), F.lit(TOP).alias("high")))
    near = search(asking.withColumn("windows", whole), same=True, most=positives, home=True)
    near = near.filter(f"rank = {positives}").select("uid", F.col("score").alias("bar"))
    bounded = F.array(F.struct(F.lit(0).alias("no"), F.coalesce("bar", F.lit(-TOP)).alias("low"), F.lit(TOP).alias("high")))
    best = search(asking.join(near, "uid", "left").withColumn("windows", bounded), same=True, most=positives, home=False)
    best = materialize(best.select("uid", F.col("rank").alias("no"), F.col("score").alias("ps"), F.col("found_id").alias("pid")), "op13-positives")

    # Whole hundredths, in decimals that hold any long times 100.
    ps = F.col("ps").cast("decimal(20,0)")
    best = best.select("*", F.ceil(ps * window[0] / 100).cast("long").alias("low"), F.floor(ps * window[1] / 100).cast("long").alias("high")).filter("low <= high")
    asked = best.groupBy("uid").agg(_windows("no", F.col("low"), F.col("high")).alias("windows"))
    near = search(asking.join(asked, "uid"), same=False, most=negatives, home=True)
    near = near.filter(f"rank = {negatives}").select("uid", "no", F.col("score").alias("bar"))
    tight = best.join(near, ["uid", "no"], "left").groupBy("uid").agg(_windows("no", F.coalesce("bar", "low"), F.col("high")).alias("windows"))
    worst = search(asking.join(tight, "uid"), same=False, most=negatives, home=False)

    of_anchor = base.filter("anchor").select("uid", F.col("id").alias("anchor_id"))
    named = worst.join(best.select("uid", "no", "ps", "pid"), ["uid", "no"]).join(of_anchor, "uid")
    return named.select(
        "anchor_id", F.nullif("pid", F.lit(TOP)).alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.nullif("found_id", F.lit(TOP)).alias("negative_id"), F.col("ps").alias("positive_score"), F.col("score").alias("negative_score"),
    )


ORACLE_SQL = """
WITH fit AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same,
    CAST(list_inner_product(list_transform(a.v, lambda c: CAST(c AS DOUBLE)), list_transform(x.v, lambda c: CAST(c AS DOUBLE))) AS BIGINT) AS s
  FROM fit a JOIN fit x ON a.vec_id % 100 = 0 AND a.vec_id <> x.vec_id
), pos AS (
  SELECT anchor_id, vec_id AS positive_id, s AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, vec_id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.s AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.s DESC, n.vec_id) AS rank
  FROM pos p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 30 * p.positive_score <= 100 * n.s AND 100 * n.s <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 10
"""
