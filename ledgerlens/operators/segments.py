"""Chain segments: evidence digests folded in bounded ranges of ids, and a hash tree over the ranges' heads.

A source's chain is one serial fold. Here a fold covers SEGMENT ids at most, whatever source they are of, so segments are
sealed in parallel, and a source with most of the evidence is many segments. Heads are combined FAN at a time, level by level,
to one root; a row is proved to be under a root by its segment's digests and FAN - 1 neighbours on each level.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import materialize
from .chain import link, row_digest

SEGMENT, FAN = 1000, 16
START = hashlib.sha256(b"segment").hexdigest()


def heads(raw: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(number, head, rows): the fold of each range of ``size`` ids, in id order, over rows' digests."""
    rows = raw.select((F.col("id") / size).cast("long").alias("number"), F.struct("id", row_digest().alias("digest")).alias("r"))
    ordered = F.transform(F.array_sort(F.collect_list("r")), lambda r: r["digest"])
    return rows.groupBy("number").agg(F.aggregate(ordered, F.lit(START), link).alias("head"), F.count("*").alias("rows"))


def _parents(level: DataFrame, fan: int) -> DataFrame:
    """A node is the digest of its children's numbers and digests."""
    child = F.struct("number", F.concat_ws(":", F.col("number").cast("string"), "digest").alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(child)), lambda c: c["line"])
    return level.groupBy((F.col("number") / fan).cast("long").alias("n")).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest")).withColumnRenamed("n", "number")


def tree(raw: DataFrame, size: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """(level, number, digest) of all nodes. Each level is written, and has a ``fan``-th of the numbers below it; level 0 are
    the segments. The top level is the first with number 0 alone; no evidence gives no nodes."""
    level = materialize(heads(raw, size).select("number", F.col("head").alias("digest")), "segments")
    top = level.agg(F.max("number")).first()[0]
    nodes, n = level.withColumn("level", F.lit(0)), 0
    while top:
        level, top, n = materialize(_parents(level, fan), "segments"), top // fan, n + 1
        nodes = nodes.unionByName(level.withColumn("level", F.lit(n)))
    return nodes.select("level", "number", "digest")


def root(nodes: DataFrame) -> DataFrame:
    """(root, levels), one row if there is any node."""
    return nodes.groupBy().agg(F.max_by("digest", "level").alias("root"), (F.max("level") + 1).alias("levels")).filter("root IS NOT NULL")


def head_matches(nodes: DataFrame, kept: str) -> DataFrame:
    """Whether the root is the one that was kept elsewhere: a rewrite that was sealed again shows only here."""
    return root(nodes).select((F.col("root") == kept).alias("matches"))


def changed(nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """Numbers of segments whose head differs from the kept nodes', or that are on one side only."""
    a, b = (x.filter("level = 0").select("number", F.col("digest").alias(c)) for x, c in ((nodes, "now"), (kept, "then")))
    return a.join(b, "number", "full").filter(~F.col("now").eqNullSafe(F.col("then"))).select("number")


def proofs(nodes: DataFrame, wanted: DataFrame, size: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """wanted(id) -> (id, level, number, lines): for each level above the segments the node on the id's way, and its
    children's numbers and digests."""
    levels = nodes.agg(F.max("level")).first()[0] or 0
    steps = wanted.select("id", F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("level")) if levels else wanted.select("id", F.lit(0).alias("level")).limit(0)
    steps = steps.withColumn("number", (F.col("id") / F.lit(size)).cast("long"))
    for _ in range(levels):  # the ancestor on each level
        steps = steps.withColumn("number", F.when(F.col("level") > _, (F.col("number") / fan).cast("long")).otherwise(F.col("number")))
    child = F.struct("child", F.concat_ws(":", F.col("child").cast("string"), "digest").alias("line"))
    children = nodes.select((F.col("level") + 1).alias("level"), F.col("number").alias("child"), "digest").withColumn("number", (F.col("child") / fan).cast("long"))
    lined = children.groupBy("level", "number").agg(F.transform(F.array_sort(F.collect_list(child)), lambda c: c["line"]).alias("lines"))
    return steps.join(lined, ["level", "number"]).select("id", "level", "number", "lines")


def proved(proof: DataFrame, own: DataFrame, kept: Column, fan: int = FAN) -> DataFrame:
    """own(id, number, head): the segments' heads as folded from the rows at hand. (id, proved): whether each step holds the
    digest below it and the last one's digest is the kept root."""
    step = F.struct("level", "number", "lines", F.sha2(F.array_join("lines", "\n"), 256).alias("digest"))
    rows = proof.groupBy("id").agg(F.array_sort(F.collect_list(step)).alias("steps")).join(own.withColumnRenamed("number", "segment"), "id", "right")
    start = F.struct(F.col("segment").alias("number"), F.col("head").alias("digest"), F.lit(True).alias("good"))
    line = lambda a: F.concat_ws(":", a["number"].cast("string"), a["digest"])
    step_on = lambda a, s: F.struct(s["number"].alias("number"), s["digest"].alias("digest"), (a["good"] & F.array_contains(s["lines"], line(a))).alias("good"))
    end = F.aggregate(F.coalesce("steps", F.array().cast("array<struct<level:int,number:bigint,lines:array<string>,digest:string>>")), start, step_on)
    return rows.select("id", (end["good"] & (end["digest"] == kept)).alias("proved"))
