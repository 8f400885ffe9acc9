"""Tamper evidence: each evidence row's digest is chained to the one before.

Chains run per source and are sealed in parallel; the sorted heads are folded to one root. ``mode="global"`` makes
the one chain over all rows instead. A chain's fold is serial by definition: it moves only ids and digests, and a task gets
one block of it at most, however long the chain is.
Verification is parallel in both modes: each check needs only the stored value before.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..staging import materialize, shared_dir

GENESIS = hashlib.sha256(b"genesis").hexdigest()


def content_sha256(body: Column) -> Column:
    return F.sha2(body.cast("binary"), 256)


def row_digest() -> Column:
    parts = ("lane", "source_ref", F.coalesce(F.col("source_offset").cast("string"), F.lit("-")), F.col("ingested_at").cast("string"), "content_sha256")
    return F.sha2(F.concat_ws("\n", *parts), 256)


def link(previous: Column, digest: Column) -> Column:
    return F.sha2(F.concat_ws("\n", previous, digest), 256)


def _keys(mode: str) -> list[str]:
    if mode not in ("source", "global"):
        raise ValueError(f"unknown mode: {mode!r}")
    return ["lane", "source_ref"] if mode == "source" else []


#: A task folds so many rows of a chain at most: a longer chain goes in rounds, each of which begins at the head of the one before.
BLOCK = 1 << 20


def _fold(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows(id, keys, head, digest) -> (id, sealed, keys): each chain in id order from its head."""
    names = ["id", "sealed", *keys]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain_of, value = None, None
        for pdf in batches:
            out = []
            for *own, head, digest in zip(*(pdf[k] for k in (*keys, "head", "digest")), strict=True):
                if own != chain_of:
                    chain_of, value = own, head
                value = hashlib.sha256(f"{value}\n{digest}".encode()).hexdigest()
                out.append(value)
            yield pdf.assign(sealed=out)[names]

    dealt = rows.repartition(*[F.col(k) for k in keys]) if keys else rows.repartition(1)
    dealt = dealt.select("id", *keys, "head", "digest").sortWithinPartitions(*keys, "id")
    return dealt.mapInPandas(fold, ", ".join(["id long", "sealed string", *[f"{k} string" for k in keys]]))


def _met(rows: DataFrame, few: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join with one row for each of some chains."""
    if keys:
        return rows.join(F.broadcast(few), keys, how)
    return rows.crossJoin(F.broadcast(few))


def _in_rounds(rows: DataFrame, long: DataFrame, longest: int, keys: list[str], block: int) -> DataFrame:
    """(id, sealed) for rows(id, keys, head, digest) of the chains ``long``(keys). Each chain's ids are cut at quantiles into as
    many parts as the longest one needs, which are read one after another."""
    spark, n = rows.sparkSession, -(-longest // block)
    rows = _met(rows, long, keys, "left_semi") if keys else rows
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("id", [k / n for k in range(1, n)], 10_000).alias("cuts"))
    cuts = materialize(cuts, "chain-cuts")
    path = f"{shared_dir(spark)}/chain-rounds-{uuid.uuid4().hex}"
    placed = _met(rows, cuts, keys, "inner").withColumn("round", F.size(F.filter("cuts", lambda c: c < F.col("id"))))
    placed.drop("cuts").write.partitionBy("round").parquet(path)
    rows = spark.read.parquet(path)
    parts, now = [], None
    for k in range(n):
        part = rows.filter(F.col("round") == k).drop("round")
        if now is not None:
            part = _met(part, now, keys, "left").withColumn("head", F.coalesce("now", "head")).drop("now")
        parts.append(materialize(_fold(part, keys), "chain-part"))
        last = parts[-1].groupBy(*keys).agg(F.max_by("sealed", "id").alias("now"))
        if now is not None:
            # A chain without rows in this part keeps its head.
            last = now.withColumn("old", F.lit(True)).unionByName(last.withColumn("old", F.lit(False)))
            last = last.groupBy(*keys).agg(F.min_by("now", F.when(F.col("now").isNotNull(), F.col("old"))).alias("now"))
        now = materialize(last, "chain-now")
    return reduce(DataFrame.union, [p.select("id", "sealed") for p in parts])


def seal(raw: DataFrame, mode: str = "source", genesis: str = GENESIS, block: int = BLOCK) -> DataFrame:
    """Fills chain_sha256 in rows without it, in id order from each chain's head. Sealing again changes nothing. Chains of up to
    ``block`` rows are folded side by side; longer ones, serial as they are, by rounds of about ``block`` rows of each."""
    keys = _keys(mode)
    heads = raw.filter("chain_sha256 IS NOT NULL").groupBy(*keys).agg(F.max_by("chain_sha256", "id").alias("head"))
    # The fold moves ids and digests, never bodies.
    todo = raw.filter("chain_sha256 IS NULL").select("id", *keys, row_digest().alias("digest"))
    todo = todo.join(heads, keys, "left") if keys else todo.crossJoin(F.broadcast(heads))
    todo = todo.withColumn("head", F.coalesce("head", F.lit(genesis)))
    long = materialize(raw.filter("chain_sha256 IS NULL").groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > block), "chain-long")
    longest = long.agg(F.max("n")).first()[0]
    if longest is None:
        sealed = _fold(todo, keys).select("id", "sealed")
    else:
        sealed = _in_rounds(todo, long.select(*keys), longest, keys, block)
        if keys:
            sealed = sealed.union(_fold(_met(todo, long.select(*keys), keys, "left_anti"), keys).select("id", "sealed"))
    return raw.join(sealed, "id", "left").withColumn("chain_sha256", F.coalesce("chain_sha256", "sealed")).select(*raw.columns)


def heads(raw: DataFrame, mode: str = "source") -> DataFrame:
    """(keys, head, sealed, unsealed) of each chain."""
    return raw.groupBy(*_keys(mode)).agg(
        F.max_by("chain_sha256", F.when(F.col("chain_sha256").isNotNull(), F.col("id"))).alias("head"),
        F.count("chain_sha256").alias("sealed"),
        F.count_if(F.col("chain_sha256").isNull()).alias("unsealed"),
    )


def root(raw: DataFrame) -> DataFrame:
    """One digest over the sources' heads, in order of lane and source: one short line for each source."""
    rows = heads(raw).filter("head IS NOT NULL").select(F.concat_ws("\n", "lane", "source_ref", "head").alias("line"))
    return rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("root"))


#: Ids of a range that is checked together.
SPAN = 100_000


def verify(raw: DataFrame, deletions: DataFrame, mode: str = "source", genesis: str = GENESIS, span: int = SPAN) -> DataFrame:
    """Breaks: (id, kind, explained). ``body``: the body isn't what was hashed; ``chain``: the row does not follow from
    the stored value before. A purge that recorded that value explains a hole."""
    keys = _keys(mode)
    sealed = raw.filter("chain_sha256 IS NOT NULL")
    named = [F.coalesce(k, F.lit("")).alias(k) for k in keys]
    narrow = sealed.select("id", *named, "chain_sha256", row_digest().alias("digest"), (F.col("content_sha256") != content_sha256(F.col("body"))).alias("edited"))
    # A chain's order goes by ranges of ids: within a range lag() finds the value before, and a range's first row takes the
    # last value of the chain's ranges before, one small row each. No task gets a whole chain.
    ranged = narrow.withColumn("range", F.expr(f"id div {span}"))
    ends = ranged.groupBy(*keys, "range").agg(F.max_by("chain_sha256", "id").alias("end"))
    ends = ends.select(*keys, "range", F.lag("end").over(W.partitionBy(*keys).orderBy("range")).alias("end_before"))
    inside = F.lag("chain_sha256").over(W.partitionBy(*keys, "range").orderBy("id"))
    checked = ranged.withColumn("inside", inside).join(ends, [*keys, "range"]).withColumn("previous", F.coalesce("inside", "end_before", F.lit(genesis)))
    broken = checked.withColumn("off", link(F.col("previous"), F.col("digest")) != F.col("chain_sha256")).filter("edited OR off")
    kinds = F.array_compact(F.array(F.when(F.col("edited"), "body"), F.when(F.col("off"), "chain")))
    # A purge's hole: the row after it follows from the value that the purge recorded.
    holes = deletions.filter("chain_before IS NOT NULL").select(F.col("chain_before").alias("previous")).distinct().withColumn("purged", F.lit(True))
    out = broken.join(holes, "previous", "left").select("id", F.explode(kinds).alias("kind"), "purged")
    return out.select("id", "kind", F.coalesce((F.col("kind") == "chain") & F.col("purged"), F.lit(False)).alias("explained")).orderBy("id", "kind")


def verdict(breaks: DataFrame) -> DataFrame:
    """``intact``, ``accounted for`` or ``unexplained``."""
    counted = breaks.agg(F.count("*").alias("breaks"), F.count_if(~F.col("explained")).alias("unexplained"))
    word = F.when(F.col("breaks") == 0, "intact").when(F.col("unexplained") == 0, "accounted for").otherwise("unexplained")
    return counted.withColumn("verdict", word)


def head_matches(raw: DataFrame, kept: str) -> DataFrame:
    """Whether the root is the one that was kept elsewhere: a rewrite that was sealed again shows only here."""
    return root(raw).select((F.col("root") == kept).alias("matches"))
