"""Mixing sources to target weights by Poisson replication.

A source with n documents and target share w is given the mean repetition rate  rate = w * total / n.  Each document's
count is the inverse of the Poisson distribution of that mean at a uniform number made from a hash of its id and the
seed; the document is exploded by its count, and the result is shuffled globally by a second hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_checked

#: A larger rate is split: a sum of independent Poisson counts is a Poisson count. (exp(-rate) must stay a double.)
PART_RATE = 500.0
#: Rates of up to so many sources are broadcast.
MOST_BROADCAST = 20_000


def hashed(*parts: Column | str) -> Column:
    """60 bits of SHA-256 over the parts joined by ``:``, as a long: the same in any SQL engine."""
    joined = F.concat_ws(":", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.sha2(joined.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def poisson_steps(rate: Column) -> Column:
    """P(X <= k) of a Poisson variable for k = 0, 1, ... far into its tail: past rate + 12 * sqrt(rate) + 30 what is
    left is below the doubles' precision, so no count is cut off."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    grown = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf")),
        lambda s, k: F.struct(
            (s["p"] * rate / k).alias("p"),
            F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * rate / k)).alias("cdf"),
        ),
        lambda s: s["cdf"],
    )
    return F.when(rate <= 0, F.array(F.lit(1.0))).otherwise(grown)


def source_rates(
    docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, epochs: float = 1.0
) -> DataFrame:
    """(source, n, rate, parts, steps): one row for each source; steps are those of rate / parts. ``weights``: relative
    target shares by source; None gives all sources the same share, and a source that isn't named gets none. ``epochs``:
    rows out for each row in, on average."""
    counts = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight: Column = F.lit(1.0)
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        weight = F.coalesce(F.create_map(*pairs)[F.coalesce("source", F.lit(""))], F.lit(0.0)) if pairs else F.lit(0.0)
    counts = counts.withColumn("w", weight)
    # One row with the totals; the counts have a row for each source.
    totals = counts.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    rated = counts.crossJoin(F.broadcast(totals)).withColumn(
        "rate", F.coalesce(F.col("w") / F.nullif("all_w", F.lit(0.0)) * F.col("all_n") * epochs / F.col("n"), F.lit(0.0))
    )
    parts = F.greatest(F.ceil(F.col("rate") / PART_RATE), F.lit(1)).cast("long")
    return rated.select("source", "n", "rate", parts.alias("parts"), poisson_steps(F.col("rate") / parts).alias("steps"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: dict[str, float] | None = None,
    epochs: float = 1.0,
    seed: int = 7,
) -> DataFrame:
    """``docs``' columns, each row as often as its count says, with copy_no (from 1), n_copies and shuffle_key, dealt
    out by a hash of shuffle_key and sorted by it within a partition: every written file is a random part of the whole, in
    random order. (Ranges of the key would be sampled first, which runs the whole plan once more.)

    A null source is a source of its own (weight key ``""``); a null id hashes as empty; rows that repeat an id get equal
    counts. Columns of ``docs`` called like an added one are kept and the added one gets underscores in front.
    """
    k, u, steps, parts = (fresh(docs, x) for x in ("source_key", "uniform", "steps", "parts"))
    copy_no, n_copies, key = (fresh(docs, x) for x in ("copy_no", "n_copies", "shuffle_key"))
    rates = source_rates(docs, source_col, weights, epochs).select(
        F.col("source").alias(k), F.col("steps").alias(steps), F.col("parts").alias(parts)
    )
    source = F.col(source_col).cast("string")
    joined = join_checked(docs, rates, source.eqNullSafe(F.col(k)), "inner", "op6-rates", MOST_BROADCAST)
    uniform = lambda *more: hashed(F.lit(seed), F.lit("count"), id_col, *more).cast("double") / float(2**60)
    below = lambda v: F.size(F.filter(steps, lambda c: c <= v)).cast("long")
    # An array of one binds a part's number, so it is hashed once and not for each step.
    part_count = lambda part: F.get(F.transform(F.array(uniform(part)), below), F.lit(0))
    more = F.aggregate(F.sequence(F.lit(2).cast("long"), F.col(parts)), below(F.col(u)), lambda n, part: n + part_count(part))
    counted = joined.withColumn(u, uniform()).withColumn(n_copies, F.when(F.col(parts) > 1, more).otherwise(below(F.col(u))))
    copies = counted.filter(F.col(n_copies) > 0).withColumn(
        copy_no, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n_copies)))
    )
    mixed = copies.withColumn(key, hashed(F.lit(seed), F.lit("order"), id_col, copy_no)).drop(k, u, steps, parts)
    return mixed.repartition(key).sortWithinPartitions(key)


ORACLE_SQL = """
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, (1.0::DOUBLE / (SELECT count(*) FROM n)::DOUBLE * (SELECT sum(n) FROM n)::DOUBLE * 1.0::DOUBLE / n::DOUBLE) AS rate FROM n),
s AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM r
      UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM s
      WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
d AS (SELECT d.*, ('0x' || substr(sha256('7:count:' || doc_id), 1, 15))::BIGINT::DOUBLE / 1152921504606846976.0::DOUBLE AS u
      FROM documents d),
m AS (SELECT d.doc_id, count(*) AS n_copies FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source AND s.c <= d.u GROUP BY d.doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, unnest(range(1, n_copies + 1)) AS copy_no, n_copies,
  ('0x' || substr(sha256('7:order:' || d.doc_id || ':' || unnest(range(1, n_copies + 1))), 1, 15))::BIGINT AS shuffle_key
FROM d JOIN m ON m.doc_id = d.doc_id
"""
