"""Shared small pieces of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import materialize, release, shared_dir, text_batches  # noqa: F401  the operators take them from here

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What is broadcast has so many bytes at most, counted as JSON.
MOST_BYTES = 32 << 20


def join_checked(left: DataFrame, right: DataFrame, on: Column | list[str], how: str, label: str, most_rows: int = 200_000) -> DataFrame:
    """Joins a ``right`` that is written first and measured: up to ``most_rows`` rows and MOST_BYTES it is broadcast and
    ``left`` stays where it is; beyond that both are shuffled, and ``right`` is the hash table's side."""
    right = materialize(right, label)
    small = right.count() <= most_rows
    if small:
        size = F.sum(F.octet_length(F.to_json(F.struct(*right.columns))).cast("long"))
        small = (right.agg(size).first()[0] or 0) <= MOST_BYTES
    return left.join(F.broadcast(right) if small else right.hint("shuffle_hash"), on, how)


#: A group is large if it has over so many rows, and over one part in MOST_LARGE of all rows: so there are MOST_LARGE at most.
LARGE_ROWS, MOST_LARGE = 1000, 100_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, values: list[str], spread: list[str]) -> DataFrame:
    """``rows`` with the ``values`` of their group; rows without a group go. ``groups`` has one row for each key and is
    read three times: pass a written table.

    The values of large groups, at most MOST_LARGE rows, are broadcast, and those groups' rows are dealt by ``spread``
    and not by the key, so no task gets a large group. All other rows meet their group by a shuffle on the key.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    large = F.col(size) > max(LARGE_ROWS, total // MOST_LARGE)
    pack = F.struct(*values)
    hot = groups.filter(large).select(F.col(key).alias("hot_key"), pack.alias("hot"))
    # A number deals as well as a hash of it does, and shuffles in fewer bytes beside itself.
    own = F.col(key) if dict(rows.dtypes)[key] == "bigint" == dict(groups.dtypes)[key] else F.xxhash64(key)
    cold = groups.filter(~large).select(F.col(key).alias("cold_key"), own.alias("cold_hash"), pack.alias("cold"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left")
    dealt = marked.withColumn("row_hash", F.when(F.col("hot").isNull(), own).otherwise(F.xxhash64(*spread)))
    met = dealt.join(cold, (F.col("row_hash") == F.col("cold_hash")) & (F.col(key) == F.col("cold_key")), "left")
    found = met.withColumn("found", F.coalesce("hot", "cold")).filter("found IS NOT NULL")
    return found.select(*rows.columns, *[F.col("found")[v].alias(v) for v in values])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column of ``df`` is called that (case-insensitive)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure-ASCII values take the byte-wise path of lower(); the rest go through translate()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_LOWER)
    )
