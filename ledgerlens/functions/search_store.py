"""A saved full-text index that is kept in step with its rows.

Postings (token, field, id, pos, version) are a table bucketed and sorted by token, so a search reads the buckets of its
tokens. A change writes the new postings of the changed ids to a second, equally bucketed table, and a tombstone for each
changed or deleted id; a posting holds unless a later tombstone names its id. A dictionary of the tokens, sorted, turns a
prefix into tokens. ``compact`` folds all of it into a new generation.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import shared_dir
from . import search

BUCKETS = 64
#: A prefix of so many tokens at most is read token by token, by buckets; a wider one as a range of each bucket.
PREFIX_TOKENS = 500


def _table(name: str, generation: int, part: str) -> str:
    return f"{name}_g{generation}_{part}"


def generation(spark: SparkSession, name: str) -> int:
    """The newest finished generation: its dictionary is written last."""
    found = [t.name for t in spark.catalog.listTables() if t.name.startswith(f"{name}_g") and t.name.endswith("_terms")]
    if not found:
        raise ValueError(f"no index {name!r}")
    return max(int(t.removeprefix(f"{name}_g").removesuffix("_terms")) for t in found)


def _save(rows: DataFrame, table: str, by: str, buckets: int, mode: str = "error") -> None:
    # A task has rows of one bucket, or of some small ones; one that is large, since a token is frequent, is written by several.
    path = f"{shared_dir(rows.sparkSession)}/{table}-{uuid.uuid4().hex}"
    dealt = rows.withColumn("bucket", F.pmod(F.hash(by), F.lit(buckets))).hint("rebalance", "bucket").drop("bucket")
    writer = dealt.write.mode(mode).bucketBy(buckets, by).sortBy(by)
    (writer if mode == "append" and rows.sparkSession.catalog.tableExists(table) else writer.option("path", path)).saveAsTable(table)


def _write(spark: SparkSession, name: str, number: int, postings: DataFrame, buckets: int) -> None:
    _save(postings, _table(name, number, "postings"), "token", buckets)
    _save(postings.limit(0), _table(name, number, "delta"), "token", buckets)
    _save(postings.limit(0).select("id", "version"), _table(name, number, "gone"), "id", buckets)
    terms = spark.table(_table(name, number, "postings")).select("token").distinct()
    path = f"{shared_dir(spark)}/{name}-terms-{uuid.uuid4().hex}"
    terms.repartitionByRange("token").sortWithinPartitions("token").write.option("path", path).saveAsTable(_table(name, number, "terms"))


def create(frame: DataFrame, name: str, id_col: str, fields: tuple[str, ...], buckets: int = BUCKETS) -> None:
    """Saves the index of ``frame`` as tables whose names begin with ``name``."""
    postings = search.inverted_index(frame, id_col, fields).withColumn("version", F.lit(0).cast("long"))
    _write(frame.sparkSession, name, 0, postings, buckets)


def change(name: str, changed: DataFrame, id_col: str, fields: tuple[str, ...], version: int, deleted: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Takes in rows that are new or have changed, and forgets ids of ``deleted``(id_col). ``version`` must grow from change
    to change. Running a change again with its version alters nothing in what a search finds."""
    spark = changed.sparkSession
    number = generation(spark, name)
    postings = search.inverted_index(changed, id_col, fields).withColumn("version", F.lit(version).cast("long"))
    gone = changed.select(F.col(id_col).alias("id"))
    gone = gone if deleted is None else gone.union(deleted.select(F.col(id_col).alias("id")))
    # Postings first: until the tombstones are there, both states of a row are found, never none.
    _save(postings, _table(name, number, "delta"), "token", buckets, "append")
    _save(gone.distinct().withColumn("version", F.lit(version).cast("long")), _table(name, number, "gone"), "id", buckets, "append")


def live(spark: SparkSession, name: str) -> DataFrame:
    """All postings that hold."""
    number = generation(spark, name)
    gone = spark.table(_table(name, number, "gone")).groupBy("id").agg(F.max("version").alias("until"))
    parts = [spark.table(_table(name, number, p)) for p in ("postings", "delta")]
    # Each part by itself, so a search's tokens choose the buckets of both.
    held = [p.join(gone.withColumnRenamed("id", "gone_id"), (F.col("id") == F.col("gone_id")) & (F.col("version") < F.col("until")), "left_anti") for p in parts]
    return reduce(DataFrame.unionByName, held)


def tokens_of(spark: SparkSession, name: str, prefix: str) -> list[str] | None:
    """The tokens with the prefix; None if there are more than PREFIX_TOKENS."""
    number = generation(spark, name)
    new = spark.table(_table(name, number, "delta")).select("token")
    known = spark.table(_table(name, number, "terms")).union(new).filter(F.startswith("token", F.lit(prefix))).distinct()
    found = [r["token"] for r in known.limit(PREFIX_TOKENS + 1).collect()]
    return None if len(found) > PREFIX_TOKENS else found


def find(spark: SparkSession, name: str, query: str) -> DataFrame:
    """Distinct ids for the query, as ``search.search_index`` gives over all postings."""
    wanted = search.terms(query)
    index = live(spark, name)
    if wanted:
        exact = [t for tokens in wanted for t in tokens][:-1]
        ends = tokens_of(spark, name, wanted[-1][-1])
        test = F.startswith("token", F.lit(wanted[-1][-1])) if ends is None else F.col("token").isin(*ends)
        index = index.filter(test | F.col("token").isin(*exact)) if exact else index.filter(test)
    return search.search_index(index, query).distinct()


def compact(spark: SparkSession, name: str, buckets: int = BUCKETS) -> None:
    """Writes what holds as a new generation, which searches use from then on; the old tables go last. A compaction that
    stopped halfway leaves the old generation in use, and is cleared by the next one."""
    number = generation(spark, name)
    for t in spark.catalog.listTables():
        if t.name.startswith(f"{name}_g{number + 1}_"):
            spark.sql(f"DROP TABLE {t.name}")
    _write(spark, name, number + 1, live(spark, name).distinct(), buckets)
    for part in ("terms", "postings", "delta", "gone"):
        spark.sql(f"DROP TABLE {_table(name, number, part)}")
