"""Exact dedup by content-defined chunk recipes. DataFrame functions only.

Each text is cut into chunks at places that its content chooses. Chunks are deduplicated to verified identifiers:
equal hashes are compared byte by byte (grouping on the chunk itself), and a hash that two different chunks share gets
an ordinal for each. Texts are then compared by their ordered identifier lists, so a long text crosses the network
once at most, as chunks that are already combined on the map side; everything later moves only identifiers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, join_checked, join_groups, materialize

MIN_CHUNK, MAX_CHUNK = 512, 4096

Hash = Callable[[Column], Column]


def chunk_pattern(least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> str:
    """A chunk ends at the first line end or clause end after ``least`` characters, at ``most`` or at the text's end.
    The second branch takes what the first can't, so every character is in one chunk."""
    return rf"(?s).{{{least},{most}}}?(?:\n|[.,;:!?|] )|.{{1,{most}}}"


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    return F.regexp_extract_all(text, F.lit(chunk_pattern(least, most)), F.lit(0))


def collisions(rows: DataFrame, chunk: str, hashed: str) -> DataFrame:
    """The hashes (``h``) that more than one distinct chunk has: none with a sound hash. Grouping on the chunk compares
    bytes; equal chunks are combined before the shuffle."""
    distinct = rows.select(F.col(hashed).alias("h"), F.col(chunk).alias("c")).distinct()
    return distinct.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")


def recipes(docs: DataFrame, least: int = MIN_CHUNK, most: int = MAX_CHUNK, hash_of: Hash = F.xxhash64) -> DataFrame:
    """docs(id, text), text not null -> (id, text_sha256, recipe array<string or long>). Two rows have equal recipes
    if and only if they have equal texts, whatever ``hash_of`` is."""
    cut = docs.select("id", "text", chunks(F.col("text"), least, most).alias("chunks"))
    each = cut.select(F.explode("chunks").alias("c")).select(hash_of(F.col("c")).alias("h"), "c")
    shared = materialize(collisions(each, "c", "h"), "op2-shared-hashes")
    plain = cut.select(
        "id",
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        F.transform("chunks", lambda c: hash_of(c)).alias("recipe"),
    )
    if shared.isEmpty():
        return plain
    # Some hash stands for two chunks: give its chunks ordinals, and look the chunks up by hash and bytes.
    ranked = (
        each.join(shared, "h", "left_semi")
        .distinct()
        .groupBy("h")
        .agg(F.array_sort(F.collect_set("c")).alias("all"))
        .select("h", F.posexplode("all").alias("ordinal", "c"))
    )
    placed = (
        cut.select("id", F.xxhash64("text").alias("t"), "text", F.posexplode("chunks").alias("pos", "c"))
        .select("id", "t", "text", "pos", hash_of(F.col("c")).alias("h"), "c")
        .join(ranked, ["h", "c"], "left")
        .select("id", "text", "pos", "h", F.coalesce("ordinal", F.lit(0)).alias("ordinal"))
    )
    listed = placed.groupBy("id", "text").agg(F.array_sort(F.collect_set(F.struct("pos", "h", "ordinal"))).alias("r"))
    back = cut.select("id", "text").join(
        listed.withColumnRenamed("id", "id2").withColumnRenamed("text", "text2"),
        F.col("id").eqNullSafe(F.col("id2")) & (F.col("text") == F.col("text2")),
        "left",
    )
    return back.select(
        "id",
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        F.coalesce(F.transform("r", lambda x: F.concat_ws(":", x["h"], x["ordinal"])), F.array().cast("array<string>")).alias("recipe"),
    )


def _normal(text: Column) -> Column:
    return ascii_lower(F.coalesce(text.cast("string"), F.lit("")))


def _grouped(docs: DataFrame, id_col: str, text_col: str, least: int, most: int, hash_of: Hash) -> DataFrame:
    """(id, text_sha256, n, keep_id, group_size): n rows repeat the id and text. What is written on the way is small."""
    listed = recipes(docs.select(F.col(id_col).alias("id"), _normal(F.col(text_col)).alias("text")), least, most, hash_of)
    rows = materialize(listed.groupBy("recipe", "id", "text_sha256").agg(F.count("*").alias("n")), "op2-recipes")
    groups = rows.groupBy("recipe").agg(F.max("id").alias("keep_id"), F.sum("n").cast("long").alias("group_size"))
    groups = materialize(groups, "op2-totals")
    return join_groups(rows, groups, "recipe", "group_size", ["keep_id", "group_size"], ["id", "n"])


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = MIN_CHUNK,
    most: int = MAX_CHUNK,
    hash_of: Hash = F.xxhash64,
) -> DataFrame:
    """One row for each row of ``docs``: (id_col, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after lower-casing A-Z only; the row with the largest id of a group stays. A null
    text counts as empty. Null ids are below all others (a group of null ids alone keeps one row, its keep_id null).
    Of rows that repeat an id and text, one is kept. Other columns are ignored; an empty table gives no rows.
    """
    grouped = _grouped(docs, id_col, text_col, least, most, hash_of)
    each = grouped.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return each.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that exact_groups() keeps. Of rows that repeat an id and text one stays,
    whichever comes first."""
    grouped = materialize(_grouped(docs, id_col, text_col, MIN_CHUNK, MAX_CHUNK, F.xxhash64), "op2-groups")
    i, h = fresh(docs, "dropped_id"), fresh(docs, "dropped_sha256")
    own = F.sha2(_normal(F.col(text_col)).cast("binary"), 256)
    # An id and the text's digest name a row; those to drop are the fewer ones.
    dropped = grouped.filter(~F.col("id").eqNullSafe(F.col("keep_id"))).select(F.col("id").alias(i), F.col("text_sha256").alias(h))
    left = join_checked(docs, dropped, F.col(id_col).eqNullSafe(F.col(i)) & (own == F.col(h)), "left_anti", "op2-dropped")
    if grouped.filter(F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n") > 1)).isEmpty():
        return left
    return left.withColumn(h, own).dropDuplicates([id_col, h]).drop(h)


ORACLE_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
