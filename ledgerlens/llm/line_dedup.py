"""Line dedup by content-defined line chunks. DataFrame functions only.

A text's lines are hashed, and a rolling hash over each line and the one before it says where a chunk starts, so
an insertion moves the boundaries near it and no others. A chunk of several lines that occurs more than once in the
corpus is removed everywhere but at its first occurrence. Hashes find the repeats; chunks of equal hashes are compared
byte by byte before any is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_checked, join_groups, materialize
from .exact_dedup import Hash, collisions

#: One line in so many starts a chunk.
DIVISOR = 3
#: The rolling hash is (previous % PRIME) * FACTOR + (this % PRIME).
PRIME, FACTOR = 1_000_003, 7


def line_hash(line: Column) -> Column:
    """The first 60 bits of MD5, as a long: the same in any SQL engine."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 15), 16, 10).cast("long")


def marked_chunks(text: Column, divisor: int = DIVISOR) -> Column:
    """array<string> of chunks. Each line is prefixed with ``n`` where it starts a chunk and with ``c`` where it
    goes on; since every line has its prefix, a chunk starts exactly where ``n`` follows a line end."""
    lines = F.split(text, "\n", -1)
    hashes = F.transform(lines, lambda x: line_hash(x) % PRIME)
    before = F.concat(F.array(F.lit(None).cast("long")), F.slice(hashes, 1, F.size(hashes) - 1))
    start = F.zip_with(
        before, hashes, lambda a, b: F.when(a.isNull() | ((a * FACTOR + b) % divisor == 0), "n").otherwise("c")
    )
    return F.split(F.array_join(F.zip_with(start, lines, lambda p, x: F.concat(p, x)), "\n"), "\n(?=n)", -1)


def plain(chunk: Column) -> Column:
    return F.regexp_replace(chunk, "(^|\n)[nc]", "$1")


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    divisor: int = DIVISOR,
    hash_of: Hash = F.xxhash64,
) -> DataFrame:
    """One row for each row of ``docs``: (id_col, n_lines, n_removed_lines, n_removed_chunks, kept_text).

    The first occurrence is the one with the smallest (id, text hash, place); a null id is below all others. Rows that
    repeat an id and text are one document and give the same result. A null text counts as empty: one empty line, never
    removed. Other columns are ignored; an empty table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("t", F.xxhash64("text"))
    at = base.select("id", "t", F.posexplode(marked_chunks(F.col("text"), divisor)).alias("pos", "c"))
    lines = F.char_length("c") - F.char_length(F.replace("c", F.lit("\n"))) + 1
    at = at.filter(F.col("c").contains("\n")).select("id", "t", "pos", lines.alias("lines"), hash_of(F.col("c")).alias("h"), "c")
    at = materialize(at, "op9-chunks")
    # Equal chunks are combined before this shuffle, the only one that moves chunks; all others move hashes and places.
    shared = materialize(collisions(at, "c", "h"), "op9-shared-hashes")
    if shared.isEmpty():
        named = at.select("id", "t", "pos", "lines", F.col("h").alias("v"))
    else:
        ranked = (
            at.join(shared, "h", "left_semi").select("h", "c").distinct()
            .groupBy("h").agg(F.array_sort(F.collect_set("c")).alias("all"))
            .select("h", F.posexplode("all").alias("o", "c"))
        )
        named = at.join(ranked, ["h", "c"], "left").select(
            "id", "t", "pos", "lines", F.concat_ws(":", "h", F.coalesce("o", F.lit(0))).alias("v")
        )
    place = F.struct("id", "t", "pos")
    first = named.groupBy("v").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = materialize(first, "op9-repeats")
    # Rows that repeat an id and text name the same places: those are counted once.
    removed = (
        join_groups(named, first, "v", "n", ["first"], ["id", "t", "pos"])
        .filter(~place.eqNullSafe(F.col("first")))
        .groupBy("id", "t")
        .agg(F.collect_set(F.struct("pos", "lines")).alias("gone"))
        .select(F.col("id").alias("id2"), F.col("t").alias("t2"), "gone")
    )
    joined = join_checked(base, removed, F.col("id").eqNullSafe(F.col("id2")) & (F.col("t") == F.col("t2")), "left", "op9-removed")
    # Texts that lose nothing are passed on as they are; the others are cut once more.
    places = F.transform("gone", lambda g: g["pos"])
    kept = F.transform(F.filter(marked_chunks(F.col("text"), divisor), lambda c, i: ~F.array_contains(places, i)), plain)
    n_lines = (F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"))) + 1).cast("long")
    lost = F.aggregate("gone", F.lit(0), lambda n, g: n + g["lines"]).cast("long")
    return joined.select(
        F.col("id").alias(id_col),
        n_lines.alias("n_lines"),
        F.coalesce(lost, F.lit(0)).cast("long").alias("n_removed_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed_chunks"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )


ORACLE_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 15))::BIGINT % {PRIME} AS x FROM l),
s AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS px FROM h),
b AS (SELECT *, sum(CASE WHEN px IS NULL OR (px * {FACTOR} + x) % {DIVISOR} = 0 THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id ORDER BY i) AS chunk FROM s),
c AS (SELECT doc_id, chunk, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS n FROM b GROUP BY ALL),
r AS (SELECT *, CASE WHEN n > 1 THEN row_number() OVER (PARTITION BY body, n > 1 ORDER BY doc_id, chunk) ELSE 1 END > 1
        AS gone FROM c)
SELECT doc_id, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed_lines,
       count(*) FILTER (gone) AS n_removed_chunks,
       sha256(coalesce(string_agg(body, chr(10) ORDER BY chunk) FILTER (NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""
