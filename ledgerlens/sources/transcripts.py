"""Transcript files: listing, lines with byte offsets, incremental resume."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ranges import RANGE_BYTES, LineSource


def encoded(path: str) -> str:
    return path.replace("/", "-")


def project_hint(directory: Column) -> Column:
    """A directory name that starts with ``-``, decoded; the encoding loses the dashes of the path."""
    return F.when(directory.startswith("-"), F.translate(directory, "-", "/"))


def files(spark: SparkSession, root: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(source_ref, project, length, content binary) of every *.jsonl below ``root`` but those of excluded projects."""
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(root)
    )
    project = F.element_at(F.split("path", "/"), -2)
    out = found.select(F.col("path").alias("source_ref"), project.alias("project"), "length", "content")
    return out.filter(~F.col("project").isin(*map(encoded, excluded))) if excluded else out


def lines(found: DataFrame) -> DataFrame:
    """(source_ref, line_no, source_offset, body): complete lines only. Blank lines are skipped but count in offsets; a last
    line without its end is held back; invalid UTF-8 is replaced."""
    # Bytes as Latin-1 keep one character for one byte, so offsets are lengths.
    text = F.decode("content", "ISO-8859-1")
    cut = F.split(text, "\n", -1)
    each = found.filter("length > 0").select("source_ref", F.posexplode(F.slice(cut, 1, F.size(cut) - 1)).alias("line_no", "raw"))
    w = W.partitionBy("source_ref").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.char_length("raw").cast("long") + 1).over(w), F.lit(0).cast("long"))
    body = F.rtrim(F.make_valid_utf8(F.encode("raw", "ISO-8859-1").cast("string")), F.lit("\r"))
    out = each.withColumn("source_offset", offset).withColumn("body", body)
    return out.filter(F.trim("body") != "").select("source_ref", "line_no", "source_offset", "body")


def resume(all_lines: DataFrame, lengths: DataFrame, stored: DataFrame) -> DataFrame:
    """Lines from each file's last stored offset on; from the start where the file has become shorter than that (it was
    replaced). Content dedup makes the overlap harmless."""
    last = stored.filter("lane = 'transcript'").groupBy("source_ref").agg(F.max("source_offset").alias("last"))
    begin = lengths.select("source_ref", "length").join(last, "source_ref", "left").select(
        "source_ref", F.when(F.col("last") > F.col("length"), 0).otherwise(F.coalesce("last", F.lit(0))).alias("begin")
    )
    return all_lines.join(begin, "source_ref").filter(F.col("source_offset") >= F.col("begin")).drop("begin")


def ranged_lines(spark: SparkSession, root: str, excluded: tuple[str, ...] = (), stored: DataFrame | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(source_ref, source_offset, body) of the files below ``root``, read in byte ranges; with ``stored`` evidence only from each
    file's last stored offset on, as resume() does, without reading what is before. The driver lists the files, and so
    may hold one offset for each."""
    spark.dataSource.register(LineSource)
    begin = {}
    if stored is not None:
        last = stored.filter("lane = 'transcript' AND source_offset IS NOT NULL").groupBy("source_ref").agg(F.max("source_offset").alias("last"))
        begin = {r["source_ref"]: r["last"] for r in last.collect()}
    reader = spark.read.format("byte_ranges").option("rangeBytes", range_bytes).option("begin", json.dumps(begin))
    return reader.option("excluded", json.dumps([encoded(e) for e in excluded])).load(root)


def line_number(records: DataFrame) -> DataFrame:
    """Adds line_no: the place of each evidence row among its source's rows."""
    w = W.partitionBy("source_ref").orderBy("source_offset")
    return records.withColumn("line_no", F.row_number().over(w))
