"""The byte-range source against whole-file reading, in batch and as a stream."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.sources import evidence, ranges, transcripts
from ledgerlens.streaming import live

LINES = [b'{"a":1}', b"", b"  ", b"x" * 300, b"\xff\xfe bad", "Straße €".encode(), b"ends in cr\r", b"\r", b"q"]


def content(seed, n):
    rng = random.Random(seed)
    return b"".join(rng.choice(LINES) + b"\n" for _ in range(n))


def whole(spark, root):
    rows = transcripts.lines(transcripts.files(spark, root)).select("source_ref", "source_offset", "body")
    return sorted(tuple(r) for r in rows.collect())


def got(df):
    return sorted(tuple(r) for r in df.select("source_ref", "source_offset", "body").collect())


@pytest.mark.parametrize("width", [1, 7, 64, 1 << 20])
def test_ranges_equal_whole_files(spark, tmp_path, width):
    (tmp_path / "-w-p").mkdir()
    (tmp_path / "-w-p" / "a.jsonl").write_bytes(content(1, 12) + b"no end yet")
    (tmp_path / "-w-p" / "b.jsonl").write_bytes(b"\n\nfirst\n")
    (tmp_path / "-w-p" / "empty.jsonl").write_bytes(b"")
    (tmp_path / "-w-p" / "other.txt").write_bytes(b"not this\n")
    df = transcripts.ranged_lines(spark, str(tmp_path), range_bytes=width)
    assert got(df) == whole(spark, str(tmp_path)) and df.rdd.getNumPartitions() >= (12 if width < 64 else 1)


@pytest.mark.parametrize("chunk", [1, 3, 1 << 20])
def test_any_cut_gives_each_line_once(monkeypatch, tmp_path, chunk):
    monkeypatch.setattr(ranges, "CHUNK", chunk)
    data = content(3, 10) + b"tail"
    (tmp_path / "f").write_bytes(data)
    want, at = [], 0
    for line in data.split(b"\n")[:-1]:
        want.append((at, line))
        at += len(line) + 1
    rng = random.Random(chunk)
    for _ in range(25):
        cuts = sorted({0, len(data), *(rng.randrange(len(data)) for _ in range(4))})
        found = [x for a, z in zip(cuts, cuts[1:], strict=False) for x in ranges.lines_of(ranges.fs.LocalFileSystem(), ranges.Span(str(tmp_path / "f"), a, z))]
        assert found == want


def test_resume_reads_on(spark, tmp_path):
    (tmp_path / "p").mkdir()
    f, g = tmp_path / "p" / "a.jsonl", tmp_path / "p" / "b.jsonl"
    f.write_bytes(b"one\ntwo\n")
    g.write_bytes(b"long line that goes\nmore\n")
    stored = evidence.numbered(evidence.prepared(transcripts.ranged_lines(spark, str(tmp_path)), "transcript", 1), 0)
    stored = spark.createDataFrame(stored.collect(), stored.schema)  # as it is now
    f.write_bytes(b"one\ntwo\nthree\n")
    g.write_bytes(b"new\n")  # replaced by a shorter one
    rows = transcripts.ranged_lines(spark, str(tmp_path), stored=stored)
    assert [r[2] for r in got(rows)] == ["two", "three", "new"]
    assert transcripts.ranged_lines(spark, str(tmp_path), excluded=("p",)).count() == 0


def test_growing_files_as_a_stream(spark, tmp_path):
    """Several triggers and restarts over a file that grows by parts of lines, and one that is replaced."""
    root, out = tmp_path / "in", str(tmp_path / "out")
    (root / "p").mkdir(parents=True)
    data = content(5, 30)
    keep = lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)
    for n, upto in enumerate((10, 11, len(data) // 2, len(data))):
        (root / "p" / "a.jsonl").write_bytes(data[:upto])
        if n == 2:
            (root / "p" / "b.jsonl").write_bytes(b"late\nfile")
        q = live.tail_stream(spark, str(root), 16).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    rows = spark.read.parquet(out)
    assert got(rows) == whole(spark, str(root)) and rows.select("batch").distinct().count() > 1
