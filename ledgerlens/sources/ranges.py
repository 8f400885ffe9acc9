"""Lines of growing text files as a data source: partitions are byte ranges, stream offsets are byte offsets by file.

A line belongs to the range it starts in, so a file of any size is read by many tasks, each of which holds one chunk and
one line. Only complete lines come out; a last line without its end waits for a later read. Files are reached through
pyarrow's file systems (local paths and the URIs that these know).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "source_ref string, source_offset long, body string"
RANGE_BYTES, CHUNK, BATCH_LINES = 64 << 20, 1 << 20, 2000


def opened(root: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path, what stands before a path in a source_ref)."""
    if "://" not in root and not root.startswith("file:"):
        return fs.LocalFileSystem(), root, "file:"
    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/"), "file:"
    found, path = fs.FileSystem.from_uri(root)
    return found, path, root.split("://")[0] + "://"


@dataclass
class Span(InputPartition):
    """The lines of one file that start at ``begin`` or later and before ``end``."""

    path: str
    begin: int
    end: int


def lines_of(files: fs.FileSystem, span: Span) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the complete lines that start in the span."""
    with files.open_input_file(span.path) as f:
        at = span.begin
        held = b""
        if at > 0:  # a line starts here only if the byte before ends one
            f.seek(at - 1)
            at -= 1
            skipping = True
        else:
            skipping = False
        while at < span.end or held:
            more = f.read(CHUNK)
            if not more:
                return
            held += more
            start = 0
            while (stop := held.find(b"\n", start)) >= 0:
                if not skipping:
                    if at + start >= span.end:
                        return
                    yield at + start, held[start:stop]
                skipping = False
                start = stop + 1
            at += start
            held = held[start:]
            if at >= span.end and not skipping:
                return
            if skipping and at + len(held) > span.end:
                return  # no line starts in the span


def _text(line: bytes) -> str:
    return line.decode("utf-8", "replace").rstrip("\r")


class _Lines:
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.width = int(options.get("rangebytes", RANGE_BYTES))
        self.suffix = options.get("suffix", ".jsonl")
        self.excluded = json.loads(options.get("excluded", "[]"))
        self.begin = json.loads(options.get("begin", "{}"))

    def sizes(self) -> dict[str, int]:
        files, path, _ = opened(self.root)
        found = files.get_file_info(fs.FileSelector(path, recursive=True))
        good = (f for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffix))
        return {f.path: f.size for f in sorted(good, key=lambda f: f.path) if f.path.split("/")[-2] not in self.excluded}

    def spans(self, path: str, begin: int, end: int) -> list[Span]:
        return [Span(path, k, min(k + self.width, end)) for k in range(begin, end, self.width)]

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file has anything to read
            return
        files, _, head = opened(self.root)
        ref = head + partition.path

        def batch(rows: list[tuple[int, str]]) -> pa.RecordBatch:
            offsets, bodies = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([ref] * len(rows)), pa.array(offsets, pa.int64()), pa.array(bodies)], ["source_ref", "source_offset", "body"])

        rows: list[tuple[int, str]] = []
        for at, line in lines_of(files, partition):
            body = _text(line)
            if body.strip(" "):
                rows.append((at, body))
            if len(rows) == BATCH_LINES:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)


class LineReader(_Lines, DataSourceReader):
    def partitions(self) -> list[Span]:
        """``begin`` has offsets by source_ref to read on from; one beyond the file's size means the file was replaced."""
        head = opened(self.root)[2]
        out = []
        for path, size in self.sizes().items():
            begin = self.begin.get(head + path, 0)
            out += self.spans(path, begin if begin <= size else 0, size)
        return out


class LineStream(_Lines, DataSourceStreamReader):
    """Offsets name the end of the last complete line of each file."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, _, _ = opened(self.root)
        return {path: self._last_end(files, path, size) for path, size in self.sizes().items()}

    @staticmethod
    def _last_end(files: fs.FileSystem, path: str, size: int) -> int:
        with files.open_input_file(path) as f:
            at = size
            while at > 0:
                low = max(at - (CHUNK >> 4), 0)
                f.seek(low)
                found = f.read(at - low).rfind(b"\n")
                if found >= 0:
                    return low + found + 1
                at = low
        return 0

    def partitions(self, start: dict, end: dict) -> list[Span]:
        out = []
        for path, upto in end.items():
            begin = start.get(path, 0)
            out += self.spans(path, begin if begin <= upto else 0, upto)
        return out

    def commit(self, end: dict) -> None:
        pass


class LineSource(DataSource):
    """``spark.read.format("byte_ranges").load(root)``, or ``readStream``. Options: rangeBytes, suffix, excluded (JSON list of
    folders), begin (JSON of offsets by source_ref, batch only)."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LineReader:
        return LineReader(self.options)

    def streamReader(self, schema) -> LineStream:
        return LineStream(self.options)
