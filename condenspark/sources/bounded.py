"""Lines of text files in bounded memory: the Spark data source ``bounded_lines``.

Files are read in byte ranges, one or several a task. A line belongs to the range that holds its first byte; a range that begins inside a
line skips to the next line end, so ranges need nothing of each other. Of a line at most the cap and two bytes are held: a line that is
longer is cut there, and the task goes on at the next line end, or stops if that is past its range. A line of any length so costs no more
memory than a short one, and no task reads beyond its range by more than the cap.

Options: path (a file, a folder, or a glob in the last part; any store that pyarrow.fs opens), maxBytes (the cap), rangeBytes, marker,
tail. Compressed files (by their ending) are one range each. ``tail`` says what becomes of the rest of an over-long last line
that has no line end: drop (the default), or emit: what is over in whole caps is dropped and the rest is a line of its own, as a filter
shows that empties its buffer at the end of its input. Bytes that are no UTF-8 become U+FFFD; a character that the cut halves goes.

Columns: source (the file), line_no (the line's first byte: rising, with gaps), raw, truncated.
"""

from __future__ import annotations

import codecs
import fnmatch
import posixpath
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from condenspark.sources.lines import MARKER, MAX_BYTES

READ, BATCH = 1 << 20, 1 << 20
ENDINGS = {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd", ".lz4": "lz4"}
SCHEMA = StructType([StructField("source", StringType()), StructField("line_no", LongType()), StructField("raw", StringType()), StructField("truncated", BooleanType())])
ARROW = pa.schema([("source", pa.string()), ("line_no", pa.int64()), ("raw", pa.string()), ("truncated", pa.bool_())])


@dataclass(frozen=True)
class Range:
    path: str
    begin: int
    end: int
    size: int


class Ranges(InputPartition):
    def __init__(self, ranges: list[Range]):
        self.ranges = ranges


def planned(files: list[tuple[str, int]], most: int) -> list[list[Range]]:
    """Ranges of at most ``most`` bytes; small files share a task."""
    out: list[list[Range]] = []
    room = 0
    for path, size in files:
        step = max(1, size) if compression(path) else most
        for begin in range(0, size, step):
            own = Range(path, begin, min(size, begin + step), size)
            if not out or own.end - own.begin > room:
                out.append([])
                room = most
            out[-1].append(own)
            room -= own.end - own.begin
    return out


def compression(path: str) -> str | None:
    return ENDINGS.get(posixpath.splitext(path)[1].lower())


def listed(path: str) -> tuple[pa.fs.FileSystem, list[tuple[str, int]]]:
    """The store, and (path in it, bytes) of the files, by name. Names that begin with a dot or an underscore are hidden, as in Spark."""
    folder, _, last = path.rpartition("/")
    if any(c in last for c in "*?["):
        store, base = pa.fs.FileSystem.from_uri(folder or "/")
        fits: Callable[[str], bool] = lambda name: fnmatch.fnmatchcase(name, last)
    else:
        store, base = pa.fs.FileSystem.from_uri(path)
        own = store.get_file_info(base)
        if own.type == pa.fs.FileType.File:
            return store, [(base, own.size)]
        if own.type == pa.fs.FileType.NotFound:
            raise FileNotFoundError(path)
        fits = lambda name: True
    found = store.get_file_info(pa.fs.FileSelector(base))
    return store, sorted((f.path, f.size) for f in found if f.type == pa.fs.FileType.File and f.base_name[0] not in "._" and fits(f.base_name))


def heads(read: Callable[[int], bytes], begin: int, end: int, cap: int, chunk: int = READ) -> Iterator[tuple[int, bytes, bool]]:
    """(first byte, the line's first cap + 2 bytes at most, is there a line end) of each line that begins in the range. read gives the bytes from
    begin on; from the one before it, if begin isn't 0."""
    skipping, at, head, first = begin > 0, max(0, begin - 1), b"", begin
    while data := read(chunk):
        i = 0
        while i < len(data):
            j = data.find(b"\n", i)
            if not skipping:
                head += data[i : min(len(data) if j < 0 else j, i + cap + 2 - len(head))]
                if j >= 0:
                    yield first, head, True
                elif len(head) == cap + 2:
                    yield first, head, False
                    skipping = True
            if j < 0:
                break
            skipping, head, first, i = False, b"", at + j + 1, j + 1
            if first >= end:
                return
        at += len(data)
        if skipping and at >= end:
            return
    if head and not skipping:
        yield first, head, False


def cut(head: bytes, cap: int, marker: str) -> tuple[str, bool]:
    """The line without one trailing carriage return, and whether it was cut."""
    line = head[:-1] if head.endswith(b"\r") and len(head) < cap + 2 else head
    if len(line) <= cap:
        return line.decode("utf-8", "replace"), False
    return codecs.getincrementaldecoder("utf-8")("replace").decode(line[:cap]) + marker, True


def rest_of_last(read: Callable[[int], bytes], length: int, cap: int, chunk: int = READ) -> tuple[int, bytes] | None:
    """After ``length`` bytes of an over-long line: if it runs to the end of the file, the bytes of the line that are dropped, and the rest."""
    kept = b""
    while data := read(chunk):
        if b"\n" in data:
            return None
        kept = (kept + data)[-cap:]
        length += len(data)
    over = length % cap
    return (length - over, kept[len(kept) - over :]) if over and over <= len(kept) else None


class BoundedReader(DataSourceReader):
    def __init__(self, path: str, cap: int, most: int, marker: str, emit: bool):
        self.path, self.cap, self.most, self.marker, self.emit = path, cap, most, marker, emit

    def partitions(self) -> list[Ranges]:
        return [Ranges(r) for r in planned(listed(self.path)[1], self.most)] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store = pa.fs.FileSystem.from_uri(self.path.rpartition("/")[0] or "/" if any(c in self.path for c in "*?[") else self.path)[0]
        rows, size = [], 0
        for own in partition.ranges:
            for row in self._lines(store, own):
                rows.append(row)
                size += len(row[2])
                if size > BATCH or len(rows) == 10_000:
                    yield self._batch(rows)
                    rows, size = [], 0
        yield self._batch(rows)

    def _lines(self, store: pa.fs.FileSystem, own: Range) -> Iterator[tuple[str, int, str, bool]]:
        packed = compression(own.path)
        with store.open_input_stream(own.path, compression=packed) if packed else store.open_input_file(own.path) as file:
            if own.begin:
                file.seek(own.begin - 1)
            for at, head, ended in heads(file.read, own.begin, own.end if not packed else 1 << 62, self.cap):
                line, long = cut(head, self.cap, self.marker)
                yield own.path, at, line, long
                if self.emit and long and not ended:
                    rest = self._rest(store, own, at, packed)
                    if rest:
                        yield own.path, at + rest[0], cut(rest[1], self.cap, self.marker)[0], False

    def _rest(self, store: pa.fs.FileSystem, own: Range, at: int, packed: str | None) -> tuple[int, bytes] | None:
        if packed:
            with store.open_input_stream(own.path, compression=packed) as file:
                left = at
                while left:
                    left -= len(file.read(min(left, READ)))
                return rest_of_last(file.read, 0, self.cap)
        with store.open_input_file(own.path) as file:
            file.seek(own.size - 1)
            if file.read(1) == b"\n":
                return None
            file.seek(at)
            return rest_of_last(file.read, 0, self.cap)

    def _batch(self, rows: list[tuple[str, int, str, bool]]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, ARROW, strict=True)], schema=ARROW)


class BoundedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bounded_lines"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> BoundedReader:
        get = {k.lower(): v for k, v in self.options.items()}
        cap, most = int(get.get("maxbytes", MAX_BYTES)), int(get.get("rangebytes", 64 << 20))
        tail = get.get("tail", "drop")
        if "path" not in get or cap < 1 or most < 1 or tail not in ("drop", "emit"):
            raise ValueError("bounded_lines needs a path, maxBytes and rangeBytes above 0, and a tail of drop or emit")
        return BoundedReader(get["path"], cap, most, get.get("marker", MARKER), tail == "emit")


def bounded_lines(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, range_bytes: int = 64 << 20, marker: str = MARKER, tail: str = "drop") -> DataFrame:
    """source, line_no, raw, truncated of text files, whatever the length of a line."""
    spark.dataSource.register(BoundedLines)
    return spark.read.format("bounded_lines").option("maxBytes", max_bytes).option("rangeBytes", range_bytes).option("marker", marker).option("tail", tail).load(path)
