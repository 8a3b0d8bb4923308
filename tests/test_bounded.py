"""The bounded line source: ranges against a plain split, ends of files, memory, compressed files and folders."""

from __future__ import annotations

import gzip
import io
import random
import tracemalloc

import pytest

from condenspark.sources.bounded import BoundedReader, Range, Ranges, bounded_lines, cut, heads, planned


def split(data, cap, marker="~"):
    out, at = [], 0
    for k, part in enumerate(pieces := data.split(b"\n")):
        if k < len(pieces) - 1 or part:
            line = part[:-1] if part.endswith(b"\r") else part
            out.append((at, (line[:cap] + marker.encode() if len(line) > cap else line).decode("utf-8", "replace"), len(line) > cap))
        at += len(part) + 1
    return out


def test_ranges_equal_a_plain_split():
    rng = random.Random(1)
    for _ in range(4000):
        data = bytes(rng.choice(b"ab\n\r\ra") for _ in range(rng.randrange(60)))
        cap, step, chunk, got = rng.randrange(1, 8), rng.randrange(1, 30), rng.randrange(1, 12), []
        for begin in range(0, len(data), step):
            file = io.BytesIO(data)
            file.seek(max(0, begin - 1))
            for at, head, _ in heads(file.read, begin, min(len(data), begin + step), cap, chunk):
                assert len(head) <= cap + 2
                got.append((at, *cut(head, cap, "~")))
        assert got == split(data, cap)


def lines_of(spark, path, **options):
    return [(r.raw, r.truncated) for r in bounded_lines(spark, str(path), marker="~", **options).orderBy("source", "line_no").collect()]


CASES = [
    (b"one\ntwo\nthree\n", ["one", "two", "three"]), (b"one\ntwo", ["one", "two"]), (b"short\n" + b"x" * 10_000 + b"\nafter\n", ["short", "x" * 100 + "~", "after"]), (b"one\r\ntwo\r\n\r\n", ["one", "two", ""]),
    (b"", []), (b"\n", [""]), (b"a\rb\r\nc\r", ["a\rb", "c"]), ("é".encode() * 80 + b"\n", ["é" * 50 + "~"]), (b"x" + "é".encode() * 80, ["x" + "é" * 49 + "~"]), (b"\xff\xfe ok\n", ["�� ok"]),
    (b"y" * 100 + b"\r\n" + b"z" * 101, ["y" * 100, "z" * 100 + "~"]),
]


@pytest.mark.parametrize(("data", "want"), CASES)
def test_lines_of_a_file(spark, tmp_path, data, want):
    (tmp_path / "a.log").write_bytes(data)
    assert lines_of(spark, tmp_path / "a.log", max_bytes=100, range_bytes=64) == [(w, w.endswith("~")) for w in want]


@pytest.mark.parametrize(("data", "want"), [
    (b"k\n" + b"x" * 250, ["k", "x" * 100 + "~", "x" * 50]), (b"x" * 300, ["x" * 100 + "~"]), (b"x" * 250 + b"\n", ["x" * 100 + "~"]), (b"x" * 250 + b"\nend", ["x" * 100 + "~", "end"]), (b"x" * 101, ["x" * 100 + "~", "x"]), (b"x" * 100, ["x" * 100]),
])
def test_the_rest_of_an_overlong_last_line(spark, tmp_path, data, want):
    """In whole caps it is dropped; what is over is a line of its own, where that is asked for."""
    (tmp_path / "a.log").write_bytes(data)
    (tmp_path / "a.log.gz").write_bytes(gzip.compress(data))
    for name in ("a.log", "a.log.gz"):
        assert [r for r, _ in lines_of(spark, tmp_path / name, max_bytes=100, range_bytes=64, tail="emit")] == want
        assert [r for r, _ in lines_of(spark, tmp_path / name, max_bytes=100, range_bytes=64)] == [w for w in want if w not in ("x" * 50, "x")]


def test_folders_globs_and_compressed_files(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"1\n2\n")
    (tmp_path / "b.log.gz").write_bytes(gzip.compress(b"3\n4\n" * 3))
    (tmp_path / "_hidden").write_bytes(b"no\n")
    (tmp_path / "c.txt").write_bytes(b"5\n")
    (tmp_path / "empty.txt").write_bytes(b"")
    texts = lambda path: [r for r, _ in lines_of(spark, path)]
    assert texts(tmp_path) == ["1", "2", *["3", "4"] * 3, "5"] and texts(tmp_path / "*.log*") == ["1", "2", *["3", "4"] * 3] and texts(f"file://{tmp_path}/c.txt") == ["5"]
    rows = bounded_lines(spark, str(tmp_path / "a.log")).orderBy("line_no").collect()
    assert [(r.source, r.line_no) for r in rows] == [(str(tmp_path / "a.log"), 0), (str(tmp_path / "a.log"), 2)]
    with pytest.raises(Exception, match="maxBytes"):
        lines_of(spark, tmp_path, max_bytes=0)
    with pytest.raises(Exception, match="absent"):
        lines_of(spark, tmp_path / "absent")


def test_files_are_planned_in_ranges():
    assert planned([("a", 250)], 100) == [[Range("a", 0, 100, 250)], [Range("a", 100, 200, 250)], [Range("a", 200, 250, 250)]]
    assert [len(task) for task in planned([(f"f{i}", 10) for i in range(25)], 100)] == [10, 10, 5]
    assert planned([("a.gz", 250), ("b", 0)], 100) == [[Range("a.gz", 0, 250, 250)]]


def test_a_line_of_a_gigabyte_needs_little_memory(tmp_path):
    """A sparse file: one line of 1 GB, between short ones."""
    path = tmp_path / "long.log"
    with path.open("wb") as f:
        f.write(b"first\n")
        f.seek(1 << 30)
        f.write(b"\nlast\n")
    reader = BoundedReader(str(path), 1 << 18, 1 << 26, "~", True)
    tracemalloc.start()
    got = [(r["line_no"], len(r["raw"]), r["truncated"]) for task in reader.partitions() for batch in reader.read(Ranges(task.ranges)) for r in batch.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(0, 5, False), (6, (1 << 18) + 1, True), ((1 << 30) + 1, 4, False)] and peak < 50 << 20


def test_condensing_bounded_lines(spark, tmp_path):
    from condenspark.operators import patterns
    from condenspark.plans.condense import condense

    (tmp_path / "a.log").write_bytes(b"".join(b"[INFO] tick %d\n" % i for i in range(50)) + b"[ERROR] " + b"z" * 400 + b"\n  more\n")
    r = patterns.report(condense(bounded_lines(spark, str(tmp_path / "a.log"), max_bytes=200, range_bytes=100))).first()
    assert (r.raw_lines, r.displayed_events, r.suppressed_events, r.truncated_lines) == (52, 2, 49, 1)
