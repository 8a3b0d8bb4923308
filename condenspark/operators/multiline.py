"""Sessionization: stack traces and other multi-line output become one event.

A line either always starts an event, or continues one of a fitting kind; which it is depends on the kind and size of the open event. That
is an automaton over the lines of a source, and it is run by composition. Lines are cut into chunks of numbers. Of each chunk a first
pass works out what it makes of the state before it: of a chunk with a sure start only that start counts, of one without it the whole
function from states to states (three kinds, sizes up to the cap). A scan over the chunks' results, a few bytes each, gives every chunk
its first start and the chunk in which the event before that began. A second pass deals each line to the chunk in which its event begins,
so each task sees whole events and gathers at most ``cap`` lines of one; a stretch without a sure start spreads over tasks like any other.

The input is read twice, and lines are shuffled once. (source, line_no) must be unique; null sources are one source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from condenspark.operators.scratch import written

MAX_LINES = 500
_S = r"[\t\n\f\r ]"
#: Shapes of continuation lines and of openings.
INDENTED = r"(?s)^(?:\t.|  [ \t]*[^ \t])"
ANY_KIND = rf"^{_S}*at{_S}+[^\t\n\f\r ]+\(|^{_S}*Caused by:|^{_S}*\.\.\.{_S}*[0-9]+{_S}*more{_S}*\z"
PYTHON_OPENS = rf"Traceback \(most recent call last\):{_S}*\z"
PYTHON_LINE = rf'^[A-Za-z_][\w.]*(?:Error|Exception|Warning|Interrupt|SystemExit)(?!\w)|^{_S}*File "[^"]*", line [0-9]+'
GO_OPENS = r"^panic:"
GO_LINE = rf"^goroutine [0-9]+ \[|^created by(?!\w)|^[\w./*()\[\]{{}}, ]+\(.*\){_S}*\z|^{_S}+[^\t\n\f\r ]+\.go:[0-9]+|^exit status [0-9]+{_S}*\z"


def line_class(content: Column) -> Column:
    """U continues any kind, P Python, G Go (in both of these also X), B is blank, H always starts."""
    python, go = content.rlike(PYTHON_LINE), content.rlike(GO_LINE)
    blank = F.trim(F.translate(content, "\t\r\n\f", "    ")) == ""
    return F.when(blank, "B").when(content.rlike(INDENTED) | content.rlike(ANY_KIND), "U").when(python & go, "X").when(python, "P").when(go, "G").otherwise("H")


def line_mode(raw: Column, content: Column) -> Column:
    """The kind that a line opens: g, p or - (any other)."""
    return F.when(raw.rlike(GO_OPENS), "g").when(content.rlike(PYTHON_OPENS), "p").otherwise("-")


def fits(mode: str, kind: str, size: int) -> bool:
    return kind == "U" or (kind in "PX" and mode == "p") or (kind in "GX" and mode == "g") or (kind == "B" and mode == "g" and size < 3)


def flags(kinds: list[str], opens: list[str], cap: int = MAX_LINES) -> list[bool]:
    """The exact rule over one stretch in order: is each line a start?"""
    mode, size, out = "-", 0, []
    for kind, opened in zip(kinds, opens, strict=True):
        start = size == 0 or size >= cap or not fits(mode, kind, size)
        mode, size = (opened, 1) if start else (mode, size + 1)
        out.append(start)
    return out


KINDS, MODES = "HUXPGB", "-pg"
#: May a line of a kind continue an event of a mode that has fewer than three lines, or more?
_FITS = [[[fits(m, k, size) for size in (1, 3)] for k in KINDS] for m in MODES]
FITS = np.array(_FITS)


def line_code(raw: Column, content: Column) -> Column:
    """line_class and line_mode as one byte: 3 * kind + mode."""
    number = lambda names, value: F.call_function("instr", F.lit(names), value) - 1
    return (number(KINDS, line_class(content)) * 3 + number(MODES, line_mode(raw, content))).cast("byte")


def walk(code: list[int], mode: int, size: int, cap: int, starts: list[int]) -> tuple[int, int]:
    """The exact rule over codes from an open event of mode and size on; starts gets the places of starts."""
    for i, c in enumerate(code):
        kind = c // 3
        if size >= cap or not _FITS[mode][kind][size >= 3]:
            mode, size = c % 3, 1
            starts.append(i)
        else:
            size += 1
    return mode, size


def starts_of(code: np.ndarray, fresh: np.ndarray, cap: int) -> np.ndarray:
    """Is each line a start? fresh: those that surely are, the first among them."""
    start = fresh | (code < 3)
    heads = np.flatnonzero(start)
    sizes = np.diff(np.append(heads, len(code)))
    plain = np.add.reduceat(code // 3 > 1, heads) - (code[heads] // 3 > 1) if len(heads) else sizes
    for h, n in zip(heads[(sizes > cap) | (plain > 0)].tolist(), sizes[(sizes > cap) | (plain > 0)].tolist(), strict=True):
        found: list[int] = []
        walk(code[h + 1 : h + n].tolist(), int(code[h]) % 3, 1, cap, found)
        start[[h + 1 + i for i in found]] = True
    return start


def effect(code: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """What a chunk without a sure start makes of every state before it, as the state's number mode * cap + size - 1: the state behind it, and
    the place at which its open event began (-1: before the chunk)."""
    mode, size = np.repeat(np.arange(3), cap), np.tile(np.arange(1, cap + 1), 3)
    begin = np.full(3 * cap, -1)
    for i, c in enumerate(code.tolist()):
        start = (size >= cap) | ~FITS[mode, c // 3, (size >= 3).astype(int)]
        mode, size, begin = np.where(start, c % 3, mode), np.where(start, 1, size + 1), np.where(start, i, begin)
    return mode * cap + size - 1, begin


BEFORE = np.iinfo(np.int64).min
CHUNK_ROW = "chunk long, lead binary, lead_at array<long>, sure_at long, state int, begin long, states binary, begins binary"


def chunk_effects(lines: DataFrame, chunk: int, cap: int) -> DataFrame:
    """source, chunk, the codes (lead) and numbers of its lines before the first sure start, up to cap, that start's number, and the state behind it: state and begin
    of its open event, or, if no line is a sure start, states and begins for each state before it."""
    rows = lines.select("source", F.floor(F.col("line_no") / chunk).alias("chunk"), F.col("line_no").cast("long").alias("line_no"), line_code(F.col("raw"), F.col("content")).alias("code"))
    rows = rows.withColumn("group", F.xxhash64("source", "chunk")).repartition("source", "chunk").sortWithinPartitions("source", "chunk", "line_no")
    kind = lines.schema["source"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            own = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            cuts = _cuts(own.column("group").to_numpy())
            yield done(own, cuts[:-1])
            kept = own.slice(int(cuts[-2])) if len(cuts) > 1 else None  # the last chunk may go on
        if kept is not None and kept.num_rows:
            yield done(kept, np.array([0, kept.num_rows]))

    def done(rows: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        code, at = rows.column("code").to_numpy().astype(np.int64), rows.column("line_no").to_numpy()
        out = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            sure = np.flatnonzero(code[a:b] < 3)
            lead = slice(a, a + min(cap, int(sure[0]) if len(sure) else b - a))
            told = (code[lead].astype(np.uint8).tobytes(), at[lead].tolist(), int(at[a + sure[0]]) if len(sure) else None)
            if len(sure):
                last, found = a + int(sure[-1]), []
                mode, size = walk(code[last + 1 : b].tolist(), int(code[last]) % 3, 1, cap, found)
                out.append((*told, mode * cap + size - 1, int(at[last + 1 + found[-1]] if found else at[last]), None, None))
            else:
                states, begins = effect(code[a:b], cap)
                out.append((*told, None, None, states.astype("<i4").tobytes(), np.where(begins < 0, BEFORE, at[a:b][begins]).astype("<i8").tobytes()))
        heads = rows.take(cuts[:-1]).select(["source", "chunk"]).combine_chunks()
        columns = list(zip(*out, strict=True)) or [()] * 7
        kinds = (pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        arrays = [_one(heads.column(c)) for c in ("source", "chunk")] + [pa.array(v, k) for v, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["source", "chunk", "lead", "lead_at", "sure_at", "state", "begin", "states", "begins"])

    return rows.mapInArrow(run, StructType([StructField("source", kind), *_fields(CHUNK_ROW)]))


def carried(effects: DataFrame, chunk: int, cap: int) -> DataFrame:
    """source, chunk, until, home of the chunks that begin inside an event: the number of the first line that isn't that event's (null: none is) and
    the chunk in which the event began. One light pass over the chunks of each source in order."""
    rows = effects.withColumn("group", F.xxhash64("source")).repartition("source").sortWithinPartitions("source", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state, begin = None, None, None
        for batch in batches:
            keep, until, home = [], [], []
            for i, (own, lead, lead_at, sure_at, after, began, states, begins) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("group", "lead", "lead_at", "sure_at", "state", "begin", "states", "begins")), strict=True)):
                if own != group:
                    group, state, begin = own, cap - 1, None  # as behind a full event: the source's first line is a start, whatever it is
                if lead:
                    found: list[int] = []
                    walk(list(lead), state // cap, state % cap + 1, cap, found)
                    if not found or found[0]:
                        keep.append(i)
                        until.append(lead_at[found[0]] if found else sure_at)
                        home.append(begin // chunk)
                if after is not None:
                    state, begin = after, began
                else:
                    at, state = int(np.frombuffer(begins, "<i8")[state]), int(np.frombuffer(states, "<i4")[state])
                    begin = begin if at == BEFORE else at
            heads = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([heads.column("source"), heads.column("chunk"), pa.array(until, pa.int64()), pa.array(home, pa.int64())], names=["source", "chunk", "until", "home"])

    return rows.mapInArrow(run, StructType([StructField("source", effects.schema["source"].dataType), *_fields("chunk long, until long, home long")]))


def _fields(ddl: str) -> list[StructField]:
    return StructType.fromDDL(ddl).fields


def _one(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _cuts(group: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin, and the end."""
    return np.r_[0, np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)] if len(group) else np.zeros(1, np.int64)


def events(lines: DataFrame, chunk: int = 1 << 16, cap: int = MAX_LINES, keep: tuple[str, ...] = (), last: tuple[str, ...] = ()) -> DataFrame:
    """source, event_no (its first line's line_no), severity (of the first line), lines, contents, n_lines, truncated (how many of its lines were
    cut), the columns ``keep`` of the first line, and those of ``last`` of the last line, as last_<name>. lines: source, line_no (from any number on), raw, content, severity, and truncated or not."""
    carry = written(carried(chunk_effects(lines, chunk, cap), chunk, cap), "carry")
    rows = lines if "truncated" in lines.columns else lines.withColumn("truncated", F.lit(False))
    rows = rows.select("source", "line_no", "raw", "content", "severity", "truncated", *dict.fromkeys([*keep, *last]), line_code(F.col("raw"), F.col("content")).alias("code"), F.floor(F.col("line_no") / chunk).alias("chunk"))
    carry = carry.select(F.col("source").alias("of"), F.col("chunk").alias("in_chunk"), "until", "home")
    rows = rows.join(carry, F.col("source").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("in_chunk")), "left")
    inside = F.col("home").isNotNull() & (F.col("until").isNull() | (F.col("line_no") < F.col("until")))
    rows = rows.withColumn("home", F.when(inside, F.col("home")).otherwise(F.col("chunk"))).drop("of", "in_chunk", "until", "chunk")
    rows = rows.withColumn("group", F.xxhash64("source", "home")).repartition("source", "home").sortWithinPartitions("source", "home", "line_no").drop("home")
    kinds = {f.name: f.dataType for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_event = None
        for batch in batches:
            own = pa.Table.from_batches([batch] if open_event is None else [*open_event.to_batches(), batch]).combine_chunks()
            if not own.num_rows:
                continue
            group = own.column("group").to_numpy()
            start = starts_of(own.column("code").to_numpy().astype(np.int64), np.r_[True, group[1:] != group[:-1]], cap)
            cuts = np.flatnonzero(start)
            yield made(own, cuts)
            open_event = own.slice(int(cuts[-1]))  # it may go on
        if open_event is not None:
            yield made(open_event.combine_chunks(), np.array([0, open_event.num_rows]))

    def made(rows: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        heads, offsets = rows.take(cuts[:-1]), pa.array(cuts - cuts[0], pa.int32())
        whole = rows.slice(int(cuts[0]), int(cuts[-1] - cuts[0]))
        lists = [pa.ListArray.from_arrays(offsets, _one(whole.column(c))) for c in ("raw", "content")]
        cut = np.add.reduceat(np.append(_one(whole.column("truncated")).fill_null(False).to_numpy(zero_copy_only=False), False).astype(np.int32), (cuts - cuts[0])[:-1]) if len(cuts) > 1 else np.zeros(0, np.int32)
        first = [_one(heads.column(c)) for c in ("source", "line_no", "severity", *keep)]
        tails = rows.take(cuts[1:] - 1) if last else heads
        ends = [_one(tails.column(c)) for c in last]
        return pa.RecordBatch.from_arrays([*first[:3], *lists, pa.array(np.diff(cuts), pa.int32()), pa.array(cut, pa.int32()), *first[3:], *ends], names=[f.name for f in out])

    text = ArrayType(kinds["raw"])
    out = [StructField("source", kinds["source"]), StructField("event_no", kinds["line_no"]), StructField("severity", kinds["severity"]), StructField("lines", text), StructField("contents", text)]
    out += [StructField("n_lines", IntegerType()), StructField("truncated", IntegerType()), *(StructField(c, kinds[c]) for c in keep), *(StructField(f"last_{c}", kinds[c]) for c in last)]
    return rows.mapInArrow(run, StructType(out))
