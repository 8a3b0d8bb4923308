"""The whole plan on a stream: each source is condensed by a state of its own, as if it had a filter process to itself.

The state of a source holds the lines of its open event, its patterns with their rates (at most ``max_patterns``: the least recently used goes and
is new when it comes back), and the repeats that wait for their summary. Lines of a source must come in the order of line_no from
micro-batch to micro-batch; inside one they are sorted. However a log is cut into micro-batches, the records are those of the batch plan
with clock="event" on that source alone, in the same order.

Severity, templates and the classes of lines are native expressions before the state; the state only steps the automaton and counts. It is
read and written once a micro-batch for each pattern that occurred. A source has ended with a row without line_no, or when it had no
lines for ``idle_ms`` and its timer is due: its open event is closed, all waits are let out, and its state goes. The state store must be RocksDB (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import asdict

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from condenspark.functions import normalize, severity
from condenspark.operators.anomaly import History
from condenspark.operators.multiline import MAX_LINES, line_code, walk
from condenspark.operators.patterns import FLUSH_ERROR_MS, FLUSH_MS, parse, with_fingerprints
from condenspark.plans.config import Config

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = (
    "n long, type string, severity tinyint, template string, lines array<string>, count long, baseline_per_min double, current_per_min double, bootstrap boolean, event_no long, n_lines int"
)
FIELDS = [f.split()[0] for f in OUT.split(", ")]
#: Numbers of a source's state: the open event's mode and size; the clock and when waits were last looked through; and how many records, uses
#: of patterns, waits and patterns there are; the oldest use that may still count; and the timer.
HEAD = ("mode", "size", "clock", "checked", "records", "uses", "waits", "tracked", "oldest", "timer")
PATTERN = "severity int, template string"


class Condenser(StatefulProcessor):
    def __init__(self, config: Config, idle_ms: int, multi_line: bool, by_line: bool, throttle_ms: int, cap: int):
        self.config, self.idle_ms, self.multi_line, self.by_line, self.throttle, self.cap = config, idle_ms, multi_line, by_line, throttle_ms * 1000, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", ", ".join(f"{c} long" for c in HEAD))
        self.open = handle.getListState("open", "line_no long, severity int, content string, template string")
        self.patterns = handle.getMapState("patterns", PATTERN, "used long, history string")
        self.uses = handle.getMapState("uses", "used long", PATTERN)
        self.pending = handle.getMapState("pending", PATTERN, "count long, since long, seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self._load(key)
        rows = list(rows)
        for line in sorted((r for r in rows if r.line_no is not None), key=lambda r: r.line_no):
            self._line(line)
        h = self.h
        if any(r.line_no is None for r in rows):
            self._finish()
            if h["timer"]:
                self.handle.deleteTimer(h["timer"])
            yield from self.out
            return
        if h["timer"]:
            self.handle.deleteTimer(h["timer"])
        h["timer"] = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        self.handle.registerTimer(h["timer"])
        self._store()
        yield from self.out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.head.exists():
            return
        self._load(key)
        self._finish()
        yield from self.out

    def _finish(self) -> None:
        if self.lines:
            self._event(self.h["clock"])
        for pattern in sorted(self.waits, key=lambda p: self.waits[p][2]):
            self._summary(pattern, None)
        for state in (self.head, self.open, self.patterns, self.uses, self.pending):
            state.clear()

    def _load(self, key: tuple) -> None:
        self.key, self.out = key, []
        found = self.head.get() if self.head.exists() else None
        self.h = dict(zip(HEAD, found, strict=True)) if found else dict.fromkeys(HEAD, 0) | {"size": self.cap, "clock": -(1 << 62), "checked": -(1 << 62)}
        self.lines = [tuple(r) for r in self.open.get()] if self.h["size"] < self.cap else []
        self.waits = {tuple(k): list(v) for k, v in self.pending.iterator()}
        self.stored_waits, self.due = set(self.waits), min((w[1] + self._wait(p[0]) for p, w in self.waits.items()), default=None)
        self.touched: OrderedDict[tuple, list] = OrderedDict()  # pattern: [its stored use or None, History], from the least recently used
        self.first_use = self.h["uses"]

    def _store(self) -> None:
        h = self.h
        for pattern, (used, history) in self.touched.items():
            if used is not None and used >= h["oldest"]:
                self.uses.removeKey((used,))
            self.patterns.updateValue(pattern, (h["uses"], json.dumps(asdict(history))))
            self.uses.updateValue((h["uses"],), pattern)
            h["uses"] += 1
        for pattern in self.stored_waits - set(self.waits):
            self.pending.removeKey(pattern)
        for pattern, wait in self.waits.items():
            self.pending.updateValue(pattern, tuple(wait))
        self.open.put(self.lines) if self.lines else self.open.clear()
        self.head.update(tuple(h[c] for c in HEAD))

    def _line(self, line: Row) -> None:
        h, own = self.h, (line.line_no, line.severity, line.content, line.template)
        if not self.multi_line:
            self.lines = [own]
            self._event(line.us)
        else:
            start: list[int] = []
            mode, size = walk([line.code], h["mode"], h["size"], self.cap, start)
            if start and self.lines:
                self._event(line.us)
            self.lines.append(own)
            h["mode"], h["size"] = mode, size
            if size >= self.cap:
                self._event(line.us)
        h["clock"] = max(h["clock"], line.us)
        if self.by_line:
            self._tick(line.line_no)

    def _event(self, us: int) -> None:
        h, lines = self.h, self.lines
        self.lines = []
        h["clock"] = max(h["clock"], us)
        no, level = lines[0][0], lines[0][1]
        pattern = (level, "\n".join(x[3] or "" for x in lines) if lines[0][3] is not None or len(lines) > 1 else None)
        new, history = self._used(pattern)
        spike, base, current, bootstrap = history.record(us / 1e6, (level or 3) >= self.config.protect_rank, self.config)
        if spike and pattern in self.waits:
            self._summary(pattern, no)
        if spike or new:
            self._record("anomaly" if spike else "event", pattern, [x[2] for x in lines], None if spike else 1, base, current, bootstrap, no, len(lines))
        else:
            if pattern not in self.waits:
                self.waits[pattern] = [0, h["clock"], h["waits"]]
                h["waits"] += 1
                due = h["clock"] + self._wait(level)
                self.due = due if self.due is None else min(self.due, due)
            self.waits[pattern][0] += 1
        if not self.by_line:
            self._tick(no)

    def _used(self, pattern: tuple) -> tuple[bool, History]:
        """Is the pattern new, and its history. It is the most recently used from here on, and the least recently used may go."""
        h = self.h
        if pattern in self.touched:
            self.touched.move_to_end(pattern)
            return False, self.touched[pattern][1]
        found = self.patterns.getValue(pattern)
        history = History(**json.loads(found[1])) if found else History()
        self.touched[pattern] = [found[0] if found else None, history]
        if not found:
            h["tracked"] += 1
            while h["tracked"] > self.config.max_patterns:
                self._evict()
        return not found, history

    def _evict(self) -> None:
        h = self.h
        while h["oldest"] < self.first_use:
            use = self.uses.getValue((h["oldest"],))
            if use is not None:
                self.uses.removeKey((h["oldest"],))
            h["oldest"] += 1
            if use is not None and tuple(use) not in self.touched:
                self.patterns.removeKey(tuple(use))
                h["tracked"] -= 1
                return
        pattern, (used, _) = self.touched.popitem(last=False)
        if used is not None:
            self.patterns.removeKey(pattern)
        h["tracked"] -= 1

    def _wait(self, level: int | None) -> int:
        return (FLUSH_ERROR_MS if (level or 3) >= 6 else FLUSH_MS) * 1000

    def _tick(self, no: int) -> None:
        now = self.h["clock"]
        if not self.waits or now - self.h["checked"] < self.throttle:
            return
        self.h["checked"] = now
        if now < self.due:
            return
        for pattern in sorted((p for p, w in self.waits.items() if now >= w[1] + self._wait(p[0])), key=lambda p: self.waits[p][2]):
            self._summary(pattern, no)
        self.due = min((w[1] + self._wait(p[0]) for p, w in self.waits.items()), default=None)

    def _summary(self, pattern: tuple, no: int | None) -> None:
        self._record("repeat_summary", pattern, None, self.waits.pop(pattern)[0], None, None, None, no, None)

    def _record(self, kind: str, pattern: tuple, *values) -> None:
        self.out.append(Row(**dict(zip(("source", *FIELDS), (self.key[0], self.h["records"], kind, *pattern, *values), strict=True))))
        self.h["records"] += 1


def condense_stream(lines: DataFrame, config: Config = Config(), idle_ms: int = 600_000, multi_line: bool = True, ticks: str = "event", throttle_ms: int = 0, cap: int = MAX_LINES) -> DataFrame:
    """lines: source, line_no, raw, arrival_ts. Records: source, n (their order in the source), type (event, anomaly, repeat_summary), severity,
    template, lines, count, rates, event_no and n_lines. ticks: are waits looked through after each event, as in the batch plan, or after each "line",
    as a filter does, then with throttle_ms=125 at most as often."""
    if ticks not in ("event", "line"):
        raise ValueError(f"ticks must be event or line, not {ticks!r}")
    parsed = parse(lines)
    rows = parsed.select(
        "source", F.col("line_no").cast("long").alias("line_no"), F.unix_micros(F.col("arrival_ts").cast("timestamp")).alias("us"), F.col("severity").cast("int").alias("severity"), "content", normalize.template(F.col("content")).alias("template"),
        line_code(F.col("raw"), F.col("content")).cast("int").alias("code"),
    )
    out = StructType([StructField("source", lines.schema["source"].dataType), *StructType.fromDDL(OUT).fields])
    return rows.groupBy("source").transformWithState(Condenser(config, idle_ms, multi_line, ticks == "line", throttle_ms, cap), out, "append", "ProcessingTime")


def shown(records: DataFrame) -> DataFrame:
    """The stream's records as sinks.records() gives them, for to_json and to_text: source, emit_no (the record's number) and seq stay for the order."""
    named = with_fingerprints(records)
    new = F.col("type") == "event"
    return named.select(
        "type", "fingerprint", severity.level_name(F.col("severity")).alias("severity"), F.nullif("template", F.lit("")).alias("template"), "lines", "count", F.when(new, F.lit(True)).alias("new"),
        *(F.when(F.col("type") == "anomaly", F.col(c)).alias(c) for c in ("baseline_per_min", "current_per_min")), F.when(F.col("bootstrap"), F.lit(True)).alias("bootstrap"), "source", F.col("n").alias("emit_no"), F.lit(0).cast("long").alias("seq"),
    )
