"""The plan on a stream equals the batch plan, however the log is cut into micro-batches."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from condenspark.operators import patterns, sinks
from condenspark.plans.condense import condense
from condenspark.plans.config import Config
from condenspark.streaming.condense import ROCKS, condense_stream, shown
from tests.test_log import POOL

LINES = "source string, line_no long, raw string, us long"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, folder, batches, config, name, ends=1, **options):
    """The stream's records of micro-batches of lines. It runs until so many sources have ended, each with a summary at its end."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, LINES).coalesce(1).write.json(str(folder / "in" / f"{k:03}"))
    lines = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(folder / "in")).withColumn("arrival_ts", F.timestamp_micros("us"))
    query = condense_stream(lines, config, **options).writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder / "check")).outputMode("append")
    query = query.start()
    try:
        until = time.time() + 120
        while time.time() < until and query.isActive and spark.table(name).where("event_no is null").select("source").distinct().count() < ends:
            time.sleep(0.5)
        if query.exception():
            raise query.exception()
    finally:
        query.stop()
    return spark.table(name)


def as_rows(records):
    return [(r.type, r.severity, r.template, r.lines, r["count"], r.baseline_per_min and round(r.baseline_per_min, 6), r.current_per_min and round(r.current_per_min, 6), r.bootstrap) for r in records]


@pytest.mark.parametrize(("bound", "cuts"), [(10_000, 4), (3, 6)])
def test_stream_equals_the_batch_plan(spark, tmp_path, bound, cuts):
    rng, rows = random.Random(bound), {}
    for source in ("a", "b"):
        at, own = 1_780_000_000_000_000, []
        for i in range(220):
            at += rng.choice([0, 10_000, 200_000, 700_000, 3_000_000 if rng.random() < 0.2 else 0])
            own.append((source, i, rng.choice(POOL) if rng.random() < 0.5 else rng.choice(["[ERROR] stuck 5", "[ERROR] stuck 6", "[INFO] tick 7"]), at))
        own += [(source, 220 + i, "[INFO] last of all", at) for i in range(3)]
        rows[source] = own
    config = Config(max_patterns=bound, min_window_events=3, cooldown=3.0, window=10)
    marks = sorted(rng.sample(range(1, 223), cuts - 1))
    batches = [[r for own in rows.values() for r in own[a:b]] for a, b in zip([0, *marks], [*marks, 223], strict=True)]
    for b in batches:
        rng.shuffle(b)
    batches[-1] += [(source, None, None, None) for source in rows]
    got = streamed(spark, tmp_path, batches, config, f"equal_{bound}", ends=2)
    for source, own in rows.items():
        lines = spark.createDataFrame(own, LINES).withColumn("ts", F.timestamp_micros("us"))
        decided = condense(lines, config, clock="event")
        want = as_rows(sinks.in_order(sinks.records(decided, config, patterns.timed_summaries(decided))).collect())
        found = as_rows(shown(got.where(F.col("source") == source)).orderBy("emit_no").collect())
        assert found == want and {"event", "repeat_summary", *(["anomaly"] if bound > 3 else [])} == {r[0] for r in want}
    assert got.where("type <> 'repeat_summary'").count() + got.agg(F.sum(F.when(F.col("type") == "repeat_summary", F.col("count")))).first()[0] == sum(condense(spark.createDataFrame(own, LINES)).count() for own in rows.values())


def test_waits_are_looked_through_as_a_filter_does(spark, tmp_path):
    """After each line, at most every 125 ms: against a replay."""
    rng, at, rows = random.Random(2), 1_780_000_000_000_000, []
    for i in range(300):
        at += rng.choice([0, 20_000, 60_000, 90_000, 400_000 if rng.random() < 0.3 else 0])
        rows.append(("s", i, rng.choice(["[ERROR] x 1", "[INFO] y 2", "[INFO] z 3"]), at))
    waits, seen, checked, want = {}, set(), -(1 << 62), []
    for _, i, raw, us in rows:
        if raw in seen:
            waits.setdefault(raw, [0, us])[0] += 1
        seen.add(raw)
        if waits and us - checked >= 125_000:
            checked = us
            for k in [k for k, (_, since) in waits.items() if us - since >= (500_000 if "ERROR" in k else 2_000_000)]:
                want.append((k[k.index("]") + 2 :][0], waits.pop(k)[0], i))
    assert waits  # the source ends with a summary
    want += [(k[k.index("]") + 2 :][0], n, None) for k, (n, _) in waits.items()]
    config = Config(min_window_events=10_000)
    got = streamed(spark, tmp_path, [rows[:140], [*rows[140:], ("s", None, None, None)]], config, "ticks", multi_line=False, ticks="line", throttle_ms=125)
    found = [(r.template[0], r["count"], r.event_no) for r in got.where("type = 'repeat_summary'").orderBy("n").collect()]
    assert found == want
    text = [r.value for r in sinks.to_text(shown(got).where("type = 'repeat_summary'").orderBy("emit_no")).collect()]
    assert text[0].endswith(f"  × {want[0][1]}\n")
    with pytest.raises(ValueError):
        condense_stream(spark.readStream.format("rate").load(), ticks="never")


def test_an_idle_source_ends_by_its_timer(spark, tmp_path):
    rows = [("s", i, "[INFO] again and again", 1_780_000_000_000_000 + i) for i in range(6)] + [("s", 6, "[ERROR] odd", 1_780_000_000_000_007), ("s", 7, "  with more", 1_780_000_000_000_008)]
    got = streamed(spark, tmp_path, [rows], Config(), "idle", idle_ms=3_000).orderBy("n").collect()
    assert [(r.type, r["count"], r.n_lines) for r in got] == [("event", 1, 1), ("event", 1, 2), ("repeat_summary", 5, None)]


def test_files_that_arrive_are_condensed(spark, tmp_path):
    from condenspark.sources.lines import read_lines, stream_lines

    for name, text in (("a.log", "[INFO] tick 1\r\n[INFO] tick 2\n[ERROR] odd\n  more\n  still more\n"), ("b.log", "[INFO] tick 3\n[INFO] tick 4\n")):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    query = condense_stream(stream_lines(spark, str(tmp_path / "in")), idle_ms=3_000).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").start()
    try:
        until = time.time() + 120
        while time.time() < until and query.isActive and spark.table("arrived").where("event_no is null").count() < 2:
            time.sleep(0.5)
    finally:
        query.stop()
    got = {}
    for r in spark.table("arrived").orderBy("n").collect():
        got.setdefault(r.source[-5:], []).append((r.type, r["count"], r.lines))
    assert got == {"a.log": [("event", 1, ["tick 1"]), ("event", 1, ["odd", "  more", "  still more"]), ("repeat_summary", 1, None)], "b.log": [("event", 1, ["tick 3"]), ("repeat_summary", 1, None)]}
    assert [r.raw for r in read_lines(spark, str(tmp_path / "in" / "a.log")).orderBy("line_no").collect()] == ["[INFO] tick 1", "[INFO] tick 2", "[ERROR] odd", "  more", "  still more"]
