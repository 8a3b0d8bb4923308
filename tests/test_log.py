"""The log operators: severity, templates, fingerprints, multi-line events, anomalies, bounded tracking, sinks, settings."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from condenspark.functions import fingerprint, normalize, severity
from condenspark.operators import anomaly, lru, multiline, patterns, sinks
from condenspark.operators.anomaly import History
from condenspark.plans.condense import condense, output
from condenspark.plans.config import Config
from condenspark.plans.correctness import correctness
from condenspark.sources import scenarios
from condenspark.sources.lines import clean_line, split_column, with_cap

LEVELS = [
    ("level=info msg=x", "INFO", "msg=x"), ("##[error]Process", "ERROR", "Process"), ("Connection ERROR=5", "UNKNOWN", "Connection ERROR=5"), ("INFO2 x", "UNKNOWN", "INFO2 x"),
    ("[ERROR foo", "ERROR", "foo"), ("an error occurred", "ERROR", "occurred"), ("[Error_x]", "ERROR", "_x]"), ("2026-08-30 03:01:07 plain", "UNKNOWN", "plain"), ("Aug 30 03:01:00 host x", "UNKNOWN", "host x"), ("", "UNKNOWN", ""),
]
TEMPLATES = [
    ("v1.4.2", "v1.[NUM]"), ("abc123%", "abc[PCT]%"), ("abc-1-10.0.0.1", "abc-1-[IP]"), ("-5 -5.5ms", "-[NUM] -[DURATION]"), ("10.0.0.1:99999999", "[IP]:[NUM]"), ("123456789012", "[HASH]"), ("_abc1234", "_abc1234"),
    ("5 hours", "[NUM] hours"), ("3 MB", "[SIZE]"), ("sha256", "[ID]"), ("fe80::1", "fe80::[NUM]"), ("2001:db8::8a2e:370:7334", "[NUM]:db8::[IPV6]"), ("Aug 30 03:01:00 host", "Aug [NUM] [TIME] host"),
    ("00:11:22:33:44:55", "[TIME]:[TIME]"), ("00:1a:2b:3c:4d:5e", "[MAC]"), ("10-20 1_000", "10-20 1_000"), ("", ""), ("é123", "é[NUM]"),
]


def test_severity_and_prefix(spark):
    rows = spark.createDataFrame(LEVELS, "raw string, level string, content string")
    got = rows.select("raw", severity.level_name(severity.severity(F.col("raw"))), severity.content(F.col("raw"))).collect()
    assert [tuple(r) for r in got] == LEVELS


def test_templates(spark):
    rows = spark.createDataFrame(TEMPLATES, "m string, want string").select("m", normalize.template(F.col("m")))
    assert [tuple(r) for r in rows.collect()] == TEMPLATES


def test_fingerprints(spark):
    rows = spark.createDataFrame([(3, "a"), (3, "Connection pool active. [NUM] connections open.")], "s int, t string")
    assert [r[0] for r in rows.select(fingerprint.fingerprint(F.col("s"), F.col("t"))).collect()] == ["e1f6ee1870f7d335", "380c682975a463f5"]


POOL = ["INFO a", "INFO b", "  at x", "\tat y(z)", "", "panic: boom", "goroutine 1 [running]:", "main.run(0x1)", "Traceback (most recent call last):", '  File "a.py", line 3', "  Traceback (most recent call last):", "ValueError: x", "Caused by: y", "exit status 2", "plain"]


@pytest.mark.parametrize(("chunk", "cap"), [(7, 500), (5, 4), (3, 9), (1 << 16, 500)])
def test_multiline_equals_the_fold(spark, chunk, cap):
    """Also stretches without a sure start, over many chunks; numbers with gaps and below 0; a null source."""
    rng, rows = random.Random(1), []
    for s in range(120):
        own = POOL if s % 3 else [x for x in POOL if x not in ("INFO a", "INFO b", "plain")]
        at = rng.randrange(-20, 20)
        for _ in range(rng.randrange(1, 60)):
            rows.append((s if s % 40 else None if s else 0, at, rng.choice(own)))
            at += 1 if rng.random() < 0.9 else rng.randrange(2, 30)
    rows = list({(s, n): (s, n, x) for s, n, x in rows}.values())
    rows += [(999, 0, "INFO head")] + [(999, i, "  more") for i in range(1, 1203)]
    lines = patterns.parse(spark.createDataFrame(rows, "source long, line_no long, raw string")).repartition(5)
    classed = lines.select("source", "line_no", multiline.line_class(F.col("content")).alias("kind"), multiline.line_mode(F.col("raw"), F.col("content")).alias("opens"), "raw", "severity").collect()
    want, by = [], {}
    for r in sorted(classed, key=lambda r: r.line_no):
        by.setdefault(r.source, []).append(r)
    for source, own in by.items():
        starts = [i for i, f in enumerate(multiline.flags([r.kind for r in own], [r.opens for r in own], cap)) if f]
        for i, j in zip(starts, [*starts[1:], len(own)], strict=True):
            want.append((source, own[i].line_no, own[i].severity, [r.raw for r in own[i:j]], j - i))
    got = [(r.source, r.event_no, r.severity, r.lines, r.n_lines) for r in multiline.events(lines, chunk, cap).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_a_stretch_without_a_start_spreads_over_tasks(spark):
    """Chunks of one source that has no sure start at all."""
    lines = patterns.parse(spark.range(30_000).select(F.lit("s").alias("source"), F.col("id").alias("line_no"), F.concat(F.lit("  deep "), F.col("id").cast("string")).alias("raw")))
    found = multiline.events(lines, chunk=1000)
    assert {(r.n_lines, r["count"]) for r in found.groupBy("n_lines").count().collect()} == {(500, 60)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tasks = found.select(F.spark_partition_id().alias("p"), "event_no").groupBy("p").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) >= 4 and max(r["count"] for r in tasks) <= 30


def test_lines_are_scanned_twice(spark):
    """An accumulator at the scan: whatever the options and however many patterns, lines are read twice."""
    words = spark.range(400).select(F.lit("s").alias("source"), F.col("id").alias("line_no"), F.timestamp_seconds(F.col("id") + 1_780_000_000).alias("ts"), F.concat(F.lit("[INFO] word"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("raw")).collect()
    rows = spark.createDataFrame(words)
    for multi_line in (False, True):
        for config in (Config(), Config(max_patterns=50)):
            for clock in ("constant",) if config.max_patterns > 50 else ("event",):
                seen = spark.sparkContext.accumulator(0)

                def scan(batches, seen=seen):
                    for batch in batches:
                        seen.add(batch.num_rows)
                        yield batch

                decided = condense(rows.mapInArrow(scan, rows.schema), config, multi_line=multi_line, clock=clock)
                assert decided.where("is_new").count() == 400 and seen.value == 800, (multi_line, config.max_patterns, clock, seen.value)


def test_null_and_repeated_sources_lose_no_line(spark, tmp_path):
    rows = [(None, "[INFO] a\n[INFO] b\n[INFO] a"), (1, "[INFO] a\n  more"), (1, "[WARN] c\n[INFO] a"), (1, "[WARN] c\n[INFO] a"), (2, None), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    from condenspark.plans import queries

    blocks = sorted(((r.doc_id, r.event_no, r.n_lines) for r in queries.multiline_blocks(spark, str(tmp_path)).collect()), key=repr)
    assert blocks == sorted([(None, 0, 1), (None, 1, 1), (None, 2, 1), (1, 0, 2), (1, 0, 1), (1, 1, 1), (1, 0, 1), (1, 1, 1), (3, 0, 1)], key=repr)
    r = queries.multiline_condense(spark, str(tmp_path)).first()
    assert (r.raw_lines, r.displayed_events, r.suppressed_events, r.structural_patterns) == (10, 5, 4, 5)
    lines = spark.createDataFrame([(None, 0, "[INFO] a"), (None, 1, "[INFO] a"), (None, 2, "[ERROR] b"), ("s", 0, "[INFO] a")], "source string, line_no long, raw string")
    for multi_line in (False, True):
        got = sorted(((x.source, x.event_no, x.decision) for x in condense(lines, multi_line=multi_line).collect()), key=repr)
        assert got == sorted([(None, 0, "event"), (None, 1, "repeat"), (None, 2, "event"), ("s", 0, "repeat")], key=repr)


def test_cut_lines_are_counted_where_they_are_cut(spark):
    lines = with_cap(spark.createDataFrame([("s", 0, "[INFO] " + "x" * 50), ("s", 1, "  " + "y" * 50), ("s", 2, "[INFO] ends in ...[truncated]"), ("s", 3, None)], "source string, line_no long, raw string"), max_bytes=40)
    for multi_line in (True, False):
        assert patterns.report(condense(lines, multi_line=multi_line)).first().truncated_lines == 2


def test_lru_keys_are_exact(spark):
    keys = [2**60, 2**60 + 1, None, 2**60, None, 2**60 + 1, 5, None]
    rows = spark.createDataFrame(list(enumerate(keys)), "at long, k long")
    for bound, block in ((2, 3), (10, 64)):
        assert [(r.k, r.novel) for r in lru.novelty(rows, "k", "at", bound, block).orderBy("at").collect()] == list(zip(keys, lru.replay(keys, [], bound), strict=True))


def test_groups_have_a_bound_each(spark):
    rng = random.Random(14)
    rows = [(i, rng.randrange(3), rng.randrange(12)) for i in range(900)]
    for bound, block in ((4, 32), (5, 1 << 16)):
        got = {r.at: r.novel for r in lru.novelty(spark.createDataFrame(rows, "at long, g int, k long"), "k", "at", bound, block, fan=2, group="g").collect()}
        for g in range(3):
            own = [(at, k) for at, h, k in rows if h == g]
            assert [got[at] for at, _ in own] == lru.replay([k for _, k in own], [], bound)


def test_rates_begin_anew_after_eviction(spark):
    """By the events' clock, against a replay of histories in a bounded store."""
    rng, rows, at = random.Random(8), [], 1_780_000_000.0
    for i in range(900):
        at += rng.choice([0.0, 0.05, 0.3, 2.0])
        rows.append(("s", i, rng.choice([3, 6]), rng.choice("ab") if i % 100 < 70 else rng.choice("abcdefgh"), at))
    events = spark.createDataFrame(rows, "source string, event_no long, severity byte, template string, at double").withColumn("ts", F.timestamp_micros((F.col("at") * 1e6).cast("long")))
    for bound, block in ((3, 64), (3, 1 << 16), (5, 128), (100, 64)):
        config, store, want = Config(max_patterns=bound, cooldown=20.0, spike_multiplier=1.3, protect_multiplier=1.1), {}, {}
        for _, i, level, template, t in rows:
            new = (level, template) not in store
            history = store.pop((level, template), None) or History()
            spike = history.record(int(t * 1e6) / 1e6, level >= 6, config)[0]
            store[level, template] = history
            if len(store) > bound:
                store.pop(next(iter(store)))
            want[i] = "anomaly" if spike else "event" if new else "repeat"
        got = {r.event_no: r.decision for r in patterns.decide_by_clock(events, config, block_rows=block).collect()}
        assert got == want and {"anomaly", "event", "repeat"} == set(want.values())


def test_anomalies():
    c = Config()
    h = History()
    assert not any(h.record(i * 5.0, False, c)[0] for i in range(100))  # steady
    h = History()
    got = [h.record(0.1 * i, True, c) for i in range(12)]
    assert [k for k, r in enumerate(got) if r[0]] == [9] and got[9] == (True, 1.0, 40.0, True)
    h = History()
    for i in range(12):
        h.record(5.0 * i, False, c)
    assert any(h.record(61 + 0.01 * i, False, c)[0] for i in range(60))


def test_alerts_equal_a_replay(spark):
    rng = random.Random(12)
    for config in (Config(), Config(cooldown=3.0, window=5, spike_multiplier=1.5), Config(cooldown=0.0, window=31, min_window_events=2, spike_multiplier=1.2)):
        rows, at = [], 1_780_000_000.0
        for i in range(1500):
            at += rng.choice([0.0, 0.01, 0.2, 1.0, 4.0, 40.0 if rng.random() < 0.1 else 0.5])
            rows.append(("s", i, rng.choice([3, 6]), rng.choice(["a", "b"]), at))
        events = spark.createDataFrame(rows, "source string, event_no long, severity byte, template string, at double").withColumn("ts", F.timestamp_micros((F.col("at") * 1e6).cast("long")))
        got = {(r.event_no, round(r.baseline_per_min, 6), round(r.current_per_min, 6), r.bootstrap) for r in anomaly.alerts(events, config).collect()}
        histories, want = {}, set()
        for _, i, level, template, t in rows:
            spike, base, current, assumed = histories.setdefault((level, template), History()).record(int(t * 1e6) / 1e6, level >= 6, config)
            if spike:
                want.add((i, round(base, 6), round(current, 6), assumed))
        assert want and got == want


def test_timed_summaries_equal_a_replay(spark):
    rng, rows, now = random.Random(13), [], 0
    for i in range(900):
        now += rng.choice([0, 50, 200, 900, 2500 if rng.random() < 0.1 else 0])
        rows.append((i % 3 // 2, i, rng.choice([3, 6]), rng.choice("ab"), rng.choice(["repeat"] * 6 + ["anomaly", "event"]), 1_780_000_000_000 + now - rng.choice([0, 0, 30])))
    decided = spark.createDataFrame(rows, "source int, event_no long, severity byte, template string, decision string, ms long").withColumn("ts", F.timestamp_millis("ms"))
    want = []
    for source in (0, 1):
        waits, clock = {}, 0
        for _, i, level, template, decision, ms in (r for r in rows if r[0] == source):
            clock, key = max(clock, ms), (level, template)
            if decision == "anomaly" and key in waits:
                want.append((*key, source, waits.pop(key)[1], i))
            if decision == "repeat":
                waits.setdefault(key, [clock, 0])[1] += 1
            for k in [k for k, (since, _) in waits.items() if clock >= since + (500 if k[0] >= 6 else 2000)]:
                want.append((*k, source, waits.pop(k)[1], i))
        want += [(*k, source, n, None) for k, (_, n) in waits.items()]
    for chunk in (7, 1 << 16):
        got = [(r.severity, r.template, r.source, r["count"], r.emit_no) for r in patterns.timed_summaries(decided, chunk=chunk).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_records_in_order_and_their_text(spark):
    rows = [("s", i, f"[ERROR] stuck {i}", 1000.0 + 0.001 * i) for i in range(12)] + [("s", 12, "[INFO] on", 1003.0), ("s", 13, "[INFO] on", 1003.1)]
    lines = spark.createDataFrame(rows, "source string, line_no long, raw string, at double").withColumn("ts", F.timestamp_micros((F.col("at") * 1e6).cast("long")))
    found = [(r.type, r["count"]) for r in sinks.in_order(output(lines, clock="event")).collect()]
    assert found == [("event", 1), ("repeat_summary", 8), ("anomaly", None), ("event", 1), ("repeat_summary", 2), ("repeat_summary", 1)]
    text = [r.value for r in sinks.to_text(sinks.in_order(output(lines, clock="event"))).collect()]
    assert text[:3] == ["✖ ERROR stuck 0\n", "✖ ERROR stuck [NUM]\n  × 8\n", "🚨 FREQUENCY SPIKE (new pattern)\n   stuck 9\n   no prior history - already occurring at 40/min\n"]
    assert "\x1b[31m" in sinks.to_text(sinks.in_order(output(lines)), colour=True).first().value
    r = patterns.report(condense(lines))
    assert {x.name: x.value for x in sinks.stats(r, 2.0).collect()}["anomalies detected"] == "1" and sinks.impact(r, 2.0).count() == 1
    with pytest.raises(ValueError):
        condense(lines, clock="wall")


#: Lines, shown, suppressed, patterns, anomalies, percent of events and of lines, retained.
GOLDEN = {
    "build-failure": (105, 16, 89, 16, 0, 84.76, 84.76, 2), "go-panic": (138, 2, 129, 2, 0, 98.47, 93.48, 1), "java-trace": (237, 2, 229, 2, 0, 99.13, 96.62, 2), "pool-exhausted": (337, 6, 328, 6, 0, 98.20, 97.33, 2),
    "python-trace": (196, 2, 189, 2, 0, 98.95, 96.43, 1), "restart-loop": (321, 10, 311, 9, 1, 96.88, 96.88, 2), "sign-in-burst": (551, 3, 548, 3, 0, 99.46, 99.46, 1),
}


def test_scenarios(spark):
    names = list(GOLDEN)
    got = correctness(scenarios.lines(spark, names), scenarios.manifests(spark, names)).collect()
    found = {r.scenario: (r.input_lines, r.displayed_events, r.suppressed_events, r.structural_patterns, r.anomaly_events, r.logical_event_suppression_percentage, r.raw_line_suppression_percentage, r.known_important_retained) for r in got}
    assert found == GOLDEN and all(r.missed is None for r in got)


def test_scenarios_have_stores_of_their_own(spark):
    """Against a run for each: also with a bound that some exceed, a manifest without lines and lines without a manifest."""
    names = ["go-panic", "build-failure", "sign-in-burst"]
    lines = scenarios.lines(spark, names)
    for bound in (3, 10_000):
        config = Config(max_patterns=bound)
        got = {r.scenario: r for r in correctness(lines, scenarios.manifests(spark, names[:2]).union(spark.createDataFrame([("absent", True, 0, ["x"], "")], "a string, b boolean, c long, d array<string>, e string")), config).collect()}
        assert set(got) == {"go-panic", "build-failure", "absent"} and (got["absent"].input_lines, got["absent"].missed, got["absent"].displayed_events) == (0, ["x"], 0)
        for name in names[:2]:
            alone = patterns.report(condense(lines.where(F.col("source") == name), config), config).first()
            assert (got[name].input_lines, got[name].displayed_events, got[name].suppressed_events, got[name].structural_patterns) == (alone.raw_lines, alone.displayed_events, alone.suppressed_events, alone.structural_patterns)


def test_templates_keep_every_text_and_span_no_line_end(spark):
    rows = [("[5:0:_K", "[[IPV6]_K"), ("202412.5abc50%", "202412.5abc[PCT]%"), ("took 12ms\n5 GB of 10.1.1.1\n3", "took [DURATION]\n[SIZE] of [IP]\n[NUM]"), ("2026-01-02\n03:04:05", "[DATE]\n[TIME]"), ("x" * 70_000 + " 5", "x" * 70_000 + " [NUM]"), (None, None)]
    got = spark.createDataFrame(rows, "m string, want string").select(normalize.template(F.col("m")), "want").collect()
    assert all(r[0] == r[1] for r in got)


def test_levels_are_looked_for_in_bytes(spark):
    rows = spark.createDataFrame([("é" * 95 + " ERROR x",), ("é" * 99 + " ERROR x",), ("é" * 120 + " ERROR x",)], "raw string")
    assert [r[0] for r in rows.select(severity.severity(F.col("raw")).cast("int")).collect()] == [6, 0, 0]


def test_constant_clock(spark):
    lines = spark.createDataFrame([("s", i, f"2026-08-30 03:01:0{i % 10} [ERROR] timeout after {i}ms") for i in range(20)] + [("s", 20 + i, f"[INFO] ok {i}") for i in range(980)], "source string, line_no long, raw string")
    decided = condense(lines).cache()
    r = patterns.report(decided).first()
    assert (r.raw_lines, r.displayed_events, r.suppressed_events, r.structural_patterns, r.anomaly_events) == (1000, 3, 997, 2, 1)
    kinds = {x.type: x for x in sinks.records(decided, Config()).orderBy("count").collect()}
    assert set(kinds) == {"event", "repeat_summary", "anomaly"} and kinds["anomaly"].current_per_min == 40.0
    assert sinks.to_text(sinks.records(decided, Config())).count() == 5
    empty = patterns.report(condense(lines.where("false"))).first()
    assert empty.raw_lines == 0 and empty.logical_event_suppression_percentage == 0


def test_lru_equals_replay(spark):
    rng = random.Random(7)
    keys = [rng.randrange(30) for _ in range(600)]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "at long, k long")
    for bound in (1, 3, 12, 100):
        got = [r.novel for r in lru.novelty(rows, "k", "at", bound, 64).orderBy("at").collect()]
        assert got == lru.replay(keys, [], bound)


def test_lru_merges_blocks_in_a_tree(spark):
    rng = random.Random(9)
    keys = [rng.randrange(40) if i % 90 < 60 else i % 7 for i in range(1500)]
    rows = spark.createDataFrame(list(enumerate(keys)), "at long, k long")
    for bound in (25,):
        found = lru.novelty(rows, "k", "at", bound, 16, fan=3)
        assert [r.novel for r in found.orderBy("at").collect()] == lru.replay(keys, [], bound)
    last = lru.latest(rows.select(F.lit(0).cast("long").alias("group"), (F.col("at") / 16).cast("long").alias("block"), F.col("k").alias("key"), F.col("at").alias("last")), 25)
    groups = lru.latest(last.withColumn("block", F.floor(F.col("block") / 3)), 25)
    assert groups.count() < last.count() and groups.groupBy("block").count().agg(F.max("count")).first()[0] <= 25


def test_decisions_equal_a_replay_of_the_bounded_store(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta"]
    rows = [(f"s{i // 250}", i % 250, f"[{rng.choice(['ERROR', 'INFO'])}] {rng.choice(words[:2]) if i % 60 < 40 else rng.choice(words)}") for i in range(600)]
    lines = spark.createDataFrame(rows, "source string, line_no long, raw string").repartition(5)
    for bound in (4,):
        want, seen = {}, {}
        for source, no, raw in rows:
            n = seen.pop(raw, 0) + 1
            seen[raw] = n
            if len(seen) > bound:
                seen.pop(next(iter(seen)))
            want[source, no] = "anomaly" if n == 10 and "ERROR" in raw else "event" if n == 1 else "repeat"
        config = Config(max_patterns=bound)
        events = condense(lines, config, multi_line=False).drop("is_spike", "is_new", "decision")
        for block in (16, 1 << 16):
            decided = patterns.decide(events, config, block_rows=block)
            assert {(r.source, r.event_no): r.decision for r in decided.select("source", "event_no", "decision").collect()} == want
        assert patterns.report(decided, config).first().structural_patterns == bound


def test_lines(spark):
    rows = spark.createDataFrame([("a\r",), ("x" * 30,), ("",), ("é" * 6,)], "v string")
    assert [r[0] for r in rows.select(clean_line(F.col("v"), 11, "!")).collect()] == ["a", "x" * 11 + "!", "", "é" * 5 + "!"]


def test_lines_of_a_column_are_whole(spark):
    long = "x" * 300_000 + " 10.0.0.1"
    rows = spark.createDataFrame([(1, f"a\r\n{long}\n")], "doc_id long, text string")
    assert [(r.line_no, r.raw) for r in split_column(rows, "doc_id", "text").collect()] == [(0, "a"), (1, long), (2, "")]
    assert [r.truncated for r in split_column(rows, "doc_id", "text", 1000).collect()] == [False, True, False]


def test_retention_keeps_items_without_text(spark, tmp_path):
    from condenspark.plans.queries import retention

    spark.createDataFrame([(1, "Some Text"), (2, None), (3, "absent"), (4, "some text")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([("here is some text.",), (None,)], "text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(tuple(r) for r in retention(spark, str(tmp_path)).collect()) == [(1, True), (2, False), (3, False), (4, True)]


def test_retention_equals_contains(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["ab", "cd", "abc", "x"]) for _ in range(12)) + rng.choice(["", "\n", "\tz"]) for _ in range(40)] + [None]
    needles = ["b", "ab cd", "", None, *{t[a : a + rng.randrange(1, 25)] for t in texts[:20] for a in range(0, 20, 5)}, "ab  cd x", "q ab q"]
    rows, shown = spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(t,) for t in texts], "text string")
    for most in (10_000, 5):
        got = {r.needle: r.retained for r in patterns.retention(shown, rows, "text", "needle", most).collect()}
        assert got == {n: n is not None and any(t is not None and n in t for t in texts) for n in needles}


@pytest.mark.parametrize("bad", [{"window": 0}, {"spike_multiplier": 1.0}, {"protect_multiplier": float("inf")}, {"max_patterns": -1}, {"cooldown": -1.0}, {"severity_protect": "INFO"}, {"min_window_events": 0}])
def test_settings(bad):
    with pytest.raises(ValueError):
        Config(**bad)
    assert Config().buckets == 3 and Config(window=1).buckets == 1 and Config(severity_protect=" warning ").protect_rank == 5


def test_an_event_has_the_time_of_the_line_that_closes_it(spark):
    rows = [("s", 0, "[INFO] a", 10), ("s", 1, "  more", 11), ("s", 2, "[INFO] b", 20), ("t", 0, "[INFO] a", 30), ("t", 1, "  more", 31), (None, 5, "[INFO] c", 40), (None, 6, "[INFO] c", 41)] + [("u", i, "  deep", 100 + i) for i in range(501)]
    lines = spark.createDataFrame(rows, "source string, line_no long, raw string, at long").withColumn("ts", F.timestamp_seconds("at"))
    got = {(r.source, r.event_no): r.at for r in condense(lines, clock="event").select("source", "event_no", F.unix_seconds("ts").alias("at")).collect()}
    assert got == {("s", 0): 20, ("s", 2): 20, ("t", 0): 31, (None, 5): 41, (None, 6): 41, ("u", 0): 599, ("u", 500): 600}
