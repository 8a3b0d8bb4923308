"""Patterns: events that share severity and template. Counts, novelty, decisions by the constant clock, and reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condenspark.functions import fingerprint as fp
from condenspark.functions import normalize, severity
from condenspark.operators import lru
from condenspark.operators.scratch import numbered, written
from condenspark.plans.config import Config

KEY = ["severity", "template"]


def parse(lines: DataFrame) -> DataFrame:
    """lines with severity and content."""
    return lines.withColumns({"severity": severity.severity(F.col("raw")), "content": severity.content(F.col("raw"))})


def with_templates(events: DataFrame, text: str = "content") -> DataFrame:
    """events with the template of text, row by row: no shuffle, however often a text repeats. A null text has a null template."""
    return events.withColumn("template", normalize.template(F.col(text)))


def with_block_templates(events: DataFrame) -> DataFrame:
    """The same for contents of several lines, joined by line ends; no class or token spans a line end."""
    return events.withColumn("template", normalize.template(F.array_join("contents", "\n")))


def counts(events: DataFrame, order: str = "event_no", time: str | None = None) -> DataFrame:
    """severity, template, total_count, first and last order (and time), example (the first event's lines)."""
    extra = [F.min(time).alias("first_seen"), F.max(time).alias("last_seen")] if time else []
    example = [F.min_by("lines", F.struct("source", order)).alias("example")] if "lines" in events.columns else []
    return events.groupBy(*KEY).agg(F.count("*").alias("total_count"), F.min(order).alias("first_no"), F.max(order).alias("last_no"), *extra, *example)


def with_fingerprints(patterns: DataFrame) -> DataFrame:
    return patterns.withColumn("fingerprint", fp.fingerprint(F.col("severity"), F.col("template")))


def keyed(events: DataFrame, order: tuple[str, ...], time: str | None = None, by_source: bool = False) -> DataFrame:
    """order, severity, store, pattern (64 bits of severity and template) and us (the time) of all events, written once: what decisions are made
    from, without the templates. All events share one store of patterns, or each source has its own."""
    us = [F.unix_micros(F.col(time).cast("timestamp")).alias("us")] if time else []
    store = F.xxhash64("source") if by_source else F.lit(0).cast("long")
    return written(events.select(*order, "severity", store.alias("store"), F.xxhash64(*KEY, *(["source"] if by_source else [])).alias("pattern"), *us), "keys")


def tracked(keys: DataFrame, order: tuple[str, ...], bound: int, block_rows: int = 1 << 16) -> DataFrame:
    """keys with generation: how often the event's pattern has been new up to it. A store tracks at most bound patterns; one that comes back after
    the least recently used went is new again. If no store has more than bound patterns all are of generation 1, and the order doesn't matter.
    Else novelty is counted in blocks of events and carried from block to block, so a common pattern spreads over tasks."""
    if not keys.select("store", "pattern").distinct().groupBy("store").count().where(F.col("count") > bound).limit(1).count():
        return keys.withColumn("generation", F.lit(1).cast("long"))
    rows = numbered(keys, order, "at")
    found = written(lru.novelty(rows.select("store", "pattern", "at"), "pattern", "at", bound, block_rows, group="store"), "novelty").withColumn("block", F.floor(F.col("at") / block_rows))
    by_block = Window.partitionBy("pattern").orderBy("block")
    carried = found.groupBy("pattern", "block").agg(F.count_if("novel").alias("n")).select("pattern", "block", (F.sum("n").over(by_block) - F.col("n")).alias("before"))
    own = F.sum(F.col("novel").cast("int")).over(Window.partitionBy("pattern", "block").orderBy("at"))
    since = found.withColumn("own", own).join(carried, ["pattern", "block"]).select("at", (F.col("own") + F.col("before")).alias("generation"))
    return written(rows.join(since, "at").drop("at"), "generations")


def marks(keys: DataFrame, order: tuple[str, ...], at: int) -> DataFrame:
    """order and nth of the first and the at-th event of each pattern and generation. Only so many rows of one are ranked."""
    nth = F.row_number().over(Window.partitionBy("pattern", "generation").orderBy(*order))
    return keys.withColumn("nth", nth).where(F.col("nth") <= at).where(F.col("nth").isin(1, at)).select(*order, "nth")


def _met(events: DataFrame, found: DataFrame, order: tuple[str, ...], columns: list[Column]) -> DataFrame:
    """events with columns aggregated from the rows of found of the same order; null orders are equal."""
    told = found.groupBy(*order).agg(*columns).withColumnsRenamed({c: f"__of_{c}" for c in order})
    same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in order]
    return events.join(written(told, "decisions"), same, "left").drop(*(f"__of_{c}" for c in order))


def decide(events: DataFrame, config: Config, order: tuple[str, ...] = ("source", "event_no"), block_rows: int = 1 << 16, by_source: bool = False) -> DataFrame:
    """decision: anomaly, event (a pattern's first) or repeat, as if all events came at one time. Then a protected pattern alerts once, at
    the occurrence that reaches every limit, and nothing else does. Of more patterns than max_patterns the least recently used
    goes, and is new when it comes back. by_source: each source for itself, all at once.

    Events are read twice: once for their keys, which are written and from which all is decided, and once to meet the decisions."""
    at = max(config.min_bootstrap_events, config.min_window_events, -(-int(config.assumed_per_minute * config.protect_multiplier * config.window_seconds) // 60))
    found = marks(tracked(keyed(events, order, by_source=by_source), order, config.max_patterns, block_rows), order, at)
    out = _met(events, found, order, [F.max(F.col("nth") == 1).alias("is_new"), F.max(F.col("nth") == at).alias("is_spike")])
    spike = F.coalesce("is_spike", F.lit(False)) & (severity.rank(F.col("severity")) >= config.protect_rank)
    out = out.withColumns({"is_spike": spike, "is_new": F.coalesce("is_new", F.lit(False))})
    return out.withColumn("decision", F.when(F.col("is_spike"), "anomaly").when(F.col("is_new"), "event").otherwise("repeat"))


def decide_by_clock(events: DataFrame, config: Config, time: str = "ts", order: tuple[str, ...] = ("source", "event_no"), block_rows: int = 1 << 16, by_source: bool = False) -> DataFrame:
    """The same by the events' own times: anomalies as anomaly.alerts() finds them, with baseline_per_min, current_per_min and bootstrap.
    New patterns are as in decide(). One that comes back after eviction begins a new history of rates and may alert at once."""
    from condenspark.operators.anomaly import alerts

    keys = tracked(keyed(events, order, time, by_source), order, config.max_patterns, block_rows)
    told = ["baseline_per_min", "current_per_min", "bootstrap"]
    rated = keys.select(*order, "severity", F.xxhash64("pattern", "generation").alias("template"), F.timestamp_micros("us").alias("at"))
    found = alerts(rated, config, "at", order).select(*order, F.lit(False).alias("is_new"), *told)
    firsts = marks(keys, order, 1).select(*order, F.lit(True).alias("is_new"), *(F.lit(None).cast(found.schema[c].dataType).alias(c) for c in told))
    out = _met(events, found.union(firsts), order, [F.max(c).alias(c) for c in ("is_new", *told)])
    out = out.withColumns({"is_spike": F.col("current_per_min").isNotNull(), "is_new": F.coalesce("is_new", F.lit(False))})
    return out.withColumn("decision", F.when(F.col("is_spike"), "anomaly").when(F.col("is_new"), "event").otherwise("repeat"))


def repeat_summaries(decided: DataFrame) -> DataFrame:
    """severity, template, count of the repeats that were not shown one by one; due at the end (source and emit_no null), in the order of
    the first repeats (seq). They are numbered in ranges, and written for that."""
    found = decided.where("decision = 'repeat'").groupBy(*KEY).agg(F.count("*").alias("count"), F.min(F.struct("source", "event_no")).alias("first"))
    source = decided.schema["source"].dataType
    placed = numbered(written(found, "summaries"), ("first",), "seq")
    return placed.select(*KEY, "count", F.lit(None).cast(source).alias("source"), F.lit(None).cast("long").alias("emit_no"), (F.col("seq") + 1).alias("seq"))


#: Milliseconds that repeats wait for their summary, by the rank of their level; the last is for errors and above.
FLUSH_MS, FLUSH_ERROR_MS = 2000, 500


def timed_summaries(decided: DataFrame, time: str = "ts", chunk: int = 1 << 16) -> DataFrame:
    """KEY, source, count, emit_no and seq of the summaries of repeats by a clock. A pattern's repeats wait from the first of them on; the
    first event of the source, of any pattern, that comes an interval later lets them out, after itself; so does an anomaly of
    the pattern, before itself; what is left waits for the end (emit_no null). Each source has a clock of its own.

    Which event lets a wait out is found by windows, for each time of the clock as if a wait began at it: the clock doesn't go back, so of the
    events at one time only the first counts. A time's next one is looked for in its second, then in the seconds of its era, then in later
    eras, each by a window that runs from behind. A streamed fold over a pattern's repeats then takes the waits that do begin; patterns go as
    64 bits there, and many events at one time go by chunks."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    rows = written(decided.select("source", "event_no", *KEY, F.xxhash64(*KEY).alias("pattern"), "decision", us.alias("us"), F.floor(F.col("event_no") / chunk).alias("chunk")), "decided")
    names = rows.select("pattern", *KEY).distinct()
    # the clock of a source doesn't go back: the running maximum, by chunks of numbers
    tops = rows.groupBy("source", "chunk").agg(F.max("us").alias("top"))
    tops = tops.select(F.col("source").alias("of"), F.col("chunk").alias("in_chunk"), F.max("top").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("in_chunk"))
    inner = Window.partitionBy("source", "chunk").orderBy("event_no").rowsBetween(Window.unboundedPreceding, 0)
    clock = rows.withColumn("own", F.max("us").over(inner)).join(tops, same).withColumn("now", F.greatest("own", F.coalesce("earlier", "own")))
    slow = ~F.coalesce(severity.rank(F.col("severity")) >= 6, F.lit(False))
    clock = written(clock.select("source", "chunk", "event_no", "pattern", slow.alias("slow"), "decision", "now"), "clock")
    # the first event at or after a time: the clock's times (tick) and those that are asked for, in order
    times = written(clock.groupBy("source", "chunk", "now").agg(F.min("event_no").alias("first")), "times")
    ticks = times.groupBy("source", "now").agg(F.min("first").alias("first"))
    waits = F.array(F.lit(FLUSH_ERROR_MS * 1000), F.lit(FLUSH_MS * 1000))
    asked = ticks.select("source", "now", F.posexplode(waits).alias("slow", "wait")).select("source", (F.col("now") + F.col("wait")).alias("at"), F.lit(None).cast("long").alias("first"), "now", F.col("slow").cast("boolean").alias("slow"))
    every = ticks.select("source", F.col("now").alias("at"), "first", F.lit(None).cast("long").alias("now"), F.lit(None).cast("boolean").alias("slow")).union(asked)
    every = every.where("at is not null").withColumn("second", F.floor(F.col("at") / 1_000_000))
    seconds = every.groupBy("source", "second").agg(F.min("first").alias("first")).withColumn("era", F.shiftright("second", 12))
    behind = lambda *of: Window.partitionBy(*of[:-1]).orderBy(F.desc(of[-1])).rowsBetween(Window.unboundedPreceding, -1)
    eras = seconds.groupBy("source", "era").agg(F.min("first").alias("first"))
    eras = eras.select(F.col("source").alias("of"), F.col("era").alias("in_era"), F.min("first").over(behind("source", "era")).alias("later"))
    seconds = seconds.withColumn("next", F.min("first").over(behind("source", "era", "second")))
    seconds = seconds.join(eras, F.col("source").eqNullSafe(F.col("of")) & (F.col("era") == F.col("in_era"))).select("of", F.col("second").alias("in_second"), F.coalesce("next", "later").alias("later"))
    ahead = Window.partitionBy("source", "second").orderBy(F.desc("at"), F.desc_nulls_last("first")).rowsBetween(Window.unboundedPreceding, 0)
    found = every.withColumn("out", F.min("first").over(ahead)).where("slow is not null").join(seconds, F.col("source").eqNullSafe(F.col("of")) & (F.col("second") == F.col("in_second")))
    found = found.withColumn("out", F.coalesce("out", "later")).groupBy("of", "now").agg(F.max(F.when(F.col("slow"), F.col("out"))).alias("slow_out"), F.max(F.when(~F.col("slow"), F.col("out"))).alias("fast_out"))
    told = times.join(found.withColumnRenamed("now", "at"), F.col("source").eqNullSafe(F.col("of")) & (F.col("now") == F.col("at"))).select("of", F.col("chunk").alias("in_chunk"), "at", "slow_out", "fast_out")
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("in_chunk")) & (F.col("now") == F.col("at"))
    due = clock.where("decision <> 'event'").join(told, same, "left").select("source", "pattern", "event_no", "decision", F.when(F.col("slow"), F.col("slow_out")).otherwise(F.col("fast_out")).alias("out"))
    dealt = due.repartition("source", "pattern").sortWithinPartitions("source", "pattern", "event_no")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, out, first = None, 0, None, None
        for batch in batches:
            done = []
            for source, pattern, at, decision, until in zip(*(batch.column(c).to_pylist() for c in ("source", "pattern", "event_no", "decision", "out")), strict=True):
                if n and (key != (source, pattern) or decision == "anomaly" or (out is not None and at > out)):
                    before = decision == "anomaly" and key == (source, pattern) and (out is None or at <= out)
                    done.append((*key, n, at if before else out, first, -1 if before else 1))
                    n = 0
                key = source, pattern
                if decision == "repeat":
                    if not n:
                        out, first = until, at
                    n += 1
            yield table(done, batch.schema)
        if n:
            yield table([(*key, n, out, first, 1)], batch.schema)

    def table(done: list, schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * 6
        kinds = [schema.field("source").type] + [pa.int64()] * 5
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=["source", "pattern", "count", "emit_no", "first", "side"])

    ended = dealt.mapInArrow(fold, f"source {due.schema['source'].dataType.simpleString()}, pattern long, count long, emit_no long, first long, side long")
    seq = F.row_number().over(Window.partitionBy("source", "emit_no", "side").orderBy("first")) * F.col("side")
    shifted = F.when(F.col("side") < 0, seq - (1 << 32)).otherwise(seq)
    placed = ended.select("pattern", "count", "source", "emit_no", shifted.cast("long").alias("seq"))
    return placed.join(names, "pattern").select(*KEY, "count", "source", "emit_no", "seq")


def report(decided: DataFrame, config: Config = Config(), by: tuple[str, ...] = ()) -> DataFrame:
    """One row of counters, or one for each value of the columns ``by``: logical events, raw lines, bytes and lines that were cut, patterns tracked at the end and evicted, warnings, errors and suppression
    percentages. An event that is new and not its pattern's only one follows an eviction."""
    shown = F.col("decision") != "repeat"
    n, rank = F.col("n_lines"), severity.rank(F.col("severity"))
    size = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 1) if "lines" in decided.columns else F.lit(0).cast("long")
    cut = F.coalesce(F.sum("truncated"), F.lit(0)).cast("long") if "truncated" in decided.columns else F.lit(0).cast("long")
    total = decided.groupBy(*by, *KEY).agg(
        F.sum(n).cast("long").alias("raw_lines"), F.sum(size).alias("raw_bytes"), F.count_if(shown).alias("displayed_events"), F.count_if(~shown).alias("suppressed_events"),
        F.sum(F.when(shown, n).otherwise(0)).cast("long").alias("displayed_raw_lines"), F.sum(F.when(shown, 0).otherwise(n)).cast("long").alias("suppressed_raw_lines"),
        F.count_if(F.col("severity") == 5).alias("warning_events"), F.count_if(rank >= 6).alias("error_events"), F.count_if(F.col("decision") == "anomaly").alias("anomaly_events"),
        F.count_if("is_new").alias("generations"), cut.alias("truncated_lines"),
    )
    names = [c for c in total.columns if c not in (*by, *KEY, "generations")]
    tracked = F.least(F.count("*"), F.lit(config.max_patterns).cast("long"))
    one = total.groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names), tracked.alias("structural_patterns"), (F.coalesce(F.sum("generations"), F.lit(0)) - tracked).alias("patterns_evicted"))
    events = F.col("displayed_events") + F.col("suppressed_events")
    return one.withColumns({"logical_event_suppression_percentage": fp.percent(F.col("suppressed_events"), events), "raw_line_suppression_percentage": fp.percent(F.col("suppressed_raw_lines"), F.col("raw_lines"))})


def retention(shown: DataFrame, needles: DataFrame, text: str, needle: str, most: int = 10_000) -> DataFrame:
    """needles with retained: does any row of shown hold it? Null needles and texts hold nothing.

    A needle of three words or more has a word with blanks around it, which must be a whole word of a text that holds it: the longest such
    word is its anchor, and texts meet only the needles whose anchors are among their words. Shorter needles have none and are tried
    on every text. Needles go to the tasks in parts of about ``most``, one pass over the texts for each."""
    listed = needles.select(F.col(needle).alias("needle")).where("needle is not null").distinct()
    words = F.split("needle", r"\s+")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    listed = listed.withColumn("anchor", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    parts, hits = max(1, -(-listed.count() // most)), None
    for k in range(parts):
        own = listed.where(F.pmod(F.xxhash64("needle"), F.lit(parts)) == k)
        anchors = [r["anchor"] for r in own.select("anchor").distinct().collect()]  # about ``most`` of them
        usual = [x for x in anchors if x is not None]
        found = shown.select(F.col(text).alias("text"), F.explode(F.filter(F.array_distinct(F.split(text, r"\s+")), lambda w: w.isin(usual))).alias("word"))  # noqa: B023
        met = found.join(F.broadcast(own.withColumnRenamed("anchor", "word")), "word").where(F.contains(F.col("text"), F.col("needle"))).select("needle")
        if None in anchors:
            short = own.where("anchor is null").select("needle")
            met = met.union(shown.select(F.col(text).alias("text")).join(F.broadcast(short), F.contains(F.col("text"), F.col("needle"))).select("needle"))
        hits = met if hits is None else hits.union(met)
    hits = hits.distinct().select(F.col("needle").alias("of"), F.lit(True).alias("retained"))
    return needles.join(hits, F.col(needle) == F.col("of"), "left").drop("of").withColumn("retained", F.coalesce("retained", F.lit(False)))
