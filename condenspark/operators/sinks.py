"""Output records: newline-delimited JSON, text, and the impact report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condenspark.functions import fingerprint as fp
from condenspark.functions import severity
from condenspark.operators.patterns import KEY, repeat_summaries, with_fingerprints
from condenspark.plans.config import Config

#: ANSI colours by level.
COLOURS = {1: "\x1b[2m", 2: "\x1b[2m", 5: "\x1b[33m", 6: "\x1b[31m", 7: "\x1b[1m\x1b[31m", 8: "\x1b[1m\x1b[31m"}


def records(decided: DataFrame, config: Config, summaries: DataFrame | None = None) -> DataFrame:
    """One row for each output record; empty fields are null and so left out of the JSON. decided: as from decide(), with contents, and
    with baseline_per_min, current_per_min and bootstrap where a clock gave them. summaries: as from timed_summaries(); else one for each
    pattern at the end. Records in order: by source, emit_no (the event's number; that of a summary is the event after which it is due,
    null at the end), and seq (summaries that are due together go by their first repeat)."""
    ids = with_fingerprints(decided.select(*KEY).distinct())
    shown = decided.where("decision <> 'repeat'").join(ids, KEY)
    new, spike = F.col("decision") == "event", F.col("decision") == "anomaly"
    clocked = "current_per_min" in decided.columns
    base = F.col("baseline_per_min") if clocked else F.lit(config.assumed_per_minute)
    current = F.col("current_per_min") if clocked else F.lit(config.min_bootstrap_events * 60.0 / config.window_seconds)
    assumed = F.when(F.col("bootstrap"), F.lit(True)) if clocked else F.lit(True)
    order = [F.col("source"), F.col("event_no").cast("long").alias("emit_no"), F.lit(0).cast("long").alias("seq")]
    one = shown.select(
        F.col("decision").alias("type"), "fingerprint", severity.level_name(F.col("severity")).alias("severity"), F.nullif("template", F.lit("")).alias("template"), F.col("contents").alias("lines"), F.when(new, 1).cast("long").alias("count"),
        F.when(new, F.lit(True)).alias("new"), F.when(spike, base).alias("baseline_per_min"), F.when(spike, current).alias("current_per_min"), F.when(spike, assumed).alias("bootstrap"), *order,
    )
    none = lambda kind: F.lit(None).cast(kind)
    due = repeat_summaries(decided) if summaries is None else summaries
    many = due.join(ids, KEY).select(
        F.lit("repeat_summary").alias("type"), "fingerprint", severity.level_name(F.col("severity")).alias("severity"), F.nullif("template", F.lit("")).alias("template"), none("array<string>").alias("lines"), "count",
        none("boolean").alias("new"), none("double").alias("baseline_per_min"), none("double").alias("current_per_min"), none("boolean").alias("bootstrap"), "source", "emit_no", "seq",
    )
    return one.union(many)


def in_order(rows: DataFrame) -> DataFrame:
    """The records as a stream would show them."""
    return rows.orderBy(F.col("source").asc_nulls_last(), F.col("emit_no").asc_nulls_last(), "seq")


def to_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*(c for c in rows.columns if c not in ("source", "emit_no", "seq")))).alias("value"))


def to_text(rows: DataFrame, colour: bool = False) -> DataFrame:
    """The records as text blocks, each with an empty line behind it."""
    level = F.array_position(F.array(*(F.lit(x) for x in severity.LEVELS)), F.col("severity")).cast("int") - 1
    paint = F.coalesce(*(F.when(level == k, F.lit(v)) for k, v in COLOURS.items()), F.lit("")) if colour else F.lit("")
    off = F.when(paint != "", F.lit("\x1b[0m")).otherwise(F.lit("")) if colour else F.lit("")
    head = F.when(level == 0, F.lit("")).otherwise(F.concat(severity.icon(level), F.lit(" "), F.col("severity"), F.lit(" ")))
    rest = F.transform(F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1))), lambda x: F.concat(F.lit("\n  "), x))
    event = F.concat(paint, head, F.col("lines")[0], F.array_join(rest, ""), off, F.lit("\n"))
    summary = F.concat(paint, head, F.coalesce("template", F.lit("")), off, F.lit("\n"), paint, F.lit("  × "), F.col("count").cast("string"), off, F.lit("\n"))
    red, reset = (COLOURS[7], "\x1b[0m") if colour else ("", "")
    line = lambda *x: F.concat(F.lit(red), F.lit("   "), *x, F.lit(f"{reset}\n"))
    rates = fp.rate_text(F.col("baseline_per_min")), fp.rate_text(F.col("current_per_min"))
    told = F.when(F.col("bootstrap"), line(F.lit("no prior history - already occurring at "), rates[1], F.lit("/min")))
    told = told.otherwise(F.concat(line(F.lit("baseline: "), rates[0], F.lit("/min")), line(F.lit("current:  "), rates[1], F.lit("/min"))))
    title = F.concat(F.lit(f"{red}{severity.ICONS[-1]} FREQUENCY SPIKE"), F.when(F.col("bootstrap"), F.lit(" (new pattern)")).otherwise(F.lit("")), F.lit(f"{reset}\n"))
    anomaly = F.concat(title, line(F.coalesce(F.col("lines")[0], F.col("template"))), told)
    return rows.select(F.when(F.col("type") == "event", event).when(F.col("type") == "anomaly", anomaly).otherwise(summary).alias("value"))


def stats(report: DataFrame, seconds: float) -> DataFrame:
    """The report as named rows, in order: n, name, value."""
    per_second = lambda c, by=1.0: F.format_number(F.col(c) / by / max(seconds, 1e-9), 2)
    whole = lambda c: F.col(c).cast("string")
    rows = [
        ("input lines", whole("raw_lines")), ("displayed events", whole("displayed_events")), ("suppressed events", whole("suppressed_events")),
        ("logical-event suppression", F.concat(F.format_number("logical_event_suppression_percentage", 1), F.lit("%"))), ("raw-line suppression", F.concat(F.format_number("raw_line_suppression_percentage", 1), F.lit("%"))),
        ("structural patterns", F.concat(whole("structural_patterns"), F.lit(" (evicted "), whole("patterns_evicted"), F.lit(")"))), ("warning events observed", whole("warning_events")), ("error events observed", whole("error_events")),
        ("anomalies detected", whole("anomaly_events")), ("truncated lines", whole("truncated_lines")), ("elapsed", F.lit(f"{seconds:.2f}s")), ("rate", F.concat(per_second("raw_lines"), F.lit(" lines/sec, "), per_second("raw_bytes", 1e6), F.lit(" MB/sec"))),
    ]
    return report.select(F.inline(F.array(*(F.struct(F.lit(k).alias("n"), F.lit(name).alias("name"), value.alias("value")) for k, (name, value) in enumerate(rows)))))


def impact(report: DataFrame, seconds: float, version: str = "1") -> DataFrame:
    """The impact report as one JSON object: aggregates only."""
    rate = F.round(F.col("raw_lines") / max(seconds, 1e-9), 2)
    full = report.select(F.lit(2).alias("schema_version"), F.lit(version).alias("engine_version"), F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated_at"), F.lit(seconds).alias("session_duration_seconds"), "*", rate.alias("processing_rate_lines_per_second"))
    return to_json(full)
