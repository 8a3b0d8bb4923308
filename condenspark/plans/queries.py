"""Registered queries of the log operators, on log lines derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condenspark.functions import fingerprint as fp
from condenspark.functions import normalize, severity
from condenspark.operators import anomaly, lru, multiline, patterns, sinks
from condenspark.operators.scratch import place
from condenspark.plans import shapes
from condenspark.plans.condense import condense
from condenspark.plans.config import Config
from condenspark.plans.correctness import correctness
from condenspark.sources import bounded
from condenspark.sources.lines import split_column

#: The level that each event type is logged with.
LEVEL_OF = {"error": "ERROR", "signup": "NOTICE", "purchase": "WARN", "click": "INFO", "view": "DEBUG"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that go to one task.
PER_TASK = {"events": 250_000, "documents": 10_000}


def _spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its rows dealt evenly over tasks (column dealt: a number of the row in its file), whose number grows with the rows and is
    that of the cores at least. A scan's own tasks are cut by bytes, but a row group goes to one of them whole, and a file may be one group."""
    rows = _table(spark, sf_dir, name)
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows.count() // PER_TASK[name]))  # counted from the files' footers
    return rows.select("*", F.col("_metadata.file_path").alias("dealt_file"), F.col("_metadata.row_index").alias("dealt")).repartition(tasks, "dealt")


def _once(rows: DataFrame, column: str) -> DataFrame:
    """rows with a column that is worked out once, however often it is used and whatever is filtered by it: optimizers put a projected
    expression in the place of each use, and move filters by it below an exchange, into the few tasks of a scan; what is generated stays."""
    return rows.select(*(c for c in rows.columns if c != column), F.explode(F.array(column)).alias(column))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a log: source, line_no, ts, event_type, user_id, raw."""
    level = F.element_at(F.create_map(*(F.lit(x) for kv in LEVEL_OF.items() for x in kv)), F.col("event_type"))
    cents = F.round(F.abs(F.col("value")) * 100).cast("long")
    value = F.concat(F.when(F.col("value") < 0, "-").otherwise(""), (F.floor(cents / 100)).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    raw = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), level, F.lit("] user "), F.col("user_id").cast("string"), F.lit(" "), F.col("event_type"), F.lit(" value="), value, F.lit(" props="), F.col("props"))
    return _spread(spark, sf_dir, "events").select(F.lit("events").alias("source"), F.col("event_id").alias("line_no"), "ts", "event_type", "user_id", raw.alias("raw"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as logs, one source a row."""
    keyed = _spread(spark, sf_dir, "documents").select(F.struct("doc_id", F.col("dealt_file").alias("file_path"), F.col("dealt").alias("row_index")).alias("row_key"), "text")
    return split_column(keyed, "row_key", "text")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = patterns.parse(event_lines(spark, sf_dir)).withColumnRenamed("line_no", "event_no")
    return patterns.with_templates(parsed)


def level_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each event, with every alias of a level in brackets, bare, after level=, behind a host, and in a path."""
    return _spread(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), F.expr(f"{shapes.PREFIX} || {shapes.MESSAGE}").alias("raw"))


def severity_detect(spark, sf_dir):
    lines = level_lines(spark, sf_dir)
    code = severity.severity(F.col("raw"))
    return lines.select("line_no", code.cast("int").alias("severity"), severity.level_name(code).alias("level"), severity.rank(code).alias("rank"), severity.icon(code).alias("icon"), severity.consumed(F.col("raw")).alias("consumed"))


def prefix_strip(spark, sf_dir):
    lines = level_lines(spark, sf_dir)
    return lines.select("line_no", severity.content(F.col("raw")).alias("content"), severity.strip_time(F.col("raw")).alias("without_time"))


def _norm(name: str):
    def query(spark, sf_dir):
        lines = _once(_spread(spark, sf_dir, "events").select("event_id", F.expr(shapes.SHAPED).alias("raw")), "raw")
        found = _once(lines.withColumn("line", normalize.replace_class(F.col("raw"), name)), "line")
        return found.where(F.col("raw") != F.col("line")).select("event_id", "line")

    return query


def norm_documents(spark, sf_dir):
    """Every class in the lines of documents: how many lines have it."""
    lines = document_lines(spark, sf_dir).where(normalize.has_any(F.col("raw")))  # few have any
    found = lines.agg(*(F.count_if(normalize.has_class(F.col("raw"), name)).alias(name) for name, _, _ in normalize.CLASSES))
    listed = F.array(*(F.struct(F.lit(name).alias("class"), F.col(name).alias("lines")) for name, _, _ in normalize.CLASSES))
    return found.select(F.inline(listed)).where("lines > 0")


def template_full(spark, sf_dir):
    return _events(spark, sf_dir).select("event_no", "template")


def template_documents(spark, sf_dir):
    lines = document_lines(spark, sf_dir)
    return patterns.with_templates(lines, "raw").groupBy("template").agg(F.count("*").alias("n"))


def fingerprints(spark, sf_dir):
    return patterns.with_fingerprints(_events(spark, sf_dir).select("severity", "template").distinct()).select(F.col("severity").cast("int").alias("severity"), "template", "fingerprint")


def pattern_counts(spark, sf_dir):
    found = patterns.counts(_events(spark, sf_dir), time="ts")
    return found.select(F.col("severity").cast("int").alias("severity"), "template", "total_count", "first_no", "last_no", "first_seen", "last_seen")


def pattern_example(spark, sf_dir):
    found = patterns.counts(_events(spark, sf_dir).withColumn("lines", F.col("content")))
    return found.select(F.col("severity").cast("int").alias("severity"), "template", "example")


def _decided(spark, sf_dir, hold=True):
    return condense(event_lines(spark, sf_dir), multi_line=False, hold=hold)


def novelty(spark, sf_dir):
    return _decided(spark, sf_dir, hold=False).select("event_no", "is_new").where("is_new")


def decisions_constant_clock(spark, sf_dir):
    return _decided(spark, sf_dir, hold=False).select("event_no", "decision")


def repeat_summaries(spark, sf_dir):
    return patterns.repeat_summaries(_decided(spark, sf_dir)).select(F.col("severity").cast("int").alias("severity"), "template", "count")


def suppression_report(spark, sf_dir):
    return patterns.report(_decided(spark, sf_dir))


def ndjson_records(spark, sf_dir):
    return sinks.to_json(sinks.records(_decided(spark, sf_dir), Config()))


def text_output(spark, sf_dir):
    return sinks.to_text(sinks.records(_decided(spark, sf_dir), Config()))


def _clocked(spark, sf_dir, hold=True):
    config = Config(bucket_seconds=3600, window=3 * 3600, cooldown=12 * 3600, spike_multiplier=1.5, protect_multiplier=1.2)
    return condense(event_lines(spark, sf_dir), config, multi_line=False, clock="event", hold=hold), config


def decisions_event_clock(spark, sf_dir):
    return _clocked(spark, sf_dir, hold=False)[0].select("event_no", "decision", F.round("baseline_per_min", 6).alias("baseline_per_min"), F.round("current_per_min", 6).alias("current_per_min"))


def timed_repeat_summaries(spark, sf_dir):
    return patterns.timed_summaries(_clocked(spark, sf_dir)[0]).select(F.col("severity").cast("int").alias("severity"), "template", "count", "emit_no")


def text_output_event_clock(spark, sf_dir):
    decided, config = _clocked(spark, sf_dir)
    return sinks.to_text(sinks.records(decided, config, patterns.timed_summaries(decided)))


def stats(spark, sf_dir):
    found = sinks.stats(patterns.report(_decided(spark, sf_dir)), 1.0)
    return found.where("name not in ('elapsed', 'rate')")


def bucket_counts(spark, sf_dir):
    return anomaly.bucket_counts(_table(spark, sf_dir, "events"), 3600, keys=("event_type",))


def rolling_rate(spark, sf_dir):
    return anomaly.rolling(bucket_counts(spark, sf_dir), 3600, 3, keys=("event_type",))


def ewma_baseline(spark, sf_dir):
    return anomaly.baselines(bucket_counts(spark, sf_dir), 3600, 3, keys=("event_type",))


def spikes(spark, sf_dir):
    config = Config(bucket_seconds=3600, window=3 * 3600, cooldown=12 * 3600, spike_multiplier=1.5, protect_multiplier=1.2)
    found = anomaly.alerts(_events(spark, sf_dir), config)
    return found.select("event_no", "template", F.round("baseline_per_min", 6).alias("baseline_per_min"), F.round("current_per_min", 6).alias("current_per_min"), "bootstrap")


def correctness_report(spark, sf_dir):
    """The events as five logs, a manifest each: its first user, its last one, and one that never was."""
    lines = event_lines(spark, sf_dir).withColumn("source", F.col("event_type"))
    user = lambda pick: F.concat(F.lit("user "), pick("user_id", "line_no").cast("string"), F.lit(" "))
    manifests = lines.groupBy(F.col("source").alias("scenario")).agg(F.array(user(F.min_by), user(F.max_by), F.lit("user nobody")).alias("known_important_substrings"))
    found = correctness(lines, manifests, multi_line=False)
    return found.withColumn("missed", F.array_join("missed", ","))


def bounded_lines(spark, sf_dir):
    """The documents as text files, read with a small cap, in small ranges."""
    path = place(spark, "text")
    _spread(spark, sf_dir, "documents").where("text is not null").select("text").write.text(path)
    found = bounded.bounded_lines(spark, path, max_bytes=48, range_bytes=1 << 20)
    return found.groupBy("raw", "truncated").agg(F.count("*").alias("n"))


def multiline_blocks(spark, sf_dir):
    found = multiline.events(patterns.parse(document_lines(spark, sf_dir)))
    return found.select(F.col("source.doc_id").alias("doc_id"), "event_no", "n_lines")


def multiline_condense(spark, sf_dir):
    return patterns.report(condense(document_lines(spark, sf_dir)))


def conversation_novelty(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source"), F.col("turn").alias("event_no"), F.col("role").alias("severity"), F.col("text").alias("template"))
    return patterns.counts(turns).groupBy("severity").agg(F.count("*").alias("patterns"), F.sum("total_count").alias("turns"))


def lru_novelty(spark, sf_dir):
    found = lru.novelty(_table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id", 50, 4096)
    return found.groupBy("user_id").agg(F.count("*").alias("accesses"), F.count_if("novel").alias("generations"))


def retention(spark, sf_dir):
    needles = _table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("needle"))
    docs = _table(spark, sf_dir, "documents").select(F.lower("text").alias("text"))
    kept = patterns.retention(docs, needles.select("needle").distinct(), "text", "needle")
    kept = kept.withColumnRenamed("needle", "of")
    return needles.join(kept, F.col("needle").eqNullSafe(F.col("of"))).select("item_id", "retained")


def order_patterns(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("event_no"), F.col("o_orderpriority").alias("severity"), F.col("o_orderstatus").alias("template"))
    return patterns.counts(rows)


def lineitem_patterns(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem")
    return items.groupBy(F.col("l_returnflag").alias("severity"), F.col("l_linestatus").alias("template")).agg(F.count("*").alias("total_count"), F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"))


def dominant_shapes(spark, sf_dir):
    """Flagship: which message shapes dominate the log, and which are errors."""
    found = patterns.counts(_events(spark, sf_dir).withColumn("lines", F.col("content")))
    return found.select(severity.level_name(F.col("severity")).alias("level"), "template", "total_count", "example")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        dominant_shapes, severity_detect, prefix_strip, norm_documents, template_full, template_documents, fingerprints, pattern_counts, pattern_example, novelty, decisions_constant_clock,
        repeat_summaries, suppression_report, ndjson_records, text_output, decisions_event_clock, timed_repeat_summaries, text_output_event_clock, stats, bucket_counts, rolling_rate, ewma_baseline, spikes, correctness_report, bounded_lines, multiline_blocks, multiline_condense, conversation_novelty,
        lru_novelty, retention, order_patterns, lineitem_patterns,
    )
} | {f"norm_{name}": _norm(name) for name, _, _ in normalize.CLASSES}
