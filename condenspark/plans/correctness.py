"""The correctness report: logs with manifests of what must not be lost, condensed, with what is shown and what is retained."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condenspark.operators import patterns
from condenspark.operators.scratch import written
from condenspark.plans.condense import condense
from condenspark.plans.config import Config

REPORTED = ("displayed_events", "suppressed_events", "logical_event_suppression_percentage", "raw_line_suppression_percentage", "structural_patterns", "anomaly_events")


def correctness(lines: DataFrame, manifests: DataFrame, config: Config = Config(), multi_line: bool = True) -> DataFrame:
    """One row for each manifest (scenario, known_important_substrings; lines of the scenario have its name as source): input lines,
    what is shown and suppressed, patterns, and how many of the important substrings are in the shown lines, and which are missed
    (null if none). All scenarios are condensed at once, each with a store of patterns of its own, and their substrings are looked for in
    the shown events of their scenario only. A manifest without lines gets zeros and misses all it names; lines without a manifest are
    left out."""
    none = F.array().cast("array<string>")
    wanted = manifests.select("scenario", F.coalesce("known_important_substrings", none).alias("wanted"))
    own = lines.join(wanted.select(F.col("scenario").alias("source")).distinct(), "source", "left_semi")
    decided = condense(own, config, multi_line=multi_line, by_source=True, hold=True)
    told = patterns.report(decided, config, ("source",))
    shown = written(decided.where("decision <> 'repeat'").select("source", F.array_join("contents", "\n").alias("text")), "shown")
    needles = wanted.select("scenario", F.explode("wanted").alias("needle")).distinct()
    found = needles.join(shown, (F.col("scenario") == F.col("source")) & F.contains(F.col("text"), F.col("needle"))).select("scenario", "needle").distinct()
    kept = found.groupBy("scenario").agg(F.collect_set("needle").alias("kept"))  # at most what the manifest names
    missed = F.filter("wanted", lambda x: ~F.array_contains(F.coalesce("kept", none), x))
    zero = {c: F.coalesce(c, F.lit(0)).cast(told.schema[c].dataType) for c in ("raw_lines", *REPORTED)}
    rows = wanted.join(kept, "scenario", "left").join(told.withColumnRenamed("source", "scenario"), "scenario", "left").withColumns({**zero, "missed": missed})
    return rows.select("scenario", F.col("raw_lines").alias("input_lines"), *REPORTED, F.size("wanted").alias("known_important_total"), (F.size("wanted") - F.size("missed")).alias("known_important_retained"), F.when(F.size("missed") > 0, F.col("missed")).alias("missed"))
