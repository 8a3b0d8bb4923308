"""The whole plan: lines -> events -> templates -> decisions.

The lines are read twice, whatever the options (once if single-line events are held): events of several lines are assembled and written, and decided from there; events of one line
are read once for the keys by which they are decided and once to meet the decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condenspark.functions import severity
from condenspark.operators import multiline, patterns, sinks
from condenspark.operators.scratch import numbered, written
from condenspark.plans.config import Config


def condense(lines: DataFrame, config: Config = Config(), multi_line: bool = True, clock: str = "constant", time: str = "ts", by_source: bool = False, hold: bool = False) -> DataFrame:
    """by_source: patterns are counted for each source by itself, as if it had a run of its own. lines: source, line_no, raw; and a time for clock="event". Decided events. clock: "constant" takes all lines as of one time, as
    when a file is read at once; "event" goes by the lines' own times (an event's is that of the line that closes it, as closed() says). hold: events of one line are written with their
    templates, as those of several are, and lines are read once: for results that look at the events more than once."""
    if clock not in ("constant", "event"):
        raise ValueError(f"clock must be constant or event, not {clock!r}")
    parsed = patterns.parse(lines)
    timed = [time] if clock == "event" else []
    if multi_line:
        events = written(patterns.with_block_templates(multiline.events(parsed, keep=tuple(timed), last=tuple(timed))), "events")
        events = closed(events, time) if timed else events
    else:
        cut = F.coalesce(F.col("truncated"), F.lit(False)).cast("int") if "truncated" in lines.columns else F.lit(0)
        one = patterns.with_templates(parsed.select("source", F.col("line_no").alias("event_no"), "severity", "raw", "content", cut.alias("truncated"), *timed))
        if hold:  # without the content, which is soon found again
            one = written(one.drop("content"), "events")
            one = one.withColumn("content", severity.content(F.col("raw")))
        events = one.select("source", "event_no", "severity", F.array("raw").alias("lines"), F.array("content").alias("contents"), F.lit(1).alias("n_lines"), "truncated", *timed, "template")
    return patterns.decide_by_clock(events, config, time, by_source=by_source) if timed else patterns.decide(events, config, by_source=by_source)


def closed(events: DataFrame, time: str, cap: int = multiline.MAX_LINES) -> DataFrame:
    """events (with time of the first line and last_<time>) with the time at which each was known to be whole: that of the source's next event, of
    its own last line if it is full, or if there is no next one. The next event is found by its place in the order of all."""
    order = ("source", "event_no")
    places = numbered(events.select(*order, time), order, "place")
    after = places.select(F.col("source").alias("s"), (F.col("place") - 1).alias("p"), F.col(time).alias("next_time"))
    told = places.join(after, (F.col("place") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("of"), F.col("event_no").alias("no"), "next_time")
    own = events.join(told, F.col("source").eqNullSafe(F.col("of")) & (F.col("event_no") == F.col("no")), "left")
    at = F.when(F.col("n_lines") >= cap, F.col(f"last_{time}")).otherwise(F.coalesce("next_time", f"last_{time}"))
    return own.withColumn(time, at).drop("of", "no", "next_time", f"last_{time}")


def output(lines: DataFrame, config: Config = Config(), clock: str = "constant", time: str = "ts") -> DataFrame:
    """The records; by the events' clock repeats are summed up as often as a stream would."""
    decided = condense(lines, config, clock=clock, time=time)
    return sinks.records(decided, config, patterns.timed_summaries(decided, time) if clock == "event" else None)
