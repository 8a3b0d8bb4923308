"""Frequency anomalies by a clock: rolling rate against a slow baseline, with cooldown.

Events are counted per pattern and bucket first; windows and a fold over these counts, whose number is bounded by time and not by events,
give each bucket the ordinal from which its events are too many. Single events are only looked at in buckets that can alert, and only from
that ordinal on; a last fold over these keeps the cooldown. Both folds stream rows that are sorted by pattern, in the memory of one batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condenspark.operators.patterns import KEY
from condenspark.plans.config import Config


def learned(baseline: float, samples: int, n: int, gap: int, c: Config) -> tuple[float, int]:
    """Baseline and samples after a bucket of n events and the empty ones behind it, ``gap`` buckets later; a long gap counts as one window."""
    steps = min(gap, c.buckets)
    rate = n * 60.0 / c.bucket_seconds
    first = c.alpha * rate + (1 - c.alpha) * baseline if samples else rate
    return first * (1 - c.alpha) ** (steps - 1), samples + steps


def least_events(baseline: float, samples: int, protected: bool, c: Config) -> tuple[int, float, bool] | None:
    """The events in a window from which on it is a spike, what they are held against, and whether that is assumed; None: never."""
    known = samples >= c.min_baseline_samples and baseline > 0
    if not known and not protected:
        return None
    base = baseline if known else c.assumed_per_minute
    wanted = base * (c.protect_multiplier if protected else c.spike_multiplier)
    n = math.ceil(wanted * c.window_seconds / 60.0)
    while n * 60.0 / c.window_seconds < wanted:
        n += 1
    while n and (n - 1) * 60.0 / c.window_seconds >= wanted:
        n -= 1
    return max(n, c.min_window_events, 1 if known else c.min_bootstrap_events), base, not known


@dataclass
class History:
    """One pattern's state on a stream: counts of its last buckets, baseline, last alert."""

    counts: dict[str, int] = field(default_factory=dict)
    bucket: int | None = None
    baseline: float = 0.0
    samples: int = 0
    last_alert: float = float("-inf")

    def record(self, at: float, protected: bool, c: Config) -> tuple[bool, float | None, float | None, bool | None]:
        """Is this event an alert? A late one counts in the current bucket."""
        now = int(at // c.bucket_seconds)
        if self.bucket is not None and now > self.bucket:
            self.baseline, self.samples = learned(self.baseline, self.samples, self.counts.get(str(self.bucket), 0), now - self.bucket, c)
            self.counts = {k: n for k, n in self.counts.items() if int(k) > now - c.buckets}
        self.bucket = now if self.bucket is None else max(now, self.bucket)
        self.counts[str(self.bucket)] = self.counts.get(str(self.bucket), 0) + 1
        n, need = sum(self.counts.values()), least_events(self.baseline, self.samples, protected, c)
        if need is None or n < need[0] or at - self.last_alert < c.cooldown:
            return False, None, None, None
        self.last_alert = at
        return True, need[1], n * 60.0 / c.window_seconds, need[2]


def _protected(severity: Column, c: Config) -> Column:
    return F.when(F.coalesce(severity, F.lit(0)) == 0, 3).otherwise(severity.cast("int")) >= c.protect_rank


def alerts(events: DataFrame, config: Config, time: str = "ts", order: tuple[str, ...] = ("event_no",)) -> DataFrame:
    """KEY, order, baseline_per_min, current_per_min, bootstrap of the events that are frequency anomalies. events: severity, template,
    time, order. Events without a time take no part."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    width = config.bucket_seconds * 1_000_000
    plain = events.select(*KEY, *order, us.alias("us"), F.floor(us / width).alias("bucket")).where("us is not null")
    before = Window.partitionBy(*KEY).orderBy("bucket").rangeBetween(1 - config.buckets, -1)
    series = plain.groupBy(*KEY, "bucket").agg(F.count("*").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(before) if config.buckets > 1 else F.lit(0), F.lit(0)).cast("long"))
    series = series.withColumn("protected", _protected(F.col("severity"), config)).repartition(*KEY).sortWithinPartitions(*KEY, "bucket")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, base, samples = None, None, 0.0, 0
        for batch in batches:
            out = {k: [] for k in ("from_nth", "baseline_per_min", "bootstrap")}
            for level, template, bucket, n, earlier, protected in zip(*(batch.column(c).to_pylist() for c in [*KEY, "bucket", "n", "earlier", "protected"]), strict=True):
                if key != (level, template):
                    key, base, samples = (level, template), 0.0, 0
                else:
                    base, samples = learned(base, samples, last[1], bucket - last[0], config)
                last = bucket, n
                need = least_events(base, samples, protected, config)
                fits = need is not None and earlier + n >= need[0]
                for k, v in zip(out, (max(1, need[0] - earlier), need[1], need[2]) if fits else (None,) * 3, strict=True):
                    out[k].append(v)
            done = batch.drop_columns(["n", "protected"])
            for k, kind in zip(out, (pa.int64(), pa.float64(), pa.bool_()), strict=True):
                done = done.append_column(k, pa.array(out[k], kind))
            yield done

    kinds = ", ".join(f"{c} {plain.schema[c].dataType.simpleString()}" for c in KEY)
    hot = series.mapInArrow(judge, f"{kinds}, bucket long, earlier long, from_nth long, baseline_per_min double, bootstrap boolean").where("from_nth is not null")
    hot = hot.select(*(F.col(c).alias(f"of_{c}") for c in KEY), F.col("bucket").alias("in_bucket"), "earlier", "from_nth", "baseline_per_min", "bootstrap")
    same = (F.col("bucket") == F.col("in_bucket")) & F.col("severity").eqNullSafe(F.col("of_severity")) & F.col("template").eqNullSafe(F.col("of_template"))
    nth = F.row_number().over(Window.partitionBy(*KEY, "bucket").orderBy("us", *order))
    found = plain.join(hot, same).withColumn("nth", nth).where("nth >= from_nth")
    found = found.withColumn("current_per_min", (F.col("earlier") + F.col("nth")) * 60.0 / config.window_seconds)
    found = found.select(*KEY, *order, "us", "baseline_per_min", "current_per_min", "bootstrap").repartition(*KEY).sortWithinPartitions(*KEY, "us", *order)
    pause = config.cooldown * 1e6

    def cool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, -math.inf
        for batch in batches:
            keep = []
            for level, template, at in zip(*(batch.column(c).to_pylist() for c in [*KEY, "us"]), strict=True):
                if key != (level, template):
                    key, last = (level, template), -math.inf
                keep.append(at - last >= pause)
                last = at if keep[-1] else last
            yield batch.filter(pa.array(keep, pa.bool_())).drop_columns(["us"])

    return found.mapInArrow(cool, found.drop("us").schema)


def bucket_counts(events: DataFrame, seconds: int, time: str = "ts", keys: tuple[str, ...] = tuple(KEY)) -> DataFrame:
    """keys, bucket (seconds from the epoch), n."""
    bucket = F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / seconds) * seconds
    return events.groupBy(*keys, bucket.cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def rolling(buckets: DataFrame, seconds: int, width: int, keys: tuple[str, ...] = tuple(KEY)) -> DataFrame:
    """bucket counts with window_events (of width buckets up to this one) and rate_per_min."""
    over = Window.partitionBy(*keys).orderBy("bucket").rangeBetween(-(width - 1) * seconds, 0)
    return buckets.withColumn("window_events", F.sum("n").over(over)).withColumn("rate_per_min", F.round(F.col("window_events") * 60.0 / (width * seconds), 6))


def baselines(buckets: DataFrame, seconds: int, width: int, alpha: float = 0.05, keys: tuple[str, ...] = tuple(KEY)) -> DataFrame:
    """keys, baseline_per_min, samples after each pattern's last bucket. A gap adds one zero for each empty bucket, width - 1 at most."""
    series = buckets.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("s"))
    start = F.struct(F.lit(None).cast("double").alias("b"), F.lit(0).cast("long").alias("k"), F.lit(None).cast("long").alias("at"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        steps = F.least(((x["bucket"] - acc["at"]) / seconds).cast("long"), F.lit(width).cast("long"))
        rate = acc["n"] * 60.0 / seconds
        folded = F.when(acc["k"] == 0, rate).otherwise(alpha * rate + (1 - alpha) * acc["b"]) * F.pow(F.lit(1 - alpha), steps - 1)
        opened = acc["at"].isNull()
        return F.struct(F.when(opened, acc["b"]).otherwise(folded).alias("b"), F.when(opened, acc["k"]).otherwise(acc["k"] + steps).alias("k"), x["bucket"].alias("at"), x["n"].alias("n"))

    done = series.withColumn("a", F.aggregate("s", start, step))
    return done.select(*keys, F.round("a.b", 6).alias("baseline_per_min"), F.col("a.k").alias("samples"))
