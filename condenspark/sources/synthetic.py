"""Synthetic logs for tests and benches, as distributed ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Services, verbs, lines per second of log time, one error in so many lines.
SERVICES, VERBS, PER_SECOND, ERROR_EVERY = ("api", "auth", "billing", "search", "worker"), ("fetched", "stored", "queued", "updated", "removed"), 37, 50_000


def letters(n: Column) -> Column:
    """A number in letters only, base 26."""
    return F.translate(F.conv(n.cast("string"), 10, 26), "0123456789", "QRSTUVWXYZ")


def log(spark: SparkSession, n: int, profile: str = "mixed") -> DataFrame:
    """source, line_no, raw. profile: repetitive (one shape a service), mixed (one line in ten of other shapes), or diverse (each line its own)."""
    i, pick = F.col("id"), lambda xs, k: F.get(F.array(*(F.lit(x) for x in xs)), (k % len(xs)).cast("int"))
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_780_000_000) + F.floor(i / PER_SECOND)), "yyyy-MM-dd HH:mm:ss")
    usual = F.concat(pick(SERVICES, i), F.lit(": "), (40 + i % 5).cast("string"), F.lit(" links of the pool are in use"))
    other = F.format_string("%s: %s parcel %d in %dms for 10.%d.%d.%d", pick(SERVICES, i), pick(VERBS, F.floor(i / 10)), i, i % 997, i % 251, F.floor(i / 7) % 251, F.floor(i / 13) % 251)
    unique = F.concat(other, F.lit(" as "), letters(i))
    body = {"repetitive": usual, "mixed": F.when(i % 10 == 9, other).otherwise(usual), "diverse": unique}[profile]
    error = (i % ERROR_EVERY) == ERROR_EVERY - 1
    raw = F.concat(stamp, F.when(error, F.lit(" [ERROR] ")).otherwise(F.lit(" [INFO] ")), F.when(error, F.lit("the store does not answer")).otherwise(body))
    return spark.range(n).select(F.lit(profile).alias("source"), i.alias("line_no"), raw.alias("raw"))
