"""64-bit FNV-1a fingerprint of (level, template), as 16 hexadecimal digits; and number formats of reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fingerprint(level: Column, template: Column) -> Column:
    """FNV-1a over the level's byte, a zero byte and the UTF-8 template, in two 32-bit halves, as longs don't wrap. Use it on distinct
    templates."""
    digits = F.concat(F.lpad(F.hex(level.cast("long")), 2, "0"), F.lit("00"), F.hex(F.encode(template, "UTF-8")))
    places = F.sequence(F.lit(0), (F.length(digits) / 2 - 1).cast("int"))
    octets = F.transform(F.array(digits), lambda d: F.transform(places, lambda i: F.conv(F.substring(d, 2 * i + 1, F.lit(2)), 16, 10).cast("long")))[0]
    start = F.struct(F.lit(3421674724).cast("long").alias("hi"), F.lit(2216829733).cast("long").alias("lo"))

    def step(acc: Column, octet: Column) -> Column:
        x = acc["lo"].bitwiseXOR(octet)
        low = x * 435
        high = acc["hi"] * 435 + F.shiftright(low, 32) + F.shiftleft(x, 8)
        mask = F.lit(0xFFFFFFFF).cast("long")
        return F.struct(high.bitwiseAND(mask).alias("hi"), low.bitwiseAND(mask).alias("lo"))

    half = lambda c: F.lower(F.lpad(F.hex(c), 8, "0"))
    return F.aggregate(octets, start, step, lambda acc: F.concat(half(acc["hi"]), half(acc["lo"])))


def rate_text(rate: Column) -> Column:
    return F.when(rate < 10, F.format_string("%.1f", rate)).otherwise(F.format_string("%.0f", rate))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, 2)).otherwise(F.lit(0.0))
