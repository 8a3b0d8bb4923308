"""Operator 10: cumulative-snapshot collapse, then chat formatting.

A chat service logs a conversation again and again as it grows. Each turn gets a rolling hash of the conversation up to it: sums of
hashes of (place, role, text), so a prefix is known by its length and 124 bits. A conversation whose whole hash is a proper prefix hash of another goes
(anti-join); of equal ones the least conv_id stays. What is left is rendered. Texts are read as digests until then: whole texts move only
for conversations that stay.

Turns are numbered by (turn, role, digest of the text), nulls first; role and text may be null and then count as
empty. Repeated rows are turns of their own. A conversation of any length is numbered in buckets of ``bucket``
turn numbers and rendered in parts of ``part_turns`` turns, so no task gathers more. A null conv_id is a conversation of its own; a null
turn comes first. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from condenspark.llm.common import materialise

LANES = ["s1", "s2", "s3", "s4"]


ORDER = ["turn", "role", "digest"]


def numbered(turns: DataFrame, bucket: int, *more: str) -> DataFrame:
    """conv_id, bucket, role, digest, place (from 1), n (turns of the conversation), and more columns."""
    t = turns.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), F.floor(F.col("turn") / bucket).alias("bucket"), *more)
    offsets = t.groupBy("conv_id", "bucket").agg(F.count("*").alias("k"))
    over = Window.partitionBy("conv_id").orderBy("bucket")
    offsets = offsets.select(F.col("conv_id").alias("o_conv"), F.col("bucket").alias("o_bucket"), (F.sum("k").over(over) - F.col("k")).alias("before"), F.sum("k").over(Window.partitionBy("conv_id")).alias("n_turns"))
    same = t["conv_id"].eqNullSafe(offsets["o_conv"]) & t["bucket"].eqNullSafe(offsets["o_bucket"])
    inner = F.row_number().over(Window.partitionBy("conv_id", "bucket").orderBy(*ORDER))
    return t.withColumn("row", inner).join(offsets, same).select("conv_id", "bucket", "role", "digest", (F.col("before") + F.col("row")).alias("place"), "n_turns", *more)


def prefix_hashes(turns: DataFrame, bucket: int = 512) -> DataFrame:
    """conv_id, place, n_turns, s1..s4 (the rolling hash up to the turn)."""
    placed = numbered(turns, bucket)
    said = [F.col("place"), F.coalesce("role", F.lit("")), F.coalesce("digest", F.md5(F.lit("").cast("binary")))]
    h1, h2 = F.xxhash64(*said), F.xxhash64(F.lit("second"), *said)
    low, high = lambda h: h.bitwiseAND(0x7FFFFFFF), lambda h: F.shiftrightunsigned(h, 33)
    lanes = placed.select("conv_id", "bucket", "place", "n_turns", *(f.alias(c) for c, f in zip(LANES, (low(h1), high(h1), low(h2), high(h2)), strict=True)))
    sums = lanes.groupBy("conv_id", "bucket").agg(*(F.sum(c).alias(c) for c in LANES))
    over = Window.partitionBy("conv_id").orderBy("bucket")
    upto = sums.select(F.col("conv_id").alias("o_conv"), F.col("bucket").alias("o_bucket"), *((F.sum(c).over(over) - F.col(c)).alias(f"b_{c}") for c in LANES))
    running = Window.partitionBy("conv_id", "bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rolled = lanes.select("conv_id", "bucket", "place", "n_turns", *(F.sum(c).over(running).alias(c) for c in LANES))
    same = rolled["conv_id"].eqNullSafe(upto["o_conv"]) & rolled["bucket"].eqNullSafe(upto["o_bucket"])
    return rolled.join(upto, same).select("conv_id", "place", "n_turns", *((F.col(c) + F.col(f"b_{c}")).alias(c) for c in LANES))


def maximal(hashed: DataFrame) -> DataFrame:
    """conv_id, n_copies of the conversations that prefix no longer one: one of each set of equal ones."""
    whole = hashed.where("place = n_turns").groupBy("n_turns", *LANES).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = hashed.where("place < n_turns").select(F.col("place").alias("n_turns"), *LANES).distinct()
    return whole.join(proper, ["n_turns", *LANES], "left_anti").select("conv_id", "n_copies")


def format_chats(turns: DataFrame, bucket: int = 512, part_turns: int = 256, begin: str = "<|", middle: str = "|>\n", end: str = "<|end|>\n") -> DataFrame:
    """conv_id, part, n_turns, n_copies, text: the maximal conversations, rendered. Parts joined in order are the whole conversation."""
    hashed = materialise(prefix_hashes(turns, bucket), "turns")
    kept = maximal(hashed).withColumnRenamed("conv_id", "kept_id")
    own = turns.select("conv_id", "turn", "role", "text")
    own = own.join(kept, own["conv_id"].eqNullSafe(kept["kept_id"])).drop("kept_id")
    line = F.concat(F.lit(begin), F.coalesce("role", F.lit("")), F.lit(middle), F.coalesce("text", F.lit("")), F.lit("\n" + end))
    placed = numbered(own, bucket, "text", "n_copies")
    placed = placed.select("conv_id", F.expr(f"(place - 1) div {part_turns}").cast("int").alias("part"), "place", "n_turns", "n_copies", line.alias("line"))
    parts = placed.groupBy("conv_id", "part", "n_turns", "n_copies").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    return parts.select("conv_id", "part", "n_turns", "n_copies", F.array_join("lines.line", "").alias("text"))
