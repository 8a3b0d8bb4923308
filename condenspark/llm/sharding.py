"""Operator 1: proportional stratified interleaving.

Rows are ranked within their source in a seeded random order, given the fractional rank (rank - 1/2) / rows of the source,
sorted by it, and cut into equal runs. Each run holds every source in its share of the whole. Law: ``rows``.

A source may hold a third of all rows, so neither ranking runs in one task: rows go to the buckets of a fixed grid, a small
table of bucket counts gives each bucket its offset, and row_number() only numbers the rows inside a bucket. The grid grows with the
number of rows. The random order comes from doc_id, size and CRC, so rows of one doc_id (or of none) spread over it too.

Null text has size 1 and the CRC of no bytes. A null source is a source of its own. Rows that agree in doc_id, size and CRC are
interchangeable; a null doc_id is kept. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _offsets(rows: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Rows before each bucket, and in all, within the keys. The table is bounded by keys times the grid."""
    w = Window.partitionBy(*keys).orderBy(bucket) if keys else Window.orderBy(bucket)
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy()
    n = rows.groupBy(*keys, bucket).agg(F.count("*").alias("n"))
    return n.select(*keys, bucket, (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("total"))


def interleave(docs: DataFrame, n_shards: int = 8, seed: int = 17, grid_hex: int | None = None, text: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32, source, position, shard, slot for every row. grid_hex: the bucket grid has 16 ** grid_hex cells; as a
    rule so many that a cell of an even source has at most about 65,536 rows, and 4,096 at least."""
    grid_hex = grid_hex or max(3, -(-max(0, docs.count().bit_length() - 16) // 4))
    cells = 16**grid_hex
    text = F.coalesce(F.col("text") if text is None else text, F.lit(""))
    rows = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("stratum"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    names = (F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), F.col("text_crc32").cast("string"))
    rows = rows.withColumn("shuffle", F.md5(F.concat_ws(":", *names).cast("binary"))).withColumn("cell", F.substring("shuffle", 1, grid_hex))
    ties = ["doc_id", "size", "text_crc32"]
    inner = F.row_number().over(Window.partitionBy("stratum", "cell").orderBy("shuffle", *ties))
    ranked = rows.join(_offsets(rows, ["stratum"], "cell"), ["stratum", "cell"]).select(
        "stratum", *ties, ((F.col("before") + inner - 0.5) / F.col("total")).alias("fraction")
    )
    ranked = ranked.withColumn("cell", F.floor(F.col("fraction") * cells))
    inner = F.row_number().over(Window.partitionBy("cell").orderBy("fraction", "stratum", *ties))
    placed = ranked.join(_offsets(ranked, [], "cell"), "cell").select("stratum", *ties, "total", (F.col("before") + inner - 1).alias("position"))
    placed = placed.withColumn("shard", F.expr(f"position * {n_shards} div total").cast("int"))
    return placed.select(
        "doc_id", "size", "text_crc32", "stratum", "position", "shard",
        F.expr(f"position - (shard * total + {n_shards - 1}) div {n_shards}").cast("long").alias("slot"),
    )
