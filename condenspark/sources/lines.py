"""Log lines from text files, streams and tables: source, line_no, raw, truncated."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 256 * 1024
MARKER = " ...[truncated]"


def clean_line(value: Column, max_bytes: int = MAX_BYTES, marker: str = MARKER) -> Column:
    """Without one trailing carriage return; cut at max_bytes, with a marker. A character that the cut halves goes."""
    line = F.regexp_replace(value, "\\r\\z", "")
    head = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(line, "UTF-8"), 1, max_bytes).cast("string")), "\ufffd\\z", "")
    return F.when(F.octet_length(line) > max_bytes, F.concat(head, F.lit(marker))).otherwise(line)


def with_cap(lines: DataFrame, column: str = "raw", max_bytes: int = MAX_BYTES) -> DataFrame:
    too_long = F.octet_length(F.regexp_replace(column, "\\r\\z", "")) > max_bytes
    return lines.withColumns({"truncated": too_long, column: clean_line(F.col(column), max_bytes)})


def read_lines(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Lines of text files. line_no rises in file order, with gaps; a file's blocks follow each other."""
    at = F.col("_metadata.file_block_start") * 65536 + F.monotonically_increasing_id() % (1 << 33)
    text = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("source"), at.alias("line_no"), F.col("value").alias("raw"))
    return with_cap(text, max_bytes=max_bytes)


def stream_lines(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The same for files that arrive in a folder, each whole in one micro-batch; arrival_ts is its time. For streaming.condense_stream()."""
    text = spark.readStream.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("line_no"), F.col("value").alias("raw"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n = None, 0
        for batch in batches:
            out = []
            for own in zip(batch.column("source").to_pylist(), batch.column("line_no").to_pylist(), strict=True):
                block, n = own, n + 1 if own == block else 0
                out.append(own[1] * 65536 + n)
            yield batch.set_column(1, "line_no", pa.array(out, pa.int64()))

    return with_cap(text.mapInArrow(number, text.schema).withColumn("arrival_ts", F.current_timestamp()), max_bytes=max_bytes)


def row_key(table: DataFrame, key: str, name: str = "row_key") -> DataFrame:
    """A table read from files, with a column that tells its rows apart even where the key is null or repeats: the key, the file, and the row's
    place in it."""
    return table.withColumn(name, F.struct(key, "_metadata.file_path", "_metadata.row_index"))


def split_column(table: DataFrame, key: str, text: str, max_bytes: int | None = None) -> DataFrame:
    """Lines of a text column: source (the key), line_no from 0, raw. They are whole unless a cap is given. A key must be a row's own, or lines of
    several rows become one source's: row_key() makes such a key. Rows without text have no lines."""
    lines = table.select(F.col(key).alias("source"), F.posexplode(F.split(text, "\n")).alias("line_no", "raw"))
    return with_cap(lines, max_bytes=max_bytes) if max_bytes else lines.withColumns({"truncated": F.lit(False), "raw": F.regexp_replace("raw", "\r\\z", "")})


def read_manifests(spark: SparkSession, glob: str) -> DataFrame:
    schema = "scenario string, synthetic boolean, total_lines long, known_important_substrings array<string>, description string"
    return spark.read.schema(schema).option("multiLine", True).json(glob).orderBy("scenario")
