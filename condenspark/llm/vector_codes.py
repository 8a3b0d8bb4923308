"""Operator 13: vectors as short codes (product quantisation), all in whole numbers.

A component x becomes floor(scale * x). A vector is cut into ``parts`` equal parts; each part position has a codebook of ``entries`` parts,
which begins as those of the least ids. A round sends every part to its nearest entry (squared Euclidean distance, ties to the lower index)
and replaces each entry by its parts' componentwise floor of the mean; entries without parts stay.

Vectors are kept as blocks: a row holds some thousand of them, dimension by dimension, as NumPy reads them. An RDD treeAggregate goes over
the blocks: distances accumulate dimension by dimension, np.add.at adds parts to 64-bit tensors of sums and counts, and the tensors,
whose size depends on the codebooks only, merge through a tree of tasks. The driver gets one tensor a round.

Vectors that are null, or hold null, non-finite or huge components (of 131,072 and more, where 64-bit errors could overflow) take no part.
Vectors of fewer components than the longest, or than fill equal parts, count as if zeros followed. Rows of one id take part each for
itself; where they compete for the first codebook the lesser vector goes first, and null ids go last. With fewer rows than entries there
are as many entries as rows. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from condenspark.llm.common import Scratch, bound_batches, give_back

HUGE = 1 << 17
STEP_ROWS = 1024  # distances of so many vectors are worked out at a time


@dataclass(frozen=True)
class Codes:
    """rows: id, label, code (two hex digits a part), error, label_error. books: part x place in the part x entry."""

    rows: DataFrame
    books: np.ndarray

    def sha256(self) -> str:
        """Of all entries' components as decimals, by part, entry and place."""
        return hashlib.sha256(",".join(map(str, self.books.transpose(0, 2, 1).ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> np.ndarray:
        """The whole-number vector that a code stands for."""
        return np.concatenate([self.books[p, :, i] for p, i in enumerate(bytes.fromhex(code))])


def usable(vectors: DataFrame, id: str, vector: str, label: str) -> DataFrame:
    """id, label, x of the rows that take part."""
    rows = vectors.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("x"))
    return rows.where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) >= HUGE)))


def to_blocks(rows: DataFrame, scale: int, block: int) -> DataFrame:
    """ids, labels, width, cells: some vectors a row; cells has the components, four bytes each, those of one dimension together."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                n, lists = part.num_rows, part.column("x")
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
                cells = np.zeros((int(sizes.max(initial=0)), n), "<i4")
                cells[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(np.arange(n), sizes)] = flat
                own = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part.column(c)) for c in ("id", "label")]
                yield pa.RecordBatch.from_arrays([*own, pa.array([len(cells)], pa.int32()), pa.array([cells.tobytes()], pa.binary())], names=["ids", "labels", "width", "cells"])
        give_back()

    fields = [("ids", ArrayType(kinds["id"])), ("labels", ArrayType(kinds["label"])), ("width", IntegerType()), ("cells", BinaryType())]
    return rows.mapInArrow(run, StructType([StructField(*f) for f in fields]))


def unpacked(cells: bytes, width: int, to: int) -> np.ndarray:
    """Dimensions x vectors, with zeros up to the dimension ``to``."""
    x = np.frombuffer(cells, "<i4").reshape(width, -1) if width else np.zeros((0, 0), "<i4")
    return x if width == to else np.concatenate([x, np.zeros((to - width, x.shape[1]), "<i4")])


def nearest(own: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector (column of own) the nearest entry (column of book) and the squared distance to it."""
    index, error = np.empty(own.shape[1], np.int64), np.empty(own.shape[1], np.int64)
    for at in range(0, own.shape[1], STEP_ROWS):
        part = own[:, at : at + STEP_ROWS].astype(np.int64)
        far = np.zeros((part.shape[1], book.shape[1]), np.int64)
        for x, c in zip(part, book, strict=True):
            apart = x[:, None] - c
            far += apart * apart
        index[at : at + STEP_ROWS] = far.argmin(axis=1)
        error[at : at + STEP_ROWS] = far.min(axis=1)
    return index, error


def totals(cells: RDD, books: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums (as books) and counts (part x entry) of the parts that are nearest to each entry. cells: rows of width and cells."""
    parts, step, entries = books.shape

    def add(total: tuple[np.ndarray, np.ndarray], row) -> tuple[np.ndarray, np.ndarray]:
        x = unpacked(bytes(row["cells"]), row["width"], parts * step)
        for p in range(parts):
            own = x[p * step : (p + 1) * step]
            index, _ = nearest(own, books[p])
            for j in range(step):
                np.add.at(total[0][p, j], index, own[j])
            np.add.at(total[1][p], index, 1)
        return total

    def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return a[0] + b[0], a[1] + b[1]

    return cells.treeAggregate((np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)), add, merge, depth)


def encoded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, code, error of every vector."""
    parts, step, _ = books.shape
    kinds = {f.name: f.dataType.elementType for f in blocks.schema.fields if f.name in ("ids", "labels")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = (batch.column(c)[i].values for c in ("ids", "labels"))
                x = unpacked(batch.column("cells")[i].as_py(), batch.column("width")[i].as_py(), parts * step)
                n = len(ids)
                codes, errors = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
                for p in range(parts if x.shape[1] else 0):
                    index, error = nearest(x[p * step : (p + 1) * step], books[p])
                    codes[:, p] = index
                    errors += error
                digits = codes.tobytes().hex()
                code = pa.array([digits[k : k + 2 * parts] for k in range(0, len(digits), 2 * parts)], pa.string())
                yield pa.RecordBatch.from_arrays([ids, labels, code, pa.array(errors)], names=["id", "label", "code", "error"])
        give_back()

    fields = [("id", kinds["ids"]), ("label", kinds["labels"]), ("code", StringType()), ("error", LongType())]
    return blocks.mapInArrow(run, StructType([StructField(*f) for f in fields]))


def with_label_error(codes: DataFrame, salts: int = 16) -> DataFrame:
    """codes with the sum of error over each label, nulls together. A label may have any share of the rows: they meet its sum in ``salts``
    groups."""
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.select(F.col("label").alias("of"), "label_error", F.explode(F.array(*(F.lit(k) for k in range(salts)))).alias("in_salt"))
    salted = codes.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return salted.join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("in_salt"))).select("id", "label", "code", "error", "label_error")


def compress(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, block: int = 2048, depth: int = 2) -> Codes:
    """The codes of all vectors, and the codebooks. entries: up to 256, for two hex digits."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    spark = vectors.sparkSession
    bound_batches(spark)
    scratch, rows = Scratch(spark), usable(vectors, id, vector, label)
    blocks = scratch.keep(to_blocks(rows, scale, block), "vector-blocks")
    width = blocks.agg(F.max("width")).first()[0] or 0
    step = -(-width // parts)
    first = [r["x"] for r in rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()]  # as many as entries
    start = np.zeros((len(first), parts * step), np.int64)
    for i, x in enumerate(first):
        start[i, : len(x)] = np.floor(scale * np.asarray(x, np.float64))
    books = start.reshape(len(first), parts, step).transpose(1, 2, 0).copy()
    if first:
        cells = blocks.select("width", "cells").rdd
        for _ in range(rounds):
            sums, counts = totals(cells, books, depth)
            used = counts[:, None, :]
            books = np.where(used > 0, sums // np.maximum(used, 1), books)  # floor division, also below zero
    codes = scratch.keep(encoded(blocks, books), "vector-codes")
    scratch.drop("vector-blocks")
    return Codes(with_label_error(codes), books)
