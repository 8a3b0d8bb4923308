"""Operator 8: exact top-k search by block-at-a-time pruning.

Vectors become integers, ``floor(scale * x)``; each dimension is a term and the score is the inner product. Rows are ordered by their
strongest term and cut into document-range blocks, each with a forward index (its integer matrix, in the least width that holds it) and,
for every term, the largest and smallest value. A query's bound on a block sums its terms' best values. Queries visit a range's blocks in
the order of their bounds and stop when the bound falls below the k-th score.

A query first searches the range it lies in; its k-th score there is a floor. The bounds of whole ranges, a small table, are held against
the floors before any vector moves, and a query goes only to ranges whose bound reaches its floor. Queries go in chunks: a task joins one
chunk with one range, so neither is ever whole in a task, and only k rows a query leave it.

Vectors that are null or hold null, non-finite or huge components (HUGE and more, whose scores could overflow) take no part, nor do rows with
a null id. Vectors of unlike length are
filled up with zeros. Every row counts: repeated rows are candidates each, and each row whose id is divisible by ``every`` is a query of
its own, for which all other rows are candidates, also those of its own id. Ties go to the smaller id. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condenspark.llm.common import Scratch

NONE = -(2**62)
HUGE = 1 << 19  # components from here on take no part: scores of up to 512 of them fit in 64 bits


def usable(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < HUGE))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, through doubles while they are exact."""
    if not a.size or not b.size or float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**52:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def merge(best_s: np.ndarray, best_i: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of what each query has and what a block gives."""
    s, i = np.concatenate([best_s, scores], axis=1), np.concatenate([best_i, np.broadcast_to(ids, scores.shape)], axis=1)
    if s.shape[1] > 8 * k:  # rows at or above the k-th score stay
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, -k]
        width = int((s >= kth[:, None]).sum(axis=1).max())
        keep = np.argsort(-s, axis=1, kind="stable")[:, :width] if width < s.shape[1] else None
        if keep is not None:
            s, i = np.take_along_axis(s, keep, 1), np.take_along_axis(i, keep, 1)
    order = np.lexsort((i, -s), axis=1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def search(home: np.ndarray, row: np.ndarray, q: np.ndarray, floor: np.ndarray, blocks: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], k: int):
    """blocks: number, ids, matrix, top, low. Scores and ids of each query's k best; floor: scores that the k-th is known to reach; home
    and row: the block and the row in it that is the query itself."""
    best_s, best_i = np.full((len(q), k), NONE), np.full((len(q), k), np.iinfo(np.int64).max)
    if not blocks:
        return best_s, best_i
    top, low = np.stack([b[3] for b in blocks]), np.stack([b[4] for b in blocks])
    bound = _product(np.maximum(q, 0), top) + _product(np.minimum(q, 0), low)
    order = np.argsort(-bound, axis=1, kind="stable")
    for turn in range(len(blocks)):
        at = order[:, turn]
        open_ = np.take_along_axis(bound, at[:, None], 1)[:, 0] >= np.maximum(best_s[:, -1], floor)
        if not open_.any():
            break  # later blocks have lesser bounds
        for b in np.unique(at[open_]):
            mine = np.flatnonzero(open_ & (at == b))
            number, ids, matrix, _, _ = blocks[b]
            scores = _product(q[mine], matrix)
            own = np.flatnonzero(home[mine] == number)
            scores[own, row[mine[own]]] = NONE
            best_s[mine], best_i[mine] = merge(best_s[mine], best_i[mine], scores, ids, k)
    return best_s, best_i


BLOCK = "range_id int, block long, ids binary, kind string, matrix binary, top binary, low binary"
ASKED = "query_id long, home_range int, home_block long, row int, q binary"
HIT = "query_id long, home_range int, home_block long, row int, vec_id long, score long"


def _table(columns: dict, schema: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], kind) for k, kind in schema.items()], names=list(schema))


_BLOCK = {"range_id": pa.int32(), "block": pa.int64(), "ids": pa.binary(), "kind": pa.string(), "matrix": pa.binary(), "top": pa.binary(), "low": pa.binary()}
_ASKED = {"query_id": pa.int64(), "home_range": pa.int32(), "home_block": pa.int64(), "row": pa.int32(), "q": pa.binary()}
_HIT = {"query_id": pa.int64(), "home_range": pa.int32(), "home_block": pa.int64(), "row": pa.int32(), "vec_id": pa.int64(), "score": pa.int64()}


def _ints(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.int64)


def index(vectors: DataFrame, vec_id: str, vector: str, scale: int, block: int, range_rows: int) -> DataFrame:
    """A row per block."""
    rows = vectors.where(usable(vector)).where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    dims, n_ranges = int(size["d"] or 0), max(1, -(-size["n"] // range_rows))
    strongest = F.expr("coalesce(array_position(transform(v, x -> abs(x)), array_max(transform(v, x -> abs(x)))), 0)")
    sign = F.when(F.get("v", (strongest - 1).cast("int")) < 0, -1).otherwise(1)
    order = ["key", "id", "nth"]
    dealt = rows.withColumns({"key": strongest * sign, "nth": F.monotonically_increasing_id()}).repartitionByRange(n_ranges, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("range_id"), "id", "v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                own = batch.slice(at, block)
                ids, range_id = own.column("id").to_numpy(), own.column("range_id")[0].as_py()
                m = np.zeros((len(ids), dims), np.int64)
                for r, v in enumerate(own.column("v")):
                    m[r, : len(v)] = np.floor(scale * np.asarray(v.as_py(), np.float64)).astype(np.int64)
                top, low = m.max(0), m.min(0)
                kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if not dims or (np.iinfo(k).min <= low.min() and top.max() <= np.iinfo(k).max))
                yield _table({"range_id": [range_id], "block": [number], "ids": [ids.tobytes()], "kind": [kind], "matrix": [m.astype(kind).tobytes()], "top": [top.tobytes()], "low": [low.tobytes()]}, _BLOCK)
                number += 1

    return dealt.mapInArrow(pack, BLOCK)


def _asked(blocks: DataFrame, every: int) -> DataFrame:
    """The queries, with their places in the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = _ints(r["ids"])
                m, at = np.frombuffer(r["matrix"], r["kind"]).reshape(len(ids), -1), np.flatnonzero(ids % every == 0)
                yield _table({"query_id": ids[at], "home_range": [r["range_id"]] * len(at), "home_block": [r["block"]] * len(at), "row": at, "q": [m[i].astype("<i8").tobytes() for i in at]}, _ASKED)

    return blocks.select("range_id", "block", "ids", "kind", "matrix").mapInArrow(run, ASKED)


def _searched(asked: DataFrame, blocks: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of each query in the range that it meets; asked has range_id, floor and the keys, blocks have the keys."""

    def run(asked: pa.Table, own: pa.Table) -> pa.Table:
        if not asked.num_rows or not own.num_rows:
            return pa.Table.from_batches([_table({c: [] for c in _HIT}, _HIT)])
        q = np.stack([_ints(x.as_py()) for x in asked.column("q")])
        home = np.where(asked.column("home_range").to_numpy() == asked.column("range_id").to_numpy(), asked.column("home_block").to_numpy(), -1)
        parts = [(r["block"], i := _ints(r["ids"]), np.frombuffer(r["matrix"], r["kind"]).reshape(len(i), -1), _ints(r["top"]), _ints(r["low"])) for r in own.to_pylist()]
        s, i = search(home, asked.column("row").to_numpy(), q, asked.column("floor").to_numpy(), parts, k)
        found = s.ravel() != NONE
        of = np.repeat(np.arange(len(q)), k)[found]
        columns = {c: asked.column(c).to_numpy()[of] for c in ("query_id", "home_range", "home_block", "row")}
        return pa.Table.from_batches([_table(columns | {"vec_id": i.ravel()[found], "score": s.ravel()[found]}, _HIT)])

    return asked.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(run, HIT)


def _routed(asked: DataFrame, ranges: DataFrame, n_chunks: int, per_group: int) -> DataFrame:
    """asked (with floor and chunk), a row for each other range (range_id) whose bound reaches the floor. Chunks of queries meet groups of
    range bounds."""
    out = f"{ASKED}, floor long, chunk int, range_id int"
    columns = [c.split()[0] for c in out.split(", ")]
    n = ranges.agg(F.max("range_id")).first()[0] or 0
    left = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n // per_group))))
    right = ranges.withColumn("part", F.floor(F.col("range_id") / per_group).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))

    def run(asked: pa.Table, own: pa.Table) -> pa.Table:
        q = np.stack([_ints(x.as_py()) for x in asked.column("q")]) if asked.num_rows else np.zeros((0, 0))
        hits = (np.empty(0, np.int64),) * 2
        if asked.num_rows and own.num_rows:
            top, low = (np.stack([_ints(x.as_py()) for x in own.column(c)]) for c in ("top", "low"))
            reach = _product(np.maximum(q, 0), top) + _product(np.minimum(q, 0), low) >= asked.column("floor").to_numpy()[:, None]
            hits = np.nonzero(reach & (asked.column("home_range").to_numpy()[:, None] != own.column("range_id").to_numpy()[None, :]))
        found = asked.drop_columns(["part"]).take(pa.array(hits[0])).append_column("range_id", own.column("range_id").take(pa.array(hits[1])))
        return found.select(columns)

    return left.groupBy("chunk", "part").cogroup(right.groupBy("chunk", "part")).applyInArrow(run, out)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", block: int = 256, range_rows: int = 8192, chunk_rows: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by ``every``."""
    scratch = Scratch(vectors.sparkSession)
    blocks = scratch.keep(index(vectors, vec_id, vector, scale, block, range_rows), "blocks")
    asked = scratch.keep(_asked(blocks, every), "asked")
    key = ["query_id", "home_range", "home_block", "row"]
    near = scratch.keep(_searched(asked.withColumns({"range_id": F.col("home_range"), "floor": F.lit(NONE).cast("long")}), blocks, ["range_id"], k), "near")
    floors = near.groupBy(*key).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(NONE).cast("long")).alias("floor"))
    n_chunks = max(1, -(-asked.count() // chunk_rows))
    chunk = F.pmod(F.xxhash64(*key), F.lit(n_chunks)).cast("int")
    floored = asked.join(floors, key, "left").withColumns({"floor": F.coalesce("floor", F.lit(NONE).cast("long")), "chunk": chunk})

    def widest(own: pa.Table) -> pa.Table:
        top, low = (np.stack([_ints(x.as_py()) for x in own.column(c)]) for c in ("top", "low"))
        return pa.table({"range_id": own.column("range_id")[:1], "top": pa.array([top.max(0).tobytes()], pa.binary()), "low": pa.array([low.min(0).tobytes()], pa.binary())})

    ranges = blocks.select("range_id", "top", "low").groupBy("range_id").applyInArrow(widest, "range_id int, top binary, low binary")
    routed = scratch.keep(_routed(floored, scratch.keep(ranges, "ranges"), n_chunks, per_group=1024), "routed")
    pairs = routed.select(F.col("range_id").alias("in_range"), F.col("chunk").alias("of_chunk")).distinct()
    used = blocks.join(pairs, F.col("range_id") == F.col("in_range")).select(*(F.col(c).alias(c) for c in blocks.columns), F.col("of_chunk").alias("chunk"))
    far = _searched(routed, used, ["range_id", "chunk"], k)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id"))
    return near.union(far).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
