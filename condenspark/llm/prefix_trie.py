"""Operator 12: the trie of conversation prefixes, with what each subtree could save.

Each different sequence of a conversation's first d turns (role and text) is a node; the root is the empty sequence. A node's key is the
digest of its depth and of four running sums of hashes of (place, role, text), 124 bits; a turn gives an edge from its own prefix's key to the
shorter one's. Leaf counts and savings go up to all ancestors by pointer jumping: in round k each node sends its total to the ancestor 2^k
above it and then points twice as far, so a trie of depth d takes log2(d) + 1 rounds, not d.

Nothing is gathered by conversation or node: turns are numbered in ranges of one global order and summed in chunks of places, counts are
combined before the shuffle, and pointers that many nodes share (there are at most HOT such) are followed by broadcast, the rest by a join.
Ids of the conversations that end in a node are joined in pieces, one for each range of ids, and hashed piece after piece as a stream.

Turns are ordered by (turn, role, digest of the text), null turns first; null role and text count as empty. Repeated rows are turns of their
own. Rows without conv_id take no part. An empty table gives no rows, not even the root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condenspark.llm.common import Scratch, bound_batches

LANES = ["s1", "s2", "s3", "s4"]
HOT = 256  # pointers that more than this part of all nodes share


def numbered(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """All turns in one order: conv_id, part, id (rising), role, digest, points. And for each conversation and part: n, n_turns and shift,
    which makes an id the turn's place, from 1."""
    text = F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.md5(text.cast("binary")).alias("digest"), F.length(text).alias("points"))
    order = ["conv_id", "turn", "role", "digest"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("turn").withColumn("id", F.monotonically_increasing_id())
    placed = scratch.keep(ordered.withColumn("part", F.shiftright("id", 33)), "turns")
    spans = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    by_part = Window.partitionBy("conv_id").orderBy("part")
    before = F.sum("n").over(by_part) - F.col("n")
    return placed, spans.select("conv_id", "part", "n", (before - F.col("low") + 1).alias("shift"), F.sum("n").over(Window.partitionBy("conv_id")).alias("n_turns"))


def grafted(placed: DataFrame, spans: DataFrame, every: int, most: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Conversations c whose first turns are another's: the first h turns of conversation c - c % every (all if fewer, none if absent), then
    c's own turns after its first h; h = crc32(c in decimal) % most. Their turns: conv_id, part, place, role, digest, points; and conversations:
    conv_id, part, n_turns."""
    of, h = F.col("conv_id") - F.col("conv_id") % every, F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    bases = spans.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.col("n_turns").alias("n_base")).distinct()
    spans = scratch.keep(spans.withColumns({"base": of, "h": h}).join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0)))), "spans")
    own = placed.join(spans.select("conv_id", "part", "shift", "h", "taken"), ["conv_id", "part"]).withColumn("at", F.col("id") + F.col("shift"))
    convs = spans.groupBy("conv_id").agg(F.min("part").alias("part"), F.min("base").alias("base"), F.min("h").alias("h"), (F.min("taken") + F.greatest(F.min("n_turns") - F.min("h"), F.lit(0))).alias("n_turns"))
    said = ["role", "digest", "points"]
    starts = own.where((F.col("conv_id") % every == 0) & (F.col("at") < most)).select(F.col("conv_id").alias("of"), "at", *said)
    taken = convs.join(starts, (F.col("base") == F.col("of")) & (F.col("at") <= F.col("h"))).select("conv_id", "part", F.col("at").alias("place"), *said)
    rest = own.where("at > h").select("conv_id", "part", (F.col("at") - F.col("h") + F.col("taken")).alias("place"), *said)
    return taken.unionByName(rest), convs.select("conv_id", "part", "n_turns")


def steps(turns: DataFrame, scratch: Scratch, chunk: int) -> DataFrame:
    """conv_id, part, place, points, node and parent (keys of the prefix up to the turn and up to the one before)."""
    said = [F.col("place"), F.col("role"), F.col("digest")]
    h1, h2 = F.xxhash64(*said), F.xxhash64(F.lit("second"), *said)
    low, high = lambda h: h.bitwiseAND(0x7FFFFFFF), lambda h: F.shiftrightunsigned(h, 33)
    lanes = turns.select("conv_id", "part", "place", "points", F.floor(F.col("place") / chunk).alias("chunk"), *(f.alias(c) for c, f in zip(LANES, (low(h1), high(h1), low(h2), high(h2)), strict=True)))
    lanes = scratch.keep(lanes, "lanes")
    over = Window.partitionBy("conv_id").orderBy("chunk")
    upto = lanes.groupBy("conv_id", "chunk").agg(*(F.sum(c).alias(c) for c in LANES)).select("conv_id", "chunk", *((F.sum(c).over(over) - F.col(c)).alias(f"b_{c}") for c in LANES))
    running = Window.partitionBy("conv_id", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rolled = lanes.select("conv_id", "part", "place", "points", "chunk", *LANES, *(F.sum(c).over(running).alias(f"r_{c}") for c in LANES)).join(upto, ["conv_id", "chunk"])
    whole = [F.col(f"r_{c}") + F.col(f"b_{c}") for c in LANES]
    return rolled.select("conv_id", "part", "place", "points", key(F.col("place"), *whole).alias("node"), key(F.col("place") - 1, *(w - F.col(c) for w, c in zip(whole, LANES, strict=True))).alias("parent"))


def key(depth: Column, *sums: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth, *sums).cast("binary")))


def ended(ends: DataFrame) -> DataFrame:
    """node, ends_sha256: of the ids of the conversations that end there, in decimal, ascending, joined by commas. ends: node, part, conv_id;
    a part is a range of ids."""
    pieces = ends.groupBy("node", "part").agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done = []
            for own, piece in zip(batch.column("node").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                if own == node:
                    digest.update(b"," + piece.encode())
                else:
                    if digest:
                        done.append((node, digest.hexdigest()))
                    node, digest = own, hashlib.sha256(piece.encode())
            yield rows(done)
        if digest:
            yield rows([(node, digest.hexdigest())])

    def rows(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], names=["node", "ends_sha256"])

    return pieces.repartition("node").sortWithinPartitions("node", "part").mapInArrow(run, "node binary, ends_sha256 string")


def followed(state: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """The rows of state (node, pointer, conv_id, ...) with next and next_conv: pointer and conv_id of the node pointed at; both null where pointer is.
    counts: node and how many point at it. n: rows of state."""
    told = state.select(F.col("node").alias("pointer"), F.col("pointer").alias("next"), F.col("conv_id").alias("next_conv"))
    often = counts.where(F.col("pointing") > max(1, n // HOT)).select(F.col("node").alias("pointer"))  # HOT rows at most
    hot = told.join(F.broadcast(often), "pointer").withColumn("is_hot", F.lit(True))
    active = state.where("pointer is not null").join(F.broadcast(hot), "pointer", "left")
    cold = active.where("is_hot is null").drop("next", "next_conv").join(told, "pointer")
    ended = state.where("pointer is null").withColumns({"next": F.lit(None).cast("binary"), "next_conv": F.lit(None).cast(state.schema["conv_id"].dataType)})
    return active.where("is_hot").drop("is_hot").unionByName(cold.drop("is_hot")).unionByName(ended)


def rolled_up(tree: DataFrame, scratch: Scratch) -> DataFrame:
    """tree (node, pointer: its parent, conv_id, depth, leaves, saved, ...) with leaves and saved summed over subtrees, and parent_conv_id."""
    found = tree.agg(F.max("depth").alias("depth"), F.count("*").alias("n")).first()
    state, k = tree.withColumn("parent_conv_id", F.lit(None).cast(tree.schema["conv_id"].dataType)), 0
    while not k or 1 << k <= (found["depth"] or 0):
        sent = state.where("pointer is not null").groupBy(F.col("pointer").alias("node")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count("*").alias("pointing"))
        sent = scratch.keep(sent, "sent")
        ahead = followed(state, sent, found["n"])
        if not k:
            ahead = ahead.withColumn("parent_conv_id", F.col("next_conv"))
        ahead = ahead.drop("pointer", "next_conv").withColumnRenamed("next", "pointer").join(sent.drop("pointing"), "node", "left")
        total = {c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")}
        state = scratch.keep(ahead.withColumns(total).drop("more_leaves", "more_saved"), "state")
        scratch.drop("sent")
        scratch.drop("state", but=1)
        k += 1
    return state


def prefix_trie(turns: DataFrame, graft: tuple[int, int] | None = None, chunk: int = 512) -> DataFrame:
    """conv_id (least member), depth, parent_conv_id, n_convs (members), n_children, n_leaves (childless nodes of the subtree), saved_tokens (over the
    subtree: code points of a node's last text for each member but one), ends_sha256. turns: conv_id, turn, role, text. graft: (every, most),
    conversations get their first turns from others, as grafted() says."""
    bound_batches(turns.sparkSession)
    scratch = Scratch(turns.sparkSession)
    placed, spans = numbered(turns, scratch)
    if graft:
        own, convs = grafted(placed, spans, *graft, scratch)
    else:
        own = placed.join(spans, ["conv_id", "part"]).withColumn("place", F.col("id") + F.col("shift"))
        convs = spans.groupBy("conv_id").agg(F.min("part").alias("part"), F.min("n_turns").alias("n_turns"))
    convs = scratch.keep(convs, "convs")
    edges = scratch.keep(steps(own, scratch, chunk), "edges")
    scratch.drop("turns", "spans", "lanes")
    root = key(*(F.lit(0) for _ in range(5)))
    nodes = edges.groupBy("node").agg(F.min("parent").alias("pointer"), F.min("place").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("points").alias("points"))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    top = top.select(root.alias("node"), F.lit(None).cast("binary").alias("pointer"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).alias("points"))
    nodes = scratch.keep(nodes.unionByName(top), "nodes")
    children = nodes.where("pointer is not null").groupBy(F.col("pointer").alias("node")).agg(F.count("*").alias("n_children"))
    tree = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    tree = tree.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("points")}).drop("points")
    state = rolled_up(scratch.keep(tree, "tree"), scratch)
    last = edges.join(convs.select("conv_id", F.col("n_turns").alias("place")), ["conv_id", "place"]).select("node", "part", "conv_id")
    ends = scratch.keep(ended(last.unionByName(convs.where("n_turns = 0").select(root.alias("node"), "part", "conv_id"))), "ends")
    scratch.drop("edges", "convs", "nodes", "tree")
    out = state.join(ends, "node", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))
