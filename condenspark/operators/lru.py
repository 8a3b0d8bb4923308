"""A bound on tracked patterns: the least recently used goes. Exact and parallel.

The ordered stream is cut into blocks. What is tracked at a block's start is the ``bound`` last used keys before it, so each block gives its own
last used keys (at most bound). These are merged in a tree: groups of blocks, and groups of groups, keep their last ``bound`` keys; from the
top down each group's start gives its members' starts, and all blocks are then replayed at once. Keys stay as they are in Arrow: a null is a
key like any other, and whole numbers are exact.

Accesses may belong to groups (whole numbers), each with a bound of its own; all groups are worked on at once.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType


def replay(keys: list, tracked: list, bound: int) -> list[bool]:
    """Is each access novel? tracked: keys from the least to the most recently used."""
    seen, novel = OrderedDict.fromkeys(tracked), []
    for key in keys:
        novel.append(key not in seen)
        seen[key] = None
        seen.move_to_end(key)
        if len(seen) > bound:
            seen.popitem(last=False)
    return novel


def latest(used: DataFrame, bound: int) -> DataFrame:
    """The bound last used keys of each block. used: group, block, key, last."""
    recent = F.row_number().over(Window.partitionBy("group", "block").orderBy(F.desc("last")))
    return used.groupBy("group", "block", "key").agg(F.max("last").alias("last")).withColumn("r", recent).where(F.col("r") <= bound).drop("r")


def starts(last: DataFrame, bound: int, fan: int, levels: int = 2) -> DataFrame:
    """group, block, key, nth: the keys that are tracked at each block's start, from the least recently used. last: as from latest()."""
    out = StructType([StructField("group", LongType()), StructField("block", LongType()), StructField("key", last.schema["key"].dataType), StructField("nth", LongType())])

    def fold(own: pa.Table, start: pa.Table | None = None) -> pa.Table:
        tracked = OrderedDict.fromkeys([] if start is None else start.sort_by("nth").column("key").to_pylist())
        own = own.sort_by([("block", "ascending"), ("last", "ascending")])
        blocks, keys = own.column("block").to_numpy(), own.column("key").to_pylist()
        cuts = np.r_[0, np.flatnonzero(np.diff(blocks)) + 1, len(blocks)].tolist() if len(blocks) else [0]
        found, sizes = [], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            found += tracked
            sizes.append(len(tracked))
            for k in keys[a:b]:
                tracked[k] = None
                tracked.move_to_end(k)
            while len(tracked) > bound:
                tracked.popitem(last=False)
        nth = np.concatenate([np.zeros(0, np.int64), *map(np.arange, sizes)])
        group = np.full(len(found), own.column("group")[0].as_py() if len(own) else 0)
        return pa.table([pa.array(group, pa.int64()), pa.array(np.repeat(blocks[cuts[:-1]], sizes), pa.int64()), pa.array(found, own.schema.field("key").type), pa.array(nth, pa.int64())], names=["group", "block", "key", "nth"])

    if not levels:
        return last.withColumn("above", F.col("block") * 0).groupBy("group", "above").applyInArrow(lambda own: fold(own), out)
    own = last.withColumn("above", F.floor(F.col("block") / fan))
    above = starts(latest(own.select("group", F.col("above").alias("block"), "key", "last"), bound), bound, fan, levels - 1)
    return own.groupBy("group", "above").cogroup(above.groupBy("group", "block")).applyInArrow(fold, out)


def novelty(accesses: DataFrame, key: str, order: str, bound: int, block_rows: int = 1 << 16, fan: int | None = None, group: str | None = None) -> DataFrame:
    """key, order, novel. order is a unique whole number. group: a column of whole numbers; each has a bound of its own. fan: how many blocks a group has; as a rule about a million keys."""
    own_group = F.col(group) if group else F.lit(0)
    rows = accesses.select(own_group.cast("long").alias("group"), F.col(key).alias("key"), F.col(order).alias("at")).withColumn("block", F.floor(F.col("at") / block_rows))
    state = starts(latest(rows.select("group", "block", "key", F.col("at").alias("last")), bound), bound, fan or max(2, min(64, (1 << 20) // bound)))

    def run(own: pa.Table, start: pa.Table) -> pa.Table:
        own = own.sort_by("at").select(["key", "at"])
        return own.append_column("novel", pa.array(replay(own.column("key").to_pylist(), start.sort_by("nth").column("key").to_pylist(), bound), pa.bool_()))

    out = StructType([*(StructField(f.name, f.dataType) for f in rows.schema.fields if f.name in ("key", "at")), StructField("novel", BooleanType())])
    return rows.groupBy("group", "block").cogroup(state.groupBy("group", "block")).applyInArrow(run, out).withColumnsRenamed({"key": key, "at": order})
