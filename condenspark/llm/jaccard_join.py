"""Operator 9: exact n-gram Jaccard self-join with adaptive multi-match prefixes.

A document's set holds its distinct ``width``-word shingles. Two documents link when ``100 * |A & B| >= percent * |A | B|``; a document's
component is the smallest doc_id that it reaches by links.

1. One pass hashes every set, and adds every shingle to a frequency sketch whose width follows the bytes of text (about one cell for
   64 shingles, from 2^18 to 2^24 cells; beyond that it only orders less well). Equal sets become one node.
2. Shingles are ordered rarest first (by sketch, then by hash; any order is right, the sketch only saves work). A node's prefix for
   ``m`` matches holds all but ``ceil(percent * n) - m`` of its shingles, and two linked nodes share at least m of them. Each node
   takes the m of least estimated cost: a longer prefix has more postings, but fewer candidates that share m of them.
3. Postings meet by shingle; those of shingles that the sketch takes for very frequent are spread over tasks and go the way of large
   groups, which is right for any group. A small group gives its pairs, with counts. A pair is a candidate if what it shares in the
   prefixes and what it can share beyond them are enough for a link; postings in large groups, where nothing is counted, are taken as
   shared. In a group above ``small`` each node meets one node only, that with the fewest rarer shingles of its own (among copies, the
   least changed); nodes that link with it are in one component, whatever pairs they form. Each node that doesn't meets those of the
   group whose set sizes and whose places of the shingle leave room for a link: both sides are first cut down to the sizes at which
   they can link at all, so documents that only share a common passage are not paired. No pair that could link two components is left
   out, and large groups of copies don't give all their pairs.
4. Candidates that share enough are verified on whole sets. Components come from the verified links by rounds of least labels.

Null and empty texts have no shingles; their component is their own doc_id. With fewer than ``width`` words the whole sequence is one
shingle. Repeated rows each get a row. Rows with a null doc_id take part; a component's id is the least that isn't null. Extra columns
are not read. Sets are known by 96 bits of hash, shingles by 64. A text of 2^26 distinct shingles or more (some hundred megabytes) is
refused with an error. Intermediate tables are dropped as soon as no later step reads them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condenspark.llm.common import Scratch, bound_batches, give_back

U = np.uint64
_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_PLACE = 0x9E3779B97F4A7C15
_BACK = pow(_PLACE, -1, 2**64)
_TABLE = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    np.cumprod(np.full(n - 1, base, np.uint64), out=out[1:])
    return out


_UP, _DOWN = _powers(_PLACE, _TABLE), _powers(_BACK, _TABLE)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def shingles(text: bytes | None, width: int = 4) -> np.ndarray:
    """Sorted hashes of the distinct shingles of UTF-8 text."""
    if not text:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(b" " + text + b" ", np.uint8)
    blank = _BLANK[raw]
    begin, end = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1, np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    if not len(begin):
        return np.empty(0, np.uint64)
    n = len(raw)
    up, down = (_UP, _DOWN) if n <= _TABLE else (_powers(_PLACE, n), _powers(_BACK, n))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:n], out=total[1:])
    word = _mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    k = min(width, len(word))
    turn = _powers(0xC2B2AE3D27D4EB4F, width + 1)[1:]
    found = sum(word[i : len(word) - k + 1 + i] * turn[i] for i in range(k)) + U(k)
    return np.unique(_mix(found))


def set_key(found: np.ndarray, seed: int = 0x51ED270B) -> tuple[int, int]:
    """96 bits that name a set: sums of two mixes."""
    a = int(_mix(found ^ U(seed)).sum(dtype=np.uint64))
    b = int(_mix(found + U(seed)).sum(dtype=np.uint64)) >> 32
    return a - (1 << 64) * (a >> 63), b - (1 << 32) * (b >> 31)


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that few texts and hashes are Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        give_back()


SIGNED = pa.schema([("a", pa.int64()), ("b", pa.int32()), ("n", pa.int64()), ("cell", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])


def size_of_sketch(docs: DataFrame, per_cell: int = 64) -> tuple[int, int]:
    """The logarithm of the number of cells, about one for per_cell words; and in how many groups of tasks it is summed first."""
    size = docs.select(F.octet_length("text").alias("bytes"), F.spark_partition_id().alias("part")).agg(F.sum("bytes"), F.max("part")).first()
    return min(24, max(18, ((size[0] or 0) // (6 * per_cell)).bit_length())), 1 + int((1 + (size[1] or 0)) ** 0.5)


def _packed(counts: np.ndarray) -> bytes:
    """Counts below 2^32, byte by byte of their weight: most are small."""
    return zlib.compress(np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def signatures(docs: DataFrame, width: int, cells_log2: int, groups: int, chunk: int = 1 << 16) -> DataFrame:
    """doc_id, text_hash, a, b, n of each row; and, with a cell, each task's part of the sketch."""
    kept = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    spark_schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, a long, b int, n long, cell int, part int, counts binary"
    shift = U(64 - cells_log2)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sketch, kind, part = np.zeros(1 << cells_log2, np.uint32), None, TaskContext.get().partitionId() % groups
        for batch in _slices(batches):
            kind = batch.schema.field("doc_id").type
            a, b, n = [], [], []
            for text in _texts(batch):
                found = shingles(text, width)
                if len(found) >= 1 << 26:
                    raise ValueError(f"a text has {len(found)} distinct shingles; at most {(1 << 26) - 1} are possible")
                np.add.at(sketch, (found >> shift).astype(np.int64), np.uint32(1))
                x, y = set_key(found)
                a.append(x)
                b.append(y)
                n.append(len(found))
            k = len(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(n, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=["doc_id", "text_hash", *SIGNED.names])
        if kind is not None:
            for i in range(0, len(sketch), chunk):
                counts = _packed(sketch[i : i + chunk])
                yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([i // chunk], pa.int32()), pa.array([part], pa.int32()), pa.array([counts], pa.binary())], names=["doc_id", "text_hash", *SIGNED.names])

    return kept.mapInArrow(sign, spark_schema)


def sketch_of(signed: DataFrame) -> np.ndarray:
    """The sum of the tasks' sketches."""

    def add(part: pa.Table) -> pa.Table:
        total = np.zeros(1, np.uint64)
        for c in part.column("counts"):
            total = total + _unpacked(c.as_py())
        return pa.table({"cell": part.column("cell")[:1], "counts": pa.array([_packed(np.minimum(total, 2**32 - 1))], pa.binary())})

    # in two levels, so that no task gathers the parts of all tasks
    half = signed.where("cell is not null").select("cell", "part", "counts").groupBy("cell", "part").applyInArrow(add, "cell int, counts binary")
    rows = half.groupBy("cell").applyInArrow(add, "cell int, counts binary").collect()
    return np.concatenate([_unpacked(r["counts"]) for r in sorted(rows, key=lambda r: r["cell"])]) if rows else np.zeros(1, np.uint32)


def excess(sketch: np.ndarray) -> np.ndarray:
    """How much each cell is above what chance puts there, as a code of eight steps a doubling: the frequency of its frequent shingles."""
    usual = int(np.median(sketch))
    above = np.maximum(0, sketch.astype(np.int64) - usual - 4 * isqrt(usual))
    return np.minimum(255, np.ceil(8 * np.log2(1.0 + above))).astype(np.uint8)


#: What a code of excess() stands for.
FREQUENCY = np.exp2(np.arange(256) / 8) - 1


def least(n, percent: int):
    """The least overlap of a set of n with any set that it links with."""
    return -(-percent * n // 100)


def choose_matches(costs: np.ndarray, base: int, most: int, verify_cost: int = 8) -> int:
    """costs: estimated frequencies, in order. Postings read, plus candidates (those that share m of them) times their cost."""
    best, total = (None, 1), int(costs[:base].sum())
    for m in range(1, most + 1):
        if m > 1 and base + m - 2 < len(costs):
            total += int(costs[base + m - 2])
        cost = total + verify_cost * total / m + m
        if best[0] is None or cost < best[0]:
            best = (cost, m)
    return best[1]


POSTED = "token long, a long, b int, pack long"


def postings(docs: DataFrame, codes: np.ndarray, width: int, percent: int, most: int, frequent: int) -> DataFrame:
    """A row for each shingle of each node's prefix. pack: n (26 bits), place in order (26), m (3), typicality (7), and whether the shingle
    is taken to be in more than ``frequent`` sets (1)."""
    shift = U(64 - (len(codes).bit_length() - 1))
    shared = docs.sparkSession.sparkContext.broadcast(codes)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value
        seen: set[tuple[int, int]] = set()  # of this task's rows: copies are left out here, others where groups meet
        for batch in _slices(batches):
            token, a, b, pack = [], [], [], []
            for text in _texts(batch):
                found = shingles(text, width)
                n = len(found)
                if not n or (key := set_key(found)) in seen:
                    continue
                seen.add(key)
                own = code[(found >> shift).astype(np.int64)]
                order = np.argsort(own, kind="stable")
                base = n - least(n, percent) + 1
                m = choose_matches(FREQUENCY[own[order[: base + most]]].astype(np.int64), base, min(most, least(n, percent)))
                first = order[: base + m - 1]
                typical = min(127, int(8 * np.log2(1 + FREQUENCY[own].mean())))
                token.append(found[first])
                a.append(np.full(len(first), key[0], np.int64))
                b.append(np.full(len(first), key[1], np.int32))
                pack.append((n << 37) + (np.arange(len(first), dtype=np.int64) << 11) + (m << 8) + (typical << 1) + (FREQUENCY[own[first]] > frequent))
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([t.view(np.int64) for t in token], a, b, pack)], names=["token", "a", "b", "pack"])

    return docs.select("text").mapInArrow(post, POSTED)


def _unpack(pack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pack >> 37, (pack >> 11) & ((1 << 26) - 1), (pack >> 8) & 7


def _allowed(n1, p1, n2, p2, percent: int):
    """May two sets link if the shingles at these places are the first that they share?"""
    need = -(-percent * (n1 + n2) // (100 + percent))
    return (np.minimum(n1 - p1, n2 - p2) >= need) & (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2))


MET = pa.schema([("a1", pa.int64()), ("b1", pa.int32()), ("a2", pa.int64()), ("b2", pa.int32()), ("shared", pa.int64()), ("room", pa.int32()), ("fits", pa.bool_()), ("token", pa.int64()), ("pack", pa.int64())])
MET_SQL = "a1 long, b1 int, a2 long, b2 int, shared long, room int, fits boolean, token long, pack long"


def meet(posted: DataFrame, percent: int, small: int) -> DataFrame:
    """Of postings sorted by token: pairs of small groups, and (with a token) the postings of large groups and of frequent shingles."""

    def small_pairs(t, a, b, pack) -> pa.RecordBatch | None:
        n, p, m = _unpack(pack)
        level = np.maximum(1, p - (n - least(n, percent) + 1) + 2)
        got = []
        for d in range(1, small):
            if d >= len(t):
                break
            i = np.flatnonzero(t[d:] == t[:-d])
            if not len(i):
                break
            j = i + d
            need = np.minimum(m[i], m[j])
            fits = _allowed(n[i], p[i], n[j], p[j], percent)
            ok = (np.maximum(level[i], level[j]) <= need) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            room = np.maximum(least(n[i], percent), least(n[j], percent)) - need - -(-percent * (n[i] + n[j]) // (100 + percent))
            got.append(np.stack([a[i[ok]], b[i[ok]], a[j[ok]], b[j[ok]], room[ok], fits[ok]]))
        if not got or not sum(g.shape[1] for g in got):
            return None
        x, first, times = np.unique(np.concatenate(got, axis=1)[:4], axis=1, return_inverse=True, return_counts=True)
        every = np.concatenate(got, axis=1)
        room, fits = np.zeros(x.shape[1], np.int64), np.zeros(x.shape[1], bool)
        room[first.ravel()] = every[4]  # the same in all of a pair's rows
        np.logical_or.at(fits, first.ravel(), every[5].astype(bool))
        none = pa.nulls(x.shape[1], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x[0], pa.int64()), pa.array(x[1].astype(np.int32)), pa.array(x[2], pa.int64()), pa.array(x[3].astype(np.int32)), pa.array(times.astype(np.int64)), pa.array(room.astype(np.int32)), pa.array(fits), none, none], schema=MET)

    def large(t, a, b, pack) -> pa.RecordBatch:
        k = len(t)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.bool_()), pa.array(t), pa.array(pack)], schema=MET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)]
        held, hot = empty, None

        def split(cols: list[np.ndarray], end: bool):
            """What is complete, and the last group, which may go on. A last group that is large already is not held."""
            nonlocal hot, held
            t, a, b, pack = cols
            same = np.zeros(len(t), bool)
            same[1:] = (t[1:] == t[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            t, a, b, pack = (c[~same] for c in (t, a, b, pack))
            if not len(t):
                held = [t, a, b, pack]
                return
            edge = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1], [True]]))
            size = np.repeat(np.diff(edge), np.diff(edge))
            big = size > small
            if hot is not None:
                big |= t == hot
            hold = np.zeros(len(t), bool)
            if not end and not big[-1]:
                hold[edge[-2] :] = True
            hot = t[-1] if big[-1] else None
            held = [c[hold] for c in (t, a, b, pack)]
            mid = ~hold & ~big & (size > 1)
            if big.any():
                yield large(*(c[big] for c in (t, a, b, pack)))
            if mid.any() and (out := small_pairs(*(c[mid] for c in (t, a, b, pack)))) is not None:
                yield out

        for batch in _slices(batches, 2048):  # a posting has up to ``small`` pairs
            new = [batch.column(k).to_numpy() for k in range(4)]
            spread = new[3] % 2 == 1
            if spread.any():
                yield large(*(c[spread] for c in new))
                new = [c[~spread] for c in new]
            yield from split([np.concatenate(x) for x in zip(held, new, strict=True)], False)
        yield from split(held, True)

    spread = F.when(F.col("pack") % 2 == 1, F.pmod("a", F.lit(256))).otherwise(0)  # postings of frequent shingles need not meet here
    dealt = posted.repartition("token", spread).sortWithinPartitions("token", "a", "b")
    return dealt.mapInArrow(run, MET_SQL)


def _fields(prefix: str) -> tuple[str, str, str]:
    return f"shiftright({prefix}pack, 37)", f"(shiftright({prefix}pack, 11) & 67108863)", f"(shiftright({prefix}pack, 8) & 7)"


def _may_link(percent: int, x: str, y: str) -> str:
    """SQL: may the shingle be the first that two sets share, and may they then link?"""
    (n1, p1, _), (n2, p2, _) = _fields(x), _fields(y)
    fits = f"least({n1} - {p1}, {n2} - {p2}) >= ceil({percent} * ({n1} + {n2}) / {100 + percent}.0)"
    return f"100 * least({n1}, {n2}) >= {percent} * greatest({n1}, {n2}) and {fits}"


def _room(percent: int, x: str, y: str) -> str:
    """SQL: the shingles that two sets can share beyond those of their prefixes, less those that they need to link."""
    (n1, _, m1), (n2, _, m2) = _fields(x), _fields(y)
    low = lambda n: f"ceil({percent} * {n} / 100.0)"
    return f"cast(greatest({low(n1)}, {low(n2)}) - least({m1}, {m2}) - ceil({percent} * ({n1} + {n2}) / {100 + percent}.0) as int)"


PAIR = ["a1", "b1", "a2", "b2"]


def _ordered(x: str, y: str) -> list:
    """The pair of nodes with the lesser one first."""
    swap = F.expr(f"struct({x}a, {x}b) > struct({y}a, {y}b)")
    one, two = F.struct(F.col(f"{x}a").alias("a"), F.col(f"{x}b").alias("b")), F.struct(F.col(f"{y}a").alias("a"), F.col(f"{y}b").alias("b"))
    lo, hi = F.when(swap, two).otherwise(one), F.when(swap, one).otherwise(two)
    return [lo["a"].alias("a1"), lo["b"].alias("b1"), hi["a"].alias("a2"), hi["b"].alias("b2")]


def verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """a1..b2 and x, y (node ids) of the pairs whose whole sets link."""
    left = texts.select(F.col("a").alias("a1"), F.col("b").alias("b1"), F.col("node").alias("x"), F.col("text").alias("t1"))
    right = texts.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("node").alias("y"), F.col("text").alias("t2"))
    both = pairs.join(right, ["a2", "b2"]).join(left, ["a1", "b1"]).select(*PAIR, "x", "y", "t1", "t2")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, None
        for batch in _slices(batches):
            t1, t2 = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("t1", "t2"))
            keep = []
            for s, t in zip(t1, t2, strict=True):
                if s != last or one is None:
                    last, one = s, shingles(s, width)
                two = shingles(t, width)
                common = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * common >= percent * (len(one) + len(two) - common))
            yield batch.drop_columns(["t1", "t2"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "a1 long, b1 int, a2 long, b2 int, x long, y long")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label (the least node of its component), for the nodes of links x, y. Least labels spread by rounds, each of which also
    jumps to the label of the label; each round is written to the shared folder."""
    both = scratch.keep(links.select("x", "y").union(links.select("y", "x")).distinct(), "edges")
    labels = scratch.keep(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("y")).select("node", F.least("node", "y").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        new = scratch.keep(step.join(jump, "next").select("node", "label", F.least("next", "far").alias("next")), "labels")
        scratch.drop("labels", but=1)
        labels = new.select("node", F.col("next").alias("label"))
        if not new.where("next < label").limit(1).count():
            scratch.drop("edges")
            return labels


def _in_bitmap(rows: DataFrame, values: DataFrame, columns: list[str], bits_log2: int = 23) -> DataFrame:
    """The rows whose columns are among the values, and a few others: a filter of a fixed size that only spares the shuffle of texts that
    no one needs."""
    words = (1 << bits_log2) // 32
    at = F.pmod(F.xxhash64(*columns), F.lit(1 << bits_log2))
    packed = values.select((at / 32).cast("int").alias("w"), F.pmod(at, F.lit(32)).cast("int").alias("k")).distinct().groupBy("w").agg(F.sum(F.expr("shiftleft(1L, k)")).alias("v")).collect()
    bitmap = np.zeros(words, np.uint32)
    bitmap[[r["w"] for r in packed]] = [r["v"] for r in packed]
    shared = values.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column("__at").to_numpy()
            yield batch.drop_columns(["__at"]).filter(pa.array((shared.value[k // 32] >> (k % 32).astype(np.uint32)) & 1 == 1))

    return rows.withColumn("__at", at).mapInArrow(run, rows.schema)


def _band(n: str) -> tuple[str, str]:
    """SQL: the least and the greatest size of n's band; sizes below 128 are bands of their own, others keep seven leading bits."""
    cut = f"greatest(0, length(bin({n})) - 7)"
    low = f"shiftleft(shiftright({n}, {cut}), {cut})"
    return low, f"({low} + shiftleft(1L, {cut}) - 1)"


def _reach(posted: DataFrame, others: DataFrame, percent: int) -> DataFrame:
    """posted (token, a, b, pack) with own (its band of sizes) and other: each band of ``others`` (token, low, high) with which its size
    and the place of the shingle leave room for a link."""
    n, p, _ = _fields("")
    sizes = f"{percent} * low <= 100 * {n} and {percent} * {n} <= 100 * high"
    place = f"least({n} - {p}, high) >= ceil({percent} * ({n} + low) / {100 + percent}.0)"
    return posted.withColumn("own", F.expr(_band(n)[0])).join(others, "token").where(f"{sizes} and {place}").select("token", "own", F.col("low").alias("other"), "a", "b", "pack")


def _bands(posted: DataFrame) -> DataFrame:
    low, high = _band(_fields("")[0])
    return posted.select("token", F.expr(low).alias("low"), F.expr(high).alias("high")).distinct()


def jaccard_links(docs: DataFrame, width: int = 4, percent: int = 85, most_matches: int = 4, small: int = 64, frequent: int = 4096, cells_log2: int | None = None, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, n, a, b), classes of equal sets (a, b, node, least doc_id), and links between classes (x, y: node ids). The links
    span every component; in large groups not every link between members of one component is listed."""
    bound_batches(docs.sparkSession)
    scratch = scratch or Scratch(docs.sparkSession)
    cells, groups = size_of_sketch(docs)
    signed = scratch.keep(signatures(docs, width, cells_log2 or cells, groups), "signed")
    codes = excess(sketch_of(signed))
    rows = scratch.keep(signed.where("cell is null").drop("cell", "part", "counts"), "rows")
    scratch.drop("signed")
    classes = rows.where("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "text_hash")).alias("example"))
    classes = scratch.keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    met = scratch.keep(meet(postings(docs, codes, width, percent, most_matches, frequent), percent, small), "met")

    hot = met.where("token is not null").select("token", F.col("a1").alias("a"), F.col("b1").alias("b"), "pack").dropDuplicates(["token", "a", "b"])
    heads = hot.groupBy("token").agg(F.max(F.struct(F.expr(f"-{_fields('')[1]}").alias("few"), F.expr("shiftright(pack, 1) & 127").alias("typical"), "a", "b", "pack")).alias("h"))
    headed = hot.join(heads.select("token", F.col("h.a").alias("h_a"), F.col("h.b").alias("h_b"), F.col("h.pack").alias("h_pack")), "token")
    headed = scratch.keep(headed, "hot").withColumn("is_head", F.expr("a = h_a and b = h_b"))
    times = scratch.keep(headed.groupBy("a", "b").agg(F.count("*").alias("times")), "times")  # postings in large groups
    one = met.where("token is null").select(*(F.col(c) for c in PAIR), "shared", "room", "fits")
    swapped = F.expr("struct(a1, b1) > struct(a2, b2)")
    one = one.select(*(F.when(swapped, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in zip(PAIR, ["a2", "b2", "a1", "b1"], strict=True)), "shared", "room", "fits")
    counted = scratch.keep(one.groupBy(*PAIR).agg(F.sum("shared").alias("shared"), F.max("room").alias("room"), F.max("fits").alias("fits")), "counted")
    scratch.drop("met")

    def enough(pairs: DataFrame) -> DataFrame:
        """Pairs that share enough in their prefixes, if they share all that isn't counted."""
        t1, t2 = (times.select(F.col("a").alias(f"a{k}"), F.col("b").alias(f"b{k}"), F.col("times").alias(f"times{k}")) for k in (1, 2))
        return pairs.join(t1, ["a1", "b1"]).join(t2, ["a2", "b2"]).where("shared + room + least(times1, times2) >= 0").select(*PAIR)

    def of_large(pairs: DataFrame) -> DataFrame:
        return enough(pairs.groupBy(*PAIR).agg(F.max("room").alias("room")).join(counted.select(*PAIR, "shared"), PAIR, "left").withColumn("shared", F.coalesce("shared", F.lit(0))))

    star = headed.where("not is_head").where(_may_link(percent, "", "h_")).select(*_ordered("", "h_"), F.expr(_room(percent, "", "h_")).alias("room"))
    candidates = counted.where("fits and shared + room >= 0").select(*PAIR).union(enough(counted.where("fits and shared + room < 0"))).union(of_large(star))
    candidates = scratch.keep(candidates.distinct(), "candidates")

    nodes = candidates.select("a1", "b1").union(candidates.select("a2", "b2")).union(headed.select("a", "b")).distinct().toDF("a", "b")
    wanted = scratch.keep(nodes.join(classes, ["a", "b"]).select("a", "b", "node", "example.*"), "wanted")
    # by text_hash and doc_hash the texts are dealt once, for the removal of repeated rows and for the join
    wanted = wanted.select("a", "b", "node", "text_hash", F.xxhash64("doc_id").alias("doc_hash"))
    texts = _in_bitmap(docs.select("text", F.xxhash64("text").alias("text_hash"), F.xxhash64("doc_id").alias("doc_hash")), wanted, ["text_hash", "doc_hash"])
    texts = texts.groupBy("text_hash", "doc_hash").agg(F.first("text").alias("text")).join(wanted, ["text_hash", "doc_hash"]).select("a", "b", "node", "text")
    texts = scratch.keep(texts, "texts")
    links = scratch.keep(verify(candidates, texts, width, percent), "links")

    # the postings of a large group that its most typical node doesn't link with meet those of the group that they may link with
    linked = links.select(*PAIR, F.lit(True).alias("linked"))
    away = headed.where("not is_head").select("token", "a", "b", "pack", *_ordered("", "h_")).join(linked, PAIR, "left").where("linked is null").select("token", "a", "b", "pack")
    away = scratch.keep(away, "away")
    rest = headed.where("not is_head").select("token", "a", "b", "pack")
    u = _reach(away, _bands(rest), percent).select("token", "own", "other", *(F.col(c).alias(f"u_{c}") for c in ("a", "b", "pack")))
    y = _reach(rest, _bands(away), percent).select("token", F.col("own").alias("other"), F.col("other").alias("own"), "a", "b", "pack")
    left = y.join(u, ["token", "own", "other"]).where("a != u_a or b != u_b").where(_may_link(percent, "", "u_"))
    left = left.select(*_ordered("", "u_"), F.expr(_room(percent, "", "u_")).alias("room"))
    left = scratch.keep(of_large(left).join(candidates, PAIR, "left_anti"), "left")
    scratch.drop("away", "hot", "times", "counted", "candidates", "wanted")
    texts = texts.join(left.select("a1", "b1").union(left.select("a2", "b2")).distinct().toDF("a", "b"), ["a", "b"], "left_semi")
    links = scratch.keep(links.select("x", "y").union(verify(left, texts, width, percent).select("x", "y")), "all_links")
    scratch.drop("texts", "left", "links")
    return rows, classes, links


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85, most_matches: int = 4, small: int = 64, frequent: int = 4096, cells_log2: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    scratch = Scratch(docs.sparkSession)
    rows, classes, links = jaccard_links(docs, width, percent, most_matches, small, frequent, cells_log2, scratch)
    labels = components(links, scratch)
    scratch.drop("all_links")
    labelled = classes.join(labels, "node", "left").select("a", "b", "doc_id", F.coalesce("label", "node").alias("label"))
    least_id = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = scratch.keep(labelled.join(least_id, "label").select("a", "b", "component_id"), "named")
    scratch.drop("labels", "classes")
    full = rows.where("n > 0").join(named, ["a", "b"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.union(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
