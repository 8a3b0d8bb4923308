"""Operator 4: benchmark decontamination by one Aho-Corasick automaton.

A window is ``window`` consecutive words of a benchmark item (a shorter item is one window). A document word inside any occurrence of a
window is hit. Items are cut into blocks of half a window; whatever 13 consecutive words of an item occur, one of its blocks occurs whole.
The blocks are the patterns of one automaton, so it grows with the text of the benchmark and not with its windows. A document is
normalised and scanned once; each block that is found is extended word by word along its item, and a stretch as long as a window is a hit.
In an item that repeats itself (a block occurs more than OFTEN times) the windows around a found block are looked up among the item's
windows instead, so that a text of one phrase over and over costs no more than any other.
Word numbers are mapped back to character offsets of the original.

Words are runs of digits, letters and non-ASCII characters; A-Z count as a-z. Null text and text of separators have no words and
are not contaminated. Items without words have no windows; items with equal windows are all reported. The windows of an item without an
id count as hits, but it can't be named. Repeated rows each get a row. Other columns stay, of whatever name; ``contamination`` is replaced.

Tasks get the benchmark's text, and each builds the automaton once. Its size has a bound, ``max_bytes`` of benchmark text for one
automaton; a larger benchmark is dealt into parts of items, each part has a scan of its own over all documents, and their spans are
merged: one automaton in a task at any time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from condenspark.llm.common import ALNUM, bound_batches, give_back, materialise, unused

OFTEN = 4
_SPAN = StructType([StructField(k, LongType()) for k in ("first", "last", "begin", "end")])
FOUND = StructType([StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("spans", ArrayType(_SPAN)), StructField("items", ArrayType(StringType())), StructField("contaminated", BooleanType())])
ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([(k, pa.int64()) for k in ("first", "last", "begin", "end")]))), ("items", pa.list_(pa.string())), ("contaminated", pa.bool_())])


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(ALNUM).split()


class Matcher:
    """The automaton of a benchmark's blocks, and where its items have them."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], window: int):
        import ahocorasick

        self.window, self.half, self.automaton = window, (window + 1) // 2, ahocorasick.Automaton()
        self.items: list[tuple[str | None, list[bytes]]] = []
        self.windows: dict[bytes, list[str | None]] = {}  # of items that repeat themselves
        at: dict[str, list[tuple[int, int]]] = {}
        for name, text in items:
            words = normal_words(text)
            n = self.half if len(words) >= window else len(words)
            own: dict[str, list[int]] = {}
            for p in range(0, len(words) - n + 1 if n else 0, max(1, n)):
                own.setdefault(f" {b' '.join(words[p : p + n]).decode('latin-1')} ", []).append(p)  # a byte is a character
            repeats = max(map(len, own.values()), default=0) > OFTEN
            for block, places in own.items():
                at.setdefault(block, []).extend([(-1, 0)] if repeats else [(len(self.items), p) for p in places])
            for w in {b" ".join(words[i : i + window]) for i in range(len(words) - window + 1)} if repeats else ():
                self.windows.setdefault(w, []).append(name)
            self.items.append((name, words))
        for block, places in at.items():
            self.automaton.add_word(block, (block.count(" ") - 1, places))
        if len(self.automaton):
            self.automaton.make_automaton()

    def runs(self, words: list[bytes]) -> tuple[list[list[int]], list[str]]:
        """Stretches of hit words (first, last), and the items that have windows there."""
        if not words or not len(self.automaton):
            return [], []
        hay = b" " + b" ".join(words) + b" "
        hits = list(self.automaton.iter(hay.decode("latin-1")))
        if not hits:
            return [], []
        ends = np.searchsorted(np.flatnonzero(np.frombuffer(hay, np.uint8) == 32), [e for e, _ in hits]) - 1
        found, items, reached, upto = [], set(), {}, -1
        for last, (_, (n, places)) in zip(ends.tolist(), hits, strict=True):
            first = last - n + 1
            for item, p in places:
                if item < 0:
                    for b in range(max(0, upto + 1, last - self.window + 1), min(first, len(words) - self.window) + 1):
                        upto = b
                        if own := self.windows.get(b" ".join(words[b : b + self.window])):
                            found.append((b, b + self.window - 1))
                            items.update(name for name in own if name is not None)
                    continue
                name, own = self.items[item]
                line = item, first - p  # where the item's first word would be: its stretches there are disjoint
                if reached.get(line, -1) >= last:
                    continue
                b, e = first, last
                while b > 0 and p > first - b and words[b - 1] == own[p - (first - b) - 1]:
                    b -= 1
                while e + 1 < len(words) and p + e + 1 - first < len(own) and words[e + 1] == own[p + e + 1 - first]:
                    e += 1
                reached[line] = e
                if e - b + 1 >= min(self.window, len(own)):
                    found.append((b, e))
                    if name is not None:
                        items.add(name)
        merged: list[list[int]] = []
        for b, e in sorted(found):
            if merged and b <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([b, e])
        return merged, sorted(items)

    def scan(self, text: str | None, share: int) -> dict:
        raw = (text or "").encode("utf-8", "surrogatepass").translate(ALNUM)
        words = raw.split()
        merged, items = self.runs(words)
        spans = []
        if merged:
            used = np.frombuffer(b" " + raw + b" ", np.uint8) != 32
            starts, ends = np.flatnonzero(used[1:] & ~used[:-1]), np.flatnonzero(used[:-1] & ~used[1:])
            original = text.encode("utf-8", "surrogatepass")
            at = lambda b: len(original[:b].decode("utf-8", "surrogatepass"))
            spans = [{"first": a, "last": b, "begin": at(int(starts[a])), "end": at(int(ends[b]))} for a, b in merged]
        n_hit = sum(b - a + 1 for a, b in merged)
        return {"n_words": len(words), "n_hit": n_hit, "spans": spans, "items": items, "contaminated": n_hit > 0 and n_hit * share >= len(words)}


def parts(benchmark: DataFrame, max_bytes: int) -> Iterable[list[tuple[str | None, str | None]]]:
    """The benchmark's items, dealt out so that a part of them holds about max_bytes of text; one part is here at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where(F.octet_length("text") > 0).distinct()
    n = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // max_bytes) or 1
    for k in range(n):
        yield sorted(((r["item"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()), key=str)


def _scan(docs: DataFrame, items: list, window: int, share: int, text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)  # at most about max_bytes of text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, window)
        for batch in batches:
            yield batch.append_column("contamination", pa.array([matcher.scan(t, share) for t in batch.column(text).to_pylist()], ARROW))
        del matcher
        give_back()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("contamination", FOUND)]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, max_bytes: int = 4 << 20, text: str = "text") -> DataFrame:
    """docs with a column ``contamination``: n_words, n_hit, spans (words first..last, characters begin..end), items, contaminated.
    A document is contaminated if it has a hit word and hit words are at least one in ``share``."""
    bound_batches(docs.sparkSession)
    docs = docs.drop("contamination")
    found = parts(benchmark, max_bytes)
    first, second = next(found := iter(found)), next(found, None)
    if second is None:
        return _scan(docs, first, window, share, text)
    row = unused(docs, "__row")
    keyed = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    short = keyed.select(F.col(row).alias("__row"), F.col(text).alias("text"))
    hits = None
    for items in (first, second, *found):
        own = _scan(short, items, window, share, "text").where("contamination.n_words > 0" if hits is None else "contamination.n_hit > 0")
        own = materialise(own.select("__row", "contamination.n_words", "contamination.spans", "contamination.items"), "part")
        hits = own if hits is None else hits.union(own)
    merged = hits.groupBy("__row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    start = "cast(array() as array<struct<first:long,last:long,begin:long,end:long>>)"
    joined = "named_struct('first', element_at(a, -1).first, 'last', greatest(element_at(a, -1).last, s.last), 'begin', element_at(a, -1).begin, 'end', greatest(element_at(a, -1).end, s.end))"
    spans = F.expr(f"aggregate(all, {start}, (a, s) -> if(size(a) > 0 and s.first <= element_at(a, -1).last + 1, concat(slice(a, 1, size(a) - 1), array({joined})), concat(a, array(s))))")
    merged = merged.withColumn("spans", spans).withColumn("n_hit", F.expr("aggregate(spans, 0L, (k, s) -> k + s.last - s.first + 1)"))
    merged = merged.select("__row", F.struct("n_words", "n_hit", "spans", "items", F.expr(f"n_hit > 0 and n_hit * {share} >= n_words").alias("contaminated")).alias("contamination"))
    none = F.struct(F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.expr(start).alias("spans"), F.expr("cast(array() as array<string>)").alias("items"), F.lit(False).alias("contaminated"))
    return keyed.join(merged.withColumnRenamed("__row", row), row, "left").withColumn("contamination", F.coalesce("contamination", none)).drop(row)
