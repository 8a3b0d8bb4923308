"""Operator 2: toxicity by a fuzzy lexicon and the context of its matches.

The lexicon is a fixed seed list and terms learned from labelled rows: words, and stems with any ending. Its trie is intersected with the
Levenshtein automata of the allowed edits (one for whole words of ``5`` letters, two from ``8``); the product is made deterministic
lazily, state by state, so most words end in the dead state after a few letters. Each match is scored in a window of words: inside
quotation marks or after a word of reporting it counts less, beside direct address more. A logistic model over the summed context
scores gives the document's score.

The model learns from about ``max_rows`` labelled documents at most, chosen by hash of doc_id; words of two letters or more can become
terms, and stems of four to seven, however many or long. What a task works out about words is kept within a bound and forgotten after it. Without labelled rows of both kinds, the seed list and default weights are
used. Null and empty texts have no match and get the score of such texts. Every row gets a row; repeated rows alike. Only the text is read; a column
named toxicity or toxic is replaced.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from condenspark.llm.common import bound_batches, give_back

#: Seed terms, words of reporting, and words of direct address.
SEED_TERMS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
REPORTING = frozenset("said says wrote quoted quote quotes reported called term word dit sagte dijo".split())
ADDRESS = frozenset("you your youre u du dich tu toi vous usted are is".split())
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
DEFAULT = (-3.5, 3.0, 2.0, -1.0, 1.5)

WORD = re.compile(r"[\w@$]+")
QUOTE = re.compile("[\"“”«»]")
WINDOW = 6


def edits_of(term: str, stem: bool) -> int:
    return 0 if stem or len(term) < 5 else 1 if len(term) < 8 else 2


class FuzzyTrie:
    """Words within the allowed edits of a term, or that begin with a stem. A state is a set of (trie node, edits used), packed as numbers
    4 * node + edits. At most about ``most`` steps between states are remembered at a time, in some 40 MB."""

    def __init__(self, terms: Iterable[tuple[str, bool]], most: int = 250_000):
        self.next: list[dict[str, int]] = [{}]
        self.end: list[tuple[str, int] | None] = [None]
        self.stem: list[str | None] = [None]
        self.most = [0]
        for term, stem in terms:
            at, k = 0, edits_of(term, stem)
            self.most[0] = max(self.most[0], k)
            for c in term:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.end.append(None)
                    self.stem.append(None)
                    self.most.append(0)
                at = self.next[at][c]
                self.most[at] = max(self.most[at], k)
            if stem:
                self.stem[at] = term
            else:
                self.end[at] = (term, k)
        self.limit = most
        self.forget()

    def forget(self) -> None:
        self.ids: dict[bytes, int] = {b"": 0}
        self.states: list[bytes] = [b""]
        self.step: list[dict[str, int]] = [{}]
        self.found: list[tuple[str, int] | None] = [None]
        self.steps = 0
        self.start = self._id(self._close({(0, 0)}))

    def _close(self, state: set[tuple[int, int]]) -> bytes:
        """With letters of a term left out."""
        todo = list(state)
        while todo:
            node, e = todo.pop()
            for child in self.next[node].values():
                if e < self.most[child] and (child, e + 1) not in state:
                    state.add((child, e + 1))
                    todo.append((child, e + 1))
        best: dict[int, int] = {}
        for node, e in state:
            best[node] = min(e, best.get(node, e))
        return array("I", sorted(4 * node + e for node, e in best.items())).tobytes()

    def _of(self, state: bytes) -> list[tuple[int, int]]:
        return [(x >> 2, x & 3) for x in memoryview(state).cast("I")]

    def _id(self, state: bytes) -> int:
        if state not in self.ids:
            self.ids[state] = len(self.states)
            self.states.append(state)
            self.step.append({})
            ends = [(e, self.end[n][0]) for n, e in self._of(state) if self.end[n] and e <= self.end[n][1]]
            self.found.append(min(ends)[::-1] if ends else None)
        return self.ids[state]

    def _move(self, at: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, e in self._of(self.states[at]):
            if e < self.most[node]:
                out.add((node, e + 1))
            for letter, child in self.next[node].items():
                if letter == c or letter == LEET.get(c):
                    out.add((child, e))
                elif e < self.most[child]:
                    out.add((child, e + 1))
        self.steps += 1
        return self._id(self._close(out))

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term and the edits to it."""
        if self.steps > self.limit:
            self.forget()
        at, steps = self.start, self.step
        for c in word:
            nxt = steps[at].get(c)
            if nxt is None:
                nxt = steps[at][c] = self._move(at, c)
            if not nxt:
                break
            at = nxt
        else:
            if self.found[at]:
                return self.found[at]
        node = 0
        for c in word:  # stems match without edits
            node = self.next[node].get(c, -1)
            if node < 0:
                return None
            if self.stem[node]:
                return self.stem[node], 0
        return None


def features(text: str | None, trie: FuzzyTrie) -> tuple[float, float, float, float]:
    """Context scores summed over exact and over misspelled matches, quoted matches, and the number of different terms; as logarithms."""
    lower = (text or "").lower()
    hits = {w: m for w in set(WORD.findall(lower)) if (m := trie.match(w))}
    if not hits:
        return 0.0, 0.0, 0.0, 0.0
    spans = [(m.start(), m.group()) for m in WORD.finditer(lower)]
    exact = fuzzy = quoted = 0.0
    marks = [m.start() for m in QUOTE.finditer(lower)]
    lines = [-1, *(i for i, c in enumerate(lower) if c == "\n")] if marks else []
    for i, (at, w) in enumerate(spans):
        if w not in hits:
            continue
        near = {x for _, x in spans[max(0, i - WINDOW) : i + WINDOW + 1]}
        inside = False
        if marks:
            row, before = bisect_left(lines, at), bisect_left(marks, at)
            inside = (before - bisect_left(marks, lines[row - 1])) % 2 == 1 and before < len(marks) and (row == len(lines) or marks[before] < lines[row])
        report = bool(REPORTING & {x for _, x in spans[max(0, i - WINDOW) : i]})
        score = (0.3 if inside else 1.0) * (0.6 if report else 1.0) * (1.25 if ADDRESS & near else 1.0)
        quoted += inside or report
        if hits[w][1]:
            fuzzy += score
        else:
            exact += score
    return math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), math.log1p(len({t for t, _ in hits.values()}))


def terms_of(text: str | None) -> set[tuple[str, bool]]:
    words = {w for w in WORD.findall((text or "").lower()) if not w.isdigit() and len(w) >= 2}
    return {(w, False) for w in words} | {(w[:k], True) for w in words for k in range(4, min(8, len(w)))}


def learn_lexicon(sample: DataFrame, min_docs: int, min_gain: float) -> list[tuple[str, bool]]:
    """sample: text, toxic. Terms far more frequent in toxic rows; of terms that cover each other, the one that tells most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                (toxic if label else clean).update(terms_of(text))
        every = sorted(toxic.keys() | clean.keys())  # also terms of clean rows only: they may be toxic in other tasks
        for at in range(0, len(every), 10_000):
            part = every[at : at + 10_000]
            columns = ([t for t, _ in part], pa.string()), ([s for _, s in part], pa.bool_()), ([toxic[k] for k in part], pa.int64()), ([clean[k] for k in part], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in columns], names=["term", "stem", "t", "c"])

    totals = sample.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    n_toxic, n_clean = int(totals["t"] or 0), int(totals["n"]) - int(totals["t"] or 0)
    if not n_toxic or not n_clean:
        return []
    counted = sample.select("text", "toxic").mapInArrow(count, "term string, stem boolean, t long, c long").groupBy("term", "stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    share = n_toxic / (n_toxic + n_clean)
    gain = 2 * (F.col("t") * F.log(F.col("t") / ((F.col("t") + F.col("c")) * share)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / ((F.col("t") + F.col("c")) * (1 - share)))).otherwise(0.0))
    rows = counted.where(f"t >= {min_docs} and t >= 0.6 * (t + c)").withColumn("gain", gain).where(F.col("gain") >= min_gain).collect()
    weight = lambda r: r["gain"] * (1 if r["stem"] else 1.06)  # noqa: E731  a whole word goes before a stem that tells no more
    out: list[tuple[str, bool]] = []
    stems, begun = set(), set()  # the stems in out, and how its terms begin
    for r in sorted(rows, key=lambda r: (-weight(r), r["stem"], -len(r["term"]), r["term"])):
        term = r["term"]
        begins = {term[:k] for k in range(4, len(term) + 1)}
        if not (begins & stems or (r["stem"] and term in begun)):
            out.append((term, r["stem"]))
            begun |= begins
            if r["stem"]:
                stems.add(term)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 30) -> np.ndarray:
    """Newton's method; the first weight is the constant."""
    x1 = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x1.shape[1])
    penalty = np.diag([1e-3] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve(x1.T @ (x1 * (p * (1 - p) + 1e-9)[:, None]) + penalty, x1.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


_tries: dict[tuple, FuzzyTrie] = {}


def _trie(terms: tuple) -> FuzzyTrie:
    """Kept by a worker from task to task while a model is learned; the tasks that score with it forget it."""
    if terms not in _tries:
        _tries.clear()
        _tries[terms] = FuzzyTrie(terms)
    return _tries[terms]


class Scorer:
    """Adds a column of scores to documents, a few hundred texts at a time."""

    def __init__(self, terms: tuple, weights: tuple):
        self.terms, self.weights = terms, weights

    def __call__(self, docs: DataFrame, text: str, name: str) -> DataFrame:
        terms, weights = self.terms, self.weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie, w = _trie(terms), np.asarray(weights)
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    x = np.array([features(t, trie) for t in part.column(text).to_pylist()])
                    yield part.append_column(name, pa.array(1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))))
            _tries.clear()
            del trie
            give_back()

        return docs.mapInArrow(run, StructType([*(StructField(f.name, f.dataType) for f in docs.schema.fields), StructField(name, DoubleType())]))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, min_docs: int = 3, min_gain: float = 16.0):
    """A scorer of texts, learned from labelled documents that aren't held out: about max_rows of them at most."""
    usable = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    n = usable.count()
    rank = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20))
    chosen = usable.where(rank < int((1 << 20) * min(1.0, max_rows / max(1, n))))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # a row count bounded by max_rows
    sample = sample.repartition(48, "doc_id", F.crc32(F.col("text").cast("binary"))).select("text", "toxic")
    learned = learn_lexicon(sample, min_docs, min_gain)
    terms = tuple(learned + [(t, False) for t in SEED_TERMS if (t, False) not in learned])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(terms)
        for batch in batches:
            x = [list(features(t, trie)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = sample.mapInArrow(describe, "toxic int, x array<double>").collect()
    rows.sort(key=lambda r: (r["toxic"], *r["x"]))
    y = np.array([r["toxic"] for r in rows], float)
    weights = fit_logistic(np.array([r["x"] for r in rows]), y) if 0 < y.sum() < len(y) else np.array(DEFAULT)
    return Scorer(terms, tuple(float(v) for v in weights))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """docs with toxicity (0 to 1) and toxic (toxicity >= threshold)."""
    bound_batches(docs.sparkSession)
    scored = train(docs, labels, **options)(docs.drop("toxicity"), "text", "toxicity")
    return scored.withColumn("toxic", F.col("toxicity") >= threshold)
