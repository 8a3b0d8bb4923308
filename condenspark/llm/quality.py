"""Operator 5: a quality classifier from weak labels.

Heuristic labellers vote good (1), bad (-1) or abstain (0) on every document. Expectation-maximisation over the counts of all vote
patterns (at most 3 to the number of labellers, counted over all documents) estimates each labeller's accuracy on good and on bad documents and the share of
good ones. A pattern's posterior is its documents' label. A linear scorer over hashed words and byte trigrams learns the posteriors of a
sample of at most ``max_rows`` different texts (those of least hash), and scores every document.

Null and empty texts get the votes of an empty text. Every row gets a row, repeated rows alike; doc_id may be null and of any type. Only
the text is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condenspark.llm.common import bound_batches
from condenspark.llm.jaccard_join import shingles

_KIND = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 mark of a sentence, 7 other ASCII, 8 beyond ASCII
_KIND[33:127] = 7
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[9, 32]], _KIND[[10, 13]], _KIND[128:] = 1, 2, 3, 4, 5, 8
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 6
LABELLERS = ("symbols", "shouting", "repeated_words", "repeated_lines", "sentences", "word_length", "digits", "exclamation", "tables")


def votes(text: bytes | None) -> tuple[int, ...]:
    """One vote for each of LABELLERS."""
    raw = np.frombuffer(text or b"", np.uint8)
    if not len(raw):
        return (0, 0, 0, 0, -1, -1, 0, 0, 0)
    kind = np.bincount(_KIND[raw], minlength=9).astype(float)
    words = (text or b"").split()
    letters = kind[1] + kind[2] + kind[8]
    n = max(1, len(words))
    symbols, shout = kind[7] / n, kind[2] / max(1.0, kind[1] + kind[2])
    distinct = len(set(words)) / n
    twins = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    lines = [x for x in (text or b"").split(b"\n") if x.strip()]
    new_lines = len(set(lines)) / max(1, len(lines))
    ends = kind[6] / n
    mean = letters / n
    bangs, pipes = int((raw == 33).sum()) / n, int((raw == 124).sum()) / n
    vote = lambda good, bad: 1 if good else -1 if bad else 0
    return (
        vote(symbols < 0.02, symbols > 0.08),
        vote(shout < 0.1, shout > 0.2),
        vote(twins < 0.01, twins > 0.03 or (n > 100 and distinct < 0.25)),
        vote(len(lines) > 2 and new_lines > 0.95, len(lines) > 2 and new_lines < 0.8),
        vote(0.03 < ends < 0.4, ends < 0.01 or ends > 1),
        vote(3 < mean < 9, mean < 2 or mean > 14),
        vote(False, kind[3] > 0.2 * len(raw)),
        vote(False, bangs > 0.08),
        vote(False, pipes > 0.08),
    )


def code(v: tuple[int, ...]) -> int:
    return sum((x + 1) * 3**i for i, x in enumerate(v))


def decode(codes: np.ndarray, m: int) -> np.ndarray:
    return np.stack([codes // 3**i % 3 - 1 for i in range(m)], axis=1)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, prior: float = 0.8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """patterns: votes, a row each. Posterior of good for each pattern; P(vote good | voted, good) and P(vote bad | voted, bad).
    Labellers abstain at random. Smoothing keeps each labeller better than chance at the start, and the two classes in their place."""
    good, m = prior, patterns.shape[1]
    right_good, right_bad = np.full(m, 0.9), np.full(m, 0.7)
    up, down = patterns == 1, patterns == -1
    post = np.full(len(patterns), prior)
    for _ in range(rounds):
        lg = np.log(good) + up @ np.log(right_good) + down @ np.log(1 - right_good)
        lb = np.log(1 - good) + down @ np.log(right_bad) + up @ np.log(1 - right_bad)
        new = 1 / (1 + np.exp(np.clip(lb - lg, -500, 500)))
        wg, wb = counts * new, counts * (1 - new)
        good = float((wg.sum() + 8) / (counts.sum() + 10))
        right_good = np.clip((wg @ up + 9) / (wg @ (up | down) + 10), 0.5, 0.999)
        right_bad = np.clip((wb @ down + 7) / (wb @ (up | down) + 10), 0.05, 0.999)
        done, post = np.abs(new - post).max(initial=0) < 1e-9, new
        if done:
            break
    return post, right_good, right_bad


def hashed(text: bytes | None, bits: int) -> np.ndarray:
    """Distinct buckets of the text's words and byte trigrams."""
    raw = np.frombuffer(b" " + (text or b"") + b" ", np.uint8).astype(np.uint32)
    tri = np.unique((raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:])
    tri = (tri.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    return np.unique(np.concatenate([tri, shingles(text, 1) >> np.uint64(64 - bits)])).astype(np.int32)


def fit_linear(rows: list[np.ndarray], target: np.ndarray, bits: int, epochs: int = 6, rate: float = 0.5, seed: int = 3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by adaptive gradient steps; each row's features weigh 1 / sqrt(number)."""
    w, g, bias, g0 = np.zeros(1 << bits), np.full(1 << bits, 1e-6), 0.0, 1e-6
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x, scale = rows[i], 1 / np.sqrt(max(1, len(rows[i])))
            d = 1 / (1 + np.exp(-np.clip(w[x].sum() * scale + bias, -30, 30))) - target[i]
            g[x] += (d * scale) ** 2
            w[x] -= rate * d * scale / np.sqrt(g[x] + 1e-3)
            g0 += d * d
            bias -= rate * d / np.sqrt(g0)
    return w.astype(np.float32), float(bias)


def _bytes(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def vote_codes(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([code(votes(t)) for t in _bytes(batch)], pa.int32())], names=["code"])

    return docs.select("text").mapInArrow(run, "code int")


def label_model(docs: DataFrame) -> dict[int, float]:
    """Vote pattern -> posterior of good, from the patterns of all documents."""
    rows = vote_codes(docs).groupBy("code").count().orderBy("code").collect()  # at most 3 ** len(LABELLERS)
    if not rows:
        return {}
    codes = np.array([r["code"] for r in rows])
    post, _, _ = expectation_maximisation(decode(codes, len(LABELLERS)), np.array([r["count"] for r in rows], float))
    return dict(zip(codes.tolist(), post.tolist(), strict=True))


def classify_quality(docs: DataFrame, threshold: float = 0.5, max_rows: int = 6000, bits: int = 18) -> DataFrame:
    """doc_id, weak_label (the posterior of the votes), score (of the linear scorer, 0 to 1), keep (score >= threshold)."""
    bound_batches(docs.sparkSession)
    model = label_model(docs)
    n = docs.count()
    rank = F.xxhash64("text", F.lit(11))
    share = min(1.0, 2 * max_rows / max(1, n))  # texts are fewer than rows, and the least hashes are among these as a rule
    picked = docs.select("text", rank.alias("rank"))
    if share < 1 and picked.where(F.col("rank") <= int(-(2**63) + 2.0**64 * share)).select("rank").distinct().limit(max_rows).count() == max_rows:
        picked = picked.where(F.col("rank") <= int(-(2**63) + 2.0**64 * share))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _bytes(batch)
            yield pa.RecordBatch.from_arrays([batch.column("rank"), pa.array([hashed(t, bits).tobytes() for t in texts], pa.binary()), pa.array([code(votes(t)) for t in texts], pa.int32())], names=["rank", "x", "code"])

    different = picked.groupBy("rank").agg(F.first("text").alias("text")).select("text", "rank")
    rows = different.mapInArrow(features, "rank long, x binary, code int").orderBy("rank").limit(max_rows).collect()
    rows.sort(key=lambda r: (r["code"], bytes(r["x"])))
    weights, bias = fit_linear([np.frombuffer(r["x"], np.int32) for r in rows], np.array([model.get(r["code"], 0.5) for r in rows]), bits)
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias, model))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, known = shared.value
        for batch in batches:
            out, weak = [], []
            for t in _bytes(batch):
                x = hashed(t, bits)
                z = float(w[x].sum()) / np.sqrt(max(1, len(x))) + b
                out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
                weak.append(known.get(code(votes(t)), 0.5))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(weak, pa.float64()), pa.array(out, pa.float64())], names=["doc_id", "weak_label", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, weak_label double, score double").withColumn("keep", F.col("score") >= threshold)
