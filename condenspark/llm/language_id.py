"""Operator 11: language identification, family first.

A text is described by its words' characters: sequences of one to three letters, with the edges of words, hashed into DIM cells, as square roots of
counts at unit length. One linear support vector machine for each family (against the rest) names the family; within it one for each pair of
languages separates these, and the language with the greatest sum over its pairs wins. Margins become probabilities by a logistic fit, and the
score is the family's times the language's. Families are those of FAMILIES by the code before a hyphen; a code that isn't there is a family of
its own.

The model is fitted on a bounded sample of the labelled rows: about ``max_rows`` in all, the same number of each language, for the
``max_languages`` most frequent ones; of each text the whole and one short piece are learned, so short texts are no strangers. Every text is
read whole: longer ones in parts that end between words (a word of over 4,096 letters may count as several).

Null texts and texts without a letter are ``und`` with score 0; so are all if no language was learned. If one was, it is predicted with
score 1. Languages without a single letter in their sample are not learned. Repeated rows get equal results; every row gets one. Of documents only doc_id, text and lang
are read for learning, and only text for predicting; other columns stay, columns named lang_pred and score are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from condenspark.llm.common import bound_batches, give_back
from condenspark.llm.toxicity import fit_logistic

#: Language codes by family.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi", "romance": "ca es fr gl it la oc pt ro", "slavic": "be bg bs cs hr mk pl ru sk sl sr uk", "baltic": "lt lv", "celtic": "br cy ga gd",
    "indo-aryan": "as bn gu hi mr ne or pa sd si ur", "iranian": "fa ku ps tg", "uralic": "et fi hu", "turkic": "az kk ky tk tr tt ug uz", "semitic": "am ar he mt", "dravidian": "kn ml ta te", "austronesian": "id jv ms su tl",
}
DIM = 2048
PART, WORD = 1 << 20, 4096
PIECES = (24, 60, 150, 400)
NONE = "und"


def family(code: str) -> str:
    base = code.replace("_", "-").split("-")[0].lower()
    return next((name for name, codes in FAMILIES.items() if base in codes.split()), f"={code}")


@cache
def _letters() -> np.ndarray:
    """Is each code point a letter? A megabyte, for as long as the worker lives."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def parts(text: str) -> Iterator[str]:
    """The text in parts that end between words."""
    at = 0
    while len(text) - at > PART:
        end = at + PART
        cut = next((i for i in range(end, end - WORD, -1) if not text[i - 1].isalpha()), end)
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def counts(texts: list[str | None]) -> np.ndarray:
    """text x cell: how often each cell's sequences occur."""
    out = np.zeros((len(texts), DIM), np.float32)
    group, owners, size = [], [], 0

    def flush() -> None:
        nonlocal group, owners, size
        if group:
            np.add.at(out, owners, _counted(group))
        group, owners, size = [], [], 0

    for i, text in enumerate(texts):
        for part in parts(text or ""):
            if size + len(part) > PART or len(group) == 256:
                flush()
            group.append(part)
            owners.append(i)
            size += len(part)
    flush()
    return out


def _counted(texts: list[str]) -> np.ndarray:
    lower = [f" {t.lower()} " for t in texts]
    code = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), "<u4")
    own = np.repeat(np.arange(len(texts)), [len(t) for t in lower])
    code = np.where(_letters()[code], code, 0).astype(np.uint64)
    edge = code == 0
    keep = ~edge | np.r_[True, ~edge[:-1] | (own[1:] != own[:-1])]  # one edge between two words
    code, own, edge = code[keep], own[keep], edge[keep]
    total = np.zeros(len(texts) * DIM, np.int64)
    mixed = np.zeros(len(code), np.uint64)
    for order in range(1, 4):
        if len(code) < order:
            break
        mixed = (mixed[: len(code) - order + 1] + code[order - 1 :] + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        inner = edge[1:-1] if order == 3 else edge if order == 1 else None
        fits = own[: len(mixed)] == own[order - 1 :]
        if inner is not None:
            fits &= ~inner
        elif len(mixed):
            fits &= ~(edge[:-1] & edge[1:])
        cell = (mixed[fits] >> np.uint64(40)) % np.uint64(DIM)
        total += np.bincount(own[: len(mixed)][fits] * DIM + cell.astype(np.int64), minlength=len(total))
    return total.reshape(len(texts), DIM).astype(np.float32)


def scaled(x: np.ndarray) -> np.ndarray:
    root = np.sqrt(x)
    return root / np.maximum(np.sqrt(x.sum(axis=1, keepdims=True)), 1e-9)


def fit_svm(x: np.ndarray, y: np.ndarray, ridge: float = 2e-4, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and constant of the least squared hinge loss, both sides weighing the same. Newton's method with conjugate gradients. x: the last
    column is all ones."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    loss = lambda w: ridge / 2 * float(w @ w) + float(share @ np.maximum(0, 1 - y * (x @ w)) ** 2)
    best = loss(w)
    for _ in range(rounds):
        short = np.maximum(0, 1 - y * (x @ w))
        weight = np.where(short > 0, share, np.float32(0))  # rows without loss don't count, but aren't copied out
        slope = ridge * w - 2 * x.T @ (weight * y * short)
        step, left = np.zeros_like(w), -slope
        way, size = left.copy(), float(left @ left)
        start = size
        for _ in range(40):
            if size <= 1e-4 * start or size < 1e-14:
                break
            bent = ridge * way + 2 * x.T @ (weight * (x @ way))
            k = size / float(way @ bent)
            step += k * way
            left -= k * bent
            size, before = float(left @ left), size
            way = left + size / before * way
        rate = 1.0
        while rate > 1e-3 and loss(w + rate * step) > best:
            rate /= 2
        now = loss(w + rate * step)
        if best - now < 1e-6 * max(best, 1e-9):
            break
        w, best = w + rate * step, now
    return w[:-1], float(w[-1])


@dataclass(frozen=True)
class Machine:
    """A linear separator with the logistic curve of its margins."""

    weights: np.ndarray
    constant: float
    curve: tuple[float, float]

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray) -> Machine:
        w, b = fit_svm(x, y.astype(np.float32))
        c = fit_logistic((x[:, :-1] @ w + b)[:, None].astype(float), (y > 0).astype(float), ridge=1e-2)
        return Machine(w, b, (float(c[0]), float(c[1])))


@dataclass(frozen=True)
class Languages:
    """families: names and their languages; of_family: a machine each (none for a single one); of_pair: by family and pair of languages."""

    families: list[tuple[str, list[str]]]
    of_family: list[Machine]
    of_pair: dict[tuple[int, int, int], Machine]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        machines = [*self.of_family, *self.of_pair.values()]
        score = np.ones(len(x))
        if machines:
            margins = x @ np.column_stack([m.weights for m in machines]) + np.array([m.constant for m in machines])
            p = 1 / (1 + np.exp(-np.clip(np.array([m.curve[0] for m in machines]) + margins * np.array([m.curve[1] for m in machines]), -30, 30)))
        best = np.zeros(len(x), np.int64)
        if self.of_family:
            of = p[:, : len(self.of_family)]
            of = of / of.sum(axis=1, keepdims=True)
            best, score = of.argmax(axis=1), of.max(axis=1)
        names = np.empty(len(x), object)
        pair_at = {k: len(self.of_family) + i for i, k in enumerate(self.of_pair)}
        for f, (_, languages) in enumerate(self.families):
            rows, n = best == f, len(languages)
            if n == 1:
                names[rows] = languages[0]
                continue
            votes = np.zeros((int(rows.sum()), n))
            for i, j in combinations(range(n), 2):
                own = p[rows, pair_at[f, i, j]]
                votes[:, i] += own
                votes[:, j] += 1 - own
            names[rows] = np.array(languages, object)[votes.argmax(axis=1)]
            score[rows] *= votes.max(axis=1) * 2 / (n * (n - 1))
        return names.tolist(), score


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def piece(text: str, rank: int) -> str:
    """A short piece of the text, by the row's hash."""
    n = PIECES[rank % len(PIECES)]
    at = (rank >> 8) % max(1, len(text) - n)
    return text[at : at + n]


def train(docs: DataFrame, max_rows: int = 4000, max_languages: int = 100) -> Languages:
    """From text and lang of the rows that aren't held out."""
    usable = docs.where("lang is not null").where(~held_out())
    most = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    wanted = max_rows / max(1, len(most))
    share = docs.sparkSession.createDataFrame([(r["lang"], int((1 << 20) * min(1.0, wanted / r["n"]))) for r in most], "lang string, upto long")
    rank = F.xxhash64("doc_id", "text", F.lit(11))
    chosen = usable.select("lang", "text", rank.alias("rank")).join(F.broadcast(share), "lang").where(F.pmod("rank", F.lit(1 << 20)) < F.col("upto"))  # at most max_languages rows
    sample = chosen.groupBy("lang", "rank").agg(F.first("text").alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ranks = batch.column("text").to_pylist(), batch.column("rank").to_pylist()
            both = [t for text, rank in zip(texts, ranks, strict=True) for t in (text, piece(text or "", rank & (1 << 40) - 1))]
            cells = [row.tobytes() for row in scaled(counts(both)).reshape(len(texts), 2, DIM)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("rank"), pa.array(cells, pa.binary())], names=["lang", "rank", "cells"])
        give_back()

    rows = sample.mapInArrow(describe, "lang string, rank long, cells binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["rank"]), reverse=True)
    x, lang = np.ones((2 * len(rows), DIM + 1), np.float32), []
    while rows:  # one copy at a time
        row, at = rows.pop(), len(lang)
        own = np.frombuffer(row["cells"], np.float32).reshape(2, DIM)
        own = own[own.any(axis=1)]
        x[at : at + len(own), :-1] = own
        lang += [row["lang"]] * len(own)
    return fit(x[: len(lang)], np.array(lang, object))


def fit(x: np.ndarray, lang: np.ndarray) -> Languages:
    """x: scaled counts and a column of ones."""
    by_family: dict[str, list[str]] = {}
    for code in sorted(set(lang)):
        by_family.setdefault(family(code), []).append(code)
    families = sorted(by_family.items())
    side = lambda yes: np.where(yes, 1.0, -1.0)
    kin = np.array([family(code) for code in lang], object)
    of_family = [Machine.fit(x, side(kin == name)) for name, _ in families] if len(families) > 1 else []
    of_pair = {}
    for f, (_, languages) in enumerate(families):
        for i, j in combinations(range(len(languages)), 2):
            both = (lang == languages[i]) | (lang == languages[j])
            of_pair[f, i, j] = Machine.fit(x[both], side(lang[both] == languages[i]))
    return Languages(families, of_family, of_pair)


def identify(docs: DataFrame, model: Languages | None = None, **options) -> DataFrame:
    """docs with lang_pred and score. model: as from train(); else one is trained on docs."""
    bound_batches(docs.sparkSession)
    model = model or train(docs, **options)
    docs = docs.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = counts(part.column("text").to_pylist())
                some = x.any(axis=1) if model.families else np.zeros(len(x), bool)
                names, score = [NONE] * len(x), np.zeros(len(x))
                if some.any():
                    found, score[some] = model.predict(scaled(x[some]))
                    for i, name in zip(np.flatnonzero(some), found, strict=True):
                        names[i] = name
                yield part.append_column("lang_pred", pa.array(names, pa.string())).append_column("score", pa.array(np.clip(score, 0.0, 1.0)))
        give_back()

    kept = [StructField(f.name, f.dataType) for f in docs.schema.fields]
    return docs.mapInArrow(run, StructType([*kept, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
