"""Language identification, the prefix trie and vector codes: against brute force, held-out rows and odd inputs."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from condenspark.llm import language_id, prefix_trie, queries, vector_codes

SMALL, MIDDLE, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"
BIG = 2**60 + 1


def brute_trie(rows, graft):
    """rows: conv_id, turn, role, text. By dictionaries over all prefixes."""
    said = {}
    for c, turn, role, text in rows:
        if c is not None:
            said.setdefault(c, []).append(((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest()), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v)] for c, v in said.items()}
    built = own
    if graft:
        every, most = graft
        built = {}
        for c, v in own.items():
            h = zlib.crc32(str(c).encode()) % most
            built[c] = own.get(c - int(math.fmod(c, every)), [])[:h] + v[h:]
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    out = []
    for node, found in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = sum(not any(m[:-1] == n and m for m in members) for n in below)
        saved = sum((len(members[n]) - 1) * (len(n[-1][1]) if n else 0) for n in below)
        ends = sorted(c for c in found if len(built[c]) == len(node))
        out.append((min(found), len(node), min(members[node[:-1]]) if node else None, len(found), len(children), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(rng, n=260):
    rows = []
    for c in [*range(n), 1000, 1001, 1003, BIG, BIG + 1]:  # 1000 has turns, 1100 to 1102 have no base
        begin = rng.choice(("hello", "hi", "", None, "hi there ☃"))
        for t in range(rng.choice((1, 2, 3, 4, 5, 6, 9))):
            rows.append((c, t, rng.choice(("user", "user", None)) if t else "user", begin if not t else rng.choice(("yes", "no", "yes", None, "é" * (c % 5)))))
    rows += [(c, 0, "user", f"only {c % 2}") for c in range(1101, 1140)]
    rows += [(7, None, "system", "first of all"), (7, None, "system", "first of all"), (8, 3, "user", "tie"), (8, 3, "user", "tie"), (8, 3, "bot", "tie"), (None, 1, "user", "nobody's"), (None, None, None, None)]
    rows += [(9, k, "user", "on and on") for k in range(100, 170)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("graft", "chunk"), [((100, 6), 512), (None, 3)])
def test_trie_equals_brute_force(spark, graft, chunk):
    rows = conversations(random.Random(4))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"node": F.lit(1), "part": F.lit("x"), "id": F.lit(None)})
    got = prefix_trie.prefix_trie(turns.repartition(5), graft, chunk)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_trie(rows, graft)


def test_trie_of_copies_and_of_nothing(spark, monkeypatch):
    """One conversation in many copies: its nodes are hot, its ends many. Without any node that is followed by broadcast, too."""
    rows = [(c, t, "user", f"turn {t}") for c in range(1500) for t in range(3)] + [(c, 0, "user", f"own {c}") for c in range(2000, 2600)]
    want = brute_trie([r for r in rows if r[0] < 1500], None)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for hot in (256, 1):
        monkeypatch.setattr(prefix_trie, "HOT", hot)
        got = {(r.conv_id, r.depth): tuple(r) for r in prefix_trie.prefix_trie(turns).collect()}
        assert len(got) == 604 and all(got[w[0], w[1]] == w for w in want if w[1]) and got[0, 0][3:7] == (2100, 601, 601, want[0][6])
    assert prefix_trie.prefix_trie(turns.limit(0), (100, 6)).count() == 0


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """rows: id, vector, label."""
    rows = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) and abs(x) < 131072 for x in v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    step = -(-max((len(v) for _, v, _ in rows), default=0) // parts)
    whole = [[math.floor(256 * x) for x in v] + [0] * (parts * step - len(v)) for _, v, _ in rows]
    cut = [[w[p * step : (p + 1) * step] for p in range(parts)] for w in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]  # noqa: E731, B023
    for _ in range(rounds):
        own = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                of = [c[p] for c, a in zip(cut, own, strict=True) if a[p] == e]
                if of:
                    books[p][e] = [sum(x) // len(of) for x in zip(*of, strict=True)]
    own = assign()
    error = [sum(far(c[p], books[p][a[p]]) for p in range(parts)) for c, a in zip(cut, own, strict=True)]
    total = {}
    for (_, _, lab), e in zip(rows, error, strict=True):
        total[lab] = total.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{x:02x}" for x in a), e, total[lab]) for (i, _, lab), a, e in zip(rows, own, error, strict=True)), key=repr), sha


@pytest.mark.parametrize(("n", "dims"), [(150, 32), (40, 20), (3, 5), (0, 8)])
def test_codes_equal_brute_force(spark, n, dims):
    rng = random.Random(n)
    rows = [(k, [rng.choice((-1, 1)) * rng.random() * rng.choice((1, 1, 40)) for _ in range(dims)], rng.choice((1, 2, None))) for k in range(n)]
    if n > 10:
        rows += [rows[5], rows[5], (5, rows[6][1], 1), (None, rows[7][1], 2), (BIG, rows[8][1][: dims // 2], None), (BIG + 1, [], 3), (901, None, 1), (902, [1.0, None], 1), (903, [math.nan] * dims, 1), (904, [math.inf] * dims, 1), (905, [1e300] * dims, 1), (906, [131071.9] + [0.0] * (dims - 1), 1)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"id": F.lit("clash"), "code": F.lit(1)})
    found = vector_codes.compress(table.repartition(4), block=16)
    want, sha = brute_codes(rows)
    assert sorted((tuple(r) for r in found.rows.select("id", "code", "error", "label_error").collect()), key=repr) == want and found.sha256() == sha
    if want:
        code = min((r for r in want if r[0] == 0), key=repr)
        near = found.decode(code[1])
        vector = next(v for i, v, _ in rows if i == 0)
        assert sum((math.floor(256 * x) - y) ** 2 for x, y in zip([*vector, *[0.0] * (len(near) - dims)], near.tolist(), strict=True)) == code[2]


def test_a_tree_of_tasks_adds_up_as_one(spark):
    table = spark.read.parquet(f"{MIDDLE}/embeddings.parquet")
    shas = {vector_codes.compress(table.repartition(n), block=b, depth=d).sha256() for n, b, d in ((1, 4096, 1), (40, 8, 2), (40, 8, 4))}
    assert len(shas) == 1


def test_languages_of_held_out_rows(spark):
    truth = spark.read.parquet(f"{LARGE}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    rows = queries.op11_language_id(spark, LARGE).join(truth, "doc_id").where("held_out and lang is not null").collect()
    right = [r.lang == r.lang_pred for r in rows]
    assert len(rows) > 1800 and np.mean(right) > 0.99 and all(0 <= r.score <= 1 for r in rows)
    for lang in ("en", "de", "fr", "es"):
        assert np.mean([r.lang_pred == lang for r in rows if r.lang == lang]) > 0.98
    sure, unsure = [r.score for r in rows if r.lang == r.lang_pred], [r.score for r in rows if r.lang != r.lang_pred]
    assert np.mean(sure) > 0.97 and np.mean(unsure) < np.mean(sure)


def test_language_counts_equal_a_plain_loop():
    def cells(text):
        out = np.zeros(language_id.DIM, int)
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        for w in words:
            code = [0, *map(ord, w), 0]
            for order in (1, 2, 3):
                for i in range(len(code) - order + 1):
                    part = code[i : i + order]
                    if (order == 1 and not part[0]) or (order == 3 and not part[1]):
                        continue
                    mixed = 0
                    for k, x in enumerate(part, 1):
                        mixed = (mixed + x + k) * 0x9E3779B97F4A7C15 % 2**64
                        mixed ^= mixed >> 29
                    out[(mixed >> 40) % language_id.DIM] += 1
        return out

    rng = random.Random(2)
    texts = ["", None, "a", "  ", "Straße, ÉTÉ!", "x1y2", "İ\U0001f600z", "né\n\né"] + ["".join(rng.choice("abÄß é1,\n\U00020000") for _ in range(rng.randrange(40))) for _ in range(200)]
    assert all((got == cells(t)).all() for got, t in zip(language_id.counts(texts), texts, strict=True))


def test_long_texts_are_read_whole(monkeypatch):
    text = "ein langer text und mehr davon " * 400
    whole = language_id.counts([text, "kurz", text])
    monkeypatch.setattr(language_id, "PART", 997)
    monkeypatch.setattr(language_id, "WORD", 50)
    assert (language_id.counts([text, "kurz", text]) == whole).all() and "".join(language_id.parts("y" * 5000)) == "y" * 5000


def test_odd_language_rows(spark):
    rows = [(i, ("the house of them and that " if i % 2 else "la maison est dans le jardin ") * 3, "en" if i % 2 else "fr") for i in range(60)]
    odd = [(900, None, "en"), (901, "", None), (902, "12 %% 3", "fr"), (None, "the house of that", "en"), (None, "the house of that", "en"), (903, "x", "xx"), (BIG, "dans le jardin", None)]
    table = spark.createDataFrame(rows + odd + rows[:2], "doc_id long, text string, lang string").withColumns({"score": F.lit("clash"), "rank": F.lit(1), "upto": F.lit(2), "cells": F.lit(None)})
    found = language_id.identify(table)
    got = found.collect()
    assert found.columns == ["doc_id", "text", "lang", "rank", "upto", "cells", "lang_pred", "score"] and len(got) == len(rows) + len(odd) + 2
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == lang for i, _, lang in rows) and [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by[BIG].lang_pred == "fr" and by[None].lang_pred == "en"
    assert language_id.identify(table.limit(0)).count() == 0
    nothing = language_id.identify(table.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    single = language_id.identify(table.where("lang = 'en' and text is not null")).collect()
    assert {(r.lang_pred, r.score) for r in single} == {("en", 1.0)}


def test_families_and_pairs(spark):
    assert language_id.family("pt-BR") == "romance" and language_id.family("xx") == "=xx" and language_id.family("DE") == "germanic"
    table = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    model = language_id.train(table)
    assert [(f, langs) for f, langs in model.families] == [("germanic", ["de", "en"]), ("romance", ["es", "fr"])] and len(model.of_family) == 2 and set(model.of_pair) == {(0, 0, 1), (1, 0, 1)}
    held = {r.lang: r.text for r in table.where(language_id.held_out()).where(F.length("text") > 300).collect()}
    names, score = model.predict(language_id.scaled(language_id.counts([held[k] for k in ("en", "de", "es", "fr")])))
    assert names == ["en", "de", "es", "fr"] and ((score > 0.5) & (score <= 1)).all()
