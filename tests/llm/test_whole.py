"""Whole queries and stages against brute-force versions, held-out labels and planted cases; ids, repeated rows and sizes at their edges."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from condenspark.llm import chat_format, decontamination, jaccard_join, license_scan, packing, quality, queries, secret_scan, sharding, topk_search, toxicity
from tests.llm.test_operators import brute_components, docs

SMALL, MIDDLE, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"
BIG = 2**60 + 1


def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_those_of_the_tokenizer():
    rng, cache = random.Random(5), packing.ChunkCache(path(), 1 << 20)
    assert cache.splits and cache.parts
    pools = [range(33, 127), range(0x20, 0x250), range(0x180, 0x250), range(0x370, 0x500), range(0x4E00, 0x4E80), range(0x1F600, 0x1F640), [9, 10, 11, 13, 32, 0x85, 0xA0, 0x2003], range(0x300, 0x370), [0x130, 0x131, 0x1E9E, 0xDF, 0x212A], list(map(ord, "'stremvlld|<>"))]
    texts = ["Ɗan'UWA ƁERA! Ɔ! ƐBI-1", "<|endoftext|> a<|b", "", None]
    texts += ["".join(chr(rng.choice(rng.choice(pools[:3] if k % 2 else pools))) for _ in range(rng.randrange(1, 24))) for k in range(10_000)]
    ids, ends = cache.encode(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == cache.tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_best_fit_equals_a_naive_search():
    rng = random.Random(3)
    for _ in range(60):
        lengths, free = [rng.randrange(1, 65) for _ in range(rng.randrange(1, 90))], []
        for n in sorted(lengths, reverse=True):
            fits = [f for f in free if f >= n]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - n)
            else:
                free.append(64 - n)
        where, offset, windows = packing.best_fit_decreasing(lengths, 64)
        used = Counter()
        for w, o, n in sorted(zip(where, offset, lengths, strict=True), key=lambda x: x[:2]):
            assert o == used[w]
            used[w] += n
        assert windows == len(free) and sorted(64 - u for u in used.values()) == sorted(free)


def test_large_ids_stay_exact_beside_null_ones(spark):
    text = 'token = "cf1d64a9a4cd9723e1f4eafc27395915e6868ffa" Released under the MIT License.'
    rows = spark.createDataFrame([(BIG, text, "s"), (None, text, "s"), (BIG + 2, text, None)], "doc_id long, text string, source string")
    want = {BIG, None, BIG + 2}
    for found in (license_scan.scan_licenses(rows), secret_scan.scan_secrets(rows), packing.pack(rows, path()), quality.classify_quality(rows), decontamination.decontaminate(rows, rows.selectExpr("'x' item_id", "text"))):
        assert {r.doc_id for r in found.select("doc_id").collect()} == want


def test_packing_groups_are_bounded_by_bytes(spark):
    rows = spark.createDataFrame([(None, "word " * 4000)] * 40, "doc_id long, text string")
    got = packing.pack(rows, path(), window=256, group_bytes=20_000).collect()
    assert len({r.sequence_id >> 32 for r in got}) > 20 and sum(r.length for r in got) == 40 * got[0].doc_tokens


def test_shards_hold_every_source_in_its_share(spark):
    rows = spark.createDataFrame([(i if i % 7 else None, f"t{i}", "big" if i % 3 else f"s{i % 5}") for i in range(900)], "doc_id long, text string, source string")
    got = Counter((r.shard, r.stratum) for r in sharding.interleave(rows).collect())
    for s in {k[1] for k in got}:
        counts = [got[k, s] for k in range(8)]
        assert max(counts) - min(counts) <= 2, s


def test_join_of_rows_that_share_a_passage(spark):
    """Rows with a common passage and too little else in common: no links, and no pairs of all rows."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(9))
    common = " ".join(word() for _ in range(60))
    texts = [(i, common + " " + " ".join(word() for _ in range(6))) for i in range(10_000)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string"))
    assert got.where("component_id <> doc_id").count() == 0 and got.count() == 10_000


@pytest.mark.parametrize("frequent", [1, 3])
def test_join_by_the_way_of_frequent_shingles(spark, frequent):
    rng = random.Random(9)
    word = lambda: "w%d" % rng.randrange(3000)
    texts, passage = ["", None], [word() for _ in range(60)]
    for _ in range(3):
        base = [word() for _ in range(90)]
        for k in range(14):
            texts.append(" ".join(base[: 90 - k] + [word() for _ in range(k // 2)]))
    texts += [" ".join(passage + [word() for _ in range(rng.choice([3, 8, 12]))]) for _ in range(25)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs(spark, texts), small=3, frequent=frequent, cells_log2=18).collect()}
    assert got == brute_components(texts)


def naive_contamination(text, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    own, hit, found, places = words(text), set(), set(), {}
    for name, item in items:
        w = words(item)
        n = min(window, len(w))
        if n and n not in places:
            places[n] = {}
            for j in range(len(own) - n + 1):
                places[n].setdefault(tuple(own[j : j + n]), []).append(j)
        for i in range(len(w) - n + 1 if n else 0):
            for j in places[n].get(tuple(w[i : i + n]), []):
                hit |= set(range(j, j + n))
                found |= {name} - {None}
    return len(own), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(own)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(4)
    pool = ["a", "b", "ab", "É", "7", "Long"]
    items = [(f"i{k}" if k % 6 else None, "-".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 4, 12, 13, 14, 20, 40])))) for k in range(30)]
    texts = []
    for _ in range(60):
        t = []
        for _ in range(rng.randrange(6)):
            _, item = rng.choice(items)
            w = item.split("-")
            a = rng.randrange(len(w))
            t += w[a : a + rng.randrange(1, 30)] + [rng.choice(pool) for _ in range(rng.randrange(3))]
        texts.append(" ".join(t))
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = {i: naive_contamination(t, items) for i, t in enumerate(texts)}
    for size in (4 << 20, 300):
        got = {r.doc_id: r.contamination for r in decontamination.decontaminate(docs(spark, texts).withColumn("contamination", F.lit(1)), bench, max_bytes=size).collect()}
        assert {i: (c.n_words, c.n_hit, c["items"], c.contaminated) for i, c in got.items()} == want
        assert all(sum(s.last - s.first + 1 for s in c.spans) == c.n_hit for c in got.values())


def test_every_row_of_repeated_vectors_counts(spark):
    rows = spark.createDataFrame([(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.5, 0.0]), (7, [0.25, 0.0]), (7, [0.25, 0.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk_search.top_k(rows, k=2, block=2, range_rows=2).collect())
    assert got == sorted([(50, 1, 50, 65536), (50, 2, 50, 32768)] * 2 + [(50, 1, 50, 32768), (50, 2, 50, 32768)])
    wide = spark.createDataFrame([(i, [float(x) for x in np.random.default_rng(i).normal(size=700) * 10.0 ** (i % 5)]) for i in range(60)], "vec_id long, embedding array<double>")
    q = {r.vec_id: np.floor(256 * np.array(r.embedding)).astype(object) for r in wide.collect()}
    want = {(0, k, j, int(-s)) for k, (s, j) in enumerate(sorted((-(q[0] @ v), j) for j, v in q.items() if j)[:5], 1)}
    assert {tuple(r) for r in topk_search.top_k(wide, block=8, range_rows=16).where("query_id = 0").collect()} == want


def test_chats_equal_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for c in range(60):
        said = [(t, rng.choice(["user", None]), rng.choice(["a", "b", None, ""])) for t in range(rng.randrange(1, 4))]
        rows += [(None if c == 3 else c, *s) for s in said + said[: c % 11 == 0]]
    rows += [(90, None, "user", "long " * 50_000), (90, 5, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"place": F.lit(1), "n_turns": F.lit(2), "digest": F.lit("x"), "bucket": F.lit(0)})
    whole = {}
    for c, t, role, text in rows:
        whole.setdefault(c, []).append((t, role, text))
    import hashlib

    key = lambda s: (s[0] is not None, s[0] or 0, s[1] is not None, s[1] or "", s[2] is not None, hashlib.md5((s[2] or "").encode()).hexdigest())
    said = {c: tuple((r or "", x or "") for _, r, x in sorted(v, key=key)) for c, v in whole.items()}
    prefixes = {v[:k] for v in said.values() for k in range(1, len(v))}
    want = Counter(v for v in said.values() if v not in prefixes)
    got = {}
    for r in chat_format.format_chats(turns, bucket=2, part_turns=2).orderBy("part").collect():
        got[r.conv_id] = (got.get(r.conv_id, ("", 0))[0] + r.text, r.n_copies)
    assert sorted(got.values()) == sorted(("".join(f"<|{r}|>\n{x}\n<|end|>\n" for r, x in v), n) for v, n in want.items())


def test_toxicity_on_held_out_labels(spark):
    rows = queries.op2_toxicity(spark, LARGE).join(spark.read.parquet(f"{LARGE}/labels.parquet"), "doc_id").where("held_out and toxic is not null").select("predicted", "toxic").collect()
    caught, clean = [r.predicted for r in rows if r.toxic], [1 - r.predicted for r in rows if not r.toxic]
    assert len(caught) >= 5 and np.mean(caught) >= 0.9 and np.mean(clean) >= 0.95
    text = "He said \"" + "calm words " * 40 + "idiot\". You idiot\n" + "x" * 60
    trie = toxicity.FuzzyTrie([("idiot", False)], most=3)
    assert toxicity.features(text, trie)[2] == pytest.approx(np.log1p(1)) and trie.match("x" * 200) is None and trie.match("idit") is not None and trie.match("idoit") is None  # five letters allow one edit, and a swap is two
    assert ("y" * 60, False) in toxicity.terms_of("y" * 60)


def test_quality_on_labels(spark):
    rows = queries.op5_quality(spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").where("quality is not null").select("score", "quality").collect()
    good, bad = np.array([r.score for r in rows if r.quality]), np.array([r.score for r in rows if not r.quality])
    assert len(bad) >= 5 and (good[:, None] > bad[None, :]).mean() > 0.95
    same = spark.createDataFrame([(i, "one text of many rows" if i % 3 else f"text number {i}.") for i in range(300)], "doc_id long, text string")
    assert quality.classify_quality(same, max_rows=20).count() == 300


def test_planted_secrets_are_found(spark):
    table = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    planted = re.compile(r"AKIA[A-Z2-7]{16}|(?<=token = \")[0-9a-f]{40}")
    want = {(r.doc_id, *m.span()) for r in table.select("doc_id", "text").collect() for m in planted.finditer(r.text or "")}
    got = {(r.doc_id, r.begin, r.end) for r in secret_scan.scan_secrets(table).where("secret").collect()}
    caught = sum(any(d == e and b <= x and y <= z for e, b, z in got) for d, x, y in want)
    assert len(want) >= 5 and caught >= 0.95 * len(want)


def test_pipeline_equals_its_stages_by_brute_force(spark):
    import corpus_pipeline as p

    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    toxic = {r.doc_id for r in toxicity.score_toxicity(table, spark.read.parquet(f"{SMALL}/labels.parquet")).where("toxic").collect()}
    rows = sorted((r for r in table.collect() if r.doc_id not in toxic), key=lambda r: r.doc_id)
    kept = [r for i, (r, least) in enumerate(zip(rows, brute_near(rows), strict=True)) if least == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = [r for r in kept if not naive_contamination(r.text, items)[3]]
    forest, encoder = secret_scan.train(), packing.ChunkCache(path(), 1 << 20).tokenizer
    want = {}
    for r in kept:
        text, spans = r.text or "", [(b, e) for (b, e, s) in secret_scan._scored([r.text], [r.source], forest)[0] if s >= 0.5]
        inside = [any(b <= k < e for b, e in spans) for k in range(len(text))]
        out, k = [], 0
        while k < len(text):
            if inside[k]:
                out.append("[SECRET]")
                end = max(e for b, e in spans if b <= k < e)
                while any(b < end < e for b, e in spans):
                    end = max(e for b, e in spans if b < end < e)
                k = end
            else:
                out.append(text[k])
                k += 1
        want[r.doc_id] = [*encoder.encode("".join(out), add_special_tokens=False).ids, 2]
    got = {}
    for r in sorted(p.run(spark, SMALL).collect(), key=lambda r: r.start):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == want


def brute_near(rows, width=5, percent=80):
    """The least place of each row's component."""
    sets = []
    for r in rows:
        w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\v\f\r" else c for c in r.text or "").split(" ") if x]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(rows))]
