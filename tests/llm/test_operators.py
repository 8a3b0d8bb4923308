"""The training-data operators against brute force, on small cases."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from condenspark.llm import chat_format, decontamination, jaccard_join, license_scan, packing, quality, secret_scan, sharding, topk_search, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, start=0):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i % 5 else None, 7) for i, t in enumerate(texts, start)], DOCS).withColumns({"label": F.lit(1), "n": F.lit("clash"), "a": F.lit(0), "node": F.lit(2)})


def brute_components(texts, width=4, percent=85):
    sets = []
    for t in texts:
        w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\v\f\r" else c for c in t or "").split(" ") if x]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    return {i: (len(s), root[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("small", "cells"), [(64, 18), (3, 8)])
def test_join_equals_brute_force(spark, small, cells):
    rng = random.Random(5)
    word = lambda: "w%d" % rng.randrange(4000)
    passage = [word() for _ in range(60)]
    texts = [None, "", " \n ", "one two", "One  TWO", "x", "İ é x y z"]
    for _ in range(4):
        base = [word() for _ in range(rng.choice([30, 80, 160]))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [" ".join(passage + [word() for _ in range(rng.choice([3, 10, 30]))]) for _ in range(15)]
    texts += [texts[-1]] * 4
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs(spark, texts), small=small, cells_log2=max(cells, 12)).collect()}
    assert got == brute_components(texts)


def test_join_of_nothing(spark):
    assert jaccard_join.jaccard_components(docs(spark, ["x"]).where("false")).collect() == []


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [[float(x) for x in v] for v in np.round(rng.normal(size=(300, 6)), 1)]
    vectors += [vectors[0]] * 9 + [None, [1.0, None], [float("nan")], [float("inf")], [2.0]]
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = sorted(tuple(r) for r in topk_search.top_k(rows, every=10, block=16, range_rows=64, chunk_rows=8).select("query_id", "rank", "vec_id", "score").collect())
    q = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in enumerate(vectors) if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for i in (i for i in q if i % 10 == 0):
        best = sorted((-sum(x * y for x, y in zip(q[i], v, strict=False)), j) for j, v in q.items() if j != i)[:5]
        want += [(i, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert got == sorted(want)
    assert topk_search.top_k(rows.where("false")).collect() == []


def test_packing(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [None, "", "It's a <|endoftext|> été, straße!", "word " * 9000] + ["the small text number %d" % i for i in range(60)]
    rows = packing.pack(docs(spark, texts), path, window=256, group_bytes=4000).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length == len(r.ids) // 4
            at += r.length
        assert at <= 256
    encoder = packing.ChunkCache(path, 10).tokenizer
    for i, t in enumerate(texts):
        ids = [x for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start) for x in np.frombuffer(r.ids, "<u4").tolist()]
        assert ids == [*encoder.encode(t or "", add_special_tokens=False).ids, 2]
    assert packing.pack(docs(spark, ["x"]).where("false"), path).collect() == []


def test_best_fit_takes_the_tightest_window():
    where, offset, n = packing.best_fit_decreasing([6, 5, 4, 3, 2], 10)
    assert n == 2 and sum([6, 5, 4, 3, 2]) == 20 and len(set(zip(where, offset, strict=True))) == 5


def test_sharding(spark):
    rows = sharding.interleave(docs(spark, ["a", None, "", "é" * 9] * 25)).collect()
    counts = Counter(r.shard for r in rows)
    assert len(counts) == 8 and max(counts.values()) - min(counts.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    assert sharding.interleave(docs(spark, ["x"]).where("false")).collect() == []


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(20))), (2, "Short item"), (3, None), (10, "short ITEM!")], "item_id long, text string")
    texts = [None, "", "a Short, item b", "x " * 10 + " ".join(f"B{i}" for i in range(3, 17)), "short\nitem " * 3]
    got = {r.doc_id: r.contamination for r in decontamination.decontaminate(docs(spark, texts), bench).collect()}
    assert [(got[i].n_words, got[i].n_hit, got[i]["items"], got[i].contaminated) for i in range(5)] == [(0, 0, [], False), (0, 0, [], False), (4, 2, ["10", "2"], True), (24, 14, ["1"], True), (6, 6, ["10", "2"], True)]
    assert texts[2][got[2].spans[0].begin : got[2].spans[0].end] == "Short, item"
    small = {r.doc_id: r.contamination.n_hit for r in decontamination.decontaminate(docs(spark, texts), bench, max_bytes=20).collect()}
    assert small == {i: got[i].n_hit for i in range(5)}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_trie_equals_edit_distance():
    rng, terms = random.Random(3), ["idiot", "worthless", "scum", "moron", "pathetic"]
    trie = toxicity.FuzzyTrie([(t, False) for t in terms] + [("vequ", True)])
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(2)] = rng.choice(["", "x", "i", "o"])
        w = "".join(w)
        near = [(distance(w, t), t) for t in terms if distance(w, t) <= toxicity.edits_of(t, False)]
        assert (trie.match(w) or (None, None))[1] == (min(near)[0] if near else None), w
    assert trie.match("vequxyz") == ("vequ", 0) and trie.match("1diot")[1] == 0 and trie.match("veq") is None


def test_toxicity(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["sun", "tree", "river", "stone"]) + str(rng.randrange(50)) for _ in range(20)) + (" you idiot loser" if i % 4 == 0 else "") for i in range(160)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id long, toxic int")
    more = [None, "", "You ID1OT and l0ser", "a calm river", "he said \"idiot\""]
    rows = docs(spark, texts + more)
    got = {r.doc_id: r.toxicity for r in toxicity.score_toxicity(rows, labels).collect()}
    assert all((got[i] >= 0.3) == (i % 4 == 0) for i in range(160))
    assert got[160] == got[161] == got[163] < 0.3 <= got[162] and got[164] < got[0]
    assert toxicity.score_toxicity(rows.where("false"), labels.where("false")).count() == 0


def test_licenses(spark):
    mit = license_scan.TEMPLATES["MIT-grant"]
    texts = [None, "", "nothing here", "x. Released under the MIT License. y\nReleased under the MIT License.", "pre " * 50 + mit.replace("merge, ", "") + " post" * 50, "All rights reserved."]
    got = [(r.doc_id, r.license) for r in license_scan.scan_licenses(docs(spark, texts)).orderBy("doc_id", "begin").collect()]
    assert got == [(3, "MIT"), (3, "MIT"), (4, "MIT-grant"), (5, "reserved")]
    pairs = license_scan.patience("a b c x d".split(), "a c b d".split())
    assert len(pairs) == 3 and pairs == sorted(pairs)


def test_every_license_line_of_the_tables_is_found(spark):
    lines = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "All rights reserved.", "Licensed under CC BY-NC 4.0."]
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(" or ".join(f"contains(text, '{x}')" for x in lines)).select("doc_id", "text").collect()
    got = {(r.doc_id, r.begin, r.end) for r in license_scan.scan_licenses(spark.createDataFrame(rows)).collect()}
    want = {(r.doc_id, r.text.index(x), r.text.index(x) + len(x) - 1) for r in rows for x in lines if x in r.text}
    assert len(want) >= len(rows) > 40 and want <= got


def test_each_license_is_found_by_its_name():
    texts = license_scan.all_templates()
    scanner = license_scan.Scanner(texts, 0.85)
    for name, text in texts.items():
        assert [f[:2] for f in scanner.scan(f"some words {text} and more")] == [(name, 1.0)], name
    for kind in ("Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "MPL-2.0", "CC0-1.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC"):
        assert f"{kind}-text" in texts
    assert scanner.scan("Licensed under CC BY 4.0.")[0][0] == "CC-BY-4.0-line" and scanner.scan("Licensed under CC BY-NC-SA 4.0.")[0][0] == "CC-BY-NC-SA-4.0-line"


def test_licenses_that_repeat_are_all_found():
    texts = license_scan.all_templates()
    scanner = license_scan.Scanner(texts, 0.85)
    for name, text in texts.items():
        words = license_scan.WORD.findall(text)
        if len(words) >= 25:
            less = " ".join(w for i, w in enumerate(words) if i % 20 != 7)
            joined = f"{'pre ' * 40}{text} mid dle {text} {less} {'post ' * 40}"
            got = scanner.scan(joined)
            assert [f[0] for f in got] == [name] * 3 and all(f[1] == 1.0 for f in got[:2]), name
            assert all(a[4] <= b[3] for a, b in zip(got, got[1:], strict=False)) and len(" ".join(joined[got[0][3] : got[0][4]].split())) <= len(text)


def test_common_subsequence_of_any_size():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(30))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        for cells in (1, 40, 1 << 26):
            pairs = sorted(license_scan.common(a, b, 0, len(a), 0, len(b), cells))
            assert len(pairs) == best[-1][-1] and all(a[i] == b[j] for i, j in pairs)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    twice = "x y z w".split() * 2000
    assert len(license_scan.patience(twice, "z w y x".split() * 20)) > 0


def test_quality(spark):
    rng = random.Random(4)
    good = [". ".join(" ".join(rng.choice(["river", "stone", "light", "garden"]) + str(i) for i in range(8)).capitalize() for _ in range(4)) + "." for _ in range(60)]
    bad = [" ".join("BUY!! NOW!!" for _ in range(30)) for _ in range(10)] + ["### $$$ %%% " * 20 for _ in range(10)]
    got = {r.doc_id: r.keep for r in quality.classify_quality(docs(spark, [*good, *bad, None, ""])).collect()}
    assert all(got[i] for i in range(60)) and not any(got[i] for i in range(60, 80)) and len(got) == 82
    assert quality.classify_quality(docs(spark, ["x"]).where("false")).collect() == []


def test_secrets(spark):
    key, token = "AKIA" + "Q7XW2M4KZP6RT5YB", "cf1d64a9a4cd9723e1f4eafc27395915e6868ffa"
    texts = [None, "", f"a word {key} b", f'set token = "{token}" now', f"see commit {token} for it", "call 4041894974608795", "a-very-plain-hyphenated-word"]
    out = {r.doc_id: r.text for r in secret_scan.redact(docs(spark, texts)).collect()}
    assert out == dict(enumerate([None, "", "a word [SECRET] b", 'set token = "[SECRET]" now', *texts[4:]]))
    held = secret_scan.labelled_findings(800, seed=99)
    scores = secret_scan.train().predict(np.array([secret_scan.describe(*r[:4]) for r in held]))
    assert np.mean((scores >= 0.5) == np.array([r[4] for r in held])) > 0.95


def test_secrets_of_any_length_and_characters(spark):
    secrets = [('password = "{}" now', "Tr0ub4dor&3"), ("see postgres://user:{}@db.host/x for it", "p@ss!word"), ("the password: {} is set", "qzvkwjxrtplmbnhd"), ("DB_PASSWORD={}\nnext", "s3cr#t"), ('{{"api_key": "{}"}}', "k9$Lm!2x"), ("dbPassword: '{}'", "Zx9!q_7w")]
    plain = ["password: required", 'token = "${TOKEN}"', "the key: value", "passwords are good: keep them", "password = None", "at http://host:80/a@b here", "monkey: banana"]
    texts = [a.format(b) for a, b in secrets] + plain
    out = [r.text for r in secret_scan.redact(docs(spark, texts)).orderBy("doc_id").collect()]
    assert out == [a.format("[SECRET]") for a, _ in secrets] + plain


def test_chats(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (4, 0, "user", None), (5, 0, "user", "hi"), (5, 1, None, "no")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1))
    for bucket, part in ((512, 256), (1, 1)):
        got = chat_format.format_chats(turns, bucket, part).orderBy("conv_id", "part").collect()
        text = {}
        for r in got:
            text[r.conv_id] = text.get(r.conv_id, "") + r.text
        assert {r.conv_id: (r.n_turns, r.n_copies) for r in got} == {2: (2, 2), 4: (1, 1), 5: (2, 1)}
        assert text[2] == "<|user|>\nhi\n<|end|>\n<|assistant|>\nyes\n<|end|>\n" and text[4] == "<|user|>\n\n<|end|>\n"
    assert chat_format.format_chats(turns.where("false")).collect() == []


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    dir_ = "/root/testdata/sf0.001"
    kept = spark.read.parquet(f"{dir_}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, kept, dir_)
        assert out.columns == kept.columns, name
        kept = spark.createDataFrame(out.collect(), kept.schema)
    ids = {r.doc_id for r in p.STAGES[-1][1](spark, kept, dir_).select("doc_id").collect()}
    assert ids == {r.doc_id for r in kept.select("doc_id").collect()}


def test_near_duplicates_keep_one_row_of_each_component(spark):
    import corpus_pipeline as p

    rng = random.Random(6)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(6)]
    rows = [(1, base[0]), (1, base[1]), (2, base[1] + " more"), (3, base[2]), (3, base[2]), (None, base[3]), (None, base[3] + " end"), (None, base[4]), (5, base[4]), (7, ""), (7, None)]
    got = p.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    want = [(1, base[0]), (1, base[1]), (3, base[2]), (None, base[3]), (5, base[4]), (7, ""), (7, None)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    texts = [*base, base[0] + " x", base[5] + " y", "", "one"]
    plain = p.near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "").collect()
    assert {r.doc_id for r in plain} == {i for i, (_, c) in brute_components(texts, 5, 80).items() if i == c}


def odd_rows(spark):
    """Nulls in every column, repeated rows, an empty and a very long text, and columns with clashing names."""
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "", None, "s", 0), (2, "tie of one two three four", "en", None, None), (2, "tie of one two three four", "en", None, None), (3, "long text " * 30000, None, "s", 1), (4, None, "en", "s", None)]
    clash = {c: F.lit("x") for c in ("label", "n", "a", "b", "node", "score", "size", "shard", "slot", "toxicity", "contamination", "count", "start", "length", "ids", "token", "stratum", "position", "x", "y")}
    return spark.createDataFrame(rows, DOCS).withColumns(clash)


def test_odd_rows_keep_their_number(spark):
    rows = odd_rows(spark)
    labels = spark.createDataFrame([(None, 1), (1, None), (2, 0), (3, 1)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    bench = spark.createDataFrame([(None, None), (None, "tie of one"), (1, "")], "item_id long, text string").withColumn("n", F.lit(1))
    for found in (sharding.interleave(rows), toxicity.score_toxicity(rows, labels), decontamination.decontaminate(rows, bench), quality.classify_quality(rows), secret_scan.redact(rows), jaccard_join.jaccard_components(rows)):
        ids = sorted((r.doc_id for r in found.select("doc_id").collect()), key=str)
        assert ids == [1, 2, 2, 3, 4, None, None], found.columns
    hit = {r.doc_id: r.contamination.n_hit for r in decontamination.decontaminate(rows, bench).collect()}
    assert hit == {None: 0, 1: 0, 2: 3, 3: 0, 4: 0}
    assert license_scan.scan_licenses(rows).count() == secret_scan.scan_secrets(rows).count() == 0


def test_odd_rows_are_packed_whole(spark):
    import public_tokenizers

    rows = packing.pack(odd_rows(spark), public_tokenizers.path("word_bpe_49k.json")).collect()
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.length
    assert total[None] == 2 and total[1] == total[4] == 1 and total[2] % 2 == 0 and total[3] == max(r.doc_tokens for r in rows) > 4096


def test_pipeline_stages_on_odd_and_on_no_rows(spark):
    import corpus_pipeline as p

    dir_ = "/root/testdata/sf0.001"
    want = {"toxicity": [1, 2, 2, 3, 4, None, None], "near_duplicates": [1, 2, 3, 4, None, None]}
    for name, stage in p.STAGES[:-1]:
        ids = sorted((r.doc_id for r in stage(spark, odd_rows(spark), dir_).select("doc_id").collect()), key=str)
        assert ids == want.get(name, [1, 2, 2, 3, 4, None, None]), name
        assert stage(spark, odd_rows(spark).where("false"), dir_).count() == 0, name
