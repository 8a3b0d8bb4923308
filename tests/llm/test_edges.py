"""Long texts in linear time, clashing names, tiny documents and huge numbers."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from condenspark.llm import decontamination, license_scan, packing, secret_scan, topk_search, toxicity
from tests.llm.test_operators import DOCS
from tests.llm.test_whole import path


def took(f, *args):
    began = time.process_time()
    out = f(*args)
    return out, time.process_time() - began


MB = 1 << 20


@pytest.mark.parametrize("text", ["idiot ", 'He said "idiot" and you ', 'idiot\n"', "“idiot "])
def test_a_megabyte_of_insults(text):
    trie = toxicity.FuzzyTrie([("idiot", False)])
    found, seconds = took(toxicity.features, text * (MB // len(text)), trie)
    assert seconds < 10 and found[0] > 5
    short = toxicity.features(text * 5, trie)
    assert all(b >= a for a, b in zip(short, found, strict=True))


def test_quotation_marks_count_as_before():
    """Against the plain rule: an odd number of marks before it in its line, and a mark behind it in the line."""
    rng, trie = random.Random(5), toxicity.FuzzyTrie([("idiot", False)])
    for _ in range(300):
        text = "".join(rng.choice(["idiot ", "calm ", '"', "\n", "« "]) for _ in range(rng.randrange(1, 30)))
        quoted = 0
        for line in text.split("\n"):
            for i in range(len(line)):
                if line.startswith("idiot", i):
                    before, after = (sum(c in '"«' for c in part) for part in (line[:i], line[i:]))
                    quoted += before % 2 == 1 and after > 0
        assert toxicity.features(text, trie)[2] == pytest.approx(np.log1p(quoted))


@pytest.mark.parametrize("text", ["key=", "key=a", "key='", "password: x", "token=abc&key=", 'secret="', "://a:b"])
def test_a_quarter_of_a_megabyte_of_assignments(text):
    whole = text * (MB // 4 // len(text))
    found, seconds = took(secret_scan.candidates, whole, None)
    assert seconds < 20 and all(0 <= b < e <= len(whole) for b, e, _ in found)


def test_values_end_at_the_next_assignment():
    spans = lambda t: [t[b:e] for b, e, _ in secret_scan.candidates(t, None)]
    assert spans("password=Tr0ub4dor&3 x") == ["Tr0ub4dor&3"] and spans("key=ab,token=cd;secret=ef") == ["ab", "cd", "ef"]
    assert spans("key=key=key=x1") == ["x1"] and spans("key=") == [] and spans("token = \"a b\" pwd=z.") == ["a b", "z"]


def test_a_megabyte_of_one_phrase():
    for phrase, item in (("word ", "word " * 2000), ("a b c d e f g ", "a b c d e f g " * 300), ("a b c d e f g h ", "x " * 20 + "a b c d e f g " * 30 + "y " * 20)):
        matcher = decontamination.Matcher([("i", item), ("j", "other things " + item)], 13)
        found, seconds = took(matcher.scan, phrase * (MB // len(phrase)), 20)
        assert seconds < 20 and found["n_words"] == MB // len(phrase) * len(phrase.split())


def test_items_that_repeat_themselves_equal_brute_force():
    rng = random.Random(9)
    for _ in range(150):
        word = lambda: rng.choice("ab" if rng.random() < 0.8 else "abcdef")  # noqa: E731, B023
        items = [(str(k), " ".join(word() for _ in range(rng.randrange(1, 60)))) for k in range(4)] + [("r", "a b " * 30), (None, "a " * 40)]
        words = [word() for _ in range(rng.randrange(120))]
        hit, names = set(), set()
        for name, text in items:
            own = text.split()
            n = min(13, len(own))
            windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    names |= {name} - {None}
        found = decontamination.Matcher(items, 13).scan(" ".join(words), 20)
        assert found["n_hit"] == len(hit) and found["items"] == sorted(names)


def test_a_megabyte_of_notices():
    notice = "Released under the MIT License. "
    found, seconds = took(license_scan.Scanner(license_scan.all_templates(), 0.85).scan, notice * (MB // 2 // len(notice)))
    assert seconds < 30 and len(found) == MB // 2 // len(notice) and all(a[4] <= b[3] for a, b in zip(found, found[1:], strict=False))


def test_columns_of_any_name_stay(spark):
    import corpus_pipeline as p

    rows = [(1, "the same text of some length in all " * 4 + tail, 70 + i, 80) for i, tail in enumerate(("zz", "aa", "mm", "bb"))] + [(2, "a text of its own", 5, 6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, __row long, __id long").withColumns({"row": F.lit(9), "id": F.lit(8)})
    out = sorted(tuple(r) for r in p.near_duplicates(spark, table, "").collect())
    assert out == [(1, rows[1][1], 71, 80, 9, 8), (2, "a text of its own", 5, 6, 9, 8)]
    items = spark.createDataFrame([("i", " ".join(f"w{k}" for k in range(14))), ("j", " ".join(f"v{k}" for k in range(14)))], "item_id string, text string")
    for most in (10, 1 << 20):
        found = decontamination.decontaminate(table, items, max_bytes=most)
        assert {r["__row"] for r in found.collect()} == {70, 71, 72, 73, 5}


def test_tiny_documents_leave_little_padding(spark):
    rows = spark.createDataFrame([(i, "hi" if i % 3 else None) for i in range(8192)], DOCS.split(", lang")[0])
    got = packing.pack(rows, path()).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    total = sum(r.n for r in got)
    assert total < 0.97 * 4096 * 4 and len(got) * 4096 < 1.4 * total and sum(r.n < 3900 for r in got) <= 1


def test_huge_components_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (50, [3.0, 1.0]), (1, [1e300, 0.0]), (2, [float(2**19), 1.0]), (3, [float(2**19 - 1), 1.0]), (100, [-1e30, 1e30])]
    got = [tuple(r) for r in topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()]
    v = {0: (256, 512), 50: (768, 256), 3: (256 * (2**19 - 1), 256)}
    want = []
    for q in (0, 50):
        found = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), c) for c in v if c != q)
        want += [(q, k, c, -s) for k, (s, c) in enumerate(found, 1)]
    assert got == want
