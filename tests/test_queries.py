"""Whole queries without SQL against plain loops over the same tables."""

from __future__ import annotations

from collections import Counter

import pytest

from condenspark.functions.severity import ICONS, LEVELS
from condenspark.plans import queries
from tests import naive

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def logs(spark):
    """The lines of each document."""
    found = spark.read.parquet(f"{SMALL}/documents.parquet").where("text is not null").select("doc_id", "text").collect()
    return {r.doc_id: [x.removesuffix("\r") for x in r.text.split("\n")] for r in found}


def test_template_documents(spark, logs):
    got = {r.template: r.n for r in queries.template_documents(spark, SMALL).collect()}
    assert got == Counter(naive.template(x) for lines in logs.values() for x in lines)


def test_multiline_blocks(spark, logs):
    got = sorted((r.doc_id, r.event_no, r.n_lines) for r in queries.multiline_blocks(spark, SMALL).collect())
    assert got == sorted((doc, e[0], len(e)) for doc, lines in logs.items() for e in naive.events(lines))


def test_multiline_condense(spark, logs):
    """One store for all, in the order of documents; below its bound the order doesn't matter."""
    seen, shown, warned, errors, alerts = Counter(), Counter(), 0, 0, 0
    for lines in logs.values():
        for e in naive.events(lines):
            level = naive.level_of(lines[e[0]])[0]
            key = level, "\n".join(naive.template(naive.content(lines[i])) for i in e)
            seen[key] += 1
            alert = seen[key] == 10 and level >= 6
            warned, errors, alerts = warned + (level == 5), errors + (level >= 6), alerts + alert
            shown[seen[key] == 1 or alert] += 1
    r = queries.multiline_condense(spark, SMALL).first()
    assert len(seen) <= 10_000
    assert (r.raw_lines, r.displayed_events, r.suppressed_events, r.structural_patterns, r.warning_events, r.error_events, r.anomaly_events) == (sum(map(len, logs.values())), shown[True], shown[False], len(seen), warned, errors, alerts)
    assert r.raw_bytes == sum(len(x.encode()) + 1 for lines in logs.values() for x in lines)


def event_log(spark):
    return [(r.line_no, r.ts, r.raw) for r in queries.event_lines(spark, SMALL).orderBy("line_no").collect()]


def head(level):
    return f"{ICONS[level]} {LEVELS[level]} " if level else ""


def test_text_output(spark):
    count, want = Counter(), []
    left: Counter = Counter()
    for _, _, raw in event_log(spark):
        level, text = naive.level_of(raw)[0], naive.content(raw)
        key = level, naive.template(text)
        count[key] += 1
        if count[key] == 10 and level >= 6:
            want.append(f"{ICONS[-1]} FREQUENCY SPIKE (new pattern)\n   {text}\n   no prior history - already occurring at 40/min\n")
        elif count[key] == 1:
            want.append(f"{head(level)}{text}\n")
        else:
            left[key] += 1
    want += [f"{head(level)}{template}\n  × {n}\n" for (level, template), n in left.items()]
    assert Counter(r.value for r in queries.text_output(spark, SMALL).collect()) == Counter(want)


def test_timed_repeat_summaries(spark):
    """Decisions as the query has them (they have SQL); the waits by a plain loop."""
    decision = {r.event_no: r.decision for r in queries.decisions_event_clock(spark, SMALL).collect()}
    waits, want, clock = {}, Counter(), None
    for no, ts, raw in event_log(spark):
        key = naive.level_of(raw)[0], naive.template(naive.content(raw))
        clock = max(clock or ts, ts)
        if decision[no] == "anomaly" and key in waits:
            want[*key, waits.pop(key)[1], no] += 1
        if decision[no] == "repeat":
            waits.setdefault(key, [clock, 0])[1] += 1
        for k in [k for k, (since, _) in waits.items() if (clock - since).total_seconds() >= (0.5 if k[0] >= 6 else 2)]:
            want[*k, waits.pop(k)[1], no] += 1
    want.update((*k, n, None) for k, (_, n) in waits.items())
    got = Counter((r.severity, r.template, r["count"], r.emit_no) for r in queries.timed_repeat_summaries(spark, SMALL).collect())
    assert got == want
