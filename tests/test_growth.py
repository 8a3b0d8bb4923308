"""Steps of the log queries whose work must grow no faster than the input, and spread over tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from condenspark.functions import normalize
from condenspark.operators import patterns, sinks
from condenspark.plans import queries
from condenspark.plans.condense import condense


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_waits_of_many_events_at_one_time(spark):
    """The clock of a copy that begins anew stands still, so its events share one time; no window may look ahead from each row."""
    n = 120_000
    at = F.least(F.col("id"), F.lit(100)) * 1_000_000 + F.when(F.col("id") == n - 1, 60_000_000).otherwise(0)
    decided = spark.range(n).select(F.lit("s").alias("source"), F.col("id").alias("event_no"), F.lit(3).cast("byte").alias("severity"), F.lit("a").alias("template"), F.lit("repeat").alias("decision"), F.timestamp_micros(at + 1_780_000_000_000_000).alias("ts"))
    found = patterns.timed_summaries(decided)
    assert "unboundedfollowing" not in plan_of(found).lower()
    got = sorted((r.emit_no is None, r.emit_no, r["count"]) for r in found.collect())
    # a wait from each third second on, and those of the last: to the end of the standing clock, and none after it
    assert got == [(False, no, 3) for no in range(2, 99, 3)] + [(False, n - 1, n - 99)]


def test_events_without_a_time_yet_are_summed_up(spark):
    rows = [("s", i, 3, "a", "repeat", None) for i in range(3)]
    decided = spark.createDataFrame(rows, "source string, event_no long, severity int, template string, decision string, us long").withColumn("ts", F.timestamp_micros("us"))
    assert [(r["count"], r.emit_no) for r in patterns.timed_summaries(decided).collect()] == [(3, None)]


def one_group(spark, path, n=4000):
    """Events in a file of one row group, which a scan cuts into many splits that are empty but for one."""
    spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") + 1_780_000_000).alias("ts"), (F.col("id") % 7).alias("user_id"), F.lit("error").alias("event_type"), (F.col("id") / 7).alias("value"), F.concat(F.lit('{"k": '), F.md5(F.col("id").cast("string")), F.lit("}")).alias("props")).coalesce(1).write.parquet(f"{path}/events.parquet")


def test_rows_of_one_row_group_go_over_all_tasks(spark, tmp_path):
    one_group(spark, tmp_path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        assert spark.read.parquet(f"{tmp_path}/events.parquet").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        tasks = queries.event_lines(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(r["count"] for r in tasks) == 4000 and max(r["count"] for r in tasks) < 1000


def test_classes_are_replaced_once_and_behind_the_dealing(spark, tmp_path):
    """Not in the tasks of the scan, and not again for the filter."""
    one_group(spark, tmp_path, 200)
    found = queries.QUERIES["norm_ipv4"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    dealt = plan.index("RepartitionByExpression")
    assert plan.count("regexp_replace") == 1 and plan.index("regexp_replace") < dealt
    assert found.count() == 200


def test_classes_of_documents_are_counted_in_one_row_a_line(spark, tmp_path):
    rows = [(1, "10.0.0.1 and 10.0.0.2:80\nplain\n2026-01-02"), (2, None), (3, "5%\r\n7%")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.norm_documents(spark, str(tmp_path))
    assert {r["class"]: r.lines for r in found.collect()} == {"ipv4": 1, "ipv4port": 1, "date": 1, "percent": 2}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 2 and plan.rindex("Generate") > plan.index("Aggregate")


def test_held_events_are_scanned_once(spark):
    """Records, reports and summaries look at the events several times, but lines are read and their templates found once."""
    lines = spark.createDataFrame([("s", i, f"[ERROR] try {i} of x", float(i)) for i in range(50)], "source string, line_no long, raw string, at double").withColumn("ts", F.timestamp_seconds("at"))
    for clock in ("constant", "event"):
        seen = spark.sparkContext.accumulator(0)

        def scan(batches, seen=seen):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        decided = condense(lines.mapInArrow(scan, lines.schema), multi_line=False, clock=clock, hold=True)
        got = sinks.to_text(sinks.records(decided, queries.Config())).collect()
        assert patterns.report(decided).first().raw_lines == 50 and seen.value == 50, seen.value
        want = condense(lines, multi_line=False, clock=clock)
        assert sorted(r.value for r in got) == sorted(r.value for r in sinks.to_text(sinks.records(want, queries.Config())).collect())
        assert sorted(decided.columns) == sorted(want.columns)


def test_any_class_and_each_class_alone(spark):
    """The quick forms against the patterns as they are written."""
    parts = ["10.0.0.1", "x10.0.0.1", "10.0.0.1:80", "2026-01-02", "a2026-01-02", "2026-01-02T03:04:05Z", "1/2/2026", "5%", "a5%", "0xdead", "fe80:1:2", "fe80::", "::1", "00:1a:2b:3c:4d:5e", "deadbeefcafe", "0123abcd-0123-0123-0123-0123456789ab", "gdeadbeefcafe", "é10.0.0.1", "[01/Oct/2026:01:02:03 +0000]", "12:13:14", "word", "", "ab\n1.2.3.4"]
    texts = spark.createDataFrame([(f"{a}{sep}{b}",) for a in parts for b in parts for sep in ("", " ", ":")] + [(None,)], "t string")
    quick = [normalize.has_class(F.col("t"), name) for name, _, _ in normalize.CLASSES]
    plain = [F.col("t").rlike(normalize.java(pattern)) for _, pattern, _ in normalize.CLASSES]
    rows = texts.select(F.array(*quick).alias("quick"), F.array(*plain).alias("plain"), normalize.has_any(F.col("t")).alias("any")).collect()
    assert all(r.quick == r.plain and r.any == (None if None in r.plain else any(r.plain)) for r in rows)
    assert all(any(r.plain[k] for r in rows) for k in range(len(normalize.CLASSES)))


def test_texts_without_digits_or_classes_are_their_own_templates(spark):
    """They skip the passes of tokens; letters alone can still be a class."""
    rows = [("plain words, é_x-y\nmore", "plain words, é_x-y\nmore"), ("deadbeefcafe x", "[HASH] x"), ("aa:bb:cc:dd:ee:ff", "[MAC]"), ("ab:cd:ef x", "[IPV6] x"), ("a" + normalize.ON + "b" + normalize.SEP, "ab"), ("", ""), (None, None), ("try 5", "try [NUM]")]
    found = spark.createDataFrame(rows, "t string, want string").select("t", "want", normalize.template(F.col("t")).alias("got"))
    assert [r.got for r in found.collect()] == [want for _, want in rows]
    assert "CASE WHEN" in plan_of(found)
