import random
import time

from pyspark.sql import functions as F

from hostlens.operators import windows

ROWS = "id long, src_ip string, user string, us long, failed boolean"


def test_sliding_windows_equal_brute_force(spark):
    r = random.Random(3)
    rows = [(k, r.choice(["a", "b", None]), r.choice(["x", "y", "z", "", None]), r.randrange(40) * 1_000_000, r.random() < 0.6) for k in range(200)]
    df = spark.createDataFrame(rows, ROWS)

    def near(x):
        return [y for y in rows if y[1] == x[1] and 0 <= x[3] - y[3] <= 5_000_000]

    count = {q.id: q.recent for q in windows.sliding_count(df, "src_ip", 5).collect()}
    assert count == {x[0]: len(near(x)) for x in rows}
    distinct = {q.id: q.distinct_recent for q in windows.sliding_distinct(df, "src_ip", "user", 5).collect()}
    assert distinct == {x[0]: len({y[2] or "" for y in near(x)}) for x in rows}
    failed = windows.failures_before(df, "src_ip", 5, F.col("failed"))
    assert failed.columns == [*df.columns, "failures"]
    assert {q.id: q.failures for q in failed.collect()} == {x[0]: sum(y[4] for y in near(x)) for x in rows}
    assert windows.sliding_distinct(df.limit(0), "src_ip", "user", 5).count() == 0


def test_many_events_of_one_key_within_a_window(spark):
    n = 200_000
    df = spark.range(n).select("id", F.lit("192.0.2.1").alias("src_ip"), (F.col("id") % 1000).cast("string").alias("user"), (F.col("id") * 100).alias("us"))
    began = time.monotonic()
    top = windows.sliding_count(df, "src_ip", 120).agg(F.max("recent")).first()[0]
    most = windows.sliding_distinct(df, "src_ip", "user", 120).agg(F.max("distinct_recent")).first()[0]
    assert (top, most) == (n, 1000)
    assert time.monotonic() - began < 60


def test_counts_over_many_time_buckets(spark):
    """Times that lie on, before and after the ends of buckets and spans, with repeats."""
    r = random.Random(4)
    edges = [b * 20_000_000 + d for b in range(-2, 4) for d in (-5_000_001, -5_000_000, -1, 0, 1, 4_999_999, 5_000_000, 5_000_001, 10_000_000)]
    rows = [(k, r.choice("ab"), r.choice("xyz"), r.choice(edges), r.random() < 0.5) for k in range(400)] + [(900, "a", "x", None, True)]
    df = spark.createDataFrame(rows, ROWS)
    near = lambda x: [y for y in rows if y[1] == x[1] and y[3] is not None and 0 <= x[3] - y[3] <= 5_000_000]
    timed = [x for x in rows if x[3] is not None]
    count = {q.id: q.recent for q in windows.sliding_count(df, "src_ip", 5).filter("us IS NOT NULL").collect()}
    assert count == {x[0]: len(near(x)) for x in timed}
    distinct = {q.id: q.distinct_recent for q in windows.sliding_distinct(df, "src_ip", "user", 5).filter("us IS NOT NULL").collect()}
    assert distinct == {x[0]: len({y[2] for y in near(x)}) for x in timed}
    failed = {q.id: q.failures for q in windows.failures_before(df, "src_ip", 5, F.col("failed")).filter("us IS NOT NULL").collect()}
    assert failed == {x[0]: sum(y[4] for y in near(x)) for x in timed}


def test_a_hot_key_is_many_tasks(spark):
    n = 400_000
    df = spark.range(n).select("id", F.lit("192.0.2.1").alias("src_ip"), F.lit("root").alias("user"), (F.col("id") * 100_000).alias("us"))
    for out in (windows.sliding_count(df, "src_ip", 120), windows.sliding_distinct(df, "src_ip", "user", 120)):
        parts = out.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
        assert sum(r["count"] for r in parts) == n and len(parts) >= 3 and max(r["count"] for r in parts) < 0.6 * n
