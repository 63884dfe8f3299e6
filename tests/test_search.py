import pytest
from pyspark.sql import functions as F

from hostlens.operators import search


def rows(spark):
    return spark.createDataFrame(
        [
            (1, "2024-01-01T10:00:00Z", "h", "process", "process.start", "success", 1, "Ann", "192.0.2.1", "S1", 5, "vim", "vim 'a=b' x", None, "Edited"),
            (2, "2024-01-01T11:00:00Z", "h", "auth", "auth.failure", "failure", 3, None, None, None, None, None, None, None, "Failed 100% of tries"),
            (3, "2024-01-01T12:00:00Z", "h", "file", "file.modified", "success", 4, "bob", "192.0.2.2", "S2", 7, None, None, "/etc/PASSWD", "Modified"),
        ],
        "id long, ts string, host string, category string, action string, outcome string, severity int, user string, src_ip string, session_id string, pid long, process_name string, command_line string, target string, message string",
    ).withColumn("ts", F.to_timestamp("ts"))


def ids(df):
    return [r.id for r in df.collect()]


@pytest.mark.parametrize(
    "text, found",
    [
        ("", [3, 2, 1]), ("user=ANN", [1]), ("user!=ann", [3, 2]), ("pid!=5", [3]), ("pid=x", []), ("target=*/passwd", [3]), ("target!=*/passwd", [2, 1]),
        ("sev>=high", [3, 2]), ("sev=high", [3, 2]), ('"100% of"', [2]), ("%", [2]), ("vim", [1]), ("cmd=\"vim 'a=b' x\"", [1]), ("proc=v?m", []), ("u=ann a=process.*", [1]),
    ],
)
def test_terms(spark, text, found):
    assert ids(search.search(rows(spark), text)) == found


@pytest.mark.parametrize("text", ["nope=1", "sev>=loud", '"open', "user>=a"])
def test_errors(text):
    with pytest.raises(search.QueryError):
        search.parse(text)


def test_bounds_limit_and_order(spark):
    e = rows(spark)
    assert ids(search.search(e, search.parse("", since="2024-01-01T11:00:00Z", until="2024-01-01T11:00:00Z"))) == [2]
    assert ids(search.search(e, search.parse("", since="90m"), F.to_timestamp(F.lit("2024-01-01T12:00:00Z")))) == [3, 2]
    assert ids(search.search(e, search.parse("", limit=2))) == [3, 2]
    assert ids(search.display_order(search.search(e, search.parse("", limit=2)))) == [2, 3]
    assert ids(search.search(e, search.parse("", limit=1, descending=False))) == [1]
    assert search.search(e.limit(0), "vim").count() == 0


def test_filters_reach_the_scan(spark, sf):
    plan = spark.read.parquet(f"{sf}/events.parquet").withColumnRenamed("event_id", "id").withColumn("severity", F.lit(1)).filter(search.field_filter("id", "=", "5"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_id), EqualTo(event_id,5)]" in text
