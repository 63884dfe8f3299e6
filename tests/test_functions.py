from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from hostlens.functions import scalars as S
from hostlens.functions.redact import redact


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first().c


@pytest.mark.parametrize(
    "pattern, text, hit",
    [("*", "", True), ("a*c", "abbc", True), ("a?c", "abc", True), ("a?c", "ac", False), ("*.log", "x/y.log", True), ("/etc/*", "/etc/a/b", True), ("a.c", "abc", False), ("A*", "abc", False), ("*\\x", "y\\x", True), ("(a)", "(a)", True)],
)
def test_wildcards(spark, pattern, text, hit):
    df = spark.createDataFrame([(text, pattern)], "t string, p string")
    r = df.select(S.wildcard_match(F.col("t"), pattern).alias("a"), S.wildcard_match_column(F.col("t"), F.col("p")).alias("b")).first()
    assert (r.a, r.b) == (hit, hit)


@pytest.mark.parametrize("text, seconds", [("90", 90), ("90s", 90), ("15m", 900), ("24 h", 86400), ("7days", 604800), ("2w", 1209600), ("", None), ("x", None), ("5y", None)])
def test_durations(spark, text, seconds):
    assert S.parse_duration(text) == (None if seconds is None else timedelta(seconds=seconds))
    assert one(spark, S.duration_seconds(F.lit(text))) == seconds


def test_truncate_keeps_characters_whole(spark):
    got = one(spark, S.truncate_bytes(F.lit("é" * 10), 5))
    assert got == "éé…[truncated 16 bytes]"
    assert one(spark, S.truncate_bytes(F.lit("short"), 5)) == "short"


@pytest.mark.parametrize("command, name, hit", [("vim nginx.conf", "nginx.conf", True), ("vim nginx.conf.bak", "nginx.conf", False), ("cat /etc/x", "x", True), ("a", "", False), ("bobby", "bob", False), ("k=bob;", "bob", True), ("a (b+c)", "b+c", True)])
def test_mentions(spark, command, name, hit):
    assert one(spark, S.mentions_token(F.lit(command), F.lit(name))) is hit


@pytest.mark.parametrize("data, text", [(b"abc", True), (b"a\x00b", False), (b"\xff\xfe", False), ("é".encode(), True), (b"", True), (b"P\x30\x30", True)])
def test_is_text(spark, data, text):
    df = spark.createDataFrame([(data,)], "d binary")
    assert df.select(S.is_text(F.col("d")).alias("c")).first().c is text


def test_hours_over_midnight(spark):
    ts = F.to_timestamp(F.lit("2024-01-01T23:30:00Z"))
    assert one(spark, S.within_hours(ts, "22:00-06:00")) is True
    assert one(spark, S.within_hours(ts, "08:00-18:00")) is False


def test_details(spark):
    assert one(spark, S.with_detail(F.lit('{"a":"1","b":"2"}'), {"b": F.lit("3"), "c": F.lit(None).cast("string"), "d": F.lit("x")})) == '{"a":"1","b":"3","d":"x"}'
    assert one(spark, S.tty_key(F.lit("/dev/pts/3"))) == "tty:pts/3"
    assert one(spark, S.tty_key(F.lit("unknown"))) is None


@pytest.mark.parametrize(
    "text, masked",
    [
        ("export DB_PASSWORD=hunter2 x", "export DB_PASSWORD=*** x"),
        ('api_key: "a b c", next', "api_key: ***, next"),
        ("tool --password hunter2 --verbose", "tool --password *** --verbose"),
        ("git commit -m 'fix token refresh'", "git commit -m 'fix token refresh'"),
        ("curl https://ann:s3cret@example.org/x", "curl https://ann:***@example.org/x"),
        ("Authorization: Basic abc123==", "Authorization: Basic ***"),
        ("Bearer abcdefgh12345", "Bearer ***"),
        ("mysql -uroot -phunter2 db", "mysql -uroot -p*** db"),
        ("find . -print", "find . -print"),
        ("curl -u ann:pw https://example.org", "curl -u ann:*** https://example.org"),
        ("sshpass -p pw ssh h", "sshpass -p *** ssh h"),
        ("ghp_" + "a" * 24, "ghp_***"),
        ("AKIA" + "A1" * 8, "AKIA***"),
        ("xoxb-123456789012", "xox?-***"),
        ("-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "-----PRIVATE KEY REDACTED-----"),
    ],
)
def test_redaction(spark, text, masked):
    assert one(spark, redact(F.lit(text))) == masked
