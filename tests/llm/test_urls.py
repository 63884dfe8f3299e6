import pytest

from hostlens.llm import urls


@pytest.mark.parametrize(
    "url, host, path",
    [
        ("https://Ex.COM/a/B?q#f", "ex.com", "/a/B"), ("http://x.com", "x.com", ""), ("http://x.com?a/b", "x.com", ""), ("http://x.com#a/b", "x.com", ""), ("//x.com/a", "", ""), (None, "", ""), ("", "", ""), ("a://b://c/d", "b:", "//c/d"), ("x://", "", ""),
        ("https://É.com/É", "É.com", "/É"), ("https://u@x.com:80/", "u@x.com:80", "/"),
    ],
)
def test_parts(url, host, path):
    assert urls.parts(url) == (host, path)


@pytest.mark.parametrize(
    "host, path, rule",
    [
        ("a.example.com", "/en/1", "example.com/en/"), ("www.example.com", "/en/1", "www.example.com/en/"), ("b.www.example.com", "/en/", "www.example.com/en/"), ("example.com", "/de/", "com/"), ("x.net", "/es/1", "net/es/"), ("x.net", "/en/", None),
        ("com", "/", "com/"), ("x.com", "", None), ("xcom", "/", None), ("", "", None),
    ],
)
def test_rules(host, path, rule):
    found = urls.Rules().find(host, path)
    assert (found and found[0]) == rule


@pytest.mark.parametrize(
    "url, hits", [("http://casino-win.example.org/", (0, 2)), ("http://casinos.example.org/", (0, 0)), ("http://x.org/XXX", (1, 0)), ("http://x.org/casino/casino", (0, 1)), ("http://win7.org/", (0, 0)), ("http://free.org/free_bets", (0, 2)), ("http://freewin.org", (0, 0))]
)
def test_vocabulary(url, hits):
    assert urls.Vocabulary().hits(*urls.parts(url)) == hits


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "k"), (1, None, "k"), (None, "http://x.org/porn", "k"), (3, "http://a.org/" + "x" * 100_000, None)], "page_id long, url string, verdict string")
    got = sorted((r.page_id or 0, r.verdict_) for r in urls.judged(df).collect())  # a column named verdict is kept
    assert got == [(0, "block"), (1, "allow"), (1, "allow"), (3, "allow")]
    assert urls.judged(df.limit(0)).count() == 0


def test_vocabulary_from_a_table(spark):
    df = spark.createDataFrame([("Casino", 1), ("xxx", 2), ("", 2), (None, 1), ("casino", 1), ("spam", 5)], "term string, weight int")
    assert urls.vocabulary(df) == (("spam", "xxx"), ("casino",))
    with pytest.raises(ValueError):
        urls.vocabulary(df, most=2)


def test_a_host_of_many_labels_is_read_in_time():
    import time

    from hostlens.llm.urls import Rules

    rules, start = Rules(), time.process_time()
    for _ in range(20):
        assert rules.find("a." * 500_000 + "example.com", "/en/x") == ("example.com/en/", "block")
        assert rules.find("." * 500_000, "/") is None and rules.find("", "") is None
    assert time.process_time() - start < 1
    wide = Rules((("com", "/abcdefghijk", "a"), ("b.com", "/abcdefghi", "b"), ("a.b.com", "/", "c"), ("com", "/", "d")))
    assert wide.find("x.a.b.com", "/abcdefghijk") == ("b.com/abcdefghi", "b")  # equally long: that of the longer host
    assert wide.find("x.com", "/y") == ("com/", "d") and wide.find("com.x", "/") is None
