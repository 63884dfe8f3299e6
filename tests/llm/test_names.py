"""Tables that hold every column name which the operators use inside: nothing is lost, replaced or ambiguous."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hostlens.llm import common, decontaminate, importance, languages, mixing, pii, quality, sharding, shingles, simhash, tokens, urls

OWN = ("doc_id", "text", "lang", "source", "page_id", "url", "html")


def names():
    """All words in quotes in the package that could be column names."""
    found = set()
    for f in Path(common.__file__).parent.glob("*.py"):
        found |= set(re.findall(r"[\"']([a-z_][a-z0-9_]{0,30})[\"']", f.read_text()))
    return sorted((found | {"_n", "_digest", "_metadata", "pii", "host", "path", "rule", "verdict"}) - set(OWN))


@pytest.fixture(scope="module")
def crowded(spark, folder_of):
    rows = [(k, "alpha beta gamma delta one two three four five six " * (k % 4) + f"word{k}", "en", f"s{k % 3}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("url", F.lit("http://example.com/en/x"))
    return df.select("*", *[F.lit(f"own {n}").alias(n) for n in names()])


@pytest.fixture(scope="module")
def folder_of():
    return None


def check(out, docs, expected=None):
    got = out.collect()
    assert len(got) == (docs.count() if expected is None else expected)
    for n in names():
        assert {r[n] for r in got} == {f"own {n}"}, n
    assert docs.columns == out.columns[: len(docs.columns)] or set(docs.columns) <= set(out.columns)


def test_all_operators(spark, crowded):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "not there")], "item_id long, text string")
    check(mixing.mixed(crowded), crowded)
    check(sharding.sharded(crowded).read(), crowded)
    net = quality.train(crowded, labels)
    check(quality.scored(crowded, net, common.free_name(crowded, "score")), crowded)
    check(pii.personal_data(crowded), crowded)
    check(decontaminate.clean(crowded, items), crowded)
    cache = tokens.TokenCache(spark, common.shared_dir(spark, "t"), tokens.tokenizer_path())
    check(cache.counts(crowded), crowded)
    check(urls.judged(crowded), crowded)
    check(importance.resampled(crowded, items), crowded)
    check(languages.with_language(crowded, crowded), crowded)
    for one in (simhash.one_of_each, shingles.one_of_each):
        out = one(crowded)
        check(out, crowded, out.count())
