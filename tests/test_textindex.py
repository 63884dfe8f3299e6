"""Searches with and without the index over many files."""

import random
import re

import pytest
from pyspark.sql import functions as F

from hostlens.operators import search, textindex
from hostlens.operators.textindex import TextIndex
from hostlens.schema import adapted


@pytest.fixture(scope="module")
def events(spark, sf, tmp_path_factory):
    """Adapted events in 40 files; one of them has a rare text, another a text of letters beyond ASCII."""
    folder = str(tmp_path_factory.mktemp("idx"))
    e = adapted(spark, sf).repartitionByRange(40, "id")
    rare = F.when(F.col("id") == 500, "the Quokka_7 left").when(F.col("id") == 20, "Été à la PLAGE").otherwise(F.col("message"))
    e.withColumn("message", rare).write.parquet(f"{folder}/events")
    return folder, spark.read.parquet(f"{folder}/events")


def ids(df):
    return [r.id for r in df.collect()]


def test_a_rare_text_reads_few_files_and_loses_nothing(spark, events):
    folder, e = events
    index = TextIndex(spark, f"{folder}/index")
    assert index.files(e, search.parse("quokka")) == list(e.inputFiles())  # nothing is known yet
    assert index.update(e) == len(e.inputFiles()) >= 40 and index.update(e) == 0
    g = random.Random(2)
    words = ["quokka", "Quokka_7", "été", "plage", "passwd", "ssh", "curl", "#50", "by", "no such text", "c", "xyz", "target=*passwd", "target=/etc/hosts", "cmd=ls*", "user=user7", "sev>=high", "target!=*passwd*", '"click #5"', "target=*50%_done*"]
    few = 0
    for k in range(40):
        text = words[k] if k < len(words) else " ".join(g.sample(words, 2))
        q = search.parse(text, limit=5000)
        assert ids(index.search(e, q)) == ids(search.search(e, q)), text
        few += len(index.files(e, q)) < 4
    assert few >= 8
    for text in ("quokka", "Quokka_7 left", "ÉTÉ"):
        assert len(index.files(e, search.parse(text))) <= 4 and len(ids(index.search(e, text))) == 1
    assert index.files(e, search.parse("no_such_text")) == [] and ids(index.search(e, "no_such_text")) == []
    plan = index.can_hold(["quokka"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[.*In\(word", plan)


def test_new_files_are_read_until_they_are_indexed(spark, events):
    folder, e = events
    index = TextIndex(spark, f"{folder}/index2", bits=1 << 14)
    index.update(e)
    e.filter("id = 7").withColumn("message", F.lit("a brand-new zebra")).coalesce(1).write.mode("append").parquet(f"{folder}/more")
    e.filter("id = 8").coalesce(1).write.mode("append").parquet(f"{folder}/more")
    both = spark.read.parquet(f"{folder}/events", f"{folder}/more")
    assert len(ids(index.search(both, "zebra"))) == 1
    assert index.update(both) == 2
    assert len(ids(index.search(both, "zebra"))) == 1 and len(index.files(both, search.parse("zebra"))) < 20


def test_needed_bits(spark):
    texts = ["abc", "été", "zzzz"]
    need = textindex.required(texts, 1 << 12)
    rows = spark.createDataFrame([(t,) for t in texts], "message string").withColumns({"command_line": F.lit(None).cast("string"), "target": F.lit("")})
    for gram in ("abc", "été", "zzz"):
        (h,) = spark.createDataFrame([(gram,)], "g string").select(F.xxhash64("g")).first()
        low, high = h & 0xFFFFFFFF, (h % 2**64) >> 32 | 1
        assert textindex._places(gram, 1 << 12) == [(low + j * high) % (1 << 12) for j in range(3)]
    assert sum(bin(m % 2**64).count("1") for m in need.values()) <= 9 and rows.count() == 3
    with pytest.raises(ValueError):
        TextIndex(spark, "/tmp/none", bits=100)
