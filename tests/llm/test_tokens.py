import pytest
from pyspark.sql import functions as F

from hostlens.llm import tokens
from hostlens.llm.common import shared_dir


def library(text, path=None):
    from tokenizers import Tokenizer

    return len(Tokenizer.from_file(path or tokens.tokenizer_path()).encode(text or "", add_special_tokens=False).ids)


HARD = ["a  b\t\nc", "it's WE'LL don't 's", "<|endoftext|>", "x<|endoftext|>y <|startoftext|> <|END|>", "é e\u0301 ﬁ Å", "  ", "a\u00a0b\u2003c\u3000d", "12345 6.7", "日本語 テキスト", "👩‍👩‍👧 🇩🇪", "ΑΣ ΑΣ. Σ", "İstanbul ß ẞ", "\u0301 \u0301a", "a\x1cb\x85c\u200bd", "-" * 300, "x" * 3000, "\x00\x01"]


def test_counts_are_the_librarys(spark, edge, edge_rows):
    texts = HARD + [r[1] for r in edge_rows if r[1] is None or len(r[1]) < 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    cache = tokens.TokenCache(spark, shared_dir(spark, "t"), tokens.tokenizer_path())
    for r in cache.counts(df).collect():
        assert (r.n_tokens, r.n_bytes) == (library(texts[r.doc_id]), len((texts[r.doc_id] or "").encode())), texts[r.doc_id]


def test_only_distinct_misses_are_encoded(spark, edge, nothing, edge_rows):
    cache = tokens.TokenCache(spark, shared_dir(spark, "t"), tokens.tokenizer_path())
    out = cache.counts(edge.filter("doc_id < 5"))
    assert out.count() == sum(1 for r in edge_rows if r[0] is not None and r[0] < 5)
    assert {"n_tokens", "n_tokens_", "digest", "digest_"} <= set(out.columns)
    assert cache.known().count() == 3  # one text three times, another, and the empty one, which null counts as
    assert cache.counts(edge).count() == len(edge_rows)
    assert len(cache._batches()) == 2
    cache.compact()
    assert len(cache._batches()) == 1 and cache.known().count() == cache.known().select("digest").distinct().count()
    assert cache.counts(nothing).count() == 0


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = tokens.op7(spark, sf).orderBy("doc_id").collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_tokens, r.over_limit) == (library(docs[r.doc_id]), r.n_tokens > 2048)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(spark, name):
    path = tokens.tokenizer_path(name)
    count = tokens.Counter(path)
    assert not count.by_word
    texts = ["Hello  World", "", "é"]
    if name.endswith("json"):
        assert count(texts) == [library(t, path) for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("digest", tokens.digest(F.col("text")))
    assert sorted(r.n_tokens for r in tokens.encoded(df, path).collect()) == sorted(count(texts))


def test_a_second_run_encodes_nothing(spark, sf, monkeypatch):
    tokens.op7(spark, sf).count()
    cache = tokens.TokenCache(spark, f"{tokens.shared_base(spark)}/hostlens/token-cache", tokens.tokenizer_path())
    before = cache.known().count()
    assert before > 0
    monkeypatch.setattr(tokens, "Counter", None)  # a task that encoded a text would fail
    assert tokens.op7(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert cache.known().count() == before


def test_repeats_beyond_the_reducers_memory(spark):
    df = spark.createDataFrame([(f"t{k % 50}",) for k in range(400)], "text string").withColumn("digest", tokens.digest(F.col("text"))).repartition(3)
    assert tokens.encoded(df, tokens.tokenizer_path()).count() == 50
    batches = df.select("digest", "text").limit(200).toArrow().to_batches(max_chunksize=10)
    assert sum(b.num_rows for b in tokens._fewer(iter(batches), most=5)) >= 50


def test_runs_without_misses_leave_the_cache_as_it_was(spark, edge, nothing):
    cache = tokens.TokenCache(spark, shared_dir(spark, "t"), tokens.tokenizer_path())
    assert cache.counts(nothing).count() == 0 and cache._batches() == []
    some = edge.filter("doc_id < 5")
    for _ in range(3):
        cache.counts(some).count()
    assert len(cache._batches()) == 1
    whole = cache.counts(edge)
    assert len(cache._batches()) == 2
    for _ in range(2):
        assert cache.counts(nothing).count() == 0 and cache.counts(some).count() == some.count()
    assert len(cache._batches()) == 2 and whole.filter("n_tokens_ IS NULL").count() == 0
    asked = some.select(tokens.digest(F.coalesce("text", F.lit(""))).alias("digest"))
    assert cache.known(asked).count() == 3 < cache.known().count()
