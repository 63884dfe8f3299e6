"""Filters against plain sets of strings, and held-out accuracy."""

from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from hostlens.llm import languages as L
from tests.llm.conftest import prose

ALPHABETS = {"ab": "abcde", "el": "αβγδε", "mix": "abcαβ", "zh": "中文字母表"}


def invented(lang, seed, n=60):
    import random

    g = random.Random(f"{lang}{seed}")
    return " ".join("".join(g.choice(ALPHABETS[lang]) for _ in range(g.randrange(1, 8))) for _ in range(n))


def plain_grams(text):
    """The n-grams of a text as strings."""
    out = []
    for w in regex.findall(r"\p{L}[\p{L}\p{M}]*", text or ""):
        w = f" {w.lower()} "
        out += [w[k : k + n] for n in L.ORDERS for k in range(len(w) - n + 1)]
    return out


def as_hash(g):
    """The hash of one n-gram, by the same rule in plain integers."""
    h = len(g)
    for c in g:
        h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % 2**64
        h ^= h >> 32
    return h


@pytest.fixture(scope="module")
def training(spark):
    rows = [(lang, invented(lang, k)) for lang in ALPHABETS for k in range(30)] + [(None, invented("ab", 1)), ("ab", None), ("el", ""), ("mix", "12 !?")]
    return rows, spark.createDataFrame(rows, "lang string, text string").repartition(3)


@pytest.fixture(scope="module")
def model(training):
    return L.learned(training[1])


def test_grams_equal_strings():
    for text in ("", "a", "Été, 中文 x2y", prose(1, 50), "éte"):
        words = [w for part in L.words_of(text) for w in part]
        h, owner = L.grams(words) if words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        assert sorted(h.tolist()) == sorted(as_hash(g) for g in plain_grams(text))
        assert Counter(owner.tolist()) == {k: len(plain_grams(w)) for k, w in enumerate(words)}


def test_counts_and_members(training, model):
    rows, df = training
    counts = {lang: Counter() for lang in ALPHABETS}
    for lang, text in rows:
        if lang:
            counts[lang].update(plain_grams(text))
    got = {(r.lang, r.gram % 2**64): r.n for r in L.gram_counts(df.filter("lang IS NOT NULL")).collect()}
    assert got == {(lang, as_hash(g)): n for lang, c in counts.items() for g, n in c.items()}
    share = {lang: {g: n / c.total() for g, n in c.items()} for lang, c in counts.items()}
    false = Counter()
    for g in set().union(*share.values()):
        top = max(s.get(g, 0) for s in share.values())
        (mask,) = model.masks(np.array([as_hash(g)], np.uint64))[0].tolist()
        for k, lang in enumerate(model.languages):
            member = share[lang].get(g, 0) >= max(L.FLOOR, L.RIVAL * top)
            assert mask >> k & 1 or not member  # a filter forgets nothing
            false[lang] += mask >> k & 1 and not member
    assert model.languages == sorted(ALPHABETS)
    assert all(false[lang] < 0.1 * sum(map(len, share.values())) for lang in ALPHABETS)


def test_correction_of_false_positives(model):
    h = np.random.default_rng(1).integers(0, 2**63, 200_000).astype(np.uint64)
    masks = model.masks(h)[0]
    for k, p in enumerate(model.false):
        assert abs((masks >> np.uint64(k) & np.uint64(1)).mean() - p) < 0.01
    counts = np.array([[100, *(100 * model.false)]])
    assert np.abs(np.maximum(0, (counts[:, 1:] - 100 * model.false))).max() < 1e-9


def test_predictions(spark, model):
    rows = [(k, invented(lang, 1000 + k), lang) for lang in ALPHABETS for k in range(20)]
    got = L.identified(spark.createDataFrame(rows, "doc_id long, text string, truth string"), model).collect()
    assert sum(r.lang_pred == r.truth for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_texts_are_looked_up_alike_in_parts(spark, model, monkeypatch):
    rows = [(k, invented("el", k, 300) + " " + invented("ab", k, 100) + "x" * 50) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = [(r.lang_pred, r.score) for r in L.identified(docs, model).orderBy("doc_id").collect()]
    lookup = L.Lookup(model)
    for name, value in (("SLICE", 7), ("MOST_HELD", 20)):
        monkeypatch.setattr(L, name, value)
    for (_, text), (pred, score) in zip(rows, want, strict=True):
        counts = sum(lookup.sums(words) for words in L.words_of(text))
        (got,), (s,) = model.decide(counts[None])
        assert (got, s) == (pred, score)


def test_odd_texts(edge, nothing, model, spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 ?!"), (4, "ж"), (5, "a"), (None, "中")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score > 0) for r in L.identified(docs, model).collect()}
    assert got == {1: ("und", False), 2: ("und", False), 3: ("und", False), 4: ("ab", False), 5: ("ab", True), None: ("zh", True)}
    out = L.with_language(edge, edge)
    assert out.count() == edge.count() and set(edge.columns) <= set(out.columns) and out.filter("score_ < 0 OR score_ > 1").count() == 0
    assert L.with_language(nothing, edge).count() == 0
    assert {(r.lang_pred, r.score_) for r in L.with_language(edge, nothing).collect()} == {("und", 0.0)}


def test_more_languages_than_bits_in_a_plane(spark):
    rows = [(f"l{k:03d}", (chr(0x4E00 + k) * 3 + " ") * 40) for k in range(130)]
    model = L.learned(spark.createDataFrame(rows, "lang string, text string"))
    assert model.slots.shape[0] == 3
    got = L.identified(spark.createDataFrame([(lang, text[:4]) for lang, text in rows], "truth string, text string"), model).collect()
    assert all(r.lang_pred == r.truth for r in got)


def test_one_language(spark):
    model = L.learned(spark.createDataFrame([("xx", "some words")], "lang string, text string"))
    got = L.identified(spark.createDataFrame([("some",), ("1",)], "text string"), model).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("xx", 1.0), ("und", 0.0)]


def test_query_is_right_on_held_out_documents(spark, sf):
    from hostlens.llm.queries import QUERIES

    truth = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("d"), "lang")
    got = QUERIES["op12_language_filters"](spark, sf).join(truth, F.col("doc_id") == F.col("d")).filter("held_out").collect()
    assert len(got) > 40 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
