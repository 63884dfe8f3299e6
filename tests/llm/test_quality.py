import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hostlens.llm import quality as Q
from hostlens.llm.textbytes import CLASSES, utf8


def features(texts):
    return Q.passages(*utf8(pa.array(texts)))


def test_passages_cover_whole_texts():
    x, doc = features(["", "a b", " ".join(["w"] * 300), None, "  lead " + "x " * 128 + "tail"])
    assert doc.tolist() == [0, 1, 2, 2, 2, 3, 4, 4]
    assert x.shape == (8, Q.FEATURES) and np.isfinite(x).all()
    # A passage's character shares are those of its own words.
    assert x[7, ord("l") - 97] > 0 and x[2, ord("w") - 97] == pytest.approx(0.5)
    assert (x[:, :26].sum(1) <= 1 + 1e-6).all() and CLASSES == 32


def test_a_batch_does_not_change_a_text():
    texts = ["Some TEXT, with 3 lines\nand été.\n" * 20, "", "For " * 400, "a | b | c\n" * 30]
    x, doc = features(texts)
    for k, t in enumerate(texts):
        own, _ = features([t])
        assert np.allclose(x[doc == k], own)


def test_a_long_text_in_pieces():
    data, at = utf8(pa.array(["  Some TEXT with été, " + "word Word w\n" * 3000 + " end "]))
    x, doc = Q.encoded(data, at, 5000)
    whole, _ = Q.passages(data, at)
    assert np.allclose(x, whole) and len(x) > 60 and not doc.any()


def test_attention_finds_the_passage_that_decides():
    g = np.random.default_rng(1)
    bags, y = [], []
    for k in range(300):
        b = g.normal(0, 1, (g.integers(1, 12), 6)).astype(np.float32)
        y.append(k % 2)
        b[g.integers(len(b)), 0] = 6.0 if k % 2 == 0 else 0.0
        bags.append(b)
    net = Q.fit(bags[:200], np.array(y[:200]))
    doc = np.repeat(np.arange(100), [len(b) for b in bags[200:]])
    s = net.score(np.concatenate(bags[200:]).astype(float), doc, 100)
    assert ((s > 0.5) == np.array(y[200:], bool)).mean() > 0.95


def test_held_out_accuracy(spark, sf):
    got = {r.doc_id: r for r in Q.op4(spark, sf.replace("sf0.001", "sf0.01")).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/labels.parquet").collect()}
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    test = [(labels[d], r.predicted) for d, r in got.items() if r.held_out and d in labels]
    assert len(test) > 40 and sum(a == b for a, b in test) / len(test) > 0.95


def test_held_out_labels_are_not_used(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.train(docs, labels), Q.train(docs, flipped)
    assert all(np.array_equal(a.w[k], b.w[k]) for k in a.w)


def test_edges(spark, edge, nothing, edge_rows):
    labels = spark.createDataFrame([(k, k % 2) for k in range(100, 140)] + [(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    net = Q.train(edge, labels)
    out = Q.scored(edge, net)
    got = out.collect()
    assert len(got) == len(edge_rows) and all(0 <= r.score <= 1 for r in got)
    same: dict = {}
    for r in got:
        same.setdefault(r.text or "", set()).add(r.score)
    assert all(len(v) == 1 for v in same.values())
    kept = Q.accepted(edge, labels)
    assert kept.columns == edge.columns and 0 < kept.count() <= len(edge_rows)
    assert Q.scored(nothing, net).count() == 0
    alone = Q.train(edge, labels.filter("quality = 1"))
    assert alone.constant == 1.0 and Q.train(edge, labels.limit(0)).constant == 0.5


def test_gradient_against_differences():
    g = np.random.default_rng(3)
    w = Q.weights(5)
    w = {k: v + g.normal(0, 0.1, v.shape) for k, v in w.items()}
    sizes = [1, 4, 2, 7]
    x, first, y = g.normal(0, 1, (sum(sizes), 5)), np.cumsum([0, *sizes])[:-1], np.array([1.0, 0.0, 1.0, 0.0])
    _, grad = Q.gradient(w, x, first, y)
    for k in w:
        for at in list(np.ndindex(w[k].shape))[:40]:
            both = []
            for e in (1e-5, -1e-5):
                moved = {n: v.copy() for n, v in w.items()}
                moved[k][at] += e
                both.append(Q.gradient(moved, x, first, y)[0])
            assert grad[k][at] == pytest.approx((both[0] - both[1]) / 2e-5, abs=1e-6)


def test_score_against_a_plain_form():
    g = np.random.default_rng(4)
    net = Q.Attention(g.normal(0, 1, 5), g.uniform(0.5, 2, 5), Q.weights(5))
    bags = [g.normal(0, 1, (n, 5)) for n in (1, 3, 6)]
    want = []
    for b in bags:
        h = [np.tanh(np.clip((r - net.mean) / net.scale, -8, 8) @ net.w["E"] + net.w["e"]) for r in b]
        e = [np.exp((np.tanh(v @ net.w["V"]) / (1 + np.exp(-(v @ net.w["U"])))) @ net.w["a"]) for v in h]
        z = sum(k * v for k, v in zip(e, h)) / sum(e)
        want.append(1 / (1 + np.exp(-(z @ net.w["c"] + net.w["b"][0]))))
    assert net.score(np.concatenate(bags), np.repeat([0, 1, 2], [1, 3, 6]), 3) == pytest.approx(np.array(want))


def test_sample_is_bounded_in_passages(spark):
    docs = spark.createDataFrame([(k, "good text here " * (43 * (1 + k % 5)) if k % 2 else "### bad %% " * 60) for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    net = Q.train(docs, labels, most=40)
    assert net.constant is None
    assert Q.train(docs, labels, most=0).constant == 0.5


def test_ids_of_any_type(spark):
    good, junk = "alpha beta gamma delta words in order. ", "$$ ## !! x x x 1 2 3 "
    rows = [(f"d{k}", (good if k % 2 else junk) * (2 + k % 5)) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{k}", k % 2) for k in range(80)] + [("other", 1)], "doc_id string, quality int")
    got = Q.accepted(docs, labels).collect()
    assert {int(r.doc_id[1:]) % 2 for r in got} == {1}
    mixed = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(rows)], "doc_id int, text string")
    assert Q.accepted(mixed, labels.unionByName(spark.createDataFrame([(str(k), k % 2) for k in range(80)], labels.schema))).count() == 40
