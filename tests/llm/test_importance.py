"""The draw against a plain form that puts every feature together as a string."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hostlens.llm import importance as I
from tests.llm.conftest import CLASHES, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, n):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[a : a + k]) for a in range(len(words)) for k in range(1, n + 1) if a + k <= len(words)]


def plain(docs, target, d):
    """(id, n_features, weight, score) of all rows in order, and the scores that are drawn, as a sorted list."""
    bucket = lambda f: zlib.crc32(f.encode()) % d.buckets
    s, t = (Counter(bucket(f) for text in texts for f in features(text, d.n)[1]) for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()) + d.buckets, sum(t.values()) + d.buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(d.buckets)}
    out, fit = [], []
    for doc_id, text in docs:
        words, own = features(text, d.n)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"{d.seed}:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if len(words) >= d.least:
                fit.append((-score, doc_id))
        out.append((doc_id, len(own), weight, score))
    due = sorted(fit)[: d.percent * len(fit) // 100]
    return out, [(k + 1, doc_id, -score) for k, (score, doc_id) in enumerate(due)]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_ring_equals_joined_strings(n):
    for text in ("", "one", "One two-three  été", prose(1, 300)):
        want = [zlib.crc32(f.encode()) for f in features(text, n)[1]]
        got = [int(c) for _, found in I.checksums(text.encode(), n) for c in found]
        assert sorted(got) == sorted(want)


def test_slices_change_nothing(monkeypatch):
    text = (prose(2, 500) + " " + "x" * 90 + ", " + prose(3, 40)).encode()
    whole = [np_.tolist() for _, np_ in I.checksums(text, 3)]
    monkeypatch.setattr(I, "SLICE", 16)
    parts = [np_.tolist() for _, np_ in I.checksums(text, 3)]
    assert len(parts) > 50 and sum(parts, []) == sum(whole, [])


@pytest.mark.parametrize("draw", [I.Draw(1, 50, 7, 30, 5), I.Draw(3, 997, 2024, 10, 20), I.Draw(2, 10_000, 1, 100, 0)])
def test_equals_brute_force(spark, edge, edge_rows, draw, monkeypatch):
    monkeypatch.setattr(I, "AT_ONCE", 64)
    target = ["alpha beta gamma", None, "", prose(1, 40), "For the été"]
    want, due = plain([(r[0], r[1]) for r in edge_rows], target, draw)
    out = I.resampled(edge, spark.createDataFrame([(t,) for t in target], "text string"), draw).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    got = [(r.doc_id, r.n_features, r.weight, r.score_) for r in out]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sorted((r["rank"], r.doc_id, r.score_) for r in out if r["rank"] is not None) == due
    assert set(edge.columns) <= set(out[0].asDict()) and all(r.score == "x" for r in out)


def test_repeated_and_tied_rows(spark):
    rows = [(k % 3, "same words " * 30) for k in range(900)] + [(None, "same words " * 30)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    target = docs.limit(0)
    want, due = plain(rows, [], I.Draw(percent=50))
    ranks = sorted((r["rank"], r.doc_id, r.score) for r in I.resampled(docs, target, I.Draw(percent=50)).filter("rank IS NOT NULL").collect())
    assert ranks == due and len(due) == 450
    assert I.drawn(docs, target, I.Draw(percent=50)).count() == 450


def test_ids_of_any_type_and_empty_tables(spark, nothing):
    rows = [(f"d{k}", prose(k, 30)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    _, due = plain(rows, ["alpha"], I.Draw())
    out = I.resampled(docs, spark.createDataFrame([("alpha",)], "text string"))
    assert sorted((r["rank"], r.doc_id, r.score) for r in out.filter("rank IS NOT NULL").collect()) == due
    assert I.resampled(nothing, docs).count() == 0 and I.drawn(docs.limit(0), docs.limit(0)).count() == 0


def test_likely_documents_are_drawn_more_often(spark):
    g = random.Random(1)
    words = lambda pool: " ".join(g.choice(pool) for _ in range(40))
    near, far = [f"near{k}" for k in range(30)], [f"far{k}" for k in range(30)]
    docs = spark.createDataFrame([(k, words(near if k % 4 == 0 else far)) for k in range(2000)], "doc_id long, text string")
    got = I.drawn(docs, spark.createDataFrame([(words(near),) for _ in range(50)], "text string"), I.Draw(percent=20))
    assert got.filter(F.col("doc_id") % 4 == 0).count() > 0.9 * got.count() == 0.9 * 400


def test_clashes_are_kept(edge):
    assert set(CLASHES) <= set(I.resampled(edge, edge).columns)
