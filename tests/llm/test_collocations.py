"""Phrases against a plain count of all of them."""

import re
from collections import Counter

import pytest

from hostlens.llm import collocations as C
from tests.llm.conftest import prose

SETTINGS = [C.Phrases(4, 3, 80, 2000), C.Phrases(3, 2, 50, 7), C.Phrases(5, 2, 101, 50), C.Phrases(2, 1, 80, 10)]


def plain(rows, most):
    """All rows of the result, by counting every phrase of every length."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[a : a + k])) for k in range(1, most.longest + 1) for a in range(len(words) - k + 1))
    inside = lambda p, q: any(q[a : a + len(p)] == p for a in range(len(q) - len(p) + 1))
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= most.least}
    out = []
    for (lang, p), a in found.items():
        if any(g == lang and len(q) > len(p) and 100 * b >= most.covered * a and inside(p, q) for (g, q), b in found.items()):
            continue
        cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    out.sort()
    rank, rows = Counter(), []
    for lang, score, a, p, left, right, total in out:
        rank[lang] += 1
        if rank[lang] <= most.top:
            rows.append((lang, rank[lang], p.decode(), -a, left, right, total, -score))
    return rows


def result(df, most):
    return sorted(tuple(r) for r in C.collocations(df, most).collect())


@pytest.fixture(scope="module")
def rows():
    texts = [prose(k, 80).replace(" and", ", and") for k in range(12)]
    extra = ["New York City. new york city; NEW YORK", "a\tb  a b\na b a b a b", "\x1c x\x1cy x\x1cy", "é é é é é", None, "", " . , ", "of the of the of the of"]
    return [(("en", "de", None)[k % 3], t) for k, t in enumerate(texts * 2)] + [(g, t) for t in extra for g in ("en", "und", "xx") for _ in range(2)]


@pytest.mark.parametrize("most", SETTINGS)
def test_equals_brute_force(spark, rows, most):
    got = result(spark.createDataFrame(rows, "lang string, text string").repartition(3), most)
    assert got == plain(rows, most) and len(got) > 10


def phrases(text, k):
    """The phrases of k words of a text, as its parts have them."""
    out = Counter()
    for part in C.parts(text.encode(), k):
        words = C.words_of(part)
        found = [words[a : a + k] for a in range(len(words) - k + 1)]
        out.update(b" ".join(w).decode() for w in found if C.END not in w)
    return out


def test_small_slices_and_bounds_change_nothing(rows, monkeypatch):
    long = prose(5, 60) + ", " + prose(6, 60)
    texts = [t or "" for _, t in rows] + [long]
    whole = {k: [phrases(t, k) for t in texts] for k in (1, 2, 3, 4)}
    for name, value in (("SLICE", 8), ("AT_ONCE", 50), ("MOST_HELD", 10)):
        monkeypatch.setattr(C, name, value)
    assert len(list(C.parts(long.encode(), 3))) > 20
    for k in whole:
        assert [phrases(t, k) for t in texts] == whole[k]
    everything = C.Frequent(C.np.full(64, 2**64 - 1, C.np.uint64))
    for k in whole:
        counts, total = C.Counts(k, everything if k > 1 else None), Counter()
        for t in texts:
            for part in C.parts(t.encode(), k):
                counts.add("en", part)
            for b in counts.give() if counts.many() else ():
                total.update(dict(zip(b.column("phrase").to_pylist(), b.column("n").to_pylist(), strict=True)))
        for b in counts.give():
            total.update(dict(zip(b.column("phrase").to_pylist(), b.column("n").to_pylist(), strict=True)))
        words = total.pop(None, 0)
        assert total == sum(whole[k], Counter()) and (k > 1 or words == total.total())


def test_a_full_filter_gives_the_same(spark, rows, monkeypatch):
    monkeypatch.setattr(C, "FILTER_BITS", 1 << 12)
    most = C.Phrases(4, 1, 80, 2000)
    few = rows[:3] + rows[-9:]
    assert result(spark.createDataFrame(few, "lang string, text string"), most) == plain(few, most)


def test_counts_beyond_64_bits(spark):
    """2,000,000 a passes 64 bits; the score stays exact."""
    a, big = 9_007_199_254_740_993, 9_007_199_254_740_995
    one = spark.createDataFrame([("en", "x", big), ("en", "y", a)], "lang string, phrase string, n long")
    two = spark.createDataFrame([("en", "x y", a)], "lang string, phrase string, n long")
    r = C.scored([one, two], C.Phrases(2)).first()
    assert (r.score, r.l, r.r) == (2000000 * a // (a + big), big, a)


def test_a_hot_word(spark):
    """One word begins a third of all phrases."""
    rows = [("en", ". ".join(f"the w{k % 50} x{k % 7}" for k in range(j, j + 200))) for j in range(20)]
    most = C.Phrases(3, 5, 80, 30)
    assert result(spark.createDataFrame(rows, "lang string, text string"), most) == plain(rows, most)


def test_empty_and_clashing(spark, edge, nothing, edge_rows):
    assert C.collocations(nothing).count() == 0
    most = C.Phrases(3, 4, 80, 20)
    assert result(edge, most) == plain([(r[2], r[1]) for r in edge_rows if r[0] != 6] + [(r[2], r[1]) for r in edge_rows if r[0] == 6], most)
