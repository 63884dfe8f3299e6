import random
import re

from pyspark.sql import functions as F

import corpus_pipeline as P
from hostlens.llm import shingles as S


def brute_set(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def brute_kept(rows):
    """The smallest ids of groups that pairs with a similarity of 0.8 connect."""
    sets, head = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while head[k] != k:
            k = head[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                head[find(a)] = find(b)
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(find(k), []).append(i)
    return sorted((min((i for i in ids if i is not None), default=None) for ids in least.values()), key=str)


def words(g, n):
    return [f"w{g.randrange(5000)}" for _ in range(n)]


def planted(seed, families, copies):
    """Texts and edited copies of them, with similarities on both sides of 0.8."""
    g, rows = random.Random(seed), []
    for f in range(families):
        base = words(g, g.choice((30, 100, 400)))
        rows.append(" ".join(base))
        for _ in range(copies):
            w = list(base)
            for _ in range(g.choice((0, 1, len(w) // 60, len(w) // 40, len(w) // 25))):
                w[g.randrange(len(w))] = f"x{g.randrange(10**6)}"
            rows.append(" ".join(w + words(g, g.choice((0, 0, len(w) // 12, len(w) // 4)))))
    g.shuffle(rows)
    return list(enumerate(rows))


def test_the_stage_drops_planted_near_copies(spark):
    rows = planted(7, 12, 8)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id for r in S.one_of_each(df).collect()), key=str) == brute_kept(rows)
    assert sorted((r.doc_id for r in P.deduplicate(spark, df, "").collect()), key=str) == brute_kept(rows)


def test_a_large_group_makes_few_candidates(spark, monkeypatch):
    """Near copies of one text: pairs grow with the group, not with its square."""
    g = random.Random(3)
    base, rows = words(g, 200), []
    for k in range(600):
        w = list(base)
        w[g.randrange(len(w))] = f"x{g.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    seen = []
    plain = S._confirmed
    monkeypatch.setattr(S, "_confirmed", lambda pairs, *rest: seen.append(pairs.select("a", "b").distinct().count()) or plain(pairs, *rest))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((r.doc_id for r in S.one_of_each(df).collect()), key=str) == brute_kept(rows)
    assert sum(seen) < 12 * len(rows)


def test_contracted_links_connect_the_same():
    import numpy as np
    import pyarrow as pa

    g = np.random.default_rng(1)
    src, dst = g.integers(0, 300, 200), g.integers(0, 300, 200)
    (out,) = S._contracted(iter([pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])]))

    def heads(links):
        head = list(range(300))
        find = lambda k: k if head[k] == k else find(head[k])
        for x, y in links:
            x, y = find(x), find(y)
            head[max(x, y)] = min(x, y)
        return [find(k) for k in range(300)]

    got = list(zip(out.column("src").to_pylist(), out.column("dst").to_pylist(), strict=True))
    assert heads(got) == heads(zip(src.tolist(), dst.tolist(), strict=True)) and all(x > y for x, y in got)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((r.doc_id for r in S.one_of_each(docs).collect()), key=str) == brute_kept(rows)


def test_edges(spark, edge, nothing, edge_rows):
    out = S.one_of_each(edge)
    assert out.columns == edge.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == brute_kept([r[:2] for r in edge_rows])
    assert S.one_of_each(nothing).count() == 0


def test_similarity_of_exactly_four_fifths(spark):
    got = spark.range(1).select(S.similar(F.lit(8), F.lit(9), F.lit(9)).alias("at"), S.similar(F.lit(8), F.lit(9), F.lit(10)).alias("below")).first()
    assert got.at and not got.below


def test_parities_refuse_no_similar_sets_and_most_others(spark):
    import numpy as np

    g, rows = np.random.default_rng(2), []
    for n in (1, 2, 60, 64, 65, 130, 500, 513, 3000):
        for k in range(40):
            a = g.integers(0, 2**63, n).astype(np.uint64)
            own = int(n * (k % 20) / 40)  # of b: none to half
            b = np.append(a[own:], g.integers(0, 2**63, int(own * g.random())).astype(np.uint64))
            both, na, nb = n - own, n, len(b)
            rows.append((9 * both >= 4 * (na + nb), both / (na + nb - both), na, nb, *(S.parity(s).view(np.int64).tolist() for s in (a, b))))
    df = spark.createDataFrame(rows, "similar boolean, j double, a int, b int, pa array<long>, pb array<long>")
    got = df.withColumn("may", S.possible(F.col("pa"), F.col("pb"), F.col("a"), F.col("b"))).collect()
    assert any(r.similar and len(r.pa) != len(r.pb) for r in got)
    assert all(r.may for r in got if r.similar)
    far = [r.may for r in got if r.j < 0.65 and r.a >= 60]
    assert sum(far) < 0.05 * len(far)


def test_the_stage_links_fingerprints_first(spark, monkeypatch):
    seen = []
    plain = S.simhash.links
    monkeypatch.setattr(S.simhash, "links", lambda fps, *rest: seen.append(fps.count()) or plain(fps, *rest))
    rows = planted(9, 4, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id for r in P.deduplicate(spark, df, "").collect()), key=str) == brute_kept(rows)
    assert seen and seen[0] > 1


def test_folded_parities_refuse_no_similar_sets():
    import numpy as np

    g = np.random.default_rng(4)
    for n in (1, 5, 64, 200, 2000):
        for k in range(20):
            a = g.integers(0, 2**63, n).astype(np.uint64)
            b = np.append(a[n * k // 60 :], g.integers(0, 2**63, n * k // 90).astype(np.uint64))
            apart = len(set(a.tolist()) ^ set(b.tolist()))
            for f in (S.wide, S.folded):
                assert np.bitwise_count(f(a) ^ f(b)).sum() <= apart
