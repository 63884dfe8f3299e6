import random
import re

import pytest
import xxhash

from hostlens.llm import simhash as S


def brute_fp(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows, radius=2):
    """rows (id, fp) -> for each row the smallest id that it can reach."""
    head = list(range(len(rows)))

    def find(k):
        while head[k] != k:
            k = head[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= radius:
                x, y = find(a), find(b)
                head[max(x, y)] = min(x, y)
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return [least[find(k)] for k in range(len(rows))]


def test_edges_against_brute_force(spark, edge, edge_rows, nothing):
    got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in S.near_duplicates(edge).collect()), key=str)
    fps = [(r[0], brute_fp(r[1])) for r in edge_rows]
    want = sorted([(i, f, c) for (i, f), c in zip(fps, brute_groups(fps), strict=True)], key=str)
    assert got == want
    assert S.near_duplicates(nothing).count() == 0


def planted(n, seed):
    """Fingerprints in chains and balls of few differing bits, and random ones."""
    g = random.Random(seed)
    out = []
    while len(out) < n:
        x = g.getrandbits(64)
        out.append(x)
        for _ in range(g.choice((0, 0, 1, 3, 40))):
            y = g.choice(out[-5:]) if g.random() < 0.5 else x
            for b in g.sample(range(64), g.choice((1, 2, 2, 3))):
                y ^= 1 << b
            out.append(y)
    return out[:n]


@pytest.mark.parametrize("hot", [S.HOT, 3])
def test_groups_of_planted_fingerprints(spark, hot):
    rows = [(1000 - k, fp) for k, fp in enumerate(planted(700, 5))]
    df = spark.createDataFrame([(i, f - 2**64 if f >= 2**63 else f) for i, f in rows], "doc_id long, fp long").repartition(3)
    got = {r.doc_id: r.component_id for r in S.grouped(df, hot).collect()}
    assert got == dict(zip((i for i, _ in rows), brute_groups(rows), strict=True))


def test_a_long_chain_is_one_group(spark):
    x, rows = 12345, []
    for k in range(30):
        rows.append((500 - k if k else 7, x - 2**64 if x >= 2**63 else x))
        x ^= 3 << (2 * k)
    got = {r.component_id for r in S.grouped(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    assert got == {7}


def test_tree_finds_all_within_the_radius():
    values = planted(300, 9)
    tree = S.BKTree()
    for k, x in enumerate(values):
        assert sorted(tree.add(x)) == [j for j in range(k) if (x ^ values[j]).bit_count() <= 2]


def test_one_document_of_each_group_stays(spark, edge, edge_rows, nothing):
    out = S.one_of_each(edge)
    assert out.columns == edge.columns
    got = out.collect()
    fps = [(r[0], brute_fp(r[1])) for r in edge_rows]
    groups = set(zip(brute_groups(fps), (f if c is None else 0 for (_, f), c in zip(fps, brute_groups(fps), strict=True)), strict=True))
    assert len(got) == len(groups)
    assert sum(r.doc_id == 2 for r in got) == 1 and sum(r.doc_id is None for r in got) == 1
    assert S.one_of_each(nothing).count() == 0
