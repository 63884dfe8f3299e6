import re

import pytest

from hostlens.llm import mixing


def water(sizes, weights, most=3):
    """Targets by sharing again and again what is above the limit."""
    left, target = dict(zip(sizes, weights, strict=True)), {}
    total = sum(sizes.values())
    while left:
        rest = total - sum(target.values())
        share = {s: rest * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in left if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            del left[s]
    return target


def test_edges_against_brute_force(spark, edge, edge_rows):
    got = mixing.mixed(edge).collect()
    assert len(got) == len(edge_rows)
    sizes: dict = {}
    for _, text, _, source, _ in edge_rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = [(5, 2, 1)[k % 3] for k in range(len(order))]
    want = water({s: sizes[s] for s in order}, weights)
    taken: dict = {}
    for r in got:
        assert r.size == "x" and r.target == "x"  # columns of the input stay
        assert r.target_ == pytest.approx(want[r.source])
        assert r.source_size == sizes[r.source]
        assert 0 <= r.taken_ <= 3 * r.size_ and r.taken_ == sum(r.pass_words)
        assert len(r.pass_words) == len(r.positions_) and all(0 <= p <= 1 for p in r.positions_)
        assert list(r.positions_) == sorted(r.positions_)
        taken[r.source] = taken.get(r.source, 0) + r.taken_
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1


def test_mix_takes_effect_and_is_in_order(spark, edge):
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "", r.source or "")
    passes = sorted((key(r), sum(2 * w >= r.size_ for w in r.pass_words)) for r in mixing.mixed(edge).collect())
    out = mixing.mixed_documents(edge)
    assert out.columns == edge.columns
    assert sorted(key(r) for r in out.collect()) == [k for k, n in passes for _ in range(n)]
    assert [key(r) for r in out.collect()] == [key(r) for r in mixing.mixed_documents(edge).collect()]


def test_empty_table(nothing):
    assert mixing.mixed(nothing).count() == mixing.mixed_documents(nothing).count() == 0


def test_schedules_are_integrated_and_inverted(spark):
    from pyspark.sql import functions as F

    s = mixing.Share(1.0, ((0.0, 1.8), (0.4, 0.6), (1.0, 1.0 - 0.08 * 0 + 0.0)))
    area = (1.8 + 0.6) / 2 * 0.4 + (0.6 + 1.0) / 2 * 0.6
    s = mixing.Share(1.0, tuple((t, m / area) for t, m in s.knots))
    df = spark.range(0, 101).select((F.col("id") / 100).alias("f")).select("f", s.due(F.col("f")).alias("t"))
    for r in df.collect():  # the share asked for by time t is f again
        done = 0.0
        for (t0, m0), (t1, m1) in zip(s.knots, s.knots[1:], strict=False):
            x = min(max(r.t - t0, 0), t1 - t0)
            done += m0 * x + (m1 - m0) / (t1 - t0) * x * x / 2
        assert done == pytest.approx(r.f, abs=1e-9)
    with pytest.raises(ValueError):
        mixing.Share(1.0, ((0.0, 2.0), (1.0, 2.0))).segments()
