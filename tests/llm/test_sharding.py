import pytest

from hostlens.llm import sharding
from hostlens.llm.common import shared_dir


def rows(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_append_compact_and_read(spark, edge, edge_rows):
    store = sharding.ShardStore(spark, shared_dir(spark, "t"), target_bytes=1 << 20, fanout=4)
    for _ in range(3):
        store.append(edge.repartition(3))
    assert store.version() == 3 and len(store.shards()) == 9
    before = rows(store.read(), edge.columns)
    store.compact()
    assert len(store.shards()) == 1 and store.version() == 4
    assert rows(store.read(), edge.columns) == before == sorted(rows(edge, edge.columns) * 3)
    # Old versions can be read until they are vacuumed; clashing columns stay.
    assert store.read(2).count() == 2 * len(edge_rows)
    out = store.read()
    assert {"shard", "shard_", "version", "version_", "shard_bytes", "shard_tier"} <= set(out.columns)
    assert out.select("shard_").distinct().count() == 1
    store.vacuum()
    assert store.read().count() == 3 * len(edge_rows)


def test_large_shards_stay(spark, edge):
    store = sharding.ShardStore(spark, shared_dir(spark, "t"), target_bytes=1000, fanout=2)
    store.append(edge.repartition(4))
    files = {s.file for s in store.shards()}
    store.compact()
    assert {s.file for s in store.shards()} == files


def test_the_second_writer_of_a_version_fails(spark, edge):
    path = shared_dir(spark, "t")
    a, b = sharding.ShardStore(spark, path), sharding.ShardStore(spark, path)
    a.append(edge)
    shards, base = a.shards(), a.version()
    b.append(edge)
    with pytest.raises(sharding.Conflict):
        a._commit(base, edge.schema.json(), shards)
    assert b.version() == 2 and a.read().count() == 2 * edge.count()


def test_files_outside_the_manifest_are_not_read(spark, edge):
    store = sharding.ShardStore(spark, shared_dir(spark, "t"))
    store.append(edge)
    edge.write.mode("append").parquet(f"{store.path}/data")  # as an attempt that failed before its commit
    assert store.read().count() == edge.count()


def test_empty_table(spark, nothing):
    store = sharding.sharded(nothing)
    assert store.read().count() == 0
    assert sharding.tier_of(0) == 0 and sharding.tier_of(1 << 20) == 1 and sharding.tier_of(4 << 20) == 2


def test_query_is_one_row_a_document(spark, sf):
    out = sharding.op2(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_large_arrivals_are_written_in_small_pieces(spark):
    import random

    g = random.Random(1)
    df = spark.createDataFrame([(k, g.randbytes(500).hex()) for k in range(3000)], "doc_id long, text string").coalesce(1)
    store = sharding.ShardStore(spark, shared_dir(spark, "t"), target_bytes=400_000)
    store.append(df)
    sizes = [s.bytes for s in store.shards()]
    assert len(sizes) > 10 and max(sizes) <= store.most
    before = rows(store.read(), df.columns)
    store.compact()
    assert rows(store.read(), df.columns) == before == rows(df, df.columns)
    assert len(store.shards()) < len(sizes) and max(s.bytes for s in store.shards()) > 200_000


def test_manifest_against_the_files(spark, sf):
    """Every live file is listed once with its size and tier, no tier that could be merged is left, no row is lost."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    store = sharding.ShardStore(spark, shared_dir(spark, "t"), target_bytes=60_000)
    for k in range(5):
        store.append(docs.filter(f"doc_id % 5 = {k}").repartition(3))
    store.compact()
    there = dict(store._list(f"{store.path}/data"))
    live = store.shards()
    assert len({s.file for s in live}) == len(live) and all(there[s.file] == s.bytes and s.tier == sharding.tier_of(s.bytes) for s in live)
    for tier in {s.tier for s in live}:
        runs = [s for s in live if s.tier == tier and s.bytes < store.target_bytes]
        assert len(runs) < store.fanout or store._files(runs) >= len(runs)
    got = store.read()
    assert rows(got, docs.columns) == rows(docs, docs.columns)
    of = {s.file: s for s in live}
    for r in got.select("shard", "shard_bytes", "shard_tier").distinct().collect():
        assert (of[r.shard].bytes, of[r.shard].tier) == (r.shard_bytes, r.shard_tier)


def test_order_is_kept_inside_files(spark):
    df = spark.range(1000).selectExpr("id", "(id * 7919) % 1000 AS p").repartition(6)
    store = sharding.sharded(df, order="p")
    for r in store.read().groupBy("shard").agg({"shard": "count"}).collect():
        own = [x.p for x in spark.read.parquet(f"{store.path}/data/{r.shard}").collect()]
        assert own == sorted(own)
