import re

import corpus_pipeline as P
from hostlens.llm import mixing
from tests.llm.test_decontaminate import brute as contamination
from tests.llm.test_shingles import brute_kept


def test_stages_on_their_own_input(spark, sf):
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    got, decontaminated = {}, None
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        path = P.shared_dir(spark, name)
        out.write.parquet(path)
        decontaminated = docs if name == "mixing" else None if name != "sharding" else decontaminated
        before, docs = docs, spark.read.parquet(path)
        got[name] = (before.collect(), docs.collect())
        assert docs.columns[: len(columns)] == columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    a, b = got["quality_classifier"]
    left = {r.doc_id for r in b}
    known = [r.doc_id for r in a if r.doc_id in labels]
    assert sum((d in left) == bool(labels[d]) for d in known) / len(known) > 0.95
    a, b = got["simhash_near_dedup"]
    assert sorted((r.doc_id for r in b), key=str) == brute_kept([(r.doc_id, r.text) for r in a])  # five words, a similarity of 0.8
    a, b = got["benchmark_decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = [d for d, _, hit, _ in contamination([(r.doc_id, r.text) for r in a], items) if not hit]
    assert sorted(r.doc_id for r in b) == sorted(clean)
    a, b = got["mixing"]
    assert {r.doc_id for r in b} <= {r.doc_id for r in a} and b
    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows)
    assert abs(words(b) - words(a)) < 0.1 * words(a)
    before, (a, b) = b, got["sharding"]
    assert sorted((r.doc_id, r.text) for r in a) == sorted((r.doc_id, r.text) for r in b)
    # The order of training, as mixing has it, is that of a column of the result, and of the rows of every shard.
    assert [r.doc_id for r in sorted(b, key=lambda r: r.training_order)] == [r.doc_id for r in mixing.mixed_documents(decontaminated).collect()]


def test_run_and_stages_on_edges(spark, edge, nothing, folder, sf):
    base = edge.select("doc_id", "text", "lang", "source", "n_chars", "score", "row")
    labels = spark.createDataFrame([(k, int(k < 130)) for k in range(100, 140)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "not in any document at all")], "item_id long, text string")
    d = folder(documents=base, labels=labels, benchmark=items)
    assert P.run(spark, d).columns[: len(base.columns)] == base.columns
    for _, stage in P.STAGES:
        assert stage(spark, base.limit(0), d).count() == 0
