"""Benchmark decontamination by a prefix-filtered set join.

Items and documents are sequences of words. A window is `WINDOW` consecutive words of an item, or all words of a
shorter item. A document that contains a window contains each of its shingles (`SHINGLE` consecutive words, or the
whole window where that is shorter) at a fixed offset, so one shingle per window is a necessary prefix. Shingles are
ordered by rarity, the number of documents' positions that hold them, and each window is joined on its rarest one.
Where a shingle meets, bounds on position and length leave only places where the whole window fits, and the words
themselves are compared: results are exact.

The benchmark side of both joins is broadcast in blocks of at most `BLOCK_WORDS` item words; a benchmark that is larger
takes several blocks, each against all documents. Which items hold a window is no part of a block: that is joined to
the places found, however many items share it. Documents are never shuffled with their texts: what leaves a task is
a narrow row for each document and each verified place.

Defined results: null and blank texts have no words and no hits; items without words match nothing; an item with a null
id marks words but is in no list of items; repeated items with one id count once; repeated rows of documents each get
their own result; empty tables give empty or clean results. Columns of documents stay in `contamination`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, table, written

WINDOW = 10
SHINGLE = 3
BLOCK_WORDS = 400_000
#: What lies between words, after A-Z were lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP, -1), lambda w: w != "")


def with_words(docs: DataFrame, name: str) -> DataFrame:
    """docs with words() of their text in place of it: only the first and last part of a split can be empty."""
    out = docs.withColumn(name, F.split(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), GAP, -1)).drop("text")
    w = F.col(name)
    first, last = (w[0] == "").cast("int"), (F.element_at(w, -1) == "").cast("int")
    return out.withColumn(name, F.slice(w, 1 + first, F.greatest(F.size(w) - first - last, F.lit(0))))


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows: w (words), n (their number), items (distinct non-null ids, as strings), wid (once written)."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("all")).filter(F.size("all") > 0)
    w = w.withColumn("n", F.least(F.lit(size), F.size("all")))
    w = w.select("item", "n", "all", F.explode(F.sequence(F.lit(1), F.size("all") - F.col("n") + 1)).alias("at"))
    w = w.select("item", "n", F.slice("all", F.col("at"), F.col("n")).alias("w"))
    return w.groupBy("w", "n").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("wid", F.monotonically_increasing_id())


def shingle_hash(w: Column, at: Column, n: int) -> Column:
    """Of the n words from the zero-based position `at`; null where there are not that many."""
    parts = [F.get(w, at + k) for k in range(n)]
    return F.when(parts[-1].isNotNull(), F.xxhash64(*parts))


def _positions(docs: DataFrame, lengths: list[int], with_row: bool) -> DataFrame:
    """A row for each position and shingle length; with_row: and one with pos -1 for the document."""
    first = -1 if with_row else 0
    at = docs.withColumn("pos", F.explode(F.sequence(F.lit(first), F.greatest(F.size("dw") - 1, F.lit(first)))))
    if lengths == [SHINGLE]:
        return at.withColumn("hash", shingle_hash(F.col("dw"), F.col("pos"), SHINGLE)).withColumn("len", F.lit(SHINGLE))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("len"), shingle_hash(F.col("dw"), F.col("pos"), n).alias("hash")) for n in lengths]))
    return at.withColumn("s", each).select(*at.columns, "s.len", "s.hash")


def anchored(docs: DataFrame, wins: DataFrame, blocks: int, lengths: list[int]) -> DataFrame:
    """wins with off (zero-based) and hash of its rarest shingle among docs, which have dw, and len, its length."""
    len_ = F.least(F.lit(SHINGLE), F.col("n"))
    offs = wins.select("w", "n", "wid", F.explode(F.sequence(F.lit(0), F.col("n") - len_)).alias("off"), len_.alias("len"))
    hash_ = F.lit(None).cast("long")
    for n in lengths:
        hash_ = F.when(F.col("len") == n, shingle_hash(F.col("w"), F.col("off"), n)).otherwise(hash_)
    offs = offs.withColumn("hash", hash_)
    known = offs.select("hash", "len").distinct()
    at = _positions(docs.select("dw"), lengths, False).select("hash", "len").filter(F.col("hash").isNotNull())
    seen = None
    for b in range(blocks):
        part = known if blocks == 1 else known.filter(F.pmod("hash", F.lit(blocks)) == b)
        met = at.join(F.broadcast(part), ["hash", "len"], "left_semi").groupBy("hash", "len").agg(F.count("*").alias("df"))
        seen = met if seen is None else seen.unionByName(met)
    offs = offs.join(seen, ["hash", "len"])  # a window with a shingle that no document has occurs nowhere
    best = F.min(F.struct("df", "off", "hash")).alias("best")
    full = offs.groupBy("w", "n").agg(best, F.count("*").alias("there"), F.first("wid").alias("wid"), F.first("len").alias("len"))
    full = full.filter(F.col("there") == F.col("n") - F.col("len") + 1)
    return full.select("w", "n", "wid", "len", "best.off", "best.hash")


def occurrences(docs: DataFrame, items: DataFrame, size: int = WINDOW, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """docs (key columns and text) -> a row for each document (pos null) and for each place of a window.

    Columns: the keys, n_words, pos (zero-based first word), n (words of the window), wid (the window's id). And the
    windows, with their wid and items.
    """
    wins = written(windows(items, size), "windows")
    stats = wins.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words"), F.collect_set(F.least(F.lit(SHINGLE), F.col("n"))).alias("lengths")).first()
    keys = [c for c in docs.columns if c != "text"]
    toks = with_words(docs.select(*keys, "text"), "dw")
    if not stats["lengths"]:
        return toks.select(*keys, F.size("dw").cast("long").alias("n_words"), *[F.lit(None).cast(t).alias(c) for c, t in (("pos", "int"), ("n", "int"), ("wid", "long"))]), wins
    lengths = sorted(stats["lengths"])
    blocks = max(1, math.ceil(stats["words"] / block_words))
    anchors = written(anchored(toks, wins, blocks, lengths), "anchors")
    at = _positions(toks, lengths, True)
    out = None
    for b in range(blocks):
        part = anchors if blocks == 1 else anchors.filter(F.pmod("hash", F.lit(blocks)) == b)
        a = F.broadcast(part.withColumnsRenamed({"hash": "a_hash", "len": "a_len"}))
        start = F.col("pos") - F.col("off")
        fits = (start >= 0) & (start + F.col("n") <= F.size("dw"))  # bounds on position and length
        same = F.slice("dw", F.greatest(start, F.lit(0)) + 1, F.col("n")) == F.col("w")
        met = at.join(a, (F.col("hash") == F.col("a_hash")) & (F.col("len") == F.col("a_len")) & fits & same, "left")
        row = (F.col("pos") == -1) & (F.col("len") == lengths[0]) & F.lit(b == 0)
        met = met.filter(F.col("w").isNotNull() | row)
        met = met.select(*keys, F.size("dw").cast("long").alias("n_words"), F.when(F.col("w").isNotNull(), start).alias("pos"), "n", "wid")
        out = met if out is None else out.unionByName(met)
    return out, wins


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, text_hash, copies, n_words, n_hit, n_items, item_ids of each distinct document.

    Rows with the same doc_id and text are one document; copies is their number.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found, wins = occurrences(keyed, items, size, block_words)
    spans = F.array_sort(F.collect_set(F.when(F.col("pos").isNotNull(), F.struct("pos", "n"))))
    one = found.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(F.col("pos").isNull(), 1)).alias("copies"),
        spans.alias("spans"),
        F.collect_set("wid").alias("wids"),
    )
    one = written(one, "contamination")  # a narrow row for each document; read twice
    held = one.select("doc_id", "text_hash", F.explode("wids").alias("wid")).join(wins.select("wid", "items"), "wid")
    held = held.select("doc_id", "text_hash", F.explode("items").alias("item")).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    held = held.withColumnsRenamed({"doc_id": "held_id", "text_hash": "held_hash"})
    one = one.join(held, one["doc_id"].eqNullSafe(held["held_id"]) & (one["text_hash"] == held["held_hash"]), "left").drop("held_id", "held_hash")
    one = one.withColumn("item_ids", F.coalesce("item_ids", F.expr("array()").cast("array<string>")))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit"))

    def step(a: Column, s: Column) -> Column:
        end = s["pos"] + s["n"]
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["hit"] + F.greatest(F.lit(0), end - F.greatest(a["end"], s["pos"]))).alias("hit"))

    hit = F.aggregate("spans", zero, step, lambda a: a["hit"])
    return one.select("doc_id", "text_hash", "copies", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids")


def clean(docs: DataFrame, items: DataFrame, size: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the documents that hold a window of an item."""
    name = free_name(docs, "text_hash")
    bad = contamination(docs, items, size, block_words).filter("n_hit > 0").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash"))
    out = docs.withColumn(name, F.xxhash64("text"))
    same = out["doc_id"].eqNullSafe(bad["bad_id"]) & (out[name] == bad["bad_hash"])
    return out.join(bad, same, "left_anti").drop(name)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("item_ids", ","), 256)
    out = one.select("copies", "doc_id", "n_words", "n_hit", "n_items", ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
    return out.withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).drop("copies")


OP6_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{GAP}'), lambda w: w <> '') AS w FROM documents
), i AS (
  SELECT item_id::VARCHAR AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{GAP}'), lambda w: w <> '') AS w FROM benchmark
), wi AS (
  SELECT DISTINCT item, n, array_to_string(w[p : p + n - 1], ' ') AS k
  FROM (SELECT item, w, least({WINDOW}, len(w)) AS n, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)
), dp AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM wi) WHERE len(w) >= n
), hits AS (
  SELECT r, p, dp.n, item FROM dp JOIN wi ON dp.n = wi.n AND array_to_string(w[p : p + dp.n - 1], ' ') = wi.k
), marked AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r
), found AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (r) LEFT JOIN found USING (r)
"""
