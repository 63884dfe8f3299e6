"""SimHash near-duplicates with BK-trees.

A fingerprint has 64 bits: bit b is 1 if it is set in over half of the hashes of the text's shingles. Fingerprints
within `RADIUS` bits are linked, and linked documents form groups.

A BK-tree keeps each child under its integer Hamming distance from the parent; a query follows only the edges whose
distance lies within the radius of its own distance from the node. One tree over all fingerprints has no size bound
and could not be broadcast, so the trees are built by shard: 64 bits in 4 blocks of 16, and as 2 differing bits touch
2 blocks at most, linked fingerprints agree in 2 whole blocks. Each of the 6 pairs of blocks deals the distinct
fingerprints to shards by the pair's 32 bits, and a shard's tree is built in the task that receives the shard, which
takes the place of broadcasting it; of a shard of two fingerprints, the root and one child, only the one distance is
taken. Shards of more than `HOT` fingerprints are dealt again, by 6 pairs of the 4 bytes
in the other two blocks: what is left then differs in 16 bits only, so no tree exceeds 65,536 nodes.

A shard gives a link from each fingerprint to the smallest one of its tree's group, never all pairs. Groups over all
shards come from passing the smallest doc_id along links until nothing changes, with each round written to the shared
folder. Copies share one fingerprint and take no part in any of it.

Defined results: null and blank texts have fingerprint 0, linked like any other; texts with fewer words than a shingle
have one, the whole sequence; repeated rows each get a row; a null doc_id is never the id of a group with another one;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import UPPER, free_name, table, written

SHINGLE = 3
RADIUS = 2
SEED = 42
HOT = 4096
LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


# -- fingerprints ---------------------------------------------------------------------------------------------


def _bits(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def fingerprint(text: bytes, n: int = SHINGLE, seed: int = SEED) -> int:
    words = text.translate(LOWER).split()  # splits at the six white-space characters
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= n:
        return digest(b" ".join(words), seed)
    total, count = np.zeros(64, np.int64), len(words) - n + 1
    for at in range(0, count, 1 << 16):  # so that a long text's shingles are never there all at once
        part = words[at : at + (1 << 16) + n - 1]
        hashes = [digest(b" ".join(w), seed) for w in zip(*[part[k:] for k in range(n)])]
        total += _bits(np.array(hashes, np.uint64))
    high = total * 2 > count
    return int.from_bytes(np.packbits(high, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, n: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of each row; key columns beside doc_id stay."""
    ship(docs.sparkSession)
    keys = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text").cast(pa.large_binary()).to_pylist()
            fp = np.array([fingerprint(t or b"", n, seed) for t in text], np.uint64)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keys], pa.array(fp.view(np.int64))], [*keys, "fp"])

    return docs.select(*[f"`{c}`" for c in keys], "text").mapInArrow(each, f"{kinds}, fp long")


# -- BK-trees -------------------------------------------------------------------------------------------------


class BKTree:
    """Fingerprints by distance from their parents; node k is the k-th added."""

    def __init__(self, radius: int = RADIUS):
        self.radius, self.value, self.edges = radius, [], []

    def add(self, x: int) -> list[int]:
        """Add x as a node; the nodes within the radius of it. Only edges within the radius are followed."""
        new, near = len(self.value), []
        self.value.append(x)
        self.edges.append({})
        if not new:
            return near
        node, home = 0, None
        queue = [0]
        d = (x ^ self.value[0]).bit_count()
        while True:  # where it goes
            nxt = self.edges[node].get(d)
            if nxt is None:
                home = (node, d)
                break
            node = nxt
            d = (x ^ self.value[node]).bit_count()
        while queue:
            at = queue.pop()
            d = (x ^ self.value[at]).bit_count()
            if d <= self.radius:
                near.append(at)
            edges = self.edges[at]
            if edges:
                for k in range(max(0, d - self.radius), d + self.radius + 1):
                    if k in edges:
                        queue.append(edges[k])
        self.edges[home[0]][home[1]] = new
        return near


def groups(values: list[int], radius: int = RADIUS) -> list[int]:
    """For each value the index of the first value of its group, groups being what links of the radius connect."""
    tree, head = BKTree(radius), list(range(len(values)))

    def find(k: int) -> int:
        while head[k] != k:
            head[k] = head[head[k]]
            k = head[k]
        return k

    for k, x in enumerate(values):
        for near in tree.add(x):
            a, b = find(k), find(near)
            if a != b:
                head[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(values))]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, fp) sorted by both -> links from each fingerprint to the first of its group in the shard."""
    rest_s, rest_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def links(shard: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(shard)))
        src, dst = [], []
        two = start[size == 2]  # most shards with links have two fingerprints
        if len(two):
            a, b = fp[two], fp[two + 1]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= RADIUS
            src.append(b[near])
            dst.append(a[near])
        for s, n in zip(start[size > 2], size[size > 2], strict=True):
            own = fp[s : s + n]
            head = np.array(groups(own.view(np.uint64).tolist()))
            moved = head != np.arange(n)
            src.append(own[moved])
            dst.append(own[head[moved]])
        none = [np.zeros(0, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(src or none)), pa.array(np.concatenate(dst or none))], ["src", "dst"])

    for b in batches:
        shard, fp = (np.concatenate([r, b.column(c).to_numpy(zero_copy_only=False)]) for r, c in ((rest_s, "shard"), (rest_f, "fp")))
        cut = int(np.searchsorted(shard, shard[-1])) if len(shard) else 0  # the last shard may go on in the next batch
        yield links(shard[:cut], fp[:cut])
        rest_s, rest_f = shard[cut:], fp[cut:]
    yield links(rest_s, rest_f)


def _part(fp: Column, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << bits) - 1))


def shards(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Distinct fp -> shard and fp: 6 rows for each, or 36 where a shard is hot."""
    pairs = list(combinations(range(4), 2))
    key = F.array(*[F.struct(F.lit(k).alias("pair"), (_part(F.col("fp"), 16 * a, 16) * 65536 + _part(F.col("fp"), 16 * b, 16)).alias("key")) for k, (a, b) in enumerate(pairs)])
    dealt = fps.select("fp", F.explode(key).alias("k")).select("fp", "k.pair", "k.key")
    large = dealt.groupBy("pair", "key").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("pair", "key", F.lit(True).alias("hot"))
    dealt = dealt.join(large, ["pair", "key"], "left")
    again = F.lit(None).cast("array<bigint>")
    for k, (a, b) in enumerate(pairs):
        others = [16 * c + 8 * h for c in range(4) if c not in (a, b) for h in range(2)]
        part = F.array(*[(F.lit(j + 1) * 65536 + _part(F.col("fp"), x, 8) * 256 + _part(F.col("fp"), y, 8)).cast("long") for j, (x, y) in enumerate(combinations(others, 2))])
        again = F.when(F.col("pair") == k, part).otherwise(again)
    sub = F.explode(F.when(F.col("hot"), again).otherwise(F.array(F.lit(0).cast("long"))))
    dealt = dealt.withColumn("sub", sub)
    # pair (3 bits), key (32) and sub (19) side by side.
    return dealt.select((F.shiftleft(F.col("pair").cast("long"), 51) + F.shiftleft(F.col("key"), 19) + F.col("sub")).alias("shard"), "fp")


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Distinct fp -> src and dst: enough links to connect all fingerprints within the radius of one another."""
    ship(fps.sparkSession)
    dealt = shards(fps, hot)
    return dealt.repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(_linked, "src long, dst long").distinct()


# -- groups ---------------------------------------------------------------------------------------------------


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and id of nodes on edges, and links (src, dst) between them -> node and the smallest id it can reach.

    Each round takes the smallest id among a node and its neighbours, and then that of the node this id came from, so
    that ids travel twice as far each round. Minima are partly aggregated before the shuffle, however many links a
    node has.
    """
    both = written(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "links")
    ends = both.select(F.col("src").alias("node")).distinct()
    # best is (id, node it comes from); a node without an id comes after all with one.
    label = nodes.join(ends, "node", "left_semi").select("node", F.struct(F.col("id").isNull().alias("none"), "id", F.col("node").alias("of")).alias("best"))
    label = written(label, "labels")
    while True:
        near = both.join(label.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "best")
        low = label.unionByName(near).groupBy("node").agg(F.min("best").alias("best"))
        via = label.select(F.col("node").alias("of"), F.col("best").alias("further"))
        jump = low.withColumn("of", F.col("best.of")).join(via, "of", "left").select("node", F.least("best", F.coalesce("further", "best")).alias("best"))
        jump = written(jump, "labels")
        changed = jump.join(label.withColumnRenamed("best", "before"), "node").filter(F.col("best") != F.col("before")).limit(1).count()
        label = jump
        if not changed:
            return label.select("node", F.col("best.id").alias("id"))


def grouped(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, fp and further columns (written, as they are read twice) -> the same with component_id."""
    ids = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    found = written(links(ids.select("fp"), hot), "links")
    reach = components(ids.select(F.col("fp").alias("node"), F.col("least").alias("id")), found)
    ids = ids.join(reach.select(F.col("node").alias("fp"), "id", F.lit(True).alias("linked")), "fp", "left")
    ids = ids.select("fp", F.when(F.col("linked"), F.col("id")).otherwise(F.col("least")).alias("component_id"))
    ids = written(ids, "groups")  # so that both sides of the next join come from plain scans and a hot fp can be split
    return prints.join(ids, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) of each row of docs (doc_id and text)."""
    return grouped(written(fingerprints(docs.select("doc_id", "text")), "fingerprints"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each group: the first row of the group's smallest doc_id."""
    key, order, fp_ = free_name(docs, "text_hash"), free_name(docs, "copy_rank"), free_name(docs, "fp")
    prints = written(fingerprints(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")), "fingerprints")
    out = grouped(prints)
    # The group's document: smallest doc_id, then smallest hash; a narrow row for each group.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    # Groups whose documents have no ids are told apart by their fingerprint.
    chosen = out.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias(fp_)).agg(first.alias("c"))
    chosen = chosen.select(F.col("c.doc_id").alias("keep_id"), F.col("c.text_hash").alias("keep_hash")).distinct()
    rows = docs.withColumn(key, F.xxhash64("text"))
    rows = rows.join(chosen, rows["doc_id"].eqNullSafe(chosen["keep_id"]) & (rows[key] == chosen["keep_hash"]), "left_semi")
    rank = F.row_number().over(Window.partitionBy("doc_id", key).orderBy(key))
    return rows.withColumn(order, rank).filter(F.col(order) == 1).drop(order, key)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
