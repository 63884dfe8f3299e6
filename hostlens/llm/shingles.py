"""Near copies by similarity: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Of two such sets, put into one order, the first shingle they share is among the first n - ceil(0.8 n) + 1 of each. So
each distinct set deals out only these (its prefix), pairs that meet at a shingle are candidates where their sizes and
shared shingles still allow 0.8, and each one left is confirmed on its whole sets: the pairs found are all there are.
Any order will do; shingles that are common in a sample of texts come last, so that few pairs meet at them.

Groups of many near copies would make a candidate of every two of their sets. So a first pass takes the links of SimHash
fingerprints of these shingles (`simhash.links`), and deals each set out by `BANDS` pairs of its minima under hash
functions and pairs it with the first and the one before it of the same band; what of this is confirmed has a label in
common. The second pass, which misses nothing, makes candidates only of sets with
different labels, and of none whose folded parities already tell them apart. Candidates meet the sets' parities then, a bit or two for each shingle: they differ in no more bits
than the sets do in shingles, so what differs in too many is not similar, and only the texts of the rest are read again. At a shingle where a set still has more than `FEW` of these it tries that many first, and only what
they leave apart is paired fully: pairs grow with what differs, not with the square of a group.

Defined results: null and blank texts have one shingle, the empty one, and are copies of one another; texts with fewer
words than a shingle have one, the whole sequence; of repeated rows one stays; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import free_name, written
from . import simhash
from .simhash import LOWER, SEED, components

WORDS = 5
BANDS = 3
FEW = 12
WIDE = 8
LINKS = 500_000
SAMPLE = 20_000
COMMON = 200_000
SENT = 200_000  # row digests that are broadcast at most
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.translate(LOWER).split()
    digest = xxhash.xxh64_intdigest
    if len(words) < WORDS:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    w = np.array([digest(x, SEED) for x in words], np.uint64)
    n = len(w) - WORDS + 1
    h = np.zeros(n, np.uint64)
    for k, m in enumerate(MIX):
        h += (w[k : k + n] ^ (w[k : k + n] >> np.uint64(29))) * m
    h ^= h >> np.uint64(32)
    return np.unique(h * MIX[0])


def bands(s: np.ndarray) -> np.ndarray:
    """A hash for each band: of two minima of the set, which sets of a similarity of 0.8 share in two of three cases."""
    low = []
    for k in range(2 * BANDS):
        x = s * (MIX[k % 5] + np.uint64(2 * k))
        low.append((x ^ (x >> np.uint64(31))).min())
    m = np.array(low, np.uint64)
    return (m[::2] * MIX[1] ^ m[1::2]) * MIX[2] + np.arange(BANDS, dtype=np.uint64)


def parity(s: np.ndarray) -> np.ndarray:
    """Which residues of the shingles are odd in number: bits, as many as the least power of two (64 or more) >= len(s)."""
    m = max(64, 1 << (len(s) - 1).bit_length())
    odd = (np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def wide(s: np.ndarray) -> np.ndarray:
    """As parity, in WIDE words of 64 bits whatever the size; XOR of them has the residues modulo 64."""
    odd = (np.bincount((s & np.uint64(64 * WIDE - 1)).astype(np.int64), minlength=64 * WIDE) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def folded(s: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduce(wide(s), keepdims=True)


def fingerprint(s: np.ndarray) -> np.uint64:
    """SimHash of a set: the bits that over half of its shingles have."""
    ones = np.unpackbits(s.view(np.uint8).reshape(len(s), 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(s)).view(np.uint64)[0]


def possible(pa: Column, pb: Column, a: Column, b: Column) -> Column:
    """Whether sets of a and b shingles with these parities can be similar: at most (a + b) / 9 of both are in one only.

    Sizes that allow a similarity of 0.8 are so near that one parity is at most twice as long as the other.
    """

    def half(p: Column) -> Column:
        k = (F.size(p) / 2).cast("int")
        return F.zip_with(F.slice(p, F.lit(1), k), F.slice(p, k + 1, k), lambda x, y: x.bitwiseXOR(y))

    na, nb = F.size(pa), F.size(pb)
    x, y = F.when(na > nb, half(pa)).otherwise(pa), F.when(nb > na, half(pb)).otherwise(pb)
    bits = F.aggregate(F.zip_with(x, y, lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda n, v: n + v)
    return (5 * F.least(a, b) >= 4 * F.greatest(a, b)) & (9 * bits <= a + b)


def similar(both: Column, a: Column, b: Column) -> Column:
    """Whether sets of a and b shingles that share `both` have a similarity of 0.8: both >= 0.8 (a + b - both)."""
    return 9 * both >= 4 * (a + b)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            b = batch.slice(k, 256)
            yield b, [shingles(t or b"") for t in b.column("text").cast(pa.large_binary()).to_pylist()]


def _lists(values: list[np.ndarray]) -> pa.Array:
    at = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(values).view(np.int64)))


def common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur in several of about SAMPLE texts, sorted, and in how many: COMMON of them at most."""
    every = max(1, docs.count() // SAMPLE)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _texts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["h"])

    # By the row's digest, so that a text with many copies is seen in proportion.
    some = docs.filter(F.pmod("rid", F.lit(every)) == 0).select("text").mapInArrow(each, "h long")
    top = some.groupBy("h").agg(F.count("*").alias("n")).filter("n > 2").orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefixes(docs: DataFrame) -> DataFrame:
    """rid, doc_id, sid (a digest of the set), size, prefix, bands, parity, folded parity and fingerprint of each row of docs (rid, doc_id, text)."""
    ship(docs.sparkSession)
    often, times = common(docs)

    def prefix(s: np.ndarray) -> np.ndarray:
        n = len(s) - (4 * len(s) + 4) // 5 + 1
        if len(often):
            k = np.minimum(np.searchsorted(often, s), len(often) - 1)
            rank = np.where(often[k] == s, times[k], 0)
            s = s[np.argsort(rank, kind="stable")]
        return s[:n]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in _texts(batches):
            sid = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in found], np.uint64).view(np.int64)
            size = pa.array([len(s) for s in found], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("rid"), b.column("doc_id"), pa.array(sid), size, *(_lists([f(s) for s in found]) for f in (prefix, bands, parity, folded, wide)), pa.array(np.array([fingerprint(s) for s in found], np.uint64).view(np.int64))],
                ["rid", "doc_id", "sid", "size", "prefix", "bands", "parity", "fold", "wide", "fp"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(each, f"rid long, doc_id {kind}, sid long, size int, prefix array<long>, bands array<long>, parity array<long>, fold array<long>, wide array<long>, fp long")


MET = "h long, a long, b long, need int"


def _met(batches: Iterator[pa.RecordBatch], how: str) -> Iterator[pa.RecordBatch]:
    """Rows (h, size, left, sid, label, fold) sorted by h, size and sid -> candidate pairs a < b with different labels.

    left is how many shingles a set has from this one on, in an order that all sets have in common: two sets that do not
    share an earlier one share at most the less of theirs. fold refuses pairs that differ in too many shingles.

    how: "near" pairs a set with the first and the one before it of its h only; "last" makes all pairs that can share
    what they must.
    "few" makes them where a set has at most FEW, with the number of shingles that the two prefixes must share as need;
    else FEW of them with a need of 0, and the sets of this h again as rows with a = b and their size as need.
    """
    names = ("h", "size", "left", "sid", "label")
    rest = [np.zeros(0, np.int64)] * 5 + [np.zeros((0, WIDE if how == "last" else 1), np.int64)]

    def rows(h, a, b, need) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(a), pa.array(b), pa.array(need.astype(np.int32))], ["h", "a", "b", "need"])

    def needed(size, x, y) -> np.ndarray:
        """How many shingles the prefixes must share: what is shared beyond them lies in the rest of one of the two."""
        return (4 * (size[x] + size[y]) + 8) // 9 - ((4 * np.maximum(size[x], size[y]) + 4) // 5 - 1)

    def close(size, fold, x, y) -> np.ndarray:
        return 9 * np.bitwise_count((fold[x] ^ fold[y]).view(np.uint64)).sum(1, dtype=np.int64) <= size[x] + size[y]

    def out(h, size, sid, fold, x, y, tried) -> pa.RecordBatch:
        good = (5 * np.minimum(size[x], size[y]) >= 4 * np.maximum(size[x], size[y])) & close(size, fold, x, y)
        x, y, tried = x[good], y[good], tried[good]
        return rows(h[x], np.minimum(sid[x], sid[y]), np.maximum(sid[x], sid[y]), np.where(tried, 0, needed(size, x, y)))

    def pairs(h, size, left, sid, label, fold) -> Iterator[pa.RecordBatch]:
        new = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        n = np.diff(np.append(start, len(h)))
        if how == "near":
            own = np.flatnonzero(~new)
            first = np.repeat(start, n)[own]
            yield out(h, size, sid, fold, np.append(own, own), np.append(own - 1, first), np.zeros(2 * len(own), bool))
            return
        two = start[n == 2]
        two = two[label[two] != label[two + 1]]
        if how == "last":
            two = two[np.minimum(left[two], left[two + 1]) >= needed(size, two, two + 1)]
        xs, ys, free, held = [two + 1], [two], [np.zeros(len(two), bool)], 0
        for s, m in zip(start[n > 2], n[n > 2], strict=True):
            kinds, where, count = np.unique(label[s : s + m], return_inverse=True, return_counts=True)
            if len(kinds) == 1:
                continue
            # The sets of the largest label meet all others, and those each other; sizes rise, so near ones lie together.
            most, crowd = count.argmax(), False
            other = np.flatnonzero(where != most)
            low = np.searchsorted(size[s : s + m] * 5, size[s + other] * 4)
            high = np.searchsorted(size[s : s + m] * 4, size[s + other] * 5, "right")
            for k, i, j in zip(other, low, high, strict=True):
                c = np.arange(i, j)
                c = c[(where[c] != where[k]) & ((where[c] == most) | (c < k))]
                c = c[close(size, fold, s + c, np.full(len(c), s + k))]
                tried = how == "few" and len(c) > FEW
                if tried or how == "last":
                    c = c[np.minimum(left[s + c], left[s + k]) >= needed(size, s + c, s + k)]
                if tried:
                    crowd = True
                    c = c[np.unique(np.linspace(0, len(c) - 1, FEW).astype(int))] if len(c) else c
                xs.append(np.full(len(c), s + k))
                ys.append(s + c)
                free.append(np.full(len(c), tried))
                held += len(c)
                if held > 1 << 18:
                    yield out(h, size, sid, fold, np.concatenate(xs), np.concatenate(ys), np.concatenate(free))
                    xs, ys, free, held = [], [], [], 0
            if crowd:
                own = slice(s, s + m)
                yield rows(h[own], sid[own], sid[own], size[own])
        if xs:
            yield out(h, size, sid, fold, np.concatenate(xs), np.concatenate(ys), np.concatenate(free))

    for b in batches:
        own = [b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
        own.append(b.column("fold").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else rest[-1][:0])
        cols = [np.concatenate(x) for x in zip(rest, own, strict=True)]
        cut = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0  # the last shingle may go on
        yield from pairs(*[c[:cut] for c in cols])
        rest = [c[cut:] for c in cols]
    yield from pairs(*rest)


def _dealt(rows: DataFrame, how: str) -> DataFrame:
    rows = rows.select("h", "size", "left", "sid", "label", "fold")
    return rows.repartition("h").sortWithinPartitions("h", "size", "sid").mapInArrow(lambda b: _met(b, how), MET)


def _fingerprinted(sets: DataFrame) -> DataFrame:
    """Candidate pairs a < b of sets with equal fingerprints or such as simhash.links connects; linear in the sets."""
    own = sets.select("sid", "fp")
    heads = written(own.groupBy("fp").agg(F.min("sid").alias("head")), "fingerprints")
    found = simhash.links(heads.select("fp"))
    side = lambda c, x: heads.select(F.col("fp").alias(c), F.col("head").alias(x))
    linked = found.join(side("src", "x"), "src").join(side("dst", "y"), "dst").select("x", "y")
    same = own.join(heads, "fp").filter("sid <> head").select("sid", "head")
    return linked.union(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _sets(docs: DataFrame) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in _texts(batches):
            yield pa.RecordBatch.from_arrays([b.column("sid"), _lists(found)], ["sid", "hs"])

    return docs.select("sid", "text").mapInArrow(each, "sid long, hs array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """src and dst of the candidate pairs (a, b) with a similarity of 0.8; only their texts are read as sets again."""
    sketch = lambda c: sets.select(F.col("sid").alias(c), F.col("size").alias(f"n{c}"), F.col("parity").alias(f"p{c}"))
    pairs = pairs.select("a", "b").distinct().join(sketch("a"), "a").join(sketch("b"), "b")
    pairs = written(pairs.filter(possible(F.col("pa"), F.col("pb"), F.col("na"), F.col("nb"))).select("a", "b"), "candidates")
    some = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(sets, "sid").select("sid", F.col("first.rid").alias("rid"))
    some = written(some, "candidates")
    some = F.broadcast(some) if some.count() <= SENT else some
    # A repeated row comes more than once; its set is needed once.
    whole = written(_sets(texts.join(some, "rid")).dropDuplicates(["sid"]), "shingles")
    side = lambda c, h: whole.select(F.col("sid").alias(c), F.col("hs").alias(h))
    out = pairs.join(side("a", "ha"), "a").join(side("b", "hb"), "b")
    out = out.filter(similar(F.size(F.array_intersect("ha", "hb")), F.size("ha"), F.size("hb")))
    return written(out.select(F.col("a").alias("src"), F.col("b").alias("dst")), "links")


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (src, dst) -> as many as connect the same: from each node to the least one it reaches by LINKS of them."""

    def least(ends: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(ends, return_inverse=True)
        x, y = at.reshape(2, -1)
        low = np.arange(len(nodes))
        while True:
            before = low.copy()
            both = np.minimum(low[x], low[y])
            np.minimum.at(low, x, both)
            np.minimum.at(low, y, both)
            low = low[low]
            if np.array_equal(low, before):
                break
        moved = low != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[low[moved]])], ["src", "dst"])

    held, n = [], 0
    for b in batches:
        held.append(np.stack([b.column("src").to_numpy(), b.column("dst").to_numpy()]))
        n += b.num_rows
        if n >= LINKS:
            yield least(np.concatenate(held, 1))
            held, n = [], 0
    if held:
        yield least(np.concatenate(held, 1))


def contracted(links: DataFrame) -> DataFrame:
    """links (written) without most of those that others make needless, so that groups are found in few rounds."""
    n = links.count() // LINKS + 1  # tasks of about LINKS rows
    return links.select("src", "dst").coalesce(n).mapInArrow(_contracted, "src long, dst long")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each group that pairs of a similarity of 0.8 connect: the one of smallest doc_id."""
    rid, rank, check = free_name(docs, "rid"), free_name(docs, "copy_rank"), free_name(docs, "rid_check")
    own = F.xxhash64("doc_id", "text")
    texts = docs.select(own.alias("rid"), "doc_id", "text")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")
    sets = prefixes(texts).groupBy("sid").agg(first, *[F.any_value(c).alias(c) for c in ("size", "prefix", "bands", "parity", "fold", "wide", "fp")])
    sets = written(sets, "shingles")
    nodes = sets.select(F.col("sid").alias("node"), F.col("sid").alias("id"))
    rows = sets.select("sid", "size", F.explode("bands").alias("h"), F.lit(0).alias("left"), F.col("sid").alias("label"), "fold")
    near = _dealt(rows, "near").select("a", "b").union(_fingerprinted(sets))
    links = contracted(_confirmed(near, sets, texts))
    reach = components(nodes, links)

    def labelled(x: DataFrame, *columns: str) -> DataFrame:
        labels = reach.select(F.col("node").alias("of"), F.col("id").alias("label"))
        return x.join(labels, F.col("sid") == F.col("of"), "left").select("sid", "size", F.coalesce("label", "sid").alias("label"), *columns)

    def further(more: DataFrame) -> DataFrame:
        if not more.limit(1).count():
            return reach
        return components(nodes, reach.filter("node <> id").select(F.col("node").alias("src"), F.col("id").alias("dst")).union(contracted(more)))

    rows = labelled(sets.select("sid", "size", "prefix", "fold"), "prefix", "fold").select("*", F.posexplode("prefix").alias("pos", "h")).withColumn("left", F.size("prefix") - F.col("pos"))
    met = written(_dealt(rows, "few"), "candidates")
    crowd = met.filter("a = b").select("h", F.col("need").alias("size"), F.col("a").alias("sid"))
    # Pairs share what they share where they were made, and at most all their crowded shingles.
    busy = written(crowd.groupBy("sid").agg(F.count("*").alias("n")), "candidates")
    side = lambda c: busy.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"))
    pairs = met.filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"), F.min("need").alias("need"))
    pairs = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    pairs = pairs.filter(F.col("n") + F.least(F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))) >= F.col("need"))
    reach = further(_confirmed(pairs, sets, texts))
    if busy.limit(1).count():
        # What is left shares crowded shingles only, and enough of them: ordered by rarity they bound what follows.
        often = crowd.groupBy("h").agg(F.count("*").alias("df"))
        order = Window.partitionBy("sid").orderBy("df", "h")
        ranked = crowd.join(busy, "sid").join(often, "h").withColumn("left", (F.col("n") - F.row_number().over(order) + 1).cast("int"))
        ranked = ranked.join(sets.select("sid", F.col("wide").alias("fold")), "sid")  # few rows, so the wide parities
        reach = further(_confirmed(_dealt(labelled(ranked, "h", "left", "fold"), "last"), sets, texts))
    chosen = sets.join(reach.withColumnRenamed("node", "sid"), "sid", "left").groupBy(F.coalesce("id", "sid").alias("group")).agg(F.min("first").alias("first"))
    out = docs.withColumn(rid, own).join(chosen.select(F.col("first.rid").alias(rid)), rid, "left_semi")
    # Repeated rows go here; another hash tells rows apart whose rid is the same by chance.
    out = out.withColumn(check, F.xxhash64(F.lit(1), "doc_id", "text"))
    out = out.withColumn(rank, F.row_number().over(Window.partitionBy(rid, check).orderBy(rid))).filter(F.col(rank) == 1)
    return out.select(*[f"`{c}`" for c in docs.columns])
