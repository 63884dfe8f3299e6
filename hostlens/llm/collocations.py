"""Phrases that stand together more often than their parts: counted level by level, scored by their weakest cut.

Texts are split into pieces at punctuation and line ends, pieces into words. Level k counts the phrases of k words;
since a phrase occurs no more often than any part of it, a phrase of level k is only put together where both phrases of
k - 1 words in it are frequent. The frequent ones are sent to the tasks as a bit filter of at most `FILTER_BITS` bits:
it lets through all of them and a few others, which the exact counts of the level then refuse, so its bound costs time
and never a result. Tasks count before they send, holding at most `MOST_HELD` phrases at a time.

A candidate's cuts are looked up in the level tables: both sides of a cut of a frequent phrase are frequent themselves.
The first words of many phrases are the same few, so that join is left to Spark, which splits hot keys; all further
steps are aggregations and a top-k of each language in two steps, the first on slices of the language.

Defined results: null texts are empty; a null language is `und`, together with documents that say so; empty texts and
tables give nothing; repeated rows count each; texts, pieces and words of any length are read whole, a slice at a time.
Only text and language are read, so further columns of any name stay out of the way.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import UPPER, table, written
from .textbytes import utf8

SLICE = 1 << 20  # bytes of a text that are split at a time
AT_ONCE = 1 << 20  # bytes of a language's texts that are counted at a time
MOST_HELD = 400_000  # phrases that a task counts before it sends their counts
FILTER_BITS = 1 << 28  # 32 MB
SLICES = 64  # of a language, for its best phrases


@dataclass(frozen=True)
class Phrases:
    """Phrases of 2 to `longest` words with `least` occurrences; `covered` percent of them inside one longer phrase drop
    a phrase; the first `top` of each language count."""

    longest: int = 4
    least: int = 30
    covered: int = 80
    top: int = 2000


# -- words ------------------------------------------------------------------------------------------------------------


def _plain() -> bytes:
    """Letters A-Z lower-cased, the ends of pieces a line end, tabs a space."""
    out = bytearray(range(256))
    out[65:91] = range(97, 123)
    for b in b".,;:!?\x0a\x0b\x0c\x0d":
        out[b] = 10
    out[9] = 32
    return bytes(out)


PLAIN = _plain()
_GAP = re.compile(b"[ \n]")
END = b"\n"  # stands as a word at the end of a piece


def parts(text: bytes, k: int) -> Iterator[bytes]:
    """A text as PLAIN has it, in parts that together hold each phrase of k words once.

    A part ends at the first gap at or after SLICE bytes; where a piece goes on, the next part begins with the piece's
    last k - 1 words."""
    plain = text.translate(PLAIN)
    if len(plain) <= SLICE:
        yield plain
        return
    at, tail = 0, b""
    while at < len(plain):
        cut = _GAP.search(plain, at + SLICE)
        end = cut.start() if cut else len(plain)
        part = tail + plain[at:end]
        yield part
        words = part.rpartition(END)[2].split()
        tail = b" ".join(words[max(0, len(words) - k + 1) :])
        at = end


def words_of(plain: bytes) -> list[bytes]:
    """The words, and an END for each end of a piece."""
    return list(filter(None, plain.replace(END, b" \n ").split(b" ")))


def digests(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_END = np.uint64(xxhash.xxh3_64_intdigest(END))


def phrase_digests(words: np.ndarray, k: int, lang: str) -> np.ndarray:
    """A digest of every k consecutive words, from the words' digests."""
    n = max(0, len(words) - k + 1)
    h = np.full(n, xxhash.xxh3_64_intdigest(lang.encode()), np.uint64)
    for j in range(k):
        h = (h ^ words[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


# -- the filter of frequent phrases -----------------------------------------------------------------------------------


class Frequent:
    """A bit filter: two bits for each phrase; all that were added are found, and few others."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.mask = np.uint64(64 * len(bits) - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        return self._bit(h & self.mask) & self._bit((h >> np.uint64(32)) & self.mask)

    def _bit(self, at: np.ndarray) -> np.ndarray:
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def frequent_filter(level: DataFrame, k: int) -> Frequent:
    """The filter of a level's phrases, put together from the bits that tasks find; 16 bits a phrase, within the bound."""
    size = 1 << 12
    wanted = 16 * level.count()
    while size < wanted and size < FILTER_BITS:
        size *= 2

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.array([phrase_digests(digests(p.encode().split(b" ")), k, lang)[0] for lang, p in zip(b.column("lang").to_pylist(), b.column("phrase").to_pylist(), strict=True)], np.uint64)
            at = np.concatenate([h & np.uint64(size - 1), (h >> np.uint64(32)) & np.uint64(size - 1)])
            block, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
            out = np.zeros(len(block), np.uint64)
            np.bitwise_or.at(out, inverse, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int64)), pa.array(out.view(np.int64))], ["block", "bits"])

    got = level.select("lang", "phrase").mapInArrow(bits, "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)  # the rows are at most as many as this has
    out[got.column("block").to_numpy()] = got.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return Frequent(out)


# -- levels -----------------------------------------------------------------------------------------------------------


class Counts:
    """Phrase counts of a task, by language, given out whenever they are many."""

    def __init__(self, k: int, known: Frequent | None):
        self.k, self.known = k, known
        self.counts: dict[str, Counter] = defaultdict(Counter)
        self.waiting: dict[str, list[bytes]] = defaultdict(list)
        self.size: Counter = Counter()

    def add(self, lang: str, part: bytes) -> None:
        self.waiting[lang].append(part)
        self.size[lang] += len(part)
        if self.size[lang] >= AT_ONCE:
            self.count(lang)

    def count(self, lang: str) -> None:
        k, counts = self.k, self.counts[lang]
        words = words_of(END.join(self.waiting.pop(lang, [])))
        self.size[lang] = 0
        if self.known is None:
            counts.update(words)
            counts[None] += len(words) - counts.pop(END, 0)
            return
        own = digests(words)
        part = self.known.has(phrase_digests(own, k - 1, lang))
        n = len(words) - k + 1
        if n > 0:
            due = part[:n] & part[1 : n + 1]
            inner = own != _END
            for j in range(k):
                due &= inner[j : j + n]
            counts.update([b" ".join(words[i : i + k]) for i in np.flatnonzero(due).tolist()])

    def many(self) -> bool:
        return sum(map(len, self.counts.values())) >= MOST_HELD

    def give(self) -> Iterator[pa.RecordBatch]:
        for lang in list(self.waiting):
            self.count(lang)
        for lang, c in self.counts.items():
            if c:
                phrases = pa.array(list(c), pa.binary()).view(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), phrases, pa.array(list(c.values()), pa.int64())], ["lang", "phrase", "n"])
        self.counts.clear()


def level(docs: DataFrame, k: int, known: Frequent | None, least: int) -> DataFrame:
    """lang, phrase, n of the phrases of k words with n >= least; at k = 1 also, with a null phrase, all words of lang.

    docs: lang (not null) and text. known: the filter of the phrases of k - 1 words, from k = 2 on."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counts(k, sent.value)
        for b in batches:
            data, at = utf8(b.column("text"))
            for lang, a, e in zip(b.column("lang").to_pylist(), at[:-1], at[1:], strict=True):
                for part in parts(data[a:e].tobytes(), k):
                    found.add(lang, part)
                if found.many():
                    yield from found.give()
        yield from found.give()

    counted = docs.select("lang", "text").mapInArrow(count, "lang string, phrase string, n long")
    return counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | F.col("phrase").isNull())


def levels(docs: DataFrame, most: Phrases) -> tuple[DataFrame, list[DataFrame]]:
    """lang and n (all words), and the tables of the frequent phrases of 1, 2, … words."""
    first = written(level(docs, 1, None, most.least), "words")
    found = [first.filter("phrase IS NOT NULL")]
    for k in range(2, most.longest + 1):
        found.append(written(level(docs, k, frequent_filter(found[-1], k - 1), most.least), f"phrases-{k}"))
    return first.filter("phrase IS NULL").select("lang", "n"), found


# -- scores -----------------------------------------------------------------------------------------------------------


def _slice(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.concat_ws(" ", F.slice(words, start, length))


def scored(found: list[DataFrame], most: Phrases) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer candidate covers."""
    candidates = reduce(DataFrame.unionByName, found[1:]).withColumn("words", F.split("phrase", " ")).withColumnRenamed("n", "a")
    size = F.size("words")
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    sides = F.array(F.struct(F.lit(0).alias("side"), _slice(F.col("words"), 1, F.col("k")).alias("part")), F.struct(F.lit(1).alias("side"), _slice(F.col("words"), F.col("k") + 1, size).alias("part")))
    halves = cuts.select("lang", "phrase", "a", "k", F.inline(sides))
    known = reduce(DataFrame.unionByName, found[:-1]).select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    none = lambda *names: [F.lit(None).cast("long").alias(c) for c in names]
    looked_up = halves.join(known, ["lang", "part"]).select("lang", "phrase", "a", "k", "side", "f", *none("cover"))
    # Every shorter phrase of two words or more inside a candidate, with the candidate's count.
    inside = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda s: F.transform(F.sequence(F.lit(1), size - s + 1), lambda p: _slice(F.col("words"), p, s))))
    covers = candidates.filter(size > 2).select("lang", F.explode(inside).alias("phrase"), *none("a", "k", "side", "f"), F.col("a").alias("cover"))
    side = lambda k, s: F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f")))
    ks = range(1, most.longest)
    met = looked_up.unionByName(covers).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("cover").alias("cover"), *[side(k, s).alias(f"{n}{k}") for k in ks for s, n in ((0, "l"), (1, "r"))])
    # Decimals, as the product may pass 64 bits; div cuts to whole numbers without rounding.
    score = lambda k: F.expr(f"(cast(a AS decimal(20, 0)) * 2000000) div (cast(l{k} AS decimal(20, 0)) + cast(r{k} AS decimal(20, 0)))")
    each = F.array(*[F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in ks])
    kept = F.col("a").isNotNull() & ~F.coalesce(F.col("cover").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * most.covered, F.lit(False))
    out = met.filter(kept).withColumn("cut", F.array_min(each))
    return out.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))


def best(rows: DataFrame, top: int) -> DataFrame:
    """The first `top` of each language with their rank: of each slice of a language first, then of what is left."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    first = Window.partitionBy("lang", "_slice").orderBy(*order)
    rows = rows.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    rows = rows.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= top).drop("_n", "_slice")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, most: Phrases = Phrases()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language of docs (text, lang)."""
    own = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    totals, found = levels(own, most)
    out = best(scored(found, most), most.top).join(totals, "lang")
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def _sql(most: Phrases = Phrases()) -> str:
    """The same in SQL: all phrases are counted, then those that are frequent kept."""
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS size, unnest(list_transform(range(1, len(words) - {k} + 2), lambda i: array_to_string(words[i:i + {k - 1}], ' '))) AS phrase FROM w" for k in range(1, most.longest + 1)
    )
    subs = " UNION ALL ".join(
        f"SELECT lang, array_to_string(words[{p}:{p + s - 1}], ' ') AS phrase, a FROM c WHERE size = {k}" for k in range(3, most.longest + 1) for s in range(2, k) for p in range(1, k - s + 2)
    )
    cuts = " UNION ALL ".join(f"SELECT lang, phrase, a, {k} AS k, array_to_string(words[1:{k}], ' ') AS lp, array_to_string(words[{k + 1}:], ' ') AS rp FROM c WHERE size > {k}" for k in range(1, most.longest))
    return f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS text FROM documents
), p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d
), w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM p
), totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang
), f AS (SELECT lang, size, phrase, count(*) AS a FROM ({grams}) GROUP BY ALL HAVING count(*) >= {most.least}
), c AS (SELECT *, string_split(phrase, ' ') AS words FROM f WHERE size > 1
), covered AS (SELECT lang, phrase, max(a) AS cover FROM ({subs}) GROUP BY lang, phrase
), cuts AS (
  SELECT x.lang, x.phrase, x.a, x.k, l.a AS l, r.a AS r, (2000000::HUGEINT * x.a // (l.a + r.a))::BIGINT AS score
  FROM ({cuts}) x JOIN f l ON l.lang = x.lang AND l.phrase = x.lp JOIN f r ON r.lang = x.lang AND r.phrase = x.rp
), worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT y.*, row_number() OVER (PARTITION BY y.lang ORDER BY score DESC, a DESC, y.phrase) AS rank
  FROM worst y LEFT JOIN covered v ON v.lang = y.lang AND v.phrase = y.phrase WHERE NOT coalesce(100 * cover >= {most.covered} * a, false)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {most.top}
"""


OP13_SQL = _sql()
