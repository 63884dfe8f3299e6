"""Language identification by n-gram filters whose slots are bitmasks of languages.

An n-gram belongs to a language if it makes up at least `FLOOR` of the language's n-grams and at least `RIVAL` of its
highest share in any language. The n-grams of all languages go into one bit-sliced Bloom filter: each sets its
languages' bits in `HASHES` slots, and the bitwise AND of these slots names all languages that contain it at once. The
bits of a text's n-grams are counted by language, and the count is corrected for the false positives that the filter's
fill for this language explains: (hits - n p) / (1 - p). The largest count decides; the score is its share of the two
largest.

N-grams do not reach over words, so a task looks a word up once and adds its counts wherever it meets the word again.
All training texts are counted, whole, in Spark. What is broadcast does not grow with them: at FLOOR = 1e-5 a language
has at most 100,000 n-grams of all orders together, however much text there is, so the filter has at most
`SLOTS_PER_GRAM` x 100,000 slots, rounded up to a power of two, of 8 bytes for each 64 languages.

Defined results: null texts and texts without a letter are `und` with score 0, and so is everything where nothing could
be learned; a text none of whose n-grams is known, and ties, go to the first language by code point, the former with
score 0. Rows without an id are not held out. Repeated rows count each. Texts of any length are read whole; a word of
more than `LONGEST` letters is read as several. Columns of the input stay, and new ones that would clash get an
underscore. The languages, a row each, pass through the driver.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import free_name, table, written

ORDERS = (2, 3, 4)  # characters; a word has a space at either end
FLOOR = 1e-5
RIVAL = 0.05
HASHES = 3
SLOTS_PER_GRAM = 8
LONGEST = 1 << 16
SLICE = 1 << 19  # characters of a text that are split at a time
MOST_HELD = 200_000  # distinct words that a task keeps
MOST_LETTERS = 1 << 24  # and their letters
UNKNOWN = "und"
_WORD = regex.compile(rf"\p{{L}}[\p{{L}}\p{{M}}]{{0,{LONGEST - 1}}}")
_REST = regex.compile(rf"[\p{{L}}\p{{M}}]{{1,{LONGEST}}}")


# -- n-grams ----------------------------------------------------------------------------------------------------------


def words_of(text: str | None) -> Iterator[list[str]]:
    """The words of a text, lower-cased, some at a time: a letter and the letters and marks after it."""
    text, at = text or "", 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        more = _REST.match(text, end) if end < len(text) else None
        end = more.end() if more else end
        if words := _WORD.findall(text[at:end].lower()):
            yield words
        at = end


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each n-gram of each word, and the number of the word."""
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    space = points == 32
    word = np.cumsum(space) - 1  # the space before a word counts to it, the one after it to the next
    hashes, owners = [], []
    for order in ORDERS:
        n = max(0, len(points) - order + 1)
        inside = np.ones(n, bool)
        for j in range(1, order - 1):
            inside &= ~space[j : j + n]
        if order == 2:
            inside = ~(space[:n] & space[1:])
        at = np.flatnonzero(inside)
        h = np.full(len(at), order, np.uint64)
        for j in range(order):
            h = (h ^ points[at + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        hashes.append(h)
        owners.append(word[at])
    return np.concatenate(hashes), np.concatenate(owners)


def _groups(words: list[str]) -> Iterator[tuple[int, int]]:
    """First and last word of runs of words with about LONGEST letters."""
    start, size = 0, 0
    for k, w in enumerate(words):
        if size and size + len(w) > LONGEST:
            yield start, k
            start, size = k, 0
        size += len(w) + 1
    if words:
        yield start, len(words)


# -- the filter -------------------------------------------------------------------------------------------------------


@dataclass
class LanguageFilter:
    """slots[p] has the bits of languages 64 p to 64 p + 63."""

    languages: list[str]
    slots: np.ndarray

    def __post_init__(self):
        fill = np.array([(self.slots[k // 64] >> np.uint64(k % 64) & np.uint64(1)).mean() for k in range(len(self.languages))])
        self.false = fill**HASHES

    def masks(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram the languages that contain it, as bits, in planes of 64."""
        low, high = (h & np.uint64(0xFFFFFFFF)).astype(np.int64), ((h >> np.uint64(32)) | np.uint64(1)).astype(np.int64)
        out = None
        for j in range(HASHES):
            found = self.slots[:, (low + j * high) & (self.slots.shape[1] - 1)]
            out = found if out is None else out & found
        return out

    def hits(self, words: list[str]) -> np.ndarray:
        """For each word the number of its n-grams, then how many of them each language has."""
        out = np.zeros((len(words), len(self.languages) + 1), np.int64)
        for a, b in _groups(words):
            h, owner = grams(words[a:b])
            masks = self.masks(h)
            out[a:b, 0] = np.bincount(owner, minlength=b - a)
            for k in range(len(self.languages)):
                bit = masks[k // 64] >> np.uint64(k % 64) & np.uint64(1)
                out[a:b, k + 1] = np.bincount(owner[bit.astype(bool)], minlength=b - a)
        return out

    def decide(self, counts: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores of texts, given the sums of their words' hits."""
        n = counts[:, :1]
        own = np.maximum(0, (counts[:, 1:] - n * self.false) / np.maximum(1e-9, 1 - self.false))
        own = np.where(n > 0, own, 0)
        if not self.languages:
            return [UNKNOWN] * len(counts), np.zeros(len(counts))
        first = own.argmax(1)
        best = own.max(1)
        second = np.partition(own, -2, 1)[:, -2] if own.shape[1] > 1 else np.zeros(len(own))
        pred = [self.languages[k] if some else UNKNOWN for k, some in zip(first.tolist(), (n[:, 0] > 0).tolist(), strict=True)]
        return pred, np.where(best > 0, best / np.maximum(best + second, 1e-12), 0.0)


class Lookup:
    """The hits of words, kept while they are few, and their sums by text."""

    def __init__(self, model: LanguageFilter):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.letters = 0
        self.rows = np.zeros((0, len(self.model.languages) + 1), np.int64)

    def sums(self, words: list[str]) -> np.ndarray:
        if len(self.place) > MOST_HELD or self.letters > MOST_LETTERS:
            self.clear()
        place, times = self.place, Counter(words)
        new = [w for w in times if w not in place]
        if new:
            first, last = len(place), len(place) + len(new)
            place.update(zip(new, range(first, last), strict=True))
            self.letters += sum(map(len, new))
            if last > len(self.rows):  # grows by doubling, so that a row is seldom moved
                rows = np.zeros((max(1024, 2 * last), self.rows.shape[1]), np.int64)
                rows[:first] = self.rows[:first]
                self.rows = rows
            self.rows[first:last] = self.model.hits(new)
        return np.fromiter(times.values(), np.int64, len(times)) @ self.rows[[place[w] for w in times]]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n of all texts of docs (text, lang)."""
    ship(docs.sparkSession)

    def give(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            words, times = list(own), np.fromiter(own.values(), np.int64, len(own))
            for a, b in _groups(words):
                h, owner = grams(words[a:b])
                found, inverse = np.unique(h, return_inverse=True)
                n = np.zeros(len(found), np.int64)
                np.add.at(n, inverse, times[a:b][owner])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])
        counts.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        letters = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                for words in words_of(text.as_py()):
                    counts[lang].update(words)
                    letters += sum(map(len, words))
                    if letters > MOST_LETTERS:
                        yield from give(counts)
                        letters = 0
        yield from give(counts)

    return docs.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learned(docs: DataFrame) -> LanguageFilter:
    """The filter of the languages of docs (text, lang); rows without a language teach nothing."""
    spark = docs.sparkSession
    counts = written(gram_counts(docs.filter("lang IS NOT NULL")), "grams")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row for each language
    names = sorted(totals)
    planes = max(1, -(-len(names) // 64))
    numbered = spark.createDataFrame([(name, k, totals[name]) for k, name in enumerate(names)], "lang string, k int, total long")
    shares = counts.join(numbered, "lang").withColumn("share", F.col("n") / F.col("total")).filter(F.col("share") >= FLOOR)
    own = shares.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("k", "share")).alias("all"))  # at most one entry a language
    kept = own.select("gram", F.filter("all", lambda x: x["share"] >= RIVAL * F.col("top")).alias("all"))
    kept = written(kept.select("gram", F.col("all.k").alias("ks")), "members")
    most = kept.select(F.explode("ks").alias("k")).groupBy("k").count().agg(F.max("count")).first()[0] or 1
    size = 1 << (SLOTS_PER_GRAM * most - 1).bit_length()
    low, high = F.col("gram").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("gram", 32).bitwiseOR(F.lit(1))
    slots = F.array(*[F.pmod(low + high * j, F.lit(size)) for j in range(HASHES)])
    plane = lambda p: F.aggregate("ks", F.lit(0).cast("long"), lambda a, k: F.when(F.floor(k / 64) == p, a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), k % 64))).otherwise(a))
    bits = kept.select(F.explode(slots).alias("slot"), *[plane(p).alias(f"p{p}") for p in range(planes)])
    got = bits.groupBy("slot").agg(*[F.bit_or(f"p{p}").alias(f"p{p}") for p in range(planes)]).toArrow()  # at most `size` rows
    out = np.zeros((planes, size), np.uint64)
    for p in range(planes):
        out[p, got.column("slot").to_numpy()] = got.column(f"p{p}").to_numpy().astype(np.int64).view(np.uint64)
    return LanguageFilter(names, out)


def identified(docs: DataFrame, model: LanguageFilter, names: tuple[str, str] = ("lang_pred", "score"), keep_text: bool = True) -> DataFrame:
    """docs with the predicted language of its texts and the score, named `names`."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    own = [f.name for f in kept]
    kinds = T.StructType([*kept, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(sent.value)
        for batch in batches:
            counts = np.zeros((batch.num_rows, len(sent.value.languages) + 1), np.int64)
            for k, text in enumerate(batch.column("text")):
                for words in words_of(text.as_py()):
                    counts[k] += lookup.sums(words)
            pred, score = sent.value.decide(counts)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], pa.array(pred, pa.string()), pa.array(score)], [*own, *names])

    return docs.mapInArrow(identify, kinds)


def with_language(docs: DataFrame, training: DataFrame) -> DataFrame:
    """docs with lang_pred and score, as the languages of `training` (text, lang) teach them."""
    return identified(docs, learned(training), (free_name(docs, "lang_pred"), free_name(docs, "score")))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learned(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"))
    out = identified(docs.select("doc_id", "text"), model, keep_text=False)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
