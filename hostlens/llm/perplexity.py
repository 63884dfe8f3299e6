"""Quality rules with n-gram perplexity: a modified Kneser-Ney model and bands for each language present.

The model is over sequences of `ORDER` characters, as they are: any script, case or mark counts as itself. Tasks count
the sequences of their texts, Spark adds the counts up and derives all lower orders, discounts, probabilities and
back-off weights with joins and windows, per value of lang (null is one). It is stored as arrays of 64-bit hashes in
order with their values, in files dealt by ranges of hashes: it grows with what the corpus holds. A scoring task looks
the hashes of its texts up by binary search; it keeps at most `HELD` bytes of the arrays and reads further files one
after the other for each part of its texts, so its memory is bounded however large the model is.

Bands: of the distinct texts that pass the base rules, per language, the median log perplexity and the quartiles of the
distance from it, times the fourth root of a text's length, as short texts vary more. A document below the middle by
more than `LOW_REACH` times the lower quartile's distance, or above it by more than `HIGH_REACH` times the upper
quartile's, is rejected. These distances are blended with those over all languages, which weigh as much as `POOLED`
texts, so that a language with few texts has a band as well. Copies count once there, so that a text repeated over and
over moves no band. Quartiles come from values rounded to 1/1000.

Defined results: null and empty texts have no words, fail the base rules and have a null perplexity; repeated rows are
judged alike, and each counts in the model; a text of any length is read in pieces; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import shared_dir, table, written

ORDER = 5
LOW_REACH, HIGH_REACH = 6.0, 5.0
POOLED = 50
PIECE = 1 << 20
HELD = 256 << 20
COUNTED = 400_000
MIN_WORDS = 50
REPEAT_SHARE = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
START = "\x02"


# -- base rules -----------------------------------------------------------------------------------------------


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    n, end = 0, 0
    for k, w in enumerate(windows):
        if count[w] > 1:
            n += k + 3 - max(end, k)
            end = k + 3
    return n


def base(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()  # splits at the same six white-space characters
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(text.count(c) for c in SPACES),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


# -- hashes ---------------------------------------------------------------------------------------------------

_A, _B, _STEP, _CONTEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xD1342543DE82EF95), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _A
    x ^= x >> np.uint64(29)
    x *= _B
    return x ^ (x >> np.uint64(32))


def language_key(lang: str | None) -> np.uint64:
    return np.uint64(0 if lang is None else int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little") | 1)


def hashes(chars: np.ndarray, at: np.ndarray, n: int, lang: np.ndarray) -> np.ndarray:
    """Of the n characters from each place `at` on; lang has a language key for each place."""
    m = _mixed(chars.astype(np.uint64) + np.uint64(1))
    h = np.full(max(0, len(m) - n + 1), np.uint64(n))
    for k in range(n):
        h = h * _STEP + m[k : k + len(h)]
    return h[at] ^ lang


@dataclass
class Part:
    """Texts, or a piece of one: characters with ORDER - 1 before each, the first places of sequences, and their rows."""

    chars: np.ndarray
    at: np.ndarray
    row: np.ndarray
    lang: np.ndarray


def parts(batch: pa.RecordBatch, most: int = PIECE) -> Iterator[Part]:
    """All characters of a batch (text, lang) in parts of about `most`."""
    keys = {x: language_key(x) for x in set(batch.column("lang").to_pylist())}
    langs = batch.column("lang").to_pylist()
    held: list[tuple[int, str, str]] = []
    size = 0

    def part() -> Part:
        whole = "".join(b + t for _, b, t in held)
        chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        n = np.array([len(t) for _, _, t in held])
        first = np.append(0, np.cumsum(n + ORDER - 1))[:-1]
        at = np.repeat(first - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())
        rows = np.array([r for r, _, _ in held])
        return Part(chars, at, np.repeat(rows, n), np.repeat(np.array([keys[langs[r]] for r in rows], np.uint64), n))

    for row in range(batch.num_rows):
        text = batch.column("text")[row].as_py() or ""
        for k in range(0, len(text), most):
            before = text[k - ORDER + 1 : k] if k else START * (ORDER - 1)
            held.append((row, before, text[k : k + most]))
            size += len(held[-1][2])
            if size >= most:
                yield part()
                held, size = [], 0
    if held:
        yield part()


# -- counting -------------------------------------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, lang) -> lang, gram and n; what a task has counted is given out whenever it is much."""
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, ORDER), np.uint32), np.zeros(0, np.uint64))
    total, waiting, names = none, [], {}

    def merged() -> tuple:
        h, n, grams, lang = (np.concatenate(c) for c in zip(total, *waiting, strict=True))
        h, first, own = np.unique(h, return_index=True, return_inverse=True)
        return h, np.bincount(own, n, len(h)).astype(np.int64), grams[first], lang[first]

    def batch() -> pa.RecordBatch:
        _, n, grams, lang = total
        text = np.ascontiguousarray(grams).tobytes().decode("utf-32-le")
        grams = [text[k : k + ORDER] for k in range(0, len(text), ORDER)]
        return pa.RecordBatch.from_arrays([pa.array([names[x] for x in lang.tolist()], pa.string()), pa.array(grams, pa.string()), pa.array(n)], ["lang", "gram", "n"])

    for b in batches:
        names |= {int(language_key(x)): x for x in set(b.column("lang").to_pylist())}
        for p in parts(b):
            h, first, n = np.unique(hashes(p.chars, p.at, ORDER, p.lang), return_index=True, return_counts=True)
            at = p.at[first]
            waiting.append((h, n, p.chars[at[:, None] + np.arange(ORDER)], p.lang[first]))
            if sum(len(w[0]) for w in waiting) > COUNTED:
                total, waiting = merged(), []
                if len(total[0]) > COUNTED:
                    yield batch()
                    total = none
    if waiting:
        total = merged()
    yield batch()


def ngram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram and c, how often each sequence of ORDER characters occurs in all texts (columns text and lang)."""
    ship(docs.sparkSession)
    each = docs.select("text", "lang").mapInArrow(_count, "lang string, gram string, n long")
    return each.groupBy("lang", "gram").agg(F.sum("n").alias("c"))


# -- the model ------------------------------------------------------------------------------------------------


def _discounted(level: DataFrame) -> DataFrame:
    """level (lang, gram, c) with cut, what modified Kneser-Ney takes off c. A row per language is joined."""
    n = [F.count(F.when(F.col("c") == k, 1)) for k in (1, 2, 3, 4)]
    seen = level.groupBy("lang").agg(*[x.alias(f"n{k}") for k, x in enumerate(n, 1)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def of(k: int, usual: float) -> Column:
        rare = (F.col("n1") == 0) | (F.col("n2") == 0) | (F.col(f"n{k}") == 0)  # too few to estimate from
        return F.when(rare, usual).otherwise(F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.nullif(F.col(f"n{k}"), F.lit(0)), F.lit(0.0)), F.lit(k - 0.01)))

    seen = seen.select(F.col("lang").alias("own"), *[of(k, usual).alias(f"d{k}") for k, usual in ((1, 0.5), (2, 0.75), (3, 0.9))])
    cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    return level.join(seen, F.col("lang").eqNullSafe(F.col("own"))).withColumn("cut", cut).select("lang", "gram", "c", "cut")


def probabilities(counts: DataFrame) -> DataFrame:
    """ngram_counts -> lang, gram, p and free: of each sequence of 1 to ORDER characters the probability of its last one
    after the others, and for sequences that something follows, the weight of the shorter sequence after them."""
    levels = {ORDER: written(counts, "ngrams")}
    for n in range(ORDER - 1, 0, -1):  # lower orders count what comes before them, not occurrences
        levels[n] = written(levels[n + 1].groupBy("lang", F.expr(f"substring(gram, 2, {n})").alias("gram")).agg(F.count("*").alias("c")), "ngrams")
    before: DataFrame | None = None
    out: list[DataFrame] = []
    for n in range(1, ORDER + 1):
        rows = _discounted(levels[n]).withColumn("context", F.expr(f"substring(gram, 1, {n - 1})"))
        # A context is followed by at most as many characters as there are; the shortest one by the alphabet.
        same = Window.partitionBy("lang", "context")
        rows = rows.withColumns({"total": F.sum("c").over(same), "off": F.sum("cut").over(same), "kinds": F.count("*").over(same)})
        rows = rows.withColumn("free", F.col("off") / F.col("total"))
        if before is None:
            rows = rows.withColumn("lower", 1 / (F.col("kinds") + 1))
        else:
            lower = before.select(F.col("lang").alias("b_lang"), F.col("gram").alias("b_gram"), F.col("p").alias("lower"))
            rows = rows.join(lower, F.col("lang").eqNullSafe(F.col("b_lang")) & (F.expr(f"substring(gram, 2, {n - 1})") == F.col("b_gram")))
        rows = rows.withColumn("p", (F.col("c") - F.col("cut")) / F.col("total") + F.col("free") * F.col("lower"))
        before = written(rows.select("lang", "gram", "context", "p", "free", "kinds"), "ngrams")
        out.append(before.select("lang", "gram", F.log("p").alias("value"), F.lit(False).alias("weight")))
        out.append(before.groupBy("lang", F.col("context").alias("gram")).agg(F.log(F.first("free")).alias("value")).withColumn("weight", F.lit(True)))
        if n == 1:  # what has never been seen: one more character than the alphabet has
            rest = before.groupBy("lang").agg((-F.log(F.first("kinds") + 1)).alias("value"))
            out.append(rest.select("lang", F.lit("").alias("gram"), "value", F.lit(False).alias("weight")))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        grams, langs = b.column("gram").to_pylist(), b.column("lang").to_pylist()
        key = {x: language_key(x) for x in set(langs)}
        lang = np.array([key[x] for x in langs], np.uint64)
        size = np.array([len(g) for g in grams], np.int64)
        h = np.zeros(len(grams), np.uint64)
        for n in range(ORDER + 1):
            own = np.flatnonzero(size == n)
            chars = np.frombuffer("".join(grams[k] for k in own).encode("utf-32-le"), np.uint32)
            h[own] = hashes(chars, np.arange(len(own)) * n, n, lang[own]) if n else lang[own]
        h[np.array(b.column("weight").to_pylist(), bool)] ^= _CONTEXT
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column("value").cast(pa.float32())], ["h", "value"])


@dataclass
class Model:
    """Files of sorted hashes with their values; what fits into `held` bytes stays in memory."""

    files: list[str]
    held: int = HELD
    kept: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def _arrays(self, file: str) -> tuple[np.ndarray, np.ndarray]:
        if file in self.kept:
            return self.kept[file]
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(file)
        got = pq.read_table(path, filesystem=store)
        h = got.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)  # files are sorted as signed numbers
        found = h[order], got.column("value").to_numpy()[order]
        if sum(a.nbytes + b.nbytes for a, b in self.kept.values()) + found[0].nbytes + found[1].nbytes <= self.held:
            self.kept[file] = found
        return found

    def find(self, h: np.ndarray) -> np.ndarray:
        """The values of hashes; NaN for those that are not there."""
        out = np.full(len(h), np.nan, np.float64)
        for file in self.files:
            keys, values = self._arrays(file)
            if len(keys):
                k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                met = keys[k] == h
                out[met] = values[k[met]]
        return out

    def log_p(self, part: Part) -> np.ndarray:
        """The log probability of each sequence's last character, backing off where the sequence is unknown."""
        h, first, own = np.unique(hashes(part.chars, part.at, ORDER, part.lang), return_index=True, return_inverse=True)
        at, lang = part.at[first], part.lang[first]
        out, value = np.zeros(len(h)), self.find(h)
        for n in range(ORDER, -1, -1):
            known = ~np.isnan(value)
            out[known] += value[known]
            if known.all() or n == 0:
                out[~known] += np.log(1e-7)  # of a language that the model does not have
                break
            rest = np.flatnonzero(~known)
            shift = at[rest] + ORDER - n
            context = (hashes(part.chars, shift, n - 1, lang[rest]) if n > 1 else lang[rest]) ^ _CONTEXT
            out[rest] += np.nan_to_num(self.find(context), nan=0.0)
            value = np.zeros(len(h))
            value[rest] = self.find(hashes(part.chars, shift + 1, n - 1, lang[rest]) if n > 1 else lang[rest])
        return out[own]


def train(docs: DataFrame) -> Model:
    """Write the model of docs (text and lang); its file names are all that comes to the driver."""
    spark = docs.sparkSession
    rows = probabilities(ngram_counts(docs)).mapInArrow(_hashed, "h long, value float")
    path = shared_dir(spark, "perplexity-model")
    rows.repartitionByRange("h").sortWithinPartitions("h").write.parquet(path)
    return Model(sorted(spark.read.parquet(path).inputFiles()))


# -- scoring --------------------------------------------------------------------------------------------------

SCORED = "lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_ppl double, text_hash long"


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and SCORED of each document (columns doc_id, text and lang)."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for p in parts(batch):
                total += np.bincount(p.row, model.log_p(p), batch.num_rows)
                n += np.bincount(p.row, minlength=batch.num_rows)
            texts = [x or "" for x in batch.column("text").to_pylist()]
            ppl = np.round(-total / np.maximum(n, 1), 6)
            rules = np.array([base(x) for x in texts], np.int64).reshape(-1, 5)
            digest = np.array([xxhash.xxh64_intdigest(x) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), *[pa.array(c) for c in rules.T], pa.array(ppl, mask=n == 0), pa.array(digest)],
                ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ppl", "text_hash"],
            )

    return docs.select("doc_id", "text", "lang").mapInArrow(score, f"doc_id {kind}, {SCORED}")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))


def apart() -> Column:
    """How far a text is from its language's middle; a short text's log perplexity varies more."""
    return (F.col("log_ppl") - F.col("middle")) * F.sqrt(F.sqrt(F.col("word_chars")))


def _quartiles(x: DataFrame) -> DataFrame:
    """Rows (lang, x) -> band_lang, q and texts; first counted by value, so that few rows meet."""
    seen = x.groupBy("lang", F.round("x", 3).alias("x")).agg(F.count("*").alias("n"))
    return seen.groupBy(F.col("lang").alias("band_lang")).agg(F.percentile("x", [0.25, 0.5, 0.75], F.col("n")).alias("q"), F.sum("n").alias("texts"))


def bands(stats: DataFrame) -> DataFrame:
    """band_lang, middle, low and high: the distances between which documents are kept. A row per language."""
    own = F.col("lang").eqNullSafe(F.col("band_lang"))
    texts = stats.filter(~base_failed() & F.col("log_ppl").isNotNull()).groupBy("lang", "text_hash").agg(F.min("log_ppl").alias("log_ppl"), F.min("word_chars").alias("word_chars"))
    texts = written(texts, "perplexity-texts")  # narrow rows
    middle = written(_quartiles(texts.select("lang", F.col("log_ppl").alias("x"))).select("band_lang", F.col("q")[1].alias("middle")), "perplexity-bands")
    away = texts.join(middle, own).select("lang", apart().alias("x"))
    usual = away.groupBy(F.round("x", 3).alias("x")).agg(F.count("*").alias("n")).agg(F.percentile("x", [0.25, 0.75], F.col("n")).alias("q")).first()["q"] or [0.0, 0.0]

    def reach(quartile: Column, pooled: float) -> Column:
        return F.greatest((quartile * F.col("texts") + F.lit(float(pooled) * POOLED)) / (F.col("texts") + POOLED), F.lit(0.001))

    q = F.col("q")
    ends = _quartiles(away).select(F.col("band_lang").alias("lang"), (q[1] - LOW_REACH * reach(q[1] - q[0], -usual[0])).alias("low"), (q[1] + HIGH_REACH * reach(q[2] - q[1], usual[1])).alias("high"))
    return middle.join(ends, own).select("band_lang", "middle", "low", "high")


def judged(docs: DataFrame) -> DataFrame:
    """doc_id and SCORED with base_failed, middle, low, high and kept."""
    stats = written(scored(docs, train(docs)), "perplexity")  # narrow rows; the bands and the verdicts both read them
    limits = written(bands(stats), "perplexity-bands")
    out = stats.join(limits, F.col("lang").eqNullSafe(F.col("band_lang")), "left").drop("band_lang").withColumn("base_failed", base_failed())
    odd = (apart() < F.col("low")) | (apart() > F.col("high"))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False)))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.exp("log_ppl").alias("perplexity"))
