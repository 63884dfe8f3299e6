"""Importance resampling towards a target: draw documents in proportion to how like a target corpus their words are.

Features are all runs of 1 to `n` consecutive words. One scan of a text keeps the running CRC-32 states of its last
`n` starts; each word extends every state by a space and itself and opens a new one, and each state met is the
checksum of a feature, so no feature is ever put together as a string. Features fall into `buckets` classes by their
checksum. A bucket's gain is how much commoner it is in the target than in the documents, a document's weight the mean
gain of its features, and a Gumbel noise that depends on the seed and the id alone turns the highest scores into a
draw without replacement.

The texts are read twice: once for the counts of the buckets (each task sends at most `buckets` rows), once for the
weights. What is sent to the tasks in between is one number a bucket. The cutting score comes from a histogram of the
scores, whole numbers within a range of about 200,000; only rows at or above it are sorted, by range, with ties dealt
out at random, and a row's rank is its place in its range plus the ranges before it.

Defined results: a null text has no words; a document without features has weight 0; one with fewer than `least` words
is scored and never drawn; one without an id has no noise, hence no score, is never drawn and does not count in the
share that is drawn. Repeated rows are separate documents: those with one id and one score take adjacent ranks. Texts
and words of any length are read whole, a slice at a time. Empty documents or an empty target give gains of their own
counts only; an empty table gives an empty result. Columns of the input stay, and new ones that would clash get an
underscore.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import UPPER, free_name, table, written
from .textbytes import utf8

SLICE = 1 << 20  # bytes of a text that are split into words at a time
AT_ONCE = 1 << 20  # checksums that are counted at a time


@dataclass(frozen=True)
class Draw:
    """Runs of up to `n` words in `buckets` classes; `percent` of the documents with at least `least` words are drawn."""

    n: int = 1
    buckets: int = 10_000
    seed: int = 2024
    percent: int = 10
    least: int = 20


def _spaces() -> bytes:
    """Letters A-Z lower-cased; all other ASCII but a-z and 0-9 a space. Bytes beyond ASCII belong to words."""
    keep = set(b"abcdefghijklmnopqrstuvwxyz0123456789")
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or b in keep else 32 for b in range(256))


SPACES = _spaces()
_SPACE = re.compile(b" ")


def word_slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, some at a time: a slice ends at the first space at or after SLICE bytes."""
    plain, at = text.translate(SPACES), 0
    while at < len(plain):
        cut = _SPACE.search(plain, at + SLICE)
        end = cut.start() if cut else len(plain)
        yield plain[at:end].split()
        at = end


class Ring:
    """The running CRC-32 states of the last n starts of a text."""

    def __init__(self, n: int):
        self.n, self.states = n, []

    def run(self, words: list[bytes]) -> np.ndarray:
        """The checksums of all features that end in one of the next words."""
        if self.n == 1:  # every state ends where it starts
            return np.fromiter(map(crc32, words), np.uint32, len(words))
        out, states = [], self.states
        for word in words:
            spaced = b" " + word
            states = [crc32(spaced, c) for c in states[len(states) == self.n :]]
            states.append(crc32(word))
            out += states
        self.states = states
        return np.array(out, np.uint32)


def checksums(text: bytes, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Slice by slice of a text: how many words, and the checksums of its features."""
    ring = Ring(n)
    for words in word_slices(text):
        yield len(words), ring.run(words)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    data, at = utf8(batch.column("text"))
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield data[a:b].tobytes()


def bucket_counts(docs: DataFrame, draw: Draw) -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(draw.buckets, np.int64), [], 0
        for batch in batches:
            for text in _texts(batch):
                for _, found in checksums(text, draw.n):
                    held.append(found)
                    size += len(found)
                    if size >= AT_ONCE:
                        total += np.bincount(np.concatenate(held) % draw.buckets, minlength=draw.buckets)
                        held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held) % draw.buckets, minlength=draw.buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(total[full])], ["bucket", "n"])

    return docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, draw: Draw) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over its share in the documents, both smoothed by one."""

    def counts(df: DataFrame) -> list[int]:
        got, out = bucket_counts(df, draw).toArrow(), [0] * draw.buckets  # at most `buckets` rows
        for bucket, n in zip(got.column("bucket").to_pylist(), got.column("n").to_pylist(), strict=True):
            out[bucket] = n
        return out

    s, t = counts(docs), counts(target)
    all_s, all_t = sum(s) + draw.buckets, sum(t) + draw.buckets
    ratio = lambda a, b: (float(b + 1) * float(all_s)) / (float(a + 1) * float(all_t))
    return np.array([math.floor(1000 * math.log(ratio(a, b))) for a, b in zip(s, t, strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, draw: Draw, keep_text: bool = True) -> DataFrame:
    """docs with n_words, n_features and weight as columns _words, _features and _weight."""
    ship(docs.sparkSession)
    kept = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    names = [f.name for f in kept]
    added = ["_words", "_features", "_weight"]
    kinds = T.StructType([*kept, *[T.StructField(c, T.LongType()) for c in added]])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((3, batch.num_rows), np.int64)
            for k, text in enumerate(_texts(batch)):
                for n_words, found in checksums(text, draw.n):
                    rows[:, k] += n_words, len(found), gain[found % draw.buckets].sum()
            rows[2] //= np.maximum(rows[1], 1)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *map(pa.array, rows)], [*names, *added])

    return docs.mapInArrow(weigh, kinds)


def noise(doc_id: Column, seed: int) -> Column:
    """A standard Gumbel variable in thousandths, a function of seed and id; null for a null id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def cut(scores: DataFrame, draw: Draw) -> tuple[int | None, int]:
    """The lowest score that is drawn (None if none is) and how many rows are drawn. scores: the eligible rows' _score."""
    got = scores.groupBy("_score").agg(F.count("*").alias("n")).toArrow()  # distinct whole numbers within about 200,000
    found = sorted(zip(got.column("_score").to_pylist(), got.column("n").to_pylist(), strict=True), reverse=True)
    due = draw.percent * sum(n for _, n in found) // 100
    seen = 0
    for score, n in found:
        if seen >= due:
            break
        seen += n
        lowest = score
    return (lowest if due else None), due


def with_rank(rows: DataFrame, draw: Draw, id_column: str = "doc_id") -> DataFrame:
    """rows (written ones, with _words and _score) with _rank: 1, 2, 3… by score and id for the drawn, else null."""
    eligible = (F.col("_words") >= draw.least) & F.col("_score").isNotNull()
    lowest, due = cut(rows.filter(eligible), draw)
    if lowest is None:
        return rows.withColumn("_rank", F.lit(None).cast("long"))
    high = F.coalesce(eligible & (F.col("_score") >= lowest), F.lit(False))
    ordered = rows.filter(high).withColumn("_tie", F.rand(0)).orderBy(F.col("_score").desc(), id_column, "_features", "_tie").drop("_tie")
    ordered = written(ordered.withColumn("_place", F.monotonically_increasing_id()), "drawn")  # range << 33 | place in it
    part = F.shiftright("_place", 33)
    sizes = dict(ordered.groupBy(part.alias("p")).count().collect())  # a row for each range
    before, starts = 0, []
    for p in sorted(sizes):
        starts.append((p, before))
        before += sizes[p]
    starts_df = F.broadcast(rows.sparkSession.createDataFrame(starts, "_p long, _before long"))
    rank = F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1
    ranked = ordered.join(starts_df, part == F.col("_p")).withColumn("_rank", F.when(rank <= due, rank))
    rest = rows.filter(~high).withColumn("_rank", F.lit(None).cast("long"))
    return ranked.select(*rest.columns).unionByName(rest)


def resampled(docs: DataFrame, target: DataFrame, draw: Draw = Draw()) -> DataFrame:
    """docs with n_features, weight, score and rank; the drawn ones have a rank. doc_id may be of any type with an order."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    out = _scored(rows, target, draw, keep_text=False)
    names = ("n_features", "weight", "score", "rank")
    added = [F.col(c).alias(free_name(docs, n)) for c, n in zip(("_features", "_weight", "_score", "_rank"), names, strict=True)]
    return out.select("row.*", *added)


def drawn(docs: DataFrame, target: DataFrame, draw: Draw = Draw()) -> DataFrame:
    """The documents that are drawn, with their columns alone."""
    name = free_name(docs, "rank")
    return resampled(docs, target, draw).filter(F.col(name).isNotNull()).select(*[f"`{c}`" for c in docs.columns])


def _scored(rows: DataFrame, target: DataFrame, draw: Draw, keep_text: bool) -> DataFrame:
    gain = gains(rows, target, draw)
    scored = weighed(rows, gain, draw, keep_text).withColumn("_score", F.col("_weight") + noise(F.col("doc_id"), draw.seed))
    return with_rank(written(scored, "weighed"), draw)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = _scored(docs, table(spark, sf_dir, "benchmark"), Draw(), keep_text=False)
    return out.select("doc_id", F.col("_features").alias("n_features"), F.col("_weight").alias("weight"), F.col("_score").alias("score"), F.col("_rank").alias("rank"))


def _sql(draw: Draw = Draw()) -> str:
    """The same in SQL, for runs of one word; the checksum is folded over a word's bytes with the usual table."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    shift = "CASE WHEN {c} & 1 = 1 THEN xor({c} >> 1, 3988292384::BIGINT) ELSE {c} >> 1 END"
    steps = ", ".join(f"c{k + 1} AS (SELECT n, {shift.format(c='c')} AS c FROM c{k})" for k in range(8))
    return f"""
WITH c0 AS (SELECT range AS n, range AS c FROM range(256)), {steps}, entries AS (SELECT list(c ORDER BY n) AS entry FROM c8
), d AS (SELECT doc_id, unnest({words}) AS word FROM documents
), b AS (SELECT unnest({words}) AS word FROM benchmark
), v0 AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM d UNION SELECT word FROM b)
), v AS (
  SELECT word, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda c, y: xor(c >> 8, entry[(xor(c, y) & 255) + 1]))) % {draw.buckets} AS bucket
  FROM v0, entries
), s AS (SELECT bucket, count(*) AS n FROM d JOIN v USING (word) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS n FROM b JOIN v USING (word) GROUP BY bucket
), totals AS (SELECT (coalesce((SELECT sum(n) FROM s), 0) + {draw.buckets})::DOUBLE AS big_s, (coalesce((SELECT sum(n) FROM t), 0) + {draw.buckets})::DOUBLE AS big_t
), g AS (
  SELECT s.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * big_s) / ((s.n + 1)::DOUBLE * big_t)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), totals
), f AS (SELECT d.doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM d JOIN v USING (word) JOIN g USING (bucket) GROUP BY d.doc_id
), w AS (
  SELECT k.doc_id, coalesce(n, 0)::BIGINT AS n_features,
    coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
    ('0x' || substr(sha256('{draw.seed}:' || k.doc_id::VARCHAR), 1, 8))::BIGINT::DOUBLE AS h
  FROM documents k LEFT JOIN f ON k.doc_id = f.doc_id
), x AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM w
), r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () * {draw.percent} // 100 AS due
  FROM x WHERE n_features >= {draw.least}
)
SELECT x.doc_id, n_features, weight, score, CASE WHEN place <= due THEN place END AS rank FROM x LEFT JOIN r USING (doc_id)
"""


OP11_SQL = _sql()
