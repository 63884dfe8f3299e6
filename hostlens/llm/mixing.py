"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight and a schedule, a piecewise linear intensity over training time 0..1. The schedule's
integral up to t is the share of the source's tokens that training has asked for by then. A document that supplies the
tokens [c, c + size) of its source is due at the time at which that cumulative demand reaches c, so its training
position is the inverse of the integral at c / budget. Sources with less text than asked for are read again, up to
`max_repeat` passes; a pass that the budget ends within a document takes its first words only.

Prefix sums of a hot source never meet in one task: documents are ordered by a digest, the digest's first three hex
digits deal them to 4096 buckets, and a document's start is its bucket's start plus a running sum inside the bucket.

Defined results: null or blank texts have size 0 and take nothing; a null source is a source of its own, after all
others; an empty table gives an empty result; repeated rows are separate documents and share a digest.
The sources themselves, a row each, are put into one order in one task; they are to be tens of thousands at most.
Columns of the input stay; new columns that would clash get an underscore.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, table, word_count, written

MAX_REPEAT = 3


@dataclass(frozen=True)
class Share:
    """A source's weight and its schedule: (time, intensity) knots with an integral of 1 over 0..1."""

    weight: float
    knots: tuple[tuple[float, float], ...] = ((0.0, 1.0), (1.0, 1.0))

    def segments(self) -> list[tuple[float, float, float, float, float]]:
        """(share asked for before, time, intensity, slope, share asked for after) of each piece."""
        out, area = [], 0.0
        for (t0, m0), (t1, m1) in zip(self.knots, self.knots[1:], strict=False):
            after = area + (m0 + m1) / 2 * (t1 - t0)
            out.append((area, t0, m0, (m1 - m0) / (t1 - t0), after))
            area = after
        if self.weight <= 0 or abs(area - 1) > 1e-9:
            raise ValueError("a weight must be positive and a schedule's integral 1")
        return out

    def due(self, share: Column) -> Column:
        """The time at which the share of the tokens that the schedule has asked for is `share`."""
        pieces = self.segments()
        found = F.lit(1.0)
        for k, (before, t0, m0, slope, after) in reversed(list(enumerate(pieces))):
            a = share - F.lit(before)
            x = 2 * a / (F.lit(m0) + F.sqrt(F.lit(m0 * m0) + F.lit(2 * slope) * a))
            found = F.lit(t0) + x if k == len(pieces) - 1 else F.when(share < F.lit(after), F.lit(t0) + x).otherwise(found)
        return found


#: Sources in code-point order take these in turn: broad text fades, rare text comes late.
CURRICULUM = (
    Share(5.0, ((0.0, 1.2), (0.5, 1.0), (1.0, 0.8))),
    Share(2.0),
    Share(1.0, ((0.0, 0.5), (1.0, 1.5))),
)


def source_key(source: Column) -> Column:
    """A non-null key with the order of the sources, nulls last."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("k"), source))


def targets(sizes: DataFrame, curriculum: tuple[Share, ...] = CURRICULUM, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """skey, size -> skey, kind, source_size, target.

    All words are shared by weight; a target stops at max_repeat times its source's size and the excess goes to the
    others by weight. Ordered by size per weight, the sources that stop come first, so one pass of window sums over
    the sources (a row each) finds the level at which the rest share.
    """
    own = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    rank = Window.orderBy("skey")
    kind = ((F.row_number().over(rank) - 1) % len(curriculum)).cast("int")
    own = own.select("skey", "source_size", kind.alias("kind"))
    weight = F.element_at(F.array(*[F.lit(float(s.weight)) for s in curriculum]), F.col("kind") + 1)
    own = own.withColumn("weight", weight).withColumn("most", F.col("source_size") * max_repeat)
    order = Window.orderBy(F.col("most") / F.col("weight"), "skey")
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy(F.lit(0))
    total = F.sum("source_size").over(everything)
    own = own.withColumn("level", (total - before) / left)
    level = F.max("level").over(everything)
    return own.select("skey", "kind", "source_size", F.least(F.col("most").cast("double"), level * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame,
    sizes: DataFrame,
    curriculum: tuple[Share, ...] = CURRICULUM,
    max_repeat: int = MAX_REPEAT,
) -> DataFrame:
    """docs with skey, size and h (see keyed) -> docs with source_size, target, taken, pass_words and positions.

    sizes has skey, h and size of the same rows and gives all sums; taken is the words the mix takes of a document,
    pass_words the words of each pass and positions the training positions (0 to 1) of these passes.
    """
    goal = targets(sizes, curriculum, max_repeat)
    buckets = sizes.groupBy("skey", F.substring("h", 1, 3).alias("bucket")).agg(F.sum("size").alias("bucket_size"))
    order = Window.partitionBy("skey").orderBy("bucket")
    start = F.coalesce(F.sum("bucket_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = buckets.select("skey", "bucket", start.alias("bucket_start")).join(goal, "skey")
    inside = Window.partitionBy("skey", "bucket").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("bucket", F.substring("h", 1, 3)).withColumn("in_bucket", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = docs.join(starts, ["skey", "bucket"]).withColumn("start", F.col("bucket_start") + F.col("in_bucket"))
    budget = F.floor(F.col("target") + 0.5)
    first = [F.col("start") + F.col("source_size") * k for k in range(max_repeat)]
    words = [F.greatest(F.lit(0), F.least(F.col("size"), budget - f)).cast("long") for f in first]
    share = [f / budget for f in first]

    def due(x: Column) -> Column:
        at = curriculum[-1].due(x)
        for k in range(len(curriculum) - 1):
            at = F.when(F.col("kind") == k, curriculum[k].due(x)).otherwise(at)
        return at

    passes = F.array(*[F.struct(w.alias("words"), F.when(w > 0, due(x)).alias("position")) for w, x in zip(words, share, strict=True)])
    out = out.withColumn("passes", F.filter(passes, lambda p: p["words"] > 0))
    taken = sum(words[1:], words[0])
    return (
        out.withColumn("taken", taken)
        .withColumn("pass_words", F.col("passes.words"))
        .withColumn("positions", F.col("passes.position"))
        .drop("bucket", "in_bucket", "bucket_start", "start", "passes", "kind")
    )


def keyed(docs: DataFrame) -> DataFrame:
    """docs with skey, size (words) and h, the digest that orders a source's documents."""
    size = word_count(F.col("text"))
    return docs.withColumns({"skey": source_key(F.col("source")), "size": size}).withColumn(
        "h", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = keyed(table(spark, sf_dir, "documents")).select("doc_id", "skey", "size", "h")
    docs = written(docs, "mix")  # texts are read once; the sums and the range sort below use these few columns
    out = mix(docs, docs).withColumn("position", F.round(F.get("positions", F.lit(0)), 9))
    return out.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def _rows(docs: DataFrame) -> DataFrame:
    """docs as one struct beside the columns that mixing reads, so that no column of docs is in its way."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", "text")


def mixed(docs: DataFrame, curriculum: tuple[Share, ...] = CURRICULUM, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """docs with size, source_size, target, taken, pass_words and positions; all documents stay."""
    rows = _rows(docs)
    sizes = written(keyed(rows).select("skey", "size", "h"), "mix")
    out = mix(keyed(rows).drop("text"), sizes, curriculum, max_repeat)
    added = [F.col(c).alias(free_name(docs, c)) for c in ("size", "source_size", "target", "taken", "pass_words", "positions")]
    return out.select("row.*", *added)


def mixed_documents(docs: DataFrame, curriculum: tuple[Share, ...] = CURRICULUM, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The mix itself: a row for each pass over each document it takes, in the order of training.

    A last pass that ends within a document takes the whole document if that is at least half of it, else nothing.
    """
    rows = _rows(docs)
    sizes = written(keyed(rows).select("skey", "size", "h"), "mix")
    out = mix(keyed(rows).drop("text"), sizes, curriculum, max_repeat)
    whole = F.filter(F.arrays_zip("pass_words", "positions"), lambda p: p["pass_words"] * 2 >= F.col("size"))
    out = out.select("row", "doc_id", F.explode(whole).alias("pass"))
    return out.orderBy("pass.positions", "doc_id").select("row.*")


def in_order(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, as read from the files that mixed_documents was written to, with a column of their place in training, and its name.

    Spark writes a sorted frame as sorted files with numbers that rise, so a row's place is its file's number, then its
    row in the file: nothing is counted or shuffled. Other frames than those of files have null there.
    """
    name = free_name(docs, "training_order")
    if not docs.inputFiles():
        return docs.withColumn(name, F.lit(None).cast("long")), name
    meta = docs.metadataColumn("_metadata")
    number = lambda pattern: F.coalesce(F.regexp_extract(meta["file_name"], pattern, 1).try_cast("long"), F.lit(0))
    place = F.shiftleft(number(r"^part-(\d+)"), 42) + F.shiftleft(number(r"-c(\d+)\b"), 32) + meta["row_index"]
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns], place.cast("long").alias(name)), name


def _sql() -> str:
    """The same mix in SQL, by plain running sums."""

    def due(share: Share) -> str:
        found = ""
        pieces = share.segments()
        for k, (before, t0, m0, slope, after) in enumerate(pieces):
            x = f"{t0}::DOUBLE + 2 * (f - {before}::DOUBLE) / ({m0}::DOUBLE + sqrt({m0 * m0!r}::DOUBLE + {2 * slope!r}::DOUBLE * (f - {before}::DOUBLE)))"
            found += f" WHEN f < {after!r}::DOUBLE THEN {x}" if k < len(pieces) - 1 else f" ELSE {x} END"
        return f"CASE{found}" if len(pieces) > 1 else f"CASE WHEN true THEN{found.removeprefix(' ELSE')}"

    kinds = " ".join(f"WHEN kind = {k} THEN ({due(s)})" for k, s in enumerate(CURRICULUM))
    weights = ", ".join(str(float(s.weight)) for s in CURRICULUM)
    return f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS t FROM documents
), k AS (
  SELECT *, md5(coalesce(doc_id::VARCHAR, '') || ':' || t) AS h FROM d
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source
), s1 AS (
  SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(CURRICULUM)} AS kind FROM s0
), s2 AS (
  SELECT *, ([{weights}]::DOUBLE[])[kind + 1] AS weight, source_size * {MAX_REPEAT} AS most FROM s1
), s3 AS (
  SELECT *, ((SELECT sum(source_size) FROM s2) - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s2 WINDOW o AS (ORDER BY most::DOUBLE / weight, encode(source) NULLS LAST)
), s AS (
  SELECT source, kind, source_size, least(most::DOUBLE, max(level) OVER () * weight) AS target FROM s3
), r AS (
  SELECT doc_id, size, h, source_size, target, kind, floor(target + 0.5)::BIGINT AS budget,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM k JOIN s ON k.source IS NOT DISTINCT FROM s.source
), t AS (
  SELECT *, start::DOUBLE / nullif(budget, 0) AS f,
    {" + ".join(f"greatest(0, least(size, budget - start - {e} * source_size))" for e in range(MAX_REPEAT))} AS taken
  FROM r
)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
  CASE WHEN taken > 0 THEN round(CASE {kinds} END, 9) END AS position FROM t
"""


OP1_SQL = _sql()
