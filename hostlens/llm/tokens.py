"""Token counts behind a digest cache.

A text's digest is the SHA-256 of its normalised content, and a cache row is (version, digest, n_tokens), where version
is the digest of the tokenizer's file. Counting joins the documents' digests to the rows of this version, encodes each
distinct text that has none once, appends those rows to the cache, and joins them back. Normalising replaces runs of
white space by one space, as the tokenizer's own normaliser does first, so that it never changes a count.

Texts that have to be encoded lose most repeats within each input partition before they are dealt out by digest, so a
text that a third of all rows repeat reaches its task a few times per input partition; there they are sorted by digest
and the first of each is encoded. Only (doc_id, digest,
bytes) is joined to the counts.

The tokenizer splits at white space and never merges across it, so a task counts a text word by word and keeps the
counts of the words it has seen, up to `MEMO` of them. `exact` says whether a tokenizer allows that; others encode
whole texts.

Defined results: a null text counts as empty, with 0 bytes and 0 tokens; texts of any length are encoded whole;
repeated rows each get a row; an empty table gives an empty result and leaves the cache as it was.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import discard, free_name, shared_base, table, written

LIMIT = 2048
MEMO = 400_000
SEEN = 200_000
TOKENIZER = "word_bpe_49k.json"
CACHE = "digest binary, n_tokens long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), 256))


class Counter:
    """Counts tokens with the library of the file's kind: .json tokenizers, .model sentencepiece."""

    def __init__(self, path: str):
        self.by_word = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.encode = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as f:
                self.by_word = exact(json.load(f))
        self.memo: dict[bytes, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return self.encode(texts)
        memo, split = self.memo, [t.encode().split() for t in texts]
        if len(memo) > MEMO:
            memo.clear()
        new = list({w for words in split for w in words if w not in memo})
        memo.update(zip(new, self.encode([w.decode() for w in new]), strict=True))
        return [sum(map(memo.__getitem__, words)) for words in split]


def exact(config: dict) -> bool:
    """Whether a tokenizer's counts add up over words: white space is dropped and nothing is matched across it."""
    normal = [n.get("type") for n in (config.get("normalizer") or {}).get("normalizers", [])]
    steps = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
    drops = bool(steps) and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and "\\s" in json.dumps(steps[0]["pattern"])
    plain = all(not any(c.isspace() for c in t["content"]) and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in config.get("added_tokens", []))
    return normal == ["NFC", "Replace", "Lowercase"] and drops and plain and config.get("post_processor") is None


def _batches(texts: list[str], most: int = 4 << 20) -> Iterator[list[str]]:
    """Parts of `most` characters, so that a task holds little beside its batch."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _fewer(batches: Iterator[pa.RecordBatch], most: int = SEEN) -> Iterator[pa.RecordBatch]:
    """The rows without most of the partition's repeats: those among the last `most` digests and more."""
    seen: set[bytes] = set()
    for b in batches:
        if len(seen) > most:
            seen.clear()
        fresh = []
        for d in b.column("digest").to_pylist():
            fresh.append(d not in seen)
            seen.add(d)
        yield b.filter(pa.array(fresh, pa.bool_()))


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by digest -> the first of each digest."""
    last = None
    for b in batches:
        digests = b.column("digest").to_pylist()
        yield b.filter(pa.array([d != before for before, d in zip([last, *digests], digests)], pa.bool_()))
        last = digests[-1] if digests else last


def encoded(texts: DataFrame, path: str) -> DataFrame:
    """digest, text (repeats allowed) -> digest and n_tokens, a row for each distinct digest."""
    ship(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for b in _first_of_each(batches):
            n = [k for part in _batches(b.column("text").to_pylist()) for k in counter(part)]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    once = texts.select("digest", "text").mapInArrow(_fewer, "digest binary, text string")
    return once.repartition("digest").sortWithinPartitions("digest").mapInArrow(count, "digest binary, n_tokens long")


class TokenCache:
    """Counts by tokenizer version and digest: `folder/version=…/batch=…`, a batch for each run that added rows.

    A batch holds a digest once, and only runs that encoded something leave one. Several batches, which runs at the same
    time may have filled with the same digests, are reduced to one row for each digest that is asked for. compact() makes
    one batch of them, sorted by digest, when nothing else uses the cache.
    """

    def __init__(self, spark: SparkSession, folder: str, path: str):
        self.spark, self.path = spark, path
        with open(path, "rb") as f:
            self.version = hashlib.sha256(f.read()).hexdigest()
        self.folder = f"{folder.rstrip('/')}/version={self.version}"

    def _batches(self) -> list[str]:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
        done = lambda n: fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))
        return [f"{self.folder}/{n}" for n in names if n.startswith("batch=") and done(n)]

    def known(self, asked: DataFrame | None = None) -> DataFrame | None:
        """digest and n_tokens of this version, of the digests in `asked` only; None where the cache has none yet."""
        batches = self._batches()
        if not batches:
            return None
        rows = self.spark.read.schema(CACHE).parquet(*batches)
        rows = rows if asked is None else rows.join(asked.select("digest"), "digest", "left_semi")
        return rows if len(batches) == 1 else rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def add(self, rows: DataFrame) -> None:
        """Add a batch, unless there are no rows."""
        path = f"{self.folder}/batch={uuid.uuid4().hex}"
        rows.select("digest", "n_tokens").write.parquet(path)
        if not self.spark.read.schema(CACHE).parquet(path).head(1):
            discard(self.spark, path)

    def compact(self) -> None:
        """Make one batch of all; not while others add to or read the cache."""
        old, rows = self._batches(), self.known()
        if len(old) > 1:
            self.add(rows.repartitionByRange("digest").sortWithinPartitions("digest"))
            for path in old:
                discard(self.spark, path)

    def counts(self, docs: DataFrame) -> DataFrame:
        """docs with n_bytes, digest and n_tokens; the texts that the cache lacks are encoded and added to it."""
        text = F.coalesce(F.col("text"), F.lit(""))
        names = {c: free_name(docs, c) for c in ("n_bytes", "n_tokens", "digest")}
        keyed = docs.withColumns({names["n_bytes"]: F.octet_length(text).cast("long"), names["digest"]: digest(text)})
        misses = docs.select(text.alias("text")).withColumn("digest", digest(F.col("text")))
        known = self.known()
        if known is not None:
            misses = misses.join(known, "digest", "left_anti")
        self.add(encoded(misses, self.path))
        known = self.known() if len(self._batches()) <= 1 else self.known(docs.select(digest(text).alias("digest")))
        if known is None:
            known = self.spark.createDataFrame([], CACHE)
        if len(self._batches()) > 1:  # written, so that Spark can split the rows of a frequent text in the join
            known = written(known, "token-counts")
        key = free_name(keyed, "known_digest")
        return keyed.join(known.select(F.col("digest").alias(key), F.col("n_tokens").alias(names["n_tokens"])), F.col(names["digest"]) == F.col(key)).drop(key)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = TokenCache(spark, f"{shared_base(spark)}/hostlens/token-cache", tokenizer_path())
    out = cache.counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
