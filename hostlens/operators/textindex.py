"""Which files can hold a text: a Bloom filter of each file's trigrams, kept in a table beside the files.

A search for a text of three letters or more has to read only files whose filter has all of the text's trigrams; files
that the index does not know yet are read in any case, so a search never misses what it would find without the index.
The filters are stored by word (64 bits) and sorted by it: a search reads the few words that its trigrams fall into, for
all files, and no file's whole filter. Files are taken to never change under their names, as Spark's writers have it.

Terms that narrow a search down: free texts, and `=` on one of the indexed columns, with or without wildcards. All other
conditions are left to the search, which is the one of operators.search on the files that are left.
"""

from __future__ import annotations

from collections.abc import Iterable

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sinks.commits import Store
from .search import FREE_TEXT, Query, parse, search

BITS = 1 << 20  # of a file's filter
HASHES = 3
_LOW = 0xFFFFFFFF


def _trigrams(text: Column) -> Column:
    low = F.lower(text)
    return F.when(F.length(low) >= 3, F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3))))


def fragments(query: Query, columns: Iterable[str] = FREE_TEXT) -> list[str]:
    """Lower-cased texts that a file must hold somewhere in its columns for the query to find anything in it."""
    found = [*query.text]
    for name, op, value in query.filters:
        if op == "=" and name in columns:
            found += value.split("*")
    return [f.lower() for f in found if len(f.lower()) >= 3]


def _places(gram: str, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(gram.encode(), 42)
    low, high = h & _LOW, h >> 32 | 1
    return [(low + j * high) & (bits - 1) for j in range(HASHES)]


def required(texts: Iterable[str], bits: int = BITS) -> dict[int, int]:
    """Word and the bits in it that a file's filter must have, for all trigrams of all texts."""
    out: dict[int, int] = {}
    for text in texts:
        for k in range(len(text) - 2):
            for place in _places(text[k : k + 3], bits):
                out[place >> 6] = out.get(place >> 6, 0) | 1 << (place & 63)
    return {word: mask - (1 << 64) if mask >> 63 else mask for word, mask in out.items()}


class TextIndex:
    """The filters of the files of a table, in a store of their own at `path`."""

    def __init__(self, spark: SparkSession, path: str, columns: tuple[str, ...] = FREE_TEXT, bits: int = BITS):
        if bits & (bits - 1) or bits < 64:
            raise ValueError("the bits of a filter are a power of two, 64 at least")
        self.spark, self.columns, self.bits = spark, columns, bits
        self.store = Store(spark, path)

    def known(self) -> DataFrame:
        rows = self.store.read("files")
        return rows if rows is not None else self.spark.createDataFrame([], "file string")

    def filters(self, events: DataFrame) -> DataFrame:
        """file, word, bits of the files that events is read from; a file's words with no bit set are left out."""
        path = events.metadataColumn("_metadata")["file_path"]
        file = F.regexp_replace(path, "^([a-z0-9]+):/(?!/)", "$1:///").alias("file")  # as inputFiles() writes it
        grams = F.array_distinct(F.flatten(F.array(*[F.coalesce(_trigrams(F.col(c)), F.array().cast("array<string>")) for c in self.columns])))
        h = F.xxhash64("gram")
        low, high = h.bitwiseAND(_LOW), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
        place = F.array(*[(low + high * j).bitwiseAND(self.bits - 1) for j in range(HASHES)])
        once = events.select(file, F.explode(grams).alias("gram")).groupBy("file", "gram").agg(F.lit(1).alias("_one"))
        bit = F.expr("shiftleft(1L, CAST(place & 63 AS INT))")
        places = once.select("file", F.explode(place).alias("place")).select("file", F.shiftright("place", 6).alias("word"), bit.alias("bit"))
        return places.groupBy("file", "word").agg(F.bit_or("bit").alias("bits"))

    def update(self, events: DataFrame, at_once: int = 10_000) -> int:
        """Index the files of events that are not yet; how many there were. A fault leaves the index as it was."""
        known = {r.file for r in self.known().collect()}  # names of files, as a listing of the table has them
        new = sorted(f for f in events.inputFiles() if f not in known)
        for k in range(0, len(new), at_once):
            part = new[k : k + at_once]
            tx = self.store.begin()
            rows = self.filters(self.spark.read.schema(events.schema).parquet(*part))
            tx.append("filters", rows.repartitionByRange("word").sortWithinPartitions("word"))
            tx.append("files", self.spark.createDataFrame([(f,) for f in part], "file string"))
            tx.commit()
        return len(new)

    def can_hold(self, texts: list[str]) -> DataFrame:
        """file: the indexed files that can hold all of the texts."""
        need = required([t for t in texts if len(t) >= 3], self.bits)
        if not need:
            return self.known()
        rows = self.store.read("filters")
        if rows is None:
            return self.known()
        masks = F.create_map(*[F.lit(x) for word, mask in need.items() for x in (word, mask)])
        rows = rows.filter(F.col("word").isin(*need)).withColumn("mask", F.element_at(masks, F.col("word").cast("int")).cast("long"))
        return rows.filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).groupBy("file").agg(F.count("*").alias("n")).filter(F.col("n") == len(need)).select("file")

    def files(self, events: DataFrame, query: Query) -> list[str]:
        """The files of events that the query has to read."""
        texts, every = fragments(query, self.columns), events.inputFiles()
        if not texts:
            return list(every)
        known = {r.file for r in self.known().collect()}
        some = {r.file for r in self.can_hold(texts).collect()}
        return [f for f in every if f not in known or f in some]

    def search(self, events: DataFrame, query: str | Query, now: Column | None = None) -> DataFrame:
        """operators.search over the files that can hold what the query asks for. events: as read from Parquet files."""
        q = parse(query) if isinstance(query, str) else query
        files = self.files(events, q)
        rows = self.spark.read.schema(events.schema).parquet(*files) if files else self.spark.createDataFrame([], T.StructType(events.schema.fields))
        return search(rows, q, now)
