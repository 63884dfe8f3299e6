"""Sharding by size-tiered compaction.

A store is a folder: `data/` holds immutable Parquet shards, `manifest/` a JSON file per version that lists the live
shards with their tier, rows and bytes. `append` writes what arrives as small shards, one per input partition and
without a shuffle; `compact` takes runs of similar size (a tier spans a factor of `fanout`), and where a tier has
`fanout` runs or more merges them into files of about `target_bytes`, again without a shuffle: a merging task reads
several runs and writes one file. Each change becomes visible by renaming one finished manifest file to the next
version's name; a writer that finds the name taken has lost the race and fails, and readers see the old or the new
version, never a part. Files of failed attempts are in no manifest and `vacuum` removes them.

Only file names and sizes pass through the driver, never rows. A shard is never split; one of target size or more
stays as it is. Defined results: nulls, empty and long texts, repeated rows and any further columns are kept as they
are; an empty table gives an empty store. A store's columns are those of the first append; a column named like one
that `read` adds is kept and the added one gets an underscore.

Arrivals are small: a file of an append that is larger than `MOST_APPEND` is written again in pieces of about
`SMALL_BYTES` before the append is committed, so that compaction makes the target-sized files at every size of input.
Renaming must fail where the target exists, as it does on HDFS and local disks; object stores without that promise need
a committer that has it. With `order`, rows are sorted by that column inside each file, and runs are merged in its order.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, shared_dir, table

TARGET_BYTES = 64 << 20
FANOUT = 4
MIN_BYTES = 1 << 20
SMALL_BYTES = TARGET_BYTES // 8
MOST_APPEND = TARGET_BYTES // 2


class Conflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Shard:
    file: str
    bytes: int
    tier: int


def tier_of(size: int, fanout: int = FANOUT, least: int = MIN_BYTES) -> int:
    """Runs below `least` bytes are of tier 0; each further tier spans a factor of `fanout`."""
    return 0 if size < least else 1 + int(math.log(size / least, fanout) + 1e-9)


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, order: str | None = None):
        self.spark, self.path, self.target_bytes, self.fanout, self.order = spark, path.rstrip("/"), target_bytes, fanout, order
        self.small, self.most = max(1, target_bytes * SMALL_BYTES // TARGET_BYTES), max(1, target_bytes * MOST_APPEND // TARGET_BYTES)
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _list(self, path: str) -> list[tuple[str, int]]:
        at = self._at(path)
        return sorted((s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    # -- manifest ---------------------------------------------------------------------------------------------

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        return max([0, *(int(n[1:-5]) for n, _ in self._list(f"{self.path}/manifest") if n.startswith("v") and n.endswith(".json"))])

    def _load(self, version: int) -> dict:
        if not version:
            return {"schema": None, "shards": []}
        stream = self._fs.open(self._at(f"{self.path}/manifest/v{version:08d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**s) for s in self._load(self.version() if version is None else version)["shards"]]

    def _commit(self, base: int, schema: str, shards: list[Shard]) -> int:
        """Make `shards` version base + 1, or raise Conflict if that version exists."""
        body = json.dumps({"schema": schema, "shards": [asdict(s) for s in sorted(shards, key=lambda s: s.file)]})
        draft, final = self._at(f"{self.path}/manifest/.{uuid.uuid4().hex}"), self._at(f"{self.path}/manifest/v{base + 1:08d}.json")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(body.encode()))
        stream.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"version {base + 1} of {self.path} exists")
        return base + 1

    # -- writing ----------------------------------------------------------------------------------------------

    def _pieces(self, draft: str, schema: T.StructType) -> None:
        """Write the draft's files of more than the largest arrival again, by as many rows as make a small one."""
        large = [(n, size) for n, size in self._list(draft) if n.startswith("part-") and size > self.most]
        if not large:
            return
        df = self.spark.read.schema(schema).parquet(*[f"{draft}/{n}" for n, _ in large])
        rows = max(1, df.count() * self.small // sum(size for _, size in large))
        part = f"{draft}/.pieces"
        df.write.option("maxRecordsPerFile", rows).parquet(part)
        for n, _ in large:
            self._fs.delete(self._at(f"{draft}/{n}"), False)
        for n, _ in self._list(part):
            if n.startswith("part-"):
                self._fs.rename(self._at(f"{part}/{n}"), self._at(f"{draft}/{n}"))

    def _write(self, df: DataFrame, arrival: bool) -> list[Shard]:
        """The partitions of df as files, moved from a private folder into data/ once all are written."""
        draft = f"{self.path}/.draft-{uuid.uuid4().hex}"
        df = df.sortWithinPartitions(f"`{self.order}`") if self.order else df
        df.write.option("maxRecordsPerFile", 0).parquet(draft)
        if arrival:
            self._pieces(draft, df.schema)
        self._fs.mkdirs(self._at(f"{self.path}/data"))
        out = []
        for name, size in self._list(draft):
            if name.startswith("part-"):
                self._fs.rename(self._at(f"{draft}/{name}"), self._at(f"{self.path}/data/{name}"))
                out.append(Shard(name, size, tier_of(size, self.fanout)))
        self._fs.delete(self._at(draft), True)
        return out

    def append(self, df: DataFrame) -> int:
        base = self.version()
        now = self._load(base)
        schema = T.StructType.fromJson(json.loads(now["schema"])) if now["schema"] else df.schema
        fresh = self._write(df.select([F.col(f"`{f.name}`").cast(f.dataType) for f in schema.fields]), True)
        return self._commit(base, now["schema"] or df.schema.json(), [Shard(**s) for s in now["shards"]] + fresh)

    def compact(self) -> int:
        """Merge tiers with `fanout` runs or more below target size, smallest first, until there is none."""
        while True:
            base = self.version()
            now = self._load(base)
            live = [Shard(**s) for s in now["shards"]]
            by_tier: dict[int, list[Shard]] = {}
            for s in live:
                if s.bytes < self.target_bytes:
                    by_tier.setdefault(s.tier, []).append(s)
            # Runs that are merged already and cannot fill more of a target file are left alone.
            due = [(t, runs) for t, runs in sorted(by_tier.items()) if len(runs) >= self.fanout and self._files(runs) < len(runs)]
            if not due:
                return base
            runs = due[0][1]
            df = self._rows(now["schema"], [s.file for s in runs])
            merged = self._write(df.coalesce(self._files(runs)), False)
            gone = {s.file for s in runs}
            self._commit(base, now["schema"], [s for s in live if s.file not in gone] + merged)

    def _files(self, runs: list[Shard]) -> int:
        return max(1, math.ceil(sum(s.bytes for s in runs) / self.target_bytes))

    def vacuum(self) -> None:
        """Remove files and versions that the newest version does not use; not while others write or read old ones."""
        newest = self.version()
        used = {s.file for s in self.shards(newest)}
        for name, _ in self._list(f"{self.path}/data"):
            if name not in used:
                self._fs.delete(self._at(f"{self.path}/data/{name}"), False)
        for name, _ in self._list(f"{self.path}/manifest"):
            if name != f"v{newest:08d}.json":
                self._fs.delete(self._at(f"{self.path}/manifest/{name}"), False)

    # -- reading ----------------------------------------------------------------------------------------------

    def _rows(self, schema: str, files: list[str]) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        if not files:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.path}/data/{f}" for f in files])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, each with its shard, the shard's tier and bytes, and the version."""
        version = self.version() if version is None else version
        now = self._load(version)
        shards = [Shard(**s) for s in now["shards"]]
        if now["schema"] is None:
            raise ValueError(f"{self.path} has no version yet")
        df = self._rows(now["schema"], [s.file for s in shards])
        name = {c: free_name(df, c) for c in ("shard", "shard_tier", "shard_bytes", "version")}
        # The scan itself knows each row's file and its size, so nothing has to be joined.
        meta = df.metadataColumn("_metadata") if shards else None  # also where a column of the data has that name
        file, size = (meta["file_name"], meta["file_size"]) if shards else (F.lit(None).cast("string"), F.lit(None).cast("long"))
        tier = F.when(size < MIN_BYTES, 0).otherwise(F.lit(1) + F.floor(F.log(size / MIN_BYTES) / math.log(self.fanout) + 1e-9)).cast("int")
        added = [file.alias(name["shard"]), tier.alias(name["shard_tier"]), size.alias(name["shard_bytes"]), F.lit(version).cast("long").alias(name["version"])]
        return df.select(*[f"`{c}`" for c in df.columns], *added)


def sharded(docs: DataFrame, path: str | None = None, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, order: str | None = None) -> ShardStore:
    """Append docs to a store (a new one by default) and compact it; of a new one, drop what compaction replaced.

    A store at a given path may have other writers and readers: call vacuum() there when none is at work.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, path or shared_dir(spark, "shards"), target_bytes, fanout, order)
    store.append(docs)
    store.compact()
    if path is None:
        store.vacuum()
    return store


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = sharded(table(spark, sf_dir, "documents"))
    return store.read().select("doc_id", "source", F.octet_length("text").alias("text_bytes"), "shard", "shard_tier", "shard_bytes", "version")
