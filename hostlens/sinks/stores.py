"""Tables that writers keep: events, sessions, states, blobs, baselines, incident files and forwarded lines.

A table is a folder of Parquet files. Appends carry the batch's number as a partition and replace what an earlier
attempt of that batch wrote, so a batch that is run again leaves one copy. Current-state tables (sessions, states,
baselines) are written as a new version next to the old one; the newest version that is complete is read.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def append_batch(df: DataFrame, path: str, batch: int) -> None:
    """Append a micro-batch once, however often it is tried."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


class VersionedTable:
    """The newest row of each key, rewritten as a whole with each merge."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str]):
        self.spark, self.path, self.keys, self.order = spark, path, keys, order

    def _versions(self) -> list[str]:
        return [v for v in _names(self.spark, self.path) if v.startswith("v") and "_SUCCESS" in _names(self.spark, f"{self.path}/{v}")]

    def read(self) -> DataFrame | None:
        done = self._versions()
        return self.spark.read.parquet(f"{self.path}/{done[-1]}") if done else None

    def delete(self, gone: DataFrame, keep: int = 2) -> None:
        """A version without the rows whose keys are in `gone`."""
        old = self.read()
        if old is not None:
            self._store(old.join(gone.select(*self.keys).distinct(), self.keys, "left_anti").select(*old.columns), keep)

    def merge(self, changes: DataFrame, keep: int = 2) -> None:
        """Insert or update by key: of old and new rows the last in order counts. Old versions beyond `keep` go."""
        old = self.read()
        every = changes.withColumn("_new", F.lit(1))
        if old is not None:
            every = old.withColumn("_new", F.lit(0)).unionByName(every)
        last = Window.partitionBy(*self.keys).orderBy(*[F.col(c).desc() for c in self.order], F.col("_new").desc())
        self._store(every.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "_new"), keep)

    def _store(self, out: DataFrame, keep: int) -> None:
        done = self._versions()
        n = int(done[-1][1:]) + 1 if done else 1
        out.write.mode("overwrite").parquet(f"{self.path}/v{n:08d}")
        for v in done[: max(0, len(done) + 1 - keep)]:
            fs, at = _fs(self.spark, f"{self.path}/{v}")
            fs.delete(at, True)


def write_ndjson(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """One JSON object a line, in files of a bounded number of rows."""
    df.write.option("maxRecordsPerFile", rows_per_file).mode("append").json(path)


def deflated(content: Column) -> Column:
    """Binary content as a zlib stream; null for null. Spark has no such function, so Arrow batches go through Python."""
    ship(SparkSession.active())
    return _deflate(content)


def inflated(content: Column) -> Column:
    """What `deflated` was given; null for null and for bytes that are no whole zlib stream."""
    ship(SparkSession.active())
    return _inflate(content)


@F.pandas_udf(T.BinaryType())
def _deflate(x: pd.Series) -> pd.Series:
    return x.map(zlib.compress, na_action="ignore")


@F.pandas_udf(T.BinaryType())
def _inflate(x: pd.Series) -> pd.Series:
    def back(data: bytes) -> bytes | None:
        try:
            return zlib.decompress(data)
        except zlib.error:
            return None

    return x.map(back, na_action="ignore")


def keep_newest(spark: SparkSession, path: str, keep: int) -> list[str]:
    """Remove the files of a folder of forwarded lines but the newest `keep`; the names of those that went."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return []
    files = [f for f in fs.listStatus(at) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
    old = sorted(files, key=lambda f: (f.getModificationTime(), f.getPath().getName()), reverse=True)[keep:]
    for f in old:
        fs.delete(f.getPath(), False)
    return sorted(f.getPath().getName() for f in old)


def next_incident(existing: DataFrame, year: int, column: str = "name") -> DataFrame:
    """The next number of a year after incident files named INC-<year>-<number>.…"""
    number = F.max(F.regexp_extract(column, rf"^INC-{year}-([0-9]{{1,9}})", 1).try_cast("long"))
    return existing.agg((F.coalesce(number, F.lit(0)) + 1).alias("next"))


def severe(events: DataFrame, minimum: int) -> DataFrame:
    """The events that are forwarded: those of at least this severity."""
    return events.filter(F.col("severity") >= minimum)


def forward(df: DataFrame, column: str, host: str, port: int, protocol: str = "tcp", limit: int = 8192) -> None:
    """Send a column's lines to a collector from the tasks that have them; UDP packets are cut at `limit` bytes, TCP
    lines carry their length in front. A failed task sends its lines again."""

    def send(rows) -> None:
        import socket

        if protocol == "udp":
            with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
                for r in rows:
                    s.sendto(r[0].encode()[:limit], (host, port))
            return
        with socket.create_connection((host, port), timeout=10) as s:
            for r in rows:
                data = r[0].encode()
                s.sendall(str(len(data)).encode() + b" " + data)

    df.select(column).foreachPartition(send)
