"""A watched set of files: the baseline as a state, a silent first pass, and rescans that tell only what differs.

The baseline and the changes are tables of one store: a rescan that finds differences commits both at once, so a change
is told once however often a rescan is tried, and a rescan without differences writes nothing. Each host has its first
pass to itself: a host that joins later does not report its files as created.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import integrity
from ..sinks.commits import Store

COLUMNS = ("host", "path", "sha256", "size", "mtime", "mode", "uid")


class BaselineWatcher:
    """files() lists what is there now: COLUMNS, of every host that could be listed (hosts without a row are left as they are)."""

    def __init__(self, spark: SparkSession, path: str, files: Callable[[], DataFrame], name: str = "baseline"):
        self.spark, self.files, self.name = spark, files, name
        self.store = Store(spark, path)

    def rescan(self, batch: int | None = None, us: int | None = None) -> DataFrame:
        """The events of what has changed since the last scan. A batch that is run again takes the place of its first run."""
        us = int(time.time() * 1_000_000) if us is None else us
        tx = self.store.begin(self.name, batch)
        old, now = tx.read("files"), self.files().select(*COLUMNS)
        if old is None:
            tx.replace("files", now)
            tx.append("changes", self._events(now.limit(0), now.limit(0), us), "us")
            tx.commit()
            return self.changes().limit(0)
        # Written first: the listing is read several times, and files may change meanwhile.
        now = tx.replace("files", now.unionByName(old.join(now.select("host").distinct(), "host", "left_anti").select(*COLUMNS)))
        known = now.join(old.select("host").distinct(), "host", "left_semi")
        found = tx.append("changes", self._events(old.join(now.select("host").distinct(), "host", "left_semi"), known, us), "us")
        if not found.head(1) and not now.join(old.select("host").distinct(), "host", "left_anti").head(1):
            return found  # nothing new: the version stays, and vacuum removes what was written
        tx.commit()
        return found

    def _events(self, old: DataFrame, now: DataFrame, us: int) -> DataFrame:
        # A path on a host is one key, with a separator that no host name holds.
        keyed = lambda df: df.withColumn("path", F.concat_ws(chr(31), "host", "path")).select(*COLUMNS[1:])
        both = integrity.compare_baseline(keyed(old), keyed(now))
        parts = F.split("path", chr(31), 2)
        both = both.withColumns({"host": parts[0], "path": parts[1]})
        return integrity.file_events(both, keep=["host"]).withColumn("us", F.lit(us).cast("long"))

    def changes(self, since_us: int | None = None) -> DataFrame:
        return self.store.read("changes", since_us=since_us)

    def watch(self, checkpoint: str, every_seconds: float = 3600):
        """A running query that rescans every so often; its batches are the rescans."""
        clock = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return clock.writeStream.queryName(self.name).option("checkpointLocation", checkpoint).trigger(processingTime=f"{every_seconds} seconds").foreachBatch(lambda _, batch: self.rescan(batch) and None).start()
