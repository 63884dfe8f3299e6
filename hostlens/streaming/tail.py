"""A streaming source that follows growing log files in a folder.

A file is known by device and inode, so a rename does not start it over; a file that is shorter than what was read has
been truncated in place and is read from its start. Only whole lines are handed on. Lines read after a truncation
say so; where there are none yet, a row without a value does.

Offsets hold where each file was left and how often it had been truncated, so a batch that is run again after a
truncation reads the file from its start, too.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

MOST_BYTES, MOST_LINE = 8 << 20, 64 << 10
CUTS = "cuts:"


def truncations(rows: DataFrame) -> DataFrame:
    """The log.truncated events of followed authentication logs: severity 3 (high), the file as target.

    The row at the start of a truncated file stands for the truncation."""
    cut = rows.filter("truncated AND offset = 0")
    message = F.concat("file", F.lit(" was truncated in place (not rotated): possible log tampering"))
    return cut.select(F.lit("agent").alias("category"), F.lit("log.truncated").alias("action"), F.lit(3).alias("severity"), F.col("file").alias("target"), message.alias("message"))


class LogTail(DataSource):
    """Options: path (a folder that every node sees, or the driver's own), pattern (a glob, default *.log)."""

    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return "value string, file string, offset bigint, truncated boolean"

    def simpleStreamReader(self, schema) -> LogTailReader:  # noqa: N802
        return LogTailReader(self.options["path"], self.options.get("pattern", "*.log"))


class LogTailReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def _files(self) -> dict[str, str]:
        from pathlib import Path

        found = {}
        for p in sorted(Path(self.path).glob(self.pattern)):
            s = os.stat(p)
            found[f"{s.st_dev}:{s.st_ino}"] = str(p)
        return found

    def read(self, start: dict) -> tuple:
        rows, end = [], dict(start)
        for key, path in self._files().items():
            at, cut = start.get(key, 0), False
            if os.path.getsize(path) < at:
                at, cut = 0, True
                end[CUTS + key] = start.get(CUTS + key, 0) + 1
            with open(path, "rb") as f:
                f.seek(at)
                data = f.read(MOST_BYTES)
            whole = data.rfind(b"\n") + 1
            if not whole and len(data) >= MOST_LINE:  # a line beyond the limit is handed on in parts
                whole = MOST_LINE
            for line in data[:whole].splitlines(True):
                rows.append((line.rstrip(b"\r\n").decode("utf-8", "replace"), os.path.basename(path), at, cut))
                at += len(line)
            if cut and not whole:
                rows.append((None, os.path.basename(path), 0, True))
            end[key] = at
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict):  # noqa: N802
        """The rows of a batch that is run again: from start to end of each file."""
        rows = []
        for key, path in self._files().items():
            a, b = start.get(key, 0), end.get(key, 0)
            cut = end.get(CUTS + key, 0) != start.get(CUTS + key, 0)
            if cut:
                a = 0
                if not b:
                    rows.append((None, os.path.basename(path), 0, True))
            if b > a:
                with open(path, "rb") as f:
                    f.seek(a)
                    for line in f.read(b - a).splitlines(True):
                        rows.append((line.rstrip(b"\r\n").decode("utf-8", "replace"), os.path.basename(path), a, cut))
                        a += len(line)
        return iter(rows)

    def commit(self, end: dict) -> None:
        pass
