"""A streaming source that follows channels (event logs, journals) by cursor, from pages that a recorder has put down.

A channel is a folder of pages named `<first>-<last>.<suffix>` after the record ids they hold, one record a line (a
journal entry as JSON, an event's XML on one line). Pages are written under another name and renamed, and never change,
so an offset (the last record id of each channel) always stands for the same rows: any range of offsets can be read
again. The driver lists names; rows are read by the tasks, a channel's pages of a batch in a task of their own.

A batch takes at most `pages` pages of a channel. What has been handed out is noted beside the channels before the
batch is planned, so a query that is started again goes on with its next pages, at most twice as many at first. Record
ids that no page holds are told as `gap` on the row that follows them; pages that were there when a batch was planned
and are gone when it is read again are an error, not a gap.

On a cluster the workers need this package (session.ship).

Options: path; pages (40); start (`first`, or `latest`: from the newest record less `backfill`, 0 by default);
name (of the query, where several follow the same channels).
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

PAGE = 250
_NAME = re.compile(r"^(\d+)-(\d+)\.\w+$")


def _open(path: str):
    """A file system, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record(path: str, channel: str, first: int, lines: list[str], page: int = PAGE) -> None:
    """Put down records with the ids from `first` on, as pages."""
    at, folder = _open(path.rstrip("/"))
    at.create_dir(f"{folder}/{channel}", recursive=True)
    for k in range(0, len(lines), page):
        part = lines[k : k + page]
        draft = f"{folder}/{channel}/.{uuid.uuid4().hex}"
        with at.open_output_stream(draft) as out:
            out.write("".join(x.replace("\n", " ") + "\n" for x in part).encode())
        at.move(draft, f"{folder}/{channel}/{first + k:020d}-{first + k + len(part) - 1:020d}.log")


@dataclass
class Pages(InputPartition):
    """Pages of a channel, of which the records after `start` up to `end` are read."""

    channel: str
    files: list[str]
    start: int
    end: int


class Channels(DataSource):
    @classmethod
    def name(cls) -> str:
        return "channels"

    def schema(self) -> str:
        return "channel string, record_id bigint, gap bigint, value string"

    def streamReader(self, schema) -> ChannelReader:  # noqa: N802
        o = self.options
        return ChannelReader(o["path"], int(o.get("pages", "40")), o.get("start", "first"), int(o.get("backfill", "0")), o.get("name", "default"))


class ChannelReader(DataSourceStreamReader):
    def __init__(self, path: str, pages: int = 40, start: str = "first", backfill: int = 0, name: str = "default"):
        self.path, self.pages, self.start, self.backfill, self.name = path.rstrip("/"), pages, start, backfill, name

    # -- names --------------------------------------------------------------------------------------------------------

    def _listed(self) -> dict[str, list[tuple[int, int, str]]]:
        """The pages of each channel (first id, last id, path), in order."""
        from pyarrow import fs

        at, folder = _open(self.path)
        found: dict[str, list[tuple[int, int, str]]] = {}
        for info in at.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)):
            channel, _, base = info.path[len(folder) + 1 :].rpartition("/")
            if info.type == fs.FileType.File and channel and not channel.startswith(".") and (m := _NAME.match(base)):
                found.setdefault(channel, []).append((int(m[1]), int(m[2]), info.path))
        return {c: sorted(pages) for c, pages in sorted(found.items())}

    def _note(self, change: dict | None = None) -> dict:
        """What is noted of earlier runs, after `change`."""
        at, folder = _open(self.path)
        path = f"{folder}/.progress/{self.name}.json"
        try:
            with at.open_input_stream(path) as f:
                known = json.loads(f.read())
        except FileNotFoundError:
            known = {}
        if change:
            known |= change
            at.create_dir(f"{folder}/.progress", recursive=True)
            with at.open_output_stream(f"{path}.new") as out:
                out.write(json.dumps(known).encode())
            at.move(f"{path}.new", path)
        return known

    # -- offsets ------------------------------------------------------------------------------------------------------

    def initialOffset(self) -> dict:  # noqa: N802
        known = self._note()
        if "initial" not in known:
            newest = {c: p[-1][1] for c, p in self._listed().items()}
            known = self._note({"initial": {c: max(0, n - self.backfill) for c, n in newest.items()} if self.start == "latest" else {}})
        return known["initial"]

    def latestOffset(self) -> dict:  # noqa: N802
        end = dict(self._note().get("end", self.initialOffset()))
        for channel, pages in self._listed().items():
            new = [last for _, last, _ in pages if last > end.get(channel, 0)]
            if new:
                end[channel] = new[min(self.pages, len(new)) - 1]
        self._note({"end": end})
        return end

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        listed, out = self._listed(), []
        for channel, last in sorted(end.items()):
            before = start.get(channel, 0)
            files = [(a, b, f) for a, b, f in listed.get(channel, []) if b > before and a <= last]
            if last > before:
                if not files or files[-1][1] < last:
                    raise FileNotFoundError(f"pages of {channel} up to {last} are gone")
                out += [Pages(channel, [f for _, _, f in files[k : k + self.pages]], before if not k else files[k - 1][1], last) for k in range(0, len(files), self.pages)]
        return out

    def read(self, partition: Pages):
        at, _ = _open(self.path)
        before = partition.start
        for path in partition.files:
            first = int(_NAME.match(path.rpartition("/")[2])[1])
            with at.open_input_stream(path) as f:
                lines = f.read().decode("utf-8", "replace").split("\n")
            for n, line in enumerate(lines[:-1]):
                record_id = first + n
                if partition.start < record_id <= partition.end:
                    yield (partition.channel, record_id, record_id - before - 1, line)
                    before = record_id

    def commit(self, end: dict) -> None:
        pass
