"""Channels by cursor: any range of offsets again, pages of a batch, restarts, gaps."""

import json
import os

import pytest

from hostlens.sources import journal
from hostlens.streaming.channels import ChannelReader, Channels, record


def rows(reader, start, end):
    return [r for p in reader.partitions(start, end) for r in reader.read(p)]


def test_every_range_reads_the_same_again(tmp_path):
    record(str(tmp_path), "security", 1, [f"s{k}" for k in range(1, 24)], page=5)
    record(str(tmp_path), "ts/lsm", 1, [f"t{k}" for k in range(1, 8)], page=3)
    reader = ChannelReader(str(tmp_path), pages=2)
    ends = [reader.initialOffset()]
    while (end := reader.latestOffset()) != ends[-1]:
        ends.append(end)
    assert ends == [{}, {"security": 10, "ts/lsm": 6}, {"security": 20, "ts/lsm": 7}, {"security": 23, "ts/lsm": 7}]
    whole = rows(reader, {}, ends[-1])
    assert [(c, n) for c, n, *_ in whole] == [("security", k) for k in range(1, 24)] + [("ts/lsm", k) for k in range(1, 8)]
    assert all(g == 0 and v == f"{c[0]}{n}" for c, n, g, v in whole)
    other = ChannelReader(str(tmp_path), pages=7)
    for a in range(0, 24, 3):
        for b in range(a, 24, 4):
            assert rows(other, {"security": a}, {"security": b}) == [r for r in whole if r[0] == "security" and a < r[1] <= b]
    assert max(len(p.files) for p in reader.partitions({}, ends[-1])) == 2


def test_gaps_and_pages_that_are_gone(tmp_path):
    record(str(tmp_path), "c", 5, ["a", "b"])
    record(str(tmp_path), "c", 10, ["d"])
    reader = ChannelReader(str(tmp_path))
    assert rows(reader, {}, {"c": 10}) == [("c", 5, 4, "a"), ("c", 6, 0, "b"), ("c", 10, 3, "d")]
    for f in os.listdir(tmp_path / "c"):
        os.remove(tmp_path / "c" / f)
    with pytest.raises(FileNotFoundError):
        rows(reader, {}, {"c": 10})
    record(str(tmp_path), "c", 20, ["e"])
    assert rows(reader, {"c": 10}, reader.latestOffset()) == [("c", 20, 9, "e")]


def test_start_at_the_newest_stays_where_it_was(tmp_path):
    record(str(tmp_path), "c", 1, [str(k) for k in range(1, 101)])
    reader = ChannelReader(str(tmp_path), start="latest", backfill=10)
    assert reader.initialOffset() == {"c": 90}
    record(str(tmp_path), "c", 101, ["101"])
    assert ChannelReader(str(tmp_path), start="latest", backfill=10).initialOffset() == {"c": 90}
    assert [r[1] for r in rows(reader, {"c": 90}, reader.latestOffset())] == list(range(91, 102))


def entry(k):
    return json.dumps({"__REALTIME_TIMESTAMP": str(1_700_000_000_000_000 + k), "SYSLOG_IDENTIFIER": "sshd", "_PID": "7", "MESSAGE": f"Failed password for u{k} from 203.0.113.9 port 22 ssh2", "__CURSOR": f"c{k}"})


def test_a_query_goes_on_where_it_was(spark, tmp_path):
    spark.dataSource.register(Channels)
    folder = str(tmp_path / "log")
    record(folder, "journal", 1, [entry(k) for k in range(1, 901)])
    seen = []

    def run(limit=None):
        def take(df, batch):
            got = sorted(r.record_id for r in df.collect())
            if limit is not None and batch >= limit:
                raise RuntimeError("stopped")
            seen.append(got)

        q = spark.readStream.format("channels").option("path", folder).option("pages", "2").load().writeStream.foreachBatch(take).option("checkpointLocation", f"{tmp_path}/cp").start()
        try:
            q.processAllAvailable()
        except Exception:  # noqa: BLE001
            pass
        q.stop()

    run(limit=1)
    assert seen == [list(range(1, 501))]
    record(folder, "journal", 901, [entry(k) for k in range(901, 951)])
    run()
    assert [x for part in seen for x in part] == list(range(1, 951)) and max(map(len, seen)) <= 1000
    lines = spark.read.text(f"{folder}/journal")
    assert journal.journal_lines(lines).count() == 950
