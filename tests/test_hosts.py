"""The state of a host: order, the hold and its limit, marks, sessions, reaping, rows that break."""

import json
import os
import time

from pyspark.sql import functions as F

from hostlens.operators import sessions
from hostlens.schema import adapted
from hostlens.streaming import hosts
from tests.test_streaming import in_parts

EVENT = "host string, us long, arrival_seq long, id long, action string, category string, user string, src_ip string, protocol string, target string, message string, keys array<string>, learn array<string>, ts timestamp"


class Feed:
    """Rows of a stream, a file a batch, and what has come out so far."""

    def __init__(self, spark, folder, name, **settings):
        self.spark, self.folder, self.name, self.n = spark, str(folder), name, 0
        os.makedirs(f"{self.folder}/in")
        stream = spark.readStream.schema(EVENT).json(f"{self.folder}/in")
        self.q = hosts.host_rows(stream, **settings).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{self.folder}/cp").start()

    def put(self, *rows):
        lines = [json.dumps({"host": "h", "arrival_seq": self.n * 100 + k} | r) for k, r in enumerate(rows)]
        self.n += 1
        with open(f"{self.folder}/.part", "w") as f:
            f.write("\n".join(lines))
        os.rename(f"{self.folder}/.part", f"{self.folder}/in/{self.n:03d}.json")

    def out(self, least, seconds=60):
        until = time.time() + seconds
        while time.time() < until:
            got = self.spark.table(self.name).collect()
            if len(got) >= least:
                return got
            if not self.q.isActive:
                raise self.q.exception()
            time.sleep(0.3)
        return self.spark.table(self.name).collect()


def event(n, s, **more):
    return {"id": n, "us": None if s is None else s * 1_000_000, "action": "file.modified", "category": "file"} | more


def test_hold_limit_and_marks(spark, tmp_path):
    feed = Feed(spark, tmp_path, "hold", hold_seconds=2, most_seconds=6)
    try:
        feed.put(event(1, 10), event(2, 5), event(3, 11), event(4, None), {"action": hosts.MARK, "category": "agent", "target": "log", "message": "100"}, event(5, 9, host="other"))
        at = time.time()
        got = feed.out(2)
        ids = lambda rows: [json.loads(r.body).get("id", "mark") for r in rows]
        assert sorted(ids(got)) == [2, 4]
        got = feed.out(6)  # no further data: the limit lets go, in order, and the mark comes with the rows before it
        assert time.time() - at >= 5.5
        mine = [x for x in ids([r for r in got if r.host == "h"])]
        assert mine.index(1) < mine.index(3) and mine[-1] == "mark" and sorted(map(str, ids(got))) == ["1", "2", "3", "4", "5", "mark"]
        assert {r.kind for r in got} == {"event", "mark"}
    finally:
        feed.q.stop()


def test_late_rows_and_marks_wait_for_what_came_before(spark, tmp_path):
    feed = Feed(spark, tmp_path, "late", hold_seconds=2, most_seconds=600)
    mark = lambda x: {"action": hosts.MARK, "category": "agent", "target": "log", "message": x}
    try:
        feed.put(event(1, 10), mark("a"), event(2, 12), mark("b"))
        assert [r.kind for r in feed.out(2)] == ["event", "mark"]
        feed.put(event(3, 8), event(4, 14))
        got = feed.out(5)
        assert [(r.kind, json.loads(r.body).get("id") or json.loads(r.body)["message"]) for r in got] == [("event", 1), ("mark", "a"), ("event", 3), ("event", 2), ("mark", "b")]
    finally:
        feed.q.stop()


def test_sessions_end_without_a_logoff_and_bad_rows_pass(spark, tmp_path):
    feed = Feed(spark, tmp_path, "reap", hold_seconds=0, most_seconds=2, reap_seconds=3)
    login = lambda n, s, user, *keys: event(n, s, action="session.start", category="session", user=user, protocol="ssh", src_ip="203.0.113.5", keys=list(keys))
    try:
        feed.put(login(1, 1, "ann", "pid:11"), login(2, 2, "bob", "pid:12"), login(3, 3, "cid", "tty:1"), login(4, 4, "dot", "ts:7"))
        assert len(feed.out(4)) == 4
        feed.put(event(5, 10, action=hosts.ALIVE, category="agent", learn=["pid:11"]), event(6, 11, action="session.start", category="session", user="eve", keys=["pid:99"]), event(7, 12, keys=[None, "x"], learn=["y"]))
        got = feed.out(7)
        ends = [r for r in got if r.kind == "ended"]
        assert [(r.tracked_user, r.us, r.tracked_action) for r in ends] == [("bob", 10_000_000, "session.ended_unobserved")] and "processes are gone" in ends[0].error
        feed.put(event(8, 20, action=hosts.PRESENT, category="session", target="ts", keys=["ts:9"]), event(9, 21, action="session.end", category="session", keys=["ts:7"]), event(10, 22, action="session.end", category="session", keys=["tty:1"]))
        got = feed.out(9)
        assert [(r.tracked_user, r.us) for r in got if r.kind == "ended"][1:] == [("dot", 20_000_000)]
        assert [r.tracked_user for r in got if r.tracked_action == "session.end"] == ["cid"]  # the other one is gone already
    finally:
        feed.q.stop()


def test_order_and_sessions_equal_the_batch_form(spark, sf, tmp_path):
    """Shuffled rows within the hold, in three batches, against sessions.track over all of them."""
    e = adapted(spark, sf).withColumns({"arrival_seq": F.col("id"), "keys": F.array(F.concat(F.lit("ip:"), F.coalesce("src_ip", F.lit("-")))), "learn": F.lit(None).cast("array<string>"), "action": F.when((F.col("category") == "file") & (F.col("id") % 3 == 0), "session.end").otherwise(F.col("action"))})
    span = e.agg(F.max("us") - F.min("us")).first()[0] // 1_000_000
    folder = tmp_path / "f"
    folder.mkdir()
    stream = in_parts(spark, e.withColumn("noise", F.col("us") + F.pmod(F.xxhash64("id"), F.lit(span // 10)) * 1_000_000), str(folder), 3, order="noise")
    rows = hosts.host_rows(stream.drop("noise"), hold_seconds=span // 10 + 1, most_seconds=8)
    q = rows.writeStream.format("memory").queryName("ordered").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    want = sorted((r.id, r.us, r.user, r.ts, r.value, r.tracked_session or "", r.tracked_action, r.merged) for r in sessions.track(e).collect())
    until = time.time() + 90
    while time.time() < until and spark.table("ordered").count() < len(want) and q.isActive:
        time.sleep(0.5)
    q.stop()
    got = hosts.opened(spark.table("ordered"), e.schema)
    assert dict(got.dtypes)["ts"] == "timestamp"
    show = sorted((r.id, r.us, r.user, r.ts, r.value, r.tracked_session or "", r.tracked_action, r.merged) for r in got.collect())
    assert [x[:5] for x in show] == [x[:5] for x in want]
    assert show == want
