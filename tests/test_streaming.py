import json
import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from hostlens.operators import rules, sessions
from hostlens.schema import adapted
from hostlens.sinks import formats, stores
from hostlens.streaming import stateful
from hostlens.streaming.tail import LogTail, LogTailReader, truncations


def in_parts(spark, df, folder, n, order="us"):
    """df written as n files in time order, and a stream that reads one file a batch."""
    rows = df.count()
    numbered = df.withColumn("_n", F.row_number().over(Window.orderBy(order)))
    os.makedirs(f"{folder}/in")
    for j in range(n):
        numbered.filter((F.col("_n") > rows * j // n) & (F.col("_n") <= rows * (j + 1) // n)).drop("_n").coalesce(1).write.parquet(f"{folder}/p{j}")
        (part,) = [f for f in os.listdir(f"{folder}/p{j}") if f.endswith(".parquet") and f.startswith("part-")]
        os.rename(f"{folder}/p{j}/{part}", f"{folder}/in/{j:03d}.parquet")
        os.utime(f"{folder}/in/{j:03d}.parquet", (1000 + j, 1000 + j))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def run(stream, folder, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/cp-{name}").start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def test_cooldown_equals_batch(spark, sf, tmp_path):
    c = adapted(spark, sf).filter("action = 'auth.failure'").select("host", "us", "id")
    want = sorted(r.id for r in rules.with_cooldown(c, ["host"], 6 * 3600).collect())
    got = run(stateful.stream_cooldown(in_parts(spark, c, str(tmp_path), 3), ["host"], 6 * 3600), tmp_path, "cooldown")
    assert sorted(r.id for r in got.collect()) == want and len(want) > 10


def test_sessions_equal_batch(spark, sf, tmp_path):
    e = adapted(spark, sf).withColumns({"arrival_seq": F.col("id"), "keys": F.array(F.concat(F.lit("ip:"), F.coalesce("src_ip", F.lit("-")))), "learn": F.lit(None).cast("array<string>"), "action": F.when((F.col("category") == "file") & (F.col("id") % 3 == 0), "session.end").otherwise(F.col("action"))})
    e = e.select("host", "us", "id", "arrival_seq", "action", "category", "user", "src_ip", "protocol", "keys", "learn")
    show = lambda df: sorted((r.id, r.tracked_session or "", r.tracked_action, r.merged) for r in df.collect())
    got = run(stateful.stream_sessions(in_parts(spark, e, str(tmp_path), 3)), tmp_path, "tracked")
    assert show(got) == show(sessions.track(e))


def test_windows_and_debounce(spark, sf, tmp_path):
    e = adapted(spark, sf).select("ts", "us", "action", "src_ip", "user")
    s = in_parts(spark, e, str(tmp_path), 2)
    got = run(stateful.failure_windows(s, "2 days", "1 day", "30 days"), tmp_path, "windows")
    assert got.count() == 0  # nothing is older than the watermark yet
    got = run(stateful.failure_windows(s, "2 days", "1 day", "1 minute"), tmp_path, "windows2")
    assert got.filter("failures > 0").count() == got.count() > 0
    got = run(stateful.debounced_notices(s.withColumn("path", F.col("action")), "1 hour", "1 minute"), tmp_path, "notices")
    assert got.count() > 5


def test_held_order_drops_nothing(spark, tmp_path):
    seen = []
    held = stateful.HeldOrder(f"{tmp_path}/held", lambda df, batch: seen.append([(r.id, batch) for r in df.collect()]), 2)
    schema = "id long, arrival_seq long, s long"
    for batch, rows in enumerate([[(1, 0, 10), (2, 1, 5), (3, 2, 11)], [(4, 3, 8), (5, 4, 13)], [(6, 5, 1)]]):
        held(spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")), batch)
    held.flush(spark, 2, spark.createDataFrame([], schema).withColumn("ts", F.timestamp_seconds("s")).schema)
    assert seen == [[(2, 0)], [(4, 1), (1, 1), (3, 1)], [(6, 2)], [(5, 3)]]
    held(spark.createDataFrame([(6, 5, 1), (7, 6, None)], schema).withColumn("ts", F.timestamp_seconds("s")), 2)  # tried again
    assert seen[-1] == [(7, 2), (6, 2)]
    assert sorted(n for n in os.listdir(f"{tmp_path}/held") if n.startswith("batch")) == ["batch=1", "batch=2"]


def test_tail(spark, tmp_path):
    log, r = tmp_path / "a.log", LogTailReader(str(tmp_path), "*.log*")

    def read(at):
        rows, end = r.read(at)
        return [(v, cut) for v, _, _, cut in rows], end

    log.write_bytes(b"one\ntwo\npart")
    got, at = read(r.initialOffset())
    assert got == [("one", False), ("two", False)]
    with log.open("ab") as f:
        f.write(b"ial\n")
    got, at = read(at)
    assert got == [("partial", False)]
    log.rename(tmp_path / "a.log.1")
    log.write_bytes(b"new\n")
    got, at = read(at)
    assert got == [("new", False)]
    log.write_bytes(b"x\n")
    got, _ = read(at)
    assert got == [("x", True)]
    spark.dataSource.register(LogTail)
    q = spark.readStream.format("logtail").option("path", str(tmp_path)).load()
    assert sorted(x.value for x in run(q, tmp_path, "tailed").collect()) == ["x"]


def test_stores(spark, tmp_path):
    t = stores.VersionedTable(spark, f"{tmp_path}/t", ["k"], ["n"])
    assert t.read() is None
    make = lambda *rows: spark.createDataFrame(list(rows), "k string, n long, v string")
    t.merge(make(("a", 1, "x"), ("b", 1, "x")))
    t.merge(make(("a", 2, "y"), ("a", 0, "old"), ("c", 1, "z")))
    t.merge(make(("c", 1, "again")))
    assert sorted(tuple(r) for r in t.read().collect()) == [("a", 2, "y"), ("b", 1, "x"), ("c", 1, "again")]
    assert len(t._versions()) == 2
    t.delete(make(("b", 9, "any"), ("none", 1, "x")))
    assert sorted(r.k for r in t.read().collect()) == ["a", "c"]
    stores.append_batch(make(("a", 1, "x")), f"{tmp_path}/b", 0)
    stores.append_batch(make(("a", 1, "x")), f"{tmp_path}/b", 0)
    assert stores.read_batches(spark, f"{tmp_path}/b").count() == 1
    stores.write_ndjson(make(*[("a", k, "é") for k in range(5)]).coalesce(1), f"{tmp_path}/j", 2)
    lines = [x.value for x in spark.read.text(f"{tmp_path}/j").collect()]
    assert sorted(json.loads(x)["n"] for x in lines) == list(range(5))
    names = spark.createDataFrame([("INC-2024-000007.json",), ("INC-2023-000099.json",), ("x",)], "name string")
    assert [stores.next_incident(names, y).first().next for y in (2024, 2025)] == [8, 1]


def test_forwarding(spark):
    import socket
    import threading

    got, server = [], socket.create_server(("127.0.0.1", 0))

    def serve():
        c, _ = server.accept()
        with c:
            while data := c.recv(4096):
                got.append(data)

    thread = threading.Thread(target=serve)
    thread.start()
    df = spark.createDataFrame([("é1",), ("2",)], "line string").coalesce(1)
    stores.forward(df, "line", "127.0.0.1", server.getsockname()[1])
    thread.join(10)
    server.close()
    assert b"".join(got) == "3 é11 2".encode()


def test_formats(spark):
    n = spark.createDataFrame([("T", "line1\nline2")], "title string, text string")
    for kind, key in (("slack", "text"), ("discord", "content"), ("teams", "summary"), ("generic", "title")):
        assert key in json.loads(n.select(formats.chat_payload(n, kind).alias("j")).first().j)
    assert "<td>&lt;b&gt;</td>" in formats.html_table("<t>", [spark.createDataFrame([("<b>",)], "a string").select(formats.html_row(["a"]).alias("r")).first().r], ["a"])


def test_deflated_blobs(spark):
    df = spark.createDataFrame([(bytearray(b"a" * 5000),), (bytearray(b""),), (None,)], "content binary")
    packed = df.withColumn("z", stores.deflated(F.col("content")))
    got = packed.withColumn("back", stores.inflated(F.col("z"))).collect()
    assert [r.back for r in got] == [r.content for r in got] and len(got[0].z) < 100 and got[2].z is None
    assert df.select(stores.inflated(F.col("content")).alias("x")).first().x is None


def test_files_that_are_kept(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"part-{k}.json").write_text("{}")
        os.utime(tmp_path / f"part-{k}.json", (1000 + k, 1000 + k))
    assert stores.keep_newest(spark, str(tmp_path), 2) == ["part-0.json", "part-1.json", "part-2.json"]
    assert stores.keep_newest(spark, f"{tmp_path}/none", 2) == []
    events = spark.createDataFrame([(1, 0), (2, 3)], "id long, severity int")
    assert [r.id for r in stores.severe(events, 2).collect()] == [2]


TAIL = "value string, file string, offset long, truncated boolean"


def test_truncation_is_told_and_replayed(spark, tmp_path):
    reader, log = LogTailReader(str(tmp_path), "*.log"), tmp_path / "auth.log"
    log.write_text("one\ntwo\n")
    rows, first = reader.read({})
    assert [r[0] for r in rows] == ["one", "two"]
    log.write_text("new\n")
    rows, second = reader.read(first)
    rows = list(rows)
    assert [(r[0], r[3]) for r in rows] == [("new", True)]
    assert list(reader.readBetweenOffsets(first, second)) == rows
    log.write_text("")
    assert truncations(spark.createDataFrame(rows, TAIL)).count() == 1
    rows, third = reader.read(second)
    rows = list(rows)
    assert [r[0] for r in rows] == [None] and list(reader.readBetweenOffsets(second, third)) == rows
    e = truncations(spark.createDataFrame(rows, TAIL)).first()
    assert (e.action, e.severity, e.target) == ("log.truncated", 3, "auth.log")
