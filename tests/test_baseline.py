"""Rescans of watched files, incident files, paths and volumes."""

import json
import os
import time

from pyspark.sql import functions as F

from hostlens.functions import scalars as S
from hostlens.sinks.incidents import IncidentFiles
from hostlens.sources import hosts
from hostlens.streaming.baseline import BaselineWatcher

FILES = "host string, path string, sha256 string, size long, mtime long, mode int, uid int"


def listing(spark, *rows):
    return spark.createDataFrame([(h, p, sha, 1, 1, mode, 0) for h, p, sha, mode in rows], FILES)


def test_the_first_pass_is_silent_and_a_change_is_told_once(spark, tmp_path):
    now = [("a", "/x", "1", 0o600), ("a", "/y", "1", 0o600)]
    w = BaselineWatcher(spark, str(tmp_path), lambda: listing(spark, *now))
    told = lambda df: sorted((r.host, r.action, r.target, r.severity) for r in df.collect())
    assert told(w.rescan(0)) == [] and told(w.rescan(1)) == [] and w.store.version() == 1
    now[0] = ("a", "/x", "2", 0o600)
    now.append(("a", "/z", "1", 0o600))
    want = [("a", "file.created", "/z", 0), ("a", "file.modified", "/x", 0)]
    assert told(w.rescan(2)) == want and told(w.rescan(3)) == [] and told(w.changes()) == want
    del now[1]
    now[0] = ("a", "/x", "2", 0o602)
    now.append(("b", "/new", "1", 0o600))  # a host's first pass is silent, too
    want2 = [("a", "file.deleted", "/y", 0), ("a", "file.permissions_changed", "/x", 2)]
    assert told(w.rescan(4)) == want2 and told(w.rescan(4)) == want2 and told(w.rescan(5)) == []
    assert told(w.changes()) == sorted(want + want2)
    gone = [x for x in now if x[0] == "b"]  # a host that could not be listed keeps its baseline
    w.files = lambda: listing(spark, *gone)
    assert told(w.rescan(6)) == [] and {r.host for r in w.store.read("files").collect()} == {"a", "b"}


def test_timed_rescans(spark, tmp_path):
    now = [("a", "/x", "1", 0o600)]
    w = BaselineWatcher(spark, f"{tmp_path}/s", lambda: listing(spark, *now))
    q = w.watch(f"{tmp_path}/cp", 1)
    until = time.time() + 90
    while w.store.version() < 1 and time.time() < until:
        time.sleep(0.5)
    now[0] = ("a", "/x", "2", 0o600)
    while w.store.version() < 2 and time.time() < until and q.isActive:
        time.sleep(0.5)
    time.sleep(3)
    q.stop()
    assert [r.action for r in w.changes().collect()] == ["file.modified"]


INCIDENTS = "host string, kind string, start_us long, end_us long, recovered_us long, probable_cause string"


def test_incident_numbers_stay(spark, tmp_path):
    year = 31_536_000_000_000
    make = lambda *rows: spark.createDataFrame([(h, "cpu", at, at + 10, at + 5, "<db>") for h, at in rows], INCIDENTS)
    files = IncidentFiles(spark, str(tmp_path))
    ids = lambda df: {(r.host, r.start_us): r.incident_id for r in df.collect()}
    first = ids(files.save(make(("h", 100), ("g", 200), ("h", year + 5))))
    assert first == {("h", 100): "INC-1970-000001", ("g", 200): "INC-1970-000002", ("h", year + 5): "INC-1971-000001"}
    again = ids(files.save(make(("h", 100), ("f", 50), ("g", 200))))  # an earlier one is found later
    assert again == {("h", 100): "INC-1970-000001", ("f", 50): "INC-1970-000003", ("g", 200): "INC-1970-000002"}
    assert files.store.version() == 2 and ids(files.save(make(("f", 50)))) == {("f", 50): "INC-1970-000003"} and files.store.version() == 2
    assert sorted(os.listdir(tmp_path / "incidents")) == [f"{x}.json" for x in ("INC-1970-000001", "INC-1970-000002", "INC-1970-000003", "INC-1971-000001")]
    assert json.loads((tmp_path / "incidents/INC-1970-000003.json").read_text())["host"] == "f"
    assert "&lt;db&gt;" in (tmp_path / "reports/INC-1970-000003.html").read_text()


def test_paths_and_volumes(spark):
    df = spark.createDataFrame([("C:\\Windows", "c:\\WINDOWS", "type C:\\windows\\x"), ("/a", "/A", "cat /a")], "a string, b string, c string")
    got = df.select(S.eq_path(F.col("a"), F.col("b")), S.eq_path(F.col("a"), F.col("b"), True), S.contains_path(F.col("c"), F.col("a")), S.contains_path(F.col("c"), F.col("a"), True)).collect()
    assert [tuple(r) for r in got] == [(False, True, False, True), (False, True, True, True)]
    v = spark.createDataFrame([([("ext4", 50.0, 1.0, 1.0), ("tmpfs", 99.0, 1.0, 1.0), ("fuse.sshfs", 98.0, 1.0, 1.0), (None, 10.0, 1.0, 1.0)],)], "volumes array<struct<file_system:string,used_percent:double,read_bytes_per_sec:double,write_bytes_per_sec:double>>")
    r = hosts.volume_totals(hosts.real_volumes(v)).first()
    assert (r.max_used_percent, len(r.volumes)) == (50.0, 2)
