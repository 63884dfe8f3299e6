"""The wired stream against the batch operators over all rows, with a batch that fails after its commit and runs again."""

import time

import pytest
from pyspark.sql import functions as F

from hostlens.operators import attribution, integrity, rules, search, sessions
from hostlens.schema import adapted
from hostlens.streaming.hosts import MARK
from hostlens.streaming.pipeline import AuditPipeline, faults
from tests.test_streaming import in_parts

SETTINGS = rules.Settings(failure_threshold=2, spray_users=2, window_seconds=86400, success_failures=1, cooldown_seconds=86400)
CUSTOM = [rules.CustomRule("etc", target="/etc/*")]
SUPPRESS = [rules.Suppression(rule="webserver_shell", parent="tomcat9"), rules.Suppression(rule="success_after_failures", user="user1*")]


def wait(p, spark, least, seconds=150):
    """Until so many events are stored that are no alerts."""
    until = time.time() + seconds
    while time.time() < until:
        e = p.store(spark).read("events")
        if e is not None and e.filter("NOT is_alert").count() >= least:
            return
        time.sleep(1)


@pytest.fixture(scope="module")
def source(spark, sf):
    """Events with keys, some of them logoffs, some changes that nobody is known for."""
    e = adapted(spark, sf)
    quiet = (F.col("category") == "file") & (F.col("id") % 2 == 0)
    return e.withColumns(
        {
            "arrival_seq": F.col("id"),
            "keys": F.when(~quiet, F.array(F.concat(F.lit("ip:"), F.coalesce("src_ip", F.lit("-"))))),
            "learn": F.lit(None).cast("array<string>"),
            "action": F.when((F.col("category") == "file") & (F.col("id") % 7 == 3), "session.end").otherwise(F.col("action")),
            "user": F.when(~quiet, F.col("user")),
            "session_id": F.lit(None).cast("string"),
            "details": F.lit(None).cast("string"),
        }
    )


@pytest.fixture(scope="module")
def stored(spark, source, tmp_path_factory):
    """The store after the stream has had all rows in three batches, with marks, bad rows and a crash between."""
    folder = str(tmp_path_factory.mktemp("pipe"))
    span = source.agg(F.max("us") - F.min("us")).first()[0] // 1_000_000
    noise = F.col("us") + F.pmod(F.xxhash64("id"), F.lit(span // 20)) * 1_000_000
    bad = source.filter("id % 200 = 17")
    bad = bad.withColumns({"id": F.col("id") + 1_000_000, "severity": F.when(F.col("id") % 400 == 17, 9).otherwise(F.col("severity")), "details": F.when(F.col("id") % 400 != 17, "{no json")})
    marks = source.filter("id % 100 = 50").withColumns({"action": F.lit(MARK), "category": F.lit("agent"), "target": F.lit("auth.log"), "message": F.col("id").cast("string"), "id": F.col("id") + 2_000_000, "keys": F.lit(None).cast("array<string>")})
    every = source.unionByName(bad).unionByName(marks).withColumn("noise", noise)
    stream = in_parts(spark, every, folder, 3, order="noise").drop("noise")
    p = AuditPipeline(f"{folder}/store", SETTINGS, CUSTOM, SUPPRESS, hold_seconds=span // 20 + 1, most_seconds=5)
    seen, failed = [], []
    p.after.append(lambda rows, batch: seen.append(batch))

    def crash(rows, batch):
        if not failed and batch > 0:
            failed.append(batch)
            raise RuntimeError("the driver dies after the commit, before the stream knows")

    p.after.append(crash)
    q = p.start(stream, f"{folder}/cp")
    until = time.time() + 200
    while not failed and time.time() < until and q.isActive:
        time.sleep(0.5)
    while q.isActive and time.time() < until:
        time.sleep(0.5)
    assert failed and "driver dies" in str(q.exception())
    tracked = sessions.track(source)
    n = tracked.count()
    q = p.start(stream, f"{folder}/cp")
    wait(p, spark, n)
    q.stop()
    assert q.exception() is None and seen.count(failed[0]) == 2
    return p, tracked


def overlaid(p, tracked):
    """The batch form of what the stream hands to its rules."""
    e = rules.with_rule_columns(p.prepared(tracked))
    own = {"session_id": F.coalesce("session_id", "tracked_session"), "action": F.coalesce("tracked_action", "action"), "category": F.when(F.col("merged"), "auth").otherwise(F.col("category")), "user": F.coalesce("tracked_user", "user"), "src_ip": F.coalesce("tracked_ip", "src_ip")}
    return e.withColumns(own)


def test_events_sessions_and_attributions_equal_the_batch_form(spark, stored):
    p, tracked = stored
    want = overlaid(p, tracked)
    due = want.filter("category IN ('file', 'package', 'account') AND session_id IS NULL AND user IS NULL AND target IS NOT NULL")
    table = sessions.session_table(tracked)
    host = tracked.filter("tracked_session IS NOT NULL").groupBy(F.col("tracked_session").alias("id")).agg(F.min("host").alias("host"))
    found = attribution.attribution(due.select("id", "host", "us", "target"), attribution.recent_commands(want), table.join(host, "id").select("id", "host", "user", "start_us", "end_us"))
    want = attribution.apply(want, found)
    got = p.store(spark).read("events").filter("NOT is_alert")
    columns = [c for c in want.columns if c not in ("tracked_session", "tracked_user", "tracked_ip", "merged", "severity_floor", "keys", "learn", "attribution") and c in got.columns]
    show = lambda df: {r.id: tuple(r) for r in df.select(*columns, F.col("attribution.confidence"), F.col("attribution.reason")).collect()}
    got, want = show(got), show(want)
    assert len(got) == len(want) > 900 and set(got) == set(want)
    assert [(got[k], want[k]) for k in want if got[k] != want[k]] == []
    assert sum(x[-2] in ("high", "medium") for x in want.values()) >= 0 and sum(x[-2] is not None for x in want.values()) > 20


def test_alerts_equal_the_batch_form_and_are_found(spark, stored):
    p, tracked = stored
    events = p.store(spark).read("events")
    key = lambda r: (r.rule, r.of, r.severity)
    want = rules.evaluate(overlaid(p, tracked), SETTINGS, CUSTOM, SUPPRESS).withColumn("of", F.col("id"))
    got = events.filter("is_alert").withColumn("of", F.col("trigger_event_id"))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) and got.count() > 200
    titles = {(r.rule, r.id): r.title for r in want.filter("rule NOT IN ('sensitive_file')").collect()}
    assert all(titles[r.rule, r.of] == r.message for r in got.filter("rule NOT IN ('sensitive_file')").collect())
    assert {r.category for r in got.collect()} == {"alert"} and got.select("id").distinct().count() == got.count()
    found = search.alerts(events.withColumn("ts", F.timestamp_micros("us")), "low", "10000d", 100_000)
    assert found.count() == got.filter("severity >= 1").count() > 0


def test_one_chain_over_all_batches(spark, stored):
    p, _ = stored
    store = p.store(spark)
    e = store.read("events")
    assert store.version() >= 4 and len(store.manifest()["tables"]["events"]) >= 3
    assert integrity.verify(e, ["host"], p.hashed(e), order="seq", heads=store.read("heads")).count() == 0
    assert e.groupBy("host").agg((F.max("seq") == F.count("*")).alias("x")).filter("NOT x").count() == 0
    other = e.withColumn("message", F.when(F.col("seq") == 5, "changed").otherwise(F.col("message")))
    assert {r.problem for r in integrity.verify(other, ["host"], p.hashed(e), order="seq").collect()} == {"content"}


def test_sessions_sources_positions_and_bad_rows(spark, stored, source):
    p, tracked = stored
    store = p.store(spark)
    events = store.read("events")
    counters = {r.session_id: tuple(r) for r in sessions.session_counters(events).collect()}
    got = p.sessions(spark).collect()
    assert {r.id: (r.id, r.commands, r.privileged, r.file_changes, r.alerts, r.max_severity, r.last_us) for r in got} == counters
    want = {r.id: (r.start_us, r.end_us) for r in sessions.session_table(tracked).collect()}
    assert {r.id: (r.start_us, r.end_us) for r in got if r.id in want} == want
    logins = events.filter("action = 'session.start' AND src_ip IS NOT NULL")
    assert sum(r.logins for r in p.sources(spark).collect()) == logins.count()
    bad = store.read("quarantine").withColumn("raw", F.to_json("raw")).collect()
    assert len(bad) == source.filter("id % 200 = 17").count() >= 4
    assert {r.error for r in bad} == {"severity is out of range", "details are no JSON"}
    assert all('"action":' in r.raw and '"category":' in r.raw and r.host and r.us for r in bad)
    (position,) = store.read("positions").collect()
    assert (position.source, position.position) == ("auth.log", str(source.filter("id % 100 = 50").agg(F.max("id")).first()[0]))


def test_faults(spark):
    row = {"id": 1, "host": "h", "category": "auth", "severity": 1, "details": None}
    rows = [row, row | {"id": None}, row | {"host": None}, row | {"category": "?"}, row | {"severity": None}, row | {"details": "{"}, row | {"details": "{}"}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, host string, category string, severity int, details string")
    assert [r.x for r in df.select(faults(df).alias("x")).collect()] == [None, "id is missing", "host is missing", "category is unknown", "severity is out of range", "details are no JSON", None]
