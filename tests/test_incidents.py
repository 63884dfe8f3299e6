import pytest
from pyspark.sql import functions as F

from hostlens.operators import incidents as I
from hostlens.operators import windows

S = 1_000_000


def samples(spark, values, key="h"):
    return spark.createDataFrame([(key, k * 10 * S, k, float(v)) for k, v in enumerate(values)], "host string, us long, id long, value double")


def test_sustained(spark):
    # Above 90 for 30 s from 20 s on; a dip at 60 s ends the run; the second run is too short.
    df = samples(spark, [10, 95, 99, 95, 96, 97, 50, 95, 95, 20])
    (r,) = I.detect(df, ["host"], "value", 90, 30).collect()
    assert (r.start_us, r.trigger_us, r.end_us, r.peak, r.samples) == (10 * S, 40 * S, 50 * S, 99.0, 5)
    assert I.detect(df, ["host"], "value", 90, 41).count() == 0
    got = I.recovered(samples(spark, [95, 50, 95, 50, 50, 50, 50]), ["host"], "value", 90, 30).collect()
    assert [(r.recovered_us, r.confirmed_us) for r in got] == [(30 * S, 60 * S)]
    assert I.detect(df.limit(0), ["host"], "value", 90, 30).count() == 0


def test_machine(spark):
    limits = {"cpu": (80.0, 90.0), "memory": (80.0, 90.0), "disk": (80.0, 90.0)}
    cpu = [10, 95, 95, 95, 95, 50, 50, 95, 50, 50, 50, 50, 50, 50, 50, 50]
    mem = [10, 10, 95, 95, 95, 95, 95, 95, 95, 95, 95, 95, 95, 95, 95, 95]
    df = spark.createDataFrame([("h", k * 10 * S, k, float(c), float(m), 1.0) for k, (c, m) in enumerate(zip(cpu, mem, strict=True))], "host string, us long, id long, cpu double, memory double, disk double")
    got = [(r.id, r.incident_start // S, r.kind, r.phase) for r in I.incident_samples(df, "host", limits, 20, 20, 40).orderBy("id").collect()]
    # cpu triggers at 30 s, recovers from 80 s (confirmed at 100 s), and is done at 120 s; memory waits until then.
    assert got[:10] == [(k, 30, "cpu", "during") for k in range(3, 11)] + [(11, 30, "cpu", "post"), (12, 30, "cpu", "post")]
    assert got[10:] == [(k, 130, "memory", "during") for k in (13, 14, 15)]


def test_score_and_conclusion(spark):
    usage = spark.createDataFrame([("i", "pre", "db", 20.0), ("i", "during", "db", 90.0), ("i", "during", "db", 90.0), ("i", "post", "db", 18.0), ("i", "during", "web", 20.0), ("i", "during", "tiny", 1.0)], "i string, phase string, name string, v double")
    ticks = spark.createDataFrame([("i", "pre", 2), ("i", "during", 2), ("i", "post", 1)], "i string, phase string, n long")
    a = I.phase_averages(usage, ticks, ["i"])
    assert {r.name: (r.baseline, r.incident, r.post) for r in a.collect()} == {"db": (10.0, 90.0, 18.0), "web": (0.0, 10.0, 0.0), "tiny": (0.0, 0.5, 0.0)}
    c = I.candidates(I.score(a, ["i"]), ["i"])
    got = {r.name: (r.place, r.score) for r in c.collect()}
    assert set(got) == {"db", "web"}  # tiny is below 2 %
    assert got["db"] == (1, pytest.approx(55 * 90 / 100.5 + 25 + 20 * 0.8))
    assert got["web"] == (2, pytest.approx(55 * 10 / 100.5 + 25 + 20))
    i = spark.createDataFrame([("i", "cpu"), ("none", "disk")], "i string, kind string")
    out = {r.i: (r.probable_cause, r.category, r.quality) for r in I.conclude(i, c, ["i"]).collect()}
    assert out == {"i": ("db", "process", "high"), "none": ("Unknown", "unknown", "low")}
    weak = c.withColumn("score", F.lit(39.0)).filter("place = 1")
    assert I.conclude(i, weak, ["i"]).filter("i = 'i'").first().category == "cpu"
    texts = {r.name: r.reasons for r in I.reasons(c).collect()}
    assert texts["db"] == ["db averaged 90.0 during the incident and 10.0 before", "db fell by 80% after recovery", "db made up 90% of all activity"]


def test_metric_of_a_resource(spark):
    p = F.struct(F.lit(5.0).alias("cpu_percent"), F.lit(7).alias("memory_bytes"), F.lit(1.0).alias("read_bytes_per_sec"), F.lit(2.0).alias("write_bytes_per_sec"))
    row = spark.range(1).select(*[I.process_metric(F.lit(k), p).alias(k) for k in ("cpu", "memory", "disk", "network")]).first()
    assert tuple(row) == (5.0, 7.0, 3.0, 0.0)
    levels = spark.range(1).select(I.worst_level(F.create_map(F.lit("cpu"), F.lit("warning"), F.lit("disk"), F.lit("normal"))).alias("a"), I.worst_level(F.create_map().cast("map<string,string>")).alias("b")).first()
    assert tuple(levels) == ("warning", "normal")


def test_timeline(spark):
    df = samples(spark, [10, 50, 95, 99, 50, 10]).withColumn("level", F.when(F.col("value") >= 90, "critical").when(F.col("value") >= 40, "warning").otherwise("normal"))
    got = sorted((r.us // S, r.description) for r in windows.level_timeline(df, ["host"]).collect())
    assert got == [(10, "Resource warning"), (20, "Critical threshold crossed"), (20, "Investigation started"), (30, "Peak activity"), (40, "Resource level decreased to warning"), (50, "Recovery started")]


def test_related_changes(spark):
    e = spark.createDataFrame(
        [(1, -40 * S, "h", "file", "file.modified", "ann", "Modified /etc/nginx.conf"), (2, -180 * S, "h", "package", "package.upgraded", None, "Upgraded nginx"), (3, -5 * S, "h", "alert", "alert.x", None, "A"), (4, -1801 * S, "h", "file", "file.created", None, "old"), (5, -1500_000, "h", "session", "session.start", None, "s"), (6, 0, "other", "file", "file.created", None, "x")],
        "id long, us long, host string, category string, action string, user string, message string",
    ).withColumn("us", F.col("us") + 10_000 * S)
    i = spark.createDataFrame([("I1", "h", 10_000 * S, None, "NGINX.exe")], "incident_id string, host string, start_us long, end_us long, probable_cause string")
    got = I.related(i, e)
    assert {r.id: (r.offset_seconds, r.summary) for r in got.collect()} == {1: (-40, "Modified /etc/nginx.conf by ann"), 2: (-180, "Upgraded nginx"), 3: (-5, "A"), 5: (-1, "s")}
    r = I.change_evidence(got).first()
    assert (r.changes, r.latest_offset, r.latest, [c.id for c in r.culprit]) == (2, -40, "Modified /etc/nginx.conf by ann", [1, 2])
    assert {x.id for x in I.related(i, e, most=2).collect()} == {3, 5}
    assert {x.id for x in I.related(i, e, most=2, compat=True).collect()} == {2, 1}


def brute_related(incidents, events, lookback, most, compat):
    """related() pair by pair: (incident_id, event id, offset_seconds), sorted."""
    found = {}
    for name, host, start, end, _ in incidents:
        if host is None or start is None:
            continue
        end = start if end is None else end
        near = [(us, k) for k, us, h, *_ in events if h == host and us is not None and start - lookback * S <= us <= end]
        found.setdefault(name, []).extend((us, k, int((us - start) / S)) for us, k in near)
    return sorted((str(name), k, o) for name, rows in found.items() for _, k, o in sorted(rows, key=lambda r: r[:2], reverse=not compat)[:most])


@pytest.mark.parametrize("compat", [False, True])
@pytest.mark.parametrize("cell, span, block", [(I.CELL_US, I.SPAN_CELLS, I.BLOCK_EVENTS), (7 * S, 3, 4), (S, 1, 1)])
def test_related_equals_all_pairs(spark, monkeypatch, compat, cell, span, block):
    import random

    for name, value in (("CELL_US", cell), ("SPAN_CELLS", span), ("BLOCK_EVENTS", block)):
        monkeypatch.setattr(I, name, value)
    g = random.Random(5)
    # Many events at one time, before 1970 too; some without a time or a host.
    events = [(k, None if k % 41 == 0 else g.randrange(-40, 160) * S + g.choice((0, 0, 1, 999_999)), g.choice(("a", "a", "a", "b", None)), "file", "file.modified", None, f"m{k}") for k in range(400)]
    incidents = [(f"I{k}", g.choice(("a", "b", "none", None)), None if k % 17 == 0 else (s := g.randrange(-30, 170) * S), None if k % 5 == 0 else s + g.choice((-30, -3, 0, 0, 7, 90)) * S, "x") for k in range(1, 60)]
    incidents += [("twice", "a", 50 * S, 60 * S, "x")] * 2 + [("both", "a", 30 * S, 40 * S, "x"), ("both", "b", 35 * S, 45 * S, "y"), (None, "a", 90 * S, 95 * S, None), (None, "b", 20 * S, 25 * S, "z")]
    e = spark.createDataFrame(events, "id long, us long, host string, category string, action string, user string, message string")
    i = spark.createDataFrame(incidents, "incident_id string, host string, start_us long, end_us long, probable_cause string")
    for lookback, most in ((20, 6), (60, 9), (0, 3), (1000, 10_000)):
        got = I.related(i, e, lookback, most, compat)
        assert got.columns == [*e.columns, "incident_id", "start_us", "probable_cause", "offset_seconds", "summary"]
        assert sorted((str(r.incident_id), r.id, r.offset_seconds) for r in got.collect()) == brute_related(incidents, events, lookback, most, compat)
    assert I.related(i.limit(0), e).count() == 0 and I.related(i, e.limit(0)).count() == 0


def joined_rows(df):
    """Rows that all joins of a plan made, after the plan was run."""

    def walk(node):
        made = node.metrics().get("numOutputRows").get().value() if "Join" in node.nodeName() else 0
        return made + sum(walk(node.children().apply(k)) for k in range(node.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_related_makes_no_pairs_that_it_drops(spark):
    # 2,000 events and 300 incidents of a host in half an hour: 600,000 pairs, of which 18,000 are kept.
    e = spark.range(2000).selectExpr("id", "id * 500000 AS us", "'h' AS host", "'file' AS category", "'file.modified' AS action", "'u' AS user", "'m' AS message")
    i = spark.range(300).selectExpr("concat('I', id) AS incident_id", "'h' AS host", "(1000 + id) * 1000000 AS start_us", "(1600 + id) * 1000000 AS end_us")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan that was run is in parts
    try:
        got = I.related(i, e)
        assert len(got.collect()) == 18_000
        assert joined_rows(got) < 30_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


@pytest.mark.parametrize("name", ["related_activity_interval", "nearest_changes_topk"])
def test_related_queries_over_dense_events(spark, sf, tmp_path, name):
    # The events ten times, their month squeezed into an hour and a half: most incidents have more than 60 in reach.
    import duckdb

    from hostlens.plans import queries as q

    from .conftest import same_rows

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    con.sql(f"CREATE TABLE events AS SELECT event_id + 100000 * k AS event_id, make_timestamp(epoch_us(ts) // 480) AS ts, user_id + 1500 * k AS user_id, event_type, value, props FROM '{sf}/events.parquet', range(10) r(k)")
    con.sql(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = q.QUERIES[name](spark, str(tmp_path))
        got.collect()
        assert joined_rows(got) < 3 * con.sql("SELECT count(*) FROM events").fetchall()[0][0]
        assert same_rows(got, con, q.ORACLE_SQL[name]) > 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_report(spark):
    i = spark.createDataFrame([("h", "cpu", 0, 100 * S, 70 * S, "db"), ("g", "disk", 5 * S, 10 * S, 9 * S, "x")], "host string, kind string, start_us long, end_us long, recovered_us long, probable_cause string")
    got = {r.host: r for r in I.report(i).collect()}
    assert [got[h].incident_id for h in ("h", "g")] == ["INC-1970-000001", "INC-1970-000002"]
    assert (got["h"].duration_seconds, got["h"].degraded_seconds, got["h"].impact) == (100, 70, "A cpu incident of about 1m 40s")
    assert I.incident_events(I.report(i)).count() == 2


def test_pages(spark):
    from hostlens.sinks import reports

    i = I.report(spark.createDataFrame([("h", "cpu", 0, 100 * S, 70 * S, "<db>")], "host string, kind string, start_us long, end_us long, recovered_us long, probable_cause string"))
    t = spark.createDataFrame([(2, "Peak & end"), (1, "Start")], "us long, description string")
    page = reports.incident_report(i, "INC-1970-000001", timeline=t)
    assert "&lt;db&gt;" in page and page.index("Start") < page.index("Peak &amp; end")
    with pytest.raises(KeyError):
        reports.incident_report(i, "none")
    s = spark.createDataFrame([("S1", "ann", "192.0.2.1", "ssh", "ended", 0, 65 * S, 60 * S, 1, 2, 3, 0, 3)], "id string, user string, src_ip string, protocol string, status string, start_us long, end_us long, last_us long, commands long, privileged long, file_changes long, alerts long, max_severity int")
    e = spark.createDataFrame([(1, 5, "S1", 3, "a", "<x>"), (2, 6, "S2", 0, "b", "other")], "id long, us long, session_id string, severity int, action string, message string")
    page = reports.session_report(s, e, "S1")
    assert "1m 5s" in page and "risk: 55" in page and "&lt;x&gt;" in page and "other" not in page


def test_source_choice(tmp_path):
    from hostlens.sources.authlog import choose_source

    assert choose_source("/x", True) == "/x"
    assert choose_source(None, True, str(tmp_path)) == "journal" and choose_source(None, False, str(tmp_path)) is None
    (tmp_path / "var/log").mkdir(parents=True)
    (tmp_path / "var/log/secure").touch()
    assert choose_source(None, True, str(tmp_path)).endswith("secure")


def test_rows_beyond_a_page_are_told(spark, monkeypatch):
    from hostlens.sinks import reports

    monkeypatch.setattr(reports, "MOST_ROWS", 3)
    rows = spark.range(5).select(F.col("id").alias("us"))
    assert "2 more rows are not shown" in reports._section("Events", rows, ["us"])
    assert "not shown" not in reports._section("Events", rows.limit(3), ["us"])
