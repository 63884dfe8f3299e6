from pyspark.sql import functions as F

from hostlens.operators import attribution, sessions

SCHEMA = "host string, us long, arrival_seq long, action string, category string, user string, src_ip string, protocol string, keys array<string>, learn array<string>, severity int"


def ev(second, action, category, user=None, ip=None, protocol=None, keys=(), learn=None, severity=0):
    return [second * 1_000_000, action, category, user, ip, protocol, list(keys), learn, severity]


def track(spark, rows):
    df = spark.createDataFrame([("h", r[0], k, *r[1:]) for k, r in enumerate(rows)], SCHEMA)
    return sessions.track(df).orderBy("us", "arrival_seq")


def test_a_session_with_learned_keys(spark):
    tracked = track(
        spark,
        [
            ev(0, "session.start", "session", "ann", "192.0.2.1", "ssh", ["pid:10"]),
            ev(5, "process.start", "process", keys=["pid:10"], learn=["pid:20"]),
            ev(6, "process.start", "process", keys=["pid:20"], learn=["pid:30"]),
            ev(7, "file.modified", "file", keys=["pid:99"]),
            ev(8, "privilege.sudo", "privilege", "ANN"),
            ev(9, "session.end", "session", keys=["pid:10"]),
            ev(10, "process.start", "process", keys=["pid:30"]),
            ev(11, "session.end", "session", keys=["pid:10"]),
        ],
    )
    got = tracked.collect()
    s = got[0].tracked_session
    assert [r.tracked_session == s for r in got] == [True, True, True, False, True, True, False]
    assert got[2].tracked_user == "ann" and got[2].tracked_ip == "192.0.2.1"
    t = sessions.session_table(tracked).first()
    assert (t.status, t.commands, t.privileged, t.end_us) == ("ended", 2, 1, 9_000_000)


def test_two_records_of_one_login_merge(spark):
    got = track(
        spark,
        [
            ev(0, "session.start", "session", "CORP\\ann", None, "rdp", ["logon:1"]),
            ev(30, "session.start", "session", "corp\\ANN ", "192.0.2.1", "rdp", ["ts:2"]),
            ev(40, "process.start", "process", keys=["ts:2"]),
            ev(200, "session.start", "session", "corp\\ann", "192.0.2.1", "rdp", ["ts:3"]),
        ],
    ).collect()
    assert [r.tracked_action for r in got] == ["session.start", "auth.success", "process.start", "session.start"]
    assert got[0].tracked_session == got[1].tracked_session == got[2].tracked_session != got[3].tracked_session
    assert got[2].tracked_ip == "192.0.2.1"
    assert [r.linked_session for r in got] == [None, got[0].tracked_session, None, None]


def test_reconnect_and_unknown(spark):
    got = track(
        spark,
        [
            ev(0, "session.start", "session", "ann", "192.0.2.1", "rdp", ["ts:2"]),
            ev(1, "session.disconnect", "session", keys=["ts:2"]),
            ev(2, "session.reconnect", "session", "ann", "192.0.2.9", "rdp", ["ts:2"]),
            ev(3, "session.reconnect", "session", "bob", "192.0.2.8", "rdp", ["ts:5"]),
            ev(4, "session.disconnect", "session", keys=["ts:77"]),
        ],
    ).collect()
    assert [(r.tracked_action, r.original_ip) for r in got] == [("session.start", None), ("session.disconnect", None), ("session.reconnect", "192.0.2.1"), ("session.start", None)]


def test_a_reused_key_goes_to_the_later_login(spark):
    got = track(spark, [ev(0, "session.start", "session", "ann", None, "console", ["tty:1"]), ev(100, "session.start", "session", "bob", None, "console", ["tty:1"]), ev(101, "process.start", "process", keys=["tty:1"])]).collect()
    assert got[2].tracked_user == "bob"


def test_learned_keys_are_bounded():
    t = sessions.Tracker("h")
    s, _ = t.open(0, "ann", "ssh", None, ["pid:1"])
    t.learn(s, [f"pid:{k}" for k in range(2, sessions.MOST_LEARNED + 12)])
    assert len(s["learned"]) == sessions.MOST_LEARNED
    assert t.resolve(["pid:1"]) is s and t.resolve(["pid:2"]) is None


def commands(spark, rows):
    return spark.createDataFrame(rows, "id long, host string, us long, session_id string, user string, pid long, name string, command_line string, cwd string")


def attributed(spark, target, rows, at=1000):
    c = spark.createDataFrame([(1, "h", at * 1_000_000, target)], "id long, host string, us long, target string")
    r = attribution.attribute(c, commands(spark, rows)).collect()
    return (r[0].tier, r[0].c_id, r[0].confidence) if r else None


def test_tiers(spark):
    def cmd(i, second, name, line, cwd="/root"):
        return (i, "h", second * 1_000_000, "S1", "ann", i, name, line, cwd)

    path = "/etc/nginx/nginx.conf"
    assert attributed(spark, path, [cmd(1, 900, "vim", f"vim {path}"), cmd(2, 950, "ls", "ls")]) == (1, 1, "high")
    assert attributed(spark, path, [cmd(1, 900, "vim", "vim nginx.conf", "/etc/nginx"), cmd(2, 990, "vim", "vim nginx.conf")]) == (2, 1, "high")
    assert attributed(spark, path, [cmd(1, 900, "vim", "vim nginx.conf"), cmd(2, 990, "apt", "apt upgrade")]) == (3, 1, "medium")
    assert attributed(spark, path, [cmd(1, 900, "APT", "apt upgrade"), cmd(2, 901, "ansible", "x")]) == (4, 1, "medium")
    assert attributed(spark, path, [cmd(1, 600, "apt", "apt upgrade")]) is None
    assert attributed(spark, path, [cmd(1, 99, "vim", f"vim {path}")]) is None
    assert attributed(spark, path, [cmd(1, 1006, "vim", f"vim {path}"), cmd(2, 1005, "vim", f"vim {path}")]) == (1, 2, "high")
    assert attributed(spark, "bob", [cmd(1, 900, "useradd", "useradd bobby"), cmd(2, 901, "useradd", "useradd bob")]) == (1, 2, "high")
    assert attributed(spark, path, [cmd(1, 900, "vim", f"vim {path}"), cmd(2, 900, "sed", f"sed {path}")]) == (1, 2, "high")


def test_open_sessions(spark):
    c = spark.createDataFrame([(k, "h", t * 1_000_000, "/x") for k, t in enumerate((0, 10, 25, 45, 60))], "id long, host string, us long, target string")
    s = spark.createDataFrame([("a", "h", "ann", 10_000_000, 30_000_000), ("b", "h", "bob", 20_000_000, 45_000_000), ("c", "other", "eve", 0, None)], "id string, host string, user string, start_us long, end_us long")
    got = {r.id: (r.open_sessions, r.only_session, r.only_user) for r in attribution.open_sessions(c, s).collect()}
    assert got == {0: (0, None, None), 1: (1, "a", "ann"), 2: (2, None, None), 3: (1, "b", "bob"), 4: (0, None, None)}


def test_apply(spark):
    e = spark.createDataFrame([(1, "file", None, None), (2, "file", None, "ann"), (3, "process", None, None), (4, "package", None, None)], "id long, category string, session_id string, user string")
    f = spark.createDataFrame([(k, "medium" if k < 4 else "low", "r", "S9", "bob") for k in range(1, 5)], "id long, confidence string, reason string, session_id string, user string")
    got = {r.id: (r.session_id, r.user, r.attribution is not None) for r in attribution.apply(e, f).collect()}
    assert got == {1: ("S9", "bob", True), 2: (None, "ann", False), 3: (None, None, False), 4: (None, None, True)}


def test_snapshot(spark):
    s = spark.createDataFrame([("a", "active", ["ts:1"], 1), ("b", "active", ["ts:2"], 1), ("c", "active", ["pid:1"], 1), ("d", "ended", ["ts:3"], 1)], "id string, status string, keys array<string>, base_keys int")
    live = spark.createDataFrame([("ts:1",)], "key string")
    assert [r.id for r in sessions.absent_sessions(s, live, "ts").collect()] == ["b"]
    assert sessions.fallback_user(spark.createDataFrame([(None, "root")], "user string, run_as string")).first().user == "root"
    assert sessions.inherit(spark.createDataFrame([("a", None, "x")], "session_id string, user string, src_ip string"), spark.createDataFrame([("a", "ann", "y")], "id string, user string, src_ip string")).select("user", "src_ip").first() == ("ann", "x")


def test_a_reconnect_from_another_address(spark):
    tracked = track(
        spark,
        [
            ev(0, "session.start", "session", "ann", "192.0.2.1", "rdp", ["ts:1"]),
            ev(5, "session.reconnect", "session", None, "192.0.2.9", "rdp", ["ts:1"]),
            ev(6, "session.reconnect", "session", None, "192.0.2.1", "rdp", ["ts:1"]),
            ev(500, "session.start", "session", "bob", "192.0.2.2", "rdp", ["ts:2"]),
        ],
    )
    got = tracked.collect()
    assert [(r.tracked_ip, r.original_ip, r.severity_floor) for r in got[1:3]] == [("192.0.2.9", "192.0.2.1", 1), ("192.0.2.1", None, 0)]
    changed = sessions.changed_sessions(tracked, F.col("us") > 100_000_000).collect()
    assert [r.user for r in changed] == ["bob"]


def test_sessions_whose_processes_are_gone(spark):
    s = spark.createDataFrame(
        [
            ("gone", "h", "ann", None, "active", ["pid:1", "pid:2", "pid:3"], 2),
            ("alive", "h", "ann", None, "active", ["pid:1", "pid:4"], 2),
            ("elsewhere", "g", "ann", "192.0.2.1", "disconnected", ["pid:4"], 1),
            ("windows", "h", "ann", None, "active", ["ts:1"], 1),
            ("ended", "h", "ann", None, "ended", ["pid:9"], 1),
        ],
        "id string, host string, user string, src_ip string, status string, keys array<string>, base_keys int",
    )
    gone = sessions.ended_sessions(s, spark.createDataFrame([("h", 4), ("h", 3)], "host string, pid long"))
    assert sorted(r.id for r in gone.collect()) == ["elsewhere", "gone"]
    e = sessions.unobserved_ends(gone, F.lit(7), False).orderBy("session_id").collect()
    assert [(r.session_id, r.action, r.us, r.src_ip) for r in e] == [("elsewhere", "session.ended_unobserved", 7, "192.0.2.1"), ("gone", "session.ended_unobserved", 7, None)]


def test_logins_find_their_session_without_a_look_at_all_others():
    import random

    class Plain(sessions.Tracker):
        """Nearest start, then smallest id, of all live sessions."""

        def nearest(self, us, name, protocol, ip):
            near = [s for s in self.live.values() if s["name"] == name and s["protocol"] == protocol and abs(s["start"] - us) <= sessions.MERGE_SECONDS * 1_000_000 and (s["ip"] is None or ip is None or s["ip"] == ip)]
            return min(near, key=lambda s: (abs(s["start"] - us), s["id"]), default=None)

    g, rows = random.Random(5), []
    for us in sorted(g.randrange(3000) * 1_000_000 for _ in range(4000)):
        kind = g.choice(("session.start", "session.start", "session.end", "privilege.sudo"))
        rows.append((us, kind, kind.split(".")[0], g.choice(("ann", "Bob", None)), g.choice((None, "a", "b")), g.choice(("ssh", "rdp")), [f"pid:{g.randrange(300)}"], None))
    a, b = sessions.Tracker("h"), Plain("h")
    assert [a.event(*r) for r in rows] == [b.event(*r) for r in rows] and len(a.live) > 20

    class Counted(dict):
        seen = 0

        def values(self):
            Counted.seen += 1
            return super().values()

    many = sessions.Tracker("h")
    many._live = Counted()
    for k in range(50):
        many.event(k * 1_000_000_000, "session.start", "session", "ann", f"ip{k}", "ssh", [f"pid:{k}"], None)
        many.event(k * 1_000_000_000, "privilege.sudo", "privilege", "bob", None, None, ["pid:none"], None)
    assert len(many.live) == 50 and not Counted.seen
