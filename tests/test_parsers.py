import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from hostlens.sources import authlog, hosts, journal, packages, winevents

def now():
    return F.to_timestamp(F.lit("2026-01-03T00:00:00Z"))


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


P = "2025-12-31T10:00:00.250000+01:00 web1 "

# Line -> what its event shows, or None for a line without one.
AUTH = {
    P + "sshd[7]: Invalid user eve from 192.0.2.9 port 9": {"ts": dt.datetime(2025, 12, 31, 9, 0, 0, 250000), "user": "eve", "action": "auth.failure"},
    "Jan  2 10:00:00 web1 sshd[7]: Invalid user eve from 192.0.2.9": {"ts": dt.datetime(2026, 1, 2, 10)},
    "Dec 31 23:59:59 web1 sshd[7]: Invalid user eve from 192.0.2.9": {"ts": dt.datetime(2025, 12, 31, 23, 59, 59)},
    "garbage": None,
    "": None,
    "Foo 99 10:00:00 h sshd: x": None,
    P + "CRON[1]: pam_unix(cron:session): session opened for user root": None,
    P + "sshd-session[12]: Accepted publickey for ann from 2001:db8::1 port 51000 ssh2: ED25519 SHA256:abc": {
        "action": "session.start", "user": "ann", "src_ip": "2001:db8::1", "outcome": "success", "keys": ["pid:12"],
        "details": {"protocol": "ssh", "auth_method": "publickey", "src_port": "51000", "key_type": "ED25519", "key_fingerprint": "SHA256:abc"},
    },
    P + "/usr/sbin/sshd[1]: Failed password for root from 192.0.2.9 port 22 ssh2": {"action": "auth.failure", "user": "root"},
    P + "sshd[1]: Failed password for invalid user eve from 192.0.2.9 port 22": None,
    P + "sshd[1]: Invalid user  from 192.0.2.9 port 22": {"user": "", "action": "auth.failure"},
    P + "sshd[1]: error: maximum authentication attempts exceeded for invalid user eve from 192.0.2.9 port 2": {"severity": 1, "action": "auth.lockout"},
    P + "sshd[1]: Disconnected from user ann 192.0.2.1 port 2": {"action": "session.end"},
    P + "sshd[1]: pam_unix(sshd:session): session closed for user ann": {"action": "session.end"},
    P + "sudo[5]:   ann : TTY=pts/0 ; PWD=/srv ; USER=root ; COMMAND=/usr/bin/vim /etc/hosts": {"outcome": "success", "command": "/usr/bin/vim /etc/hosts", "cwd": "/srv", "keys": ["tty:pts/0", "pid:5"]},
    P + "sudo: bob : user NOT in sudoers ; TTY=unknown ; PWD=/ ; USER=root ; COMMAND=/bin/sh": {"outcome": "failure", "severity": 1, "details": {"run_as": "root", "reason": "user NOT in sudoers"}, "keys": []},
    P + "su[9]: pam_unix(su-l:session): session opened for user root(uid=0) by ann(uid=1000)": {"action": "privilege.su", "user": "ann"},
    P + "su: pam_unix(su:auth): authentication failure; logname=x uid=1 euid=0 tty=/dev/pts/2 ruser=ann rhost=  user=root": {"outcome": "failure", "user": "ann", "keys": ["tty:pts/2"]},
    P + "login[3]: pam_unix(login:session): session opened for user ann(uid=1) by LOGIN(uid=0)": {"action": "session.start"},
    P + "login[3]: pam_unix(login:session): session closed for user ann": {"action": "session.end"},
    P + "passwd[1]: pam_unix(passwd:chauthtok): password changed for ann": {"action": "account.password_changed", "target": "ann"},
    P + "useradd[1]: new user: name=eve, UID=1001, GID=1001, home=/home/eve, shell=/bin/sh, from=/dev/pts/1": {"action": "account.user_created", "target": "eve", "keys": ["tty:pts/1", "pid:1"]},
    P + "groupadd[1]: new group: name=ops, GID=99": {"action": "account.group_created", "target": "ops"},
    P + "userdel[1]: delete user 'eve'": {"action": "account.user_deleted", "target": "eve"},
    P + "usermod[1]: add 'eve' to group 'sudo'": {"action": "account.group_member_added", "target": "eve", "details": {"group": "sudo", "member": "eve"}},
    P + "gpasswd[1]: user eve added by root to group wheel": {"action": "account.group_member_added", "target": "eve"},
}


def shown(e, names):
    row = e.asDict(recursive=True)
    row |= {"details": row["details"] and json.loads(row["details"]), "command": (row["process"] or {}).get("command_line"), "cwd": (row["process"] or {}).get("cwd")}
    return {n: row[n] for n in names}


def test_auth_lines(spark):
    df = lines(spark, *AUTH).withColumn("line", F.col("value"))
    got = {e.line: e for e in authlog.read_auth_log(df, now()).collect()}
    assert set(got) == {k for k, v in AUTH.items() if v}
    for line, want in AUTH.items():
        if want:
            assert shown(got[line], want) == want, line


def test_journal(spark):
    rows = [
        {"MESSAGE": "Invalid user eve from 192.0.2.9", "SYSLOG_IDENTIFIER": "sshd", "_PID": "4", "__REALTIME_TIMESTAMP": "1700000000000001", "__CURSOR": "c1"},
        {"MESSAGE": list(b"Invalid user e\xff from 192.0.2.9"), "_COMM": "sshd", "__REALTIME_TIMESTAMP": "1700000001000000"},
        {},
    ]
    got = journal.read_journal(lines(spark, *map(json.dumps, rows), "not json")).orderBy("ts").collect()
    assert [(e.user, e.cursor, e["keys"]) for e in got] == [("eve", "c1", ["pid:4"]), ("e\ufffd", None, [])]
    assert got[0].ts == dt.datetime(2023, 11, 14, 22, 13, 20, 1)


def test_packages(spark):
    got = packages.read_dpkg(lines(spark, "2026-01-01 10:00:00 upgrade nginx:amd64 1.0 1.1", "2026-01-01 10:00:01 install a:all <none> 2", "2026-01-01 10:00:02 purge b 3 <none>", "2026-01-01 10:00:03 status installed x 1", "bad")).orderBy("ts").collect()
    assert [(e.action, e.target, json.loads(e.details)) for e in got] == [
        ("package.upgraded", "nginx", {"version": "1.1", "previous_version": "1.0"}),
        ("package.installed", "a", {"version": "2"}),
        ("package.removed", "b", {"version": "3"}),
    ]
    got = packages.read_rpm(lines(spark, "2026-01-01T10:00:00+0000 SUBDEBUG Upgrade: a-b-1:2.0-1.x86_64", "2026-01-01T10:00:00+0000 SUBDEBUG Upgraded: a-b-1:1.0-1.x86_64", "2026-01-01T10:00:00+0000 INFO x")).collect()
    assert [(e.action, e.target, json.loads(e.details)["version"]) for e in got] == [("package.upgraded", "a-b", "1:2.0-1.x86_64")]


def test_who(spark):
    got = hosts.read_who(
        lines(spark, "ann  pts/0  2026-01-01 10:00   .  4242 (203.0.113.9)", "bob  tty1  Jan  2 11:00  old  77", "ann  pts/3  2026-01-01 10:00 . 5 (tmux(4242).%1)", "ann pts/4 2026-01-01 10:00 . 6", "x"), now()
    ).orderBy("ts").collect()
    assert [(e.user, e.src_ip, e["keys"], e.ts) for e in got] == [
        ("ann", "203.0.113.9", ["pid:4242", "tty:pts/0"], dt.datetime(2026, 1, 1, 10)),
        ("bob", None, ["pid:77", "tty:tty1"], dt.datetime(2026, 1, 2, 11)),
    ]


def test_stat(spark):
    rest = " ".join(str(k) for k in range(5, 30))
    df = spark.createDataFrame([(f"12 (a (b) c) S 7 8 9 34816 {rest}",), ("x",)], "s string")
    a, b = (r.p for r in df.select(hosts.parse_stat(F.col("s")).alias("p")).collect())
    assert (a.name, a.ppid, a.tty_nr) == ("a (b) c", 7, 34816)
    assert b is None


def test_process_events_and_ancestors(spark):
    rest = " ".join(["0"] * 30)
    procs = spark.createDataFrame([("h", 30, 20), ("h", 20, 10), ("h", 10, 1), ("h", 1, 0)], "host string, pid bigint, ppid bigint")
    up = {r.pid: r.ancestors for r in hosts.with_ancestors(procs).collect()}
    assert up == {30: [20, 10, 1], 20: [10, 1], 10: [1], 1: []}
    raw = spark.createDataFrame(
        [("h", dt.datetime(2026, 1, 1), 30, f"30 (vim) S 20 1 1 34816 {rest}", b"vim\x00/etc/hosts\x00", "ann", 2**32 - 1, [20, 10])],
        "host string, ts timestamp, pid bigint, stat string, cmdline binary, login_user string, session_no bigint, ancestors array<bigint>",
    )
    e = hosts.process_events(raw).first()
    assert (e.message, e.process.ppid, e["keys"], e["learn"]) == ("vim /etc/hosts", 20, ["pid:20", "pid:10", "tty:pts/0"], ["pid:30"])
    assert hosts.new_processes(raw.select("host", "pid", F.lit(1).alias("start")).limit(0), raw.select("host", "pid", F.lit(1).alias("start"))).count() == 1


def test_exec_messages(spark):
    import struct

    def message(what, pid, tgid):
        body = struct.pack("<II", 1, 1) + bytes(12) + struct.pack("<IIQII", what, 0, 0, pid, tgid)
        return struct.pack("<IHHII", 16 + len(body), 0, 0, 0, 0) + body

    data = message(2, 5, 5) + message(2, 6, 5) + message(1, 7, 7) + message(2, 8, 8) + message(2, 9, 9)[:30]
    df = spark.createDataFrame([("h", dt.datetime(2026, 1, 1), data), ("h", dt.datetime(2026, 1, 1), None)], "host string, ts timestamp, data binary")
    assert sorted(r.pid for r in hosts.exec_messages(df).collect()) == [5, 8]


def test_services(spark):
    got = hosts.read_units(lines(spark, "  nginx.service loaded active running Web server", "● db.service loaded failed failed DB", "x")).collect()
    assert [(r.service, r.state) for r in got] == [("nginx", "running"), ("db", "failed")]
    df = spark.createDataFrame([("h", k, "db", s) for k, s in enumerate(["running", "running", "failed", "unknown", "running", "stopped"])], "host string, us long, service string, state string")
    assert [r.message for r in hosts.service_transitions(df).collect()] == ["Service db: running -> failed", "Service db: running -> stopped"]


def xml(provider, event_id, data="", user="", extra=""):
    fields = "".join(f"<Data Name='{k}'>{v}</Data>" for k, v in data.items()) if isinstance(data, dict) else data
    body = f"<UserData><X xmlns='u'>{user}</X></UserData>" if user else f"<EventData>{fields}</EventData>"
    return (
        f"<Event xmlns='http://schemas.microsoft.com/win/2004/08/events/event'><System><Provider Name='{provider}'/><EventID>{event_id}</EventID><EventRecordID>9</EventRecordID>"
        f"<TimeCreated SystemTime='2026-01-01T10:00:00.5Z'/><Execution ProcessID='44' ThreadID='1'/><Channel>C</Channel></System>{body}</Event>{extra}"
    )


SEC = winevents.SECURITY
ON = {"TargetUserName": "ann", "TargetDomainName": "CORP", "LogonType": "10", "LogonProcessName": "User32 ", "IpAddress": "192.0.2.5", "IpPort": "50", "TargetLogonId": "0xAB", "AuthenticationPackageName": "Negotiate"}
RUN = {"SubjectUserName": "ann", "SubjectDomainName": "CORP", "SubjectLogonId": "0xAB", "NewProcessId": "0x10", "ProcessId": "0x8", "NewProcessName": "C:\\Windows\\cmd.exe", "CommandLine": "cmd /c &quot;a &amp; b&quot;", "ParentProcessName": "C:\\x\\w3wp.exe"}

WINDOWS = [
    ((SEC, 4624, ON), {"action": "session.start", "user": "CORP\\ann", "src_ip": "192.0.2.5", "keys": ["logon:0xab"]}),
    ((SEC, 4624, ON | {"TargetUserName": "SYSTEM"}), None),
    ((SEC, 4624, ON | {"LogonType": "5"}), None),
    ((SEC, 4625, ON | {"Status": "0xC000006D", "SubStatus": "0xC0000064", "LogonType": "3"}), {"outcome": "failure", "details": {"protocol": "network", "logon_type": "3", "reason": "no such user", "workstation": "", "win_event_id": "4625"}}),
    ((SEC, 4634, ON), {"action": "session.end", "keys": ["logon:0xab"]}),
    ((SEC, 4688, RUN), {"command": 'cmd /c "a & b"', "keys": ["logon:0xab", "pid:8"], "learn": ["pid:16"], "user": "CORP\\ann"}),
    ((SEC, 4688, RUN | {"ProcessId": "0x63"}), None),
    ((SEC, 4732, {"TargetUserName": "Administrators", "MemberName": "CN=eve,DC=x", "SubjectUserName": "ann", "SubjectDomainName": "CORP"}), {"target": "eve", "details": {"group": "Administrators", "member": "eve", "win_event_id": "4732"}}),
    ((SEC, 4740, {"TargetUserName": "eve", "TargetDomainName": "PC1"}), {"severity": 1, "action": "account.locked_out"}),
    ((winevents.EVENTLOG, 1102, "", "<SubjectUserName>ann</SubjectUserName><SubjectDomainName>CORP</SubjectDomainName>"), {"action": "log.cleared", "user": "CORP\\ann", "details": {"win_event_id": "1102"}}),
    ((winevents.SERVICES, 7045, {"ServiceName": "svc", "ImagePath": "C:\\a.exe"}), {"target": "svc", "action": "service.installed"}),
    ((winevents.TERMINAL, 21, "", "<User>CORP\\ann</User><SessionID>2</SessionID><Address>192.0.2.7</Address>"), {"action": "session.start", "src_ip": "192.0.2.7", "keys": ["ts:2"]}),
    ((winevents.TERMINAL, 21, "", "<User>x</User><SessionID>0</SessionID>"), None),
    ((winevents.OPENSSH, 4, {"process": "sshd", "payload": "sshd: Invalid user eve from 192.0.2.9 port 1"}), {"action": "auth.failure", "keys": ["pid:44"]}),
    ((winevents.MSI, 1033, "<Data>Tool</Data><Data>1.2</Data><Data>1033</Data><Data>0</Data>"), {"action": "package.installed", "target": "Tool", "outcome": "success"}),
    (("Other", 1, {"a": "b"}), None),
]


def test_windows_events(spark):
    texts = [xml(*args).replace("10:00:00.5Z", f"10:00:{k:02d}Z") for k, (args, _) in enumerate(WINDOWS)]
    broken = xml(winevents.SERVICES, 7045, {"ServiceName": "one"}).replace("10:00:00.5Z", "11:00:00Z") + xml(winevents.SERVICES, 7045, {"ServiceName": "two"})[:-20]
    df = spark.createDataFrame([("".join(texts),), (broken,)], "xml string")
    found = winevents.map_events(winevents.read_event_xml(df), self_pid=99).collect()
    got = {e.ts: e for e in found}
    assert len(got) == len(found)
    # A text that breaks off keeps the events before the break.
    assert got.pop(dt.datetime(2026, 1, 1, 11)).target == "one"
    at = lambda k: dt.datetime(2026, 1, 1, 10, 0, k)
    assert set(got) == {at(k) for k, (_, want) in enumerate(WINDOWS) if want}
    for k, (_, want) in enumerate(WINDOWS):
        if want:
            assert shown(got[at(k)], want) == want, WINDOWS[k][0]


def test_no_lines(spark):
    empty = lines(spark, "x").limit(0)
    assert packages.read_dpkg(empty).count() == journal.read_journal(empty).count() == 0


def test_path_patterns(spark, tmp_path):
    from hostlens.sources.hosts import expand_path_pattern

    for name in ("a/.ssh/keys", "b/.ssh/keys", "b/.ssh2/keys", "c/other", "d[1]/x"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
    find = lambda pattern: [x.removeprefix(f"{tmp_path}/") for x in expand_path_pattern(spark, f"{tmp_path}/{pattern}")]
    assert find("*/.ssh") == ["a/.ssh", "b/.ssh"]
    assert find("?/.ssh*/keys") == ["a/.ssh/keys", "b/.ssh/keys", "b/.ssh2/keys"]
    assert find("c/other") == ["c/other"] and find("none") == [] and find("*/none") == []
    assert find("d[1]/*") == ["d[1]/x"]


def some_events(tmp_path, kinds):
    import duckdb

    rows = ", ".join(f"({k}::BIGINT, TIMESTAMP '2024-01-01 00:00:0{k}.5', {k + 3}::BIGINT, '{kind}', 1.0::DOUBLE, '')" for k, kind in enumerate(kinds))
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    con.execute(f"COPY (SELECT * FROM (VALUES {rows}) t(event_id, ts, user_id, event_type, value, props)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    return con


@pytest.mark.parametrize("kind", ["signup", "purchase"])
def test_windows_events_whose_first_id_is_zero(spark, tmp_path, kind):
    from hostlens.plans import queries as q

    from .conftest import same_rows

    con = some_events(tmp_path, [kind, "click", "view", "error", "signup", "purchase"])
    assert same_rows(q.parse_windows_events(spark, str(tmp_path)), con, q.ORACLE_SQL["parse_windows_events"]) == 5


def test_auth_log_lines_of_one_row_group_are_many_tasks(spark, tmp_path):
    from hostlens.plans import queries as q

    some_events(tmp_path, ["signup"] * 9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert q.parse_auth_log(spark, str(tmp_path)).rdd.getNumPartitions() == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
