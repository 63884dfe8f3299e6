"""Attribution against every pair of a change and a command, and on a busy host."""

import random
import re
import time

from pyspark.sql import functions as F

from hostlens.operators import attribution as A

CHANGES = "id long, host string, us long, target string"
COMMANDS = "id long, host string, us long, session_id string, user string, pid long, name string, command_line string, cwd string"
EDGE = r"[\s/\\'\"=<>|;&(),:]"
S = 1_000_000


def tier(c, ch):
    """The tier of one command for one change, as stated; None for none."""
    _, _, us, _, _, _, name, line, cwd = c
    _, _, at, target = ch
    if target is not None:
        line = line or ""
        base, folder = re.split(r"[/\\]", target)[-1], (re.match(r"(?s)^(.*)[/\\][^/\\]*$", target) or ["", ""])[1]
        mentions = lambda x: bool(x) and re.search(rf"(?:^|(?<={EDGE})){re.escape(x)}(?:$|(?={EDGE}))", line, re.ASCII) is not None
        if target in line if re.search(r"[/\\]", target) else mentions(target):
            return 1
        if mentions(base) and cwd == folder:
            return 2
        if len(base.encode()) >= 4 and mentions(base):
            return 3
    if at - us <= A.NEAR_SECONDS * S:
        return 4 if name.lower() in A.PACKAGE_MANAGERS else 5 if name.lower() in A.AUTOMATION else None
    return None


def pairs(changes, commands, lookback):
    out = {}
    for ch in changes:
        found = []
        for c in commands:
            if c[1] == ch[1] and ch[2] - lookback * S <= c[2] <= ch[2] + A.AHEAD_SECONDS * S and (t := tier(c, ch)) is not None:
                found.append((t, -c[2], -c[0]))
        if found:
            t, us, c = min(found)
            out[ch[0]] = (t, -c, -us)
    return out


def test_equals_all_pairs(spark):
    g = random.Random(3)
    names = ["passwd", "sshd_config", "a b", "x", "==", "été.conf", "app.log", "app.log.1", "f(1)", "r*d"]
    dirs = ["/etc", "/etc/ssh", "/srv/my data", "C:\\Users\\x", "", "/", "rel/dir", "=odd=/d"]
    paths = [d + ("\\" if "\\" in d else "/") + n for d in dirs for n in names] + names + ["/etc/", "", "/"]
    tools = ["vim", "apt", "DNF", "puppet", "cat", "bash"]
    line = lambda: g.choice(["vim {}", "cat {} {}", "cp '{}' /tmp", "x={};{}", "{}.bak", "cd {}&&ls", "echo pre{} ", "{}", ""]).format(g.choice(paths), g.choice(names))
    changes = [(k, f"h{g.randrange(2)}", g.randrange(3000) * S, g.choice([*paths, None])) for k in range(250)]
    commands = [(k, f"h{g.randrange(2)}", g.randrange(3000) * S, "s", "u", 1, g.choice(tools), line(), g.choice([*dirs, None])) for k in range(250)]
    for lookback in (900, 60):
        got = A.attribute(spark.createDataFrame(changes, CHANGES), spark.createDataFrame(commands, COMMANDS), lookback).collect()
        want = pairs(changes, commands, lookback)
        assert {r.id: (r.tier, r.c_id, r.c_us) for r in got} == want
        assert {t for t, *_ in want.values()} == {1, 2, 3, 4, 5}


def test_a_busy_host(spark):
    """Tens of thousands of changes and commands on one host within fifteen minutes, some on one file."""
    n = 30_000
    place = F.col("id") * 29_000 + 1
    name = F.concat(F.lit("/srv/data/f"), F.lpad((F.col("id") * 7919 % n).cast("string"), 6, "0"))
    changes = spark.range(n).select("id", F.lit("h").alias("host"), (place + 5).alias("us"), F.when(F.col("id") % 3 == 0, "/etc/passwd").otherwise(name).alias("target"))
    command = F.when(F.col("id") % 3 == 0, "vim /etc/passwd").otherwise(F.concat(F.lit("vim "), name))
    commands = spark.range(n).select("id", F.lit("h").alias("host"), place.alias("us"), F.lit("s").alias("session_id"), F.lit("u").alias("user"), F.lit(1).cast("long").alias("pid"), F.lit("vim").alias("name"), command.alias("command_line"), F.lit("/").alias("cwd"))
    start = time.time()
    got = A.attribute(changes, commands)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.filter("tier = 1").count() == n and got.filter("id % 3 <> 0 AND c_id <> id").count() == 0
    assert time.time() - start < 120
