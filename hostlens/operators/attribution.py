"""Who changed it: a change is matched with the commands that ran shortly before it, and with the sessions then open.

No change is ever paired with the commands before it. Which distinct command lines name which distinct targets is found
once, through an inverted index of what a command line could name (`named`); then commands and changes of one host and
one target are swept in time order, and each change takes the last command before it. So a host with many changes and
many commands within minutes costs in proportion to them. The sweep is a window over a host and a target (for tiers 4
and 5 over a host's changes and the runs of those few programs), which sorts and spills; none is held in memory.

Interval joins on a host (related changes) carry a bucket of time: an event stands in its own bucket, a change asks in
the buckets its window touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import basename, dirname, mentions_token

LOOKBACK_SECONDS = 15 * 60
NEAR_SECONDS = 5 * 60
AHEAD_SECONDS = 5

# Programs that change files for others.
PACKAGE_MANAGERS = (
    "apt", "apt-get", "dpkg", "yum", "dnf", "rpm", "zypper", "apk", "pacman", "snap", "unattended-upgr",
    "msiexec.exe", "trustedinstaller.exe", "tiworker.exe", "wusa.exe", "choco.exe", "winget.exe",
)
AUTOMATION = ("ansible", "ansible-playbook", "puppet", "chef-client", "salt-minion", "salt-call", "cloud-init", "terraform", "cfn-init")


def recent_commands(events: DataFrame) -> DataFrame:
    """What enters the lookback: process events, and commands run or tried through sudo."""
    p = events.filter("category = 'process'").withColumn("name", F.col("process_name"))
    s = events.filter("action = 'privilege.sudo' AND command_line IS NOT NULL").withColumn("name", F.lit("sudo"))
    columns = ["id", "host", "us", "session_id", "user", "pid", "name", F.coalesce("command_line", F.lit("")).alias("command_line"), "cwd"]
    return p.select(*columns).unionByName(s.select(*columns))


# -- which command names which target ----------------------------------------------------------------------------------

#: What may stand beside a name (functions.scalars.mentions_token).
EDGES = r"[\s/\\'\"=<>|;&(),:]"
MOST_PREFIX = 64


def _key(*parts: Column | str) -> Column:
    return F.xxhash64(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _command_keys(command: Column) -> Column:
    """Keys of everything that a command line could name.

    It is cut at the edges. A name that stands between edges is found by any of its pieces between them, which are
    pieces of the command; a path that stands anywhere in it by its last piece, which begins one of the command's, and
    the piece before, if that has an edge before it in the path. Key 0 finds names without a piece."""
    pieces = F.split(command, EDGES, -1)
    heads = lambda p: F.transform(F.sequence(F.lit(0), F.least(F.length(p), F.lit(MOST_PREFIX))), lambda n: F.substring(p, F.lit(1), n))
    alone = F.flatten(F.transform(pieces, lambda p: F.transform(heads(p), lambda h: _key("path", h))))
    after = F.flatten(F.transform(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: F.when(i > 0, F.transform(heads(F.get(pieces, i)), lambda h: _key("dir", F.get(pieces, i - 1), h))).otherwise(F.array().cast("array<bigint>"))))
    return F.array_distinct(F.concat(F.transform(pieces, lambda p: _key("name", p)), alone, after, F.array(F.lit(0).cast("bigint"))))


def _name_key(name: Column) -> Column:
    """The key under which a command finds a name between edges: its longest piece."""
    pieces = F.split(name, EDGES, -1)
    longest = F.array_max(F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), p.alias("piece"))))
    return F.when(longest["n"] > 0, _key("name", longest["piece"])).otherwise(F.lit(0).cast("bigint"))


def _path_key(path: Column) -> Column:
    pieces = F.split(path, EDGES, -1)
    head = F.substring(F.element_at(pieces, -1), 1, MOST_PREFIX)
    return F.when(F.size(pieces) > 2, _key("dir", F.get(pieces, F.size(pieces) - 2), head)).otherwise(_key("path", head))


def _is_path(target: Column) -> Column:
    return target.rlike(r"[/\\]")


def named(commands: DataFrame, targets: DataFrame) -> DataFrame:
    """command_line, what, text: which distinct command lines name which distinct texts.

    commands: command_line; targets: what (`target` or `base`) and text. A target that is a path is named wherever it
    stands, other texts where they stand between edges. Only pairs that share a key are looked at, and then exactly."""
    t = targets.select("what", "text").distinct().withColumn("_path", (F.col("what") == "target") & _is_path(F.col("text")))
    t = t.withColumn("_key", F.when(F.col("_path"), _path_key(F.col("text"))).otherwise(_name_key(F.col("text"))))
    c = commands.select("command_line").distinct().select("command_line", F.explode(_command_keys(F.col("command_line"))).alias("_key"))
    sure = F.when(F.col("_path"), F.contains("command_line", "text")).otherwise(mentions_token(F.col("command_line"), F.col("text")))
    return c.join(t, "_key").filter(sure).select("command_line", "what", "text").distinct()


def in_window(changes: DataFrame, commands: DataFrame, before: int, after: int) -> DataFrame:
    """Pairs of a change and a command on its host, at most `before` seconds earlier and `after` seconds later.

    Columns of commands get the prefix c_. The bucket is as wide as the window, so a change asks in two at most.
    """
    width = (before + after) * 1_000_000
    asks = F.array_distinct(F.array(F.floor((F.col("us") - before * 1_000_000) / width), F.floor((F.col("us") + after * 1_000_000) / width)))
    left = changes.withColumn("_bucket", F.explode(asks))
    right = commands.select(*[F.col(c).alias(f"c_{c}") for c in commands.columns]).withColumn("c_bucket", F.floor(F.col("c_us") / width))
    near = (F.col("c_us") >= F.col("us") - before * 1_000_000) & (F.col("c_us") <= F.col("us") + after * 1_000_000)
    return left.join(right, (F.col("host") == F.col("c_host")) & (F.col("_bucket") == F.col("c_bucket")) & near).drop("_bucket", "c_bucket", "c_host")


def attribute(changes: DataFrame, commands: DataFrame, lookback: int = LOOKBACK_SECONDS) -> DataFrame:
    """Each change (id, host, us, target) with its best command: the lowest tier, then the newest.

    Tier 1: the command names the target. 2: it names the file, from the file's directory. 3: it names a file of that
    name, of at least four bytes. 4 and 5: a package manager or an automation ran within five minutes."""
    ch = changes.select("id", "host", "us", "target").withColumns({"base": basename(F.col("target")), "dir": dirname(F.col("target"))})
    cm = commands.select("host", F.struct(*[F.col(c).alias(f"c_{c}") for c in ("us", "id", "session_id", "user", "pid", "name", "command_line")]).alias("c"), F.col("us").alias("at"), "command_line", "name", "cwd")
    wanted = ch.select("host", F.explode(F.array(F.struct(F.lit("target").alias("what"), F.col("target").alias("text")), F.struct(F.lit("base").alias("what"), F.col("base").alias("text")))).alias("w")).select("host", "w.*").filter("length(text) > 0").distinct()
    hits = cm.join(named(commands, wanted), "command_line").join(wanted, ["host", "what", "text"], "left_semi")
    none = F.lit("")
    # Commands stand at their time under each text that they can explain, changes under each text that can explain them.
    one = F.struct(F.lit(1).alias("tier"), F.col("text").alias("text"), none.alias("cwd"))
    two = F.when(F.col("cwd").isNotNull(), F.struct(F.lit(2).alias("tier"), F.col("text").alias("text"), F.col("cwd").alias("cwd")))
    three = F.when(F.octet_length("text") >= 4, F.struct(F.lit(3).alias("tier"), F.col("text").alias("text"), none.alias("cwd")))
    ways = F.when(F.col("what") == "target", F.array(one)).otherwise(F.filter(F.array(two, three), lambda x: x.isNotNull()))
    there = hits.select("host", F.inline(ways), "at", "c")
    near = F.when(F.lower("name").isin(*PACKAGE_MANAGERS), 4).when(F.lower("name").isin(*AUTOMATION), 5)
    there = there.unionByName(cm.select("host", near.alias("tier"), none.alias("text"), none.alias("cwd"), "at", "c").filter("tier IS NOT NULL"))
    ask = lambda n, text, cwd, when: F.when(when, F.struct(F.lit(n).alias("tier"), text.alias("text"), cwd.alias("cwd")))
    some, base = F.length("target") > 0, F.length("base") > 0
    asks = F.array(ask(1, F.col("target"), none, some), ask(2, F.col("base"), F.col("dir"), base), ask(3, F.col("base"), none, base & (F.octet_length("base") >= 4)), ask(4, none, none, F.lit(True)), ask(5, none, none, F.lit(True)))
    asked = ch.select("host", F.inline(F.filter(asks, lambda x: x.isNotNull())), (F.col("us") + AHEAD_SECONDS * 1_000_000).alias("at"), F.col("id").alias("ask"), F.col("us").alias("asked_us"))
    every = there.withColumns({"ask": F.lit(None).cast("long"), "asked_us": F.lit(None).cast("long")}).unionByName(asked.withColumn("c", F.lit(None).cast(there.schema["c"].dataType)))
    sweep = Window.partitionBy("host", "tier", "text", "cwd").orderBy(F.col("at"), F.col("c").isNull(), F.col("c.c_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = every.withColumn("best", F.last("c", ignorenulls=True).over(sweep)).filter("ask IS NOT NULL AND best IS NOT NULL")
    span = F.when(F.col("tier") <= 3, F.lit(lookback * 1_000_000)).otherwise(F.lit(min(lookback, NEAR_SECONDS) * 1_000_000))
    found = found.filter(F.col("best.c_us") >= F.col("asked_us") - span)
    out = found.groupBy(F.col("ask").alias("id")).agg(F.min_by(F.struct("tier", "best.*"), F.struct(F.col("tier"), -F.col("best.c_us"), -F.col("best.c_id"))).alias("b")).select("id", "b.*")
    confidence = F.when(F.col("tier") <= 2, "high").otherwise("medium")
    return out.withColumns({"confidence": confidence, "session": F.col("c_session_id"), "by_user": F.col("c_user"), "reason": reason(F.col("tier"), F.col("c_name"))})


def reason(tier_: Column, name: Column) -> Column:
    quoted = F.concat(F.lit("`"), name, F.lit("`"))
    text = F.when(tier_ == 1, F.concat(quoted, F.lit(" named the target"))).when(tier_ == 2, F.concat(quoted, F.lit(" named the file from its directory")))
    text = text.when(tier_ == 3, F.concat(quoted, F.lit(" named a file of that name"))).when(tier_ == 4, F.concat(F.lit("package manager "), quoted, F.lit(" was running")))
    return text.otherwise(F.concat(F.lit("configuration management "), quoted, F.lit(" was running")))


def open_sessions(changes: DataFrame, sessions: DataFrame) -> DataFrame:
    """For each change: how many sessions were open on its host, and which if there was one.

    sessions: id, host, user, start_us, end_us (null while open). Starts, changes and ends of a host are swept in time
    order; running sums of +1 and -1 give the number, and the same sums over the sessions' hashes give the hash of the
    one that is open. So no change is ever paired with a session.
    """
    key = F.xxhash64("id").cast("decimal(38,0)")
    s = sessions.select("host", "id", "user", "start_us", "end_us", key.alias("key"))
    point = lambda at, kind, n: s.select("host", at.alias("at"), F.lit(kind).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(n).cast("long").alias("n"), (F.col("key") * n).cast("decimal(38,0)").alias("key"))
    asks = changes.select("host", F.col("us").alias("at"), F.lit(1).alias("kind"), F.col("id").cast("long"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("key"))
    every = asks.unionByName(point(F.col("start_us") - AHEAD_SECONDS * 1_000_000, 0, 1)).unionByName(point(F.col("end_us"), 2, -1).filter("at IS NOT NULL"))
    w = Window.partitionBy("host").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = every.withColumns({"open": F.sum("n").over(w), "sum": F.sum("key").over(w).cast("decimal(38,0)")}).filter("kind = 1")
    one = F.when(F.col("open") == 1, F.col("sum"))
    known = s.select(F.col("key").alias("_key"), F.col("host").alias("_host"), F.col("id").alias("only_session"), F.col("user").alias("only_user"))
    out = swept.withColumn("one", one).join(known, (F.col("one") == F.col("_key")) & (F.col("host") == F.col("_host")), "left")
    return out.select("id", F.col("open").alias("open_sessions"), "only_session", "only_user", F.when(F.col("open") == 1, "low").otherwise("none").alias("confidence"))


def attribution(changes: DataFrame, commands: DataFrame, sessions: DataFrame, lookback: int = LOOKBACK_SECONDS) -> DataFrame:
    """All tiers: a command, else the one open session with low confidence, else none."""
    found = attribute(changes, commands, lookback)
    rest = open_sessions(changes.join(found.select("id"), "id", "left_anti"), sessions)
    a = found.select("id", "confidence", "reason", F.col("session").alias("session_id"), F.col("by_user").alias("user"), F.lit(None).cast("long").alias("open_sessions"))
    why = F.when(F.col("open_sessions") == 0, "no interactive session was open").when(F.col("open_sessions") == 1, "only interactive session open at the time")
    why = why.otherwise(F.concat(F.col("open_sessions").cast("string"), F.lit(" interactive sessions were open")))
    b = rest.select("id", "confidence", why.alias("reason"), F.col("only_session").alias("session_id"), F.col("only_user").alias("user"), "open_sessions")
    return a.unionByName(b)


def apply(events: DataFrame, found: DataFrame) -> DataFrame:
    """File, package and account events without session and user take both from high or medium attributions; the
    evidence is kept for all."""
    f = found.select("id", F.struct("confidence", "reason").alias("attribution"), F.col("session_id").alias("_sid"), F.col("user").alias("_user"))
    due = F.col("category").isin("file", "package", "account") & F.col("session_id").isNull() & F.col("user").isNull()
    sure = due & F.col("attribution.confidence").isin("high", "medium")
    out = events.join(f, "id", "left").withColumn("attribution", F.when(due, F.col("attribution"))).withColumn("_sure", F.coalesce(sure, F.lit(False)))
    out = out.withColumns({"session_id": F.when(F.col("_sure"), F.col("_sid")).otherwise(F.col("session_id")), "user": F.when(F.col("_sure"), F.col("_user")).otherwise(F.col("user"))})
    return out.drop("_sid", "_user", "_sure")


def newest(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")
