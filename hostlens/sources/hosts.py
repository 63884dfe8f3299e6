"""Sessions, processes and services as a host lists them: who, /proc, and service states."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import state_changes, top_k
from .build import event, events_of, group, keys, prefixed

UNSET_ID = 2**32 - 1
MOST_ANCESTORS = 16

# States of services as system tools name them.
SERVICE_STATES = {"active": "running", "running": "running", "inactive": "stopped", "stopped": "stopped", "dead": "stopped", "failed": "failed"}


def read_who(lines: DataFrame, now: Column, zone: str = "UTC", column: str = "value") -> DataFrame:
    """`alice pts/0 2026-09-25 10:00 . 4242 (203.0.113.9)`, or with a date as in `Sep 25 10:00`.

    A terminal without a remote host is a pane of some other session and is skipped.
    """
    line = F.rtrim(column)
    noted = F.endswith(line, F.lit(")")) & F.contains(line, F.lit(" ("))
    main = F.when(noted, F.substring_index(line, " (", 1)).otherwise(line)
    note = F.when(noted, F.regexp_extract(line, r"^.*? \((.*)\)$", 1))
    f = F.split(F.trim(main), r"\s+")
    at = lambda k: F.get(f, F.lit(k))
    iso = F.contains(at(2), F.lit("-"))
    year = F.year(F.from_utc_timestamp(now, zone)).cast("string")
    stamp = F.when(iso, F.try_to_timestamp(F.concat_ws(" ", at(2), at(3)), F.lit("yyyy-MM-dd HH:mm"))).otherwise(
        F.try_to_timestamp(F.concat_ws(" ", year, at(2), F.lpad(at(3), 2, "0"), at(4)), F.lit("yyyy MMM dd HH:mm"))
    )
    pid = F.when(iso, at(5)).otherwise(at(6)).try_cast("long")
    remote = F.when((note != "") & ~note.rlike("^(?::|tmux)") & ~F.contains(note, F.lit("screen")), note)
    tty = at(1)
    protocol = F.when(remote.isNotNull(), "ssh").when(tty.rlike("^tty") | (tty == "console"), "console")
    where = F.when(remote.isNotNull(), F.concat(F.lit(" logged in via SSH from "), remote)).otherwise(F.concat(F.lit(" logged in on "), tty))
    e = event(
        "session", "session.start", F.concat(at(0), where, F.lit(" (before observation began)")), outcome="success", user=at(0), src_ip=remote,
        ts=F.coalesce(F.to_utc_timestamp(stamp, zone), now), details={"protocol": protocol, "observed_at_startup": F.lit("true")}, keys=keys(prefixed("pid", pid), prefixed("tty", tty)),
    )
    return events_of(lines, F.when(protocol.isNotNull() & pid.isNotNull() & (F.size(f) >= 5), e))


def decode_tty(number: Column) -> Column:
    """A controlling terminal's device number as its name; null for none or an unknown kind."""
    n = number.cast("long")
    major = F.shiftright(n, 8).bitwiseAND(F.lit(0xFFF))
    minor = n.bitwiseAND(F.lit(0xFF)).bitwiseOR(F.shiftright(n, 12).bitwiseAND(F.lit(0xFFF00)))
    pts = F.concat(F.lit("pts/"), (minor + (major - 136) * 256).cast("string"))
    out = F.when(n == 0, None).when(major.between(136, 143), pts).when((major == 4) & (minor < 64), F.concat(F.lit("tty"), minor.cast("string")))
    return out.when(major == 4, F.concat(F.lit("ttyS"), (minor - 64).cast("string")))


def parse_stat(stat: Column) -> Column:
    """struct<name, ppid, tty_nr, start> of a /proc stat line; the name may hold spaces and parentheses."""
    name = F.regexp_extract(stat, r"(?s)^[^(]*\((.*)\)[^)]*$", 1)
    f = F.split(F.ltrim(F.regexp_extract(stat, r"(?s)\)([^)]*)$", 1)), r"\s+")
    n = lambda k: F.get(f, F.lit(k)).try_cast("long")
    good = stat.rlike(r"(?s)\(.*\)") & n(1).isNotNull() & n(4).isNotNull() & n(19).isNotNull()
    return F.when(good, F.struct(name.alias("name"), n(1).alias("ppid"), n(4).alias("tty_nr"), n(19).alias("start")))


def known_id(c: Column) -> Column:
    """A login or session id; null for the kernel's `unset`."""
    return F.when(c != UNSET_ID, c)


def process_events(procs: DataFrame, self_pid: int = 0) -> DataFrame:
    """Recorded processes (host, ts, pid, stat, cmdline, login_user, session_no, ancestors) as events.

    A process is tied to its session by its ancestors, nearest first, its terminal and its login session.
    """
    s = parse_stat(F.col("stat"))
    command = F.trim(F.replace(F.decode("cmdline", "utf-8"), F.lit("\x00"), F.lit(" ")))
    tty = decode_tty(s["tty_nr"])
    own = F.transform(F.slice("ancestors", 1, MOST_ANCESTORS), lambda p: prefixed("pid", p))
    e = event(
        "process", "process.start", F.when(command != "", command).otherwise(s["name"]), outcome="success", user=F.col("login_user"), ts=F.col("ts"), host=F.col("host"),
        process={"pid": F.col("pid"), "ppid": s["ppid"], "name": s["name"], "command_line": F.nullif(command, F.lit(""))},
        keys=F.concat(own, keys(prefixed("tty", tty), prefixed("login", known_id(F.col("session_no"))))), learn=keys(prefixed("pid", F.col("pid"))),
    )
    rows = procs.select("pid", "stat", "cmdline", "login_user", "session_no", "ancestors", "host", "ts")
    return events_of(rows, F.when(s.isNotNull() & (F.col("pid") != self_pid), e)).drop("pid", "stat", "cmdline", "login_user", "session_no", "ancestors")


def new_processes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Processes (host, pid, start) of a listing that the one before does not have."""
    return after.join(before.select("host", "pid", "start"), ["host", "pid", "start"], "left_anti")


def with_ancestors(procs: DataFrame, rounds: int = MOST_ANCESTORS) -> DataFrame:
    """Processes (host, pid, ppid) with the pids of their ancestors, nearest first, at most `rounds`.

    Each round doubles the length that is known, so sixteen ancestors take four joins.
    """
    known = procs.select("host", "pid", F.array("ppid").alias("up"))
    n = 1
    while n < rounds:
        step = known.select(F.col("host").alias("_host"), F.col("pid").alias("_last"), F.col("up").alias("_more"))
        known = known.join(step, (F.col("host") == F.col("_host")) & (F.element_at("up", -1) == F.col("_last")), "left")
        known = known.select("host", "pid", F.concat("up", F.coalesce("_more", F.expr("array()").cast("array<bigint>"))).alias("up"))
        n *= 2
    return procs.join(known.select("host", "pid", F.slice(F.filter("up", lambda p: p > 0), 1, rounds).alias("ancestors")), ["host", "pid"])


def exec_messages(frames: DataFrame) -> DataFrame:
    """Recorded kernel process messages (host, ts, data) -> host, ts, pid of programs started, threads left out.

    A binary layout of several messages a frame; truncated ones are ignored.
    """
    import pandas as pd

    from ..session import ship

    ship(frames.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import struct

        for f in parts:
            rows = []
            for host, ts, data in zip(f["host"], f["ts"], f["data"], strict=True):
                at = 0
                while data is not None and at + 16 <= len(data):
                    size = struct.unpack_from("<I", data, at)[0]
                    if size < 16 or at + size > len(data):
                        break
                    if size >= 16 + 20 + 24:  # header, connector header, event
                        what, pid, tgid = struct.unpack_from("<I", data, at + 36)[0], *struct.unpack_from("<II", data, at + 52)
                        if what == 2 and pid == tgid:
                            rows.append((host, ts, pid))
                    at += (size + 3) & ~3
            yield pd.DataFrame(rows, columns=["host", "ts", "pid"])

    return frames.select("host", "ts", "data").mapInPandas(run, "host string, ts timestamp, pid bigint")


def service_transitions(states: DataFrame) -> DataFrame:
    """Listings (host, us, service, state) -> changes between known states."""
    out = state_changes(states, ["host", "service"], "state", ["us"])
    return out.withColumn("message", F.concat(F.lit("Service "), "service", F.lit(": "), "old_state", F.lit(" -> "), "state"))


def service_state(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SERVICE_STATES.items() for x in kv]), F.lower(c)), F.lit("unknown"))


def read_units(lines: DataFrame, column: str = "value") -> DataFrame:
    """`nginx.service loaded active running Web server` -> service, state, description."""
    p = r"^\s*(?:● )?(\S+)\.service\s+\S+\s+(\S+)\s+\S+\s*(.*)$"
    out = lines.select(group(F.col(column), p, 1).alias("service"), service_state(F.regexp_extract(column, p, 2)).alias("state"), F.regexp_extract(column, p, 3).alias("description"))
    return out.filter("service IS NOT NULL")


def top_processes(usage: DataFrame, keys_: list[str], k: int = 8) -> DataFrame:
    """The k busiest processes of each sample: cpu percent, plus bytes read and written by the million."""
    busy = (F.col("cpu_percent") + (F.col("read_bytes_per_sec") + F.col("write_bytes_per_sec")) / 1e6).desc()
    return top_k(usage, keys_, [busy, F.col("pid").asc()], k)


# File systems that are no storage.
PSEUDO_FILE_SYSTEMS = ("tmpfs", "devtmpfs", "proc", "sysfs", "cgroup", "cgroup2", "devpts", "mqueue", "debugfs", "tracefs", "pstore", "squashfs")


def real_volumes(samples: DataFrame) -> DataFrame:
    """Samples whose volumes (with file_system) are storage: neither a pseudo file system nor a fuse mount."""
    name = lambda v: F.coalesce(v["file_system"], F.lit(""))
    return samples.withColumn("volumes", F.filter("volumes", lambda v: ~name(v).isin(*PSEUDO_FILE_SYSTEMS) & ~F.startswith(name(v), F.lit("fuse."))))


def volume_totals(samples: DataFrame) -> DataFrame:
    """Samples with an array of volumes -> the fullest volume and all bytes read and written a second."""
    add = lambda f: F.aggregate("volumes", F.lit(0.0), lambda a, v: a + F.coalesce(v[f], F.lit(0.0)))
    return samples.withColumns({"max_used_percent": F.array_max(F.transform("volumes", lambda v: v["used_percent"])), "total_read": add("read_bytes_per_sec"), "total_write": add("write_bytes_per_sec")})


def expand_path_pattern(spark: SparkSession, pattern: str) -> list[str]:
    """The existing paths that a pattern names, sorted; `*` and `?` stay inside a segment. Names only, no contents.

    Other characters that globs give a meaning stand for themselves; a pattern without wildcards is the path itself.
    """
    plain = "".join("\\" + c if c in "[]{}^,\\" else c for c in pattern)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(plain)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(at)
    return sorted(f.getPath().toUri().getPath() for f in found) if found else []
