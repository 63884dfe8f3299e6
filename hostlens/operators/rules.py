"""Detection rules: candidates from events, suppression, and a cooldown for each rule and key.

Every rule turns events into candidate alerts with the columns of ALERT; the cooldown then decides which of them fire.
Suppressed candidates are removed before the cooldown, so they start none. The exception is password spraying: an
event on which it fires skips the brute-force rule even where its alert is suppressed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import base_user, is_meaningful_ip, truncate_bytes, wildcard_match, wildcard_match_column, within_hours
from ..schema import SEVERITY_ALIASES
from .ordered import Cooldown, RollingCap, fold
from .windows import failures_before, sliding_count, sliding_distinct, source_history

COOLDOWN_SECONDS = 900
ALERT = ("rule", "cooldown_key", "us", "id", "severity", "title")

# Names and paths that rules look for.
SHELLS = ("sh", "bash", "dash", "zsh", "ksh", "ash", "busybox", "cmd.exe", "powershell.exe", "pwsh.exe", "pwsh")
WEB_SERVERS = ("nginx", "apache2", "httpd", "lighttpd", "caddy", "php-fpm*", "php-cgi*", "w3wp.exe", "httpd.exe", "tomcat*", "php-cgi.exe", "nginx.exe")
ADMIN_GROUPS = ("sudo", "wheel", "admin", "root", "adm", "docker", "administrators", "domain admins", "enterprise admins", "remote desktop users", "backup operators")
PRIVILEGED = ("root", "administrator")
SENSITIVE_FILES = (
    ("/etc/ld.so.preload", 4),
    ("/etc/passwd", 3),
    ("/etc/shadow", 3),
    ("/etc/gshadow", 3),
    ("/etc/group", 2),
    ("/etc/sudoers", 3),
    ("/etc/sudoers.d/*", 3),
    ("*/authorized_keys", 3),
    ("*/authorized_keys2", 3),
    ("*administrators_authorized_keys", 3),
    ("/etc/ssh/sshd_config", 3),
    ("/etc/ssh/sshd_config.d/*", 3),
    ("*\\ssh\\sshd_config", 3),
    ("/etc/pam.d/*", 3),
    ("/etc/security/*", 2),
    ("/etc/crontab", 2),
    ("/etc/cron.d/*", 2),
    ("/etc/cron.hourly/*", 2),
    ("/etc/cron.daily/*", 2),
    ("/var/spool/cron/*", 2),
    ("/etc/systemd/system/*", 2),
    ("/etc/rc.local", 2),
    ("/etc/profile.d/*", 2),
    ("/etc/hosts", 2),
    ("*\\drivers\\etc\\hosts", 2),
    ("*\\Start Menu\\Programs\\StartUp\\*", 3),
)

# Identifier, severity and pattern of suspicious commands, the first that matches counts.
COMMAND_PATTERNS = (
    ("download_exec", 3, r"(?i)\b(curl|wget)\b[^|;&]*\|\s*(sudo\s+)?(ba|z|da)?sh\b"),
    ("encoded_exec", 3, r"(?i)base64\s+(-d|--decode)[^|]*\|\s*(ba|z|da)?sh\b"),
    ("reverse_shell", 4, r"/dev/tcp/[0-9a-zA-Z.\-]+/\d+"),
    ("reverse_shell", 4, r"(?i)\b(nc|ncat|netcat)\b.*\s-(e|c)\s"),
    ("reverse_shell", 3, r"(?i)\bsocat\b.*exec:"),
    ("history_tamper", 3, r"(?i)(history\s+-c\b|unset\s+HISTFILE|HISTFILE=/dev/null|HISTSIZE=0)"),
    ("cryptominer", 4, r"(?i)\b(xmrig|minerd|cpuminer|xmr-stak|nbminer)\b"),
    ("cryptominer", 4, r"(?i)stratum\+tcp://"),
    ("defense_evasion", 3, r"(?i)\b(setenforce\s+0|ufw\s+disable|iptables\s+-F|systemctl\s+(stop|disable|mask)\s+(auditd|rsyslog|firewalld|apparmor|syslog))"),
    ("log_tamper", 3, r"(?i)\b(rm|shred|truncate|>)\s.*(/var/log/(auth\.log|secure|wtmp|btmp|lastlog|audit)|\.bash_history)"),
    ("persistence", 2, r"(?i)\bchattr\s+\+i\s"),
    ("credential_dump", 4, r"(?i)\b(mimikatz|sekurlsa|lsadump)\b"),
    ("credential_dump", 4, r"(?i)comsvcs(\.dll)?[^\n]*minidump"),
    ("credential_dump", 4, r"(?i)\bprocdump(64)?(\.exe)?\b.*\blsass"),
    ("ransomware_prep", 4, r"(?i)vssadmin(\.exe)?\s+delete\s+shadows|wbadmin(\.exe)?\s+delete|bcdedit(\.exe)?.*recoveryenabled\s+no|wmic(\.exe)?\s+shadowcopy\s+delete"),
    ("log_tamper", 4, r"(?i)\bwevtutil(\.exe)?\s+(cl|clear-log)\b"),
    ("encoded_exec", 3, r"(?i)\b(powershell|pwsh)(\.exe)?\b.*\s-(e|ec|enc|encodedcommand)\s+[A-Za-z0-9+/=]{20,}"),
    ("download_exec", 3, r"(?i)(iex\s*\(|invoke-expression).*(downloadstring|invoke-webrequest|iwr\s|net\.webclient)"),
    ("download_exec", 3, r"(?i)\bcertutil(\.exe)?\b.*-urlcache"),
    ("account_manipulation", 3, r"(?i)\bnet(1)?(\.exe)?\s+localgroup\s+administrators\s+\S+\s+/add"),
    ("account_manipulation", 2, r"(?i)\bnet(1)?(\.exe)?\s+user\s+\S+\s+\S+\s+/add"),
    ("persistence", 2, r"(?i)\breg(\.exe)?\s+add\s+.*\\(Run|RunOnce)\b"),
)


@dataclass(frozen=True)
class Settings:
    """Thresholds and switches of the rules."""

    failure_threshold: int = 8
    spray_users: int = 5
    window_seconds: int = 120
    success_failures: int = 3
    cooldown_seconds: int = COOLDOWN_SECONDS
    business_hours: str = ""
    zone: str = "UTC"
    trusted: tuple[str, ...] = ()
    new_source: bool = True
    privileged_login: bool = True
    suspicious_commands: bool = True
    webserver_shell: bool = True
    sensitive_files: bool = True
    account_changes: bool = True
    log_tampering: bool = True

    def is_trusted(self, ip: Column) -> Column:
        return reduce(lambda a, b: a | b, [wildcard_match(ip, p) for p in self.trusted], F.lit(False))


# -- cooldown -------------------------------------------------------------------------------------------------


def with_cooldown(candidates: DataFrame, keys: list[str], seconds: int = COOLDOWN_SECONDS, us: str = "us", tie: str = "id") -> DataFrame:
    """The candidates that fire: the first of a key, and each that comes `seconds` or more after the last that fired.

    Which candidate fires depends on the one that did before it, so this is an ordered fold (see ordered).
    """
    timed = candidates if us == "us" else candidates.withColumn("us", F.col(us))
    out = fold(timed, keys, ["us", tie], partial(Cooldown, seconds * 1_000_000), inputs=["us"])
    return out if us == "us" else out.drop("us")


def rolling_cap(notices: DataFrame, key: str, most: int = 30, seconds: int = 3600, tie: str = "id") -> DataFrame:
    """At most `most` notices of a key in any `seconds`; each that is sent says how many were held back before it."""
    added = T.StructType([T.StructField("suppressed", T.LongType())])
    return fold(notices, [key], ["us", tie], partial(RollingCap, most, seconds * 1_000_000), added, inputs=["us"])


# -- rules ----------------------------------------------------------------------------------------------------


def _alerts(events: DataFrame, rule: Column | str, key: Column, severity: Column | int, title: Column) -> DataFrame:
    own = {
        "rule": rule if isinstance(rule, Column) else F.lit(rule),
        "cooldown_key": key,
        "severity": severity if isinstance(severity, Column) else F.lit(severity),
        "title": title,
    }
    return events.withColumn("trigger_action", F.col("action")).withColumns(own)


def _remote(events: DataFrame) -> DataFrame:
    return events.filter(is_meaningful_ip(F.col("src_ip")))


#: Severities of the rules that look back.
WINDOWED = {"password_spray": 2, "bruteforce": 2, "success_after_failures": 4, "new_source": 2}


def windowed_title(rule: str, n: Column, s: Settings) -> Column:
    """What a rule that looks back says about an event, given the number it found."""
    n, who = n.cast("string"), F.coalesce("user", F.lit(""))
    if rule == "password_spray":
        return F.concat(F.lit("Password spraying from "), "src_ip", F.lit(": "), n, F.lit(f" different accounts tried in {s.window_seconds}s"))
    if rule == "bruteforce":
        return F.concat(F.lit("Brute force from "), "src_ip", F.lit(": "), n, F.lit(f" failed logins in {s.window_seconds}s"))
    if rule == "success_after_failures":
        return F.concat(F.lit("Login SUCCEEDED for "), who, F.lit(" from "), "src_ip", F.lit(" after "), n, F.lit(" failed attempts from that address"))
    other = F.when(n == "1", "").otherwise("es")
    return F.concat(who, F.lit(" logged in from a new address "), "src_ip", F.lit(" (previously seen from "), n, F.lit(" other address"), other, F.lit(")"))


def password_spray(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Failures of many users from one address within the window."""
    f = sliding_distinct(_remote(events.filter("action = 'auth.failure'")), "src_ip", "user", s.window_seconds)
    f = f.filter(F.col("distinct_recent") >= s.spray_users)
    return _alerts(f, "password_spray", F.col("src_ip"), 2, windowed_title("password_spray", F.col("distinct_recent"), s))


def brute_force(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Many failures from one address within the window, on events on which no spray alert fires."""
    f = sliding_count(_remote(events.filter("action = 'auth.failure'")), "src_ip", s.window_seconds)
    f = f.filter(F.col("recent") >= s.failure_threshold)
    spray = with_cooldown(password_spray(events, s), ["rule", "cooldown_key"], s.cooldown_seconds).select("id")
    return _alerts(f.join(spray, "id", "left_anti"), "bruteforce", F.col("src_ip"), 2, windowed_title("bruteforce", F.col("recent"), s))


def success_after_failures(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    """A login from an address that has failed several times in five windows before it."""
    e = _remote(events.filter(F.col("action").isin("auth.failure", "session.start", "auth.success")))
    e = failures_before(e, "src_ip", 5 * s.window_seconds, F.col("action") == "auth.failure")
    e = e.filter((F.col("action") != "auth.failure") & (F.col("failures") >= s.success_failures))
    return _alerts(e, "success_after_failures", F.col("src_ip"), 4, windowed_title("success_after_failures", F.col("failures"), s))


def new_source(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    """A user's first login from an address, where the user is known from others."""
    h = source_history(_remote(events.filter("action = 'session.start'")).withColumn("user", F.coalesce("user", F.lit(""))))
    h = h.filter(F.col("first_seen") & (F.col("prior") > 0) & ~s.is_trusted(F.col("src_ip")))
    return _alerts(h, "new_source", F.concat_ws("|", "user", "src_ip"), 2, windowed_title("new_source", F.col("prior"), s))


@dataclass(frozen=True)
class Hit:
    """A rule that looks at one event alone: when it holds, and what it says then."""

    when: Column
    rule: Column | str
    key: Column
    severity: Column | int
    title: Column

    def of(self, events: DataFrame) -> DataFrame:
        return _alerts(events.filter(self.when), self.rule, self.key, self.severity, self.title)

    def entry(self) -> Column:
        """The hit as a struct; null where the rule does not hold."""
        as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
        own = F.struct(as_column(self.rule).alias("rule"), self.key.alias("cooldown_key"), as_column(self.severity).cast("int").alias("severity"), self.title.alias("title"), F.lit(None).cast("boolean").alias("notify"))
        return F.when(self.when, own)


def off_hours_hit(s: Settings) -> Hit:
    when = (F.col("action") == "session.start") & is_meaningful_ip(F.col("src_ip")) & ~within_hours(F.col("ts"), s.business_hours, s.zone) & ~s.is_trusted(F.col("src_ip"))
    who = F.coalesce("user", F.lit(""))
    at = F.date_format(F.from_utc_timestamp("ts", s.zone), "HH:mm")
    title = F.concat(who, F.lit(" logged in at "), at, F.lit(f" local time, outside business hours ({s.business_hours})"))
    return Hit(when, "off_hours", F.concat(who, F.lit("|"), F.date_format("ts", "yyyyMMdd")), 1, title)


def off_hours(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    """A login outside business hours, once a user and day."""
    return off_hours_hit(s).of(events)


def privileged_login_hit() -> Hit:
    when = (F.col("action") == "session.start") & F.col("protocol").isin("ssh", "rdp") & base_user(F.col("user")).isin(*PRIVILEGED)
    title = F.concat(F.lit("Direct "), "protocol", F.lit(" login as "), "user", F.coalesce(F.concat(F.lit(" from "), "src_ip"), F.lit("")))
    return Hit(when, "privileged_login", F.concat_ws("|", "user", F.coalesce("src_ip", F.lit(""))), 2, title)


def privileged_login(events: DataFrame) -> DataFrame:
    """A direct login to an administrative account over the network."""
    return privileged_login_hit().of(events)


def command_match(command: Column) -> Column:
    """rule and severity of the first pattern that matches; null for none.

    The patterns are meant for Unicode classes of characters, which Java has only under (?U). The first match is found
    as a number and then looked up, which keeps the generated code of a stage within Java's limit for a method.
    """
    first = F.lit(None).cast("int")
    for n, (_, _, p) in reversed(list(enumerate(COMMAND_PATTERNS, 1))):
        first = F.when(command.rlike("(?U)" + p), F.lit(n)).otherwise(first)
    known = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity")) for r, s, _ in COMMAND_PATTERNS])
    return F.get(known, first - 1)


def any_command_match(command: Column) -> Column:
    """Whether some pattern matches, by one expression: most commands are spared the rest."""
    return command.rlike("(?U)" + "|".join(f"(?:{p})" for _, _, p in COMMAND_PATTERNS))


def _runs() -> Column:
    return (F.col("category") == "process") | ((F.col("category") == "privilege") & (F.col("outcome") != "failure"))


def _command_key() -> Column:
    return F.concat(F.coalesce("session_id", F.lit("")), F.lit("|"), truncate_bytes(F.col("command_line"), 200))


def _command_title(rule: Column) -> Column:
    return F.concat(rule, F.lit(": "), truncate_bytes(F.col("command_line"), 300))


def suspicious_command(events: DataFrame) -> DataFrame:
    e = events.filter(_runs()).filter(any_command_match(F.col("command_line")))
    # Exploded, so that later filters on the rule (suppressions) read the match instead of repeating its expression.
    e = e.withColumn("_hit", F.explode(F.array(command_match(F.col("command_line")))))
    return _alerts(e, F.col("_hit.rule"), _command_key(), F.col("_hit.severity"), _command_title(F.col("_hit.rule"))).drop("_hit")


def webserver_shell_hit() -> Hit:
    parent = F.lower(F.coalesce("parent_name", F.lit("")))
    web = reduce(lambda a, b: a | b, [wildcard_match(parent, p, True) for p in WEB_SERVERS])
    title = F.concat(F.lit("Web server process "), parent, F.lit(" spawned a shell ("), F.lower("process_name"), F.lit(")"))
    return Hit(_runs() & F.lower("process_name").isin(*SHELLS) & web, "webserver_shell", F.concat(parent, F.lit("|"), F.coalesce("command_line", F.lit(""))), 3, title)


def webserver_shell(events: DataFrame) -> DataFrame:
    """A shell started by a web server."""
    return webserver_shell_hit().of(events)


def sensitive_severity(path: Column) -> Column:
    """Severity of the first path pattern that matches; null for none."""
    return F.coalesce(*[F.when(wildcard_match(path, p), s) for p, s in SENSITIVE_FILES])


def sensitive_title() -> Column:
    who = F.coalesce(F.concat(F.lit(" by "), "user"), F.lit(" (actor not identified)"))
    return F.concat(F.lit("Sensitive file "), F.regexp_replace("action", r"^file\.", ""), who, F.lit(": "), "target")


def _sensitive_key() -> Column:
    return F.concat("target", F.lit("|"), F.coalesce("after_sha", "action"))


def sensitive_file(events: DataFrame) -> DataFrame:
    e = events.filter("category = 'file'").withColumn("_sev", sensitive_severity(F.col("target"))).filter("_sev IS NOT NULL")
    return _alerts(e, "sensitive_file", _sensitive_key(), F.col("_sev"), sensitive_title()).drop("_sev")


def account_change_hit() -> Hit:
    target, group = F.coalesce("target", F.lit("")), F.lower(F.coalesce("group", F.lit("")))
    sev = F.when(F.col("action").isin("account.user_created", "account.user_deleted"), 2).when(F.col("action") == "account.user_enabled", 1)
    sev = sev.when((F.col("action") == "account.group_member_added") & group.isin(*ADMIN_GROUPS), 3)
    words = F.when(F.col("action") == "account.group_member_added", F.concat(F.coalesce("member", target), F.lit(" added to privileged group '"), group, F.lit("'")))
    title = words.otherwise(F.concat(F.lit("User account "), F.regexp_replace("action", r"^account\.user_", ""), F.lit(": "), target))
    # The cooldown is one for each action, the rule's name is the same for all.
    key = F.concat("action", F.lit("|"), target, F.lit("|"), F.coalesce("group", F.lit("")))
    return Hit((F.col("category") == "account") & sev.isNotNull(), "account_change", key, sev, title)


def account_change(events: DataFrame) -> DataFrame:
    """Users created, deleted or enabled, and members added to administrative groups; group and member are columns."""
    return account_change_hit().of(events)


def privilege_failure_hit(columns: list[str]) -> Hit:
    reason = F.coalesce("reason", F.lit("authentication failure")) if "reason" in columns else F.lit("authentication failure")
    who = F.coalesce("user", F.lit(""))
    sev = F.when(F.contains(reason, F.lit("NOT in sudoers")), 2).otherwise(1)
    return Hit(F.expr("category = 'privilege' AND outcome = 'failure'"), "privilege_failure", who, sev, F.concat(who, F.lit(" failed to elevate privileges ("), reason, F.lit(")")))


def privilege_failure(events: DataFrame) -> DataFrame:
    """A failed sudo or su; the reason is a column, where there is one."""
    return privilege_failure_hit(events.columns).of(events)


def service_installed_hit() -> Hit:
    what = F.coalesce("target", F.lit(""))
    return Hit(F.expr("category = 'service' AND action = 'service.installed'"), "persistence_service", what, 2, F.concat(F.lit("New service installed: "), F.coalesce("target", F.lit("?"))))


def service_installed(events: DataFrame) -> DataFrame:
    return service_installed_hit().of(events)


def scheduled_task_hit() -> Hit:
    return Hit(F.col("action") == "persistence.scheduled_task", "persistence_task", F.coalesce("target", F.lit("")), 2, F.col("message"))


def scheduled_task(events: DataFrame) -> DataFrame:
    return scheduled_task_hit().of(events)


def log_tampering_hit() -> Hit:
    sev = F.when(F.col("action") == "log.cleared", 4).otherwise(3)
    return Hit(F.expr("category = 'agent' AND action IN ('log.cleared', 'log.truncated')"), "log_tampering", F.coalesce("target", F.lit("")), sev, F.concat(F.lit("Audit log tampering: "), "message"))


def log_tampering(events: DataFrame) -> DataFrame:
    return log_tampering_hit().of(events)


@dataclass(frozen=True)
class CustomRule:
    """Every field that is not empty must match, with wildcards and in any case."""

    id: str
    severity: str = "medium"
    description: str = ""
    action: str = ""
    user: str = ""
    src_ip: str = ""
    target: str = ""
    command: str = ""
    process: str = ""
    notify: bool = True


@dataclass(frozen=True)
class Suppression:
    rule: str = ""
    user: str = ""
    src_ip: str = ""
    target: str = ""
    command: str = ""
    process: str = ""
    parent: str = ""
    reason: str = ""


FIELD_COLUMNS = {"action": "action", "user": "user", "src_ip": "src_ip", "target": "target", "command": "command_line", "process": "process_name", "parent": "parent_name", "rule": "rule"}


def matches(patterns: dict[str, str], rule: Column | None = None) -> Column:
    """All non-empty patterns match; a null value matches none. rule: where it is no column of that name."""
    value = lambda k: rule if k == "rule" and rule is not None else F.col(FIELD_COLUMNS[k])
    hits = [F.coalesce(wildcard_match(value(k), p, True), F.lit(False)) for k, p in patterns.items() if p]
    return reduce(lambda a, b: a & b, hits, F.lit(True))


def _fields(x: CustomRule | Suppression, names: tuple[str, ...]) -> dict[str, str]:
    return {n: getattr(x, n) for n in names}


CUSTOM_FIELDS = ("action", "user", "src_ip", "target", "command", "process")
SUPPRESS_FIELDS = ("rule", "user", "src_ip", "target", "command", "process", "parent")


def _custom_hits(rules: list[CustomRule]) -> Column:
    """The rules that an event matches, as an array; rules without an id or with no field are ignored."""
    used = [r for r in rules if r.id and any(_fields(r, CUSTOM_FIELDS).values())]
    none = F.lit(None).cast("struct<rule:string,severity:int,title:string,notify:boolean>")
    hits = [
        F.when(matches(_fields(r, CUSTOM_FIELDS)), F.struct(F.lit(f"custom.{r.id}").alias("rule"), F.lit(SEVERITY_ALIASES.get(r.severity.lower(), 2)).alias("severity"), F.lit(r.description or r.id).alias("title"), F.lit(r.notify).alias("notify")))
        for r in used
    ] or [none]
    return F.filter(F.array(*hits), lambda h: h.isNotNull())


def _custom_key() -> Column:
    return F.concat_ws("|", "action", F.coalesce("target", F.lit("")), F.coalesce("command_line", F.lit("")))


def custom_rules(events: DataFrame, rules: list[CustomRule]) -> DataFrame:
    """Candidates of all rules at once."""
    e = events.filter("category <> 'alert'").withColumn("_hit", F.explode(_custom_hits(rules)))
    title = F.concat(F.col("_hit.title"), F.lit(": "), "message")
    return _alerts(e, F.col("_hit.rule"), _custom_key(), F.col("_hit.severity"), title).withColumn("notify", F.col("_hit.notify")).drop("_hit")


GRAM = 3
SALT = 32  # for rules that nothing tells apart
_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _plain(c: Column) -> Column:
    """ASCII letters lower-cased, as wildcards compare them."""
    return F.translate(F.coalesce(c, F.lit("")), _ASCII, _ASCII.lower())


def _grams(text: Column) -> Column:
    return F.array_distinct(F.when(F.length(text) >= GRAM, F.transform(F.sequence(F.lit(1), F.length(text) - (GRAM - 1)), lambda i: F.substring(text, i, F.lit(GRAM)))).otherwise(F.array().cast("array<string>")))


def _entry(field: str, kind: str, choice: int, text: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), F.lit(choice).alias("choice"), text.alias("text"))


def _gram_entry(field: str) -> Callable[[Column], Column]:
    return lambda g: _entry(field, "gram", 1, g)


def _asks(field: str, kind: str, texts: Column) -> Column:
    return F.transform(texts, lambda t: F.struct(F.lit(field).alias("_field"), F.lit(kind).alias("_kind"), t.alias("_text"), F.lit(0).alias("_salt")))


def rule_keys(rules: DataFrame) -> DataFrame:
    """rules (rule_id, p_* columns) with the one key an event must have to be looked at: _field, _kind and _text.

    whole: the text of a field without wildcards. gram: of the fragments between wildcards of all fields the three
    letters in a row that fewest rules share. head and tail: up to two letters before the first or after the last
    wildcard. any: nothing of these, so every event is looked at, in SALT groups."""
    r, found = rules.withColumn("_place", F.monotonically_increasing_id()), []
    for c in CUSTOM_FIELDS:
        p = _plain(F.col(f"p_{c}"))
        fragments = F.split(p, r"[*?]+", -1)
        plain = ~p.rlike(r"[*?]")
        entry = partial(_entry, c)
        head, tail = F.element_at(fragments, 1), F.element_at(fragments, -1)
        whole = F.when(plain, F.array(entry("whole", 0, p))).otherwise(F.transform(F.flatten(F.transform(fragments, _grams)), _gram_entry(c)))
        short = F.filter(F.array(F.when(~plain & (F.length(head) > 0), entry("head", 2, F.substring(head, 1, 2))), F.when(~plain & (F.length(tail) > 0), entry("tail", 2, F.right(tail, F.lit(2))))), lambda x: x.isNotNull())
        found.append(F.when(p != "", F.concat(whole, short)).otherwise(F.array().cast("array<struct<field:string,kind:string,choice:int,text:string>>")))
    every = F.concat(F.concat(*found), F.array(F.struct(F.lit("").alias("field"), F.lit("any").alias("kind"), F.lit(3).alias("choice"), F.lit("").alias("text"))))
    keys = r.select("*", F.explode(every).alias("_k"))
    shared = keys.groupBy("_k").agg(F.count("*").alias("_shared"))
    best = F.min_by("_k", F.struct(F.col("_k.choice"), F.col("_shared"), F.col("_k.field"), F.col("_k.text")))
    own = keys.select("_place", "_k").join(shared, "_k").groupBy("_place").agg(best.alias("_k"))
    return r.join(own, "_place").drop("_place").select(*rules.columns, F.col("_k.field").alias("_field"), F.col("_k.kind").alias("_kind"), F.col("_k.text").alias("_text"))


def custom_rules_join(events: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for rules in a table: id, severity (a rank) and the six pattern columns.

    An event is looked at by the rules whose key it has (`rule_keys`), an equality; all fields are compared then. Spark
    broadcasts the rules where they are small and else shuffles both sides by key. Rows without an id or a pattern, and
    events that are alerts, say nothing."""
    r = rules.select(F.col("id").alias("rule_id"), F.col("severity").alias("rule_severity"), *[F.col(c).alias(f"p_{c}") for c in CUSTOM_FIELDS])
    r = r.filter((F.coalesce("rule_id", F.lit("")) != "") & (F.concat_ws("", *[f"p_{c}" for c in CUSTOM_FIELDS]) != ""))
    keyed = rule_keys(r)
    used = {(x[0], x[1]) for x in keyed.select("_field", "_kind").distinct().collect()}  # at most four kinds of each field, and `any`
    ways: list[Column] = []
    for c in CUSTOM_FIELDS:
        text = _plain(F.col(FIELD_COLUMNS[c]))
        each = {"whole": F.array(text), "gram": _grams(text), "head": F.array(F.substring(text, 1, 2), F.substring(text, 1, 1)), "tail": F.array(F.right(text, F.lit(2)), F.right(text, F.lit(1)))}
        for kind in ("whole", "gram", "head", "tail"):
            if (c, kind) in used:
                own = _asks(c, kind, F.array_distinct(each[kind]))
                ways.append(F.when(F.col(FIELD_COLUMNS[c]).isNotNull(), own).otherwise(F.slice(own, 1, 0)))
    if ("", "any") in used:
        ways.append(F.array(F.struct(F.lit("").alias("_field"), F.lit("any").alias("_kind"), F.lit("").alias("_text"), F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int").alias("_salt"))))
    salts = F.when(F.col("_kind") == "any", F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
    keyed = keyed.withColumn("_salt", F.explode(salts))

    def hit(c: str) -> Column:
        return (F.coalesce(f"p_{c}", F.lit("")) == "") | F.coalesce(wildcard_match_column(F.col(FIELD_COLUMNS[c]), F.col(f"p_{c}"), True), F.lit(False))

    none = F.array().cast("array<struct<_field:string,_kind:string,_text:string,_salt:int>>")
    e = events.filter("category <> 'alert'").select("*", F.inline(F.concat(none, *ways)))
    keys = ["_field", "_kind", "_text", "_salt"]
    return e.join(keyed, keys).filter(reduce(lambda x, y: x & y, map(hit, CUSTOM_FIELDS))).drop(*keys, *[f"p_{c}" for c in CUSTOM_FIELDS])


def suppressed(suppressions: list[Suppression], rule: Column | None = None) -> Column:
    return reduce(lambda a, b: a | b, [matches(_fields(s, SUPPRESS_FIELDS), rule) for s in suppressions], F.lit(False))


def with_rule_columns(events: DataFrame) -> DataFrame:
    """events with the columns that some rules need and events may lack, as nulls."""
    return events.withColumns({c: F.lit(None).cast("string") for c in ("protocol", "group", "member", "reason") if c not in events.columns})


HIT = "array<struct<rule:string,cooldown_key:string,severity:int,title:string,notify:boolean>>"
HELPERS = ("_sensitive", "_command")


def hits_of_each(events: DataFrame, s: Settings = Settings(), custom: list[CustomRule] | None = None) -> tuple[DataFrame, Column]:
    """events with HELPERS, and as an array (HIT) what the rules that look at one event alone say of each.

    An event meets all rules in one projection; a command meets its patterns one by one only if it meets the one
    expression of all of them."""
    events = with_rule_columns(events)
    hits = [privilege_failure_hit(events.columns), service_installed_hit(), scheduled_task_hit()]
    hits += [off_hours_hit(s)] if s.business_hours else []
    hits += [privileged_login_hit()] if s.privileged_login else []
    hits += [webserver_shell_hit()] if s.webserver_shell else []
    hits += [account_change_hit()] if s.account_changes else []
    hits += [log_tampering_hit()] if s.log_tampering else []
    severity = F.when(F.col("category") == "file", sensitive_severity(F.col("target"))) if s.sensitive_files else F.lit(None).cast("int")
    command = F.when(_runs() & any_command_match(F.col("command_line")), command_match(F.col("command_line"))) if s.suspicious_commands else F.lit(None).cast("struct<rule:string,severity:int>")
    events = events.withColumns({"_sensitive": severity, "_command": command})
    if s.sensitive_files:
        hits.append(Hit(F.col("_sensitive").isNotNull(), "sensitive_file", _sensitive_key(), F.col("_sensitive"), sensitive_title()))
    if s.suspicious_commands:
        hits.append(Hit(F.col("_command").isNotNull(), F.col("_command.rule"), _command_key(), F.col("_command.severity"), _command_title(F.col("_command.rule"))))
    found = F.filter(F.array(*[h.entry() for h in hits]), lambda h: h.isNotNull())
    if custom:
        own = F.when(F.col("category") != "alert", _custom_hits(custom))
        told = lambda h: F.struct(h["rule"].alias("rule"), _custom_key().alias("cooldown_key"), h["severity"].alias("severity"), F.concat(h["title"], F.lit(": "), "message").alias("title"), h["notify"].alias("notify"))
        found = F.concat(found, F.coalesce(F.transform(own, told), F.array().cast(HIT)))
    return events, found


def single_event_hits(events: DataFrame, s: Settings = Settings(), custom: list[CustomRule] | None = None) -> DataFrame:
    """What the rules that look at one event alone alert on, found in one pass over the events."""
    events, found = hits_of_each(events, s, custom)
    out = events.withColumn("_found", F.explode(found)).withColumn("trigger_action", F.col("action"))
    return out.withColumns({c: F.col(f"_found.{c}") for c in ("rule", "cooldown_key", "severity", "title", "notify")}).drop("_found", *HELPERS)


def candidates(events: DataFrame, s: Settings = Settings(), custom: list[CustomRule] | None = None, suppress: list[Suppression] | None = None) -> DataFrame:
    """What every rule would alert on, less the suppressed, before cooldowns."""
    events = with_rule_columns(events)
    keep = [*events.columns, "trigger_action", "rule", "cooldown_key", "title"]
    found = [password_spray(events, s), brute_force(events, s), success_after_failures(events, s), *([new_source(events, s)] if s.new_source else [])]
    found = [f.select(*keep, F.lit(None).cast("boolean").alias("notify")) for f in found]
    every = reduce(DataFrame.unionByName, [single_event_hits(events, s, custom).select(*keep, "notify"), *found])
    return every.filter(~suppressed(suppress)) if suppress else every


def evaluate(events: DataFrame, s: Settings = Settings(), custom: list[CustomRule] | None = None, suppress: list[Suppression] | None = None) -> DataFrame:
    """All alerts of a batch of events: the candidates that their cooldowns let fire."""
    return with_cooldown(candidates(events, s, custom, suppress), ["rule", "cooldown_key"], s.cooldown_seconds)


def alert_events(fired: DataFrame) -> DataFrame:
    """Alerts as events: category alert, the rule in the action, who and where as on the event that caused them."""
    out = fired.withColumn("trigger_event_id", F.col("id"))
    out = out.withColumns({"category": F.lit("alert"), "action": F.concat(F.lit("alert."), "rule"), "outcome": F.lit("unknown"), "message": F.col("title")})
    details = F.to_json(F.struct("rule", "trigger_action", "trigger_event_id", *(["notify"] if "notify" in fired.columns else [])))
    return out.withColumn("details", details).drop("title", "cooldown_key", "notify")


def notify_gate(alerts: DataFrame, minimum: int) -> DataFrame:
    """Alerts that are sent on: severe enough, and not marked notify=false."""
    quiet = F.coalesce(F.get_json_object("details", "$.notify") == "false", F.lit(False))
    return alerts.filter((F.col("category") == "alert") & ~quiet & (F.col("severity") >= minimum))
