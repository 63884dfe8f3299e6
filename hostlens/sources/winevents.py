"""Windows event XML: reading, and mapping to audit events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import basename, is_meaningful_ip
from ..schema import EVENT
from .authlog import sshd_event
from .build import event, events_of, keys, prefixed

# Providers, status codes and account names of the system.
SECURITY, EVENTLOG, SERVICES = "Microsoft-Windows-Security-Auditing", "Microsoft-Windows-Eventlog", "Service Control Manager"
TERMINAL, OPENSSH, MSI = "Microsoft-Windows-TerminalServices-LocalSessionManager", "OpenSSH", "MsiInstaller"
STATUS = {
    "0xc000006a": "wrong password",
    "0xc0000064": "no such user",
    "0xc0000234": "account locked out",
    "0xc0000072": "account disabled",
    "0xc000006f": "outside allowed hours",
    "0xc0000070": "workstation restriction",
    "0xc0000071": "password expired",
    "0xc0000193": "account expired",
    "0xc0000224": "password must change",
    "0xc000015b": "logon type not granted",
    "": "unknown",
}
SERVICE_USERS = ("SYSTEM", "LOCAL SERVICE", "NETWORK SERVICE", "ANONYMOUS LOGON")
SERVICE_DOMAINS = ("NT AUTHORITY", "WINDOW MANAGER", "FONT DRIVER HOST", "NT SERVICE")
ACCOUNT_EVENTS = {
    4720: ("account.user_created", "created"),
    4722: ("account.user_enabled", "enabled"),
    4725: ("account.user_disabled", "disabled"),
    4726: ("account.user_deleted", "deleted"),
    4723: ("account.password_changed", "password changed"),
    4724: ("account.password_reset", "password reset"),
    4740: ("account.locked_out", "locked out"),
}

_VALUE = "STRUCT<_Name: STRING, _VALUE: STRING>"
XML = (
    "System STRUCT<Provider: STRUCT<_Name: STRING>, EventID: STRING, EventRecordID: BIGINT, TimeCreated: STRUCT<_SystemTime: STRING>, "
    "Execution: STRUCT<_ProcessID: BIGINT>, Channel: STRING>, "
    f"EventData STRUCT<Data: ARRAY<{_VALUE}>>, UserData STRING"
)


def read_event_xml(texts: DataFrame, column: str = "xml") -> DataFrame:
    """Texts with one or many `<Event>` elements -> provider, event_id, record_id, ts, pid, channel, data, unnamed.

    Elements are cut out of the text first, so a text that breaks off keeps the events before the break.
    """
    each = texts.select(F.explode(F.regexp_extract_all(column, F.lit(r"(?s)<Event[\s>].*?</Event>"), F.lit(0))).alias("_xml"))
    plain = F.regexp_replace("_xml", r"\sxmlns(?::\w+)?=(?:'[^']*'|\"[^\"]*\")", "")
    # Exploded out of an array of one, so that what follows reads each element's XML once.
    e = each.select(plain.alias("_xml")).select("_xml", F.explode(F.array(F.from_xml("_xml", XML, {"rowTag": "Event", "valueTag": "_VALUE"}))).alias("e"))
    s = F.col("e.System")
    named = F.filter("e.EventData.Data", lambda d: d["_Name"].isNotNull())
    data = F.map_from_entries(F.transform(F.array_distinct(F.transform(named, lambda d: d["_Name"])), lambda n: F.struct(n.alias("key"), F.coalesce(F.element_at(F.filter(named, lambda d: d["_Name"] == n), -1)["_VALUE"], F.lit("")).alias("value"))))
    leaves = F.regexp_extract_all(F.regexp_extract("_xml", r"(?s)<UserData>(.*)</UserData>", 1), F.lit(r"<(\w+)(?:\s[^>]*)?>[^<>]*</\1>"), F.lit(0))
    user = F.map_from_entries(F.transform(F.array_distinct(F.transform(leaves, lambda x: F.regexp_extract(x, r"^<(\w+)", 1))), lambda n: F.struct(n.alias("key"), unescape(F.regexp_extract(F.element_at(F.filter(leaves, lambda x: F.regexp_extract(x, r"^<(\w+)", 1) == n), -1), r"(?s)>([^<]*)<", 1)).alias("value"))))
    unnamed = F.transform(F.filter("e.EventData.Data", lambda d: d["_Name"].isNull()), lambda d: F.coalesce(d["_VALUE"], F.lit("")))
    empty = F.create_map().cast("map<string,string>")
    out = e.select(
        s["Provider"]["_Name"].alias("provider"),
        s["EventID"].try_cast("int").alias("event_id"),
        s["EventRecordID"].alias("record_id"),
        F.try_to_timestamp(s["TimeCreated"]["_SystemTime"]).alias("event_ts"),
        s["Execution"]["_ProcessID"].alias("event_pid"),
        s["Channel"].alias("channel"),
        F.coalesce(F.when(F.size(leaves) > 0, user), data, empty).alias("data"),
        F.coalesce(unnamed, F.expr("array()").cast("array<string>")).alias("unnamed"),
    )
    return out.filter("provider IS NOT NULL AND event_id IS NOT NULL")


def unescape(c: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#13;", "\r"), ("&#10;", "\n"), ("&#9;", "\t"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def value(name: str) -> Column:
    return F.coalesce(F.try_element_at("data", F.lit(name)), F.lit(""))


def is_service_account(domain: Column, user: Column) -> Column:
    u = F.upper(user)
    return (user == "") | (user == "-") | F.endswith(user, F.lit("$")) | u.isin(*SERVICE_USERS) | u.rlike("^(?:DWM|UMFD)-") | F.upper(domain).isin(*SERVICE_DOMAINS)


def full_user(domain: Column, user: Column) -> Column:
    return F.when((domain == "") | (domain == "-"), user).otherwise(F.concat(domain, F.lit("\\"), user))


def hex_number(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.rlike("^0[xX][0-9A-Fa-f]{1,8}$"), F.conv(F.substring(t, 3, 8), 16, 10).cast("long")).when(t.rlike("^[0-9]{1,10}$"), t.cast("long"))


def logon_key(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(~t.isin("", "0x0", "-"), prefixed("logon", t))


def failure_reason(status: Column, sub: Column) -> Column:
    code = F.lower(F.when((sub == "") | (sub == "0x0"), status).otherwise(sub))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), code), F.concat(F.lit("status "), code))


def _one(*branches: tuple[Column, Column]) -> Column:
    return reduce(lambda w, b: w.when(*b), branches[1:], F.when(*branches[0]))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def security_event(event_id: Column, self_pid: int) -> Column:
    subject = full_user(value("SubjectDomainName"), value("SubjectUserName"))
    target = full_user(value("TargetDomainName"), value("TargetUserName"))
    by = F.when(~is_service_account(value("SubjectDomainName"), value("SubjectUserName")), subject)
    by_key = logon_key(value("SubjectLogonId"))
    ip, kind, package = value("IpAddress"), F.coalesce(value("LogonType").try_cast("int"), F.lit(0)), value("AuthenticationPackageName")
    remote = F.when(is_meaningful_ip(ip), ip)

    own = F.array_distinct(keys(logon_key(value("TargetLogonId")), logon_key(value("TargetLinkedLogonId"))))
    desk = kind.isin(2, 10, 11, 12) & (F.lower(F.trim(value("LogonProcessName"))) == "user32")
    protocol = F.when(kind == 7, "console").when(kind.isin(10, 12), "rdp").when(kind.isin(3, 8), "network").otherwise("console")
    action = F.when(desk, "session.start").when(kind == 7, "auth.unlock").otherwise("auth.success")
    text = F.when(desk & (protocol == "rdp"), _text(target, " logged in via RDP from ", ip)).when(desk, _text(target, " logged in on the console")).when(kind == 7, _text(target, " unlocked the workstation"))
    text = text.otherwise(_text(target, " authenticated over the network from ", ip, " (", package, ")"))
    station = F.when(~value("WorkstationName").isin("", "-"), value("WorkstationName"))
    logon = event(
        F.when(desk, "session").otherwise("auth"), action, text, outcome="success", user=target, src_ip=remote, keys=own,
        details={
            "protocol": protocol, "logon_type": kind, "auth_method": package, "src_port": F.when(remote.isNotNull(), value("IpPort").try_cast("int")), "workstation": station,
            "elevated_token": F.when(F.contains(value("ElevatedToken"), F.lit("1842")), F.lit("true")),
        },
    )
    logon = F.when(~is_service_account(value("TargetDomainName"), value("TargetUserName")) & (desk | (kind == 7) | (kind.isin(3, 8) & remote.isNotNull())), logon)

    why = failure_reason(value("Status"), value("SubStatus"))
    over = F.when(kind.isin(10, 12), "rdp").when(kind.isin(2, 11), "console").otherwise("network")
    failed = event(
        "auth", "auth.failure", _text("Failed ", over, " logon for ", target, F.coalesce(_text(" from ", remote), F.lit("")), " (", why, ")"), outcome="failure", user=target, src_ip=remote,
        details={"protocol": over, "logon_type": kind, "reason": why, "workstation": value("WorkstationName")},
    )

    off_key = logon_key(value("TargetLogonId"))
    off = F.when(off_key.isNotNull(), event("session", "session.end", _text(target, " logged off"), keys=keys(off_key)))

    creator, pid, path, command = hex_number(value("ProcessId")), F.coalesce(hex_number(value("NewProcessId")), F.lit(0)), value("NewProcessName"), value("CommandLine")
    run = event(
        "process", "process.start", F.when(command == "", path).otherwise(command), outcome="success", user=by,
        process={"pid": pid, "ppid": creator, "name": basename(path), "exe": path, "command_line": F.nullif(command, F.lit("")), "parent_name": F.nullif(basename(value("ParentProcessName")), F.lit("")), "run_as": subject},
        keys=keys(by_key, logon_key(value("TargetLogonId")), prefixed("pid", creator)), learn=keys(prefixed("pid", pid)),
    )
    run = F.when(~F.coalesce(creator == self_pid, F.lit(False)), run)

    accounts = []
    for number, (name, verb) in ACCOUNT_EVENTS.items():
        locked = number == 4740
        said = _text("User account ", target, " locked out (caller: ", value("TargetDomainName"), ")") if locked else _text("User account ", target, f" {verb} by ", subject)
        accounts.append((event_id == number, event("account", name, said, outcome="success", severity=int(locked), user=by, target=target, keys=keys(by_key))))

    group = value("TargetUserName")
    dn = value("MemberName")
    member = F.when(dn.isin("", "-"), value("MemberSid")).otherwise(F.regexp_replace(F.element_at(F.split(dn, ","), 1), "^(?:CN=)+", ""))
    added = event("account", "account.group_member_added", _text(member, " added to group ", group, " by ", subject), outcome="success", user=by, target=member, keys=keys(by_key), details={"group": group, "member": member})
    task = event("service", "persistence.scheduled_task", _text("Scheduled task created: ", value("TaskName"), " by ", subject), outcome="success", user=by, target=value("TaskName"), keys=keys(by_key))
    return _one((event_id == 4624, logon), (event_id == 4625, failed), (event_id.isin(4634, 4647), off), (event_id == 4688, run), *accounts, (event_id.isin(4728, 4732, 4756), added), (event_id == 4698, task))


def terminal_event(event_id: Column) -> Column:
    session, user, address = value("SessionID"), value("User"), value("Address")
    remote = F.when(is_meaningful_ip(address), address)
    protocol = F.when(remote.isNotNull(), "rdp").otherwise("console")
    own = {"user": user, "src_ip": remote, "keys": keys(prefixed("ts", session))}
    both = {"ts_session": session}
    start = event("session", "session.start", F.when(remote.isNotNull(), _text(user, " logged in via RDP from ", address)).otherwise(_text(user, " logged in on the console")), outcome="success", details={"protocol": protocol, **both}, **own)
    end = event("session", "session.end", _text(user, " logged off"), details=both, **own)
    away = event("session", "session.disconnect", _text(user, " disconnected", F.coalesce(_text(" (from ", remote, ")"), F.lit(""))), details=both, **own)
    back = event("session", "session.reconnect", _text(user, " reconnected", F.coalesce(_text(" from ", remote), F.lit(""))), details={"protocol": protocol, **both}, **own)
    return F.when(~session.isin("", "0"), _one((event_id == 21, start), (event_id == 23, end), (event_id == 24, away), (event_id == 25, back)))


def map_events(raw: DataFrame, self_pid: int = -1) -> DataFrame:
    """read_event_xml() rows as audit events; what is not known or of no interest is dropped."""
    p, n = F.col("provider"), F.col("event_id")
    who = full_user(value("SubjectDomainName"), value("SubjectUserName"))
    cleared = event("agent", "log.cleared", _text("Windows Security log was cleared by ", who), severity=3, user=who, target=F.lit("Security"))
    cleared_other = event("agent", "log.cleared", _text("Windows event log '", value("Channel"), "' was cleared by ", who), severity=3, user=who, target=value("Channel"))
    service = event(
        "service", "service.installed", _text("Service installed: ", value("ServiceName"), " (", value("ImagePath"), ")"), outcome="success", target=value("ServiceName"),
        details={"image_path": value("ImagePath"), "start_type": value("StartType"), "account": value("AccountName")},
    )
    at = lambda k: F.coalesce(F.get("unnamed", F.lit(k)), F.lit(""))
    status = at(3)
    msi = event(
        "package", F.when(n == 1033, "package.installed").otherwise("package.removed"), F.concat_ws(" ", F.when(n == 1033, "Installed").otherwise("Removed"), at(0), at(1)),
        outcome=F.when(status == "0", "success").otherwise("failure"), target=at(0), details={"version": at(1), "status": status},
    )
    found = _one(
        (p == SECURITY, security_event(n, self_pid)), ((p == EVENTLOG) & (n == 1102), cleared), ((p == EVENTLOG) & (n == 104), cleared_other), ((p == SERVICES) & (n == 7045), service),
        (p == TERMINAL, terminal_event(n)), ((p == MSI) & n.isin(1033, 1034), msi),
    )
    note = F.create_map(F.lit("win_event_id"), n.cast("string"))
    # What the SSH service says is an ordinary log message.
    payload = F.coalesce(F.try_element_at("data", F.lit("payload")), F.element_at(F.concat(F.array(F.lit("")), "unnamed"), -1))
    ssh = p == OPENSSH
    said = raw.filter(p.isin(SECURITY, EVENTLOG, SERVICES, TERMINAL, MSI, OPENSSH)).withColumn("_msg", F.when(ssh, F.regexp_replace(payload, r"^sshd\S*?: ", "")))
    found = F.when(ssh, sshd_event(F.trim("_msg"))).otherwise(found)
    out = events_of(said, found, F.col("event_ts"), F.when(ssh, keys(prefixed("pid", F.col("event_pid")))), F.when(~ssh, note))
    return out.select(*EVENT.fieldNames())
