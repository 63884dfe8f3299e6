"""System and authentication logs: lines to events, as projections over a text source.

`read_auth_log(spark.read.text(path))` keeps the scan, the parsing and the filter in one stage.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import tty_key
from .build import event, events_of, group, keys, once, prefixed

# The messages of login services.
ACCEPTED = r"^Accepted (\S+) for (\S+) from (\S+) port ([0-9]+)(?: ssh2)?(?:: (\S+) (\S+))?"
FAILED = r"^Failed (\S+) for (invalid user )?(\S*) from (\S+) port ([0-9]+)"
INVALID = r"^Invalid user (.*?) from (\S+?)(?: port ([0-9]+))?$"
MAX_AUTH = r"^(?:error: )?maximum authentication attempts exceeded for (?:invalid user )?(\S+) from (\S+)"
DISCONNECTED = r"^Disconnected from user (\S+) (\S+) port ([0-9]+)"
PAM_SESSION = r"(?U)^pam_unix\(([\w-]+):session\): session (opened|closed) for user ([^\s(]+)(?:\(uid=[0-9]+\))?(?: by ([^\s(]*)(?:\(uid=[0-9]+\))?)?"
PAM_FAILURE = r"(?U)^pam_unix\(([\w-]+):auth\): authentication failure;.*?\bruser=(\S*).*?\buser=(\S+)"
SUDO = r"^\s*(\S+) : (?:([^;]*?) ; )?TTY=(\S+) ; PWD=(.*?) ; USER=(\S+) ;(?: [A-Z]+=\S* ;)*? COMMAND=(.*)$"
PASSWORD_CHANGED = r"^pam_unix\((?:passwd|chpasswd):chauthtok\): password changed for (\S+)"
NEW_USER = r"^new user: name=([^,]+), UID=([0-9]+)(?:.*?from=(\S+))?"
NEW_GROUP = r"^new group: name=([^,]+), GID=([0-9]+)"
DELETED_USER = r"^delete user '([^']+)'"
GROUP_ADD = r"^add '([^']+)' to group '([^']+)'"
MEMBER_ADD = r"^user (\S+) added by (\S+) to group (\S+)"

RFC_STAMP = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:[Zz]|[+-][0-9]{2}:[0-9]{2})) (.*)$"
BSD_STAMP = r"^([A-Z][a-z]{2} [ 0-9][0-9] [0-9]{2}:[0-9]{2}:[0-9]{2})(.*)$"


def syslog_lines(lines: DataFrame, now: Column, zone: str = "UTC", column: str = "value") -> DataFrame:
    """lines with ts, ident, tag_pid and msg; lines of neither form are dropped.

    A stamp without a year is of the year of `now`, or of the year before if that were over a day ahead.
    """
    found = once(lines, _line=F.regexp_replace(column, r"[\r\n]+$", ""))
    line, rfc, bsd = (F.col(c) for c in ("_line", "_rfc", "_bsd"))
    found = once(found, _rfc=group(line, RFC_STAMP, 1), _bsd=group(line, BSD_STAMP, 1))
    padded = F.regexp_replace(bsd, r"^(\w{3})\s+([0-9])\b(?![0-9])", "$1 0$2")

    def at(year: Column) -> Column:
        return F.when(bsd.isNotNull(), F.to_utc_timestamp(F.try_to_timestamp(F.concat_ws(" ", year.cast("string"), padded), F.lit("yyyy MMM dd HH:mm:ss")), zone))

    this = at(F.year(F.from_utc_timestamp(now, zone)))
    old = F.when(this > now + F.expr("INTERVAL 1 DAY"), at(F.year(F.from_utc_timestamp(now, zone)) - 1)).otherwise(this)
    rest = F.ltrim(F.when(rfc.isNotNull(), F.regexp_extract(line, RFC_STAMP, 2)).otherwise(F.regexp_extract(line, BSD_STAMP, 2)))
    found = once(found, _at=F.coalesce(F.try_to_timestamp(rfc), old), _rest=rest)
    parts = r"^(\S+) (.*?): (.*)$"
    found = once(found, _tag=group(F.col("_rest"), parts, 2), _msg=F.regexp_extract("_rest", parts, 3))
    tag = F.col("_tag")
    out = found.withColumns({"ts": F.col("_at"), "ident": ident_of(tag), "tag_pid": pid_of(tag), "msg": F.col("_msg")})
    return out.filter("_at IS NOT NULL AND _tag IS NOT NULL").drop("_line", "_rfc", "_bsd", "_at", "_rest", "_tag", "_msg")


def ident_of(tag: Column) -> Column:
    """`/usr/sbin/sshd[12]` -> sshd"""
    return F.element_at(F.split(F.element_at(F.split(tag, r"\["), 1), "/"), -1)


def pid_of(tag: Column) -> Column:
    return F.regexp_extract(tag, r"\[([0-9]{1,10})\]*$", 1).try_cast("long")


def _first(*branches: tuple[Column, Column]) -> Column:
    """The value of the first branch whose condition holds."""
    return reduce(lambda w, b: w.when(*b), branches[1:], F.when(*branches[0]))


def sshd_event(m: Column) -> Column:
    g = lambda p, n: group(m, p, n)
    method, user, ip, port = (g(ACCEPTED, k) for k in (1, 2, 3, 4))
    login = event(
        "session", "session.start", F.concat(user, F.lit(" logged in via SSH from "), ip, F.lit(" ("), method, F.lit(")")), outcome="success", user=user, src_ip=ip,
        details={"protocol": F.lit("ssh"), "auth_method": method, "src_port": port, "key_type": g(ACCEPTED, 5), "key_fingerprint": g(ACCEPTED, 6)},
    )
    fuser, fip = F.regexp_extract(m, FAILED, 3), g(FAILED, 4)
    failed = event("auth", "auth.failure", F.concat(F.lit("Failed SSH "), g(FAILED, 1), F.lit(" for "), fuser, F.lit(" from "), fip), outcome="failure", user=fuser, src_ip=fip, details={"protocol": F.lit("ssh"), "auth_method": g(FAILED, 1)})
    iuser, iip = F.regexp_extract(m, INVALID, 1), g(INVALID, 2)
    invalid = event("auth", "auth.failure", F.concat(F.lit("SSH login attempt for nonexistent user '"), iuser, F.lit("' from "), iip), outcome="failure", user=iuser, src_ip=iip, details={"protocol": F.lit("ssh"), "reason": F.lit("invalid user")})
    locked = event("auth", "auth.lockout", F.concat(F.lit("Too many SSH authentication attempts for "), g(MAX_AUTH, 1), F.lit(" from "), g(MAX_AUTH, 2)), outcome="failure", severity=1, user=g(MAX_AUTH, 1), src_ip=g(MAX_AUTH, 2), details={"protocol": F.lit("ssh")})
    left = event("session", "session.end", F.concat(g(DISCONNECTED, 1), F.lit(" disconnected (SSH)")), user=g(DISCONNECTED, 1), src_ip=g(DISCONNECTED, 2))
    closed = event("session", "session.end", F.concat(F.lit("SSH session closed for "), g(PAM_SESSION, 3)), user=g(PAM_SESSION, 3))
    # A failed login of an invalid user follows a line that has been counted already.
    skip = F.lit(None).cast(login_type())
    return _first(
        (m.rlike(ACCEPTED), login), (m.rlike(FAILED) & g(FAILED, 2).isNotNull(), skip), (m.rlike(FAILED), failed), (m.rlike(INVALID), invalid), (m.rlike(MAX_AUTH), locked), (m.rlike(DISCONNECTED), left),
        ((g(PAM_SESSION, 1) == "sshd") & (g(PAM_SESSION, 2) == "closed"), closed),
    )


def login_type() -> str:
    from ..schema import EVENT

    return EVENT.simpleString()


def sudo_event(m: Column, pid: Column) -> Column:
    g = lambda n: group(m, SUDO, n)
    user, why, runas, command = g(1), F.trim(g(2)), g(5), F.trim(F.regexp_extract(m, SUDO, 6))
    text = F.when(why.isNotNull(), F.concat(user, F.lit(" was denied sudo ("), why, F.lit("): "), command)).otherwise(F.concat(user, F.lit(" ran as "), runas, F.lit(": "), command))
    e = event(
        "privilege", "privilege.sudo", text, outcome=F.when(why.isNotNull(), "failure").otherwise("success"), severity=F.when(why.isNotNull(), 1).otherwise(0), user=user,
        details={"run_as": runas, "reason": why}, keys=keys(tty_key(g(3))),
        process={"pid": F.coalesce(pid, F.lit(0)), "name": F.lit("sudo"), "command_line": command, "cwd": g(4), "run_as": runas},
    )
    return F.when(m.rlike(SUDO), e)


def pam_event(m: Column, family: str) -> Column:
    g = lambda n: group(m, PAM_SESSION, n)
    own = g(1).isin("su", "su-l") if family == "su" else g(1) == "login"
    failed = group(m, PAM_FAILURE, 1).isin("su", "su-l") if family == "su" else group(m, PAM_FAILURE, 1) == "login"
    who, target, tty = F.regexp_extract(m, PAM_FAILURE, 2), group(m, PAM_FAILURE, 3), keys(tty_key(group(m, r"(?U)\btty=(\S+)", 1)))
    if family == "su":
        by = F.regexp_extract(m, PAM_SESSION, 4)
        opened = event("privilege", "privilege.su", F.concat(by, F.lit(" switched to "), g(3), F.lit(" (su)")), outcome="success", user=by, details={"run_as": g(3)})
        name = F.when(who == "", "someone").otherwise(who)
        bad = event("privilege", "privilege.su", F.concat(name, F.lit(" failed to su to "), target), outcome="failure", severity=1, user=who, details={"run_as": target, "reason": F.lit("authentication failure")}, keys=tty)
        return _first((own & (g(2) == "opened"), opened), (m.rlike(PAM_SESSION), F.lit(None).cast(login_type())), (failed, bad))
    opened = event("session", "session.start", F.concat(g(3), F.lit(" logged in on the console")), outcome="success", user=g(3), details={"protocol": F.lit("console")})
    closed = event("session", "session.end", F.concat(F.lit("Console session closed for "), g(3)), user=g(3))
    bad = event("auth", "auth.failure", F.concat(F.lit("Failed console login for "), target), outcome="failure", user=target, details={"protocol": F.lit("console")}, keys=tty)
    return _first((own & (g(2) == "opened"), opened), (own, closed), (m.rlike(PAM_SESSION), F.lit(None).cast(login_type())), (failed, bad))


def _account(action: str, text: str, name: Column, **more) -> Column:
    return event("account", action, F.concat(F.lit(text), name), outcome="success", target=name, **more)


def group_add(member: Column, name: Column) -> Column:
    return event("account", "account.group_member_added", F.concat(member, F.lit(" added to group "), name), outcome="success", target=member, details={"group": name, "member": member})


def auth_event(ident: Column, pid: Column, msg: Column) -> Column:
    """One message of a login, privilege or account program as an event; null for anything else."""
    m = F.trim(msg)
    user = group(m, NEW_USER, 1)
    new_user = _account("account.user_created", "User account created: ", user, details={"uid": group(m, NEW_USER, 2)}, keys=keys(tty_key(group(m, NEW_USER, 3))))
    new_group = F.when(m.rlike(NEW_GROUP), _account("account.group_created", "Group created: ", group(m, NEW_GROUP, 1)))
    return _first(
        (ident.isin("sshd", "sshd-session", "sshd.exe"), sshd_event(m)),
        (ident == "sudo", sudo_event(m, pid)),
        (ident == "su", pam_event(m, "su")),
        (ident == "login", pam_event(m, "login")),
        (ident.isin("passwd", "chpasswd"), F.when(m.rlike(PASSWORD_CHANGED), _account("account.password_changed", "Password changed for ", group(m, PASSWORD_CHANGED, 1)))),
        (ident.isin("useradd", "adduser"), F.when(m.rlike(NEW_USER), new_user).otherwise(new_group)),
        (ident == "groupadd", new_group),
        (ident.isin("userdel", "deluser"), F.when(m.rlike(DELETED_USER), _account("account.user_deleted", "User account deleted: ", group(m, DELETED_USER, 1)))),
        (ident == "usermod", F.when(m.rlike(GROUP_ADD), group_add(group(m, GROUP_ADD, 1), group(m, GROUP_ADD, 2)))),
        (ident == "gpasswd", F.when(m.rlike(MEMBER_ADD), group_add(group(m, MEMBER_ADD, 1), group(m, MEMBER_ADD, 3)))),
    )


def auth_events(parsed: DataFrame) -> DataFrame:
    """Events of lines with ts, ident, tag_pid and msg; each has its process as a key."""
    lines = parsed.withColumnRenamed("ts", "_line_ts")
    out = events_of(lines, auth_event(F.col("ident"), F.col("tag_pid"), F.col("msg")), F.col("_line_ts"), keys(prefixed("pid", F.col("tag_pid"))))
    return out.drop("_line_ts", "ident", "tag_pid", "msg")


def choose_source(explicit: str | None, has_journal: bool, root: str = "/") -> str | None:
    """Where a host keeps its authentication log: the given path, else auth.log, secure, the journal, or nothing."""
    if explicit:
        return explicit
    for name in ("var/log/auth.log", "var/log/secure"):
        if os.path.exists(os.path.join(root, name)):
            return os.path.join(root, name)
    return "journal" if has_journal else None


def read_auth_log(lines: DataFrame, now: Column, zone: str = "UTC") -> DataFrame:
    return auth_events(syslog_lines(lines, now, zone))
