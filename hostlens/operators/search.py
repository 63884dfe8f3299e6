"""The search language, and the fixed queries over events and sessions.

A query is a list of terms that must all hold: `field=value`, `field!=value`, `sev>=name` or free text. Double quotes
group and are removed. `*` in a value stands for any run of characters.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import parse_duration
from ..schema import SEVERITY_ALIASES

# The names of fields, and the columns they search.
ALIASES = {
    "user": "user", "u": "user",
    "ip": "src_ip", "src_ip": "src_ip", "src": "src_ip", "source": "src_ip",
    "action": "action", "a": "action",
    "category": "category", "cat": "category",
    "session": "session_id", "session_id": "session_id", "sid": "session_id",
    "target": "target", "path": "target", "file": "target",
    "host": "host",
    "process": "process_name", "proc": "process_name",
    "command": "command_line", "cmd": "command_line",
    "outcome": "outcome",
    "pid": "pid",
    "id": "id",
}
NUMERIC = ("pid", "id")
SEVERITY_FIELDS = ("sev", "severity")
FREE_TEXT = ("message", "command_line", "target")
PROJECTION = (
    "id", "ts", "host", "category", "action", "outcome", "severity", "user", "src_ip", "session_id", "process_name", "command_line", "process", "target", "message", "details", "hash",
)
DEFAULT_LIMIT = 200


class QueryError(ValueError):
    """A query that cannot be read."""


@dataclass
class Query:
    filters: list[tuple[str, str, str]] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    min_severity: int = 0
    since: str | None = None
    until: str | None = None
    limit: int = DEFAULT_LIMIT
    descending: bool = True


def tokens(query: str) -> list[str]:
    out, now, quoted, begun = [], "", False, False
    for c in query:
        if c == '"':
            quoted, begun = not quoted, True
        elif c.isspace() and not quoted:
            if now or begun:
                out.append(now)
            now, begun = "", False
        else:
            now += c
    if quoted:
        raise QueryError("a quote is not closed")
    return [t for t in [*out, now] if t]


def parse(query: str, **more) -> Query:
    """Read a query; `more` sets since, until, limit and descending."""
    q = Query(**more)
    for token in tokens(query):
        op = next((o for o in (">=", "!=", "=") if o in token), None)
        if op is None:
            q.text.append(token)
            continue
        # The first operator in the token counts, the longer one where two begin together.
        at, op = min((token.find(o), -len(o), o) for o in (">=", "!=", "=") if o in token)[::2]
        name, value = token[:at].lower(), token[at + len(op) :]
        if name in SEVERITY_FIELDS:
            rank = SEVERITY_ALIASES.get(value.strip().lower())
            if rank is None:
                raise QueryError(f"unknown severity {value}")
            q.min_severity = rank
        elif op == ">=":
            raise QueryError(f"{name} cannot be compared with >=")
        elif name not in ALIASES:
            raise QueryError(f"unknown field {name}")
        else:
            q.filters.append((ALIASES[name], op, value))
    return q


def field_filter(name: str, op: str, value: str) -> Column:
    c = F.col(name)
    if name in NUMERIC:  # null is neither equal nor unequal, and what is no number equals nothing
        n = F.lit(int(value) if value.lstrip("-").isdigit() else -1)
        return c == n if op == "=" else c != n
    if "*" in value:
        pattern = value.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
        hit = c.ilike(pattern)
    else:
        hit = F.lower(c) == value.lower()
    return hit if op == "=" else c.isNull() | ~hit  # null counts as unequal


def text_filter(text: str, columns: Iterable[str] = FREE_TEXT) -> Column:
    """Whether one of the columns contains the text, in any case."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False)) for c in columns])


def bound(when: str, now: Column | None = None) -> Column:
    """A time: RFC 3339, or a duration before now."""
    ago = parse_duration(when)
    return F.to_timestamp(F.lit(when)) if ago is None else (now if now is not None else F.current_timestamp()) - F.expr(f"INTERVAL {int(ago.total_seconds())} SECONDS")


def conditions(q: Query, now: Column | None = None) -> Column:
    out = [field_filter(*f) for f in q.filters] + [text_filter(t) for t in q.text]
    if q.min_severity:
        out.append(F.col("severity") >= q.min_severity)
    if q.since:
        out.append(F.col("ts") >= bound(q.since, now))
    if q.until:
        out.append(F.col("ts") <= bound(q.until, now))
    return reduce(lambda a, b: a & b, out, F.lit(True))


def search(events: DataFrame, query: str | Query, now: Column | None = None) -> DataFrame:
    """The newest matching events (or the oldest), the projection of the search."""
    q = parse(query) if isinstance(query, str) else query
    order = [F.col("ts").desc(), F.col("id").desc()] if q.descending else [F.col("ts").asc(), F.col("id").asc()]
    return events.filter(conditions(q, now)).orderBy(*order).limit(q.limit).select(*[c for c in PROJECTION if c in events.columns])


def display_order(found: DataFrame) -> DataFrame:
    """A search's newest rows, oldest first."""
    return found.orderBy("ts", "id")


def get_event(events: DataFrame, event_id: int) -> DataFrame:
    return events.filter(F.col("id") == event_id)


def session_events(events: DataFrame, session_id: str, limit: int = 20_000) -> DataFrame:
    return events.filter(F.col("session_id") == session_id).orderBy("ts", "id").limit(limit)


def sessions(found: DataFrame, since: Column | None = None, live: bool = False, user: str | None = None, limit: int = 100) -> DataFrame:
    """Sessions that overlap the time since, newest first; user is part of a name in any case."""
    if since is not None:
        found = found.filter((F.col("start_ts") >= since) | F.col("end_ts").isNull() | (F.col("end_ts") >= since))
    if live:
        found = found.filter(F.col("status") != "ended")
    if user:
        found = found.filter(F.contains(F.lower("user"), F.lit(user.lower())))
    return found.orderBy(F.col("start_ts").desc(), F.col("id").desc()).limit(limit)


def live_sessions(found: DataFrame) -> DataFrame:
    return sessions(found, live=True, limit=10_000)


def changes(events: DataFrame, path: str | None = None, since: str | None = None, limit: int = 200, now: Column | None = None) -> DataFrame:
    """File events whose path contains `path`, or matches it where it has a `*`."""
    q = Query(filters=[("category", "=", "file")], since=since, limit=limit)
    if path:
        q.filters.append(("target", "=", path if "*" in path else f"*{path}*"))
    return search(events, q, now)


def alerts(events: DataFrame, min_severity: str = "low", since: str | None = None, limit: int = 200, now: Column | None = None) -> DataFrame:
    return search(events, Query(filters=[("category", "=", "alert")], min_severity=SEVERITY_ALIASES[min_severity], since=since, limit=limit), now)


def blob_pair(event: DataFrame, blobs: DataFrame) -> DataFrame:
    """Each event with the contents its before and after hashes name."""
    b, a = blobs.select(F.col("sha256").alias("b"), F.col("data").alias("before")), blobs.select(F.col("sha256").alias("a"), F.col("data").alias("after"))
    return event.join(b, event["before_sha"] == b["b"], "left").join(a, event["after_sha"] == a["a"], "left").drop("a", "b")


def event_count(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("events"))
