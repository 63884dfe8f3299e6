"""Scalar functions as Column expressions."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Addresses that name no remote party, and units of durations in seconds.
LOCAL_ADDRESSES = ("", "-", "127.0.0.1", "::1", "0.0.0.0", "::", "LOCAL")
UNITS = {
    1: ("s", "sec", "secs"),
    60: ("m", "min", "mins"),
    3600: ("h", "hr", "hrs"),
    86400: ("d", "day", "days"),
    604800: ("w", "wk", "weeks"),
}
GENESIS = "0" * 64
UNIT_SEPARATOR = chr(31)


def wildcard_regex(pattern: str) -> str:
    """An anchored regular expression for `*` (any run) and `?` (one character)."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.sub(r"([^A-Za-z0-9_\x80-\U0010ffff])", r"\\\1", c) for c in pattern)
    return f"(?s)^{body}$"


def wildcard_match(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    regex = wildcard_regex(pattern)
    return c.rlike(("(?i)" if ignore_case else "") + regex)


def wildcard_match_column(text: Column, pattern: Column, ignore_case: bool = False) -> Column:
    """wildcard_match for a pattern in each row."""
    quoted = F.regexp_replace(pattern, r"([\\.\[\]{}()+^$|\-/])", r"\\$1")
    body = F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))
    return F.rlike(text, F.concat(F.lit("(?is)^" if ignore_case else "(?s)^"), body, F.lit("$")))


def parse_duration(text: str) -> timedelta | None:
    """`90`, `90s`, `15m`, `24h`, `7d`, `2w`; None for anything else."""
    m = re.fullmatch(r"\s*([0-9]+)\s*([a-z]*)\s*", text)
    unit = m and next((k for k, names in UNITS.items() if (m[2] or "s") in names), None)
    return timedelta(seconds=int(m[1]) * unit) if m and unit else None


def duration_seconds(c: Column) -> Column:
    """parse_duration as a column of seconds."""
    t = F.trim(c)
    number = F.try_to_number(F.nullif(F.regexp_extract(t, r"^([0-9]+)\s*[a-z]*$", 1), F.lit("")), F.lit("999999999999")).cast("long")
    unit = F.regexp_extract(t, r"^[0-9]+\s*([a-z]*)$", 1)
    factor = F.when(unit == "", 1)
    for k, names in UNITS.items():
        factor = factor.when(unit.isin(*names), k)
    return number * factor


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def row_hash(previous: Column, columns: list[Column]) -> Column:
    """SHA-256 over the previous hash and the columns, a unit separator before each; null counts as empty."""
    return F.sha2(F.concat_ws(UNIT_SEPARATOR, previous, *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def truncate_bytes(c: Column, most: int) -> Column:
    """At most `most` bytes, cut at a character's edge, and a note of how many bytes are gone."""
    raw = c.cast("binary")
    heads = [F.try_validate_utf8(F.substring(raw, 1, most - k).cast("string")) for k in range(min(4, most + 1))]
    head = F.coalesce(*heads)
    gone = F.octet_length(c) - F.octet_length(head)
    return F.when(F.octet_length(c) <= most, c).otherwise(F.concat(head, F.lit("…[truncated "), gone.cast("string"), F.lit(" bytes]")))


def truncate_plain(c: Column, most: int) -> Column:
    """At most `most` characters, the last an ellipsis if any are gone."""
    return F.when(F.char_length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 1), F.lit("…")))


def pad(c: Column, width: int) -> Column:
    """Truncated or filled with blanks to `width` characters."""
    return F.rpad(truncate_plain(c, width), width, " ")


def is_text(data: Column) -> Column:
    """Valid UTF-8 without a NUL in its first 8,192 bytes."""
    return F.is_valid_utf8(data.cast("string")) & (F.instr(F.hex(F.substring(data, 1, 8192)).cast("string"), "00") == 0) | (
        F.is_valid_utf8(data.cast("string")) & ~F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.octet_length(data), F.lit(8192)))), lambda k: F.hex(F.substring(data, k, F.lit(1))) == "00")
    )


def is_meaningful_ip(c: Column) -> Column:
    return c.isNotNull() & ~c.isin(*LOCAL_ADDRESSES)


def base_user(c: Column) -> Column:
    """Without `DOMAIN\\`, lower case."""
    return F.lower(F.element_at(F.split(c, r"\\"), -1))


def norm_user(c: Column) -> Column:
    return F.lower(F.trim(c))


def mentions_token(command: Column, name: Column) -> Column:
    """Whether name stands in command with a boundary character or the text's edge on both sides."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    edge = r"[\s/\\'\"=<>|;&(),:]"
    return (F.length(name) > 0) & F.rlike(command, F.concat(F.lit(rf"(?:^|(?<={edge}))"), quoted, F.lit(rf"(?:$|(?={edge}))")))


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def _ascii_lower(c: Column) -> Column:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, letters, letters.lower())


def eq_path(a: Column, b: Column, windows: bool = False) -> Column:
    """Whether two paths are one; on Windows the case of ASCII letters does not count."""
    return _ascii_lower(a) == _ascii_lower(b) if windows else a == b


def contains_path(text: Column, path: Column, windows: bool = False) -> Column:
    """Whether a path stands anywhere in a text, as eq_path compares."""
    return F.contains(_ascii_lower(text), _ascii_lower(path)) if windows else F.contains(text, path)


def duration_text(seconds: Column) -> Column:
    """`42s`, `3m 5s`, `2h 10m`."""
    s = seconds.cast("long")
    text = F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm %ds", F.floor(s / 60), s % 60))
    return text.otherwise(F.format_string("%dh %dm", F.floor(s / 3600), F.floor((s % 3600) / 60)))


def format_ts(ts: Column) -> Column:
    """Microseconds and a Z, so that text order is time order (session time zone UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def parse_ts(text: Column) -> Column:
    """RFC 3339; what cannot be read is the epoch."""
    return F.coalesce(F.try_to_timestamp(text), F.timestamp_seconds(F.lit(0)))


def detail(details: Column, name: str) -> Column:
    """A string value of the JSON details."""
    return F.get_json_object(details, f"$.{name}")


def with_detail(details: Column, values: dict[str, Column]) -> Column:
    """JSON details with values set; null values are left out."""
    own = F.from_json(F.coalesce(details, F.lit("{}")), "map<string,string>")
    add = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()]), lambda e: e["value"].isNotNull())
    keep = F.map_filter(own, lambda k, _: ~F.exists(add, lambda e: e["key"] == k))
    return F.to_json(F.map_concat(keep, F.map_from_entries(add)))


def level_for(value: Column, warning: float, critical: float) -> Column:
    return F.when(value >= critical, "critical").when(value >= warning, "warning").otherwise("normal")


def tty_key(tty: Column) -> Column:
    """`tty:NAME`, null for placeholders."""
    t = F.regexp_replace(tty, r"^(?:/dev/)+", "")
    return F.when(~t.isin("", "unknown", "(none)", "none", "ssh"), F.concat(F.lit("tty:"), t))


def within_hours(ts: Column, hours: str, zone: str = "UTC") -> Column:
    """Whether the local time lies in `HH:MM-HH:MM`, both ends included; a range may pass midnight."""
    start, end = (x.strip() for x in hours.split("-"))
    seconds = [int(a) * 3600 + int(b) * 60 for a, b in (start.split(":"), end.split(":"))]
    local = F.from_utc_timestamp(ts, zone)
    now = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local) + (F.unix_micros(local) % 1_000_000) / 1_000_000
    a, b = now >= seconds[0], now <= seconds[1]
    return a & b if seconds[0] <= seconds[1] else a | b


def html_escape(c: Column) -> Column:
    out = c
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def risk_score(max_severity: Column, privileged: Column, file_changes: Column, alerts: Column) -> Column:
    """0..100: the worst severity, then privileged commands, file changes and alerts, each up to a limit."""
    worst = F.when(max_severity >= 4, 60).when(max_severity == 3, 45).when(max_severity == 2, 25).when(max_severity == 1, 10).otherwise(0)
    more = 2 * F.least(privileged, F.lit(10)) + 2 * F.least(file_changes, F.lit(10)) + 4 * F.least(alerts, F.lit(5))
    return F.least(F.lit(100), worst + more).cast("int")
