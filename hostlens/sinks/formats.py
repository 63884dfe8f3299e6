"""Text forms of events and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import html_escape
from ..schema import severity_name

# Syslog facility (log audit) and the level of each severity.
FACILITY = 13
LEVELS = (6, 5, 4, 3, 2)
APP = "hostlens"
UDP_LIMIT = 8192


def syslog_priority(severity: Column) -> Column:
    level = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.greatest(F.lit(0), F.least(F.lit(4), severity)).cast("int") + 1)
    return F.lit(FACILITY * 8) + level


def syslog_line(events: DataFrame, columns: list[str], proc: str = "-") -> Column:
    """RFC 5424: <priority>1 time host app process message-id - JSON of the columns."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    host = F.coalesce(F.nullif("host", F.lit("")), F.lit("-"))
    body = F.to_json(F.struct(*columns))
    return F.concat(F.lit("<"), syslog_priority(F.col("severity")).cast("string"), F.lit(">1 "), stamp, F.lit(" "), host, F.lit(f" {APP} {proc} "), F.replace("action", F.lit(" "), F.lit("_")), F.lit(" - "), body)


def notice(alerts: DataFrame) -> DataFrame:
    """Alerts as notices: what a person needs to see."""
    rule = F.coalesce(F.get_json_object("details", "$.rule"), F.col("action"))
    return alerts.select("ts", "host", rule.alias("rule"), "severity", F.col("message").alias("title"), "user", "src_ip", "session_id", "target", "command_line", F.col("id").alias("event_id"))


def notice_text(n: DataFrame) -> DataFrame:
    """Notices with text: a line for each thing that is known."""
    line = lambda label, c: F.concat(F.lit(f"{label}: "), F.col(c))
    first = F.concat(F.lit("["), F.upper(severity_name(F.col("severity"))), F.lit("] "), "title")
    time = F.concat(F.lit("Time: "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
    return n.withColumn("text", F.concat_ws("\n", first, line("Host", "host"), time, line("User", "user"), line("Source", "src_ip"), line("Target", "target"), line("Command", "command_line"), line("Session", "session_id"), line("Rule", "rule")))


def chat_payload(n: DataFrame, kind: str = "generic") -> Column:
    """notice_text() rows as the JSON body that a chat service expects."""
    if kind == "slack":
        return F.to_json(F.struct(F.col("text").alias("text")))
    if kind == "discord":
        return F.to_json(F.struct(F.substring("text", 1, 2000).alias("content")))
    if kind == "teams":
        return F.to_json(F.struct(F.lit("MessageCard").alias("@type"), F.col("title").alias("summary"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text")))
    return F.to_json(F.struct(*[c for c in n.columns]))


def html_row(columns: list[str]) -> Column:
    """A table row of escaped cells."""
    cells = [F.concat(F.lit("<td>"), html_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns]
    return F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))


def html_table(title: str, rows: list[str], columns: list[str]) -> str:
    """A page around rows that html_row has made; for a report, whose rows are few."""
    import html

    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{''.join(rows)}</table></body></html>"
