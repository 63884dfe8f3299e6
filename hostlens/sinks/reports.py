"""HTML reports of one incident or one session, from rows that are few by their nature."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import duration_text, risk_score
from ..schema import severity_name
from .formats import html_row, html_table

MOST_ROWS = 20_000


def _section(title: str, rows: DataFrame, columns: list[str]) -> str:
    """A table of the first MOST_ROWS rows; where there are more, a line says how many are not shown."""
    found = [r[0] for r in rows.select(html_row(columns)).limit(MOST_ROWS + 1).collect()]
    more = rows.count() - MOST_ROWS if len(found) > MOST_ROWS else 0
    page = html_table(title, found[:MOST_ROWS], columns).split("<body>")[1].removesuffix("</body></html>").replace("h1>", "h2>")
    return page + (f"<p>{more} more rows are not shown</p>" if more else "")


def _page(title: str, facts: dict[str, object], sections: list[str]) -> str:
    items = "".join(f"<li>{html.escape(k)}: {html.escape('' if v is None else str(v))}</li>" for k, v in facts.items())
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><ul>{items}</ul>{''.join(sections)}</body></html>"


def incident_report(reports: DataFrame, incident_id: str, timeline: DataFrame | None = None, candidates: DataFrame | None = None, related: DataFrame | None = None) -> str:
    """The page of an incident: its facts, timeline, candidates and related activity."""
    row = reports.filter(F.col("incident_id") == incident_id).first()
    if row is None:
        raise KeyError(incident_id)
    sections = []
    for title, rows, columns, order in (("Timeline", timeline, ["us", "description"], "us"), ("Candidates", candidates, ["place", "name", "score"], "place"), ("Related activity", related, ["offset_seconds", "action", "summary"], "offset_seconds")):
        if rows is not None:
            sections.append(_section(title, rows.orderBy(order), columns))
    return _page(f"Incident {incident_id}", row.asDict(), sections)


def session_report(sessions: DataFrame, events: DataFrame, session_id: str) -> str:
    """The page of a session: who, from where, how long, its risk, and its events in order."""
    end = F.coalesce("end_us", "last_us", "start_us")
    facts = sessions.filter(F.col("id") == session_id).select(
        "user", "src_ip", "protocol", "status", duration_text((end - F.col("start_us")) / 1_000_000).alias("duration"), "commands", "privileged", "file_changes", "alerts",
        risk_score(F.col("max_severity"), F.col("privileged"), F.col("file_changes"), F.col("alerts")).alias("risk"),
    ).first()
    if facts is None:
        raise KeyError(session_id)
    own = events.filter(F.col("session_id") == session_id).orderBy("us", "id").withColumn("level", severity_name(F.col("severity")))
    return _page(f"Session {session_id}", facts.asDict(), [_section("Events", own, ["us", "level", "action", "message"])])
