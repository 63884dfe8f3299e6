"""What a user asks for: the commands of an audit tool, as functions that return DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import duration_text, risk_score
from ..operators import integrity, search


def run_search(events: DataFrame, query: str, since: str = "24h", until: str | None = None, limit: int = 200, now: Column | None = None) -> DataFrame:
    return search.display_order(search.search(events, search.parse(query, since=since, until=until, limit=limit), now))


def run_sessions(sessions: DataFrame, since: str = "7d", live: bool = False, user: str | None = None, limit: int = 100, now: Column | None = None) -> DataFrame:
    """Sessions with their length and risk."""
    found = search.sessions(sessions, search.bound(since, now), live, user, limit)
    end = F.coalesce("end_ts", now if now is not None else F.current_timestamp())
    seconds = F.greatest(F.lit(0), F.unix_seconds(end) - F.unix_seconds("start_ts"))
    return found.withColumns({"duration": duration_text(seconds), "risk": risk_score(F.col("max_severity"), F.col("privileged"), F.col("file_changes"), F.col("alerts"))})


def run_session(events: DataFrame, session_id: str) -> DataFrame:
    return search.session_events(events, session_id)


def run_changes(events: DataFrame, path: str | None = None, since: str = "7d", limit: int = 200, now: Column | None = None) -> DataFrame:
    return search.display_order(search.changes(events, path, since, limit, now))


def run_diff(events: DataFrame, blobs: DataFrame, event_id: int) -> DataFrame:
    """The line diff of a change's stored contents."""
    pair = search.blob_pair(search.get_event(events, event_id), blobs)
    text = lambda c: F.coalesce(F.decode(c, "utf-8"), F.lit(""))
    return integrity.unified_diffs(pair.select(F.col("target").alias("path"), text("before").alias("before"), text("after").alias("after")))


def run_alerts(events: DataFrame, min_severity: str = "low", since: str = "7d", limit: int = 200, now: Column | None = None) -> DataFrame:
    return search.display_order(search.alerts(events, min_severity, since, limit, now))


def run_verify(events: DataFrame, shard: list[str], columns: list[str], **more) -> DataFrame:
    return integrity.verify(events, shard, columns, **more)
