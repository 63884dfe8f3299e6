"""Journal entries: one JSON object a line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .authlog import auth_events


def journal_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """lines with ts, ident, tag_pid, msg and cursor; lines without a message, a name or a time are dropped.

    A message that is no UTF-8 comes as an array of bytes; what of it is no text is replaced.
    """
    j = lambda k: F.get_json_object(column, f"$.{k}")
    raw = j("MESSAGE")
    codes = F.from_json(raw, "array<int>")
    data = F.unhex(F.array_join(F.transform(F.filter(codes, lambda b: b.between(0, 255)), lambda b: F.lpad(F.hex(b), 2, "0")), ""))
    msg = F.when(F.startswith(raw, F.lit("[")) & codes.isNotNull(), F.make_valid_utf8(data.cast("string"))).otherwise(raw)
    micros = j("__REALTIME_TIMESTAMP").try_cast("long")
    out = lines.withColumns(
        {"ts": F.timestamp_micros(micros), "ident": F.coalesce(j("SYSLOG_IDENTIFIER"), j("_COMM")), "tag_pid": F.coalesce(j("SYSLOG_PID"), j("_PID")).try_cast("long"), "msg": msg, "cursor": j("__CURSOR")}
    )
    return out.filter("ts IS NOT NULL AND ident IS NOT NULL AND msg IS NOT NULL")


def read_journal(lines: DataFrame) -> DataFrame:
    return auth_events(journal_lines(lines))
