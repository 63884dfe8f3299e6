"""Events as struct expressions: parsers give a struct per line, null where a line says nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EVENT, PROCESS


def event(category: str | Column, action: str | Column, message: Column, **fields: Column | str | int | dict) -> Column:
    """A struct with the fields of EVENT; details and process may be given as dicts of columns."""
    given: dict[str, Column] = {"category": _col(category), "action": _col(action), "message": message, "outcome": F.lit("unknown"), "severity": F.lit(0)}
    for k, v in fields.items():
        if k == "details":
            parts = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), x.cast("string").alias("value")) for n, x in v.items()]), lambda e: e["value"].isNotNull())
            given[k] = F.when(F.size(parts) > 0, F.to_json(F.map_from_entries(parts)))
        elif k == "process":
            given[k] = F.struct(*[v.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PROCESS.fields])
        else:
            given[k] = _col(v)
    return F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT.fields])


def _col(v: Column | str | int) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def keys(*found: Column) -> Column:
    """The keys that are not null, in order."""
    return F.filter(F.array(*found), lambda k: k.isNotNull())


def prefixed(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), c.cast("string"))


def group(text: Column, pattern: str, n: int) -> Column:
    """The n-th group of a pattern; null where the pattern or the group does not match."""
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns that are computed once a row, however often they are read: exploded out of an array of one."""
    row = F.struct(*[v.alias(k) for k, v in columns.items()])
    return df.select("*", F.explode(F.array(row)).alias("_once")).select(*[f"`{c}`" for c in df.columns], *[F.col(f"_once.{k}").alias(k) for k in columns])


def events_of(lines: DataFrame, found: Column, ts: Column | None = None, more_keys: Column | None = None, more_details: Column | None = None) -> DataFrame:
    """The events of lines that have one, with the line's time where the event has none.

    more_keys are put after the event's own keys, more_details (a map) into its details, where they are not null. The event is exploded out of
    an array of none or one: so the optimizer evaluates the parsing once, and not again for the test for null.
    """
    extra = {"_ts": ts, "_keys": more_keys, "_details": more_details}
    kept = [c for c in lines.columns if c not in EVENT.fieldNames()]
    out = lines.select(*kept, *[v.alias(k) for k, v in extra.items() if v is not None], F.explode(F.array_compact(F.array(found))).alias("_e"))
    fields = {f.name: F.col(f"_e.{f.name}") for f in EVENT.fields}
    if ts is not None:
        fields["ts"] = F.coalesce(fields["ts"], F.col("_ts"))
    if more_keys is not None:
        fields["keys"] = F.when(F.col("_keys").isNull(), fields["keys"]).otherwise(F.concat(F.coalesce(fields["keys"], F.expr("array()").cast("array<string>")), F.col("_keys")))
    if more_details is not None:
        own = F.coalesce(F.from_json(fields["details"], "map<string,string>"), F.create_map().cast("map<string,string>"))
        fields["details"] = F.when(F.col("_details").isNull(), fields["details"]).otherwise(F.to_json(F.map_concat(own, F.col("_details"))))
    return out.select(*[v.alias(k) for k, v in fields.items()], *kept)
