"""Stateful streams: cooldowns, sessions, windows and held-back order.

Keyed state lives in Spark's state store and commits with the stream's offsets, so a restart goes on where the last
finished batch ended.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sessions import TRACKED, Tracker
from ..session import ship

# -- keyed state ------------------------------------------------------------------------------------------------------


def stream_cooldown(candidates: DataFrame, keys: list[str], seconds: int, ttl_hours: int | None = None) -> DataFrame:
    """The candidates (with us and id) that fire, as rules.with_cooldown has them for rows in order.

    A key's state is the time it last fired. With ttl_hours, a key that is silent for so long is forgotten, which makes
    Spark run batches without data. A row older than the last firing fires and moves it back, as when a late event is
    seen after newer ones.
    """
    ship(candidates.sparkSession)
    span = seconds * 1_000_000
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_hours else GroupStateTimeout.NoTimeout

    def step(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["us", "id"], kind="stable")
        keep = []
        for us in rows["us"]:
            fires = last is None or us - last >= span or us < last
            keep.append(fires)
            last = int(us) if fires else last
        state.update((last,))
        if ttl_hours:
            state.setTimeoutDuration(ttl_hours * 3_600_000)
        yield rows[keep]

    return candidates.groupBy(*keys).applyInPandasWithState(step, candidates.schema, T.StructType([T.StructField("last", T.LongType())]), "append", timeout)


def stream_sessions(events: DataFrame) -> DataFrame:
    """Events with their sessions, as sessions.track has them: the state of a host is its live sessions."""
    ship(events.sparkSession)
    out_type = T.StructType([*events.schema.fields, *TRACKED.fields])

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t = Tracker()
        if state.exists:
            t.live, t.owner = json.loads(state.get[0])
        rows = pd.concat(list(parts)).sort_values(["us", "arrival_seq"], kind="stable").reset_index(drop=True)
        names = ("us", "action", "category", "user", "src_ip", "protocol", "keys", "learn")
        none = lambda v: None if v is None or (isinstance(v, float) and pd.isna(v)) else v
        found = [t.event(*(none(v) for v in row)) for row in zip(*(rows[n] for n in names), strict=True)]
        state.update((json.dumps([t.live, t.owner]),))
        kept = rows[[f is not None for f in found]].reset_index(drop=True)
        added = pd.DataFrame([f for f in found if f is not None], columns=TRACKED.fieldNames())
        added["opened_us"] = added["opened_us"].astype("Int64")
        yield pd.concat([kept, added], axis=1)

    return events.groupBy("host").applyInPandasWithState(step, out_type, T.StructType([T.StructField("tracker", T.StringType())]), "append", GroupStateTimeout.NoTimeout)


# -- windows ----------------------------------------------------------------------------------------------------------


def failure_windows(events: DataFrame, window: str = "2 minutes", slide: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Failures and distinct users of an address in sliding windows; rows over `late` behind are not counted."""
    f = events.filter("action = 'auth.failure' AND src_ip IS NOT NULL").withWatermark("ts", late)
    g = f.groupBy("src_ip", F.window("ts", window, slide).alias("w"))
    return g.agg(F.count("*").alias("failures"), F.approx_count_distinct("user").alias("users")).select("src_ip", F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "failures", "users")


def debounced_notices(notices: DataFrame, gap: str = "1500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Change notices of a path that follow one another within the gap, as one."""
    n = notices.withWatermark("ts", late).groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("notices"))
    return n.select("path", F.col("w.start").alias("first_ts"), "notices")


# -- order ------------------------------------------------------------------------------------------------------------


class HeldOrder:
    """A foreachBatch function that hands rows on in event order and never drops a late one.

    Rows wait until the newest event time seen is `hold_seconds` past theirs; then they go, sorted by time and arrival,
    to `process(rows, batch)`. What waits is kept as a table per batch, so a batch that is tried again starts from the
    same rows; tables older than that go. A row later than that goes with the next batch, a row without a time at once.
    flush() hands on what is left. hosts.host_rows holds rows in keyed state instead, with a limit in processing time.
    """

    def __init__(self, folder: str, process: Callable[[DataFrame, int], None], hold_seconds: int = 2, ts: str = "ts", seq: str = "arrival_seq"):
        self.folder, self.process, self.hold, self.ts, self.seq = folder.rstrip("/"), process, hold_seconds, ts, seq

    def _held(self, spark: SparkSession, batch: int, schema: T.StructType) -> DataFrame | None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch={batch}")
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return spark.read.schema(schema).parquet(f"{self.folder}/batch={batch}") if fs.exists(at) else None

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        held = self._held(spark, batch - 1, rows.schema)
        every = rows if held is None else held.unionByName(rows)
        newest = every.agg(F.max(self.ts)).first()[0]
        due = F.col(self.ts).isNull() | (F.col(self.ts) <= F.lit(newest) - F.expr(f"INTERVAL {self.hold} SECONDS"))
        every.filter(~due).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")
        self.process(every.filter(due).orderBy(self.ts, self.seq), batch)
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch={batch - 2}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    def flush(self, spark: SparkSession, batch: int, schema: T.StructType) -> None:
        held = self._held(spark, batch, schema)
        if held is not None:
            self.process(held.orderBy(self.ts, self.seq), batch + 1)
