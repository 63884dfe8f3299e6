"""The audit pipeline as a stream: parsed events in, one commit of everything that follows from them per batch.

In the streaming plan, each with keyed state: secrets are masked and rows checked, hosts hold their rows in order and
track sessions (hosts), and the rules find what fires (alerts). A batch of that is then stored: changes are attributed
to the commands before them, alerts become events, all of them are chained host by host, and events, quarantined rows,
sessions, known sources, heads and positions become one version of the store (sinks.commits).

What a batch reads of the store does not depend on its age: the commands of the last minutes, the sessions that are
open or have just ended, and a row for each host and source. A batch that is run again replaces itself: its rows, heads
and sessions start from the version before it.

Events need unique ids, a host, times as `us` and `ts`, and the flat process columns of schema.ADAPTED; what else
HostState reads is null where it is missing. Rules see events before attributions, as those look back over stored
events; the alert on a sensitive file takes its actor over from the attributed event.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.redact import redact
from ..functions.scalars import truncate_bytes
from ..operators import attribution, integrity, rules, sessions, windows
from ..schema import CATEGORIES
from ..sinks.commits import Store
from . import alerts, hosts

MOST_COMMAND = 8192
LINGER_SECONDS = 3600  # how long ended sessions stay among the live ones
COMPACT_EVERY = 32
#: What rows are chained and told apart by within a host.
ORDER = ("us", "arrival_seq", "id", "is_alert", "action")
#: What is stored beside the events' own columns.
STORED = {"tracked_action": "string", "original_ip": "string", "linked_session": "string", "opened_us": "bigint", "trigger_event_id": "bigint", "rule": "string", "trigger_action": "string", "title": "string"}


def faults(events: DataFrame) -> Column:
    """Why a row cannot be an event, null for most: a missing host or id, a category or severity that there is not,
    details that are no JSON."""
    checks = {
        "id is missing": F.col("id").isNull(),
        "host is missing": F.col("host").isNull(),
        "category is unknown": ~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)),
        "severity is out of range": ~F.coalesce(F.col("severity").between(0, 4), F.lit(False)),
    }
    if "details" in events.columns:
        checks["details are no JSON"] = F.col("details").isNotNull() & F.try_parse_json("details").isNull()
    return F.coalesce(*[F.when(bad, F.lit(why)) for why, bad in checks.items()])


@dataclass
class AuditPipeline:
    """start() runs it; rows() and process() are its two halves."""

    folder: str
    settings: rules.Settings = field(default_factory=rules.Settings)
    custom: list[rules.CustomRule] = field(default_factory=list)
    suppress: list[rules.Suppression] = field(default_factory=list)
    hold_seconds: float = 2
    most_seconds: float = 10
    reap_seconds: float = hosts.REAP_SECONDS
    ignored: list[str] = field(default_factory=list)
    sessions_only: bool = False
    ttl_hours: int = 24
    name: str = "audit"
    #: Called with the stored rows of a batch after its commit: forwarders, notices. A batch that is run again calls them again.
    after: list[Callable[[DataFrame, int], None]] = field(default_factory=list)

    def store(self, spark: SparkSession) -> Store:
        return Store(spark, self.folder)

    # -- the streaming half -------------------------------------------------------------------------------------------

    def prepared(self, events: DataFrame) -> DataFrame:
        """Secrets masked and long texts cut, before anything is held, stored or matched."""
        clean = {c: truncate_bytes(redact(F.col(c)), MOST_COMMAND) for c in ("command_line", "message")}
        return events.withColumns(clean)

    def rows(self, events: DataFrame) -> DataFrame:
        """alerts.FIRED rows of a stream of events."""
        events = rules.with_rule_columns(events)
        checked = self.prepared(events).withColumn("error", faults(events))
        held = hosts.host_rows(checked, self.hold_seconds, self.most_seconds, self.reap_seconds)
        e = hosts.opened(held, self.prepared(events).schema)
        is_event, ended = F.col("kind").isin("event", "ended"), F.col("kind") == "ended"
        moved = F.col("original_ip").isNotNull()
        from_session = {
            "session_id": F.coalesce("session_id", "tracked_session"),
            "action": F.when(is_event, F.coalesce("tracked_action", "action")),
            "category": F.when(ended, F.lit("session")).when(F.coalesce("merged", F.lit(False)), F.lit("auth")).when(is_event, F.col("category")),
            "user": F.coalesce("tracked_user", "user"),
            "src_ip": F.coalesce("tracked_ip", "src_ip"),
            "severity": F.greatest(F.coalesce("severity", F.lit(0)), F.coalesce("severity_floor", F.lit(0))).cast(dict(events.dtypes)["severity"]),
            "message": F.when(ended, F.col("error")).when(moved, F.concat(F.coalesce("message", F.lit("")), F.lit(" (from a different address than the original logon)"))).otherwise(F.col("message")),
            "id": F.when(ended, -F.abs(F.xxhash64("host", "us", "tracked_session"))).otherwise(F.col("id")).cast("long"),
            "ts": F.when(ended, F.timestamp_micros("us")).otherwise(F.col("ts")),
        }
        position = {"_source": F.when(F.col("kind") == "mark", F.col("target")), "_position": F.when(F.col("kind") == "mark", F.col("message"))}
        e = e.withColumns(position).withColumns(from_session)
        e = sessions.fallback_user(e) if "run_as" in e.columns else e
        e = sessions.store_filter(e, self.ignored, self.sessions_only) if self.ignored or self.sessions_only else e
        body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in e.columns]), hosts.JSON)
        self._type = e.schema
        return alerts.fired(e, body, self.settings, self.custom, self.suppress, self.ttl_hours)

    def start(self, events: DataFrame, checkpoint: str, **trigger):
        """The running query of a stream of events."""
        writer = self.rows(events).writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).queryName(self.name)
        return (writer.trigger(**trigger) if trigger else writer).start()

    # -- the storing half ---------------------------------------------------------------------------------------------

    def process(self, found: DataFrame, batch: int) -> None:
        spark = found.sparkSession
        store = self.store(spark)
        # Written first: what a state hands on depends on the clock, so it must be computed once.
        folder = f"{store.path}/staging/{uuid.uuid4().hex}"
        found.write.parquet(folder)
        staged = spark.read.schema(found.schema).parquet(folder)
        if not staged.head(1):
            store._fs.delete(store._at(folder), True)
            return
        tx = store.begin(self.name, batch)
        rows = staged.filter("rule IS NULL").select(F.from_json("body", self._type, hosts.JSON).alias("e")).select("e.*")
        bad, marks = rows.filter("kind = 'bad'"), rows.filter("kind = 'mark'")
        tx.append("quarantine", bad.select("host", "us", "error", F.try_parse_json("_raw").alias("raw")))
        self._positions(tx, marks)
        events = self._attributed(tx, rows.filter("kind IN ('event', 'ended')").drop("kind", "error", "_raw", "_source", "_position", "merged", "severity_floor", "tracked_session", "tracked_user", "tracked_ip"))
        told = staged.filter("rule IS NOT NULL").select("id", *[F.col(c).alias(f"_{c}") for c in ("rule", "cooldown_key", "severity", "title", "notify", "n")])
        every = self._stored(events).unionByName(self._stored(self._alerts(events, told)))
        chained = integrity.continue_chain(every, tx.read("heads"), ["host"], list(ORDER), self.hashed(every))
        kept = tx.append("events", chained, "us")
        tx.replace("heads", integrity.next_heads(kept, tx.read("heads"), ["host"]))
        self._sessions(tx, kept)
        tx.append("sources", windows.known_sources(kept.filter("action = 'session.start' AND src_ip IS NOT NULL")))
        tx.put("last_alive_us", int(time.time() * 1_000_000))
        tx.commit()
        store._fs.delete(store._at(folder), True)
        if batch % COMPACT_EVERY == COMPACT_EVERY - 1:
            for table in ("events", "sessions", "sources", "quarantine"):
                store.compact(table)
        for then in self.after:
            then(kept, batch)

    def hashed(self, rows: DataFrame) -> list[str]:
        """The columns that a row's hash covers."""
        return [c for c in ("seq_of", "id", *integrity.HASHED, "process_name", "command_line", "is_alert") if c in rows.columns]

    def _stored(self, rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({c: F.lit(None).cast(k) for c, k in STORED.items() if c not in rows.columns})
        rows = rows.withColumn("attribution", F.lit(None).cast("struct<confidence:string,reason:string>")) if "attribution" not in rows.columns else rows
        return rows if "is_alert" in rows.columns else rows.withColumn("is_alert", F.lit(False))

    def _alerts(self, events: DataFrame, told: DataFrame) -> DataFrame:
        """What has fired, as events beside those that caused it."""
        own = ["rule", "cooldown_key", "severity", "title", "notify", "n"]
        a = events.join(told, "id").drop("severity").withColumns({c: F.col(f"_{c}") for c in own}).drop(*[f"_{c}" for c in own])
        a = alerts.with_titles(a, self.settings).withColumn("trigger_action", F.col("action"))
        a = a.withColumn("title", F.when(F.col("rule") == "sensitive_file", rules.sensitive_title()).otherwise(F.col("title")))
        a = a.withColumn("_key", -F.abs(F.xxhash64("id", "rule", "cooldown_key")))
        out = rules.alert_events(a).withColumns({"id": F.col("_key"), "is_alert": F.lit(True), "title": F.col("message")})
        return out.select(*[c for c in dict.fromkeys([*events.columns, *STORED, "is_alert"]) if c in out.columns])

    def _attributed(self, tx, events: DataFrame) -> DataFrame:
        """Changes that nobody is known for, with the command or session that explains them."""
        if "details" not in events.columns:
            events = events.withColumn("details", F.lit(None).cast("string"))
        due = events.filter(F.col("category").isin("file", "package", "account") & F.col("session_id").isNull() & F.col("user").isNull() & F.col("target").isNotNull() & F.col("us").isNotNull())
        first = due.agg(F.min("us")).first()[0]
        if first is None:
            return events
        commands = attribution.recent_commands(events)
        before = tx.read("events", first - attribution.LOOKBACK_SECONDS * 1_000_000)
        if before is not None:
            commands = commands.unionByName(attribution.recent_commands(before.filter(F.col("us") >= first - attribution.LOOKBACK_SECONDS * 1_000_000)))
        found = attribution.attribution(due.select("id", "host", "us", "target"), commands, self._live(tx, events))
        return attribution.apply(events, found)

    # -- sessions and positions ---------------------------------------------------------------------------------------

    def _changes(self, rows: DataFrame) -> DataFrame:
        """What rows say of their sessions."""
        opened = F.col("action").isin("session.start", "session.reconnect") | F.col("linked_session").isNotNull()
        status = F.when(opened, "active").when(F.col("action") == "session.disconnect", "disconnected").when(F.col("action").isin("session.end", "session.ended_unobserved"), "ended")
        place = F.struct("us", "arrival_seq", "id")
        own = rows.filter("session_id IS NOT NULL").withColumn("_status", status)
        told = own.groupBy("session_id").agg(
            F.min("host").alias("host"),
            F.min_by("user", F.when(F.col("user").isNotNull(), place)).alias("user"),
            F.min_by("src_ip", F.when(F.col("src_ip").isNotNull(), place)).alias("src_ip"),
            F.max("protocol").alias("protocol"),
            F.min("opened_us").alias("start_us"),
            F.max(F.when(F.col("_status") == "ended", F.col("us"))).alias("end_us"),
            F.max_by("_status", F.when(F.col("_status").isNotNull(), place)).alias("status"),
        )
        return told.join(sessions.session_counters(own), "session_id").withColumnRenamed("session_id", "id")

    @staticmethod
    def _merged(old: DataFrame | None, new: DataFrame) -> DataFrame:
        """Sessions, given what was known before and what has come."""
        every = new.withColumn("_new", F.lit(1)) if old is None else old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_new"))).alias(c)
        last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_new"))).alias(c)
        return every.groupBy("id").agg(
            first("host"), first("user"), first("src_ip"), first("protocol"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), last("status"),
            *[F.sum(c).alias(c) for c in ("commands", "privileged", "file_changes", "alerts")], F.max("max_severity").alias("max_severity"), F.max("last_us").alias("last_us"),
        )

    def _live(self, tx, events: DataFrame) -> DataFrame:
        """id, host, user, start_us, end_us of the sessions that may be open during the batch, its own included."""
        own = self._changes(self._stored(events))
        return self._merged(tx.read("live"), own).filter("start_us IS NOT NULL").select("id", "host", "user", "start_us", "end_us")

    def _sessions(self, tx, kept: DataFrame) -> None:
        """The sessions that the batch changed are appended as they are now; those that are over leave the state."""
        new = self._changes(kept)
        old = tx.read("live")
        live = self._merged(old, new)
        newest = kept.agg(F.max("us")).first()[0] or 0
        changed = live.join(new.select("id"), "id", "left_semi").withColumn("as_of", F.lit(-1 if tx.batch is None else tx.batch))
        tx.append("sessions", changed)
        tx.replace("live", live.filter(F.col("start_us").isNotNull() & (F.col("end_us").isNull() | (F.col("end_us") > newest - LINGER_SECONDS * 1_000_000))))

    def sessions(self, spark: SparkSession, version: int | None = None) -> DataFrame | None:
        """All sessions, as they are at a version: the newest row of each."""
        rows = self.store(spark).read("sessions", version)
        if rows is None:
            return None
        last = Window.partitionBy("id").orderBy(F.col("as_of").desc(), F.col("last_us").desc())
        return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "as_of")

    def sources(self, spark: SparkSession, version: int | None = None) -> DataFrame | None:
        """Known sources: first and last time and logins of each user and address."""
        rows = self.store(spark).read("sources", version)
        return None if rows is None else windows.merge_known_sources(rows.limit(0), rows)

    def _positions(self, tx, marks: DataFrame) -> None:
        new = marks.filter("_source IS NOT NULL").groupBy(F.col("_source").alias("source")).agg(F.max_by("_position", "arrival_seq").alias("position"))
        old = tx.read("positions")
        tx.replace("positions", new if old is None else new.unionByName(old.join(new.select("source"), "source", "left_anti")))
