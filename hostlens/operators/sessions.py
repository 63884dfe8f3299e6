"""Sessions: opened, merged and closed by events, and the events that belong to them.

Exact tracking is an ordered fold per host: which session a key belongs to depends on all logins, learned keys and
logoffs before it. What can be stated without that order (counters, inheritance, snapshots, fallbacks) are joins.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import norm_user
from ..schema import struct_of
from .ordered import fold

MERGE_SECONDS = 60
MOST_LEARNED = 2000

TRACKED = struct_of(
    "tracked_session STRING, tracked_action STRING, tracked_user STRING, tracked_ip STRING, merged BOOLEAN, original_ip STRING, opened_us BIGINT, linked_session STRING, severity_floor INT"
)


class Tracker:
    """The live sessions of one host.

    Events carry keys; a session owns the keys of its login, and learns further ones from events that resolve to it.
    A later login takes over the keys it names. Of several sessions a login could merge into, the one with the nearest
    start counts, then the smallest id. Both lookups by name have an index, so no event is compared with all of a host's
    sessions.
    """

    def __init__(self, host: str = ""):
        self.host, self.live, self.owner = host, {}, {}

    @property
    def live(self) -> dict:
        return self._live

    @live.setter
    def live(self, sessions: dict) -> None:
        self._live, self.named, self.starts = sessions, {}, {}
        for s in sessions.values():
            self._enter(s)

    def _lists(self, s: dict) -> list[list]:
        """The sorted (start, id) of sessions of the same name and protocol: of any address, and of this one."""
        key = (s["name"], s["protocol"])
        return [self.starts.setdefault(k, []) for k in (key, (*key, s["ip"]))]

    def _enter(self, s: dict) -> None:
        self.named.setdefault(s["name"], {})[s["id"]] = s
        for found in self._lists(s):
            insort(found, (s["start"], s["id"]))

    def _leave(self, s: dict) -> None:
        self.named[s["name"]].pop(s["id"])
        if not self.named[s["name"]]:
            del self.named[s["name"]]
        for found in self._lists(s):
            del found[bisect_left(found, (s["start"], s["id"]))]
        for k in ((s["name"], s["protocol"]), (s["name"], s["protocol"], s["ip"])):
            if not self.starts[k]:
                del self.starts[k]

    def nearest(self, us: int, name: str, protocol: str, ip: str | None) -> dict | None:
        """The session a login merges into; an unknown address fits any."""
        best = None
        for k in [(name, protocol)] if ip is None else [(name, protocol, ip), (name, protocol, None)]:
            found = self.starts.get(k, ())
            at = bisect_left(found, (us,))
            before = found[bisect_left(found, (found[at - 1][0],))] if at else None  # of equal starts the smallest id
            for start, sid in (x for x in (before, found[at] if at < len(found) else None) if x):
                if abs(start - us) <= MERGE_SECONDS * 1_000_000:
                    best = min(best or (abs(start - us), sid), (abs(start - us), sid))
        return best and self.live[best[1]]

    def resolve(self, keys) -> dict | None:
        return next((self.live[s] for k in keys if (s := self.owner.get(k)) in self.live), None)

    def open(self, us: int, user: str, protocol: str, ip: str | None, keys: list[str]) -> tuple[dict, bool]:
        name = user.strip().lower()
        s = self.nearest(us, name, protocol, ip)
        if s is not None:
            self._leave(s)
            s["ip"], s["start"] = s["ip"] or ip, min(s["start"], us)
            self._enter(s)
            for k in keys:
                if k not in s["base"]:
                    s["base"].append(k)
                    self.owner[k] = s["id"]
            return s, True
        seed = f"{self.host}|{name}|{protocol}|{us}|{','.join(keys)}"
        s = {"id": f"S{us}-{hashlib.sha256(seed.encode()).hexdigest()[:6]}", "user": user, "name": name, "protocol": protocol, "ip": ip, "start": us, "base": list(keys), "learned": {}}
        if s["id"] in self.live:
            self._leave(self.live[s["id"]])
        self.live[s["id"]] = s
        self._enter(s)
        for k in keys:
            self.owner[k] = s["id"]
        return s, False

    def learn(self, s: dict, keys) -> None:
        for k in keys:
            if self.owner.get(k) != s["id"]:
                self.owner[k] = s["id"]
                s["learned"][k] = True
        while len(s["learned"]) > MOST_LEARNED:  # the oldest go; keys of the login never do
            k = next(iter(s["learned"]))
            del s["learned"][k]
            if self.owner.get(k) == s["id"]:
                del self.owner[k]

    def close(self, s: dict) -> None:
        self._leave(s)
        del self.live[s["id"]]
        for k in [*s["base"], *s["learned"]]:
            if self.owner.get(k) == s["id"]:
                del self.owner[k]

    def event(self, us: int, action: str, category: str, user: str | None, ip: str | None, protocol: str | None, keys, learn) -> dict | None:
        """The event's tracked columns; None for one that is dropped."""
        keys = [] if keys is None else list(keys)
        s, merged, original = None, False, None
        if action in ("session.end", "session.disconnect", "session.reconnect"):
            s = self.resolve(keys)
            if s is None and action != "session.reconnect":
                return None  # it never was an interactive session
            if action == "session.end":
                self.close(s)
            elif s is None:
                action = "session.start"
            elif action == "session.reconnect" and ip is not None and ip != s["ip"]:
                original = s["ip"] or ""
        if action == "session.start":
            s, merged = self.open(us, user or "unknown", protocol or "unknown", ip, keys)
            if merged:
                action = "auth.success"
        elif s is None:
            s = self.resolve(keys)
            if s is None and category == "privilege" and user is not None:
                mine = self.named.get(user.strip().lower(), {})
                s = next(iter(mine.values())) if len(mine) == 1 else None
            if s is not None and learn is not None:
                self.learn(s, learn)
        user, ip = (user if user is not None else s and s["user"]), (ip if ip is not None else s and s["ip"])
        return {"tracked_session": s and s["id"], "tracked_action": action, "tracked_user": user, "tracked_ip": ip, "merged": merged, "original_ip": original, "opened_us": s and s["start"], "linked_session": s["id"] if merged else None, "severity_floor": int(original is not None)}

    def feed(self, rows: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, list]]:
        columns: dict[str, list] = {f.name: [] for f in TRACKED.fields}
        keep = []
        names = ("us", "action", "category", "user", "src_ip", "protocol", "keys", "learn")
        for row in zip(*(rows[n].tolist() for n in names), strict=True):
            out = self.event(*row)
            keep.append(out is not None)
            for c in columns if out else ():
                columns[c].append(out[c])
        return np.array(keep, bool), columns


def track(events: DataFrame) -> DataFrame:
    """Events (host, us, arrival_seq, action, category, user, src_ip, protocol, keys, learn) with their sessions.

    Logoffs and disconnects of sessions that never were are dropped; a login that merged is an auth.success, with the
    session as linked_session. A reconnect from another address keeps the one before as original_ip and is of severity
    1 (low) at least (severity_floor).
    """
    inputs = ["us", "action", "category", "user", "src_ip", "protocol", "keys", "learn"]
    return fold(events, ["host"], ["us", "arrival_seq"], partial(Tracker), TRACKED, inputs)


def session_table(tracked: DataFrame) -> DataFrame:
    """The sessions of tracked events: who, when, how it ended, and counters."""
    own = tracked.filter("tracked_session IS NOT NULL").withColumn("id", F.col("tracked_session"))
    end = F.when(F.col("tracked_action") == "session.end", F.col("us"))
    last = F.max_by(F.when(F.col("tracked_action").isin("session.start", "session.reconnect", "auth.success"), "active").when(F.col("tracked_action") == "session.disconnect", "disconnected").when(F.col("tracked_action") == "session.end", "ended"), F.when(F.col("tracked_action").rlike(r"^session\."), F.struct("us", "arrival_seq")))
    return own.groupBy("id").agg(  # in one pass: what is read twice is tracked twice
        F.min_by("tracked_user", F.struct("us", "arrival_seq")).alias("user"),
        F.min_by("tracked_ip", F.struct("us", "arrival_seq")).alias("src_ip"),
        F.max("protocol").alias("protocol"),
        F.min("opened_us").alias("start_us"),
        F.max(end).alias("end_us"),
        last.alias("status"),
        *_counters(),
    )


def _counters() -> list[Column]:
    return [
        F.count(F.when((F.col("category") == "process") & (F.col("action") == "process.start"), 1)).alias("commands"),
        F.count(F.when(F.col("category") == "privilege", 1)).alias("privileged"),
        F.count(F.when(F.col("category") == "file", 1)).alias("file_changes"),
        F.count(F.when(F.col("category") == "alert", 1)).alias("alerts"),
        F.max("severity").alias("max_severity"),
        F.max("us").alias("last_us"),
    ]


def session_counters(events: DataFrame) -> DataFrame:
    """Per session: commands, privileged, file_changes, alerts, max_severity and last_us."""
    return events.filter("session_id IS NOT NULL").groupBy("session_id").agg(*_counters())


def inherit(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """User and address of an event's session, where the event has none (sessions: id, user, src_ip)."""
    s = sessions.select(F.col("id").alias("session_id"), F.col("user").alias("_user"), F.col("src_ip").alias("_ip"))
    out = events.join(s, "session_id", "left")
    return out.withColumns({"user": F.coalesce("user", "_user"), "src_ip": F.coalesce("src_ip", "_ip")}).drop("_user", "_ip")


def single_live_session(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Events without a session of users with exactly one open at that time, with that session's id in only_session.

    sessions: id, user, start_us, end_us (null while open). A user's starts, events and ends are swept in time order;
    running sums give the number of open sessions and, where it is one, the hash of that session. So no event is paired
    with the sessions of its user. At one time ends count before starts, and starts before events.
    """
    e = events.filter("session_id IS NULL AND user IS NOT NULL").select(norm_user(F.col("user")).alias("_key"), F.col("us").alias("at"), "id")
    s = sessions.select(norm_user(F.col("user")).alias("_key"), F.col("id").alias("_sid"), "start_us", "end_us", F.xxhash64("id").cast("decimal(38,0)").alias("_hash"))
    none = F.lit(None).cast(dict(e.dtypes)["id"]).alias("id")
    turn = lambda at, kind, n: s.select("_key", at.alias("at"), none, F.lit(kind).alias("kind"), F.lit(n).cast("long").alias("n"), (F.col("_hash") * n).cast("decimal(38,0)").alias("hash")).filter("at IS NOT NULL")
    asks = e.select("_key", "at", "id", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("hash"))
    w = Window.partitionBy("_key").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = asks.unionByName(turn(F.col("start_us"), 1, 1)).unionByName(turn(F.col("end_us"), 0, -1))
    swept = every.withColumns({"open": F.sum("n").over(w), "sum": F.sum("hash").over(w).cast("decimal(38,0)")}).filter("kind = 2 AND open = 1")
    one = swept.select("id", "_key", F.col("sum").alias("_hash")).join(s.select("_key", "_hash", "_sid"), ["_key", "_hash"])
    return events.join(one.select("id", F.col("_sid").alias("only_session")), "id")


def resolve_by_keys(events: DataFrame, claims: DataFrame) -> DataFrame:
    """Each event (id, us, keys) with the session of the first of its keys that a live session owns.

    claims: key, session_id, from_us, to_us (null while held). A later claim ends an earlier one of the same key, so of a
    key only the last claim before an event can hold: claims and events of a key are swept in time order. This is the
    form without learned keys; `track` is the exact one.
    """
    kind = claims.schema["session_id"].dataType
    c = claims.select("key", F.col("from_us").alias("at"), F.struct(F.col("session_id").cast(kind).alias("session"), F.col("to_us").cast("long").alias("to")).alias("claim"))
    k = events.select(F.col("id").alias("_id"), F.col("us").alias("at"), F.posexplode("keys").alias("pos", "key")).select("key", "at", "_id", "pos")
    every = c.unionByName(k, allowMissingColumns=True)
    w = Window.partitionBy("key").orderBy(F.col("at"), F.col("claim").isNull(), F.col("claim.session")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = every.withColumn("held", F.last("claim", ignorenulls=True).over(w)).filter("claim IS NULL AND held IS NOT NULL AND key IS NOT NULL AND at IS NOT NULL")
    hits = hits.filter(F.col("held.to").isNull() | (F.col("at") < F.col("held.to")))
    return hits.groupBy(F.col("_id").alias("id")).agg(F.min_by("held.session", "pos").alias("resolved_session"))


def absent_sessions(sessions: DataFrame, live_keys: DataFrame, kind: str) -> DataFrame:
    """Open sessions with a login key of the kind, none of whose keys is in the snapshot: they ended unobserved."""
    mine = sessions.filter(F.col("status") != "ended").filter(F.exists(F.slice("keys", F.lit(1), F.greatest(F.col("base_keys"), F.lit(1))), lambda k: F.startswith(k, F.lit(f"{kind}:"))))
    there = mine.select("id", F.explode("keys").alias("key")).join(live_keys.select("key").distinct(), "key", "left_semi").select("id").distinct()
    return mine.join(there, "id", "left_anti")


def ended_sessions(sessions: DataFrame, alive_pids: DataFrame) -> DataFrame:
    """Open sessions that hang on process ids, none of which is alive (alive_pids: host, pid, of each host at a time).

    Sessions (id, host, status, keys, base_keys) without a pid among the keys of their login never end this way.
    """
    base = F.slice("keys", F.lit(1), F.greatest(F.col("base_keys"), F.lit(1)))
    mine = sessions.filter(F.col("status") != "ended").withColumn("_pids", F.filter(base, lambda k: F.startswith(k, F.lit("pid:"))))
    mine = mine.filter(F.size("_pids") > 0)
    alive = alive_pids.select("host", F.concat(F.lit("pid:"), F.col("pid").cast("string")).alias("key")).distinct()
    there = mine.select("id", "host", F.explode("_pids").alias("key")).join(alive, ["host", "key"], "left_semi").select("id").distinct()
    return mine.drop("_pids").join(there, "id", "left_anti")


def unobserved_ends(gone: DataFrame, us: Column, while_off: bool) -> DataFrame:
    """The session.ended_unobserved events of sessions (id, host, user, src_ip) found gone at `us`.

    while_off tells those that a first snapshot does not hold from those whose processes have vanished since.
    """
    why = " ended while the agent was not running" if while_off else " ended (logoff not observed; its processes are gone)"
    return gone.select(
        us.cast("long").alias("us"),
        "host",
        F.lit("session").alias("category"),
        F.lit("session.ended_unobserved").alias("action"),
        "user",
        "src_ip",
        F.col("id").alias("session_id"),
        F.concat(F.lit("Session of "), F.coalesce("user", F.lit("")), F.lit(why)).alias("message"),
    )


def changed_sessions(tracked: DataFrame, new: Column) -> DataFrame:
    """The sessions, as they are now, that rows for which `new` holds belong to; the rest need not be stored again."""
    some = tracked.filter(new).select(F.col("tracked_session")).filter("tracked_session IS NOT NULL").distinct()
    return session_table(tracked.join(some, "tracked_session", "left_semi"))


def fallback_user(events: DataFrame) -> DataFrame:
    """The account a process runs as, where no user is known."""
    return events.withColumn("user", F.coalesce("user", "run_as"))


def store_filter(events: DataFrame, ignored: list[str], sessions_only: bool = False) -> DataFrame:
    """Without process events of ignored names, and with sessions_only without those that have no session."""
    drop = (F.col("category") == "process") & F.lower(F.coalesce("process_name", F.lit(""))).isin(*[n.lower() for n in ignored])
    if sessions_only:
        drop = drop | ((F.col("category") == "process") & F.col("session_id").isNull())
    return events.filter(~drop)
