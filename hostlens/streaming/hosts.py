"""One host's events in order, and their sessions: the state that a host has in the stream.

Rows wait until the newest event time of their host is `hold_seconds` past theirs, or until they have waited
`most_seconds`, whichever comes first; a processing-time timer sees to the second, so the newest row of a host that has
fallen silent is handed on too. What is due goes on sorted by time and arrival; a row later than that goes with the
next ones, and rows without a time go at once. Then the host's sessions take the rows in (operators.sessions.Tracker).

A mark (action `agent.checkpoint`, the source as target, its position as message) is handed on once every row of the
host that arrived before it has been, so that a position which is stored never lies behind a row which is not.

A `process.snapshot` tells which process ids are alive (`learn`): sessions that began before it and hang on ids none of
which is there end when the next timer finds them. A `session.snapshot` tells the live keys of one kind (`keys`, the
kind as target): open sessions with a login key of that kind, none of whose keys is listed, end at once.

Rows that cannot be handled, and those that come with an `error`, go on as `bad` with the reason and do not disturb the
rest. All columns of the events
pass through as one JSON text, which the state neither reads nor changes.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators.sessions import TRACKED, Tracker
from ..schema import struct_of
from ..session import ship

MARK, ALIVE, PRESENT = "agent.checkpoint", "process.snapshot", "session.snapshot"
REAP_SECONDS = 60
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "true"}

#: What the state reads, beside the host.
READ = ("us", "arrival_seq", "action", "category", "user", "src_ip", "protocol", "target", "message", "keys", "learn", "error", "body")
#: kind: event, mark, bad or ended (a session's unobserved end, without a body).
OUT = T.StructType([*struct_of("host STRING, us BIGINT, arrival_seq BIGINT, kind STRING, error STRING, body STRING").fields, *TRACKED.fields])


def _none(v):
    return None if v is None or (isinstance(v, float) and v != v) else v


class HostState(StatefulProcessor):
    """See the module."""

    def __init__(self, hold_seconds: float, most_seconds: float, reap_seconds: float):
        self.hold, self.most, self.every = int(hold_seconds * 1_000_000), int(most_seconds * 1000), int(reap_seconds * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "arrived BIGINT, place BIGINT, row BINARY")
        self.clock = handle.getValueState("clock", "newest BIGINT, rows BIGINT")
        self.sessions = handle.getValueState("sessions", "tracker STRING")
        self.alive = handle.getValueState("alive", "us BIGINT, due BIGINT, keys ARRAY<STRING>")

    def close(self) -> None:
        pass

    # -- rows ---------------------------------------------------------------------------------------------------------

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = []
        for df in rows:
            new += zip(*[df[c].tolist() for c in READ], strict=True)
        new = [tuple(map(_none, r)) for r in new]
        yield self._turn(key[0], new, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._turn(key[0], [], timerValues.getCurrentProcessingTimeInMs())

    def _turn(self, host: str | None, new: list[tuple], now: int) -> pd.DataFrame:
        newest, rows = self.clock.get() if self.clock.exists() else (None, 0)
        new.sort(key=lambda r: -1 if r[1] is None else r[1])
        waiting = [(a, n, pickle.loads(bytes(row))) for a, n, row in self.held.get()]
        waiting += [(now, rows + n, r) for n, r in enumerate(new)]
        times = [int(r[0]) for r in new if r[0] is not None and r[2] != MARK]
        newest = max([*times, *([] if newest is None else [newest])], default=None)
        due, rest = [], []
        for item in waiting:
            arrived, _, r = item
            ready = r[0] is None or int(r[0]) <= newest - self.hold or now - arrived >= self.most
            (due if ready and r[2] != MARK else rest).append(item)
        first = min((n for _, n, r in rest if r[2] != MARK), default=None)  # marks before it are free
        free = [x for x in rest if x[2][2] == MARK and (first is None or x[1] < first)]
        rest = [x for x in rest if not (x[2][2] == MARK and (first is None or x[1] < first))]
        due.sort(key=lambda x: (-1 if x[2][0] is None else int(x[2][0]), x[1] if x[2][1] is None else int(x[2][1]), x[1]))
        if new or due or free:
            self.held.put([(a, n, pickle.dumps(r)) for a, n, r in rest]) if rest else self.held.clear()
            self.clock.update((newest, rows + len(new)))
        out = self._tracked(host, [r for _, _, r in due], now) + [self._row(host, r, "mark") for _, _, r in free]
        self._set_timers(rest, now)
        return pd.DataFrame(out, columns=OUT.fieldNames()).astype({"us": "Int64", "arrival_seq": "Int64", "opened_us": "Int64", "severity_floor": "Int32", "merged": "boolean"})

    def _set_timers(self, rest: list[tuple], now: int) -> None:
        wanted = {min(a for a, _, _ in rest) + self.most} if rest else set()
        if self.alive.exists():
            wanted.add(self.alive.get()[1])
        wanted = {max(t, now + 1) for t in wanted}
        there = set(self.handle.listTimers())
        for t in there - wanted:
            self.handle.deleteTimer(t)
        for t in wanted - there:
            self.handle.registerTimer(t)

    # -- sessions -----------------------------------------------------------------------------------------------------

    def _row(self, host: str | None, r: tuple, kind: str, error: str | None = None, tracked: dict | None = None) -> list:
        us, seq = (None if v is None else int(v) for v in r[:2])
        return [host, us, seq, kind, error, r[-1], *[(tracked or {}).get(c) for c in TRACKED.fieldNames()]]

    def _ended(self, host: str | None, s: dict, us: int, why: str) -> list:
        told = {"tracked_session": s["id"], "tracked_action": "session.ended_unobserved", "tracked_user": s["user"], "tracked_ip": s["ip"], "merged": False, "opened_us": s["start"], "severity_floor": 0}
        return [host, us, None, "ended", f"Session of {s['user']} {why}", None, *[told.get(c) for c in TRACKED.fieldNames()]]

    def _tracked(self, host: str | None, due: list[tuple], now: int) -> list[list]:
        t = Tracker()
        if self.sessions.exists():
            t.live, t.owner = json.loads(self.sessions.get()[0])
        before = json.dumps([t.live, t.owner])
        out = []
        for r in due:
            us, _, action, category, user, ip, protocol, target, _, keys, learn, error, _ = r
            if error is not None:
                out.append(self._row(host, r, "bad", error))
                continue
            try:
                if action == ALIVE:
                    if us is not None:
                        self.alive.update((int(us), now + self.every, [k for k in ([] if learn is None else learn) if k]))
                elif action == PRESENT:
                    there = set([] if keys is None else keys)
                    for s in [s for s in t.live.values() if any(k.startswith(f"{target}:") for k in s["base"]) and not there & {*s["base"], *s["learned"]}]:
                        t.close(s)
                        out.append(self._ended(host, s, us and int(us), "ended while the agent was not running"))
                elif us is None:  # no place in the order: it opens and closes nothing
                    s = t.resolve([] if keys is None else list(keys))
                    told = {"tracked_session": s and s["id"], "tracked_action": action, "tracked_user": user if user is not None else s and s["user"], "tracked_ip": ip if ip is not None else s and s["ip"], "merged": False, "severity_floor": 0}
                    out.append(self._row(host, r, "event", None, told))
                elif (told := t.event(int(us), action, category, user, ip, protocol, keys, learn)) is not None:
                    out.append(self._row(host, r, "event", None, told))
            except Exception as e:  # noqa: BLE001  whatever a row breaks on, the others go on
                out.append(self._row(host, r, "bad", f"session: {type(e).__name__}: {e}"[:500]))
        out += self._reaped(host, t, now)
        after = json.dumps([t.live, t.owner])
        if after != before:
            self.sessions.update((after,))
        return out

    def _reaped(self, host: str | None, t: Tracker, now: int) -> list[list]:
        """Ends of sessions whose processes were gone at the last snapshot, once its timer has come."""
        if not self.alive.exists():
            return []
        us, due, alive = self.alive.get()
        if now < due:
            return []
        self.alive.clear()
        out, alive = [], set(alive)
        for s in list(t.live.values()):
            pids = [k for k in s["base"] if k.startswith("pid:")]
            if pids and s["start"] <= us and not alive & set(pids):
                t.close(s)
                out.append(self._ended(host, s, us, "ended (logoff not observed; its processes are gone)"))
        return out


def host_rows(events: DataFrame, hold_seconds: float = 2, most_seconds: float = 10, reap_seconds: float = REAP_SECONDS) -> DataFrame:
    """Events of a stream (host, the columns READ but the body, where missing null, and any others) as OUT: in order,
    with sessions, marks and bad rows.

    Needs the RocksDB state store (hostlens.session sets it)."""
    ship(events.sparkSession)
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in events.columns]), JSON)
    missing = {c: F.lit(None).cast("array<string>" if c in ("keys", "learn") else "bigint" if c == "arrival_seq" else "string") for c in READ[:-1] if c not in events.columns}
    rows = events.withColumn("body", body).withColumns(missing).select("host", *READ)
    return rows.groupBy("host").transformWithStateInPandas(HostState(hold_seconds, most_seconds, reap_seconds), OUT, "Append", "ProcessingTime")


def opened(rows: DataFrame, kind: T.StructType) -> DataFrame:
    """OUT rows with the columns of the events (type `kind`) instead of the body, which bad rows keep as _raw; host, us
    and arrival_seq are OUT's."""
    event = F.from_json("body", kind, JSON)
    own = [c for c in OUT.fieldNames() if c != "body"]
    columns = [F.col(f"_event.`{f.name}`").alias(f.name) for f in kind.fields if f.name not in own]
    return rows.withColumn("_event", event).select(*own, *columns, F.when(F.col("kind") == "bad", F.col("body")).alias("_raw"))
