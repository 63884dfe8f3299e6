"""The rules in a stream: what each address, user and rule has to remember, as keyed state.

An event is sent, once each, to those of its keys that remember something: its address (failures and logins), its user
(logins), and the rule and cooldown key of each rule that it alone meets (rules.single_event_hits). All events also
pass through unchanged, dealt out by a hash, so one stream carries both the events and what fired on them.

State by key, in variables of their own:
* an address: the times and users of its failures within five windows, and when each rule last fired;
* a user: the addresses of earlier logins;
* a rule's key: when it last fired.
Variables are forgotten `ttl_hours` after they were last written, except users' addresses, which are what makes a new
one new. An address keeps at most `MOST_FAILURES` failures, the newest: the counts in its alerts end there, and whether
a threshold is passed does not change, as thresholds lie far below. So what a batch reads and writes depends on its own
events, not on how long the stream has run.

Rows of a key are taken in order of time and id. Of rows at one time all count, as in the batch forms; a row that is
later than others of its key counts those before it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..functions.scalars import is_meaningful_ip, norm_user
from ..operators import rules
from ..schema import struct_of
from ..session import ship

MOST_FAILURES = 20_000
PASSES = 64  # keys that events are dealt to
LOGINS = ("session.start", "auth.success")

#: A row on its way: route is `pass|n`, `ip|address`, `user|name` or `rule|rule|key`; flag: a failure, or a trusted address.
ROUTED = struct_of("route STRING, us BIGINT, id BIGINT, flag BOOLEAN, user STRING, src_ip STRING, rule STRING, cooldown_key STRING, severity INT, title STRING, notify BOOLEAN, body STRING")
#: An event (rule null, with its body) or an alert on event `id` (n: the number that windowed rules found).
FIRED = struct_of("id BIGINT, us BIGINT, rule STRING, cooldown_key STRING, severity INT, title STRING, notify BOOLEAN, n BIGINT, body STRING")


class Failures:
    """Failures of an address: the number and the distinct users within a span up to a time."""

    def __init__(self, rows: list[tuple[int, str]]):
        rows = sorted(rows)
        self.times, self.users = [t for t, _ in rows], [u for _, u in rows]
        self.span = (0, 0)
        self.seen: Counter = Counter()

    def add(self, us: int, user: str) -> None:
        at = bisect_right(self.times, us)
        self.times.insert(at, us)
        self.users.insert(at, user)
        if at < self.span[1]:
            self.span, self.seen = (0, 0), Counter()

    def count(self, us: int, span: int) -> int:
        return bisect_right(self.times, us) - bisect_left(self.times, us - span)

    def distinct(self, us: int, span: int) -> int:
        a, b = bisect_left(self.times, us - span), bisect_right(self.times, us)
        if a < self.span[0] or b < self.span[1]:
            self.span, self.seen = (a, a), Counter()
        start, end = self.span
        self.seen.update(self.users[max(end, a) : b])
        for u in self.users[start : min(a, end)]:
            self.seen[u] -= 1
            if not self.seen[u]:
                del self.seen[u]
        self.span = (a, b)
        return len(self.seen)


class RuleState(StatefulProcessor):
    """See the module."""

    def __init__(self, settings: rules.Settings, ttl_hours: int):
        self.s, self.ttl = settings, ttl_hours * 3_600_000

    def init(self, handle) -> None:
        self.failures = handle.getListState("failures", "us BIGINT, user STRING", self.ttl)
        self.fired = handle.getMapState("fired", "rule STRING", "us BIGINT", self.ttl)
        self.sources = handle.getMapState("sources", "src_ip STRING", "us BIGINT")
        self.known = handle.getValueState("known", "n BIGINT")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kind = key[0].partition("|")[0]
        if kind == "pass":
            for df in rows:
                yield self._frame([(i, u, None, None, None, None, None, None, b) for i, u, b in zip(df["id"].tolist(), df["us"].tolist(), df["body"].tolist(), strict=True)])
            return
        df = pd.concat(list(rows)).sort_values(["us", "id"], kind="stable")
        yield self._frame({"ip": self._address, "user": self._user, "rule": self._rule}[kind](list(df[ROUTED.fieldNames()].itertuples(index=False))))

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=FIRED.fieldNames()).astype({"id": "Int64", "us": "Int64", "severity": "Int32", "notify": "boolean", "n": "Int64"})

    def _cool(self, rule: str, us: int) -> bool:
        """Whether the rule may fire for this key; if so, it has."""
        last = self.fired.getValue((rule,))[0] if self.fired.containsKey((rule,)) else None
        fires = last is None or us < last or us - last >= self.s.cooldown_seconds * 1_000_000
        if fires:
            self.fired.updateValue((rule,), (us,))
        return fires

    def _fires(self, r, rule: str) -> bool:
        return rule not in (r.rule or "").split(",") and self._cool(rule, int(r.us))

    def _address(self, rows: list) -> list[tuple]:
        window = self.s.window_seconds * 1_000_000
        f, out, at = Failures([(t, u) for t, u in self.failures.get()] if self.failures.exists() else []), [], 0
        while at < len(rows):
            end = at
            while end < len(rows) and rows[end].us == rows[at].us:
                if rows[end].flag:
                    f.add(int(rows[end].us), rows[end].user if isinstance(rows[end].user, str) else "")
                end += 1
            for r in rows[at:end]:
                us = int(r.us)
                if r.flag:
                    n = f.distinct(us, window)
                    if n >= self.s.spray_users:
                        if self._fires(r, "password_spray"):
                            out.append(self._alert(r, "password_spray", r.src_ip, n))
                        if self._cool("instead of bruteforce", us):
                            continue
                    n = f.count(us, window)
                    if n >= self.s.failure_threshold and self._fires(r, "bruteforce"):
                        out.append(self._alert(r, "bruteforce", r.src_ip, n))
                elif (n := f.count(us, 5 * window)) >= self.s.success_failures and self._fires(r, "success_after_failures"):
                    out.append(self._alert(r, "success_after_failures", r.src_ip, n))
            at = end
        kept = bisect_left(f.times, (f.times[-1] if f.times else 0) - 5 * window)
        kept = max(kept, len(f.times) - MOST_FAILURES)
        self.failures.put(list(zip(f.times[kept:], f.users[kept:], strict=True))) if f.times[kept:] else self.failures.clear()
        return out

    def _user(self, rows: list) -> list[tuple]:
        out, prior = [], self.known.get()[0] if self.known.exists() else 0
        before = prior
        for r in rows:
            if not self.sources.containsKey((r.src_ip,)):
                self.sources.updateValue((r.src_ip,), (int(r.us),))
                if prior and not r.flag and "new_source" not in (r.rule or ""):
                    who = r.user if isinstance(r.user, str) else ""
                    out.append(self._alert(r, "new_source", f"{who}|{r.src_ip}", prior))
                prior += 1
        if prior != before:
            self.known.update((prior,))
        return out

    def _rule(self, rows: list) -> list[tuple]:
        fired = [r for r in rows if self._cool("", int(r.us))]
        return [(r.id, r.us, r.rule, r.cooldown_key, r.severity, r.title, r.notify, None, None) for r in fired]

    def _alert(self, r, rule: str, key: str, n: int) -> tuple:
        return (r.id, r.us, rule, key, rules.WINDOWED[rule], None, None, n, None)


def _row(own: dict[str, Column]) -> Column:
    """A ROUTED struct of an event, with what is its own."""
    base = {c: F.col(c) for c in ("us", "id", "user", "src_ip")} | own
    return F.struct(*[base.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ROUTED.fields])


def routed(events: DataFrame, body: Column, s: rules.Settings, custom: list[rules.CustomRule] | None = None, suppress: list[rules.Suppression] | None = None) -> DataFrame:
    """ROUTED rows of events: a projection that is exploded once, so a stream's source is read once.

    What is suppressed is not sent: an alert on its own event is dropped, and for the rules that look back the events
    on which they may not fire say so (rule: their names), and count for later ones all the same."""
    suppress = suppress or []
    events, found = rules.hits_of_each(events.withColumn("_body", body), s, custom)
    quiet = lambda rule: rules.suppressed(suppress, F.lit(rule))
    remote = is_meaningful_ip(F.col("src_ip")) & F.col("us").isNotNull()
    failure, login = F.col("action") == "auth.failure", F.col("action").isin(*LOGINS)
    deal = F.pmod(F.xxhash64("id", "us", "host"), F.lit(PASSES)).cast("string")
    muted = F.filter(F.array(*[F.when(quiet(r), F.lit(r)) for r in rules.WINDOWED]), lambda x: x.isNotNull())
    muted = F.array_join(muted, ",")
    ways = [
        _row({"route": F.concat(F.lit("pass|"), deal), "body": F.col("_body")}),
        F.when(remote & (failure | login), _row({"route": F.concat(F.lit("ip|"), "src_ip"), "flag": failure, "rule": muted})),
    ]
    if s.new_source:
        ways.append(F.when(remote & (F.col("action") == "session.start"), _row({"route": F.concat(F.lit("user|"), norm_user(F.coalesce("user", F.lit("")))), "flag": s.is_trusted(F.col("src_ip")), "rule": muted})))
    told = ("rule", "cooldown_key", "severity", "title", "notify")
    if suppress:
        found = F.filter(found, lambda h: ~rules.suppressed(suppress, h["rule"]))
    alone = F.transform(found, lambda h: _row({"route": F.concat(F.lit("rule|"), h["rule"], F.lit("|"), F.coalesce(h["cooldown_key"], F.lit("")))} | {c: h[c] for c in told}))
    alone = F.when(F.col("us").isNotNull(), alone)
    every = F.concat(F.filter(F.array(*ways), lambda w: w.isNotNull()), F.coalesce(alone, F.array().cast(T.ArrayType(ROUTED))))
    return events.select(F.explode(every).alias("_way")).select("_way.*")


def fired(events: DataFrame, body: Column, s: rules.Settings = rules.Settings(), custom: list[rules.CustomRule] | None = None, suppress: list[rules.Suppression] | None = None, ttl_hours: int = 24) -> DataFrame:
    """FIRED rows of a stream of events (unique id, us): the events with `body`, and the alerts that cooldowns let fire.

    Events without a time are stored and meet no rule: they have no place in a cooldown. Needs the RocksDB state store."""
    ship(events.sparkSession)
    rows = routed(events, body, s, custom, suppress)
    return rows.groupBy("route").transformWithStateInPandas(RuleState(s, ttl_hours), FIRED, "Append", "ProcessingTime")


def with_titles(alerts: DataFrame, s: rules.Settings) -> DataFrame:
    """Alerts (with the columns of their events) with the titles of the rules that look back."""
    title = F.col("title")
    for rule in rules.WINDOWED:
        title = F.when(F.col("rule") == rule, rules.windowed_title(rule, F.col("n"), s)).otherwise(title)
    return alerts.withColumn("title", title)
