"""Sliding counts, first occurrences, islands and state changes, as window functions over keyed, ordered events.

Every window here has a partition key (an address, a user, a host), so no event stream is ordered in one task; sliding
counts are cut by time as well, so a hot key is not one task either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import norm_user
from ..schema import level_rank


def _width(seconds: int) -> int:
    """Microseconds of a time bucket: four spans, so that an event's span reaches into one further bucket at most."""
    return max(1, 4 * seconds) * 1_000_000


def _covered(events: DataFrame, key: str, until: Column, weight: Column, name: str, us: str, seconds: int) -> DataFrame:
    """Events with the weight of all events of their key that cover their time; one covers its own time up to `until`,
    `seconds` later at most.

    Each event adds its weight at its time and takes it back just after `until`, and a running sum is read at each. So a
    key with many events within a span costs in proportion to them; a frame of that span would be summed up anew for
    each row. Rows that only take back carry no other columns.

    A key's time is cut into buckets, each summed up by itself: an event that reaches into the next bucket adds its
    weight there from the bucket's start on. So a key with most of the events is many tasks' work.
    """
    width = _width(seconds)
    row = F.struct(*[F.col(f"`{c}`") for c in events.columns if c != name])
    none, by = F.when(F.lit(False), row), weight.cast("long")
    own = F.floor(F.col(us) / width)
    last = F.greatest(own, F.floor(until / width))
    turn = lambda row, bucket, at, by: F.struct(row.alias("row"), bucket.alias("bucket"), at.cast("long").alias("at"), by.alias("by"))
    at, back = turn(row, own, F.col(us), by), turn(none, last, until + 1, -by)
    carry = turn(none, last, last * width, by)
    turns = F.when(weight == 0, F.array(at)).when(last > own, F.array(at, carry, back)).otherwise(F.array(at, back))
    out = events.select(F.col(key).alias("of"), F.explode(turns).alias("turn")).select("of", "turn.*")
    running = Window.partitionBy("of", "bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn("total", F.sum("by").over(running)).filter("row IS NOT NULL").select("row.*", F.col("total").alias(name))


def sliding_count(events: DataFrame, key: str, seconds: int, name: str = "recent", us: str = "us") -> DataFrame:
    """Events of the key in the `seconds` up to each, itself and both ends included."""
    return _covered(events, key, F.col(us) + F.lit(seconds * 1_000_000), F.lit(1), name, us, seconds)


def sliding_distinct(events: DataFrame, key: str, value: str, seconds: int, name: str = "distinct_recent", us: str = "us") -> DataFrame:
    """Distinct values of the key in the `seconds` up to each event; a null counts as the empty value.

    An event covers the time until its value comes again, so that each value counts once. When it comes again is found
    by time buckets, too: an event also stands, as a guest, in the bucket before its own if it lies within the span of
    that bucket's end.
    """
    span, width = F.lit(seconds * 1_000_000), _width(seconds)
    own = F.floor(F.col(us) / width)
    row = F.struct(*[F.col(f"`{c}`") for c in events.columns])
    places = F.when(F.col(us) - own * width <= span, F.array(F.struct(own.alias("bucket"), row.alias("row")), F.struct((own - 1).alias("bucket"), F.when(F.lit(False), row).alias("row")))).otherwise(F.array(F.struct(own.alias("bucket"), row.alias("row"))))
    spread = events.select(F.col(key).alias("of"), F.coalesce(F.col(value), F.lit("")).alias("value"), F.col(us).alias("at"), F.explode(places).alias("place")).select("of", "value", "at", "place.*")
    again = F.lead("at").over(Window.partitionBy("of", "value", "bucket").orderBy("at", F.col("row").isNull()))
    e = spread.withColumn("_again", again).filter("row IS NOT NULL").select("row.*", "_again")
    until = F.least(F.col(us) + span, F.col("_again") - 1)
    return _covered(e, key, until, F.lit(1), name, us, seconds).drop("_again")


def failures_before(events: DataFrame, key: str, seconds: int, is_failure: Column, name: str = "failures", us: str = "us") -> DataFrame:
    """Failures of the key in the `seconds` up to each event."""
    weight = F.when(is_failure, 1).otherwise(0)
    return _covered(events, key, F.col(us) + F.lit(seconds * 1_000_000), weight, name, us, seconds)


def source_history(logins: DataFrame) -> DataFrame:
    """Logins (user, src_ip, us, id) with first_seen (is this the pair's first) and prior (the user's addresses before)."""
    user = norm_user(F.col("user"))
    logins = logins.withColumn("user_key", user)
    pair = Window.partitionBy("user_key", "src_ip").orderBy("us", "id")
    logins = logins.withColumn("first_seen", F.row_number().over(pair) == 1)
    before = Window.partitionBy("user_key").orderBy("us", "id").rowsBetween(Window.unboundedPreceding, -1)
    return logins.withColumn("prior", F.coalesce(F.sum(F.col("first_seen").cast("long")).over(before), F.lit(0)))


def known_sources(logins: DataFrame) -> DataFrame:
    """First and last time and number of logins of each user and address."""
    return logins.groupBy(norm_user(F.col("user")).alias("user"), "src_ip").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("logins"))


def merge_known_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """known_sources of old and new events together, from their two rollups."""
    both = old.unionByName(new)
    return both.groupBy("user", "src_ip").agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("logins").alias("logins"))


def state_changes(states: DataFrame, keys: list[str], state: str, order: list[str], unknown: str = "unknown") -> DataFrame:
    """Rows whose state differs from the key's row before, neither of them unknown, with old_state."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = states.withColumn("old_state", F.lag(state).over(w))
    return out.filter((F.col("old_state") != F.col(state)) & (F.col("old_state") != unknown) & (F.col(state) != unknown))


def islands(samples: DataFrame, keys: list[str], order: list[str], inside: Column, name: str = "island") -> DataFrame:
    """Rows for which `inside` holds, numbered by the contiguous run they belong to within their keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = samples.withColumn("_in", F.coalesce(inside, F.lit(False)))
    out = out.withColumn(name, F.sum((~F.col("_in")).cast("long")).over(w))
    return out.filter("_in").drop("_in")


def sustained(samples: DataFrame, keys: list[str], inside: Column, seconds: int, us: str = "us", tie: str = "id") -> DataFrame:
    """For each run in which `inside` holds for at least `seconds`: keys, start_us, trigger_us (the first sample by
    which it has), end_us and samples."""
    runs = islands(samples, keys, [us, tie], inside)
    runs = runs.withColumn("start_us", F.min(us).over(Window.partitionBy(*keys, "island")))
    hit = F.when(F.col(us) - F.col("start_us") >= seconds * 1_000_000, F.col(us))
    out = runs.groupBy(*keys, "island").agg(F.min("start_us").alias("start_us"), F.min(hit).alias("trigger_us"), F.max(us).alias("end_us"), F.count("*").alias("samples"))
    return out.filter("trigger_us IS NOT NULL").drop("island")


def gap_sessions(events: DataFrame, key: str, seconds: int, us: str = "us", tie: str = "id") -> DataFrame:
    """Runs of a key's events with no gap over `seconds`: key, first_us, last_us, events."""
    w = Window.partitionBy(key).orderBy(us, tie)
    new = (F.col(us) - F.lag(us).over(w)) > seconds * 1_000_000
    out = events.withColumn("_new", F.coalesce(new, F.lit(True)).cast("long")).withColumn("_run", F.sum("_new").over(w))
    return out.groupBy(key, "_run").agg(F.min(us).alias("first_us"), F.max(us).alias("last_us"), F.count("*").alias("events")).drop("_run")


def heartbeat_gaps(beats: DataFrame, key: str, seconds: int, us: str = "us", tie: str = "id") -> DataFrame:
    """Rows that follow a gap over `seconds`, with offline_seconds and severity medium."""
    w = Window.partitionBy(key).orderBy(us, tie)
    gap = F.floor((F.col(us) - F.lag(us).over(w)) / 1_000_000)
    return beats.withColumn("offline_seconds", gap).filter(F.col("offline_seconds") > seconds).withColumn("severity", F.lit(2))


def level_timeline(samples: DataFrame, keys: list[str], level: str = "level", value: str = "value", us: str = "us", tie: str = "id") -> DataFrame:
    """Changes of level, the start of the investigation, and the peak: keys, us, description.

    Before the first sample the level is normal; the peak is the first sample with the largest value.
    """
    w = Window.partitionBy(*keys).orderBy(us, tie)
    s = samples.withColumn("_old", F.coalesce(F.lag(level).over(w), F.lit("normal")))
    text = F.when((F.col(level) == "warning") & (F.col("_old") == "normal"), "Resource warning").when(F.col(level) == "critical", "Critical threshold crossed")
    text = text.when(F.col(level) == "warning", "Resource level decreased to warning").otherwise("Recovery started")
    turns = s.filter(F.col(level) != F.col("_old")).select(*keys, us, text.alias("description"))
    first = s.filter(level_rank(F.col(level)) == 2).groupBy(*keys).agg(F.min(us).alias(us)).withColumn("description", F.lit("Investigation started"))
    peak = s.groupBy(*keys).agg(F.max_by(us, F.struct(F.col(value), -F.col(us))).alias(us)).withColumn("description", F.lit("Peak activity"))
    return turns.unionByName(first).unionByName(peak)


def before_trigger(samples: DataFrame, triggers: DataFrame, key: str, seconds: int, us: str = "us") -> DataFrame:
    """Samples of a trigger's key in the `seconds` before trigger_us, the trigger's own moment excluded.

    Both sides carry a time bucket as wide as the window, so this is an equi join on key and bucket.
    """
    width = seconds * 1_000_000
    t = triggers.select(F.col(key).alias("_key"), F.col("trigger_us"))
    t = t.withColumn("_bucket", F.explode(F.array(F.floor(F.col("trigger_us") / width), F.floor(F.col("trigger_us") / width) - 1)))
    s = samples.withColumn("_at", F.floor(F.col(us) / width))
    near = (s[key] == t["_key"]) & (s["_at"] == t["_bucket"]) & (s[us] < t["trigger_us"]) & (s[us] >= t["trigger_us"] - width)
    return s.join(t, near).drop("_key", "_bucket", "_at")


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "place") -> DataFrame:
    """The first k rows of each key, with their place from 1."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col(name) <= k)
