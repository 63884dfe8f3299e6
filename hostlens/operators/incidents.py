"""Performance incidents: detection, phases, correlation of processes, conclusion, evidence and related changes."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import duration_text, level_for, truncate_bytes
from ..schema import level_rank, struct_of
from .ordered import fold
from .windows import islands, level_timeline

# Default thresholds (warning, critical) and times in seconds.
THRESHOLDS = {"cpu": (80.0, 95.0), "memory": (85.0, 95.0), "disk": (85.0, 95.0)}
HISTORY_SECONDS = 120
TRIGGER_SECONDS, RECOVERY_SECONDS, POST_SECONDS = 30, 30, 30
LEAST_SHARE, LEAST_SCORE = 0.02, 40.0
MOST_CANDIDATES, MOST_RELATED, LOOKBACK_SECONDS = 5, 60, 1800
#: related(): length of a cell of time, cells that are summed up together, and events that an incident meets at once.
CELL_US, SPAN_CELLS, BLOCK_EVENTS = 1_800_000_000, 256, 64


def with_levels(samples: DataFrame, thresholds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Samples (columns cpu, memory, disk) with cpu_level, memory_level and disk_level."""
    limits = thresholds or THRESHOLDS
    return samples.withColumns({f"{k}_level": level_for(F.col(k), *limits[k]) for k in limits})


def worst_level(levels: Column) -> Column:
    """The worst level of a map from resource to level; normal for an empty one."""
    ranks = F.transform(F.map_values(levels), level_rank)
    return F.element_at(F.array(F.lit("normal"), F.lit("warning"), F.lit("critical")), F.coalesce(F.array_max(ranks), F.lit(0)).cast("int") + 1)


def detect(samples: DataFrame, keys: list[str], value: str, critical: float, seconds: int = TRIGGER_SECONDS, us: str = "us", tie: str = "id") -> DataFrame:
    """Runs at or above critical that last `seconds`: keys, start_us, trigger_us, end_us, peak, samples."""
    runs = islands(samples, keys, [us, tie], F.col(value) >= critical)
    runs = runs.withColumn("start_us", F.min(us).over(Window.partitionBy(*keys, "island")))
    hit = F.when(F.floor((F.col(us) - F.col("start_us")) / 1_000_000) >= seconds, F.col(us))
    out = runs.groupBy(*keys, "island").agg(F.min("start_us").alias("start_us"), F.min(hit).alias("trigger_us"), F.max(us).alias("end_us"), F.max(value).alias("peak"), F.count("*").alias("samples"))
    return out.filter("trigger_us IS NOT NULL").drop("island")


def recovered(samples: DataFrame, keys: list[str], value: str, critical: float, seconds: int = RECOVERY_SECONDS, us: str = "us", tie: str = "id") -> DataFrame:
    """Runs below critical that last `seconds`: keys, recovered_us (the run's start) and confirmed_us."""
    runs = islands(samples, keys, [us, tie], F.col(value) < critical)
    runs = runs.withColumn("recovered_us", F.min(us).over(Window.partitionBy(*keys, "island")))
    hit = F.when(F.floor((F.col(us) - F.col("recovered_us")) / 1_000_000) >= seconds, F.col(us))
    out = runs.groupBy(*keys, "island").agg(F.min("recovered_us").alias("recovered_us"), F.min(hit).alias("confirmed_us"))
    return out.filter("confirmed_us IS NOT NULL").drop("island")


# -- the incident machine of a host ----------------------------------------------------------------------------

PHASED = struct_of("incident_start BIGINT, kind STRING, phase STRING")


class Machine:
    """One incident at a time: opened by a sustained resource in the order cpu, memory, disk, closed some time after
    it has recovered. Rows that belong to an incident are kept with its start, resource and phase."""

    def __init__(self, thresholds: dict[str, tuple[float, float]], trigger: int, recovery: int, post: int):
        self.limits, self.trigger, self.recovery, self.post = thresholds, trigger, recovery, post
        self.since: dict[str, int] = {}
        self.active: dict | None = None

    def step(self, us: int, values: dict[str, float]) -> tuple[int, str, str] | None:
        due = []
        for kind, (_, critical) in self.limits.items():
            if values[kind] >= critical:
                since = self.since.setdefault(kind, us)
                if (us - since) // 1_000_000 >= self.trigger:
                    due.append(kind)
            else:
                self.since.pop(kind, None)
        a = self.active
        if a is None:
            if not due:
                return None
            self.active = a = {"start": us, "kind": due[0], "calm": None, "back": None}
            self.since.pop(due[0], None)
            return us, a["kind"], "during"
        phase = "during" if a["back"] is None else "post"
        if a["back"] is None:
            if values[a["kind"]] < self.limits[a["kind"]][1]:
                a["calm"] = us if a["calm"] is None else a["calm"]
                if (us - a["calm"]) // 1_000_000 >= self.recovery:
                    a["back"] = a["calm"]
            else:
                a["calm"] = None
        if a["back"] is not None and (us - a["back"]) // 1_000_000 >= self.post:
            self.active = None
        return a["start"], a["kind"], phase

    def feed(self, rows: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, list]]:
        kinds = list(self.limits)
        keep, out = [], {f.name: [] for f in PHASED.fields}
        for us, *values in zip(rows["us"].tolist(), *(rows[k].tolist() for k in kinds), strict=True):
            found = self.step(us, dict(zip(kinds, values, strict=True)))
            keep.append(found is not None)
            for c, v in zip(out.values(), found or (), strict=False):
                c.append(v)
        return np.array(keep, bool), out


def incident_samples(samples: DataFrame, key: str = "host", thresholds: dict | None = None, trigger: int = TRIGGER_SECONDS, recovery: int = RECOVERY_SECONDS, post: int = POST_SECONDS) -> DataFrame:
    """Samples (key, us, id, cpu, memory, disk) during and after incidents, each with incident_start, kind and phase."""
    limits = thresholds or THRESHOLDS
    return fold(samples, [key], ["us", "id"], partial(Machine, limits, trigger, recovery, post), PHASED, inputs=["us", *limits])


def phases(samples: DataFrame, incidents: DataFrame, key: str, history: int = HISTORY_SECONDS, us: str = "us") -> DataFrame:
    """Samples of each incident (key, trigger_us, confirmed_us, end_us) with phase pre, during or post.

    pre are the `history` seconds before the trigger, during lasts until recovery is confirmed, post until end_us.
    """
    width = max(history, 60) * 1_000_000
    i = incidents.select(F.col(key).alias("_key"), "trigger_us", "confirmed_us", "end_us")
    i = i.withColumn("_bucket", F.explode(F.sequence(F.floor((F.col("trigger_us") - history * 1_000_000) / width), F.floor(F.col("end_us") / width))))
    samples = samples.withColumn("_at", F.floor(F.col(us) / width))
    near = (F.col(key) == F.col("_key")) & (F.col("_at") == F.col("_bucket")) & (F.col(us) >= F.col("trigger_us") - history * 1_000_000) & (F.col(us) <= F.col("end_us"))
    phase = F.when(F.col(us) < F.col("trigger_us"), "pre").when(F.col(us) <= F.col("confirmed_us"), "during").otherwise("post")
    return samples.join(i, near).drop("_key", "_bucket", "_at").withColumn("phase", phase)


# -- correlation ------------------------------------------------------------------------------------------------


def process_metric(kind: Column, p: Column) -> Column:
    """What counts for a resource: cpu percent, bytes of memory, or bytes read and written a second."""
    return F.when(kind == "cpu", p["cpu_percent"]).when(kind == "memory", p["memory_bytes"]).when(kind == "disk", p["read_bytes_per_sec"] + p["write_bytes_per_sec"]).otherwise(0.0).cast("double")


def phase_averages(usage: DataFrame, ticks: DataFrame, keys: list[str]) -> DataFrame:
    """usage: keys, phase, name, v, a row for each process and tick; ticks: keys, phase, n (ticks of the phase, with or
    without processes) -> keys, name, baseline, incident and post, each a sum over the number of ticks."""
    per = usage.groupBy(*keys, "phase", "name").agg(F.sum("v").alias("v")).join(ticks, [*keys, "phase"])
    mean = F.col("v") / F.greatest(F.col("n"), F.lit(1))
    pick = lambda phase: F.coalesce(F.sum(F.when(F.col("phase") == phase, mean)), F.lit(0.0))
    return per.groupBy(*keys, "name").agg(pick("pre").alias("baseline"), pick("during").alias("incident"), pick("post").alias("post"))


def score(averages: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates with share, ramp, recovery and score (0 to 100); those under 2 % of all activity are dropped.

    The score is .55 share + .25 ramp-up + .20 recovery.
    """
    total = F.greatest(F.sum("incident").over(Window.partitionBy(*keys)), F.lit(1e-9))
    a = averages.filter(F.col("incident") > 0).withColumn("share", F.col("incident") / total).filter(F.col("share") >= LEAST_SHARE)
    rise = F.when(F.col("baseline") > 1e-9, (F.col("incident") - F.col("baseline")) / F.col("baseline")).otherwise(2.0)
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    a = a.withColumns({"ramp": unit(rise / 2), "recovery": F.when(F.col("incident") > 1e-9, unit((F.col("incident") - F.col("post")) / F.col("incident"))).otherwise(0.0)})
    return a.withColumn("score", 55.0 * unit(F.col("share")) + 25.0 * F.col("ramp") + 20.0 * F.col("recovery"))


def candidates(scored: DataFrame, keys: list[str], most: int = MOST_CANDIDATES) -> DataFrame:
    """The best candidates, by score and then name, with their place."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "name")
    return scored.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= most)


def conclude(incidents: DataFrame, best: DataFrame, keys: list[str]) -> DataFrame:
    """incidents (keys, kind) with probable_cause, category, confidence, quality and reason, from candidates in place 1."""
    b = best.filter("place = 1").select(*keys, F.col("name").alias("_name"), F.col("score").alias("_score"))
    out = incidents.join(b, keys, "left")
    known, sure = F.col("_score").isNotNull(), F.coalesce(F.col("_score") >= LEAST_SCORE, F.lit(False))
    general = F.when(F.col("kind") == "disk", "storage").otherwise(F.col("kind"))
    return out.withColumns(
        {
            "probable_cause": F.when(sure, F.col("_name")).when(known, F.concat(F.lit("Unknown — no single process clearly dominated "), "kind", F.lit(" contention"))).otherwise("Unknown"),
            "category": F.when(sure, "process").when(known, general).otherwise("unknown"),
            "confidence": F.coalesce(F.col("_score"), F.lit(0.0)),
            "quality": F.when(F.col("_score") >= 80, "high").when(F.col("_score") >= 55, "medium").otherwise("low"),
            "reason_if_unknown": F.when(~sure & known, "several processes contributed, none of them clearly most").when(~known, "too little telemetry during the incident"),
        }
    ).drop("_name", "_score")


def reasons(c: DataFrame) -> DataFrame:
    """Candidates with their reasons in words."""
    n = lambda x: F.format_string("%.1f", x)
    first = F.concat("name", F.lit(" averaged "), n(F.col("incident")), F.lit(" during the incident and "), n(F.col("baseline")), F.lit(" before"))
    fell = F.when(F.col("recovery") > 0.3, F.concat("name", F.format_string(" fell by %.0f%% after recovery", F.col("recovery") * 100)))
    part = F.concat("name", F.format_string(" made up %.0f%% of all activity", F.col("share") * 100))
    return c.withColumn("reasons", F.filter(F.array(first, fell, part), lambda x: x.isNotNull()))


def calm_resources(during: DataFrame, keys: list[str], levels: dict[str, str]) -> DataFrame:
    """keys and, for each resource, whether its level was normal in every sample; levels: resource -> level column."""
    return during.groupBy(*keys).agg(*[F.bool_and(F.coalesce(F.col(c), F.lit("normal")) == "normal").alias(f"{r}_calm") for r, c in levels.items()])


def incident_severity(during: DataFrame, keys: list[str], level: str = "level") -> DataFrame:
    """keys and severity, the worst level while the incident lasted; critical where there is none."""
    worst = F.max(level_rank(F.col(level))).cast("int")
    return during.groupBy(*keys).agg(F.element_at(F.array(F.lit("normal"), F.lit("warning"), F.lit("critical")), F.coalesce(worst, F.lit(2)) + 1).alias("severity"))


def timeline(samples: DataFrame, keys: list[str], level: str = "level", value: str = "value", us: str = "us", tie: str = "id") -> DataFrame:
    """level_timeline() of samples with their phase, and the fixed marks at both ends: keys, us, description.

    The last mark is at the end of the time after recovery, or where there is none at the end of the incident.
    """
    first = samples.filter("phase = 'pre'").groupBy(*keys).agg(F.min(us).alias(us)).withColumn("description", F.lit("Server normal"))
    ends = samples.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("phase") == "post", F.col(us))), F.max(F.when(F.col("phase") == "during", F.col(us)))).alias(us)).filter(F.col(us).isNotNull())
    marks = ends.withColumn("description", F.explode(F.array(F.lit("Server normal"), F.lit("Investigation completed"))))
    return level_timeline(samples, keys, level, value, us, tie).unionByName(first).unionByName(marks)


def report(incidents: DataFrame, server: str = "", numbers: DataFrame | None = None) -> DataFrame:
    """Incidents (host, kind, start_us, end_us, recovered_us, probable_cause, …) as report rows.

    end_us includes the time after recovery; duration_seconds and degraded_seconds tell both lengths. numbers (host,
    kind, start_us, number) are those that sinks.incidents keeps; without them the given incidents are numbered by time.
    """
    number = F.row_number().over(Window.partitionBy(F.year(F.timestamp_micros("start_us"))).orderBy("start_us", "host"))
    if numbers is not None:
        incidents, number = incidents.join(numbers.select("host", "kind", "start_us", F.col("number").alias("_number")), ["host", "kind", "start_us"]), F.col("_number")
    year = F.year(F.timestamp_micros("start_us"))
    seconds = F.floor((F.col("end_us") - F.col("start_us")) / 1_000_000)
    return incidents.withColumns(
        {
            "incident_id": F.format_string("INC-%d-%06d", year, number),
            "duration_seconds": seconds,
            "degraded_seconds": F.floor((F.col("recovered_us") - F.col("start_us")) / 1_000_000),
            "server": F.when(F.lit(server) != "", F.lit(server)).otherwise(F.col("host")),
            "impact": F.concat(F.lit("A "), "kind", F.lit(" incident of about "), duration_text(seconds)),
            "recommendation": F.concat(F.lit("Review "), "probable_cause", F.lit(" around "), F.date_format(F.timestamp_micros("start_us"), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")),
        }
    ).drop("_number")


def incident_events(reports: DataFrame) -> DataFrame:
    """Reports as events of category incident at their start."""
    return reports.select(
        "host", F.col("start_us").alias("us"), F.lit("incident").alias("category"), F.lit("incident.detected").alias("action"), F.lit("unknown").alias("outcome"), F.lit(3).alias("severity"),
        F.concat("incident_id", F.lit(": "), "impact", F.lit("; "), "probable_cause").alias("message"), F.to_json(F.struct("incident_id", "kind", "duration_seconds")).alias("details"),
    )


# -- related changes --------------------------------------------------------------------------------------------


def _earlier(cells: DataFrame) -> DataFrame:
    """host, _cell, _earlier: the _n of the host's earlier cells. Cells are summed by spans first, so no task has all of a host's."""
    cells = cells.withColumn("_span", F.floor(F.col("_cell") / SPAN_CELLS))
    before = lambda n, *keys: F.coalesce(F.sum(n).over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = cells.groupBy("host", "_span").agg(F.sum("_n").alias("_n")).select("host", "_span", before("_n", "host", "_span").alias("_spans"))
    return cells.withColumn("_cells", before("_n", "host", "_span", "_cell")).join(spans, ["host", "_span"], "left").select("host", "_cell", (F.col("_spans") + F.col("_cells")).alias("_earlier"))


def related(incidents: DataFrame, events: DataFrame, lookback: int = LOOKBACK_SECONDS, most: int = MOST_RELATED, compat: bool = False) -> DataFrame:
    """Events of an incident's host from `lookback` before its start to its end, with offset_seconds (toward zero).

    incidents: incident_id, host, start_us, end_us. Of more than `most` the newest are kept; compat keeps the oldest.
    A host's events are numbered in time order, by cells of time. The two ends of an incident are counted in the same
    order, which tells the numbers it keeps; it meets only the blocks of BLOCK_EVENTS events that hold those, so the
    join makes no more rows than the result needs, however dense the events are.
    """
    kept = [c for c in ("probable_cause",) if c in incidents.columns]
    own = ["incident_id", "host", "start_us", "_end", *kept]
    i = incidents.withColumn("_end", F.coalesce("end_us", "start_us")).select(*own).filter("host IS NOT NULL AND start_us IS NOT NULL")
    cell = F.floor(F.col("us") / CELL_US).alias("_cell")
    e = events.filter("host IS NOT NULL AND us IS NOT NULL").withColumn("_cell", cell)
    # Of rows at one time, the start of a window comes before the events, its end after them.
    ends = i.withColumn("_mark", F.explode(F.array(F.struct((F.col("start_us") - lookback * 1_000_000).alias("us"), F.lit(0).alias("kind")), F.struct(F.col("_end").alias("us"), F.lit(2).alias("kind")))))
    ends = ends.select("*", "_mark.us", F.col("_mark.kind").alias("_kind")).drop("_mark").withColumn("_cell", cell)
    rows = e.select("host", "us", "_cell", F.lit(1).alias("_kind")).unionByName(ends, allowMissingColumns=True)
    earlier = _earlier(rows.groupBy("host", "_cell").agg(F.count_if(F.col("_kind") == 1).alias("_n")))

    cells = Window.partitionBy("host", "_cell")
    counted = rows.withColumn("_n", F.count_if(F.col("_kind") == 1).over(cells.orderBy("us", "_kind").rowsBetween(Window.unboundedPreceding, 0))).filter("_kind <> 1")
    counted = counted.join(earlier, ["host", "_cell"]).withColumn("_n", F.col("_n") + F.col("_earlier"))
    i = counted.groupBy(*own).agg(F.max(F.when(F.col("_kind") == 0, F.col("_n"))).alias("_after"), F.max(F.when(F.col("_kind") == 2, F.col("_n"))).alias("_to"), F.count_if(F.col("_kind") == 2).alias("_copies"))
    i = i.withColumn("_same", F.sum("_copies").over(Window.partitionBy("incident_id")))
    i = i.withColumn("_to", F.least("_to", F.col("_after") + most)) if compat else i.withColumn("_after", F.greatest("_after", F.col("_to") - most))
    i = i.filter("_after < _to").withColumn("_block", F.explode(F.sequence(F.floor(F.col("_after") / BLOCK_EVENTS), F.floor((F.col("_to") - 1) / BLOCK_EVENTS))))
    i = i.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).withColumnRenamed("host", "_host")

    e = e.withColumn("_n", F.row_number().over(cells.orderBy("us", "id"))).join(earlier, ["host", "_cell"]).withColumn("_n", F.col("_n") + F.col("_earlier"))
    e = e.withColumn("_at", F.floor((F.col("_n") - 1) / BLOCK_EVENTS))
    hits = i.join(e, (F.col("host") == F.col("_host")) & (F.col("_at") == F.col("_block")) & (F.col("_n") > F.col("_after")) & (F.col("_n") <= F.col("_to")))
    hits = hits.select("_same", *events.columns, "incident_id", "start_us", *kept)
    # Incidents of one id share the `most` rows.
    order = [F.col("us").asc(), F.col("id").asc()] if compat else [F.col("us").desc(), F.col("id").desc()]
    shared = hits.filter("_same > 1").withColumn("_n", F.row_number().over(Window.partitionBy("incident_id").orderBy(*order))).filter(F.col("_n") <= most).drop("_n")
    hits = hits.filter("_same = 1").unionByName(shared).drop("_same")
    offset = ((F.col("us") - F.col("start_us")) / 1_000_000).cast("long")
    who = F.when(F.col("category").isin("file", "package", "service"), F.coalesce(F.concat(F.lit(" by "), "user"), F.lit(""))).otherwise("")
    return hits.withColumns({"offset_seconds": offset, "summary": truncate_bytes(F.concat("message", who), 300)})


def is_change(action: Column) -> Column:
    return action.rlike(r"^(?:file|package|service)\.")


def change_evidence(found: DataFrame) -> DataFrame:
    """related() rows with probable_cause -> incident_id, changes, latest and culprit (the three nearest that name it)."""
    before = found.filter((F.col("offset_seconds") <= 0) & is_change(F.col("action")))
    stem = F.regexp_replace(F.lower("probable_cause"), r"(?:\.exe)+$", "")
    names_it = (F.octet_length(stem) >= 3) & ~F.startswith(F.lower("probable_cause"), F.lit("unknown")) & F.contains(F.lower("summary"), stem)
    row = F.struct(F.col("offset_seconds"), F.col("id"), F.col("summary"))
    near = before.withColumn("_names", names_it).withColumn("_n", F.row_number().over(Window.partitionBy("incident_id", "_names").orderBy(F.col("offset_seconds").desc(), F.col("id").desc())))
    return near.groupBy("incident_id").agg(
        F.count("*").alias("changes"),
        F.max(row)["summary"].alias("latest"),
        F.max("offset_seconds").alias("latest_offset"),
        F.reverse(F.array_sort(F.collect_list(F.when(F.col("_names") & (F.col("_n") <= 3), row)))).alias("culprit"),
    )
