"""Package manager logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .build import event, events_of, group

# What the logs call an installation, an upgrade and a removal.
DPKG = {"install": "package.installed", "upgrade": "package.upgraded", "remove": "package.removed", "purge": "package.removed"}
RPM = {
    "Installed": "package.installed", "Install": "package.installed", "Upgrade": "package.upgraded", "Downgrade": "package.upgraded", "Reinstall": "package.upgraded",
    "Erase": "package.removed", "Obsoleted": "package.removed",
}
VERBS = {"package.installed": "Installed", "package.upgraded": "Upgraded", "package.removed": "Removed"}


def _map(values: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c)


def package_event(action: Column, name: Column, version: Column, previous: Column) -> Column:
    text = F.concat_ws(" ", _map(VERBS, action), name, version)
    return event("package", action, text, outcome="success", target=name, details={"version": version, "previous_version": previous})


def split_nevra(c: Column) -> tuple[Column, Column]:
    """name-version-release.arch -> name, and version-release.arch: all before the second-last dash is the name."""
    p = r"^(.*)-([^-]*-[^-]*)$"
    return F.when(c.rlike(p), F.regexp_extract(c, p, 1)).otherwise(c), F.when(c.rlike(p), F.regexp_extract(c, p, 2)).otherwise("")


def read_dpkg(lines: DataFrame, zone: str = "UTC", column: str = "value") -> DataFrame:
    """`2026-09-25 10:00:00 upgrade nginx:amd64 1.22 1.24`"""
    f = F.split(F.trim(column), r"\s+")
    at = lambda k: F.get(f, F.lit(k))
    action = _map(DPKG, at(2))
    name = F.element_at(F.split(at(3), ":"), 1)
    new = F.coalesce(at(5), F.lit(""))
    version = F.when(action == "package.removed", at(4)).otherwise(new)
    previous = F.when(action == "package.upgraded", at(4))
    ts = F.to_utc_timestamp(F.try_to_timestamp(F.concat_ws(" ", at(0), at(1)), F.lit("yyyy-MM-dd HH:mm:ss")), zone)
    good = action.isNotNull() & at(4).isNotNull() & ts.isNotNull()
    return events_of(lines, F.when(good, package_event(action, name, version, previous)), ts)


def read_rpm(lines: DataFrame, column: str = "value") -> DataFrame:
    """`2026-09-25T10:00:00+0000 SUBDEBUG Upgrade: nginx-1:1.24.0-1.el9.x86_64`; lines for the old package are skipped."""
    p = r"^(\S+)\s+SUBDEBUG\s+([A-Za-z]+): (.*)$"
    ts = F.try_to_timestamp(group(F.col(column), p, 1), F.lit("yyyy-MM-dd'T'HH:mm:ssxx"))
    action = _map(RPM, group(F.col(column), p, 2))
    name, version = split_nevra(F.trim(F.regexp_extract(column, p, 3)))
    good = action.isNotNull() & ts.isNotNull()
    return events_of(lines, F.when(good, package_event(action, name, version, F.lit(None))), ts)
