"""Sessions, and sending this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Streams with state variables and timers need it.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_shipped: set[str] = set()


def session(name: str = "hostlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution, as the operators expect; conf keys take __ for dots."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package: once per application, as a zip that Spark sends out."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="hostlens-"), "hostlens-package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Where it is unset, only a local master gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="hostlens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")
