"""Incidents that are kept: numbers that stay with them, and a JSON and an HTML file for each.

An incident is known by its host, kind and start. It has its number from when it is first saved, also if an earlier one
is found later; new ones go on from the last number of their year. Numbers are committed before files are written, and
files are named after them, so saving again, after a fault or with more facts, replaces them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import html_escape
from ..operators.incidents import report
from ..session import ship
from .commits import Store

KEY = ("host", "kind", "start_us")


class IncidentFiles:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.store = Store(spark, f"{self.path}/numbers")

    def numbers(self) -> DataFrame:
        """host, kind, start_us, year, number of all incidents that were saved."""
        rows = self.store.read("numbers")
        return rows if rows is not None else self.spark.createDataFrame([], "host string, kind string, start_us long, year int, number long")

    def save(self, incidents: DataFrame, server: str = "") -> DataFrame:
        """Incidents (see operators.incidents.report) as reports with their numbers; writes `incidents/<id>.json` and
        `reports/<id>.html` for each of them."""
        tx = self.store.begin()
        known = self.numbers()
        new = incidents.select(*KEY).distinct().join(known, list(KEY), "left_anti").withColumn("year", F.year(F.timestamp_micros("start_us")))
        place = F.row_number().over(Window.partitionBy("year").orderBy("start_us", "host", "kind"))  # what is new alone
        last = known.groupBy("year").agg(F.max("number").alias("last"))
        numbered = new.withColumn("place", place).join(last, "year", "left").select(*KEY, "year", (F.col("place") + F.coalesce("last", F.lit(0))).cast("long").alias("number"))
        if tx.append("numbers", numbered).head(1):
            tx.commit()
        reports = report(incidents, server, self.numbers())
        self._write(reports)
        return reports

    def _write(self, reports: DataFrame) -> None:
        ship(self.spark)
        fact = lambda c: F.concat(F.lit(f"<li>{c}: "), html_escape(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))), F.lit("</li>"))
        page = F.concat(F.lit("<!doctype html><html><head><meta charset='utf-8'><title>"), "incident_id", F.lit("</title></head><body><h1>Incident "), "incident_id", F.lit("</h1><ul>"), *[fact(c) for c, kind in reports.dtypes if "<" not in kind], F.lit("</ul></body></html>"))
        rows = reports.select("incident_id", F.to_json(F.struct(*[F.col(f"`{c}`") for c in reports.columns])).alias("json"), page.alias("html"))
        folder = self.path

        def put(part: Iterator) -> None:
            from pyarrow import fs

            at, base = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
            for kind in ("incidents", "reports"):
                at.create_dir(f"{base}/{kind}", recursive=True)
            for r in part:
                for name, text in ((f"incidents/{r.incident_id}.json", r.json), (f"reports/{r.incident_id}.html", r.html)):
                    with at.open_output_stream(f"{base}/{name}") as out:
                        out.write(text.encode())

        rows.foreachPartition(put)
