"""Hash chains, retention, blobs and file baselines."""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.redact import redact
from ..functions.scalars import GENESIS, UNIT_SEPARATOR, is_text, row_hash
from ..schema import struct_of
from .ordered import fold

MOST_HASHED_BYTES, MOST_KEPT_BYTES = 64 << 20, 256 << 10

#: What a row's hash covers, in order.
HASHED = ("ts", "host", "category", "action", "outcome", "severity", "user", "src_ip", "session_id", "process", "target", "message", "details", "before_sha", "after_sha")

CHAIN = struct_of("prev_hash STRING, hash STRING")


class Chain:
    """The head of one chain."""

    def __init__(self, head: str = GENESIS):
        self.head = head

    def feed(self, rows: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, list]]:
        previous, own = [], []
        for text in rows["chain_text"].tolist():
            previous.append(self.head)
            self.head = hashlib.sha256((self.head + text).encode()).hexdigest()
            own.append(self.head)
        return np.ones(len(own), bool), {"prev_hash": previous, "hash": own}


def chain_text(columns: list[Column]) -> Column:
    """What is hashed after the previous hash."""
    return F.concat(*[F.concat(F.lit(UNIT_SEPARATOR), F.coalesce(c.cast("string"), F.lit(""))) for c in columns])


def build_chain(events: DataFrame, shard: list[str], order: list[str], columns: list[str], head: str = GENESIS) -> DataFrame:
    """Events with prev_hash and hash: a chain for each shard (say host and day), linked in order.

    A chain is sequential by definition; shards are what runs in parallel. Texts are put together by Spark, and each
    task only folds the hashes.
    """
    rows = events.withColumn("chain_text", chain_text([F.col(f"`{c}`") for c in columns]))
    return fold(rows, shard, order, partial(Chain, head), CHAIN, inputs=["chain_text"]).drop("chain_text")


CONTINUED = struct_of("seq BIGINT, prev_hash STRING, hash STRING")


class ContinuedChain(Chain):
    """A chain that goes on from where its first row, a stored head, says; the head itself is not handed on."""

    def __init__(self):
        super().__init__()
        self.rows = 0

    def feed(self, rows: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, list]]:
        start = 0
        if rows["_head"][0] is not None:
            self.head, self.rows, start = rows["_head"][0], int(rows["_rows"][0]), 1
        _, out = super().feed({"chain_text": rows["chain_text"][start:]})
        n = len(out["hash"])
        self.rows += n
        keep = np.ones(start + n, bool)
        keep[:start] = False
        return keep, {"seq": list(range(self.rows - n + 1, self.rows + 1))} | out


def continue_chain(rows: DataFrame, heads: DataFrame | None, shard: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """rows with seq, prev_hash and hash, where each shard's chain goes on from its head (shard, head, rows: how many
    rows it has had).

    A head goes with its shard's rows as a row before all others, so nothing is joined or looked up."""
    own = rows.withColumns({"chain_text": chain_text([F.col(f"`{c}`") for c in columns]), "_head": F.lit(None).cast("string"), "_rows": F.lit(None).cast("long"), "_first": F.lit(1)})
    if heads is not None:
        known = heads.join(rows.select(*shard).distinct(), shard, "left_semi")
        known = known.select(*shard, F.col("head").alias("_head"), F.col("rows").alias("_rows"), F.lit(0).alias("_first"))
        own = own.unionByName(known, allowMissingColumns=True)
    return fold(own, shard, ["_first", *order], ContinuedChain, CONTINUED, inputs=["chain_text", "_head", "_rows"]).drop("chain_text", "_head", "_rows", "_first")


def next_heads(chained: DataFrame, heads: DataFrame | None, shard: list[str]) -> DataFrame:
    """The heads after `chained`: shard, head, rows."""
    new = chained.groupBy(*shard).agg(F.max_by("hash", "seq").alias("head"), F.max("seq").alias("rows"))
    return new if heads is None else new.unionByName(heads.join(new.select(*shard), shard, "left_anti").select(*new.columns))


def verify(events: DataFrame, shard: list[str], columns: list[str], order: str = "id", anchors: DataFrame | None = None, heads: DataFrame | None = None, gapless: bool = True) -> DataFrame:
    """Problems of chains: shard, the row's order column, and problem.

    start: a chain begins neither at genesis nor at its anchor (shard, anchor). link: a row does not name the hash of
    the one before. gap: ids are missing. content: the hash is not that of the row. head: the chain does not end at the
    stored head (shard, head, rows), as when the newest rows are gone.
    """
    w = Window.partitionBy(*shard).orderBy(order)
    e = events.withColumns({"_before": F.lag("hash").over(w), "_last": F.lag(order).over(w), "_first": F.row_number().over(w) == 1})
    anchor = F.lit(None).cast("string")
    if anchors is not None:
        e, anchor = e.join(anchors.select(*shard, "anchor"), shard, "left"), F.col("anchor")
    checks = {
        "start": F.col("_first") & (F.col("prev_hash") != GENESIS) & ~F.coalesce(F.col("prev_hash") == anchor, F.lit(False)),
        "link": ~F.col("_first") & (F.col("prev_hash") != F.col("_before")),
        "gap": F.lit(gapless) & ~F.col("_first") & (F.col(order) != F.col("_last") + 1),
        "content": F.col("hash") != row_hash(F.col("prev_hash"), [F.col(f"`{c}`") for c in columns]),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())
    out = e.select(*shard, order, F.explode(found).alias("problem"))
    if heads is not None:
        ends = events.groupBy(*shard).agg(F.max_by("hash", order).alias("_hash"), F.max(order).alias(order), F.count("*").alias("_rows"))
        bad = heads.join(ends, shard, "left").filter(~F.col("head").eqNullSafe(F.col("_hash")) | ~F.col("rows").eqNullSafe(F.col("_rows")))
        out = out.unionByName(bad.select(*shard, order, F.lit("head").alias("problem")))
    return out


def chain_heads(events: DataFrame, shard: list[str], order: str = "id") -> DataFrame:
    """What verify needs to see that newest rows are gone: shard, head, rows."""
    return events.groupBy(*shard).agg(F.max_by("hash", order).alias("head"), F.count("*").alias("rows"))


def retention_boundary(events: DataFrame, shard: list[str], cutoff_us: int, order: str = "id") -> DataFrame:
    """shard, boundary (the largest id older than the cutoff) and anchor (its hash)."""
    return events.filter(F.col("us") < cutoff_us).groupBy(*shard).agg(F.max(order).alias("boundary"), F.max_by("hash", order).alias("anchor"))


def prune(events: DataFrame, boundaries: DataFrame, shard: list[str], order: str = "id") -> DataFrame:
    """Events after their shard's boundary: what is left is a contiguous end of the chain, even if clocks jumped."""
    return events.join(boundaries.select(*shard, "boundary"), shard, "left").filter(F.col("boundary").isNull() | (F.col(order) > F.col("boundary"))).drop("boundary")


def prune_sessions(sessions: DataFrame, cutoff_us: int) -> DataFrame:
    return sessions.filter(~((F.col("status") == "ended") & F.coalesce(F.col("end_us") < cutoff_us, F.lit(False))))


def unreferenced(blobs: DataFrame, references: list[DataFrame], key: str = "sha256") -> DataFrame:
    """Blobs that no reference (each with one column) names; nulls name nothing."""
    for r in references:
        r = r.toDF("_ref").filter("_ref IS NOT NULL").distinct()
        blobs = blobs.join(r, blobs[key] == r["_ref"], "left_anti")
    return blobs


def put_blobs(contents: DataFrame, column: str) -> DataFrame:
    """Distinct contents by their hash: sha256, size, copies and data.

    Copies are merged before the shuffle, so a content that many rows share moves once from each input partition.
    """
    c = contents.select(F.col(column).cast("binary").alias("data")).filter("data IS NOT NULL").withColumn("sha256", F.sha2("data", 256))
    return c.groupBy("sha256").agg(F.max(F.octet_length("data")).cast("long").alias("size"), F.count("*").alias("copies"), F.any_value("data").alias("data"))


# -- files ------------------------------------------------------------------------------------------------------


def compare_baseline(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """path and change (created, deleted, modified, permissions_changed, unchanged) with both sides' values.

    Both: path, sha256, size, mtime, mode, uid. Contents differ by hash, or by size and time where one has none.
    """
    names = [c for c in baseline.columns if c != "path"]
    b = baseline.select("path", *[F.col(c).alias(f"{c}_before") for c in names], F.lit(True).alias("_b"))
    c = current.select("path", *[F.col(x).alias(f"{x}_after") for x in names], F.lit(True).alias("_c"))
    both = b.join(c, "path", "full_outer")
    hashes = F.col("sha256_before").isNotNull() & F.col("sha256_after").isNotNull()
    content = F.when(hashes, F.col("sha256_before") != F.col("sha256_after")).otherwise(~F.col("size_before").eqNullSafe(F.col("size_after")) | ~F.col("mtime_before").eqNullSafe(F.col("mtime_after")))
    rights = ~F.col("mode_before").eqNullSafe(F.col("mode_after")) | ~F.col("uid_before").eqNullSafe(F.col("uid_after"))
    change = F.when(F.col("_b").isNull(), "created").when(F.col("_c").isNull(), "deleted").when(content, "modified").when(rights, "permissions_changed").otherwise("unchanged")
    open_now = F.col("mode_after").bitwiseAND(2) != 0
    opened = (change == "permissions_changed") & open_now & (F.col("mode_before").bitwiseAND(2) == 0)
    return both.withColumns({"change": change, "severity": F.when(F.coalesce(opened, F.lit(False)), 2).otherwise(0)}).drop("_b", "_c")


def file_events(changes: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """compare_baseline() rows as events, with further columns of theirs."""
    c = changes.filter("change <> 'unchanged'")
    verb = F.when(F.col("change") == "created", "Created").when(F.col("change") == "deleted", "Deleted").when(F.col("change") == "modified", "Modified").otherwise("Permissions or owner changed on")
    details = F.to_json(F.struct("size_before", "size_after", "sha256_before", "sha256_after", F.conv("mode_before", 10, 8).alias("mode_before"), F.conv("mode_after", 10, 8).alias("mode_after")))
    return c.select(*(keep or []), F.lit("file").alias("category"), F.concat(F.lit("file."), "change").alias("action"), F.lit("success").alias("outcome"), "severity", F.col("path").alias("target"), F.concat_ws(" ", verb, "path").alias("message"), details.alias("details"))


def content_policy(files: DataFrame, hash_only: list[str] | None = None, most_kept: int = MOST_KEPT_BYTES, most_hashed: int = MOST_HASHED_BYTES) -> DataFrame:
    """Files (path, data, link) with sha256 and, for texts that may be kept, kept_text, redacted.

    A link's content is its target. Files over most_hashed have no hash; those over most_kept, binary or matching
    hash_only (wildcards) have no text.
    """
    from ..functions.scalars import wildcard_match

    data = F.when(F.col("link").isNotNull(), F.concat(F.lit("-> "), "link", F.lit("\n")).cast("binary")).otherwise(F.col("data"))
    secret = F.lit(False)
    for p in hash_only or []:
        secret = secret | wildcard_match(F.col("path"), p)
    f = files.withColumn("_data", data).withColumn("sha256", F.when(F.octet_length("_data") <= most_hashed, F.sha2("_data", 256)))
    keep = (F.octet_length("_data") <= most_kept) & ~secret & is_text(F.col("_data"))
    return f.withColumn("kept_text", F.when(keep, redact(F.decode("_data", "utf-8")))).drop("_data")


def debounced(notices: DataFrame, seconds: float = 1.5) -> DataFrame:
    """Notices of a path (path, ts) that follow one another within `seconds`, as one: path, first_ts, last_ts, notices."""
    out = notices.groupBy("path", F.session_window("ts", f"{int(seconds * 1000)} milliseconds").alias("w")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("notices"))
    return out.drop("w")


def unified_diffs(pairs: DataFrame) -> DataFrame:
    """path, before, after (texts) with added, removed and diff, by an Arrow function: line diffs are not relational."""
    import pandas as pd

    from ..session import ship

    ship(pairs.sparkSession)
    kinds = T.StructType([*pairs.schema.fields, *struct_of("added BIGINT, removed BIGINT, diff STRING").fields])

    def run(frames):
        import difflib

        for f in frames:
            rows = []
            for path, a, b in zip(f["path"], f["before"], f["after"], strict=True):
                lines = list(difflib.unified_diff((a or "").splitlines(True), (b or "").splitlines(True), f"{path} (before)", f"{path} (after)", n=3))
                body = lines[2:]
                text = "".join(x if x.endswith("\n") else x + "\n" for x in lines)
                raw = text.encode()
                if len(raw) > 16_384:
                    head = raw[:16_384].decode("utf-8", "ignore")
                    text = f"{head}…[truncated {len(raw) - len(head.encode())} bytes]"
                rows.append((sum(x.startswith("+") for x in body), sum(x.startswith("-") for x in body), text))
            yield pd.concat([f.reset_index(drop=True), pd.DataFrame(rows, columns=["added", "removed", "diff"])], axis=1)

    return pairs.mapInPandas(run, kinds)
