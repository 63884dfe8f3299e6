"""Ordered folds: operators whose next result depends on the one before it.

Rows are dealt out by key, sorted within their partition (Spark's sort spills), and read as a stream in which only the
state of the current key is held. No key's rows are ever collected, so a hot key costs time in one task but no memory.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

KEY = "_fold_key"
SEPARATOR = chr(31)


class State(Protocol):
    """The state of one key: feed takes its next rows, in order, and returns which of them to keep and new columns."""

    def feed(self, rows: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, list]]: ...


def fold(df: DataFrame, keys: list[str], order: list[str], state: Callable[[], State], added: T.StructType | None = None, inputs: list[str] | None = None) -> DataFrame:
    """Feed each key's rows to a state in order; the rows it keeps, with the columns it adds.

    inputs are the columns the state reads; all others pass through. Null keys are a key of their own.
    """
    ship(df.sparkSession)
    added = added or T.StructType()
    inputs = inputs or order
    names = df.columns
    joined = F.concat_ws(SEPARATOR, *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit(chr(30))) for k in keys])
    rows = df.withColumn(KEY, joined).repartition(KEY).sortWithinPartitions(KEY, *order)
    kinds = T.StructType([*df.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = None, None
        types = None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.array(b.column(KEY).to_pylist(), dtype=object)
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            ends = np.append(starts[1:], len(key))
            read = {c: b.column(c).to_numpy(zero_copy_only=False) for c in inputs}
            keep, columns = np.zeros(len(key), bool), {f.name: [] for f in added.fields}
            for s, e in zip(starts, ends, strict=True):
                if key[s] != held:
                    held, now = key[s], state()
                mask, more = now.feed({c: v[s:e] for c, v in read.items()})
                keep[s:e] = mask
                for c in columns:
                    columns[c] += more[c]
            types = types or [_arrow(f.dataType) for f in added.fields]
            out = b.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*[out.column(c) for c in names], *[pa.array(columns[f.name], t) for f, t in zip(added.fields, types, strict=True)]], [*names, *[f.name for f in added.fields]])

    return rows.mapInArrow(run, kinds)


def _arrow(kind: T.DataType) -> pa.DataType:
    return {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_()}[type(kind)]


class Cooldown:
    """Keeps the first row, and each that comes a span or more after the last that was kept."""

    def __init__(self, span: int):
        self.span, self.last = span, None

    def feed(self, rows: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, list]]:
        t = rows["us"]
        keep = np.zeros(len(t), bool)
        at = 0 if self.last is None else int(np.searchsorted(t, self.last + self.span))
        while at < len(t):  # a step for each row that is kept, however many lie between
            keep[at], self.last = True, int(t[at])
            at = int(np.searchsorted(t, self.last + self.span))
        return keep, {}


class RollingCap:
    """Keeps at most so many rows within any span, and counts those held back before each."""

    def __init__(self, most: int, span: int):
        self.most, self.span, self.sent, self.held = most, span, deque(), 0

    def feed(self, rows: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, list]]:
        keep, held = [], []
        for t in rows["us"].tolist():
            while self.sent and t - self.sent[0] >= self.span:
                self.sent.popleft()
            keep.append(len(self.sent) < self.most)
            if keep[-1]:
                self.sent.append(t)
                held.append(self.held)
                self.held = 0
            else:
                self.held += 1
        return np.array(keep, bool), {"suppressed": held}
