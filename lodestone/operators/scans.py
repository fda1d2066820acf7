"""Operators that must see a key's rows in order: sliding-window limits and caches with a time to live.

Rows are hash-partitioned by key and sorted, and a task walks through them batch by batch with the state of the key
at hand, which is bounded; a key's rows are never gathered, however many there are.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scan(df: DataFrame, keys: list[str], order: list[str], start, step, fields: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """Adds fields (name, Arrow type, Spark type) to rows: step(state, row of order columns) gives their values."""
    spread = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"{n} {s}" for n, _, s in fields)])

    def run(batches):
        state, last = None, object()
        for b in batches:
            made = []
            cols = [b.column(k).to_pylist() for k in keys]
            for key, row in zip(zip(*cols), zip(*(b.column(c).to_pylist() for c in order))):
                if key != last:
                    state, last = start(), key
                made.append(step(state, row))
            out = list(zip(*made)) if made else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, kind) for x, (_, kind, _) in zip(out, fields))], [*b.schema.names, *(n for n, _, _ in fields)])

    return spread.mapInArrow(run, schema)


def rate_limit(df: DataFrame, key: str, at: str, tie: str, limit: int = 20, window: int = 60_000_000) -> DataFrame:
    """ST1: whether each request is admitted: fewer than `limit` admitted ones in the window before it, which is
    given as `at` is (say, microseconds). Rejected requests aren't counted. retry_after is in seconds of that."""

    def step(admitted: deque, row: tuple):
        now = row[0]
        while admitted and admitted[0] < now - window:
            admitted.popleft()
        if len(admitted) < limit:
            admitted.append(now)
            return True, 0
        return False, int((admitted[0] + window - now) / 1_000_000) + 1

    return scan(df, [key], [at, tie], deque, step, [("admitted", pa.bool_(), "boolean"), ("retry_after", pa.int64(), "long")])


def ttl_cache(df: DataFrame, keys: list[str], at: str, tie: str, ttl: int) -> DataFrame:
    """ST3: whether each lookup hits: the key was set, by the last miss, less than ttl ago."""

    def step(state: list, row: tuple):
        if state and row[0] - state[0] < ttl:
            return (True,)
        state[:] = [row[0]]
        return (False,)

    return scan(df, keys, [at, tie], list, step, [("hit", pa.bool_(), "boolean")])


def cache_counters(df: DataFrame, *by: str) -> DataFrame:
    """A9."""
    n = F.count("*")
    return df.groupBy(*by).agg(n.alias("lookups"), F.count_if("hit").alias("hits"), F.round(F.count_if("hit") / n, 4).alias("rate"))


def idle_keys(df: DataFrame, key: str, at: str, now: int, window: int) -> DataFrame:
    """ST2: keys without a request in the last two windows."""
    return df.groupBy(key).agg(F.max(at).alias("last")).filter(F.col("last") < now - 2 * window)


