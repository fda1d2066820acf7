"""Groups of linked rows: tiles of all pairs within a key, and connected components of edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: So many edges at most are united in one task (16 bytes each); more go the distributed way.
MOST_IN_TASK = 2_000_000


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes, the smallest node that edges a-b reach from it."""
    low = np.arange(n)
    while len(a):
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, low[a], least)
        np.minimum.at(low, low[b], least)
        low = low[low]
        while (low != low[low]).any():
            low = low[low]
        open_ = low[a] != low[b]
        a, b = a[open_], b[open_]
    return low


def tiled(df: DataFrame, keys: list[str], rows: int, by: str) -> DataFrame:
    """Rows spread over the tiles of all pairs within each key; keys of one row only are left out.

    A key of n rows is cut into ceil(n / rows) blocks by the hash of `by`; a row goes to the tile of its block with
    each block, so no task holds more than two blocks. Adds __lode_i and __lode_j, the blocks of the tile, and
    __lode_n, the number of blocks; __lode_own is the row's own block. Counts are combined before they are shuffled.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("__lode_c")).filter("__lode_c > 1")
    blocks = F.ceil(F.col("__lode_c") / rows).cast("int")
    out = df.join(counts, keys).withColumn("__lode_n", blocks).drop("__lode_c")
    out = out.withColumn("__lode_own", F.pmod(F.xxhash64(F.col(by), F.lit(17)), F.col("__lode_n")).cast("int"))
    out = out.withColumn("__lode_o", F.explode(F.sequence(F.lit(0), F.col("__lode_n") - 1)))
    return out.withColumns({"__lode_i": F.least("__lode_own", "__lode_o"), "__lode_j": F.greatest("__lode_own", "__lode_o")}).drop("__lode_o")


def by_tile(df: DataFrame, keys: list[str], function, schema: str) -> DataFrame:
    """Calls function(rows) -> record batch or None for the rows of each tile; rows is an Arrow table of one tile.

    Tiles are hash-partitioned and sorted, and a task holds one tile at a time.
    """
    order = [*keys, "__lode_i", "__lode_j"]
    spread = df.repartition(*order).sortWithinPartitions(*order)

    def run(batches):
        held, last = [], None

        def one():
            return function(pa.Table.from_batches(held).combine_chunks())

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in order]
            new = np.zeros(batch.num_rows, bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            at = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(at, at[1:]):
                if a == b:
                    continue
                me = tuple(c[a] for c in cols)
                if last is not None and me != last:
                    out = one()
                    if out is not None and out.num_rows:
                        yield out
                    held = []
                last = me
                held.append(batch.slice(a, b - a))
        if held:
            out = one()
            if out is not None and out.num_rows:
                yield out

    return spread.mapInArrow(run, schema)


EDGES = "id long, root long"


def _united(batches):
    """All edges in one task: union by smallest id."""
    a, b = [], []
    for batch in batches:
        a.append(batch.column(0).to_numpy(zero_copy_only=False))
        b.append(batch.column(1).to_numpy(zero_copy_only=False))
    if not a:
        return
    a, b = np.concatenate(a), np.concatenate(b)
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    low = forest(len(ids), at[: len(a)], at[len(a) :])
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[low])], ["id", "root"])


def components(edges: DataFrame, a: str, b: str, most_in_task: int = MOST_IN_TASK) -> DataFrame:
    """(id, root): each node of the edges with the smallest id of its connected component.

    Up to a checked number of edges, one task unites them. Beyond it, large-star and small-star steps run until the
    edges are stars; each step is cut to the shared folder, and a node of very many edges is never gathered, as only
    minima are grouped by node.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter("u <> v").distinct()
    e = cut(e)
    n = e.count()
    if n <= most_in_task:
        return e.coalesce(1).mapInArrow(_united, EDGES)
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = cut(e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            roots = e.select(F.col("u").alias("id"), F.col("v").alias("root"))
            return roots.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()).groupBy("id").agg(F.min("root").alias("root"))
        seen = now
