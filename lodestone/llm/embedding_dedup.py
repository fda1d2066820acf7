"""Near duplicates among embeddings by int8 quantised tile products with rigorous error bounds.

Vectors are scaled to length 1 and quantised: x = s q + e with q of int8. For a pair, x.y differs from
s s' (q.q') by at most |s q| |e'| + |e| |y|, so a pair whose product plus that bound stays under the threshold is
ruled out; all others are computed again in double precision from the vectors themselves. Products of tiles are
matrix products of the int8 codes, exact in 32-bit floats up to 1024 dimensions at a time.

Equal vectors are one class with a count, so copies are never paired with each other. Within a group, classes are
cut into blocks, and each pair of blocks is one task, which gives each class its number of links and its smallest
reachable class: a task's output grows with its rows, not its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import by_tile, components, forest, tiled

#: Classes in a block; a task multiplies two blocks.
BLOCK = 4096
#: Rows of a block that are multiplied at once.
STRIPE = 1024
SLACK = 1e-9


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of x, their int8 codes, their scales, and the lengths of their errors, rounded up."""
    u = x / np.abs(x).max(axis=1, keepdims=True)
    u /= np.sqrt(np.einsum("ij,ij->i", u, u))[:, None]
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    e = u - q * scale[:, None]
    return u, q, scale, np.sqrt(np.einsum("ij,ij->i", e, e)) * (1 + 1e-9) + 1e-12


def _products(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact products of int8 codes."""
    if p.shape[1] <= 1024:
        return p.astype(np.float32) @ q.astype(np.float32).T
    return sum((p[:, k : k + 1024].astype(np.float32) @ q[:, k : k + 1024].astype(np.float32).T).astype(np.float64) for k in range(0, p.shape[1], 1024))


def linked(x: np.ndarray, y: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Index pairs of rows with cosine >= threshold, within x (i < j) or between x and y; and how many pairs were
    computed in full precision."""
    ux, qx, sx, ex = quantise(x)
    uy, qy, sy, ey = (ux, qx, sx, ex) if y is None else quantise(y)
    length = np.sqrt(np.einsum("ij,ij->i", qx.astype(np.float64), qx)) * sx
    found_a, found_b, checked = [], [], 0
    for at in range(0, len(x), STRIPE):
        part = slice(at, at + STRIPE)
        first = at if y is None else 0
        products = _products(qx[part], qy[first:])
        # product * s s' + |s q| |e'| + |e| >= threshold, divided by s s'
        need = ((threshold - SLACK) - ex[part])[:, None] / sx[part][:, None] / sy[first:][None, :] - (length[part] / sx[part])[:, None] * (ey[first:] / sy[first:])[None, :]
        a, b = np.nonzero(products >= need - 1e-3)
        a, b = a + at, b + first
        if y is None:
            a, b = a[a < b], b[a < b]
        for k in range(0, len(a), 1 << 17):
            i, j = a[k : k + (1 << 17)], b[k : k + (1 << 17)]
            good = np.einsum("ij,ij->i", ux[i], uy[j]) >= threshold
            found_a.append(i[good])
            found_b.append(j[good])
        checked += len(a)
    none = np.zeros(0, int)
    return np.concatenate(found_a or [none]), np.concatenate(found_b or [none]), checked


def _tile(threshold: float):
    def run(t: pa.Table) -> pa.RecordBatch | None:
        ids = t.column("rep").to_numpy()
        copies = t.column("copies").to_numpy()
        lists = t.column("embedding").combine_chunks()
        x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        own = t.column("__lode_own").to_numpy()
        i, j = t.column("__lode_i")[0].as_py(), t.column("__lode_j")[0].as_py()
        if i == j:
            a, b, _ = linked(x, None, threshold)
        else:
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            if not len(left) or not len(right):
                return None
            a, b, _ = linked(x[left], x[right], threshold)
            a, b = left[a], right[b]
        if not len(a):
            return None
        order = np.argsort(ids, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(ids))
        low = forest(len(ids), place[a], place[b])
        links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
        some = np.flatnonzero(links > 0)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[order][low[place[some]]]), pa.array(links[some].astype(np.int64))], ["rep", "root", "links"])

    return run


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", group: str = "label", threshold: float = 0.93, block: int = BLOCK) -> DataFrame:
    """One row per row of df: its key, n_links (other rows linked directly), component_id (the smallest key that
    links reach) and kept (whether it is that row).

    Two rows link if their groups are equal and not null and the cosine of their vectors, in double precision, is at
    least the threshold. Vectors that are null, empty or zero or hold null or non-finite components link with
    nothing, nor do vectors of different lengths with each other. Keys are integers; a null key links with nothing,
    forms no component (null) and isn't kept, and rows that repeat a key count as rows of their own but share that key's result.
    Further columns are ignored. An empty table gives an empty table.
    """
    own = df.select(F.col(key).cast("long").alias("id"), F.col(group).alias("g"), F.col(vector).alias("embedding"))
    v = F.col("embedding")
    size = F.transform(v, lambda c: c.cast("double"))
    fine = (
        F.col("id").isNotNull() & F.col("g").isNotNull() & v.isNotNull() & (F.size(v) > 0)
        & F.forall(size, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
        & F.exists(size, lambda c: c != 0)
    )
    own = own.withColumn("fine", F.coalesce(fine, F.lit(False)))
    # Two hashes make one of 128 bits: unequal vectors that share both aren't to be expected.
    kind = [F.xxhash64("g", v), F.xxhash64(F.lit(1), v, "g")]
    own = own.withColumns({"h1": F.when(F.col("fine"), kind[0]), "h2": F.when(F.col("fine"), kind[1])})
    classes = own.filter("fine").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"), F.first("g").alias("g"))
    classes = classes.withColumn("dim", F.size("embedding"))
    tiles = tiled(classes.select("rep", "copies", "embedding", "g", "dim"), ["g", "dim"], block, "rep")
    from .common import cut

    parts = cut(by_tile(tiles, ["g", "dim"], _tile(threshold), "rep long, root long, links long"))
    roots = components(parts, "rep", "root").withColumnRenamed("id", "rep")
    links = parts.groupBy("rep").agg(F.sum("links").alias("links"))
    found = classes.select("h1", "h2", "rep", "copies").join(links, "rep", "left").join(roots, "rep", "left")
    out = own.select("id", "h1", "h2").join(found, ["h1", "h2"], "left")
    component = F.coalesce("root", "rep", "id")
    return out.select(
        F.col("id").alias(key),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def op7(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "embeddings"))
