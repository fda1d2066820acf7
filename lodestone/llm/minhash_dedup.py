"""Near duplicates by BagMinHash signatures, banding and verified multiset overlap.

A text's bag is the multiset of its word shingles. Each register of its signature is the first point of Poisson
processes that run over the discretised weights of its shingles. The weights 0-1, 1-2, 2-4, 4-8, ... of a shingle are
blocks of a hierarchy, each with a process of its own of a rate as large as the block; a point of the block that a
weight ends in counts if its level, uniform in the block, is under the weight. So a shingle of weight w costs log w
processes, and two registers agree with a probability that is exactly the weighted Jaccard similarity. Points are
made in order, vectorised over all shingles of a batch, and a text's processes stop at a bound by which all its
registers are likely to be filled; where they aren't, the bound is doubled.

Equal texts are one class. Classes whose signatures agree in a band meet in a bucket and are compared by their
signatures, cut to 4 bits a register; pairs that may be similar give edges, of which a task returns a spanning forest.
The components of these edges bound where links can be: within a component every pair of bags is compared exactly,
as multisets, by tiles. Hot buckets and large components are cut into blocks, a pair of blocks a task, and what a task
returns grows with its rows, not its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, modest_batches, release, text_lists, written
from .components import by_tile, components, forest, tiled
from .numtext import U, Words, mix, salted

SHINGLE = 3
BANDS = 40
ROWS = 3
THRESHOLD = 0.4
#: Classes in a block of a bucket, and in a block of a component.
BUCKET_BLOCK = 1024
BAG_BLOCK = 256


def bags(texts: list[str], shingle: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct shingles of each text, as sorted hashes, and their counts. A text of fewer words than a shingle
    has one shingle of all its words; one without words has none."""
    w = Words(texts)
    h, out = w.hash, []
    with np.errstate(over="ignore"):
        grams = h.copy()
        for j in range(1, shingle):
            grams[:-j] = mix(grams[:-j] * U(0x9E3779B97F4A7C15) + h[j:]) if len(h) > j else grams[:-j]
    for a, b in zip(w.first.tolist(), w.first[1:].tolist()):
        n = b - a
        if n >= shingle:
            own = grams[a : b - shingle + 1]
        elif n:
            whole = h[a]
            for x in h[a + 1 : b]:
                whole = mix(np.array([whole ^ U(0x5851F42D4C957F2D)]) + x)[0]
            own = np.array([whole])
        else:
            own = np.zeros(0, U)
        out.append(np.unique(own, return_counts=True))
    return out


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """BagMinHash: for each bag, the time of the first point in each of m registers; infinite for an empty bag."""
    n = len(sets)
    out = np.full((n, m), np.inf)
    sizes = np.array([len(h) for h, _ in sets])
    total = np.array([c.sum() for _, c in sets], dtype=np.float64)
    todo = np.flatnonzero(sizes)
    bound = np.zeros(n)
    bound[todo] = (math.log(m) + 4) / total[todo]
    while len(todo):
        owner = np.repeat(todo, sizes[todo])
        h = np.concatenate([sets[k][0] for k in todo])
        c = np.concatenate([sets[k][1] for k in todo]).astype(np.float64)
        out[todo] = np.inf
        level = 0
        while len(h):
            start, width = (0.0, 1.0) if level == 0 else (2.0 ** (level - 1), 2.0 ** (level - 1))
            seed = salted(h, 2 * level + 1)
            rate = m * width
            inside = np.minimum(1.0, (c - start) / width)
            who, limit, x = owner, bound[owner], np.zeros(len(h))
            step = 0
            while len(seed):
                step += 1
                r = salted(seed, 2 * step)
                x = x - np.log(_uniform(r)) / rate
                live = x < limit
                seed, who, limit, x, inside, r = seed[live], who[live], limit[live], x[live], inside[live], r[live]
                r = mix(r + U(0xD1B54A32D192ED03))
                good = (r >> U(32)).astype(np.float64) * 2.0**-32 < inside if level else slice(None)
                register = ((r & U(0xFFFFFFFF)) * U(m) >> U(32)).astype(np.int64)
                np.minimum.at(out.reshape(-1), (who * m + register)[good], x[good])
            deeper = c > start + width
            h, c, owner = h[deeper], c[deeper], owner[deeper]
            level += 1
        todo = todo[np.isinf(out[todo]).any(axis=1)]
        bound[todo] *= 2
    return out


def _sketch(bands: int, rows: int, shingle: int):
    m = bands * rows

    def run(col: pa.Array) -> pa.Array:
        keys, prints = [], []
        for texts in text_lists(col):
            sets = bags(texts, shingle)
            sig = signatures(sets, m)
            x = mix(sig.view(np.uint64))
            key = np.zeros((len(x), bands), U)
            for j in range(rows):
                key = mix(key * U(0x9E3779B97F4A7C15) + x[:, j::rows] + U(j + 1))
            key = mix(key + np.arange(1, bands + 1, dtype=U) * U(0xD6E8FEB86659FD93)).view(np.int64)
            nibble = (x >> U(60)).astype(np.uint8)
            packed = (nibble[:, 0::2] << 4 | nibble[:, 1::2]) if m % 2 == 0 else nibble
            for s, k, p in zip(sets, key, packed):
                keys.append(k if len(s[0]) else k[:0])
                prints.append(p.tobytes())
        release()
        return pa.StructArray.from_arrays([pa.array(keys, pa.list_(pa.int64())), pa.array(prints, pa.binary())], ["keys", "print"])

    return run


#: Of two bytes of two registers each, how many registers agree, by their exclusive or.
_AGREE = np.array([(x >> 4 == 0) + (x & 15 == 0) for x in range(256)], np.uint8)


def _bucket(m: int, least: float):
    """Compares the signatures of a bucket's classes, or of two blocks of it."""
    packed = m % 2 == 0
    need = m * (1 / 16 + least * 15 / 16)

    def run(t: pa.Table) -> pa.RecordBatch | None:
        ids = t.column("node").to_numpy()
        prints = np.frombuffer(b"".join(t.column("print").to_pylist()), np.uint8).reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        ids, prints = ids[order], prints[order]
        own, i, j = t.column("__lode_own").to_numpy()[order], t.column("__lode_i")[0].as_py(), t.column("__lode_j")[0].as_py()
        found_a, found_b = [], []
        for k in range(len(ids) - 1):
            x = prints[k + 1 :] ^ prints[k]
            same = _AGREE[x].sum(axis=1) if packed else (x == 0).sum(axis=1)
            hit = np.flatnonzero(same >= need) + k + 1
            if i != j:
                hit = hit[own[hit] != own[k]]
            if len(hit):
                found_a.append(np.full(len(hit), k))
                found_b.append(hit)
        if not found_a:
            return None
        low = forest(len(ids), np.concatenate(found_a), np.concatenate(found_b))
        some = np.flatnonzero(low != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[low[some]])], ["node", "root"])

    return run


def _two(batches, m: int, least: float):
    """Buckets of two classes, the bulk of them: one comparison a row."""
    packed, need = m % 2 == 0, m * (1 / 16 + least * 15 / 16)
    for b in batches:
        if not b.num_rows:
            continue
        p, q = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(b.num_rows, -1) for k in ("pa", "pb"))
        x = p ^ q
        same = _AGREE[x].sum(axis=1) if packed else (x == 0).sum(axis=1)
        hit = pa.array(np.flatnonzero(same >= need))
        yield pa.RecordBatch.from_arrays([b.column("a").take(hit), b.column("b").take(hit)], ["node", "root"])


def multiset(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A bag as a set: each shingle with the number of its occurrence. Sets overlap as the multisets do."""
    h = np.repeat(h, c)
    nth = np.arange(len(h)) - np.repeat(np.cumsum(c) - c, c)
    return mix(h + nth.astype(U) * U(0xA0761D6478BD642F))


def overlaps(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of each set of rows with each of cols."""
    flat = np.concatenate([sets[k] for k in range(len(sets))]) if sets else np.zeros(0, U)
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.zeros((len(rows), len(cols)), np.float64)
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, bool)
    at = np.cumsum(new) - 1
    often = np.bincount(at) > 1 if len(at) else np.zeros(0, bool)
    keep = often[at]
    who, at = who[keep], (np.cumsum(often) - 1)[at[keep]]
    chunk = 16384
    edges = np.searchsorted(at, np.arange(0, (at[-1] + 1 if len(at) else 0) + chunk, chunk))
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        if a < b:
            x = np.zeros((len(sets), min(chunk, int(at[-1]) + 1 - k * chunk)), np.float32)
            x[who[a:b], at[a:b] - k * chunk] = 1
            out += x[rows] @ x[cols].T
    return out


def _verify(threshold: float):
    def run(t: pa.Table) -> pa.RecordBatch | None:
        ids, copies = t.column("node").to_numpy(), t.column("copies").to_numpy()
        own = t.column("__lode_own").to_numpy()
        i, j = t.column("__lode_i")[0].as_py(), t.column("__lode_j")[0].as_py()
        order = np.argsort(ids, kind="stable")
        ids, copies, own = ids[order], copies[order], own[order]
        raw = t.column("bag").to_pylist()
        sets = [np.frombuffer(raw[k], U) for k in order]
        size = np.array([len(s) for s in sets], float)
        rows, cols = np.flatnonzero(own == i), np.flatnonzero(own == j)
        if not len(rows) or not len(cols):
            return None
        both = overlaps(sets, rows, cols)
        union = size[rows][:, None] + size[cols][None, :] - both
        a, b = np.nonzero(both >= threshold * union - 1e-9)
        a, b = rows[a], cols[b]
        pick = a < b if i == j else slice(None)
        a, b = a[pick], b[pick]
        if not len(a):
            return None
        low = forest(len(ids), a, b)
        links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
        texts = np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
        some = np.flatnonzero(texts)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[low[some]]), pa.array(links[some].astype(np.int64)), pa.array(texts[some].astype(np.int64))], ["node", "root", "links", "texts"])

    return run


#: So many members of components at most are sent to every executor (16 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 3_000_000


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE,
    bands: int = BANDS, rows: int = ROWS, bucket_block: int = BUCKET_BLOCK, bag_block: int = BAG_BLOCK, most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """One row per row of df: its key, n_copies (rows of the same text, itself included), n_links (other rows linked
    directly: copies, and texts whose bags have a weighted Jaccard similarity of at least `threshold`), n_texts (the
    different texts among these), class_id (the smallest key that links reach), kept (whether it is that row) and
    text_hash.

    Null texts link with nothing. Empty texts, and texts without a word, are copies of their equals alone. Keys are
    integers; a row with a null key links with nothing, has no class and isn't kept; rows that repeat a key are
    copies or links of each other as any rows are, and `kept` holds for all rows of the class's key. Further columns
    are ignored. An empty table gives an empty table. Texts are told apart by 128 bits of hashes. A pair of similarity s
    is found by its signatures with probability 1 - (1 - s^rows)^bands, and by what links the two to others besides.
    """
    modest_batches(df)
    m = bands * rows
    own = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    own = own.withColumn("node", F.when(F.col("id").isNotNull(), text_hash(F.col("t")))).withColumn("other", F.xxhash64("t", F.lit(10)))
    sketch = F.arrow_udf(_sketch(bands, rows, shingle), "keys array<long>, print binary")
    # One pass over the texts; what follows works on sketches.
    table = written(own.withColumn("s", sketch(F.coalesce("t", F.lit("")))).select("id", "node", "other", F.col("node").alias("hash"), "s.keys", "s.print"), "sketches")
    # Different texts of one hash, if there are any, are named by their second hash.
    met = table.filter("node IS NOT NULL").groupBy("node").agg(F.min("other").alias("a"), F.max("other").alias("b")).filter("a <> b").select("node")
    met = cut(met)
    if met.limit(1).count():
        own, table = _renamed(own, met), written(_renamed(table, met), "sketches")
    known = table.filter("node IS NOT NULL")
    classes = known.groupBy("node").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    one = known.select("node", "keys", "print").dropDuplicates(["node"])
    one = written(one, "classes")
    prints = one.select("node", "print")
    spread = one.select("node", F.explode("keys").alias("key"))
    # Buckets of one class vanish as counts are combined; those of two are pairs already.
    buckets = written(spread.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b")).filter("n > 1"), "buckets")
    twos = buckets.filter("n = 2").select("a", "b").distinct()
    twos = twos.join(prints.select(F.col("node").alias("a"), F.col("print").alias("pa")), "a").join(prints.select(F.col("node").alias("b"), F.col("print").alias("pb")), "b")
    least = max(0.0, threshold - 3 * math.sqrt(threshold * (1 - threshold) / m))
    pairs = twos.mapInArrow(lambda batches: _two(batches, m, least), "node long, root long")
    more = spread.join(buckets.filter("n > 2").select("key"), "key", "left_semi").join(prints, "node")
    tiles = by_tile(tiled(more, ["key"], bucket_block, "node"), ["key"], _bucket(m, least), "node long, root long")
    near = cut(components(pairs.unionByName(tiles), "node", "root"))
    near = near.select(F.col("id").alias("node"), F.col("root").alias("part")).join(classes, "node")
    near = cut(near)
    few = F.broadcast(near) if near.count() <= most_broadcast else near

    def bag(col: pa.Array) -> pa.Array:
        out = []
        for texts in text_lists(col):
            out += [np.sort(multiset(h, c)).tobytes() for h, c in bags(texts, shingle)]
        release()
        return pa.array(out, pa.binary())

    # The bag of each class in a component, from the row of its smallest key.
    members = own.join(few, "node").filter(F.col("id") == F.col("rep"))
    members = members.select("part", "node", "copies", F.arrow_udf(bag, "binary")("t").alias("bag"))
    if _repeats(known):
        members = members.dropDuplicates(["node"])
    parts = cut(by_tile(tiled(members, ["part"], bag_block, "node"), ["part"], _verify(threshold), "node long, root long, links long, texts long"))
    roots = components(parts, "node", "root").withColumnRenamed("id", "node")
    found = parts.groupBy("node").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    found = near.select("node", "rep").join(found, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = found.groupBy("root").agg(F.min("rep").alias("first"))
    found = classes.join(found.join(firsts, "root").select("node", "links", "texts", "first"), "node", "left")
    out = table.select("id", "node", "hash").join(found, "node", "left")
    first = F.coalesce("first", "rep", "id")
    return out.select(
        F.col("id").alias(key),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_texts"),
        first.alias("class_id"),
        F.coalesce(F.col("id") == first, F.lit(False)).alias("kept"),
        F.col("hash").alias("text_hash"),
    )


def _renamed(rows: DataFrame, met: DataFrame) -> DataFrame:
    again = rows.join(met.withColumn("__lode_met", F.lit(True)), "node", "left")
    return again.withColumn("node", F.when(F.col("__lode_met"), F.xxhash64("node", "other", F.lit(11))).otherwise(F.col("node"))).drop("__lode_met")


def text_hash(text: Column) -> Column:
    """The hash by which texts are told apart; null for null."""
    return F.when(text.isNotNull(), F.xxhash64(text.cast("string"), F.lit(9)))


def _repeats(known: DataFrame) -> bool:
    """Whether some key comes more than once with the same text."""
    return known.groupBy("node", "id").count().filter("count > 1").limit(1).count() > 0


def op9(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
