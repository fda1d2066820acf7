"""Toxicity by a convolutional text classifier trained in numpy.

A word's embedding is the sum of hashed embeddings of the word and of its prefixes, so that forms of a word share
what is learned. Filters of widths 1, 2 and 3 slide over the words of the whole text, are max-pooled, and feed a
logistic unit. Everything begins as small random numbers, those of single words larger than those of windows, and
outputs of both signs; filters are trained by Adam, embeddings by Adagrad.

Every labelled row is learned from. Training starts on a bounded part of them: at most `most_each` texts of either
label, those of the smallest hashes of their keys, as far as `most_bytes` of a label's texts go, and none of more than
a sixteenth of that. Where there are more rows, shards of all of them, told by the hash of the key, go on from there
in one pass each, on executors, and what the shards change is averaged: filters over rows, embeddings over the shards
that changed them. Scores are calibrated, and thresholds chosen by language, on all rows, each scored by a classifier
that learned from other folds only.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import modest_batches, release, slices, text_lists, written
from .numtext import U, Words

BITS = 17
DIM = 8
PREFIXES = (4, 5, 6)
WIDTHS = (1, 2, 3)
FILTERS = 6
PAD = max(WIDTHS) - 1
#: With so many rows of either label there are two folds, else four; steps of training at least.
ENOUGH, LEAST_STEPS = 250, 40
#: Texts and words of a step, at most (one text at least); rows of a shard, about.
BATCH, BATCH_WORDS, SHARD = 64, 1 << 18, 1 << 14
#: Words whose embeddings a scored text needs at a time, about.
PIECE = 1 << 17
#: Embeddings of a row of what a shard sends; steps of raw scores when those of all rows are counted, and their bound.
BLOCK, GRID, FAR = 512, 1024, 32
#: So many labelled keys at most are sent to every executor, so that only their texts are shuffled.
MOST_BROADCAST = 3_000_000


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each word, its buckets (one a hash: the word, then its prefixes); and where each text's words start."""
    w = Words(texts, PREFIXES)
    cols = [w.hash, *w.prefix]
    return np.stack([(h >> U(64 - BITS)).astype(np.int32) for h in cols], axis=1), w.first


class Cnn:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.02, (1 << BITS, DIM)).astype(np.float32)
        self.f = [rng.normal(0, 0.35 if k == 1 else 0.1, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.c = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.o = np.where(np.arange(FILTERS * len(WIDTHS)) % 2 == 0, 0.5, -0.3).astype(np.float32)
        self.b = 0.0
        self.slope, self.shift = 1.0, 0.0
        self.threshold = 0.5
        self.by_lang: dict[str, float] = {}

    def pooled(self, ids: np.ndarray, first: np.ndarray, where: bool = False, kind: type = np.float32, over: np.ndarray | None = None):
        """Max-pooled filters of each text; with `where`, also the words' embeddings and the place of each maximum.
        Of the last `over` words of a text, PAD at most, no windows begin."""
        n = len(first) - 1
        place = np.arange(len(ids)) + PAD * np.repeat(np.arange(n), np.diff(first))
        x = np.zeros((len(ids) + PAD * n, DIM), kind)
        if len(ids):
            v = self.e[ids[:, 0]]
            for j in range(1, ids.shape[1]):
                v += self.e[ids[:, j]]
            x[place] = v
        at = first[:-1] + PAD * np.arange(n)
        tops, spots = [], []
        for k, f, c in zip(WIDTHS, self.f, self.c):
            f = f.astype(kind)
            y = x @ f[0]
            for j in range(1, k):
                y[:-j] += x[j:] @ f[j]
            # a window that begins in a text's padding is all zeros, or runs on into the next text: it counts as zero
            for j in range(PAD):
                y[at + np.diff(first) + j] = 0
                if over is not None:
                    y[(at + np.diff(first) - 1 - j)[over > j]] = 0
            top = np.maximum.reduceat(y, at, axis=0) if n else np.zeros((0, FILTERS), np.float32)
            tops.append(np.maximum(top + c, 0))
            if where:
                owner = np.repeat(np.arange(n), np.diff(first) + PAD)
                spot = np.zeros((n, FILTERS), int)
                for q in range(FILTERS):
                    hit = np.flatnonzero(y[:, q] == top[owner, q])
                    spot[owner[hit][::-1], q] = hit[::-1]
                spots.append(spot)
        pooled = np.concatenate(tops, axis=1)
        return (pooled, x, place, spots) if where else pooled

    def raw(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Scores before calibration, of a settled net the same to the last bit whatever texts are scored together."""
        # in pieces of PIECE words: a text's maxima are those of its pieces
        size = np.diff(first)
        count = np.maximum(1, -(-size // PIECE))
        begin = np.cumsum(count) - count
        nth = np.arange(count.sum()) - np.repeat(begin, count)
        a, end = np.repeat(first[:-1], count) + nth * PIECE, np.repeat(first[1:], count)
        b = np.minimum(a + PIECE + PAD, end)
        over = np.where(nth == np.repeat(count, count) - 1, 0, b - a - PIECE)
        sums, parts, at = np.concatenate([[0], np.cumsum(b - a)]), [np.zeros((0, FILTERS * len(WIDTHS)))], 0
        while at < len(a):
            to = max(at + 1, int(np.searchsorted(sums, sums[at] + PIECE, side="right")) - 1)
            some = np.concatenate([ids[i:j] for i, j in zip(a[at:to], b[at:to])])
            parts.append(self.pooled(some, sums[at : to + 1] - sums[at], kind=float, over=over[at:to]))
            at = to
        pooled = np.maximum.reduceat(np.concatenate(parts), begin, axis=0) if len(size) else parts[0]
        z = np.full(len(first) - 1, float(self.b))
        for q, o in enumerate(self.o.tolist()):
            z += pooled[:, q] * o
        return z

    def step(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rate: float = 2e-3, word_rate: float = 0.05) -> None:
        """One step of training. The optimisers' state is kept until settle()."""
        small = [*self.f, *self.c, self.o]
        if not hasattr(self, "state"):
            self.state = [np.zeros_like(p) for p in small], [np.zeros_like(p) for p in small], np.full(1 << BITS, 1e-6, np.float32), [0]
        m, v, adagrad, steps = self.state
        ids = np.concatenate(docs)
        first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        pooled, x, place, spots = self.pooled(ids, first, True)
        z = pooled @ self.o + self.b
        g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / len(docs)).astype(np.float32)
        back = g[:, None] * self.o * (pooled > 0)
        word_of = np.full(len(x), -1)
        word_of[place] = np.arange(len(ids))
        gf, gc = [], []
        touched, change = [], []
        for w, k in enumerate(WIDTHS):
            d, s = back[:, w * FILTERS : (w + 1) * FILTERS], spots[w]
            gw = np.zeros_like(self.f[w])
            for j in range(k):
                at = np.minimum(s + j, len(x) - 1)
                gw[j] = np.einsum("nqd,nq->dq", x[at], d)
                words = word_of[at].ravel()
                delta = (d[:, :, None] * self.f[w][j].T[None]).reshape(-1, DIM)
                live = (words >= 0) & (np.abs(delta).sum(1) > 0)
                touched.append(words[live])
                change.append(delta[live])
            gf.append(gw)
            gc.append(d.sum(0))
        grads = [*gf, *gc, pooled.T @ g]
        steps[0] += 1
        t = steps[0]
        for k, (p, q) in enumerate(zip(small, grads)):
            m[k] = 0.9 * m[k] + 0.1 * q
            v[k] = 0.999 * v[k] + 0.001 * q * q
            p -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.b -= 10 * rate * float(g.sum())
        words = np.concatenate(touched)
        if len(words):
            delta = np.concatenate(change)
            for j in range(ids.shape[1]):
                b = ids[words, j]
                np.add.at(adagrad, b, (delta**2).mean(1))
                np.subtract.at(self.e, b, word_rate * delta / (np.sqrt(adagrad[b])[:, None] + 1e-4))

    def train(self, docs: list[np.ndarray], y: np.ndarray, epochs: int = 4, batch: int = BATCH, rate: float = 2e-3, word_rate: float = 0.05, seed: int = 3) -> None:
        if not docs:
            return
        rng = np.random.default_rng(seed)
        weight = np.where(y == 1, 0.5 / max(1e-9, (y == 1).mean()), 0.5 / max(1e-9, (y == 0).mean()))
        for _ in range(max(epochs, -(-LEAST_STEPS * batch // max(1, len(docs))))):
            order = rng.permutation(len(docs))
            for a in range(0, len(order), batch):
                part = order[a : a + batch]
                self.step([docs[k] for k in part], y[part], weight[part], rate, word_rate)

    def settle(self) -> None:
        """Ends training. Weights are rounded so that sums over a window are exact in doubles, in whichever order."""
        self.__dict__.pop("state", None)
        self.e = _rounded(self.e, 8)
        self.f = [_rounded(f, 4) for f in self.f]

    def flat(self) -> np.ndarray:
        """All that is learned but the embeddings."""
        return np.concatenate([*(p.ravel() for p in (*self.f, *self.c, self.o)), [self.b]])

    def add_flat(self, change: np.ndarray) -> None:
        at = 0
        for p in (*self.f, *self.c, self.o):
            p += change[at : at + p.size].reshape(p.shape)
            at += p.size
        self.b += float(change[at])

    def calibrate(self, z: np.ndarray, y: np.ndarray, weight: np.ndarray, lang: list) -> None:
        """Platt scaling with weights, then a threshold for each language that has enough of both labels."""
        mean, sd = z.mean(), z.std() + 1e-9
        s = (z - mean) / sd
        a, b = 1.0, 0.0
        for _ in range(60):  # Newton's method with a little ridge
            p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
            r = weight * (p - y)
            h = weight * p * (1 - p)
            g = np.array([(r * s).sum() + 1e-3 * a, r.sum()])
            hess = np.array([[(h * s * s).sum() + 1e-3, (h * s).sum()], [(h * s).sum(), h.sum() + 1e-6]])
            step = np.linalg.solve(hess, g)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.shift = a / sd, b - a * mean / sd
        p = self.probability(z)
        self.threshold = _best(p, y, weight)
        # The score's 0.5 is put where the threshold for all languages is.
        t = float(np.clip(self.threshold, 1e-6, 1 - 1e-6))
        self.shift -= np.log(t / (1 - t))
        self.threshold = 0.5
        p, lang = self.probability(z), np.array(["" if l is None else l for l in lang], dtype=object)
        for l in sorted(set(lang.tolist()) - {""}):
            own = lang == l
            if (weight * y)[own].sum() >= 25 and (weight * (1 - y))[own].sum() >= 25:
                # halfway (in log-odds) to the threshold for all: a language's own sample is small
                q = np.clip(_best(p[own], y[own], weight[own]), 1e-4, 1 - 1e-4)
                self.by_lang[l] = float(1 / (1 + np.exp(-0.5 * np.log(q / (1 - q)))))

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -40, 40)))

    def score(self, texts: list[str]) -> np.ndarray:
        out = []
        for a, b in slices(texts):
            ids, first = buckets(texts[a:b])
            out.append(self.probability(self.raw(ids, first).astype(float)))
        return np.concatenate(out) if out else np.zeros(0)


def _rounded(w: np.ndarray, bound: int) -> np.ndarray:
    return np.clip(np.round(w.astype(float) * 2**20), 1 - bound * 2**20, bound * 2**20 - 1).astype(np.float32) / np.float32(2**20)


def _best(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The threshold of the best weighted F1, in the middle between neighbouring scores."""
    order = np.argsort(-p, kind="stable")
    tp, fp = np.cumsum(weight[order] * y[order]), np.cumsum(weight[order] * (1 - y[order]))
    if not len(p) or tp[-1] == 0:
        return 0.5
    f = 2 * tp / (tp[-1] + tp + fp)
    q = p[order]
    f[:-1][q[:-1] == q[1:]] = -1
    k = int(f.argmax())
    return float((q[k] + (q[k + 1] if k + 1 < len(q) else 0)) / 2)


def _fold(folds: int) -> Column:
    return F.pmod(F.xxhash64("k", F.lit(7)), F.lit(folds)).cast("int")


class _Shard:
    """Nets that go on from the shared ones; the net of a place below the number of folds leaves that fold out."""

    def __init__(self, start: list[Cnn], weight: tuple[float, float]):
        self.start, self.weight = start, np.array(weight)
        self.nets = [copy.deepcopy(net) for net in start]
        self.waiting: list[list] = [[] for _ in start]
        self.rows = [0] * len(start)

    def add(self, ids: np.ndarray, y: int, fold: int) -> None:
        for j, some in enumerate(self.waiting):
            if j != fold:
                some.append((ids, y))
                if len(some) >= BATCH or sum(len(d) for d, _ in some) >= BATCH_WORDS:
                    self._step(j)

    def _step(self, j: int) -> None:
        docs, y = [d for d, _ in self.waiting[j]], np.array([y for _, y in self.waiting[j]])
        self.nets[j].step(docs, y.astype(float), self.weight[y])
        self.rows[j] += len(docs)
        self.waiting[j] = []

    def changes(self, shard: int) -> list[tuple]:
        """Rows (net, block, shard, rows learned from, difference): blocks of embeddings, and all else as block -1."""
        out = []
        for j, (old, net) in enumerate(zip(self.start, self.nets)):
            if self.waiting[j]:
                self._step(j)
            if self.rows[j]:
                out.append((j, -1, shard, self.rows[j], (net.flat() - old.flat()).astype(np.float32).tobytes()))
                e = (net.e - old.e).reshape(-1, BLOCK * DIM)
                out += [(j, int(k), shard, self.rows[j], e[k].tobytes()) for k in np.flatnonzero(e.any(1))]
        return out


_CHANGES = pa.schema([("net", pa.int32()), ("block", pa.int32()), ("s", pa.int32()), ("n", pa.int64()), ("v", pa.binary())])


def _pass(nets: list[Cnn], rows: DataFrame, marked: DataFrame, counts: dict[int, int]) -> None:
    """The nets learn from every marked row once, in shards, and become the shards' mean."""
    n = counts[0] + counts[1]
    weight = (0.5 * n / counts[0], 0.5 * n / counts[1])
    shards = -(-n // SHARD)
    shared = rows.sparkSession.sparkContext.broadcast(nets)
    # a key's mark, then its texts by their hash: the first is learned from
    both = rows.select("k", F.lit(None).cast("int").alias("y"), "t").unionByName(marked.select("k", "y", F.lit(None).cast("string").alias("t")))
    both = both.select(F.pmod(F.xxhash64("k", F.lit(6)), F.lit(shards)).cast("int").alias("s"), _fold(len(nets) - 1).alias("q"), F.xxhash64("k", F.lit(5)).alias("h"), "k", "y", F.xxhash64("t", F.lit(5)).alias("th"), "t")
    both = both.repartitionById(shards, F.col("s")).sortWithinPartitions("s", "h", "k", F.col("t").isNotNull(), "th", "t").select("s", "q", "k", "y", "t")

    def learn(batches):
        now, last, mark, own = None, None, None, None
        for batch in batches:
            s, q, k, y = (batch.column(j).to_pylist() for j in range(4))
            runs: list[tuple[int, list[int], list[int]]] = []
            for i, key in enumerate(zip(s, k)):
                if key != last:
                    last, mark = key, y[i]
                if y[i] is None and mark is not None:
                    if not runs or runs[-1][0] != s[i]:
                        runs.append((s[i], [], []))
                    runs[-1][1].append(i)
                    runs[-1][2].append(mark)
                    mark = None
            for shard, where, marks in runs:
                if shard != now:
                    if own is not None:
                        yield from sent(own.changes(now))
                    now, own = shard, _Shard(shared.value, weight)
                at = 0
                for texts in text_lists(batch.column(4).take(pa.array(where))):
                    ids, first = buckets(texts)
                    for i, j in zip(first, first[1:]):
                        own.add(ids[i:j], marks[at], q[where[at]])
                        at += 1
        if own is not None:
            yield from sent(own.changes(now))
        release()

    def sent(found):
        for a in range(0, len(found), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found[a : a + 256]), _CHANGES)], schema=_CHANGES)

    def mean(batches):
        now, total, number = None, None, None
        for batch in batches:
            for net, block, n, v in zip(*(batch.column(j).to_pylist() for j in (0, 1, 3, 4))):
                if (net, block) != now:
                    if now is not None:
                        yield from sent([(*now, 0, 0, (total / np.maximum(number, 1)).astype(np.float32).tobytes())])
                    now, total, number = (net, block), 0.0, 0
                d = np.frombuffer(v, np.float32).astype(float)
                if block < 0:
                    total, number = total + n * d, number + n
                else:
                    total, number = total + d, number + np.repeat(d.reshape(-1, DIM).any(1), DIM)
        if now is not None:
            yield from sent([(*now, 0, 0, (total / np.maximum(number, 1)).astype(np.float32).tobytes())])

    kind = "net int, block int, s int, n long, v binary"
    parts = both.mapInArrow(learn, kind).repartition(min(shards, 64), "net", "block").sortWithinPartitions("net", "block", "s")
    for r in parts.mapInArrow(mean, kind).select("net", "block", "v").collect():
        d = np.frombuffer(r.v, np.float32)
        if r.block < 0:
            nets[r.net].add_flat(d)
        else:
            nets[r.net].e[r.block * BLOCK : (r.block + 1) * BLOCK] += d.reshape(-1, DIM)
    shared.destroy()


def _scores(nets: list[Cnn], rows: DataFrame, marked: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Raw scores of all marked rows by nets of other folds: value, label, number of rows and language. Rows are
    counted by steps of 1/GRID, without a language where it has under 25 rows of a label."""
    shared = rows.sparkSession.sparkContext.broadcast(nets)

    def raw(t: pa.Array, q: pa.Array) -> pa.Array:
        fold, out, at = q.to_numpy(zero_copy_only=False), [], 0
        for texts in text_lists(t):
            ids, first = buckets(texts)
            z, own = np.zeros(len(texts)), fold[at : at + len(texts)]
            for j in np.unique(own):
                some = np.flatnonzero(own == j)
                size = np.diff(first)[some]
                take = np.repeat(first[some] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                z[some] = shared.value[j].raw(ids[take], np.concatenate([[0], np.cumsum(size)]))
            out.append(z)
            at += len(texts)
        release()
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    scored = rows.select("k", "l", F.xxhash64("t", F.lit(5)).alias("h"), F.arrow_udf(raw, "double")("t", _fold(len(nets) - 1)).alias("z"))
    each = scored.groupBy("k").agg(F.min(F.struct("h", "z", "l")).alias("x")).join(marked, "k")
    step = F.least(F.greatest(F.floor(F.col("x.z") * GRID), F.lit(-FAR * GRID)), F.lit(FAR * GRID - 1)).cast("int")
    bins = written(each.groupBy(F.col("x.l").alias("l"), "y", step.alias("b")).agg(F.count("*").alias("n")), "toxicity-scores")
    known = bins.groupBy("l").agg(F.sum(F.col("n") * F.col("y")).alias("a"), F.sum(F.col("n") * (1 - F.col("y"))).alias("c")).filter("l IS NOT NULL AND a >= 25 AND c >= 25").select("l", F.col("l").alias("own"))
    found = bins.join(known, "l", "left").groupBy("own", "y", "b").agg(F.sum("n").alias("n")).collect()
    found.sort(key=lambda r: (r.b, r.y, r.own or "", r.own is None))
    shared.destroy()
    return (np.array([r.b for r in found]) + 0.5) / GRID, np.array([r.y for r in found], float), np.array([r.n for r in found], float), [r.own for r in found]


def fit(df: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", label: str = "toxic", learn: Column | None = None, most_each: int = 4000, most_bytes: int = 1 << 26) -> Cnn:
    """Fits on all rows whose key has a label of 0 or 1 and where `learn`, on the labels' key, holds; see the module for
    the part that training starts on. Of a key's several labels the largest counts, of its several texts the one of the
    smallest hash, so the model doesn't depend on partitions. Null texts count as empty. With rows of one label only,
    or none, every score is the same, and no text toxic unless all learned ones are.
    """
    modest_batches(df)
    rows = df.select(F.col(key).alias("k"), F.col(lang).cast("string").alias("l") if lang in df.columns else F.lit(None).cast("string").alias("l"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).filter("k IS NOT NULL")
    marked = labels.select(F.col(key).try_cast(df.schema[key].dataType).alias("k"), F.col(label).cast("int").alias("y"), (F.lit(True) if learn is None else learn).alias("s")).filter("s AND y IN (0, 1) AND k IS NOT NULL")
    marked = written(marked.groupBy("k").agg(F.max("y").alias("y")).join(rows.select("k"), "k", "left_semi"), "toxicity-labels")
    counts = {0: 0, 1: 0} | {r.y: r.n for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts[0] or not counts[1]:
        net = Cnn()
        net.o[:], net.b = 0, 3.0 if counts[1] else -3.0
        return net
    folds = 2 if min(counts.values()) >= ENOUGH else 4
    order = [F.xxhash64("k", F.lit(5)), F.col("k")]
    ids = marked.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy(*order))).filter(F.col("r") <= most_each).select("k", "y")
    few = rows.join(F.broadcast(ids), "k")  # at most 2 * most_each keys
    few = few.groupBy("k").agg(F.max("y").alias("y"), F.min(F.struct(F.xxhash64("t", F.lit(5)).alias("h"), F.col("t"), F.col("l"))).alias("x"))
    few = written(few.select("k", "y", "x.l", "x.t", F.octet_length("x.t").cast("long").alias("n")), "toxicity-start")
    ahead = F.sum("n").over(Window.partitionBy("y").orderBy(*order))
    some = few.filter(F.col("n") <= most_bytes // 16).select("k", "y", "n").withColumn("b", ahead).filter(F.col("b") <= most_bytes).select("k")

    def made(col: pa.Array) -> pa.Array:
        out = []
        for texts in text_lists(col):
            seen, first = buckets(texts)
            out += [seen[i:j].tobytes() for i, j in zip(first, first[1:])]
        return pa.array(out, pa.large_binary()).cast(pa.binary())

    found = few.join(F.broadcast(some), "k").select("k", "y", "l", _fold(folds).alias("q"), F.arrow_udf(made, "binary")("t").alias("v")).collect()
    found.sort(key=lambda r: (r.y, r.k))
    y, fold = np.array([r.y for r in found], float), np.array([r.q for r in found], int)
    docs = [np.frombuffer(r.v, np.int32).reshape(-1, 1 + len(PREFIXES)) for r in found]
    whole = len(found) == counts[0] + counts[1]
    if whole:
        fold = np.random.default_rng(11).permutation(len(docs)) % folds
    nets = [Cnn() for _ in range(folds + 1)]  # each but the last one leaves a fold out
    for j, net in enumerate(nets):
        own = np.flatnonzero(fold != j)
        net.train([docs[k] for k in own], y[own])
    if not whole:
        found = docs = None  # the driver needs the room
        release()
        if counts[0] + counts[1] <= MOST_BROADCAST:
            rows = rows.join(F.broadcast(marked.select("k")), "k", "left_semi")
        _pass(nets, rows, marked, counts)
    for net in nets:
        net.settle()
    if whole:
        z = np.array([nets[q].raw(d, np.array([0, len(d)]))[0] for d, q in zip(docs, fold)])
        nets[-1].calibrate(z, y, np.ones(len(y)), [r.l for r in found])
    else:
        nets[-1].calibrate(*_scores(nets, rows, marked))
    return nets[-1]


def score_toxicity(df: DataFrame, model: Cnn, text: str = "text", lang: str | None = "lang", out: str = "toxicity", flag: str = "toxic") -> DataFrame:
    """Adds the toxicity score of each whole text, of 0 to 1, and whether it passes its language's threshold.

    Null texts count as empty; these get the score of a text without words. The language column, null or not learned
    included, chooses the threshold alone, never the score; without one all rows have the same threshold. Equal texts
    have equal scores; every row is kept. Columns named as the new ones are replaced, others pass through. An empty
    table gives an empty table.
    """
    modest_batches(df)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(col: pa.Array) -> pa.Array:
        found = [shared.value.score(texts) for texts in text_lists(col)]
        release()
        return pa.array(np.concatenate(found) if found else [], pa.float64())

    scored = F.arrow_udf(run, "double")(F.col(text).cast("string"))
    limit = F.lit(model.threshold)
    if lang is not None and lang in df.columns:
        for l, t in sorted(model.by_lang.items()):
            limit = F.when(F.coalesce(F.col(lang).cast("string") == l, F.lit(False)), t).otherwise(limit)
    rows = df.withColumn("__lode_limit", limit).withColumn(out, scored)
    return rows.withColumn(flag, F.col(out) >= F.col("__lode_limit")).drop("__lode_limit")


def op5(spark, sf_dir: str) -> DataFrame:
    from .common import fold, table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, table(spark, sf_dir, "labels"), learn=fold("doc_id", 5) != 0)
    scored = score_toxicity(docs, model, out="score")
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic")
