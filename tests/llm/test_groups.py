"""Operators on groups of rows against brute force."""

import collections
import random
import re

import numpy as np
import pytest

from lodestone.llm import common, components, embedding_dedup, minhash_dedup, mixing


def roots_of(n, edges):
    up = {k: k for k in n}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {k: find(k) for k in n}


@pytest.mark.parametrize("most", [10**6, 0])
def test_components(spark, most):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(k, k + 1) for k in range(100, 130)] + [(200, k) for k in range(201, 260)] + [(7, 7), (5, 6), (5, 6)]
    df = spark.createDataFrame(edges, "a long, b long")
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = {r.id: r.root for r in components.components(df, "a", "b", most).collect()}
    assert got == {k: v for k, v in roots_of({x for e in edges for x in e}, edges).items() if k in nodes}
    assert components.components(df.limit(0), "a", "b", most).count() == 0


def test_forest():
    rng = np.random.default_rng(1)
    for n, m in ((1, 0), (50, 30), (400, 300)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        want = roots_of(range(n), zip(a.tolist(), b.tolist()))
        assert components.forest(n, a, b).tolist() == [want[k] for k in range(n)]


def brute_vectors(rows, threshold):
    ok = lambda v, g: g is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)
    links, edges = collections.Counter(), []
    for i, (a, v, g) in enumerate(rows):
        for b, w, h in rows[:i]:
            if g == h and ok(v, g) and ok(w, h) and len(v) == len(w):
                x, y = np.array(v, np.float64), np.array(w, np.float64)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    edges.append((a, b))
    root = roots_of([r[0] for r in rows], edges)
    return {a: (links[a], root[a], root[a] == a) for a, _, _ in rows}


def vectors():
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for g in (1, 2, 2, 3):
        for _ in range(12):
            base = rng.normal(size=8)
            for _ in range(rng.integers(1, 6)):
                v = base + rng.normal(size=8) * rng.choice([0, 0.1, 0.3])
                rows.append((k, [float(np.float32(c)) for c in v], g))
                k += 1
    nan, inf = float("nan"), float("inf")
    for v, g in ((None, 1), ([], 1), ([0.0] * 8, 1), ([nan] + [1.0] * 7, 1), ([inf] + [1.0] * 7, 1), ([None] + [1.0] * 7, 1), (rows[0][1], None), ([1.0], 1), ([2.0], 1), ([-1.0], 1), ([1e-30] * 8, 2), ([1e30] * 8, 2)):
        rows.append((k, v, g))
        k += 1
    return rows


@pytest.mark.parametrize("block", [4096, 7])
def test_embeddings(spark, block):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, kept string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, block=block).collect()}
    want = brute_vectors(rows, 0.93)
    assert got == want and any(v[0] > 3 for v in want.values())
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_bounds_rule_out_nothing_that_links():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 64))
    x[150:] = x[:150] + rng.normal(size=(150, 64)) * 0.37  # cosines all around the threshold
    u = x / np.linalg.norm(x, axis=1)[:, None]
    a, b, checked = embedding_dedup.linked(x, None, 0.93)
    assert len(a) == (np.triu(u @ u.T, 1) >= 0.93).sum() and 0 < len(a) < checked < 150
    big = rng.normal(size=(20, 3000))
    assert len(embedding_dedup.linked(big, big, 0.93)[0]) == 20


def test_embedding_query(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.op7(spark, sf).collect()}
    assert got == brute_vectors(rows, 0.93)


def jaccard(s, t, n=3):
    def bag(x):
        w = re.findall(r"[0-9a-z_\x80-\U0010ffff]+", x.lower())
        return collections.Counter(zip(*(w[k:] for k in range(n))) if len(w) >= n else [tuple(w)] if w else [])

    a, b = bag(s), bag(t)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def copies():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows, k = [], 0
    for size in (1, 1, 1, 2, 3, 9, 30):
        base = [rng.choice(words) for _ in range(rng.randint(120, 400))]
        for _ in range(size):
            t = [w if rng.random() > 0.03 else rng.choice(words) for w in base] if rng.random() < 0.7 else base
            rows.append((k, " ".join(t)))
            k += 1
    for _ in range(10):  # these share a passage, and are no duplicates
        rows.append((k, " ".join(rng.choice(words) for _ in range(150)) + " " + passage))
        k += 1
    same = "the same " * 30
    for t in (None, None, "", "", " ", "!!", "one", "One.", "one two", "TWO ONE", same, same + "the", "x " * 4000, "x " * 4100):
        rows.append((k, t))
        k += 1
    rng.shuffle(rows)
    return rows


def brute_texts(rows, threshold=minhash_dedup.THRESHOLD):
    links, texts, edges = collections.Counter(), collections.defaultdict(set), []
    for i, (a, s) in enumerate(rows):
        for b, t in rows[:i]:
            if s is not None and t is not None and (s == t or jaccard(s, t) >= threshold):
                links[a] += 1
                links[b] += 1
                edges.append((a, b))
                if s != t:
                    texts[a].add(t)
                    texts[b].add(s)
    root = roots_of([r[0] for r in rows], edges)
    return {a: (links[a], len(texts[a]), root[a], root[a] == a) for a, _ in rows}


@pytest.mark.parametrize("how", [{}, {"bucket_block": 4, "bag_block": 5, "most_broadcast": 0}])
def test_texts(spark, how):
    rows = copies()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
    got = {r.doc_id: (r.n_links, r.n_texts, r.class_id, r.kept) for r in minhash_dedup.near_duplicates(df, **how).collect()}
    assert got == brute_texts(rows)
    assert minhash_dedup.near_duplicates(df.limit(0), **how).count() == 0


def test_repeated_rows_and_keys(spark):
    a, b = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    df = spark.createDataFrame([(1, a), (1, a), (1, b), (2, b + " end"), (None, a)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_copies, r.n_links, r.class_id or 0, r.kept) for r in minhash_dedup.near_duplicates(df).collect())
    assert got == [(0, 1, 0, 0, False), (1, 1, 1, 1, True), (1, 2, 1, 1, True), (1, 2, 1, 1, True), (2, 1, 1, 1, False)]


def test_texts_of_one_hash_are_told_apart(spark, monkeypatch):
    """With a first hash of two values only, results are those of brute force still."""
    from pyspark.sql import functions as F

    rows = [r for r in copies() if r[1] is None or len(r[1]) < 3000]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash_dedup, "text_hash", lambda c: F.when(c.isNotNull(), F.length(c) % 2))
    got = {r.doc_id: (r.n_links, r.n_texts, r.class_id, r.kept) for r in minhash_dedup.near_duplicates(df).collect()}
    assert got == brute_texts(rows)


def test_recall_near_the_threshold(spark):
    """Pairs of overlaps from 0.4 to 0.6 that nothing else links: how many of them are found."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(50_000)]
    rows, want = [], collections.defaultdict(list)
    while len(rows) < 1600:
        base = [rng.choice(words) for _ in range(rng.randint(80, 300))]
        at = rng.choice((0.06, 0.08, 0.1, 0.12, 0.14))
        other = [w if rng.random() > at else rng.choice(words) for w in base]
        s, t = " ".join(base), " ".join(other)
        j = jaccard(s, t)
        if 0.4 <= j < 0.6:
            want["0.4-0.45" if j < 0.45 else "0.45-0.5" if j < 0.5 else "0.5-0.6"].append(len(rows))
            rows += [(len(rows), s), (len(rows) + 1, t)]
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    recall = {b: sum(got[k + 1] == k for k in ks) / len(ks) for b, ks in sorted(want.items())}
    print("recall", recall, {b: len(ks) for b, ks in sorted(want.items())})
    assert min(recall.values()) >= 0.9 and all(len(ks) > 80 for ks in want.values())
    assert sum(got[k] != k - k % 2 for k in got) == sum(got[k + 1] != k for ks in want.values() for k in ks)  # no others


def test_text_query_on_real_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_links, r.n_texts, r.class_id, r.kept) for r in minhash_dedup.op9(spark, sf).collect()}
    assert got == brute_texts(rows)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    sets, want = [], []
    for _ in range(200):
        h = np.sort(rng.integers(1, 2**63, 60).astype(np.uint64))
        a = rng.integers(0, 20, 60)
        b = np.maximum(0, a + rng.integers(-8, 9, 60))
        want.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
        sets += [(h[a > 0], a[a > 0]), (h[b > 0], b[b > 0])]
    sig = minhash_dedup.signatures(sets, 256)
    got, want = (sig[0::2] == sig[1::2]).mean(axis=1), np.array(want)
    assert abs((got - want).mean()) < 0.006 and abs(got - want).max() < 0.13
    assert np.isinf(minhash_dedup.signatures([(np.zeros(0, np.uint64), np.zeros(0, int))], 8)).all()


def test_mixture(spark):
    rows = [(k, f"t{k}", ("hot" if k % 3 else "b") if k % 10 else None, "mine") for k in range(6000)] + [(None, None, "b", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, place string")
    w = {"hot": 0.2, "b": 0.5, "*": 0.3, "none": 0.9}
    mixed = mixing.mix_sources(df, w, size=2.0)
    got = mixed.collect()
    assert abs(len(got) - 12002) < 500
    share = collections.Counter(r.group for r in got)
    for g, want in (("hot", 0.2), ("b", 0.5), ("*", 0.3)):
        assert abs(share[g] / len(got) - want) < 0.02
    each = collections.Counter(r.doc_id for r in got if r.group == "b")
    assert sorted(r.copy for r in got if r.doc_id == max(each, key=each.get)) == list(range(max(each.values())))
    assert sorted(map(str, mixing.mix_sources(df.repartition(7), w, size=2.0).collect())) == sorted(map(str, got))
    mean = 12002 * 0.5 / sum(r[2] == "b" for r in rows)
    n = np.array([each[r[0]] for r in rows if r[2] == "b" and r[0] is not None])
    assert abs(n.mean() - mean) < 0.15 and abs(n.var() - mean) < 0.4
    assert mixing.mix_sources(df.limit(0), w).count() == 0 and mixing.mix_sources(df, {"hot": 0.0}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(df, {"hot": -1.0})


def test_large_means_and_hot_keys(spark):
    """A rare source of a large share, and rows that are equal in every column."""
    rows = [(k, "a") for k in range(4000)] + [(None, "rare")] * 2 + [(5000, "rare")]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    mixed = mixing.mix_sources(df, {"rare": 0.9, "*": 0.1})
    each = {r.doc_id: r.n for r in mixed.filter("source = 'rare'").groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    mean = 4003 * 0.9 / 3
    assert abs(each[None] / 2 - mean) < 6 * mean**0.5 and abs(each[5000] - mean) < 6 * mean**0.5
    plan = mixing.mix_sources(spark.range(40).selectExpr("id AS doc_id", "if(id = 0, 'big', 'x') AS source"), {"big": 0.999, "*": 0.001}, size=5000.0, shuffle=False)
    n = plan.filter("source = 'big'").count()
    assert abs(n - 199_800) < 6 * 199_800**0.5
    same = spark.createDataFrame([(7, "a")] * 4000, "doc_id long, source string").repartition(8)
    spread = mixing.mix_sources(same, {"*": 1.0}, size=9.0)
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = [r["count"] for r in spread.filter("copy = 0").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(held) == 4000 and max(held) < 3600


def test_large_means_in_sql(spark, tmp_path, monkeypatch):
    import duckdb

    docs = spark.createDataFrame([(k, "t", "en", "src0" if k else "src5", 1) for k in range(12_000)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = dict(db.sql(f"SELECT doc_id, count(*) FROM ({mixing.SQL}) GROUP BY 1").fetchall())
    got = {r.doc_id: r["count"] for r in mixing.op2(spark, str(tmp_path)).groupBy("doc_id").count().collect()}
    assert got == want and got[0] > 3000


def test_poisson_steps():
    for mean in (0.01, 1.0, 30.0, 400.0):
        c = mixing.cumulative(mean)
        assert c == sorted(c) and abs(c[-1] - 1) < 1e-9
        assert abs(sum(1 - x for x in c) - mean) < 1e-6 * max(1, mean)


def test_cut_uses_the_shared_folder(spark):
    df = common.cut(spark.range(5))
    assert df.count() == 5 and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()
