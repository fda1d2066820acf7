import random

import numpy as np

import corpus_pipeline
from lodestone.llm import language_id, minhash_dedup, toxicity
from lodestone.llm.common import fold
from lodestone.llm.numtext import Words


def test_words_against_plain_python():
    import re

    texts = ["", "A b", "a  B! c", "été ÉTÉ x_1", "the quick the", "\n", "x" * 50]
    w = Words(texts, (2, 4))
    plain = [(k, t) for k, s in enumerate(texts) for t in re.findall(r"[0-9a-z_\x80-\U0010ffff]+", s.lower())]
    assert w.owner.tolist() == [k for k, _ in plain]
    for col, cut in ((w.hash, None), (w.prefix[0], 2), (w.prefix[1], 4)):
        names = [t.encode()[:cut] for _, t in plain]
        assert len(set(zip(names, col.tolist()))) == len(set(names)) == len(set(col.tolist()))
    assert w.first.tolist() == [0, 0, 2, 5, 8, 11, 11, 12]


def test_long_texts_hash_alike_in_pieces(monkeypatch):
    from lodestone.llm import numtext

    texts = ["alpha beta gamma " * 200, "z", "longword" * 300, ""]
    whole = Words(texts)
    vec = language_id.vectors(texts)
    monkeypatch.setattr(numtext, "PIECE", 64)
    monkeypatch.setattr(language_id, "PIECE", 50)
    cut = Words(texts[:2])
    assert cut.hash.tolist() == whole.hash[: len(cut.hash)].tolist() and np.allclose(vec, language_id.vectors(texts))


def sentences(rng, words, n, size=(5, 60)):
    return [" ".join(rng.choice(words) for _ in range(rng.randint(*size))) for _ in range(n)]


def test_languages(spark, sf):
    rng = random.Random(1)
    vocab = {"en": "the and house water ing this through".split(), "de": "der und nicht haus wasser durch schon".split(), "fr": "le et maison eau cette dans tout".split(), "es": "el y casa agua esta para todo".split(), "xx": "zq zz qqz zqq qzz".split()}
    rows = [(k, t, l) for l, w in vocab.items() for k, t in enumerate(sentences(rng, w, 80), 1000 * len(l) + 100 * list(vocab).index(l))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language_id.fit(df)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !?", "x"), (4, "der und nicht " * 100_000, "x"), (4, "der und nicht", "y")], "doc_id long, text string, lang_pred string")
    got = sorted((r.doc_id, r.lang_pred, 0 <= r.lang_score <= 1) for r in language_id.identify(odd, m).collect())
    assert got == [(1, "und", True), (2, "und", True), (3, "und", True), (4, "de", True), (4, "de", True)]
    fresh = [(t, l) for l, w in vocab.items() for t in sentences(rng, w, 40)]
    assert np.mean([a == l for a, (_, l) in zip(m.predict([t for t, _ in fresh])[0], fresh)]) > 0.99
    none = language_id.fit(df.limit(0))
    assert none.predict(["a"])[0] == ["und"] and language_id.identify(odd.limit(0), none).count() == 0
    alone = language_id.fit(df.filter("lang = 'en'"))
    assert alone.predict(["le et"])[0] == ["en"]


def plain_language(m, text):
    """Language and score of a text in plain Python: n-grams one at a time, machine by machine."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    raw, counts = (" " + text.lower() + " ").encode(), {}
    for n in language_id.SIZES:
        for k in range(len(raw) - n + 1):
            h = int.from_bytes(raw[k : k + n], "big") * (0x9E3779B1 + 2 * n) % 2**32 >> 32 - language_id.BITS
            counts[h] = counts.get(h, 0) + 1
    length = sum(counts.values()) ** 0.5
    z = [sum(c**0.5 / length * float(m.w[h, j]) for h, c in counts.items()) + m.b[j] for j in range(m.w.shape[1])]
    ranked = sorted(z[: len(m.families)], reverse=True)
    family = m.families[z.index(ranked[0])]
    own = [l for l in m.langs if m.family_of[l] == family]
    votes, low = dict.fromkeys(own, 0.0), dict.fromkeys(own, 9.0)
    for (a, b), s in zip(m.pairs, z[len(m.families) :]):
        for l, v in ((a, s), (b, -s)):
            if l in votes:
                votes[l] += (v > 0) + 0.01 * np.tanh(v)
                low[l] = min(low[l], v)
    best = max(own, key=lambda l: votes[l])
    return best, 1 / (1 + np.exp(-4 * min((ranked[0] - ranked[1]) / 2, low[best])))


def test_language_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    m = language_id.fit(docs, learn=fold("doc_id", 4) != 2)
    assert len(m.families) == 2 and len(m.pairs) == 2
    got = {r.doc_id: r for r in language_id.op6(spark, sf).collect()}
    rows = docs.filter("text IS NOT NULL").collect()
    assert len(got) == docs.count()
    for r in rows:
        if len(r.text) < 3000:
            lang, score = plain_language(m, r.text)
            assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - score) < 1e-4


def test_texts_in_other_languages_do_not_fit(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    m = language_id.fit(docs, learn=fold("doc_id", 4) != 2)
    held = language_id.identify(docs.filter(fold("doc_id", 4) == 2), m, fit="fit")
    n, low = held.count(), held.filter(f"fit < {corpus_pipeline.LEAST_FIT}").count()
    assert n > 2000 and low <= 0.001 * n
    other = [
        "Это предложение на русском языке, которое никто не учил. И ещё одно предложение, чтобы было длиннее. ", "这是一个中文句子，没有人学过它。",
        "यह एक हिंदी वाक्य है जिसे कोई नहीं जानता और यहाँ एक और वाक्य है ", "To jest polskie zdanie, którego nikt nie zna, a tutaj jest jeszcze jedno zdanie w tym samym języku. ",
        "Tämä on suomenkielinen lause jota kukaan ei tunne, ja tässä on vielä toinen lause samaa kieltä varten. ", "bu bir türkçe cümledir ve kimse bilmiyor, burada aynı dilde bir cümle daha var ",
    ]
    planted = spark.createDataFrame([(10**7 + k, t * 8, None, "src1", 1) for k, t in enumerate(other)], "doc_id long, text string, lang string, source string, n_chars long")
    whole = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    kept = corpus_pipeline.language(spark, whole.unionByName(planted), "/root/testdata/sf0.1")
    assert kept.filter("doc_id >= 10000000").count() <= 1 and kept.count() >= 0.999 * whole.count()


def test_language_query_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").withColumn("h", fold("doc_id", 4) == 2).collect()}
    got = language_id.op6(spark, sf).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(docs) and all(r.held_out == docs[r.doc_id].h for r in got)
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.97


def test_toxicity(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "ba ce di fo gu".split() for b in "lan mer tis rok".split()]
    bad = ["vile", "foulish", "grimy"]
    rows = []
    for k in range(900):
        t = sentences(rng, words, 1, (10, 80))[0].split()
        toxic = k % 3 == 0
        for _ in range(2 * toxic):
            t.insert(rng.randrange(len(t)), rng.choice(bad) + rng.choice(("", "x", "ness")))
        rows.append((k, " ".join(t), "en" if k % 2 else None, int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    m = toxicity.fit(df, df.select("doc_id", "toxic"), learn=fold("doc_id", 5) != 0)
    held = toxicity.score_toxicity(df, m).withColumn("held", fold("doc_id", 5) == 0).filter("held").collect()
    truth = {r[0]: r[3] for r in rows}
    assert np.mean([r.toxic == bool(truth[r.doc_id]) for r in held]) > 0.97
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "!!", "b"), (4, "ba " * 200_000 + "vile", None), (5, "vile", "a"), (5, "vile", "b")], "doc_id long, text string, toxicity string")
    s = {(r.doc_id): r.toxicity for r in toxicity.score_toxicity(odd, m).collect()}
    assert s[1] == s[2] == s[3] < 0.5 and s[4] > 0.5 and s[5] > 0.5
    one = toxicity.fit(df, df.filter("toxic = 0").select("doc_id", "toxic"))
    assert not toxicity.score_toxicity(df, one).filter("toxic").count()
    assert toxicity.score_toxicity(df.limit(0), m).count() == 0
    texts = [r[1] for r in rows[:60]]
    ids, first = toxicity.buckets(texts)
    each = [m.raw(ids[a:b], np.array([0, b - a]))[0] for a, b in zip(first, first[1:])]
    assert np.allclose(each, m.raw(ids, first), atol=1e-4)


def test_max_pooling_against_brute_force():
    m = toxicity.Cnn(1)
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 1 << toxicity.BITS, (9, 4)).astype(np.int32)
    first = np.array([0, 1, 1, 4, 9])
    got, _, _, _ = m.pooled(ids, first, True)
    for k, (a, b) in enumerate(zip(first, first[1:])):
        x = np.concatenate([m.e[ids[a:b]].sum(1), np.zeros((toxicity.PAD, toxicity.DIM), np.float32)])
        want = []
        for w, f, c in zip(toxicity.WIDTHS, m.f, m.c):
            y = [np.zeros(toxicity.FILTERS)] + [sum(x[i + j] @ f[j] for j in range(w)) for i in range(b - a)]
            want.append(np.maximum(np.max(y, axis=0) + c, 0))
        assert np.allclose(got[k], np.concatenate(want), atol=1e-5)


def plain_score(m, text):
    """From the text to the score in plain Python, word by word and window by window."""
    import re

    top, base = (1 << 64) - 1, 0x9E3779B97F4A7C55

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & top
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & top
        return x ^ x >> 31

    def embedding(word):
        raw = word.encode()
        total = np.zeros(toxicity.DIM)
        for n in (None, *toxicity.PREFIXES):
            h = sum((c + 1) * pow(base, j, 1 << 64) for j, c in enumerate(raw[:n])) & top
            total += m.e[mix(h + (n or 0) & top) >> 64 - toxicity.BITS]
        return total

    words = [embedding(w) for w in re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (text or "").lower())]
    words += [np.zeros(toxicity.DIM)] * toxicity.PAD
    z = m.b
    for w, width in enumerate(toxicity.WIDTHS):
        for q in range(toxicity.FILTERS):
            best = max([0.0] + [sum(float(words[i + j] @ m.f[w][j][:, q]) for j in range(width)) for i in range(len(words) - toxicity.PAD)])
            z += m.o[w * toxicity.FILTERS + q] * max(0.0, best + m.c[w][q])
    return 1 / (1 + np.exp(-(m.slope * z + m.shift)))


def test_toxicity_scores_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), learn=fold("doc_id", 5) != 0)
    assert abs(m.slope) > 0 and m.e.std() > 0
    short = [(r.doc_id, r.text) for r in docs.filter("length(text) < 1500").collect()][:40] + [(-1, None), (-2, ""), (-3, "été ab")]
    truth = {k: plain_score(m, t) for k, t in short}
    for r in toxicity.score_toxicity(spark.createDataFrame(short, "doc_id long, text string"), m, out="score").collect():
        assert abs(r.score - truth[r.doc_id]) < 1e-5 and r.toxic == (r.score >= m.threshold)
    query = {r.doc_id: (r.score, r.predicted) for r in toxicity.op5(spark, sf).collect()}
    for k, t in short[:40]:
        assert abs(query[k][0] - truth[k]) < 1e-5 and query[k][1] == (query[k][0] >= 0.5)


def test_toxicity_is_fitted_alike_however_rows_lie(spark):
    rng = random.Random(2)
    rows = [(k % 150, " ".join(rng.choice(["vile", "ba", "ce", "di", "fo"]) for _ in range(12)), None) for k in range(300)] + [(900, "x " * 5000, None), (None, "ba", None)]
    labels = [(k, int(k % 3 == 0)) for k in range(150)] + [(900, 1), (1, 1), (None, 1)]
    df, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    a, b = toxicity.fit(df, marks), toxicity.fit(df.repartition(7), marks.repartition(3))
    assert np.array_equal(a.e, b.e) and (a.b, a.slope, a.shift) == (b.b, b.slope, b.shift)
    few = toxicity.fit(df, marks, most_each=40, most_bytes=16 * 500)  # the long text is left out
    assert not np.array_equal(few.e, a.e)
    assert toxicity.fit(df.limit(0), marks).raw(np.zeros((0, 4), np.int32), np.array([0, 0]))[0] == -3.0


def toxic_rows(spark, n=600):
    """Keys, with the words of toxic rows: vile ones in the first 40 of either label by hash, grimy ones in all others."""
    rng = random.Random(6)
    labels = [(k, int(k % 3 == 0)) for k in range(n)]
    hashes = {r.k: (r.h, r.k) for r in spark.createDataFrame([(k,) for k in range(n)], "k long").selectExpr("k", "xxhash64(k, 5) h").collect()}
    first = {k for y in (0, 1) for k in sorted((k for k, v in labels if v == y), key=hashes.get)[:40]}
    rows = []
    for k, y in labels:
        t = [rng.choice(["ba", "ce", "di", "fo", "gu", "lan"]) for _ in range(20)]
        if y:
            t[rng.randrange(20)] = "vile" if k in first else "grimy"
        rows.append((k, " ".join(t), "en" if k % 2 else None))
    return rows, labels, hashes


def test_toxicity_is_learned_and_calibrated_on_all_rows(spark, monkeypatch):
    rows, labels, _ = toxic_rows(spark)
    df, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels + [(10**6, 1)], "doc_id long, toxic int")
    counted = []
    calibrate = toxicity.Cnn.calibrate

    def spied(self, z, y, weight, lang):
        counted.append((weight[y == 1].sum(), weight[y == 0].sum(), sum(w for w, l in zip(weight, lang) if l == "en")))
        calibrate(self, z, y, weight, lang)

    monkeypatch.setattr(toxicity.Cnn, "calibrate", spied)
    monkeypatch.setattr(toxicity, "SHARD", 250)
    m = toxicity.fit(df, marks, most_each=40)
    assert m.score(["ba ce grimy fo"])[0] > 0.5 > m.score(["ba ce di fo"])[0] and "en" in m.by_lang
    again = toxicity.fit(df.repartition(5), marks.repartition(3), most_each=40)
    assert np.array_equal(m.e, again.e) and (m.slope, m.shift, m.by_lang) == (again.slope, again.shift, again.by_lang)
    toxicity.fit(df, marks)
    assert counted == [(200, 400, 300)] * 3
    long = spark.createDataFrame([(k, "awful " * 2000 if y else "ba ce di " * 2, None) for k, y in labels[:90]], df.schema)
    assert toxicity.fit(long, marks, most_bytes=16 * 500).score(["ba awful"])[0] > 0.5
    monkeypatch.setattr(toxicity, "MOST_BROADCAST", 10)
    shuffled = toxicity.fit(df, marks, most_each=40)
    assert np.array_equal(m.e, shuffled.e) and (m.slope, m.shift, m.by_lang) == (shuffled.slope, shuffled.shift, shuffled.by_lang)


def test_toxicity_pass_over_shards_against_one_process(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows, labels, hashes = toxic_rows(spark, 300)
    rows.append((7, rows[8][1], None))  # a second text of a key; and one without a label
    monkeypatch.setattr(toxicity, "SHARD", 130)
    df = spark.createDataFrame([(k, l, t) for k, t, l in rows] + [(999, None, "vile")], "k long, l string, t string")
    place = {(r.k, r.t): r for r in df.select("k", "t", F.expr("pmod(xxhash64(k, 6), 3)").alias("s"), F.expr("pmod(xxhash64(k, 7), 2)").alias("q"), F.expr("xxhash64(t, 5)").alias("th")).collect()}
    nets = [toxicity.Cnn(k) for k in range(3)]
    shards = [toxicity._Shard(nets, (0.75, 1.5)) for _ in range(3)]
    texts = {}
    for k, t, _ in rows:
        texts[k] = min([t, texts.get(k, t)], key=lambda x: place[k, x].th)
    for k in sorted(texts, key=hashes.get):
        r = place[k, texts[k]]
        shards[r.s].add(toxicity.buckets([r.t])[0], dict(labels)[k], r.q)
    for a in shards:
        a.changes(0)  # takes the last steps
    weight = np.array([a.rows for a in shards])
    want = []
    for j, net in enumerate(nets):
        d = np.stack([a.nets[j].e - net.e for a in shards])
        e = net.e + d.sum(0) / np.maximum(1, d.any(2).sum(0))[:, None]
        want.append((e, net.flat() + sum(w * (a.nets[j].flat() - net.flat()) for w, a in zip(weight[:, j], shards)) / weight[:, j].sum()))
    assert weight[:, 2].sum() == 300 == weight[:, :2].sum()
    toxicity._pass(nets, df, spark.createDataFrame(labels, "k long, y int"), {0: 200, 1: 100})
    for net, (e, flat) in zip(nets, want):
        assert np.allclose(net.e, e, atol=1e-5) and np.allclose(net.flat(), flat, atol=1e-5)


def test_toxicity_scores_of_equal_texts_are_equal_wherever_they_lie(monkeypatch):
    rng = random.Random(8)
    m = toxicity.Cnn(1)
    m.settle()
    texts = ["", "vile", *sentences(rng, ["ba", "ce", "vile", "di"], 60, (1, 9))]
    alone = {t: m.score([t])[0] for t in texts}
    for _ in range(200):
        some = [rng.choice(texts) for _ in range(rng.randint(1, 30))]
        assert [alone[t] for t in some] == m.score(some).tolist()
    monkeypatch.setattr(toxicity, "PIECE", 4)
    assert list(alone.values()) == m.score(list(alone)).tolist()


def test_toxicity_query_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in toxicity.op5(spark, sf).collect() if r.held_out and r.doc_id in truth]
    tp = sum(r.predicted and truth[r.doc_id] for r in rows)
    assert tp / sum(r.predicted for r in rows) > 0.9 and tp / sum(truth[r.doc_id] for r in rows) > 0.8
    good = np.cumsum([truth[r.doc_id] for r in sorted(rows, key=lambda r: -r.score)])
    precision = [g / (k + 1) for k, (g, r) in enumerate(zip(good, sorted(rows, key=lambda r: -r.score))) if truth[r.doc_id]]
    print("held-out average precision", np.mean(precision), tp / sum(r.predicted for r in rows), tp / sum(truth[r.doc_id] for r in rows))
    assert np.mean(precision) >= 0.945


def test_pipeline_stages_against_their_operators(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "src1", 0), (10**6 + 2, "12 34", "en", "src1", 5)], docs.schema)
    kept = corpus_pipeline.language(spark, docs.unionByName(extra), sf)
    assert kept.columns == docs.columns and kept.filter("doc_id >= 1000000").count() == 0 and kept.count() == docs.count()
    clean = corpus_pipeline.toxic(spark, kept, sf)
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    left = {r.doc_id for r in clean.collect()}
    assert sum(k in left for k, v in truth.items() if not v) > 0.97 * sum(not v for v in truth.values())
    one = corpus_pipeline.near_dedup(spark, clean, sf)
    found = minhash_dedup.near_duplicates(clean).collect()
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in found if r.kept} and one.columns == docs.columns
    twice = corpus_pipeline.near_dedup(spark, one.unionByName(one.limit(5)), sf)
    assert twice.count() == one.count()
    mixed = corpus_pipeline.mix(spark, one, sf)
    assert mixed.columns == docs.columns and mixed.count() > 0
    ids = corpus_pipeline.encoding(spark, mixed, sf)
    assert ids.count() == mixed.count() and ids.filter("size(ids) <> n_tokens").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_dedup", "mixing", "encoding"]


def test_the_whole_pipeline_on_empty_and_odd_tables(spark, tmp_path):
    """run() against its stages one by one, with null and empty texts, nulls in every column and repeated rows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", None, "src1", 0), (None, "the of and in the house of", None, None, None), (10**6 + 2, "x " * 50_000, "en", None, 1)] + [(10**6 + 3, "of the and in with " * 9, "en", "src1", 5)] * 2, docs.schema)
    for name, table in (("whole", docs.unionByName(odd)), ("empty", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        (labels if name == "whole" else labels.limit(0)).write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    got = corpus_pipeline.run(spark, f"{tmp_path}/whole")
    want = spark.read.parquet(f"{tmp_path}/whole/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        want = stage(spark, want, f"{tmp_path}/whole")
    key = lambda r: (r.doc_id or 0, r.n_tokens, r.decoded_sha256)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) and got.count() > 50
    assert got.filter("doc_id IN (1000000, 1000001)").count() == 0
