import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from lodestone.llm import bpe_codec, token_count

SPM, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n", "\n\n a", "a  b", " a ", "▁ ▁▁", "<s> </s> <unk> <0x0A>", "<|endoftext|> a<|startoftext|>b", "ΑΣ ΣΑΣ", "a b c", "é É İ", "日本語 🙂🏽", "\x00\x1c\x1f a\x1db", "it's I'LL 'S", "12 ½ ２"]


def fuzz(n=400):
    rng = random.Random(2)
    letters = "abcdefgh  THE're's'll éÉ日本 \n\t\x1c\x00\xa0ΣςİßDž1２½🙂́▁<>|"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 15))) for _ in range(2000)]
    return ODD + texts + [" ".join(words[k : k + 40]) for k in range(0, 2000, 40)] + ["x" * 5000, "the " * 3000, "thequickbrownfox" * 4000, "".join(rng.choice("etaoin") for _ in range(60_000))]


@pytest.fixture(scope="module")
def texts(spark, sf):
    return fuzz() + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(100).collect()]


def test_counts_equal_the_library(texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=SPM)
    c = token_count.PieceCounter(SPM)
    assert [c.count(t) for t in texts] == [len(x) for x in sp.encode(texts, num_threads=1)]


def test_counts_when_nothing_is_remembered(monkeypatch):
    monkeypatch.setattr(token_count, "REMEMBERED", 3)
    c = token_count.PieceCounter(SPM)
    assert [c.count("a b c d e f g") for _ in range(3)] == [7] * 3 and len(c) <= 3


def test_ids_and_decoding_equal_the_library(texts):
    from tokenizers import Tokenizer

    t, c = Tokenizer.from_file(BPE), bpe_codec.BpeCodec(BPE)
    got = c.encode_batch(texts)
    want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want
    assert [c.decode(g) for g in got] == [t.decode(w, skip_special_tokens=False) for w in want]
    assert c.encode_batch(texts) == got  # all remembered now
    assert c.guessed and c.exact


def test_either_merging_is_the_same():
    c, rng = bpe_codec.BpeCodec(BPE), random.Random(9)
    for _ in range(300):
        w = c.pieces("".join(rng.choice("aabehnorst") for _ in range(rng.randint(1, 90))))
        assert c.merged(w) == c.merged_long(w)


def test_compatible_pairs_against_merging():
    c, rng = bpe_codec.BpeCodec(BPE), np.random.default_rng(4)
    ends = np.array([t.endswith(c.suffix) for t in c.of])
    sound = [k for k in rng.integers(0, len(c.of), 600).tolist() if c.is_sound(k)]
    left = [k for k in sound if not ends[k]]
    pairs = [(a, b) for a in left[:60] for b in sound[:60]]

    def leaves(k):
        return [k] if c.left[k] == k else leaves(int(c.left[k])) + leaves(int(c.right[k]))

    want = [c.merged(leaves(a) + leaves(b)) == [a, b] for a, b in pairs]
    got = c.compatible(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert got.tolist() == want and 0 < sum(want) < len(want)


def test_frames(spark):
    rows = [(1, "Hello  world", "x"), (2, None, None), (2, "", "y"), (3, "a", "z"), (3, "a", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = token_count.token_counts(df, SPM)
    assert got.columns == ["doc_id", "text", "n_tokens"] and sorted(r.n_tokens for r in got.collect()) == [0, 0, 1, 1, 3]
    coded = bpe_codec.encode(df, BPE)
    assert sorted((r.doc_id, r.n_tokens, r.decoded) for r in coded.collect())[0] == (1, 2, "hello</w> world</w>")
    back = bpe_codec.decode(coded.drop("decoded"), BPE)
    assert sorted(r.decoded for r in back.collect()) == ["", "", "a</w>", "a</w>", "hello</w> world</w>"]
    assert bpe_codec.encode(df.limit(0), BPE).count() == token_count.token_counts(df.limit(0), SPM).count() == 0


def test_stage_of_the_pipeline_decodes(spark, sf):
    import corpus_pipeline
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(10**6 + k, x, "en", "src1", 0) for k, x in enumerate([*ODD, None])], docs.schema))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = corpus_pipeline.encoding(spark, docs, sf).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.ids, r.n_tokens) == (ids, len(ids))
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stage_of_the_pipeline_remembers_little(monkeypatch):
    import pyarrow as pa

    import corpus_pipeline

    rng, most = random.Random(9), 0
    texts = [" ".join(f"{rng.choice('abcdefgh')}{rng.getrandbits(40):x}w" for _ in range(400)) for _ in range(500)] + ODD
    batch = bpe_codec.BpeCodec.encode_batch

    def watched(self, *args):
        nonlocal most
        out = batch(self, *args)
        most = max(most, len(self.chunks))
        return out

    monkeypatch.setattr(bpe_codec.BpeCodec, "encode_batch", watched)
    encoded = lambda *args: pa.chunked_array(list(bpe_codec._encoded(BPE, bpe_codec.DECODED_DIGEST, *args)(iter([pa.array(texts)])))).to_pylist()
    whole, top = encoded(), most
    most = 0
    assert encoded(corpus_pipeline.REMEMBERED) == whole
    # what is remembered, and a batch that has no more
    assert most <= 2 * corpus_pipeline.REMEMBERED < top


def test_queries(spark, sf):
    import sentencepiece
    from tokenizers import Tokenizer

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sp, t = sentencepiece.SentencePieceProcessor(model_file=SPM), Tokenizer.from_file(BPE)
    for r in token_count.op1(spark, sf).collect():
        n = len(sp.encode(docs[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(docs[r.doc_id].encode()), n > 4096)
    for r in bpe_codec.op8(spark, sf).collect():
        ids = t.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_decoding_of_unknown_and_null_ids(spark):
    from tokenizers import Tokenizer

    import public_tokenizers
    from lodestone.llm import bpe_codec

    file = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(file)
    df = spark.createDataFrame([(1, [320, 60_000, 321]), (2, [320, None]), (3, [-1]), (4, []), (5, None), (6, [49407, 320])], "k int, ids array<int>")
    got = {r.k: r.decoded for r in bpe_codec.decode(df, file).collect()}
    assert got[1] == library.decode([320, 60_000, 321], skip_special_tokens=False) and got[6] == library.decode([49407, 320], skip_special_tokens=False)
    assert got[2] == library.decode([320], skip_special_tokens=False) and got[3] == got[4] == "" and got[5] is None
