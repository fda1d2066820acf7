"""Language identification by hierarchical discrimination.

A text's family is predicted first, by linear support vector machines of one family against the rest; within the
family, one-versus-one linear support vector machines separate its languages, which vote. All read the same vector:
square roots of counts of hashed byte n-grams of the whole lower-cased text, scaled to length 1.

The machines are fitted on a bounded sample: at most `per_language` texts of a language and `most_rows` in all, those
of the smallest hashes of their keys. Executors make the vectors, so the driver receives a fixed number of bytes a
row whatever the texts' lengths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import modest_batches, release, text_lists

BITS = 12
DIM = 1 << BITS
SIZES = (2, 3, 4)
UNKNOWN = "und"
#: Families of ISO 639-1 codes; a language that isn't here is a family of its own.
FAMILIES = {
    **dict.fromkeys("en de nl sv da no nb nn is af fy lb yi".split(), "germanic"),
    **dict.fromkeys("fr es it pt ro ca gl oc".split(), "romance"),
    **dict.fromkeys("ru uk be pl cs sk bg sr hr bs sl mk".split(), "slavic"),
    **dict.fromkeys("hi bn mr gu pa ur ne".split(), "indo-aryan"),
    **dict.fromkeys("fi et hu".split(), "uralic"),
    **dict.fromkeys("tr az kk uz".split(), "turkic"),
    **dict.fromkeys("ar he mt am".split(), "semitic"),
}


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


#: A longer text is counted in pieces of so many bytes that overlap by an n-gram less one byte.
PIECE = 1 << 20


def vectors(texts: list[str]) -> np.ndarray:
    """Unit vectors of square roots of n-gram counts, float32; an empty text's is zero."""
    out = np.zeros((len(texts), DIM), np.float32)
    over = max(SIZES) - 1
    for k, t in enumerate(texts):
        raw = (" " + t.lower() + " ").encode("utf-8", "replace") if t else b""
        counts = np.zeros(DIM, np.int64)
        for at in range(0, max(1, len(raw) - over), PIECE):
            b = np.frombuffer(raw[at : at + PIECE + over], np.uint8).astype(np.uint32)
            last = at + PIECE + over >= len(raw)
            gram = b
            for n in range(2, max(SIZES) + 1):
                if len(gram) < 2:
                    break
                gram = gram[:-1] << np.uint32(8) | b[n - 1 :]
                if n in SIZES:
                    own = gram if last else gram[:PIECE]
                    counts += np.bincount((own * np.uint32(0x9E3779B1 + 2 * n)) >> np.uint32(32 - BITS), minlength=DIM)
        out[k] = np.sqrt(counts)
    length = np.sqrt(np.einsum("ij,ij->i", out, out))
    return out / np.maximum(length, 1e-9)[:, None]


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 2e-4, steps: int = 150) -> np.ndarray:
    """Weights, the last one a bias, of a linear machine with squared hinge loss; y of -1 and 1, classes balanced."""
    n = len(x)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    rate = 0.25
    for step in range(steps):
        ahead = v
        slack = np.maximum(0, 1 - y * (x @ ahead[:-1].astype(np.float32) + ahead[-1]))
        g = -2 * weight * y * slack
        grad = np.concatenate([g.astype(np.float32) @ x, [g.sum()]]) + 2 * penalty * np.concatenate([ahead[:-1], [0]])
        new = ahead - rate * grad
        v = new + step / (step + 3) * (new - w)
        w = new
    return w if n else np.zeros(x.shape[1] + 1)


#: What is asked of a text's nearness to its language, of what was least among the learned; how many make a rule.
SLACK, LEAST = 0.8, 20


def _length_class(sizes: np.ndarray) -> np.ndarray:
    return np.minimum(63, np.log2(np.maximum(1, sizes)).astype(int))


class LanguageModel:
    def __init__(self, x: np.ndarray, langs: list[str], sizes: np.ndarray | None = None):
        """sizes: bytes of each text; without them every text fits its language."""
        self.langs = sorted(set(langs))
        self.family_of = {l: FAMILIES.get(l, f"({l})") for l in self.langs}
        self.families = sorted(set(self.family_of.values()))
        lang = np.array(langs, dtype=object)
        family = np.array([self.family_of[l] for l in langs], dtype=object)
        cols = []
        if len(self.families) > 1:
            for f in self.families:
                cols.append(svm(x, np.where(family == f, 1.0, -1.0)))
        self.pairs: list[tuple[str, str]] = []
        for f in self.families:
            own = [l for l in self.langs if self.family_of[l] == f]
            for k, a in enumerate(own):
                for b in own[k + 1 :]:
                    some = (lang == a) | (lang == b)
                    cols.append(svm(x[some], np.where(lang[some] == a, 1.0, -1.0)))
                    self.pairs.append((a, b))
        self._learn_fits(x, lang, sizes)
        w = np.array(cols).reshape(len(cols), -1) if cols else np.zeros((0, x.shape[1] + 1))
        self.w, self.b = w[:, :-1].T.astype(np.float32), w[:, -1]

    def _learn_fits(self, x: np.ndarray, lang: np.ndarray, sizes: np.ndarray | None) -> None:
        """How near a language's middle its texts are, by their length: the least near of those as long or longer, less
        SLACK. Of lengths under which fewer than LEAST texts were seen nothing is asked."""
        self.middle = np.zeros((len(self.langs), x.shape[1]), np.float32)
        self.near = np.zeros((len(self.langs), 64))
        for k, l in enumerate(self.langs if sizes is not None else ()):
            own = x[lang == l]
            total = own.sum(axis=0)
            self.middle[k] = total / max(1e-9, float(np.linalg.norm(total)))
            # a text's own share of the middle is taken out
            rest = total - own
            near = np.einsum("ij,ij->i", own, rest) / np.maximum(1e-9, np.linalg.norm(rest, axis=1))
            size = _length_class(sizes[lang == l])
            for c in range(64):
                longer = near[size >= c]
                if (size <= c).sum() >= LEAST:
                    self.near[k, c] = SLACK * longer.min() if len(longer) else self.near[k, c - 1]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        return self.judge(texts)[:2]

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, `und` where nothing is known; scores: the steeper of what family and language margins say; and
        how near each text is to the middle of its language, as a multiple of what is asked, 1 where nothing is."""
        n = len(texts)
        if not self.langs:
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n)
        x = vectors(texts)
        z = x @ self.w + self.b
        nf = len(self.families) if len(self.families) > 1 else 0
        if nf:
            best = z[:, :nf].argmax(1)
            second = np.partition(z[:, :nf], -2, axis=1)[:, -2] if nf > 1 else -z[:, 0]
            margin = (z[np.arange(n), best] - second) / 2
        else:
            best, margin = np.zeros(n, int), np.ones(n)
        place = {l: k for k, l in enumerate(self.langs)}
        votes, low = np.zeros((n, len(self.langs))), np.full((n, len(self.langs)), 9.0)
        for k, (a, b) in enumerate(self.pairs):
            m = z[:, nf + k]
            for l, s in ((a, m), (b, -m)):
                votes[:, place[l]] += (s > 0) + 0.01 * np.tanh(s)
                low[:, place[l]] = np.minimum(low[:, place[l]], s)
        fam = np.array([self.families.index(self.family_of[l]) for l in self.langs])
        votes[fam[None, :] != best[:, None]] = -1e9
        won = votes.argmax(1)
        least = np.minimum(margin, low[np.arange(n), won])
        score = 1 / (1 + np.exp(-4 * least))
        out = [self.langs[k] for k in won]
        asked = self.near[won, _length_class(np.array([len(t.encode("utf-8", "replace")) for t in texts], int))]
        fit = np.where(asked > 0, np.einsum("ij,ij->i", x, self.middle[won]) / np.maximum(asked, 1e-9), 1.0)
        for k, t in enumerate(texts):
            if not has_letter(t):
                out[k], score[k], fit[k] = UNKNOWN, 0.0, 0.0
        return out, score, fit


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", learn: Column | None = None, per_language: int = 600, most_rows: int = 6000) -> LanguageModel:
    """Fits on rows where `learn` holds and the language isn't null; see the module for the bounds of its sample."""
    rows = df.select(F.col(key).alias("k"), F.col(lang).cast("string").alias("l"), F.col(text).cast("string").alias("t"), (F.lit(True) if learn is None else learn).alias("s"))
    rows = rows.filter("s AND l IS NOT NULL AND t IS NOT NULL")
    order = [F.xxhash64("k", F.lit(6)), F.col("k")]
    ranked = rows.select("k", "l").withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(*order)))
    ids = ranked.filter(F.col("r") <= per_language).orderBy("r", "l").limit(most_rows).select("k").distinct()

    def made(col: pa.Array) -> pa.Array:
        return pa.array([v.tobytes() for texts in text_lists(col, rows=256) for v in vectors(texts)], pa.binary())

    few = rows.join(F.broadcast(ids), "k").filter(F.col("t").rlike(r"\p{L}"))  # at most most_rows keys
    found = few.select("l", F.octet_length("t").alias("n"), F.arrow_udf(made, "binary")("t").alias("v")).orderBy("l", F.xxhash64("v"), "n").limit(2 * most_rows).collect()
    x = np.frombuffer(b"".join(r.v for r in found), np.float32).reshape(-1, DIM)
    return LanguageModel(x, [r.l for r in found], np.array([r.n for r in found], int))


def identify(df: DataFrame, model: LanguageModel, text: str = "text", out: str = "lang_pred", score: str = "lang_score", fit: str | None = None) -> DataFrame:
    """Adds the predicted language of each whole text and a score of 0 to 1; with `fit` also how near the text is to
    the middle of that language, as a multiple of what its length lets expect: well under 1, it is in none learned.

    Null texts and texts without a letter, empty ones among them, are `und` with score and fit 0, as is everything if
    nothing was learned. Equal texts get equal answers; every row is kept. Columns named as the new ones are replaced, others
    pass through and are never looked at. An empty table gives an empty table.
    """
    modest_batches(df)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(col: pa.Array) -> pa.Array:
        langs, scores, fits = [], [], []
        for texts in text_lists(col, rows=256):
            l, s, f = shared.value.judge(texts)
            langs += l
            scores += s.tolist()
            fits += f.tolist()
        release()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(fits, pa.float64())], ["l", "s", "f"])

    at = "__lode_lang"
    new = {out: F.col(f"{at}.l"), score: F.col(f"{at}.s")} | ({fit: F.col(f"{at}.f")} if fit else {})
    # It runs once a row: a filter on what it returns would else be evaluated by a second run of it.
    once = F.arrow_udf(run, "l string, s double, f double").asNondeterministic()
    return df.withColumn(at, once(F.col(text).cast("string"))).withColumns(new).drop(at)


def op6(spark, sf_dir: str) -> DataFrame:
    from .common import fold, table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, learn=fold("doc_id", 4) != 2)
    found = identify(docs.select("doc_id", "text"), model, score="score")
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
