"""URL filters: rules by host and path, and a logistic regression where no rule fits.

The regression reads hashed character n-grams of host and path, each hashed with its own salt. It is trained in
numpy from a small labelled table of URLs; the one here is made of public-knowledge vocabulary: words of gambling,
adult, pharmacy, tracking and spam sites against words of ordinary ones, and invented names that say nothing.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numtext import U, ngrams, salted

BITS = 16
SIZES = (3, 4, 5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BAD = "adult porn xxx sex nude escort cams hentai casino poker slots jackpot roulette betting bets gamble lottery bingo pills viagra cialis pharma meds steroids diet payday loans credit-fix spam spammy linkfarm seo-links ads adserver adclick banner-ads track tracker tracking popunder clickbait malware phish scam hack crack warez keygen torrent replica fake-watches cheap-rolex get-rich crypto-doubler free-money free-bets win-cash prize-claim hot-singles".split()
BAD_TAIL = "x win farm cheap free best online club 24 hub zone deal top bonus vip live now store".split()
GOOD = "news library museum university school city garden recipe travel weather science history music book journal forum wiki docs code data open health hospital council sports football cinema theatre gallery photo craft bakery hotel train airport bank law physics chemistry biology kitchen market village church park river mountain ocean energy climate housing radio magazine archive software hardware review".split()
GOOD_TAIL = "online hub daily times world guide house lab group project center club network review post today store".split()
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ing tion ble ly the and sh wh ka mo ni ru sa lo vi ta".split()
TLDS = ("com", "org", "net", "example.com", "example.org", "example.net", "info", "de", "fr", "es", "co.uk", "io")
FRONTS = ("", "", "www.", "m.", "blog.", "de.", "en.")
PATHS = ("/", "", "/{n}", "/en/{n}", "/de/{n}", "/fr/{n}", "/es/{n}", "/en/{n}.html", "/fr/{n}/", "/article/{n}", "/{w}/{n}", "/{w}-{v}", "/{y}/{m}/{w}", "/p/{n}.php", "/index.html", "/tag/{w}")


def labelled_urls(seed: int = 7, each: int = 700) -> list[tuple[str, str, int]]:
    """(host, path, 1 if it is to be blocked): the small table that the regression learns from."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 4)))
    out = []
    for label in (0, 1):
        for k in range(each):
            join = rng.choice(("-", "-", ""))
            if label:
                a, b = BAD[k % len(BAD)], rng.choice([*BAD_TAIL, *BAD, ""])
                name = rng.choice((f"{a}{join}{b}", f"{b}{join}{a}", f"{a}{join}{word()}", f"{word()}-{a}"))
            elif k % 2:
                name = word() if rng.random() < 0.8 else f"{word()}-{word()}"
            else:
                a, b = GOOD[k // 2 % len(GOOD)], rng.choice([*GOOD_TAIL, *GOOD, ""])
                name = rng.choice((f"{a}{join}{b}", f"{a}{join}{word()}", f"{word()}-{a}"))
            path = rng.choice(PATHS).format(n=rng.randint(1, 99999), w=rng.choice(BAD if label and rng.random() < 0.3 else GOOD), v=word(), y=rng.randint(2001, 2024), m=rng.randint(1, 12))
            out.append((f"{rng.choice(FRONTS)}{name.strip('-')}.{rng.choice(TLDS)}", path, label))
    return out


def _features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of n-grams, the URL of each, and its weight: every URL's vector has length 1 but for collisions."""
    h, ho = ngrams([f"^{x}$".encode() for x in hosts], SIZES)
    p, po = ngrams([f"^{x}$".encode() for x in paths], SIZES)
    bucket = (np.concatenate([salted(h, 1), salted(p, 2)]) >> U(64 - BITS)).astype(np.int64)
    owner = np.concatenate([ho, po])
    # Hosts weigh as much as paths, however long either is.
    n = len(hosts)
    nh, np_ = np.bincount(ho, minlength=n), np.bincount(po, minlength=n)
    weight = np.concatenate([1 / np.sqrt(2 * nh[ho]), 1 / np.sqrt(2 * np_[po])])
    return bucket, owner, weight


class UrlModel:
    def __init__(self, rows: list[tuple[str, str, int]], steps: int = 600, rate: float = 8.0, penalty: float = 1e-5):
        y = np.array([r[2] for r in rows], float)
        bucket, owner, value = _features([r[0] for r in rows], [r[1] for r in rows])
        self.w, self.b = np.zeros(1 << BITS), 0.0
        v, vb, n = np.zeros_like(self.w), 0.0, max(1, len(rows))
        for _ in range(steps):
            g = self._sigmoid(np.bincount(owner, value * self.w[bucket], minlength=len(rows)) + self.b) - y
            v = 0.9 * v - rate * (np.bincount(bucket, value * g[owner], minlength=len(self.w)) / n + penalty * self.w)
            vb = 0.9 * vb - rate * g.sum() / n
            self.w, self.b = self.w + v, self.b + vb
        self.w = self.w.astype(np.float32)

    @staticmethod
    def _sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def score(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        bucket, owner, value = _features(hosts, paths)
        return self._sigmoid(np.bincount(owner, value * self.w[bucket], minlength=len(hosts)) + self.b)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where the url is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


#: More rules than this are joined instead of written into the plan.
IN_PLAN = 200
#: So many rules at most are sent to every executor when they are joined.
MOST_BROADCAST = 100_000
#: Parts into which a hot host or suffix is spread where a side is too large to be sent.
SALTS = 32


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The rule that fits and its verdict, both null if none does. rules: (verdict, host/path); the longest that
    fits wins, the first among equals."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _salted(big: DataFrame, small: DataFrame, keys: list[str], by: Column, small_rows: int, most: int, how: str = "inner") -> DataFrame:
    """big joined to small, which is sent where it is small; else a key's rows in big are spread over SALTS copies."""
    if small_rows <= most:
        return big.join(F.broadcast(small), keys, how)
    many = small.withColumn("__lode_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("__lode_salt", F.pmod(by, F.lit(SALTS)).cast("int")).join(many, [*keys, "__lode_salt"], how).drop("__lode_salt")


def joined_rules(df: DataFrame, host: str, path: str, rules: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """As matching_rule, for any number of rules (verdict, rule, place): df with columns rule and verdict.

    Different URLs are joined by their hosts' suffixes to the lengths of path prefixes that rules for them have, then
    by suffix and prefix to the rules; so work grows with labels and lengths, not with rules."""
    slash = F.instr("rule", "/")
    rules = rules.filter("rule IS NOT NULL").groupBy("rule").agg(F.min(F.struct("place", "verdict")).alias("x")).select(
        F.when(slash > 0, F.substring_index("rule", "/", 1)).otherwise(F.col("rule")).alias("__lode_s"), F.when(slash > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise("").alias("__lode_f"),
        F.struct(F.length("rule").alias("n"), (-F.col("x.place")).alias("o"), F.col("rule").alias("rule"), F.col("x.verdict").alias("verdict")).alias("__lode_r"),
    )
    lengths = rules.groupBy("__lode_s").agg(F.collect_set(F.length("__lode_f")).alias("__lode_n"))
    n = rules.count()
    urls = df.select(F.col(host).alias("__lode_h"), F.col(path).alias("__lode_p")).distinct()
    labels = F.split("__lode_h", "[.]", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    by = F.xxhash64("__lode_h", "__lode_p", F.lit(3))
    found = _salted(urls.withColumn("__lode_s", F.explode(suffixes)), lengths, ["__lode_s"], by, n, most_broadcast)
    found = found.withColumn("__lode_k", F.explode(F.filter("__lode_n", lambda k: k <= F.length("__lode_p")))).withColumn("__lode_f", F.expr("substring(__lode_p, 1, __lode_k)"))
    found = _salted(found, rules, ["__lode_s", "__lode_f"], by, n, most_broadcast)
    best = found.groupBy("__lode_h", "__lode_p").agg(F.max("__lode_r").alias("__lode_r")).select(F.col("__lode_h").alias(host), F.col("__lode_p").alias(path), "__lode_r")
    out = _salted(df, best, [host, path], F.xxhash64(F.monotonically_increasing_id()), most_broadcast + 1, most_broadcast, "left")
    return out.withColumns({"rule": F.col("__lode_r.rule"), "verdict": F.col("__lode_r.verdict")}).drop("__lode_r")


def judge_urls(df: DataFrame, rules: list[tuple[str, str]] | DataFrame, labelled: list[tuple[str, str, int]] | None = None, url: str = "url", threshold: float = 0.5, in_plan: int = IN_PLAN) -> DataFrame:
    """Adds host, path, rule, verdict (allow or block) and block_score, the regression's probability.

    rules: (verdict, host/path) in a list, or a DataFrame (verdict, rule) of any size; of those that fit the longest
    wins, then the first of the list, or of a DataFrame the one of the smallest verdict, then rule. A null url, or one
    without `://`, has empty host and path, and if no rule fits is judged by the regression on empty strings. Every row is kept, repeated ones too; columns named as the new ones are replaced,
    others pass through; an empty table gives an empty table.
    """
    model = UrlModel(labelled if labelled is not None else labelled_urls())
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(hosts.to_pylist(), paths.to_pylist()), pa.float64())

    host, path = host_and_path(F.col(url).cast("string"))
    out = df.withColumn("__lode_h", host).withColumn("__lode_p", path)
    out = out.withColumn("block_score", F.arrow_udf(score, "double")("__lode_h", "__lode_p"))
    if isinstance(rules, DataFrame):
        rules = rules.select("verdict", "rule", F.when(F.col("verdict") == "allow", 0).otherwise(1).alias("place"))
        out = joined_rules(out.drop("rule", "verdict"), "__lode_h", "__lode_p", rules)
    elif len(rules) > in_plan:
        listed = df.sparkSession.createDataFrame([(v, r, k) for k, (v, r) in enumerate(rules)], "verdict string, rule string, place long")
        out = joined_rules(out.drop("rule", "verdict"), "__lode_h", "__lode_p", listed)
    else:
        rule, verdict = matching_rule(F.col("__lode_h"), F.col("__lode_p"), rules)
        out = out.withColumns({"rule": rule, "verdict": verdict})
    judged = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    out = out.withColumns({"verdict": F.coalesce("verdict", judged), "host": F.col("__lode_h"), "path": F.col("__lode_p")})
    return out.drop("__lode_h", "__lode_p")


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op4(spark, sf_dir: str) -> DataFrame:
    from .common import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "block_score")
