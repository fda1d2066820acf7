"""Mixing sources to target weights by Poisson replication.

Each group of sources has a target share of the mixture, hence a mean number of repetitions of its documents. A
document's own number is a Poisson variable of that mean, by inverting the distribution at a uniform number made of
the document's hash and a seed; the document is exploded by it, and copies are shuffled globally by a second hash.
A mean above PART is a sum of equal parts, each inverted at a uniform number of its own: a sum of independent Poisson
variables is one. The same seed gives the same mixture on any cluster.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The group of all sources that the weights don't name, null included.
OTHER = "*"
#: More groups than this are refused: their table is kept in the plan.
MOST_GROUPS = 10_000
#: The largest mean that is inverted at once: exp(-PART) is far from underflow.
PART = 500.0


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) of 52 bits from the md5 of key and seed, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("|" + seed))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def cumulative(mean: float) -> list[float]:
    """P(X <= k) for k = 0, 1, ... until no double under 1 is above."""
    p = total = math.exp(-mean)
    out, k = [total], 0
    while total < 1 - 2**-53 and (k < mean or p > 1e-18):
        k += 1
        p = p * mean / k
        total = total + p
        out.append(total)
    return out


def mix_sources(df: DataFrame, weights: dict[str, float], key: str = "doc_id", source: str = "source", size: float = 1.0, seed: str = "mix", shuffle: bool = True) -> DataFrame:
    """Repeats each row by a Poisson number so that groups of sources have the shares of `weights`, in expectation;
    the mixture has `size` times as many rows as df. Adds copy (from 0), group and place, the uniform number by whose
    hash rows are shuffled.

    `weights` names sources, and "*" all others with null among them (default weight 0 if it isn't given). Weights of
    groups without rows go to the rest in proportion. A row of weight 0 is left out, as is one whose Poisson number
    is 0: that is what the operator is for. Rows with equal keys have equal numbers; null keys count as empty text.
    Texts aren't looked at. Columns copy, group and place are replaced, others pass through. An empty table gives
    an empty table. Means have no upper bound: work grows with the rows of the mixture.
    """
    spark = df.sparkSession
    named = {s: w for s, w in weights.items() if s != OTHER}
    if len(weights) > MOST_GROUPS or any(not (w >= 0 and math.isfinite(w)) for w in weights.values()):
        raise ValueError("weights must be finite, not negative and not too many")
    names = F.array(*(F.lit(s) for s in sorted(named))) if named else F.array().cast("array<string>")
    group = F.when(F.coalesce(F.array_contains(names, F.col(source).cast("string")), F.lit(False)), F.col(source).cast("string")).otherwise(OTHER)
    # One count per group: the groups are those of `weights`.
    counts = {r["g"]: r["n"] for r in df.groupBy(group.alias("g")).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    there = math.fsum(weights.get(g, 0.0) for g in sorted(counts))
    means = {g: (size * total * (weights.get(g, 0.0) / there) / n if there else 0.0) for g, n in counts.items()}
    # The steps of each group's distribution, and how many parts it has: a table as small as `weights`.
    parts = {g: max(1, math.ceil(m / PART)) for g, m in means.items()}
    steps = spark.createDataFrame([(g, cumulative(m / parts[g]), parts[g]) for g, m in sorted(means.items()) if m > 0], "`__lode_g` string, `__lode_cdf` array<double>, `__lode_parts` int")
    # Rows that are equal in all columns are still spread by the partition that they come from.
    salt = F.pmod(F.xxhash64(*(F.col("`" + c.replace("`", "``") + "`").cast("string") for c in df.columns), F.spark_partition_id()), F.lit(1 << 20)) if shuffle else F.lit(0)
    out = df.withColumn("__lode_salt", salt).withColumn("__lode_g", group).join(F.broadcast(steps), "__lode_g")
    first = F.size(F.filter("__lode_cdf", lambda c: c <= F.col("__lode_u")))

    def add(total: Column, j: Column) -> Column:
        u = uniform(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), j.cast("string")), seed + "-part")
        return total + F.size(F.filter("__lode_cdf", lambda c: c <= u))

    rest = F.when(F.col("__lode_parts") > 1, F.aggregate(F.sequence(F.lit(1), F.col("__lode_parts") - 1), F.lit(0), add)).otherwise(0)
    out = out.withColumn("__lode_u", uniform(F.col(key), seed)).withColumn("__lode_n", first + rest)
    out = out.drop("__lode_cdf", "__lode_u", "__lode_parts", "copy", "group", "place").filter("__lode_n > 0")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__lode_n") - 1))).drop("__lode_n").withColumnRenamed("__lode_g", "group")
    out = out.withColumn("place", uniform(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), F.col("copy").cast("string")), seed + "-place"))
    # A row's partition and its order there are both hashes of its copy: copies of one row, rows of one source and
    # rows of one key end up anywhere.
    return out.repartition("place", "__lode_salt").drop("__lode_salt").sortWithinPartitions("place") if shuffle else out.drop("__lode_salt")


#: The production mixture: the crawl's largest source gives a tenth, curated ones more than their share.
WEIGHTS = {"src0": 0.10, "src1": 0.12, "src2": 0.12, "src3": 0.08, "src4": 0.08, "src5": 0.06, "src6": 0.06, OTHER: 0.38}


def op2(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return mix_sources(table(spark, sf_dir, "documents"), WEIGHTS)


def _sql() -> str:
    values = ", ".join(f"('{g}', {w!r}::DOUBLE)" for g, w in sorted(WEIGHTS.items()))
    named = ", ".join(f"'{g}'" for g in sorted(WEIGHTS) if g != OTHER)
    return f"""
WITH RECURSIVE w(g, w) AS (VALUES {values}),
d AS (SELECT *, CASE WHEN source IN ({named}) THEN source ELSE '*' END AS g FROM documents),
c AS (SELECT g, count(*) AS n FROM d GROUP BY g),
t AS (SELECT sum(n) AS total, sum(w) AS there FROM c JOIN w USING (g)),
m AS (SELECT g, mean / ceil(greatest(mean, 1e-9) / {PART}) AS mean, ceil(greatest(mean, 1e-9) / {PART})::BIGINT AS parts
  FROM (SELECT g, total * (w / there) / n AS mean FROM c JOIN w USING (g), t)),
steps(g, mean, k, p, s) AS (
  SELECT g, mean, 0, exp(-mean), exp(-mean) FROM m
  UNION ALL SELECT g, mean, k + 1, p * mean / (k + 1), s + p * mean / (k + 1) FROM steps WHERE s < 1 - 1.2e-16 AND (k < mean OR p > 1e-18)),
u AS (SELECT d.doc_id, d.g, ('0x' || substr(md5(CASE WHEN x.j = 0 THEN doc_id || '|mix' ELSE doc_id || '|' || x.j || '|mix-part' END), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM d JOIN m USING (g), LATERAL (SELECT unnest(range(parts)) AS j) x),
r AS (SELECT u.doc_id, count(*) AS reps FROM u JOIN steps s ON u.g = s.g AND s.s <= u.u GROUP BY u.doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.g AS "group", x.copy::INTEGER AS copy,
  ('0x' || substr(md5(d.doc_id || '|' || x.copy || '|mix-place'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS place
FROM d JOIN r USING (doc_id), LATERAL (SELECT unnest(range(reps)) AS copy) x
"""


SQL = _sql()
