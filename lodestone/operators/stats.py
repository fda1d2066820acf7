"""Aggregates: counts, chunk statistics, scoreboards, exclusive quantiles, gates, latencies and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify as p


def counts(df: DataFrame, *by: str) -> DataFrame:
    """A1: counts by columns with subtotals and the total (rollup)."""
    return df.rollup(*by).agg(F.count("*").alias("n"))


def chunk_stats(df: DataFrame, doc: str = "document_name", tokens: str = "token_count") -> DataFrame:
    """A2: chunks of no token count as chunks, and not in the statistics."""
    x = F.when(F.col(tokens) > 0, F.col(tokens))
    return df.groupBy(doc).agg(F.count("*").alias("chunks"), F.round(F.avg(x), 1).alias("avg_tokens"), F.min(x).alias("min_tokens"), F.max(x).alias("max_tokens"), F.count_if(F.col(tokens) == 0).alias("empty_chunks"))


RATES = {"intent_accuracy": "intent_ok", "recall_at_k": "document_hit", "keyword_any_hit": "any_hit", "keyword_all_hit": "all_hit"}
GATES = dict.fromkeys(("intent_accuracy", "recall_at_k"), 0.7) | {"grounding_avg": 0.5, "keyword_any_hit": 0.7}


def scoreboard(df: DataFrame) -> DataFrame:
    """A3 over rows of an evaluation (intent_ok, document_hit, any_hit, all_hit, grounding, error); nulls don't count."""
    rates = [F.round(F.avg(F.col(c).cast("double")), 3).alias(n) for n, c in RATES.items()]
    return df.agg(F.count("*").alias("n"), *rates, F.round(F.avg("grounding"), 3).alias("grounding_avg"), F.count("error").alias("n_errors"))


def gates(board: DataFrame) -> DataFrame:
    """A4: each gate and whether all hold; a rate that is null fails."""
    ok = [F.coalesce(F.col(c) >= least, F.lit(False)).alias(f"{c}_ok") for c, least in GATES.items()]
    out = board.select("*", *ok)
    passed = F.lit(True)
    for c in GATES:
        passed = passed & F.col(f"{c}_ok")
    return out.withColumn("passed", passed)


def exclusive_quantile(xs: Column, n: Column, q: float) -> Column:
    """Of a sorted array of n values, at (n + 1) q between its neighbours, within the array's ends."""
    h = (n + 1) * q
    j = F.greatest(F.lit(1), F.least(F.floor(h), n - 1)).cast("int")
    a, b = F.get(xs, j - 1), F.get(xs, j)
    return F.when(n < 2, F.get(xs, F.lit(0))).otherwise(a + (h - j) * (b - a))


def usage(df: DataFrame, by: str, value: str, low: float, high: float) -> DataFrame:
    """A5: statistics of a log per key; p90 from 11 values on and p99 from 101, else the maximum; and advice by the
    p90. The quantiles need a key's values in order: ranks are made by a window and picked by an aggregate, so a
    key's values are never gathered in one array."""
    w = Window.partitionBy(by).orderBy(value)
    r = df.filter(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("x"), F.row_number().over(w).alias("r"))
    n = df.filter(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("n"))
    r = r.join(n, by)

    def at(q: float) -> Column:
        h = (F.col("n") + 1) * q
        j = F.greatest(F.lit(1), F.least(F.floor(h), F.col("n") - 1))
        part = F.when(F.col("r") == j, 1 - (h - j)).when(F.col("r") == j + 1, h - j)
        return F.sum(F.col("x") * part)

    half = F.sum(F.when((F.col("r") == F.floor((F.col("n") + 1) / 2)) | (F.col("r") == F.floor((F.col("n") + 2) / 2)), F.col("x"))) / F.max(F.when(F.col("n") % 2 == 0, 2).otherwise(1))
    out = r.groupBy(by).agg(F.max("n").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), F.avg("x").alias("mean"), half.alias("median"), at(0.9).alias("p90"), at(0.99).alias("p99"))
    out = out.withColumn("p90", F.when(F.col("n") > 10, F.col("p90")).otherwise(F.col("most"))).withColumn("p99", F.when(F.col("n") > 100, F.col("p99")).otherwise(F.col("most")))
    return out.withColumn("advice", F.when(F.col("p90") > high, "raise").when(F.col("p90") < low, "lower").otherwise("keep"))


def stage_times(df: DataFrame, by: str, order: str, elapsed: str) -> DataFrame:
    """Each stage's own time from times since the start."""
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn("stage_ms", F.col(elapsed) - F.coalesce(F.lag(elapsed).over(w), F.lit(0)))


def expectation_gates(observed: DataFrame, expected: DataFrame, doc: str = "document_name") -> DataFrame:
    """Counts of chunks by document against lo and hi; documents without chunks have none."""
    n = F.coalesce("chunks", F.lit(0))
    status = F.when(n == 0, "empty").when(n < F.col("lo"), "too_few").when(n > F.col("hi"), "too_many").otherwise("ok")
    return expected.join(observed.select(doc, "chunks"), doc, "left").select(doc, "lo", "hi", n.alias("chunks"), status.alias("status"))


def dry_run(df: DataFrame, by: str, order: str, title: str, k: int = 8) -> DataFrame:
    """Counts by type and the first titles of each, nothing else of which is gathered."""
    w = Window.partitionBy(by).orderBy(order)
    first = df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k)
    titles = first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", F.col(title).alias("t")))), lambda x: x["t"]).alias("titles"))
    return df.groupBy(by).agg(F.count("*").alias("n")).join(titles, by)


def report_line(name: Column, value: Column, ok: Column) -> Column:
    """A14."""
    return F.concat(F.rpad(name, 24, " "), F.lpad(F.format_string("%.3f", value), 10, " "), F.when(ok, "  ok").otherwise("  FAIL"))


def keyword_hits(text: Column, keywords: Column) -> tuple[Column, Column, Column]:
    """Any, all and the missing ones; no keywords count as hit."""
    miss = p.missing_keywords(text, keywords)
    return (F.size(keywords) == 0) | (F.size(miss) < F.size(keywords)), F.size(miss) == 0, miss
