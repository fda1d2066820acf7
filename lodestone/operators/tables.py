"""Tables that change: upserts, deletes, manifests, lookups with defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The last row of each key by version; by an aggregate, which combines before it shuffles."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max(F.struct(F.col(version).alias("__order"), *(F.col(c).alias(c) for c in rest))).alias("__x"))
    return top.select(*keys, *(F.col(f"__x.{c}").alias(c) for c in rest)).select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Last write wins: rows of new, the last of each key, and those of old whose key isn't among them."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(newest(new, keys, version))


def delete(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """S15 and J6."""
    return df.join(keys.select(on).distinct(), on, "left_anti")


def lookup(df: DataFrame, dim: DataFrame, on: str, defaults: dict) -> DataFrame:
    """A left join; what isn't found gets defaults (literals or Columns)."""
    j = df.join(dim, on, "left")
    return j.withColumns({c: F.coalesce(F.col(c), d if not isinstance(d, (str, int, float, bool)) else F.lit(d)) for c, d in defaults.items()})


def changes(now: DataFrame, manifest: DataFrame, key: str = "document_name", digest: str = "content_hash", force: bool = False) -> DataFrame:
    """P19 and ST4: each key as new, changed, unchanged (skip) or gone."""
    old = manifest.select(key, F.col(digest).alias("__old"))
    j = now.select(key, F.col(digest)).join(old, key, "full_outer")
    status = (
        F.when(F.col(digest).isNull(), "gone").when(F.col("__old").isNull(), "new")
        .when(F.lit(force) | ~F.col(digest).eqNullSafe(F.col("__old")), "changed").otherwise("unchanged")
    )
    return j.select(key, F.coalesce(digest, "__old").alias(digest), status.alias("status"))
