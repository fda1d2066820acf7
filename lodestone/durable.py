"""Cuts of lineage that survive the loss of an executor: tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is
    unset and Spark runs on this machine alone, as in tests; on a cluster that is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not named and not _own:
        _own.append(tempfile.mkdtemp(prefix="lodestone-"))
    return f"{named or _own[0]}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str = "table") -> DataFrame:
    path = folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
