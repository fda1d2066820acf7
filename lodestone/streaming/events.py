"""Structured Streaming: windows with watermarks, the sliding-window limit per key, appended logs, and ingestion."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources import files, logs


def read(spark: SparkSession, path: str, like: DataFrame, per_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet files with the schema of a table; path may be a pattern."""
    reader = spark.readStream.schema(like.schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def windows(stream: DataFrame, at: str = "ts", by: str = "event_type", value: str = "value", late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Counts and sums by tumbling window and key; rows that come later than `late` after the newest are left out by
    the watermark in modes that drop state."""
    w = F.window(at, size)
    out = stream.withWatermark(at, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), by, "n", "total")


def rate_limit(stream: DataFrame, key: str, at: str, tie: str, limit: int = 20, window: int = 60_000_000, expire: bool = False) -> DataFrame:
    """ST1 on a stream: (key, at, tie, admitted). The state of a key is its admitted times in the window, `limit` at
    most; with `expire` it is dropped when a key is idle for two windows (ST2). That is for streams without an end: a
    run over all there is wouldn't end, as there is always a time to wait for."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = f"{key} {kinds[key]}, {at} {kinds[at]}, {tie} {kinds[tie]}, admitted boolean"

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        # a micro-batch brings a key's rows in no order; they are few against the stream
        rows = pd.concat(list(frames)).sort_values([at, tie])
        admitted = []
        for now in rows[at]:
            times = [x for x in times if x >= now - window]
            admitted.append(len(times) < limit)
            if admitted[-1]:
                times.append(int(now))
        state.update((times,))
        if expire:
            state.setTimeoutDuration(max(1000, 2 * window // 1000))
        yield rows[[key, at, tie]].assign(admitted=admitted)

    return stream.groupBy(key).applyInPandasWithState(step, schema, "times array<long>", "append", "ProcessingTimeTimeout" if expire else "NoTimeout")


def run(out: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All there is, to a folder: appended as JSON lines or, in other modes, the latest result as Parquet."""
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        return writer.format("json").option("path", path).start()
    return writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()


def ingest(spark: SparkSession, folder: str, checkpoint: str, batch) -> StreamingQuery:
    """ST4: new files of a folder; batch(documents, number) is called with rows of files.read_documents()."""
    like = spark.read.format("binaryFile").load(folder).schema
    found = spark.readStream.format("binaryFile").schema(like).option("recursiveFileLookup", "true").load(folder)
    found = found.withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))).filter(F.col("suffix").isin(files.SCANNED))
    return found.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: batch(files.read_documents(df), n)).start()


def log(df: DataFrame, path: str) -> None:
    """ST6: rows added to a log."""
    logs.append_jsonl(df, path)
