"""Queries of whole pipelines, of sinks read back, and of streams run over all there is."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import models
from ..durable import folder
from ..operators import search as r
from ..plans import pipelines
from ..sources import logs
from ..streaming import events
from .base import table
from .data import LIMIT, RATE_SQL, SPAN, filed
from .search import asked, chunks, sparse

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("jsonl_roundtrip", "SELECT doc_id::VARCHAR AS query_id, text AS query, lang AS intent, n_chars::INTEGER AS chunks_used FROM documents")
def jsonl_roundtrip(spark, d):
    path = folder(spark, "log")
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("query_id"), F.col("text").alias("query"), F.col("lang").alias("intent"), F.col("n_chars").cast("int").alias("chunks_used"))
    logs.append_jsonl(rows, path)
    return logs.read_jsonl(spark, path, logs.QUERY_LOG).select(rows.columns)


@query("index_roundtrip", "SELECT true AS same")
def index_roundtrip(spark, d):
    path, index = folder(spark, "index"), r.build_index(chunks(spark, d))
    want = r.save_index(index, path)
    back = r.load_index(spark, path)
    return r.checksum(back).select((F.col("checksum") == want).alias("same"))


@query("manifest_swap", "SELECT 'd' || doc_id AS document_name, sha256(text) AS content_hash FROM documents")
def manifest_swap(spark, d):
    path = folder(spark, "manifest")
    rows = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("document_name"), F.sha2("text", 256).alias("content_hash"), *(F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in logs.MANIFEST.split(", ")[2:]))
    logs.swap(rows.withColumn("content_hash", F.lit("old")), path)
    logs.swap(rows, path)
    return logs.manifest(spark, path).select("document_name", "content_hash")


@query("embed_documents")
def embed_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", models.HashedEncoder()(F.col("text")).alias("embedding"))


def encoded(spark, d):
    return chunks(spark, d).withColumn("embedding", models.HashedEncoder()(F.col("text")))


@query("retrieve")
def retrieve(spark, d):
    c = encoded(spark, d)
    return pipelines.retrieve(asked(spark, d).select("query_id", "query"), c, r.build_index(c)).drop("text")


@query("answer")
def answer(spark, d):
    c, q = encoded(spark, d), asked(spark, d).select("query_id", "query")
    return pipelines.answer(pipelines.retrieve(q, c, r.build_index(c)), q)


@query("ingest")
def ingest(spark, d):
    docs = filed(spark, d).withColumn("content_hash", F.sha2("text", 256)).withColumn("path", F.concat("path", F.lit("-"), "doc_id"))
    return pipelines.ingest(docs, spark.createDataFrame([], logs.MANIFEST))["summary"]


@query("stream_windows", "SELECT strftime(ts, '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, d):
    raw = events.read(spark, f"{d}/events.parquet*", spark.read.parquet(f"{d}/events.parquet")).withColumn("ts", F.col("ts").cast("timestamp"))
    path = folder(spark, "windows")
    events.run(events.windows(raw), path, path + "-checkpoint", "complete").awaitTermination()
    return spark.read.parquet(path).select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_rate_limit", RATE_SQL.replace("SELECT event_id, user_id, admitted, retry_after FROM r", "SELECT event_id, user_id, admitted FROM r"))
def stream_rate_limit(spark, d):
    raw = events.read(spark, f"{d}/events.parquet*", spark.read.parquet(f"{d}/events.parquet"))
    raw = raw.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")
    path = folder(spark, "limits")
    out = events.rate_limit(raw, "user_id", "us", "event_id", LIMIT, SPAN)
    events.run(out, path, path + "-checkpoint").awaitTermination()
    return spark.read.schema("user_id long, us long, event_id long, admitted boolean").json(path).select("event_id", "user_id", "admitted")


@query("log_hits")
def log_hits(spark, d):
    return logs.log_hits(r.with_text(sparse(spark, d, 5), chunks(spark, d)))
