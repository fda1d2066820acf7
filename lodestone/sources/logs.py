"""Logs, conversations, manifests and collections: sources and sinks with stated schemas."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HIT = "struct<chunk_id:string,document_name:string,score:double,text_preview:string>"
QUERY_LOG = (
    f"query_id string, timestamp string, query string, session_id string, intent string, rewritten_query string, followup_anchor string, retrieved array<{HIT}>, reranked array<{HIT}>, "
    "filters_applied map<string,string>, answer string, grounding struct<ratio:double,grounded:bigint,total:bigint,reason:string>, confidence string, chunks_used int, latency_ms map<string,double>, error string, extras map<string,string>"
)
USAGE_LOG = "timestamp string, query string, chunks_used int, tokens_used int, max_context_tokens int, available_for_chunks int"
EMBEDDING_LOG = "timestamp string, chunk_id string, source_file string, chunk_length_chars int, success boolean, error string, dim int"
CONVERSATION = "session_id string, created_at string, updated_at string, messages array<struct<role:string,content:string,timestamp:string,metadata:map<string,string>>>"
MANIFEST = "document_name string, content_hash string, chunks_stored int, chunks_created int, ingested_at string, source_type string"
EVAL = "id string, query string, intent_expected string, document_expected string, keywords_any array<string>, keywords_all array<string>, min_grounding double, notes string"


def append_jsonl(df: DataFrame, path: str) -> None:
    """A line a row, added to what is there."""
    df.write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that aren't JSON are passed over."""
    x = F.from_json("value", schema)
    return spark.read.text(path).filter(F.get_json_object("value", "$").isNotNull()).select(x.alias("x")).select("x.*")


def log_hits(hits: DataFrame, query: str = "query_id") -> DataFrame:
    """Hits as a log has them: no vectors, 120 characters of text, scores of 4 digits, in rank order."""
    hit = F.struct(F.col("chunk_id").cast("string").alias("chunk_id"), "document_name", F.round("score", 4).alias("score"), F.substring("text", 1, 120).alias("text_preview"))
    rows = F.array_sort(F.collect_list(F.struct("rank", hit.alias("h"))))
    return hits.groupBy(query).agg(F.transform(rows, lambda x: x["h"]).alias("retrieved"))


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, turn, role, content, at) of a folder of sessions, a JSON file each."""
    df = spark.read.schema(CONVERSATION).option("multiLine", "true").json(path)
    return df.select("session_id", F.posexplode("messages").alias("turn", "m")).select("session_id", "turn", "m.role", "m.content", F.col("m.timestamp").alias("at"))


def save_conversations(df: DataFrame, path: str) -> None:
    """Sessions as rows of the same shape. `messages` of a session are bounded by sessions.history before."""
    m = F.struct("turn", F.struct("role", "content", F.col("at").alias("timestamp")).alias("m"))
    rows = df.groupBy("session_id").agg(F.min("at").alias("created_at"), F.max("at").alias("updated_at"), F.transform(F.array_sort(F.collect_list(m)), lambda x: x["m"]).alias("messages"))
    rows.write.mode("overwrite").json(path)


def eval_queries(spark: SparkSession, path: str) -> DataFrame:
    """A YAML or JSON file on the driver, a list or an object with `queries`."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("no YAML library is installed") from e
        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    found = found.get("queries", []) if isinstance(found, dict) else found
    names = [x.split()[0] for x in EVAL.split(", ")]
    return spark.createDataFrame([tuple(x.get(n) for n in names) for x in found], EVAL)


# -- tables that are replaced as a whole


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


CURRENT = "CURRENT"


def swap(df: DataFrame, path: str) -> None:
    """A new version beside the others, to which a small pointer file is then turned by one rename over it: a
    reader finds the old table or the new one, also if the writer dies in between. The version before the one that is
    replaced is removed; that one stays, for readers that have begun."""
    spark = df.sparkSession
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    jvm, (fs, root) = spark._jvm, _fs(spark, path)
    before = _pointer(spark, path)
    fresh = jvm.org.apache.hadoop.fs.Path(root, f".{name}.pointer")
    out = fs.create(fresh, True)
    out.write(bytearray("\n".join([name, *before[:1]]).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, jvm.org.apache.hadoop.fs.Path(root, CURRENT), options)
    for old in before[1:]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(root, old), True)


def _pointer(spark: SparkSession, path: str) -> list[str]:
    """The version that counts and the one before it; none if no table was ever written."""
    fs, root = _fs(spark, path)
    file = spark._jvm.org.apache.hadoop.fs.Path(root, CURRENT)
    if not fs.exists(file):
        return []
    return [r.value for r in spark.read.text(f"{path}/{CURRENT}").collect() if r.value]


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Empty if none was ever written; a pointer to a version that isn't there is an error, not an empty table."""
    names = _pointer(spark, path)
    return spark.read.schema(MANIFEST).parquet(f"{path}/{names[0]}") if names else spark.createDataFrame([], MANIFEST)


def create_collection(spark: SparkSession, name: str, dim: int, metric: str = "COSINE") -> None:
    """A table of points; nothing happens if it is there."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (id DECIMAL(20,0), embedding ARRAY<FLOAT>, payload MAP<STRING,STRING>) USING parquet TBLPROPERTIES ('dim' = '{int(dim)}', 'metric' = '{metric}')")


def collection_info(spark: SparkSession, name: str) -> dict:
    props = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    return {"points_count": spark.table(name).count(), "dim": int(props["dim"]), "metric": props["metric"]}


def drop_collection(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def reset(spark: SparkSession, collection: str, *paths: str) -> None:
    """The collection and the folders of index, cache and logs."""
    drop_collection(spark, collection)
    for path in paths:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
