"""Queries of search and of what follows it: the benchmark's items, whole, against all documents and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..durable import written
from ..functions import classify as p
from ..functions import text as t
from ..functions import vocab as v
from ..operators import context as g
from ..operators import search as r
from .base import pick, s, sql_list, sql_pick, table, tokens
from .text import bm25_sql, ground_sql, shingle_sql

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


INTENTS = ["general", "procedure", "eligibility", "person_lookup", "policy_lookup", "topic_search", "definition"]


def chunks(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("document_name"), "doc_id", F.col("lang").alias("section_title"))


def asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), pick(F.col("item_id"), INTENTS).alias("intent"))


def sparse(spark, d, k=40):
    return r.bm25(r.build_index(chunks(spark, d)), asked(spark, d), k)


INDEX_SQL = f"""
tok AS MATERIALIZED (SELECT doc_id, unnest({bm25_sql('text')}) AS tok FROM documents WHERE text IS NOT NULL AND trim(text) <> ''),
post AS MATERIALIZED (SELECT tok, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
len AS (SELECT d.doc_id, len({bm25_sql('text')}) AS dl FROM documents d WHERE text IS NOT NULL AND trim(text) <> ''),
st AS MATERIALIZED (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
raw AS MATERIALIZED (SELECT tok, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, st GROUP BY tok),
mean AS MATERIALIZED (SELECT avg(raw) AS mean_idf FROM raw),
lex AS MATERIALIZED (SELECT tok, df, CASE WHEN raw < 0 THEN mean_idf * 0.25 ELSE raw END AS idf FROM raw, mean)"""


def bm25_hits(q: str, k: int) -> str:
    """`q` is a table of (query_id, query)."""
    return f"""qt AS (SELECT query_id, tok, count(*) AS qtf FROM (SELECT query_id, unnest({bm25_sql('query')}) AS tok FROM {q}) GROUP BY ALL),
sc AS (SELECT query_id, doc_id AS chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN lex USING (tok) JOIN post USING (tok) JOIN len USING (doc_id), st GROUP BY ALL),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= {k})"""


ASKED_SQL = f"asked AS (SELECT item_id AS query_id, text AS query, {sql_pick('item_id', INTENTS)} AS intent FROM benchmark)"
HITS_SQL = f"WITH {ASKED_SQL}, {INDEX_SQL}, {bm25_hits('asked', 40)}"
FULL_SQL = HITS_SQL + ", fll AS (SELECT h.*, d.text, d.source AS document_name, d.doc_id, d.lang AS section_title, a.query, a.intent FROM hits h JOIN documents d ON d.doc_id = h.chunk_id JOIN asked a USING (query_id))"
ONE = "the of and die der que les"


@query("bm25_topk", f"WITH one AS (SELECT 1 AS query_id, {s(ONE)} AS query), {INDEX_SQL}, {bm25_hits('one', 40)} SELECT chunk_id, score, rank FROM hits")
def bm25_topk(spark, d):
    one = spark.range(1, 2).select(F.col("id").alias("query_id"), F.lit(ONE).alias("query"))
    return r.bm25(r.build_index(chunks(spark, d)), one, 40).select("chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query("bm25_multi_query", HITS_SQL + " SELECT query_id, chunk_id, score, rank FROM hits")
def bm25_multi_query(spark, d):
    return sparse(spark, d).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query("bm25_lexicon", f"WITH {INDEX_SQL} SELECT tok, df, round(idf, 9) AS idf FROM lex")
def bm25_lexicon(spark, d):
    return r.build_index(chunks(spark, d))["lexicon"].select("tok", "df", F.round("idf", 9).alias("idf"))


@query("bm25_stats", f"WITH {INDEX_SQL} SELECT n, round(avgdl, 6) AS avgdl, round(mean_idf, 9) AS mean_idf FROM st, mean")
def bm25_stats(spark, d):
    return r.build_index(chunks(spark, d))["stats"].select("n", F.round("avgdl", 6).alias("avgdl"), F.round("mean_idf", 9).alias("mean_idf"))


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def dense_hits(spark, d, k=40):
    q = vectors(spark, d).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("qvec")).join(asked(spark, d).select("query_id"), "query_id", "left_semi")
    return r.dense(vectors(spark, d), q, k)


def dense_sql(where_q: str, where_v: str = "true", k: int = 40, name: str = "dn") -> str:
    cos = "list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])))"
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, round({cos}, 6) AS score FROM embeddings q, embeddings e WHERE {where_q} AND {where_v}) QUALIFY rank <= {k})"


@query("dense_topk", f"WITH {dense_sql('q.vec_id % 100 = 0')} SELECT query_id, chunk_id, score, rank FROM dn")
def dense_topk(spark, d):
    q = vectors(spark, d).filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return r.dense(vectors(spark, d), q).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query("dense_filtered", f"WITH {dense_sql('q.vec_id % 100 = 0', 'e.label IN (1, 2, 3)', 10)} SELECT query_id, chunk_id, score, rank FROM dn WHERE score >= 0.1")
def dense_filtered(spark, d):
    q = vectors(spark, d).filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("qvec"))
    found = r.dense(vectors(spark, d), q, 10, threshold=0.1, where=p.payload_filter({"label": [1, 2, 3]}, any_of=True))
    return found.select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def norm_sql(src: str) -> str:
    return f"(SELECT query_id, chunk_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN score ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS score FROM {src} WINDOW w AS (PARTITION BY query_id))"


@query("minmax_norm", HITS_SQL + f" SELECT query_id, chunk_id, round(score, 6) AS score FROM {norm_sql('hits')}")
def minmax_norm(spark, d):
    return r.normalised(sparse(spark, d)).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


_WD = "CASE intent " + " ".join(f"WHEN {s(k)} THEN {a}" for k, (a, _) in v.WEIGHTS.items()) + " ELSE 0.7 END::DOUBLE"
_WS = "CASE intent " + " ".join(f"WHEN {s(k)} THEN {b}" for k, (_, b) in v.WEIGHTS.items()) + " ELSE 0.3 END::DOUBLE"
FUSED_SQL = f"""{HITS_SQL}, {dense_sql('q.vec_id IN (SELECT query_id FROM asked)')},
fu AS (SELECT query_id, chunk_id, round(sum(score * w) / any_value(m), 6) AS score FROM (
  SELECT query_id, chunk_id, score, {_WD} AS w, {_WD} + {_WS} AS m FROM {norm_sql('dn')} JOIN asked USING (query_id)
  UNION ALL SELECT query_id, chunk_id, score, {_WS}, {_WD} + {_WS} FROM {norm_sql('hits')} JOIN asked USING (query_id)) GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fu QUALIFY rank <= 20)"""


@query("hybrid_fuse", FUSED_SQL + " SELECT query_id, chunk_id, score FROM fused")
def hybrid_fuse(spark, d):
    out = r.fuse(dense_hits(spark, d), sparse(spark, d), asked(spark, d))
    return out.select("query_id", "chunk_id", "score")


@query("hybrid_names")
def hybrid_names(spark, d):
    """A third leg, here of vectors with the query's own label, boosts what it finds."""
    dn = written(dense_hits(spark, d), "dense")  # read twice
    return r.fuse(dn, sparse(spark, d), asked(spark, d), name_hits=dn.filter("rank <= 5"), name_boost=0.3)


@query("name_match", f"""WITH c AS (SELECT vec_id, [['asha', 'rao'], ['john', 'smith'], ['rao', 'li'], []][(vec_id % 4) + 1] AS nv FROM embeddings),
q AS (SELECT * FROM (VALUES (1, ['asha', 'rao']), (2, ['smith'])) t(query_id, ps))
SELECT query_id, vec_id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY vec_id) AS rank FROM q, c WHERE list_has_any(ps, nv) QUALIFY rank <= 5""")
def name_match(spark, d):
    names = [["asha", "rao"], ["john", "smith"], ["rao", "li"], []]
    lits = F.array(*(F.array(*(F.lit(x) for x in n)).cast("array<string>") for n in names))
    c = vectors(spark, d).withColumn("name_variants", F.element_at(lits, (F.col("chunk_id") % 4 + 1).cast("int")))
    q = spark.createDataFrame([(1, "Dr. Asha Rao"), (2, "Prof Smith")], "query_id int, name string")
    return r.name_match(c, q).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


def full(spark, d):
    return r.with_text(sparse(spark, d), chunks(spark, d)).join(asked(spark, d), "query_id")


CAP_SQL = """, few AS (SELECT * EXCLUDE (rank) FROM fll QUALIFY row_number() OVER (PARTITION BY query_id, coalesce(document_name, 'unknown') ORDER BY score DESC, chunk_id) <= 3),
capped AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM few QUALIFY rank <= 15)"""


@query("diversity_cap", FULL_SQL + CAP_SQL + " SELECT query_id, chunk_id, document_name, score, rank FROM capped")
def diversity_cap(spark, d):
    return r.diversity_cap(full(spark, d)).select("query_id", "chunk_id", "document_name", "score", F.col("rank").cast("long").alias("rank"))


_OWN = f"list_distinct({bm25_sql('query')})"


@query("rerank", FULL_SQL.replace("fll AS (SELECT h.*", "fll AS (SELECT h.* EXCLUDE (score)").replace("FROM hits h JOIN", f", CASE WHEN len({_OWN}) = 0 THEN 0 ELSE round(len(list_intersect({_OWN}, {bm25_sql('d.text')}))::DOUBLE / len({_OWN}), 6) END AS score FROM hits h JOIN") + CAP_SQL + " SELECT query_id, chunk_id, score, rank FROM capped")
def rerank(spark, d):
    return r.rerank(full(spark, d)).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


_LIMIT = "CASE lower(intent) " + " ".join(f"WHEN {s(k)} THEN {n}" for k, n in v.CHUNKS_BY_INTENT.items()) + " ELSE 20 END"
BUDGET_SQL = FULL_SQL + f""", tk AS (SELECT *, {tokens('text')} AS tokens FROM fll), us AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM tk),
bd AS (SELECT *, max((rank > {_LIMIT} OR used > 5644 OR (rank > 6 AND score < 0.3))::INT) OVER (PARTITION BY query_id ORDER BY rank) AS bad FROM us), chosen AS (SELECT * FROM bd WHERE bad = 0)"""


def chosen(spark, d):
    return g.select_chunks(full(spark, d))


@query("budget_select", BUDGET_SQL + " SELECT query_id, chunk_id, rank, tokens, used::BIGINT AS used FROM chosen")
def budget_select(spark, d):
    return chosen(spark, d).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "tokens", "used")


@query("build_context", BUDGET_SQL + " SELECT query_id, md5(string_agg('Source: ' || coalesce(document_name, 'Unknown Document') || CASE WHEN coalesce(section_title, '') <> '' THEN ' — ' || section_title ELSE '' END || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM chosen GROUP BY query_id")
def build_context(spark, d):
    return g.build_context(chosen(spark, d)).select("query_id", F.md5("context").alias("context_md5"))


@query("source_list", BUDGET_SQL + ", fs AS (SELECT * FROM chosen QUALIFY row_number() OVER (PARTITION BY query_id, document_name ORDER BY rank) = 1) SELECT query_id, document_name, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM fs")
def source_list(spark, d):
    return g.sources(chosen(spark, d), doc_id="document_name").select("query_id", "document_name", "chunk_id", F.col("place").cast("long").alias("place"))


@query("footer", BUDGET_SQL + " SELECT query_id, 'Based on: ' || array_to_string(list_sort(list(DISTINCT replace(document_name || '_x', '_', ' '))), ', ') AS footer FROM chosen GROUP BY query_id")
def footer(spark, d):
    return g.footer(chosen(spark, d).withColumn("document_name", F.concat("document_name", F.lit("_x.pdf"))))


CONTEXT_SQL = "string_agg('Source: ' || coalesce(document_name, 'Unknown Document') || CASE WHEN coalesce(section_title, '') <> '' THEN ' — ' || section_title ELSE '' END || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)"
_HEAD_SQL = "CASE any_value(lower(intent)) " + " ".join(f"WHEN {s(k)} THEN {s(g.instructions(k))}" for k in [*g.TEMPLATES, *g.SAME]) + f" ELSE {s(g.instructions('general'))} END"


@query("prompt", BUDGET_SQL + f" SELECT query_id, md5({_HEAD_SQL} || {s(chr(10) * 2 + 'Context:' + chr(10))} || {CONTEXT_SQL} || {s(chr(10) * 2 + 'Question: ')} || any_value(query) || {s(chr(10) + 'Answer in JSON.')}) AS prompt_md5 FROM chosen GROUP BY query_id")
def prompt(spark, d):
    c = g.build_context(chosen(spark, d)).join(asked(spark, d), "query_id")
    return c.select("query_id", F.md5(g.prompt(F.upper("intent"), F.col("context"), F.col("query"))).alias("prompt_md5"))


GROUND_SQL = f"""{HITS_SQL}, top AS (SELECT query_id, rank, d.text FROM hits h JOIN documents d ON d.doc_id = h.chunk_id WHERE rank <= 5),
w AS (SELECT query_id, flatten(list({ground_sql('text')} ORDER BY rank)) AS w FROM top GROUP BY query_id),
cw AS (SELECT DISTINCT query_id, unnest(w) AS u FROM w), cg AS (SELECT query_id, unnest({shingle_sql('w')}) AS g FROM w),
sn AS (SELECT (item_id + 1) // 2 * 2 % (SELECT count(*) FROM benchmark) AS query_id, item_id AS pos, text AS s, {ground_sql('text')} AS w FROM benchmark),
j AS (SELECT sn.*, len(list_distinct(w)) AS n, EXISTS (SELECT 1 FROM cg WHERE cg.query_id = sn.query_id AND list_contains({shingle_sql('sn.w')}, cg.g)) AS bg,
  (SELECT count(*) FROM cw WHERE cw.query_id = sn.query_id AND list_contains(sn.w, cw.u)) AS k, EXISTS (SELECT 1 FROM cw WHERE cw.query_id = sn.query_id) AS there FROM sn),
z AS (SELECT *, there AND (n = 0 OR bg OR k >= n * 0.5) AS good FROM j)
SELECT query_id, round(sum(good::INT)::DOUBLE / count(*), 3) AS ratio, sum(good::INT)::BIGINT AS grounded, count(*) AS total, coalesce((list(s ORDER BY pos) FILTER (NOT good))[1:3], []) AS ungrounded_samples,
  CASE WHEN NOT bool_or(there) THEN 'no_chunks' WHEN sum(good::INT)::DOUBLE / count(*) >= 0.5 THEN 'ok' ELSE 'low_overlap' END AS reason FROM z GROUP BY query_id"""


@query("grounding", GROUND_SQL)
def grounding(spark, d):
    n = table(spark, d, "benchmark").count()
    to = F.floor((F.col("item_id") + 1) / 2).cast("long") * 2 % n
    said = table(spark, d, "benchmark").select(to.alias("query_id"), F.col("item_id").alias("pos"), F.col("text").alias("sentence"))
    top = written(r.with_text(sparse(spark, d, 5), chunks(spark, d)).select("query_id", "rank", "text"), "top")  # read three times
    return g.grounding(said, top)


CONF_SQL = """, b AS (SELECT query_id, count(*) AS n, max(score) / 40 AS top FROM chosen GROUP BY query_id), c AS (SELECT *, query_id % 3 > 0 AS hs, query_id % 5 = 0 AS hf, (query_id * 37 % 100) / 100.0::DOUBLE AS ratio FROM b),
e AS (SELECT *, CASE WHEN n = 0 OR (NOT hs AND hf) THEN 'none' WHEN hs AND top >= 0.7 AND n >= 3 THEN 'high' WHEN hs AND top >= 0.4 AND n >= 2 THEN 'medium' WHEN hs AND top >= 0.3 THEN 'low' ELSE 'none' END AS confidence FROM c)
SELECT query_id, confidence, CASE WHEN ratio < 0.5 AND confidence IN ('high', 'medium') THEN 'low' WHEN ratio < 0.25 THEN 'none' ELSE confidence END AS grounded_confidence FROM e"""


@query("confidence", BUDGET_SQL + CONF_SQL)
def confidence(spark, d):
    b = chosen(spark, d).groupBy("query_id").agg(F.count("*").alias("n"), (F.max("score") / 40).alias("top"))
    b = b.withColumn("confidence", p.confidence(F.col("n"), F.col("top"), F.col("query_id") % 3 > 0, F.col("query_id") % 5 == 0))
    ratio = (F.col("query_id") * 37 % 100) / 100.0
    return b.select("query_id", "confidence", p.grounded_confidence(F.col("confidence"), ratio).alias("grounded_confidence"))


@query("document_hit", HITS_SQL + " SELECT a.query_id, coalesce(bool_or(contains(lower(d.source), 'src1')), false) AS hit FROM asked a LEFT JOIN hits h USING (query_id) LEFT JOIN documents d ON d.doc_id = h.chunk_id GROUP BY a.query_id")
def document_hit(spark, d):
    names = r.with_text(sparse(spark, d), chunks(spark, d)).groupBy("query_id").agg(F.collect_list("document_name").alias("names"))
    names = asked(spark, d).select("query_id").join(names, "query_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    return names.select("query_id", p.document_hit(F.col("names"), F.lit("SRC1")).alias("hit"))


@query("low_confidence", f"SELECT conv_id, turn, CASE WHEN turn % 3 < 2 THEN 'No confident answer. ' || {s('; '.join(v.SUGGESTIONS['general']))} ELSE text END AS reply FROM conversations")
def low_confidence(spark, d):
    c = F.element_at(F.array(F.lit("low"), F.lit("none"), F.lit("high")), (F.col("turn") % 3 + 1).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", g.low_confidence_reply(c, F.col("text"), p.suggestions(F.lit("general"))).alias("reply"))


@query("answer_sentences")
def answer_sentences(spark, d):
    one = F.array(F.struct(F.col("text").alias("content"), F.array(F.col("role"), F.lit("four words in here")).alias("items")))
    return table(spark, d, "conversations").select("conv_id", "turn", g.answer_sentences(one).alias("sentences"))
