"""Whole pipelines as plans: documents to a store of chunks, questions to answers, and their evaluation.

A plan treats all documents or all questions at once; the driver never loops over them.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import models
from ..durable import written
from ..functions import chunking as c
from ..functions import classify as p
from ..functions import text as t
from ..functions import vocab as v
from ..operators import context as g
from ..operators import search as r
from ..operators import stats, tables


def prepare(docs: DataFrame, inst: v.Institution = v.Institution(), encoder: models.Encoder | None = None) -> DataFrame:
    """Documents (path, text, ...) to chunks with ids and vectors: cut, filtered, cleaned, cut again for readers.

    Quality is judged on the raw chunk, duplicates are found across all documents, as in ingestion one by one."""
    encoder = encoder or models.HashedEncoder()
    chunks = c.cut_documents(docs, inst=inst)
    chunks = chunks.filter(p.skip_reason("text", F.col("token_count"), F.col("section_title"), F.col("source_type")).isNull())
    # What is compared and what stays are both made of these, so documents are cut once.
    chunks = c.described(c.without_duplicates(written(chunks, "chunks"), ["path", "chunk_no"]))
    chunks = c.split_for_reader(chunks.withColumn("text", t.clean_chunk("text", inst))).filter("is_valid")
    return chunks.withColumn("chunk_id", c.chunk_key()).withColumn("embedding", encoder(F.col("text"))).filter(~p.bad_vector("embedding"))


def ingest(docs: DataFrame, manifest: DataFrame, store: DataFrame | None = None, force: bool = False, encoder: models.Encoder | None = None) -> dict[str, DataFrame]:
    """ST4: changed documents replace their chunks, unchanged ones are left alone. docs: (path, text, content_hash).

    Returns store, manifest and summary (A1)."""
    named = docs.withColumn("document_name", F.regexp_extract("path", r"([^/]*)$", 1))
    todo = tables.changes(named.select("document_name", "content_hash"), manifest, force=force)
    fresh = named.join(todo.filter("status IN ('new', 'changed')").select("document_name"), "document_name", "left_semi")
    chunks = prepare(fresh.drop("document_name"), encoder=encoder)
    kept = tables.delete(store, todo.filter("status = 'changed'"), "document_name") if store is not None else None
    out = chunks if kept is None else kept.unionByName(tables.newest(chunks.withColumn("__v", F.lit(1)), ["chunk_id"], "__v").drop("__v"), allowMissingColumns=True)
    rows = chunks.groupBy("document_name").agg(F.count("*").cast("int").alias("chunks_stored"), F.first("source_type").alias("source_type"))
    new = fresh.select("document_name", "content_hash").join(rows, "document_name", "left")
    new = new.select("document_name", "content_hash", F.coalesce("chunks_stored", F.lit(0)).alias("chunks_stored"), F.coalesce("chunks_stored", F.lit(0)).alias("chunks_created"), F.lit(None).cast("string").alias("ingested_at"), "source_type")
    return {"store": out, "manifest": tables.upsert(manifest, new, ["document_name"], "content_hash"), "summary": stats.counts(chunks, "source_type", "chunk_type")}


#: Intents whose questions name a person: these try names first, and have a leg of their own.
LOOKUPS = ("lookup", "person_lookup")
#: What a hit came from: a name in the chunks' variants, the first pass, the second, or nothing that can be trusted.
DIRECT, FIRST, SECOND, NOTHING = "direct", "first", "second", "no_confidence"


def _nearest(chunks: DataFrame, q: DataFrame, vector: str, k: int) -> DataFrame:
    """Dense hits of queries with their metadata_filters. There are as many different filters as scopes of documents,
    and two more; each is one search. A filter on a column that the chunks haven't is left out."""
    out = None
    q = q.filter(F.col(vector).isNotNull()).withColumn("__f", F.to_json("metadata_filters"))
    for (kind,) in q.select("__f").distinct().orderBy("__f").collect():
        where = None
        for name, want in json.loads(kind or "{}").items():
            if name in chunks.columns:
                fits = F.coalesce(F.lower(F.col(name).cast("string")) == want.lower(), F.lit(False))
                where = fits if where is None else where & fits
        found = r.dense(chunks, q.filter(F.col("__f").eqNullSafe(kind)), k, query_vector=vector, where=where)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else r.dense(chunks.limit(0), q, k, query_vector=vector)


def retrieve(
    queries: DataFrame, chunks: DataFrame, index: dict[str, DataFrame], encoder: models.Encoder | None = None, scorer=r.overlap_score, k: int = 15,
    filter_sparse: bool = False, second_below: float = 0.4, generator: models.Generator | None = None, name_boost: float = 0.3,
) -> DataFrame:
    """Queries (query_id, query) to ranked chunks (query_id, chunk_id, score, rank, intent, document_name, text, path).

    chunks: (chunk_id, text, document_name, embedding), and name_variants, is_current where they are known. In order:

    1. A lookup that names somebody finds the chunks of that name at once, and isn't searched for.
    2. Others are encoded without titles; with a generator, a question by topic as what might answer it (R14).
    3. Dense and BM25 legs of 40, and for lookups one of 40 for the name (R13), fused to 20. Filters of the question
       hold in both dense legs, and by words only with filter_sparse, which leaves out chunks without a vector too.
    4. Reranked by the question without titles, 3 at most of a document.
    5. R16: where the best score is under `second_below` and there are telling words, these alone are encoded, searched
       for and reranked by; the better of both results stays. If that is under the bound too, the question has one row
       without a chunk whose path is `no_confidence` (R18)."""
    encoder = encoder or models.HashedEncoder(normalise=False)
    asked = queries.withColumn("u", p.understand("query")).select("query_id", "query", "u.*")
    bare = t.strip_titles("query")
    asked = asked.withColumn("clean", F.when(bare != "", bare).otherwise(F.col("query"))).withColumn("name", F.when(F.col("intent").isin(*LOOKUPS), F.get("entities", F.lit(0))))

    def once(q: DataFrame, meant: str, words: str, judged: str, named: bool) -> DataFrame:
        legs = [F.col(meant)] if generator is None else [F.when(F.col("intent") == "topic_search", models.hypothetical(F.col(meant), generator)).otherwise(F.col(meant))]
        vecs = q.withColumn("qvec", encoder(legs[0]))
        if named:
            vecs = vecs.withColumn("nvec", encoder(F.when(F.col("name").isNotNull(), F.concat(F.lit("Faculty: "), t.strip_titles("name")))))
        vecs = written(vecs, "vectors")
        dense = _nearest(vectors, vecs, "qvec", 40)
        names = _nearest(vectors, vecs, "nvec", 40) if named else None
        allowed = vectors.filter(F.col("embedding").isNotNull()).select("chunk_id") if filter_sparse else None
        sparse = r.bm25(index, q.select("query_id", F.col(words).alias("query")), 40, allowed=allowed)
        if filter_sparse:
            sparse = _allowed(sparse, chunks, q)
        fused = r.fuse(dense, sparse, q.select("query_id", "intent"), 20, name_hits=names, name_boost=name_boost if named else 0.0)
        full = r.with_text(fused, chunks.select("chunk_id", "text", "document_name")).join(q.select("query_id", F.col(judged).alias("query"), "intent"), "query_id")
        return r.rerank(full, scorer, k)

    # What is asked and what is found is used several times, and is as small as the questions are few.
    asked = written(asked, "asked")
    # Each search reads all vectors, which may be made as chunks are read; so they are written once, with what is filtered by.
    names = [x.n for x in asked.select(F.explode(F.map_keys("metadata_filters")).alias("n")).distinct().orderBy("n").collect()]
    vectors = written(chunks.select("chunk_id", "embedding", *(n for n in names if n in chunks.columns and n not in ("chunk_id", "embedding"))), "embeddings")
    direct = None
    if "name_variants" in chunks.columns:
        direct = r.name_match(chunks, asked.filter("name IS NOT NULL"), 5)
        direct = r.with_text(direct, chunks.select("chunk_id", "text", "document_name")).join(asked.select("query_id", "query", "intent"), "query_id")
        direct = written(direct.withColumn("path", F.lit(DIRECT)), "direct")
        searched = written(asked.join(direct.select("query_id").distinct(), "query_id", "left_anti"), "searched")
    else:
        searched = asked
    first = written(once(searched, "clean", "expanded_query", "clean", True), "first")
    best = first.groupBy("query_id").agg(F.max("score").alias("top"))
    weak = searched.join(best.filter(F.col("top") < second_below), "query_id")
    weak = weak.withColumn("words", F.array_join(p.signal_terms("clean", F.col("entities")), " ")).filter("words <> ''")
    weak = written(weak, "weak")
    second = written(once(weak, "words", "words", "words", False), "second")
    again = second.groupBy("query_id").agg(F.max("score").alias("top2"))
    outcome = best.join(weak.select("query_id", F.lit(True).alias("tried")), "query_id", "left").join(again, "query_id", "left")
    better = F.coalesce(F.col("top2") > F.col("top"), F.lit(False))
    lost = F.coalesce(F.col("tried"), F.lit(False)) & (F.greatest("top", F.coalesce("top2", F.lit(0.0))) < second_below)
    outcome = outcome.select("query_id", F.when(lost, NOTHING).when(better, SECOND).otherwise(FIRST).alias("path"))
    out = first.withColumn("path", F.lit(FIRST)).unionByName(second.withColumn("path", F.lit(SECOND))).join(outcome, ["query_id", "path"], "left_semi")
    none = outcome.filter(F.col("path") == NOTHING).join(asked.select("query_id", "query", "intent"), "query_id")
    out = out.unionByName(none, allowMissingColumns=True)
    return (out if direct is None else out.unionByName(direct, allowMissingColumns=True)).join(asked.select("query_id", F.col("query").alias("__asked")), "query_id").withColumn("query", F.col("__asked")).drop("__asked")


def _allowed(hits: DataFrame, chunks: DataFrame, q: DataFrame) -> DataFrame:
    """Hits whose chunks pass the filters of their query."""
    own = hits.join(q.select("query_id", "metadata_filters"), "query_id")
    for name in ("is_current", "document_name"):
        if name in chunks.columns:
            own = own.join(chunks.select("chunk_id", F.lower(F.col(name).cast("string")).alias("__x")), "chunk_id")
            want = F.try_element_at("metadata_filters", F.lit(name))
            own = own.filter(want.isNull() | F.coalesce(F.col("__x") == F.lower(want), F.lit(False))).drop("__x")
    return own.drop("metadata_filters", "rank").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))


def answer(hits: DataFrame, queries: DataFrame, generator=models.first_sentence, provider: str = "local") -> DataFrame:
    """Answers to queries from their ranked chunks: budget, context, generation, grounding, confidence, sources."""
    hits = written(hits, "hits")
    used = written(g.select_chunks(hits.filter("chunk_id IS NOT NULL"), g.BUDGETS[provider]), "used")
    ctx = g.build_context(used.withColumn("section_title", F.lit(None).cast("string")))
    q = queries.select("query_id", "query").join(hits.groupBy("query_id").agg(F.first("intent").alias("intent"), F.max("score").alias("top")), "query_id", "left")
    j = q.join(ctx, "query_id", "left").join(g.footer(used), "query_id", "left").join(used.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left")
    j = j.withColumn("intent", F.coalesce("intent", F.lit("general"))).withColumn("answer", t.parse_answer(generator(g.prompt(F.col("intent"), F.coalesce("context", F.lit("")), F.col("query"))), F.col("intent")))
    j = written(j, "answers")
    said = j.select("query_id", F.posexplode(g.answer_sentences(F.col("answer.sections"))).alias("pos", "sentence"))
    j = j.join(g.grounding(said, used), "query_id", "left")
    conf = p.confidence(F.coalesce("n", F.lit(0)), F.coalesce("top", F.lit(0.0)), F.size("answer.sections") > 0, F.col("answer.fallback").isNotNull())
    j = j.withColumn("confidence", p.grounded_confidence(conf, F.coalesce("ratio", F.lit(0.0))))
    flat = t.flatten_answer(F.col("answer"))
    reply = g.low_confidence_reply(F.col("confidence"), flat, p.suggestions(F.col("intent")))
    return j.select("query_id", "query", "intent", "confidence", "ratio", F.coalesce("answer.footer", "footer").alias("footer"), reply.alias("reply"), flat.alias("words"))


def evaluate(golden: DataFrame, hits: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Rows for stats.scoreboard; golden as in sources.logs.EVAL, with `id` as query_id."""
    g_ = golden.withColumnRenamed("id", "query_id")
    names = hits.groupBy("query_id").agg(F.collect_set("document_name").alias("names"), F.first("intent").alias("intent"))
    j = g_.join(names, "query_id", "left")
    if answers is not None:
        j = j.join(answers.select("query_id", F.col("words"), F.col("ratio").alias("grounding")), "query_id", "left")
    else:
        j = j.withColumn("words", F.lit(None).cast("string")).withColumn("grounding", F.lit(None).cast("double"))
    none = F.array().cast("array<string>")
    any_hit, _, _ = stats.keyword_hits(F.coalesce("words", F.lit("")), F.coalesce("keywords_any", none))
    _, all_hit, _ = stats.keyword_hits(F.coalesce("words", F.lit("")), F.coalesce("keywords_all", none))
    intent = F.coalesce("intent", p.intent(F.lower("query")))
    hit = p.document_hit(F.coalesce("names", none), F.col("document_expected"))
    return j.select("query_id", (intent == F.col("intent_expected")).alias("intent_ok"), hit.alias("document_hit"), any_hit.alias("any_hit"), all_hit.alias("all_hit"), "grounding", F.lit(None).cast("string").alias("error"))
