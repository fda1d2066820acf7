"""Queries of chunks, conversations, aggregates, changing tables and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..durable import written
from ..functions import chunking as c
from ..functions import classify as p
from ..functions import text as t
from ..functions import vocab as v
from ..operators import scans, sessions, stats, tables
from .base import PROBES_SQL, pick, probes, s, sql_list, sql_pick, squeeze, table, tokens
from .base import has

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# -- chunks

FILES = ["leave_policy.pdf", "agreement.pdf", "notes.txt", "compendium_forms.pdf", "faculty_list.csv", "sop.md", "handbook.pdf"]
BEFORE = [
    "SECTION 1: LEAVE\n\n4.1 Types of leave for all\n", "Intro of ten words that stands before the first header of it.\n4. WORKING OBLIGATIONS\n", "",
    "EXU — Example University\nLEAVE APPLICATION FORM\nForm Code:\nHR-LA-01\nSECTION A: Applicant details with name\nSECTION B: Dates and days of it\n",
    "Faculty: Dr. A Rao\nResearch Interests: optics\n\n", "CHAPTER 2: Steps\n\n1. one\n2. two\n", "Grade     Pay of everyone\nField one\n\n",
]


def filed(spark, d):
    n = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("raw/"), "source", F.lit("/"), pick(n, FILES)).alias("path"), F.concat(pick(n, BEFORE), "text").alias("text"))


@query("chunk_documents")
def chunk_documents(spark, d):
    return c.chunk_documents(filed(spark, d)).withColumn("label", c.chunk_label("document_name", "section_index", "sub_index"))


@query("chunk_split")
def chunk_split(spark, d):
    return c.split_for_reader(table(spark, d, "documents").select("doc_id", "text", F.col("source").alias("section_title")))


@query("join_lines")
def join_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", c.joined_lines("text").alias("text"))


SMALL = ["Employee Signature: ", "", "Maximum of ten: ", "Overview: if ", ""]
_REASON = f"""CASE WHEN {' OR '.join(f'contains(lower(c), {s(x)})' for x in v.SIGNED)} THEN 'boilerplate_signature_page' WHEN title IN ({', '.join(map(s, v.CITIES))}) THEN 'artifact_section_title'
WHEN n < 25 AND NOT ({has('c', v.FACTS)} AND n >= 15) THEN 'too_short' WHEN n >= 25 AND NOT regexp_matches(c, '\\p{{L}}') THEN 'no_alphabetic_content' END"""
CHUNKS_SQL = f"x AS (SELECT doc_id, source, {sql_pick('doc_id', SMALL)} || text AS c, CASE WHEN doc_id % 11 = 0 THEN 'mumbai' ELSE 'Mission' END AS title FROM documents), y AS (SELECT *, {tokens('c')} AS n FROM x), z AS (SELECT *, {_REASON} AS why FROM y)"


def graded(spark, d):
    df = table(spark, d, "documents").select("doc_id", "source", F.concat(pick(F.col("doc_id"), SMALL), "text").alias("text"), F.when(F.col("doc_id") % 11 == 0, "Mumbai").otherwise("Mission").alias("title"))
    df = df.withColumn("token_count", t.token_estimate("text"))
    return df.withColumn("reason", p.skip_reason("text", F.col("token_count"), F.col("title"), F.lit("general_document")))


@query("quality_filter", f"WITH {CHUNKS_SQL} SELECT doc_id, n AS token_count, coalesce(why, CASE WHEN n >= 25 AND row_number() OVER (PARTITION BY md5(c), why IS NULL AND n >= 25 ORDER BY doc_id) > 1 THEN 'duplicate' END, 'kept') AS status FROM z")
def quality_filter(spark, d):
    """Texts are read and judged once; duplicates are found by what is left of them, a hash."""
    df = written(graded(spark, d).select("doc_id", "token_count", "reason", F.md5("text").alias("key")), "graded")
    shared = df.filter("reason IS NULL AND token_count >= 25").groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = (F.col("reason").isNull()) & (F.col("token_count") >= 25) & (F.col("doc_id") > F.col("first"))
    return df.join(shared, "key", "left").select("doc_id", "token_count", F.coalesce("reason", F.when(again, "duplicate"), F.lit("kept")).alias("status"))


@query("chunk_level", f"WITH {CHUNKS_SQL} SELECT doc_id, CASE WHEN n < 200 AND ({' OR '.join(f'contains(lower(c), {s(x)})' for x in v.ATOMIC)}) THEN 'atomic' WHEN doc_id % 2 = 0 AND n < 400 AND ({' OR '.join(f'contains(lower(c), {s(x)})' for x in v.OVERVIEW)}) THEN 'overview' ELSE 'section' END AS level FROM z")
def chunk_level(spark, d):
    return graded(spark, d).select("doc_id", p.chunk_level("text", F.col("token_count"), F.col("doc_id") % 2 == 0, F.lit("general_document")).alias("level"))


@query("exact_dedup", f"WITH x AS (SELECT doc_id, source, text, {tokens('text')} AS n FROM documents) SELECT doc_id, source, n AS token_count FROM x QUALIFY n < 25 OR row_number() OVER (PARTITION BY md5(text), n < 25 ORDER BY doc_id) = 1")
def exact_dedup(spark, d):
    df = table(spark, d, "documents").select("doc_id", "source", "text").withColumn("token_count", t.token_estimate("text"))
    return c.without_duplicates(df, ["doc_id"]).select("doc_id", "source", "token_count")


@query("chunk_ids", "SELECT doc_id, md5(concat_ws('|', source, doc_id % 5, '', '', lang, '')) AS chunk_id FROM documents")
def chunk_ids(spark, d):
    df = table(spark, d, "documents").select("doc_id", F.col("source").alias("document_name"), (F.col("doc_id") % 5).alias("section_index"), F.lit(None).alias("sub_index"), F.lit(None).alias("section_letter"), F.col("lang").alias("chunk_type"), F.lit(None).alias("split_index"))
    return df.select("doc_id", c.chunk_key().alias("chunk_id"))


@query("chunk_stats", f"WITH x AS (SELECT source, {tokens('text')} AS n FROM documents) SELECT source AS document_name, count(*) AS chunks, round(avg(n) FILTER (n > 0), 1) AS avg_tokens, min(n) FILTER (n > 0) AS min_tokens, max(n) FILTER (n > 0) AS max_tokens, count(*) FILTER (n = 0) AS empty_chunks FROM x GROUP BY source")
def chunk_stats(spark, d):
    df = table(spark, d, "documents").select(F.col("source").alias("document_name"), t.token_estimate("text").alias("token_count"))
    return stats.chunk_stats(df)


@query("counts_rollup", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def counts_rollup(spark, d):
    return stats.counts(table(spark, d, "documents"), "lang", "source")


@query("dry_run", "WITH x AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) SELECT lang, (SELECT count(*) FROM documents e WHERE e.lang = x.lang) AS n, list(doc_id::VARCHAR ORDER BY r) AS titles FROM x WHERE r <= 8 GROUP BY lang")
def dry_run(spark, d):
    df = table(spark, d, "documents").select("lang", "doc_id", F.col("doc_id").cast("string").alias("title"))
    return stats.dry_run(df, "lang", "doc_id", "title")


@query("expectation_gates", "WITH o AS (SELECT source, count(*) AS n FROM documents GROUP BY source), e AS (SELECT 'src' || i AS document_name, (i * 3)::INTEGER AS lo, (i * 3 + 50)::INTEGER AS hi FROM range(25) t(i)) SELECT document_name, lo, hi, coalesce(n, 0) AS chunks, CASE WHEN coalesce(n, 0) = 0 THEN 'empty' WHEN n < lo THEN 'too_few' WHEN n > hi THEN 'too_many' ELSE 'ok' END AS status FROM e LEFT JOIN o ON o.source = e.document_name")
def expectation_gates(spark, d):
    o = table(spark, d, "documents").groupBy(F.col("source").alias("document_name")).agg(F.count("*").alias("chunks"))
    i = F.col("id")
    e = spark.range(25).select(F.concat(F.lit("src"), i).alias("document_name"), (i * 3).cast("int").alias("lo"), (i * 3 + 50).cast("int").alias("hi"))
    return stats.expectation_gates(o, e)


# -- conversations


def said(spark, d):
    return probes(spark, d).select(F.col("conv_id").alias("session_id"), "turn", F.col("q").alias("content"))


def talks(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))


@query("history_tail", "SELECT conv_id AS session_id, turn, role, text AS content FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def history_tail(spark, d):
    return sessions.history(talks(spark, d), 3)


@query("session_context", "WITH x AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5) SELECT conv_id AS session_id, string_agg(upper(role[1]) || role[2:] || ': ' || text, chr(10) ORDER BY turn) AS context FROM x GROUP BY conv_id")
def session_context(spark, d):
    return sessions.context(talks(spark, d))


@query("session_summary", "SELECT conv_id AS session_id, count(*) AS message_count, min(turn) AS created, max(turn) AS updated FROM conversations GROUP BY conv_id")
def session_summary(spark, d):
    return sessions.summary(talks(spark, d), at="turn")


@query("session_clear", "SELECT conv_id AS session_id, turn, role, text AS content FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def session_clear(spark, d):
    df = talks(spark, d)
    return sessions.clear(df, df.filter("role = 'system'").select("session_id").distinct())


_N = f"(CASE WHEN {squeeze('q')} = '' THEN 0 ELSE length({squeeze('q')}) - length(replace({squeeze('q')}, ' ', '')) + 1 END)"
FOLLOW_SQL = f"(trim(q) <> '' AND ({' OR '.join(f'starts_with(ltrim(lower(q)), {s(o)})' for o in v.OPENERS)} OR ({_N} <= 6 AND {has('q', v.PRONOUNS)}) OR ({_N} <= 3 AND NOT {has('q', chr(92) + 'b[A-Z]{2,}', '')})))"
#: Short questions as well, or hardly any would be a follow-up.
SHORT_SQL = f"{PROBES_SQL}, said AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN {sql_pick('conv_id * 31 + turn', ['What about it?', 'and how', 'Section B?', 'is it allowed', 'they need this form', 'Why', 'it works', 'That one', 'explain HR'])} ELSE q END AS q FROM probes)"
SHORT = ["What about it?", "and how", "Section B?", "is it allowed", "they need this form", "Why", "it works", "That one", "explain HR"]


def short(spark, d):
    df = said(spark, d)
    return df.withColumn("content", F.when(F.col("turn") % 2 == 1, pick(F.col("session_id") * 31 + F.col("turn"), SHORT)).otherwise(F.col("content")))


@query("followup", f"WITH {SHORT_SQL} SELECT conv_id AS session_id, turn, {FOLLOW_SQL} AS is_followup FROM said")
def followup(spark, d):
    return short(spark, d).select("session_id", "turn", p.is_followup("content").alias("is_followup"))


def anchor_sql(q: str = "q") -> str:
    lists = [f"[{{'rank': {r}, 'anchor': trim(m)}} for m in regexp_extract_all({q}, {s(x)}, 1) if trim(m) <> '' AND NOT list_contains({sql_list(v.NO_NOUN)}, trim(m))]" for r, _, x in v.ANCHORS]
    return "flatten([" + ", ".join(lists) + "])"


ANCHOR_SQL = f"""WITH {SHORT_SQL}, a AS (SELECT conv_id, turn, q, {anchor_sql()} AS xs, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM said),
b AS (SELECT a.conv_id, a.turn, a.q, o.xs[1].anchor AS anchor FROM a LEFT JOIN a o ON o.conv_id = a.conv_id AND o.rn < a.rn AND o.rn >= a.rn - 20 AND len(o.xs) > 0
QUALIFY row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY o.xs[1].rank, o.turn DESC) = 1)"""


@query("anchors", ANCHOR_SQL + " SELECT conv_id AS session_id, turn, anchor FROM b")
def anchors(spark, d):
    return sessions.best_anchor(short(spark, d)).select("session_id", "turn", "anchor")


@query("rewrite", ANCHOR_SQL + f""", f AS (SELECT *, {FOLLOW_SQL} AS fu FROM b), w AS (SELECT *, CASE WHEN trim(q) = '' THEN 'empty_query' WHEN NOT fu THEN 'not_followup' WHEN anchor IS NULL THEN 'no_anchor_found' WHEN contains(lower(q), lower(anchor)) THEN 'anchor_already_present'
WHEN regexp_matches(trim(q), {s(v.LEADING)}) THEN 'pronoun_substitution' ELSE 'anchor_appended' END AS reason FROM f)
SELECT conv_id AS session_id, turn, fu AS is_followup, reason, CASE reason WHEN 'pronoun_substitution' THEN anchor || regexp_replace(trim(q), {s(v.LEADING)}, '') WHEN 'anchor_appended' THEN trim(q) || ' (regarding ' || anchor || ')' ELSE q END AS rewritten FROM w""")
def rewrite(spark, d):
    return sessions.rewrite(sessions.best_anchor(short(spark, d))).select("session_id", "turn", "is_followup", "reason", "rewritten")


# -- evaluation, logs and tables

EVAL_SQL = "e AS (SELECT d.doc_id, (d.lang = 'en') = (l.quality = 1) AS intent_ok, l.quality = 1 AS document_hit, contains(lower(text), 'the') OR contains(lower(text), 'der') AS any_hit, contains(lower(text), 'the') AND contains(lower(text), 'der') AS all_hit, CASE WHEN toxic = 0 THEN (d.doc_id % 100) / 100.0::DOUBLE END AS grounding, CASE WHEN d.doc_id % 50 = 0 THEN 'x' END AS error FROM documents d JOIN labels l USING (doc_id))"


def evaluated(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    any_hit, all_hit, _ = stats.keyword_hits(F.col("text"), F.array(F.lit("The"), F.lit("DER")))
    return j.select("doc_id", ((F.col("lang") == "en") == (F.col("quality") == 1)).alias("intent_ok"), (F.col("quality") == 1).alias("document_hit"), any_hit.alias("any_hit"), all_hit.alias("all_hit"), F.when(F.col("toxic") == 0, (F.col("doc_id") % 100) / 100.0).alias("grounding"), F.when(F.col("doc_id") % 50 == 0, "x").alias("error"))


_BOARD = "SELECT count(*) AS n, round(avg(intent_ok::INT), 3) AS intent_accuracy, round(avg(document_hit::INT), 3) AS recall_at_k, round(avg(any_hit::INT), 3) AS keyword_any_hit, round(avg(all_hit::INT), 3) AS keyword_all_hit, round(avg(grounding), 3) AS grounding_avg, count(error) AS n_errors FROM e"


@query("eval_scoreboard", f"WITH {EVAL_SQL} {_BOARD}")
def eval_scoreboard(spark, d):
    return stats.scoreboard(evaluated(spark, d))


@query("eval_gates", f"WITH {EVAL_SQL}, b AS ({_BOARD}) SELECT *, intent_accuracy >= 0.7 AS intent_accuracy_ok, recall_at_k >= 0.7 AS recall_at_k_ok, grounding_avg >= 0.5 AS grounding_avg_ok, keyword_any_hit >= 0.7 AS keyword_any_hit_ok, intent_accuracy >= 0.7 AND recall_at_k >= 0.7 AND grounding_avg >= 0.5 AND keyword_any_hit >= 0.7 AS passed FROM b")
def eval_gates(spark, d):
    return stats.gates(stats.scoreboard(evaluated(spark, d)))


_LINES = [("intent_accuracy", 0.7), ("recall_at_k", 0.7), ("keyword_any_hit", 0.7), ("keyword_all_hit", 0.7), ("grounding_avg", 0.5)]
_LINES_SQL = " || chr(10) || ".join(f"rpad('{n}', 24, ' ') || lpad(printf('%.3f', {n}), 10, ' ') || CASE WHEN {n} >= {x} THEN '  ok' ELSE '  FAIL' END" for n, x in _LINES)


@query("eval_report", f"WITH {EVAL_SQL}, b AS ({_BOARD}) SELECT {_LINES_SQL} AS report FROM b")
def eval_report(spark, d):
    lines = [stats.report_line(F.lit(n), F.col(n), F.col(n) >= x) for n, x in _LINES]
    return stats.scoreboard(evaluated(spark, d)).select(F.concat_ws("\n", *lines).alias("report"))


@query("keyword_hits", "SELECT doc_id, [k for k in ['The', 'DER', source] if NOT contains(lower(text), lower(k))] AS missing FROM documents")
def keyword_hits(spark, d):
    return table(spark, d, "documents").select("doc_id", p.missing_keywords(F.col("text"), F.array(F.lit("The"), F.lit("DER"), F.col("source"))).alias("missing"))


def _quantile(q: float) -> str:
    j = f"greatest(1, least(floor((n + 1) * {q}::DOUBLE), n - 1))::BIGINT"
    return f"xs[{j}] + ((n + 1) * {q}::DOUBLE - {j}) * (xs[{j} + 1] - xs[{j}])"


@query("usage_stats", f"WITH x AS (SELECT user_id, count(*) AS n, list(value ORDER BY value) AS xs FROM events WHERE value IS NOT NULL GROUP BY user_id), y AS (SELECT user_id, n, round(xs[1], 6) AS least, round(xs[-1], 6) AS most, round(list_avg(xs), 6) AS mean, round(list_median(xs), 6) AS median, round(CASE WHEN n > 10 THEN {_quantile(0.9)} ELSE xs[-1] END, 6) AS p90, round(CASE WHEN n > 100 THEN {_quantile(0.99)} ELSE xs[-1] END, 6) AS p99 FROM x) SELECT *, CASE WHEN p90 > 90 THEN 'raise' WHEN p90 < 50 THEN 'lower' ELSE 'keep' END AS advice FROM y")
def usage_stats(spark, d):
    out = stats.usage(table(spark, d, "events"), "user_id", "value", 50, 90)
    return out.select("user_id", "n", *(F.round(x, 6).alias(x) for x in ("least", "most", "mean", "median", "p90", "p99")), "advice")


@query("latency_stages", "SELECT event_id, user_id, epoch_us(ts) - coalesce(lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS stage_ms FROM events")
def latency_stages(spark, d):
    df = table(spark, d, "events").withColumn("us", F.unix_micros("ts")).withColumn("o", F.struct("ts", "event_id"))
    return stats.stage_times(df, "user_id", "o", "us").select("event_id", "user_id", "stage_ms")


@query("json_props", "SELECT event_id, json_keys(props)[1] AS first_key, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value FROM events")
def json_props(spark, d):
    m = F.from_json("props", "map<string,string>")
    k = F.get(F.json_object_keys("props"), F.lit(0))
    return table(spark, d, "events").select("event_id", k.alias("first_key"), F.try_element_at(m, k).alias("first_value"))


@query("meta_left_join", "WITH m AS (SELECT 'src' || i AS source, 'Title ' || i AS title, CASE WHEN i % 2 = 0 THEN 'staff' END AS applies_to FROM range(10) t(i)) SELECT doc_id, d.source, coalesce(title, d.source) AS title, coalesce(applies_to, 'all_faculty') AS applies_to FROM documents d LEFT JOIN m USING (source)")
def meta_left_join(spark, d):
    i = F.col("id")
    m = spark.range(10).select(F.concat(F.lit("src"), i).alias("source"), F.concat(F.lit("Title "), i).alias("title"), F.when(i % 2 == 0, "staff").alias("applies_to"))
    return tables.lookup(table(spark, d, "documents").select("doc_id", "source"), m, "source", {"title": F.col("source"), "applies_to": "all_faculty"})


@query("stale_anti_join", "SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT source FROM documents GROUP BY source HAVING max(n_chars) > 20000)")
def stale_anti_join(spark, d):
    df = table(spark, d, "documents")
    gone = df.groupBy("source").agg(F.max("n_chars").alias("n")).filter("n > 20000")
    return tables.delete(df.select("doc_id", "source"), gone, "source")


@query("incremental_diff", "WITH n AS (SELECT 'd' || doc_id AS document_name, md5(text) AS h FROM documents), o AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'g' ELSE 'd' END || doc_id AS document_name, md5(CASE WHEN doc_id % 3 = 1 THEN text ELSE text || 'x' END) AS h FROM documents) SELECT coalesce(n.document_name, o.document_name) AS document_name, coalesce(n.h, o.h) AS content_hash, CASE WHEN n.h IS NULL THEN 'gone' WHEN o.h IS NULL THEN 'new' WHEN n.h <> o.h THEN 'changed' ELSE 'unchanged' END AS status FROM n FULL JOIN o USING (document_name)")
def incremental_diff(spark, d):
    """Documents against a manifest of an earlier state, in which some had other names and some other texts."""
    docs, n = table(spark, d, "documents"), F.col("doc_id") % 3
    new = docs.select(F.concat(F.lit("d"), "doc_id").alias("document_name"), F.md5("text").alias("content_hash"))
    old = docs.select(F.concat(F.when(n == 0, "g").otherwise("d"), "doc_id").alias("document_name"), F.md5(F.when(n == 1, F.col("text")).otherwise(F.concat("text", F.lit("x")))).alias("content_hash"))
    return tables.changes(new, old)


@query("upsert", "WITH n AS (SELECT source AS id, max({'v': doc_id, 'n': n_chars}) AS x FROM documents WHERE lang = 'en' GROUP BY source), o AS (SELECT 'src' || i AS id, i AS v, 0 AS n FROM range(30) t(i)) SELECT id, x.v AS v, x.n AS n FROM n UNION ALL SELECT id, v, n FROM o WHERE id NOT IN (SELECT id FROM n)")
def upsert(spark, d):
    new = table(spark, d, "documents").filter("lang = 'en'").select(F.col("source").alias("id"), F.col("doc_id").alias("v"), F.col("n_chars").alias("n"))
    old = spark.range(30).select(F.concat(F.lit("src"), "id").alias("i"), F.col("id").alias("v"), F.lit(0).cast("long").alias("n")).withColumnRenamed("i", "id")
    return tables.upsert(old, new, ["id"], "v")


# -- state

LIMIT, SPAN, TTL = 3, 6 * 3600 * 1_000_000, 3600 * 1_000_000
RATE_SQL = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT user_id, event_id, rn, [t] AS w, true AS admitted, 0::BIGINT AS retry_after FROM e WHERE rn = 1
UNION ALL SELECT user_id, event_id, rn, CASE WHEN len(live) < {LIMIT} THEN list_append(live, t) ELSE live END, len(live) < {LIMIT}, CASE WHEN len(live) < {LIMIT} THEN 0 ELSE ((live[1] + {SPAN} - t) // 1000000) + 1 END
FROM (SELECT e.user_id, e.event_id, e.rn, e.t, [x for x in r.w if x >= e.t - {SPAN}] AS live FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
SELECT event_id, user_id, admitted, retry_after FROM r"""


def timed(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros("ts").alias("us"))


@query("rate_limit", RATE_SQL)
def rate_limit(spark, d):
    return scans.rate_limit(timed(spark, d), "user_id", "us", "event_id", LIMIT, SPAN).select("event_id", "user_id", "admitted", "retry_after")


TTL_SQL = f"""WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT user_id, event_type, event_id, rn, t AS since, false AS hit FROM e WHERE rn = 1
UNION ALL SELECT e.user_id, e.event_type, e.event_id, e.rn, CASE WHEN e.t - r.since < {TTL} THEN r.since ELSE e.t END, e.t - r.since < {TTL} FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.rn = r.rn + 1)"""


@query("ttl_cache", TTL_SQL + " SELECT event_id, hit FROM r")
def ttl_cache(spark, d):
    return scans.ttl_cache(timed(spark, d), ["user_id", "event_type"], "us", "event_id", TTL).select("event_id", "hit")


@query("cache_counters", TTL_SQL + " SELECT event_type, count(*) AS lookups, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit)::DOUBLE / count(*), 4) AS rate FROM r GROUP BY event_type")
def cache_counters(spark, d):
    return scans.cache_counters(scans.ttl_cache(timed(spark, d), ["user_id", "event_type"], "us", "event_id", TTL), "event_type")


@query("idle_keys", f"SELECT user_id, max(epoch_us(ts)) AS last FROM events GROUP BY user_id HAVING max(epoch_us(ts)) < (SELECT max(epoch_us(ts)) FROM events) - 2 * {SPAN}")
def idle_keys(spark, d):
    df = timed(spark, d)
    return scans.idle_keys(df, "user_id", "us", df.agg(F.max("us")).first()[0] or 0, SPAN)
