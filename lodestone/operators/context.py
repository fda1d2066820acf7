"""What is done with ranked chunks: selection by budget, context, sources, grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from ..functions import vocab as v

#: Tokens for chunks, by provider: the window less prompt and answer.
BUDGETS = {"large": 32768 - 500 - 2048, "local": 7168 - 500 - 1024}


def chunk_limit(intent: Column) -> Column:
    """G2."""
    out = F.lit(v.MOST_CHUNKS)
    for k, n in v.CHUNKS_BY_INTENT.items():
        out = F.when(F.lower(intent) == k, n).otherwise(out)
    return out


def select_chunks(hits: DataFrame, budget: int = BUDGETS["local"], query: str = "query_id", text: str = "text") -> DataFrame:
    """G1: chunks in rank order (rank from 1) up to the first that breaks a bound: the intent's number of chunks, the
    budget of tokens, or, after the first six, a score under 0.3. Adds tokens and used, the running sum."""
    w = Window.partitionBy(query).orderBy("rank")
    out = hits.withColumn("tokens", t.token_estimate(text)).withColumn("used", F.sum("tokens").over(w))
    bad = (F.col("rank") > chunk_limit(F.col("intent"))) | (F.col("used") > budget) | ((F.col("rank") > 6) & (F.col("score") < 0.3))
    return out.withColumn("__bad", F.max(bad.cast("int")).over(w)).filter("__bad = 0").drop("__bad")


def build_context(hits: DataFrame, query: str = "query_id", doc: str = "document_name", section: str = "section_title", text: str = "text") -> DataFrame:
    """(query, context), chunks in rank order under their sources."""
    title = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(" — "), section)).otherwise("")
    block = F.concat(F.lit("Source: "), F.coalesce(doc, F.lit("Unknown Document")), title, F.lit("\n"), F.coalesce(text, F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("rank", block.alias("b"))))
    return hits.groupBy(query).agg(F.array_join(F.transform(parts, lambda x: x["b"]), "\n\n---\n\n").alias("context"))


def sources(hits: DataFrame, query: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """The first chunk of each document, in rank order; documents without an id are no sources."""
    w = Window.partitionBy(query, doc_id).orderBy("rank")
    first = hits.filter(F.coalesce(F.col(doc_id).cast("string"), F.lit("")) != "").withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return first.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy("rank")))


def footer(hits: DataFrame, query: str = "query_id", doc: str = "document_name") -> DataFrame:
    """The names of the documents, cleaned and sorted."""
    name = F.regexp_replace(F.regexp_replace(doc, r"\.pdf|\.json", ""), "_", " ")
    names = F.array_sort(F.collect_set(F.when(F.coalesce(doc, F.lit("")) != "", name)))
    return hits.groupBy(query).agg(names.alias("n")).select(query, F.when(F.size("n") > 0, F.concat(F.lit("Based on: "), F.array_join("n", ", "))).alias("footer"))


#: What every prompt asks for, and what each kind of question asks for besides; {name} stands for a slot.
SCHEMA = (
    'Reply with one JSON object and nothing else: {"intent": text, "title": text, "subtitle": text, "sections": [{"heading": text, "type": one of '
    'paragraph, bullets, steps, table, alert, "content": text, "items": [text], "headers": [text], "rows": [[text]], "severity": one of info, warning, '
    'important}], "footer": text, "confidence": one of high, medium, low, "fallback": text or null}.'
)
RULES = [
    "Use only what the context says; where it says nothing about the question, set fallback to a sentence that says so and leave sections empty.",
    "Keep names, numbers, codes of forms, dates and amounts exactly as they are written.",
    "Name the documents that you used in the footer.", "Set confidence to low where the context answers a part of the question only.",
]
TEMPLATES = {
    "general": ["Answer in short paragraphs, one idea each.", "Put three or more facts of a kind into bullets."],
    "procedure": ["Give the steps in the order in which they are taken, as a section of type steps.", "Say who acts, what form or document is needed, where it goes and by when.", "Put deadlines and approvals that are easily missed into an alert."],
    "eligibility": ["Say first who is eligible.", "List the conditions as bullets, with the years, grades or limits that are named.", "Give exceptions and what is excluded a section of their own, as an alert."],
    "definition": ["Define the term in one paragraph, in the document's words.", "Add where it applies and what it is told apart from, if the context says so."],
    "form_details": ["Name the form with its code and purpose.", "List its sections and the fields of each as bullets.", "Say who signs it and what is attached."],
    "person_lookup": ["Give the person's name, title and department first.", "Then qualifications, experience, research interests, publications and awards, a section each, those that are there.", "Never mix what belongs to different people."],
    "topic_search": ["Give a section for each person or document that deals with the topic, the closest first.", "Say in one line what links each to the topic."],
    "document_overview": ["Say what the document is for and whom it applies to.", "Then list its main sections, with a line on each."],
}
#: Kinds of questions that share a template.
SAME = {"lookup": "person_lookup", "policy_lookup": "eligibility", "form_lookup": "form_details"}


def instructions(kind: str) -> str:
    """All of a prompt that stands before its context."""
    own = TEMPLATES[SAME.get(kind, kind)]
    return "\n".join(["You answer questions about an institution's documents.", *(f"- {x}" for x in [*own, *RULES]), SCHEMA])


def prompt(intent: Column, context: Column, query: Column) -> Column:
    """The template of the intent, in upper or lower case, the general one for others."""
    low, text = F.lower(intent), F.lit(instructions("general"))
    for kind in [*TEMPLATES, *SAME]:
        text = F.when(low == kind, instructions(kind)).otherwise(text)
    return F.concat(text, F.lit("\n\nContext:\n"), context, F.lit("\n\nQuestion: "), query, F.lit("\nAnswer in JSON."))


def answer_sentences(sections: Column) -> Column:
    """Sentences of paragraphs and items of lists, of four words at least."""
    cut = lambda s: F.split(F.regexp_replace(F.trim(s), r"(?<=[.!?])" + v.GAP + "(?=[A-Z0-9])", "\0"), "\0")
    none = F.array().cast("array<string>")
    flat = F.flatten(F.transform(sections, lambda s: F.concat(F.when(F.trim(F.coalesce(s["content"], F.lit(""))) != "", cut(s["content"])).otherwise(none), F.coalesce(s["items"], none))))
    return F.filter(F.transform(flat, lambda x: F.trim(x)), lambda x: t.n_words(x) >= 4)


def grounding(sentences: DataFrame, chunks: DataFrame, query: str = "query_id", sentence: str = "sentence", text: str = "text", most_samples: int = 3) -> DataFrame:
    """For each query the share of its sentences that its chunks support.

    sentences: (query, pos, sentence); chunks: (query, rank, text). A sentence is supported if it has stop words alone,
    shares a shingle of three words with the chunks' words (taken as one run, across borders of chunks), or half of
    its distinct words. Shingles and words meet in joins on hashes; nothing is collected but a query's few samples."""
    s = sentences.select(query, "pos", F.col(sentence).alias("s"), t.ground_tokens(sentence).alias("w"))
    c = chunks.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", t.ground_tokens(text).alias("w")))).alias("x"))
    c = c.select(query, F.flatten(F.transform("x", lambda e: e["w"])).alias("w"))
    c_words = c.select(query, F.explode(F.array_distinct("w")).alias("u"))
    c_grams = c.select(query, F.explode(t.shingles(F.col("w"))).alias("g"))
    some = c.select(query, (F.size("w") > 0).alias("__some"))
    by_gram = s.select(query, "pos", F.explode(t.shingles(F.col("w"))).alias("g")).join(c_grams, [query, "g"], "left_semi").select(query, "pos").distinct().withColumn("by_gram", F.lit(True))
    own = s.select(query, "pos", F.explode(F.array_distinct("w")).alias("u"))
    shared = own.join(c_words, [query, "u"], "left_semi").groupBy(query, "pos").agg(F.count("*").alias("n"))
    j = s.join(by_gram, [query, "pos"], "left").join(shared, [query, "pos"], "left").join(some, query, "left")
    n = F.size(F.array_distinct("w"))
    there = F.coalesce("__some", F.lit(False))
    good = there & ((n == 0) | F.coalesce("by_gram", F.lit(False)) | (F.coalesce("n", F.lit(0)) >= n * 0.5))
    j = j.withColumn("good", good).withColumn("bad_rank", F.row_number().over(Window.partitionBy(query, "good").orderBy("pos")))
    sample = F.when(~F.col("good") & (F.col("bad_rank") <= most_samples), F.struct("pos", "s"))
    out = j.groupBy(query).agg(F.count("*").alias("total"), F.sum(F.col("good").cast("int")).alias("grounded"), F.array_sort(F.collect_list(sample)).alias("x"), F.max(there).alias("there"))
    ratio = F.round(F.col("grounded") / F.col("total"), 3)
    reason = F.when(~F.col("there"), "no_chunks").when(F.col("grounded") / F.col("total") >= 0.5, "ok").otherwise("low_overlap")
    return out.select(query, ratio.alias("ratio"), "grounded", "total", F.transform("x", lambda e: e["s"]).alias("ungrounded_samples"), reason.alias("reason"))


def low_confidence_reply(confidence: Column, answer: Column, suggestions: Column) -> Column:
    """An answer of low or no confidence gives way to suggestions."""
    return F.when(confidence.isin("low", "none"), F.concat(F.lit("No confident answer. "), F.array_join(suggestions, "; "))).otherwise(answer)
