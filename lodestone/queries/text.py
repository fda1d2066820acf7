"""Queries of the text functions and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as p
from ..functions import text as t
from ..functions import vocab as v
from .base import PROBES_SQL, ascii_, chain, contains_any, has, pick, probes, s, sql_ascii, sql_list, sql_pick, squeeze, table, tokens

QUERIES, ORACLES = {}, {}
#: What is in brackets goes.
_BRACKETED = (r"\([^)]*\)", "")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# -- cleaning and tokens over documents and pages


@query("token_estimate", f"SELECT doc_id, {tokens('text')} AS tokens, right(text, 600) AS tail FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", t.token_estimate("text").alias("tokens"), t.tail("text", 150).alias("tail"))


@query("html_strip", "SELECT page_id, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS text_md5, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS n FROM pages")
def html_strip(spark, d):
    x = t.strip_tags("html")
    return table(spark, d, "pages").select("page_id", F.md5(x).alias("text_md5"), F.length(x).cast("long").alias("n"))


TRIMMED = f"regexp_replace(regexp_replace(html, {s('^' + v.WS + '+|' + v.WS + '+$')}, '', 'g'), '[\\x{{00}}-\\x{{09}}\\x{{0b}}-\\x{{1f}}]', '', 'g')"


@query("normalise_space", f"SELECT page_id, md5({squeeze(TRIMMED)}) AS clean_md5 FROM pages")
def normalise_space(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(t.normalise("html")).alias("clean_md5"))


MARKS = [" — ", " … ₹5 ", " §4 ", " • a – b ", " \xa0‣ ", " ▪◦ ", ""]


@query("special_chars", f"WITH x AS (SELECT doc_id, {sql_pick('doc_id', MARKS)} || text AS c FROM documents) SELECT doc_id, md5({''.join('replace(' for _ in v.SPECIAL)}c{''.join(f', {s(a)}, {s(b)})' for a, b in v.SPECIAL)}) AS clean_md5 FROM x")
def special_chars(spark, d):
    x = F.concat(pick(F.col("doc_id"), MARKS), F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(t.special_chars(x)).alias("clean_md5"))


@query("table_rows", f"SELECT doc_id, (regexp_matches(text, {s(chr(92) + '|[^|]*' + chr(92) + '|')}) OR length(text) - length(replace(text, chr(9), '')) >= 2 OR len(regexp_extract_all(text, {s(v.WS + '{3,}')})) >= 2) AS is_row FROM documents")
def table_rows(spark, d):
    return table(spark, d, "documents").select("doc_id", t.is_table_row("text").alias("is_row"))


ROWS = ["", "Grade    Pay of everyone in it\nField  of some length and more\nplain\n", "Parameter x\n", "a\n\nDay one\nDay two\nno"]
GROUPED = f"""
WITH x AS (SELECT doc_id, string_split({sql_pick('doc_id', ROWS)} || text, chr(10)) AS l FROM documents),
y AS (SELECT doc_id, l, [(regexp_matches(trim(e), {s(t.ROW)}) AND length(trim(e)) > 20) OR regexp_matches(trim(e), {s(t.ROW_HEAD)}) for e in l] AS r FROM x)
SELECT doc_id, md5(array_to_string([(CASE WHEN i = 1 THEN '' WHEN r[i] AND r[i - 1] THEN chr(10) ELSE chr(10) || chr(10) END) || l[i] for i in range(1, len(l) + 1)], '')) AS grouped_md5 FROM y
"""


@query("group_table_rows", GROUPED)
def group_table_rows(spark, d):
    x = F.concat(pick(F.col("doc_id"), ROWS), F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(t.group_rows(x)).alias("grouped_md5"))


TERMS = [" sabbatical and posh", " travel to a conference", "", " HR leave form", " PhD, PF, NPS; appraisal of the faculty"]


@query("topic_tags", f"WITH x AS (SELECT doc_id, lower(text || {sql_pick('doc_id', TERMS)}) AS c FROM documents) SELECT doc_id, ([k for k in {sql_list(v.TOPICS)} if contains(c, k)])[1:15] AS tags FROM x")
def topic_tags(spark, d):
    return table(spark, d, "documents").select("doc_id", t.topic_tags(F.concat("text", pick(F.col("doc_id"), TERMS))).alias("tags"))


STEPPED = ["", "\n1. first", "\n step 2", "\n (3) x", "1. no"]


@query("has_steps", f"SELECT doc_id, {has(f'text || {sql_pick("doc_id", STEPPED)}', '|'.join(v.STEPS))} AS has_steps FROM documents")
def has_steps(spark, d):
    return table(spark, d, "documents").select("doc_id", t.has_steps(F.concat("text", pick(F.col("doc_id"), STEPPED))).alias("has_steps"))


NAMES = ["Dr. Asha Rao ", "Associate Professor Lim Wei ", "prof Mrs. Iyer (Shah) ", "Ma'am Madam Sir ", "dr.x mr ", "Ms Jane Q. Doe "]
BARE = squeeze(chain("lower(c)", [(rf"\b{x.replace('.', '[.]')}\b", "") for x in v.TITLES]))
NAMED_CTE = f"x AS (SELECT conv_id, turn, {sql_pick('conv_id + turn', NAMES)} || {sql_ascii('text')} AS c FROM conversations)"


@query("title_strip", f"WITH {NAMED_CTE}, y AS (SELECT *, {BARE} AS bare FROM x) SELECT conv_id, turn, bare, {squeeze(chain('bare', [(chr(92) + '([^)]*' + chr(92) + ')', '')]))} AS query FROM y")
def title_strip(spark, d):
    x = F.concat(pick(F.col("conv_id") + F.col("turn"), NAMES), ascii_(F.col("text")))
    return table(spark, d, "conversations").select("conv_id", "turn", t.strip_titles(x).alias("bare"), t.normalise_query(x).alias("query"))


PEOPLE = ["Dr. Asha Rao", "Li", "mr  Ravi Kumar (RK) Nair", "Prof. ", "Jane Mary Ann Doe"]
PARTS = f"""
WITH x AS (SELECT conv_id, turn, {squeeze(chain(f"regexp_replace(concat_ws(' ', {sql_pick('conv_id + turn', PEOPLE)}, {sql_ascii('text')}), {s(v.HONORIFIC)}, '', 'gi')", [_BRACKETED]))} AS c FROM conversations),
y AS (SELECT *, string_split(c, ' ') AS p FROM x)
SELECT conv_id, turn, CASE WHEN c = '' THEN [] ELSE [e for e in [CASE WHEN len(p) >= 2 THEN p[1] END, CASE WHEN len(p) >= 2 THEN p[-1] END, CASE WHEN len(p) > 2 THEN p[1] || ' ' || p[-1] END, c] if e IS NOT NULL] END AS parts FROM y
"""


@query("name_parts", PARTS)
def name_parts(spark, d):
    x = F.concat_ws(" ", pick(F.col("conv_id") + F.col("turn"), PEOPLE), ascii_(F.col("text")))
    return table(spark, d, "conversations").select("conv_id", "turn", t.name_parts(x).alias("parts"))


CARDS = ["Faculty: Dr. A Rao\nDepartment: Law \nEmail: a@b.c\nResearch Interests: optics, AND, x; laser physics\n\nmore ", "Faculty: B\nPublications: stock market of neural things\nAwards: none ", "Research Interests: not specified\nPublications:\nA brand study\nExperience: 3 ", ""]
_INT, _PUB, _JSON = v.INTERESTS, v.PUBLICATIONS, v.JSON_PUBLICATIONS
_FIELDS = ", ".join(f"CASE WHEN {has('pubs', '|'.join(w), '')} THEN {s(f)} END" for f, w in v.FIELD_WORDS)
CARD_SQL = f"""
WITH x AS (SELECT doc_id, {sql_pick('doc_id', CARDS)} || {sql_ascii('text')} AS c FROM documents),
y AS (SELECT *, [e for e in [lower(trim(z)) for z in regexp_split_to_array(regexp_extract(c, {s(_INT)}, 1, 'is'), '[,;•\n]')] if len(e) > 2 AND e NOT IN ('and', 'at', 'for', 'in', 'of', 'on', 'or', 'the', 'to', 'with')] AS tags,
  lower(CASE WHEN regexp_extract(c, {s(_PUB)}, 1, 'is') <> '' THEN regexp_extract(c, {s(_PUB)}, 1, 'is') ELSE regexp_extract(c, {s(_JSON)}, 1, 's') END) AS pubs FROM x)
SELECT doc_id, trim(regexp_extract(c, 'Faculty:\\s*([^\\n]+)', 1)) AS name, trim(regexp_extract(c, 'Department:\\s*([^\\n]+)', 1, 'i')) AS department, trim(regexp_extract(c, 'Email:\\s*([^\\n]+)', 1, 'i')) AS email,
  CASE WHEN len(tags) = 0 OR (len(tags) = 1 AND contains(tags[1], 'not specified')) THEN ([e for e in [{_FIELDS}] if e IS NOT NULL])[1:5] ELSE tags[1:10] END AS tags FROM y
"""


@query("profile_fields", CARD_SQL)
def profile_fields(spark, d):
    x = F.concat(pick(F.col("doc_id"), CARDS), ascii_(F.col("text")))
    return table(spark, d, "documents").select("doc_id", t.labelled(x, "Faculty", False).alias("name"), t.labelled(x, "Department").alias("department"), t.labelled(x, "Email").alias("email"), t.research_tags(x).alias("tags"))


FORMS = ["Use HR-LA-01 and form B-12. ", "See annexure 4, the prescribed form and FORM b-12 ", "", "fin-c-3: application form; Application XYZ-9 "]


@query("form_codes", f"WITH x AS (SELECT doc_id, {sql_pick('doc_id', FORMS)} || {sql_ascii('text')} AS c FROM documents) SELECT doc_id, upper(regexp_extract(c, {s(v.FORM_CODE)}, 0, 'i')) AS code, list_sort(list_distinct(list_concat(regexp_extract_all(c, {s(v.CODED_FORM)}, 0, 'i'), regexp_extract_all(c, {s(v.NAMED_FORM)}, 0, 'i')))) AS refs FROM x")
def form_codes(spark, d):
    x = F.concat(pick(F.col("doc_id"), FORMS), ascii_(F.col("text")))
    return table(spark, d, "documents").select("doc_id", t.form_code(x).alias("code"), t.form_references(x).alias("refs"))


@query("content_hash_ids", "SELECT doc_id, sha256(text) AS sha, md5(text) AS md5, ('0x' || substr(md5(concat_ws('|', source, doc_id, '0')), 1, 16))::UBIGINT::DECIMAL(20,0)::VARCHAR AS point_id, 'q:' || substr(sha256(text), 1, 16) AS cache_key FROM documents")
def content_hash_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md5"), t.point_id(F.concat_ws("|", "source", "doc_id", F.lit("0"))).cast("string").alias("point_id"), t.cache_key("q", "text").alias("cache_key"))


def bm25_sql(c: str) -> str:
    x = chain(f"lower({c})", [(r'[(){}\[\]|•·,;:!?"]', " "), (r"\s+-\s+", " "), (r"\.(\s|$)", " ")])
    return f"[w for w in string_split({squeeze(x)}, ' ') if length(w) > 1]"


@query("bm25_tokens", f"WITH x AS (SELECT doc_id, {bm25_sql('text')} AS w FROM documents) SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS tokens_md5 FROM x")
def bm25_tokens(spark, d):
    w = t.bm25_tokens("text")
    return table(spark, d, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.md5(F.array_join(w, " ")).alias("tokens_md5"))


def ground_sql(c: str) -> str:
    return f"[w for w in regexp_extract_all(lower({c}), {s(v.GROUND_WORD)}) if length(w) > 1 AND NOT list_contains({sql_list(v.GROUND_STOP)}, w)]"


def shingle_sql(w: str, n: int = 3) -> str:
    return f"list_distinct(CASE WHEN len({w}) < {n} THEN {w} ELSE [array_to_string({w}[i:i + {n - 1}], ' ') for i in range(1, len({w}) - {n - 2})] END)"


@query("ground_shingles", f"WITH x AS (SELECT doc_id, {ground_sql('text')} AS w FROM documents), y AS (SELECT doc_id, len(w) AS n, {shingle_sql('w')} AS g FROM x) SELECT doc_id, n, len(g) AS n_shingles, md5(array_to_string(list_sort(g), '|')) AS shingles_md5 FROM y")
def ground_shingles(spark, d):
    df = table(spark, d, "documents").withColumn("w", t.ground_tokens("text")).withColumn("g", t.shingles(F.col("w")))
    return df.select("doc_id", F.size("w").cast("long").alias("n"), F.size("g").cast("long").alias("n_shingles"), F.md5(F.array_join(F.array_sort("g"), "|")).alias("shingles_md5"))


@query("size_validity", f"SELECT doc_id, CASE WHEN text IS NULL OR {squeeze('text')} = '' THEN 'empty' WHEN length(text) < 20 THEN 'too_short' WHEN length(text) > 1960 THEN 'split' ELSE 'valid' END AS validity FROM documents")
def size_validity(spark, d):
    return table(spark, d, "documents").select("doc_id", p.size_validity("text").alias("validity"))


PAGES = ["EXU — Employee Resource Book 2024 CONFIDENTIAL ", "Page 3 of 9 ", "| HR Department Page | 4 ", "Last Updated: x\n", "x SECTION 2: A ", ""]


@query("page_headers")
def page_headers(spark, d):
    x = F.concat(pick(F.col("doc_id"), PAGES), F.col("text"))
    return table(spark, d, "documents").select("doc_id", t.strip_page_headers(x).alias("text"))


@query("clean_chunk")
def clean_chunk(spark, d):
    x = F.concat(pick(F.col("doc_id"), ["Parameter Details\nParameter Details\n", "<b>x</b>\n\n\n\n", "Page | 12\n", "Grade     Pay\n"]), F.col("text"))
    return table(spark, d, "documents").select("doc_id", t.clean_chunk(x).alias("text"))


# -- answers

#: What a model may say, with a row's text where @ stands.
REPLIES = [
    '```json\n{"title": "T", "confidence": "low", "sections": [{"type": "List", "points": ["a", "@"]}, {"type": "text", "body": "c"}]}\n```',
    'Sure! {"title": "U", "sections": [{"type": "note", "heading": "Caution", "content": "@"}, {"type": "grid", "content": [{"k": "1", "l": null}]}]} Bye',
    "no json here @", '{"title": "V", "sections": [{"type": "numbered", "items": "@"}], "footer": "f"}', '{"title": "@',
]
_UNQUOTED = '["\\\\\\x00-\\x1f]'


def replied():
    """Each reply has its row's whole text in a JSON string; quotes, backslashes and controls of the text are blanks."""
    return F.replace(pick(F.col("conv_id") + F.col("turn"), REPLIES), F.lit("@"), F.regexp_replace(F.coalesce("text", F.lit("")), _UNQUOTED, " "))


REPLIED_SQL = f"SELECT conv_id, turn, replace({sql_pick('conv_id + turn', REPLIES)}, '@', regexp_replace(coalesce(text, ''), {s(_UNQUOTED)}, ' ', 'g')) AS r FROM conversations"


@query("repair_json", f"WITH x AS (SELECT conv_id, turn, trim(r) AS c FROM ({REPLIED_SQL})), y AS (SELECT *, {chain('c', [(chr(94) + '```(?:json)?' + chr(10) + '?', ''), (chr(10) + '?```$', '')])} AS b FROM x) SELECT conv_id, turn, CASE WHEN regexp_matches(b, '\\{{.*\\}}', 's') THEN regexp_extract(b, '\\{{.*\\}}', 0, 's') ELSE b END AS json FROM y")
def repair_json(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", t.repair_json(replied()).alias("json"))


@query("parse_answer")
def parse_answer(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", t.parse_answer(replied(), F.lit("general")).alias("answer")).withColumn("flat", t.flatten_answer(F.col("answer")))


# -- classifiers over probes

PATHS = ["faculty_list.csv", "leave_policy.pdf", "compendium_forms.pdf", "agreement.pdf", "faculty_leave_policy.pdf", "notes.txt", "sop_process.md", "handbook_manual.docx", "FACULTY.JSON"]


def best_sql(scores: list[tuple[str, str]], none: str) -> str:
    top = f"greatest({', '.join(x for _, x in scores)})"
    return f"CASE WHEN {top} = 0 THEN {s(none)} " + " ".join(f"WHEN {x} = {top} THEN {s(n)}" for n, x in scores) + " END"


_TYPES = best_sql([(n, " + ".join(f"contains(lower(c), {s(k)})::INT" for k in w.split(","))) for n, w in v.SOURCE_TYPES], "general_document")


@query("source_type", f"WITH x AS (SELECT doc_id, 'raw/' || source || '/' || {sql_pick('doc_id', PATHS)} AS c FROM documents) SELECT doc_id, CASE WHEN contains(lower(c), 'facult') AND regexp_matches(c, '\\.(json|csv)$') THEN 'faculty_profile' ELSE {_TYPES} END AS source_type FROM x")
def source_type(spark, d):
    x = F.concat(F.lit("raw/"), "source", F.lit("/"), pick(F.col("doc_id"), PATHS))
    return table(spark, d, "documents").select("doc_id", p.source_type(x).alias("source_type"))


def intent_sql(q: str) -> str:
    n = lambda ps: "(" + " + ".join(f"{has(q, x)}::INT" for x in ps) + ")"
    top = best_sql([(k, n([v.rx(x) for x in ps])) for k, ps in v.INTENTS.items()], "general")
    return f"""CASE WHEN {has(q, chr(92) + 'b' + v.FORM_CODE + chr(92) + 'b')} OR {has(q, v.rx('form'))} THEN CASE WHEN {has(q, v.any_of(v.DOING))} THEN 'procedure' ELSE 'form_details' END
      WHEN {has(q, '|'.join(v.DEFINES))} THEN 'definition'
      WHEN {top} = 'lookup' THEN CASE WHEN {n(v.POLICY)} > {n(v.PERSON)} THEN 'policy_lookup' ELSE 'person_lookup' END ELSE {top} END"""


def domain_sql(q: str) -> str:
    return best_sql([(k, f"len(regexp_extract_all({q}, {s(x)}, 0, 'i'))") for k, x in v.DOMAINS.items()], "general")


def scope_sql(q: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(q, x)} THEN {s(f)}" for x, f in v.scope_patterns(v.Institution())) + " END"


@query("intent", f"WITH {PROBES_SQL} SELECT conv_id, turn, {intent_sql('lower(q)')} AS intent FROM probes")
def intent(spark, d):
    return probes(spark, d).select("conv_id", "turn", p.intent(F.lower("q")).alias("intent"))


@query("domain", f"WITH {PROBES_SQL} SELECT conv_id, turn, {domain_sql('lower(q)')} AS domain FROM probes")
def domain(spark, d):
    return probes(spark, d).select("conv_id", "turn", p.domain(F.lower("q")).alias("domain"))


@query("doc_scope", f"WITH {PROBES_SQL} SELECT conv_id, turn, {scope_sql('lower(q)')} AS document_name FROM probes")
def doc_scope(spark, d):
    return probes(spark, d).select("conv_id", "turn", p.document_scope(F.lower("q")).alias("document_name"))


@query("current_only", f"WITH {PROBES_SQL} SELECT conv_id, turn, {has('q', v.CURRENT)} AS current_only, CASE WHEN {has('q', v.CURRENT)} THEN 'is_current=true' ELSE '' END AS filters FROM probes")
def current_only(spark, d):
    df = probes(spark, d).withColumn("c", p.current_only("q"))
    pairs = F.array_join(F.transform(F.map_entries(p.filters(F.col("c"))), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return df.select("conv_id", "turn", F.col("c").alias("current_only"), pairs.alias("filters"))


CLEAN_SQL = f"""clean AS (SELECT conv_id, turn, q, CASE WHEN c <> '' THEN c ELSE {squeeze('q')} END AS c FROM (
  SELECT *, {squeeze(chain(squeeze('q'), [('^' + x.replace(' ', chr(92) + 's+') + chr(92) + 's+', '') for x in v.FILLERS], 'i'))} AS c FROM probes)),
rewritten AS (SELECT conv_id, turn, q, {chain(squeeze('c'), v.REWRITES, 'gi')} AS r FROM clean)"""


@query("rewrite_query", f"WITH {PROBES_SQL}, {CLEAN_SQL} SELECT conv_id, turn, r AS rewritten FROM rewritten")
def rewrite_query(spark, d):
    return probes(spark, d).select("conv_id", "turn", t.rewrite_query(t.clean_query("q")).alias("rewritten"))


def entity_sql(q: str) -> str:
    """Two steps of a WITH: all entities, then each once."""
    found = {n: f"[trim(m) for m in regexp_extract_all({q}, {s(x)}, 0, 'i')]" for n, x in v.ENTITIES.items()}
    bare = f"trim(regexp_replace(m, {s(v.HONORIFIC)}, '', 'gi'))"
    people = f"flatten([CASE WHEN {bare} <> '' THEN [{bare}, m] ELSE [] END for m in {found.pop('person')}])"
    out = people
    for x in found.values():
        out = f"list_concat({out}, {x})"
    return out


ENT_SQL = f"ent AS (SELECT conv_id, turn, q, r, [es[i] for i in range(1, len(es) + 1) if list_position([lower(e) for e in es], lower(es[i])) = i] AS ents FROM (SELECT *, {entity_sql('r')} AS es FROM rewritten))"


@query("entities", f"WITH {PROBES_SQL}, {CLEAN_SQL}, {ENT_SQL} SELECT conv_id, turn, ents AS entities FROM ent")
def entities(spark, d):
    return probes(spark, d).select("conv_id", "turn", p.entities(t.rewrite_query(t.clean_query("q"))).alias("entities"))


def sql_distinct(xs: str) -> str:
    return f"(SELECT list(x ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest({xs}) AS x, generate_subscripts({xs}, 1) AS i) GROUP BY x))"


def expand_sql() -> str:
    q = "b"
    lst = lambda ws: sql_list(ws.split())
    when = lambda c, x: f"CASE WHEN {c} THEN {x} ELSE []::VARCHAR[] END"
    cat = lambda xs: "flatten([" + ", ".join(xs) + "])"
    h = lambda ws: contains_any(q, ws)
    submit = "[fm, 'submit', 'approval']"
    form = f"CASE WHEN {h(['leave'])} THEN {cat([lst('leave application process procedure'), submit])} WHEN {h(['reimbursement', 'claim'])} THEN {cat([lst('reimbursement claim process procedure'), submit])} WHEN {h(['travel'])} THEN {cat([lst('travel process procedure'), submit])} WHEN {h(['grant', 'research'])} THEN {cat([lst('grant research process procedure'), submit])} ELSE {cat([lst('process procedure application'), submit, lst('steps')])} END"
    parts = [f"CASE WHEN fm <> '' AND {h(v.FILLING)} THEN {form} ELSE []::VARCHAR[] END"]
    parts += [when(f"kind = {s(k)}", lst(x)) for k, x in v.BY_INTENT.items()]
    parts += [when(f"vague AND {h(ws.split(','))}", lst(x)) for ws, x in v.BROAD]
    more = [when("vague AND len(sofar) < 5", lst(v.BROADEST))] + [when(f"contains({q}, {s(k)})", lst(x)) for k, x in v.SYNONYMS.items()]
    bare = squeeze(chain("lower(r)", [(rf"\b{x.replace('.', '[.]')}\b", "") for x in v.TITLES]))
    return f"""
WITH {PROBES_SQL}, {CLEAN_SQL}, k AS (SELECT conv_id, turn, {intent_sql('lower(q)')} AS kind, {bare} AS b FROM rewritten),
a AS (SELECT *, {h(v.VAGUE)} AS vague, regexp_extract(b, {s(v.FORM_NAME)}, 0, 'i') AS fm FROM k), c AS (SELECT *, {cat(parts)} AS sofar FROM a),
e AS (SELECT *, [x for x in {cat(['sofar', *more])} if NOT list_contains(string_split(b, ' '), lower(x))] AS ts FROM c),
f AS (SELECT *, [ts[i] for i in range(1, len(ts) + 1) if list_position(ts, ts[i]) = i] AS ds FROM e),
g AS (SELECT *, ds[1:CASE WHEN vague THEN 20 WHEN list_contains(ds, 'faculty') OR list_contains(ds, 'professor') THEN 10 ELSE 8 END] AS xs FROM f)
SELECT conv_id, turn, CASE WHEN len(xs) > 0 THEN b || ' ' || array_to_string(xs, ' ') ELSE b END AS expanded FROM g
"""


@query("expand_query", expand_sql())
def expand_query(spark, d):
    df = probes(spark, d).withColumn("r", t.rewrite_query(t.clean_query("q")))
    return df.select("conv_id", "turn", p.expand_query("r", p.intent(F.lower("q")), p.entities("r")).alias("expanded"))


@query("signal_terms", f"""WITH {PROBES_SQL}, {CLEAN_SQL}, {ENT_SQL},
a AS (SELECT conv_id, turn, ents[1:2] AS two, [w for w in string_split({squeeze('r')}, ' ') if (length(w) > 4 AND regexp_matches(w, '^\\p{{Lu}}')) OR length(w) > 6] AS ws FROM ent),
b AS (SELECT *, [w for w in ws if NOT list_contains([lower(e) for e in two], lower(w))] AS fs FROM a)
SELECT conv_id, turn, (list_concat(two, [fs[i] for i in range(1, len(fs) + 1) if list_position([lower(e) for e in fs], lower(fs[i])) = i]))[1:3] AS terms FROM b""")
def signal_terms(spark, d):
    df = probes(spark, d).withColumn("r", t.rewrite_query(t.clean_query("q")))
    return df.select("conv_id", "turn", p.signal_terms("r", p.entities("r")).alias("terms"))


@query("understand", f"""WITH {PROBES_SQL}, {CLEAN_SQL}, {ENT_SQL}, a AS (SELECT *, {scope_sql('lower(r)')} AS f FROM ent)
SELECT conv_id, turn, CASE WHEN f IS NOT NULL THEN 'document_overview' ELSE {intent_sql('lower(q)')} END AS intent, CASE WHEN f IS NOT NULL THEN 'policies' ELSE {domain_sql('lower(r)')} END AS domain,
CASE WHEN f IS NOT NULL THEN 0 ELSE len(ents) END AS n_entities, f IS NULL AND {has('r', v.CURRENT)} AS current_only, CASE WHEN f IS NOT NULL THEN 'document_name=' || f WHEN {has('r', v.CURRENT)} THEN 'is_current=true' ELSE '' END AS filters FROM a""")
def understand(spark, d):
    df = probes(spark, d).withColumn("u", p.understand("q"))
    pairs = F.array_join(F.transform(F.map_entries("u.metadata_filters"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return df.select("conv_id", "turn", "u.intent", "u.domain", F.size("u.entities").cast("long").alias("n_entities"), F.col("u.is_current_only").alias("current_only"), pairs.alias("filters"))


@query("request_validation", f"WITH {PROBES_SQL}, x AS (SELECT *, length({squeeze('q')}) AS n, turn * 9 AS k FROM probes) SELECT conv_id, turn, CASE WHEN n < 2 THEN 'query too short' WHEN n > 10000 THEN 'query too long' WHEN k NOT BETWEEN 1 AND 50 THEN 'top_k out of range' END AS problem FROM x")
def request_validation(spark, d):
    return probes(spark, d).select("conv_id", "turn", p.valid_request(F.col("q"), F.col("turn") * 9).alias("problem"))


@query("suggestions", f"WITH {PROBES_SQL} SELECT conv_id, turn, (CASE i WHEN 'procedure' THEN {sql_list(v.SUGGESTIONS['procedure'])} WHEN 'eligibility' THEN {sql_list(v.SUGGESTIONS['eligibility'])} ELSE {sql_list(v.SUGGESTIONS['general'])} END) AS suggestions FROM (SELECT *, {intent_sql('lower(q)')} AS i FROM probes)")
def suggestions(spark, d):
    return probes(spark, d).select("conv_id", "turn", p.suggestions(p.intent(F.lower("q"))).alias("suggestions"))


@query("vector_sanity", "SELECT vec_id, embedding IS NULL OR len(embedding) = 0 OR len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) > 0 AS bad, len(embedding) AS dim FROM embeddings")
def vector_sanity(spark, d):
    return table(spark, d, "embeddings").select("vec_id", p.bad_vector("embedding").alias("bad"), F.size("embedding").cast("long").alias("dim"))
