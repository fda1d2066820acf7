"""Classifiers and predicates as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as t
from . import vocab as v


def hits(c: Column, patterns: list[str]) -> Column:
    """How many patterns occur."""
    return reduce(lambda a, b: a + b, (c.rlike("(?i)" + p).cast("int") for p in patterns))


def best(scores: list[tuple[str, Column]], none: str) -> Column:
    """The name of the largest score, the first among equals; `none` where all are 0."""
    names = F.array(*(F.lit(n) for n, _ in scores))
    first = lambda a: F.get(names, (F.array_position(a, F.array_max(a)) - 1).cast("int"))
    return t.let(F.array(*(s for _, s in scores)), lambda a: F.when(F.array_max(a) == 0, none).otherwise(first(a)))


def source_type(path: str | Column) -> Column:
    """A record file of people by its name, else the type with most of its keywords anywhere in the path."""
    p = F.lower(t.col(path))
    scores = [(n, reduce(lambda a, b: a + b, (F.contains(p, F.lit(k)).cast("int") for k in w.split(",")))) for n, w in v.SOURCE_TYPES]
    people = F.contains(p, F.lit("facult")) & t.col(path).rlike(r"\.(?:json|csv)$")
    return F.when(people, "faculty_profile").otherwise(best(scores, "general_document"))


def chunk_level(c: str | Column, tokens: Column, first: Column, source: Column) -> Column:
    """P2."""
    some = lambda ks: t.let(F.lower(t.col(c)), lambda low: reduce(lambda a, b: a | b, (F.contains(low, F.lit(k)) for k in ks)))
    return (
        F.when(source == "faculty_profile", "section")
        .when((tokens < 200) & some(v.ATOMIC), "atomic")
        .when(first & (tokens < 400) & some(v.OVERVIEW), "overview")
        .otherwise("section")
    )


def skip_reason(c: str | Column, tokens: Column, title: Column, source: Column) -> Column:
    """P3 without duplicates (see operators.dedup): why a chunk is left out, null if it isn't."""
    c = t.col(c)
    signed = t.let(F.lower(c), lambda low: reduce(lambda a, b: a | b, (F.contains(low, F.lit(k)) for k in v.SIGNED)))
    fact = c.rlike("(?i)" + v.FACTS) & (tokens >= 15)
    short = (tokens < 25) & (source != "faculty_profile") & ~fact
    letters = c.rlike(r"\p{L}")
    kept = (tokens < 25) & ~short
    return (
        F.when(signed, "boilerplate_signature_page")
        .when(F.lower(F.trim(F.coalesce(title, F.lit("")))).isin(v.CITIES), "artifact_section_title")
        .when(short, "too_short")
        .when(~kept & ~letters, "no_alphabetic_content")
    )


def skips_duplicates(tokens: Column) -> Column:
    """Whether a chunk takes part in the search for duplicates: short ones that stay are never compared."""
    return tokens >= 25


def size_validity(c: str | Column, least: int = 20, most: int = 1960) -> Column:
    """Empty, too_short, split or valid."""
    c = t.col(c)
    return F.when(c.isNull() | (t.squeeze(c) == ""), "empty").when(F.length(c) < least, "too_short").when(F.length(c) > most, "split").otherwise("valid")


def intent(c: str | Column) -> Column:
    """P5."""

    def of(q: Column) -> Column:
        form = q.rlike(rf"(?i)\b{v.FORM_CODE}\b|\bform\b")
        top = best([(n, hits(q, [v.rx(p) for p in ps])) for n, ps in v.INTENTS.items()], "general")
        person = F.when(hits(q, v.POLICY) > hits(q, v.PERSON), "policy_lookup").otherwise("person_lookup")
        return (
            F.when(form, F.when(q.rlike("(?i)" + v.any_of(v.DOING)), "procedure").otherwise("form_details"))
            .when(q.rlike("(?i)" + "|".join(v.DEFINES)), "definition")
            .otherwise(t.let(top, lambda k: F.when(k == "lookup", person).otherwise(k)))
        )

    return t.let(t.col(c), of)


def domain(c: str | Column) -> Column:
    """By how often a domain's words occur."""
    return t.let(t.col(c), lambda q: best([(n, F.regexp_count(q, F.lit("(?i)" + p))) for n, p in v.DOMAINS.items()], "general"))


def document_scope(c: str | Column, inst: v.Institution = v.Institution()) -> Column:
    """The file that a broad question is about, null if it is about none."""
    q = t.col(c)
    return F.coalesce(*(F.when(q.rlike("(?i)" + p), f) for p, f in v.scope_patterns(inst)))


def current_only(c: str | Column) -> Column:
    """P8."""
    return t.col(c).rlike("(?i)" + v.CURRENT)


def filters(current: Column) -> Column:
    """Only the wish for what is current becomes a filter."""
    return F.when(current, F.create_map(F.lit("is_current"), F.lit("true"))).otherwise(F.create_map().cast("map<string,string>"))


def payload_filter(filters: dict, any_of: bool = False) -> Column:
    """P10: all conditions hold; a list asks for each of its values (with any_of: for one); None asks nothing.

    A key names a column; a column of lists is asked for membership if its name is in `filters` as `name[]`."""
    out = F.lit(True)
    for key, want in filters.items():
        if want is None:
            continue
        array, name = key.endswith("[]"), key.removesuffix("[]")
        one = lambda x: F.coalesce(F.array_contains(F.col(name), F.lit(x)) if array else F.col(name) == F.lit(x), F.lit(False))  # noqa: B023, E731
        conditions = [one(x) for x in want] if isinstance(want, (list, tuple)) else [one(want)]
        out = out & (reduce(lambda a, b: a | b, conditions, F.lit(False)) if any_of and isinstance(want, (list, tuple)) else reduce(lambda a, b: a & b, conditions, F.lit(True)))
    return out


def distinct_ignoring_case(xs: Column) -> Column:
    """The first of each value, upper and lower case alike, in order."""

    def firsts(y: Column) -> Column:
        return F.filter(y["x"], lambda x, i: F.array_position(y["low"], F.lower(x)) == i + 1)

    return t.let(t.let(xs, lambda x: F.struct(x.alias("x"), F.transform(x, lambda e: F.lower(e)).alias("low"))), firsts)


def entities(c: str | Column) -> Column:
    """Entities by kind, persons without and with their titles, each once."""
    return t.let(t.col(c), _entities)


def _entities(q: Column) -> Column:
    found = {n: F.transform(F.regexp_extract_all(q, F.lit("(?i)" + p), F.lit(0)), lambda m: F.trim(m)) for n, p in v.ENTITIES.items()}
    bare = lambda m: F.trim(F.regexp_replace(m, "(?i)" + v.HONORIFIC, ""))
    persons = F.flatten(F.transform(found.pop("person"), lambda m: F.when(bare(m) != "", F.array(bare(m), m)).otherwise(F.array().cast("array<string>"))))
    return distinct_ignoring_case(F.concat(persons, *found.values()))


def is_followup(c: str | Column) -> Column:
    """P12."""
    c = t.col(c)
    q = F.lower(t.squeeze(c))
    raw = F.lower(F.regexp_replace(c, rf"^{v.WS}+|{v.WS}+$", ""))
    n = t.n_words(c)
    opener = reduce(lambda a, b: a | b, (raw.startswith(o) for o in v.OPENERS))
    return (q != "") & (opener | ((n <= 6) & q.rlike("(?i)" + v.PRONOUNS)) | ((n <= 3) & ~c.rlike(r"\b[A-Z]{2,}")))


def confidence(n_chunks: Column, top: Column, has_sections: Column, has_fallback: Column) -> Column:
    """P13."""
    return (
        F.when((n_chunks == 0) | (~has_sections & has_fallback), "none")
        .when(has_sections & (top >= 0.7) & (n_chunks >= 3), "high")
        .when(has_sections & (top >= 0.4) & (n_chunks >= 2), "medium")
        .when(has_sections & (top >= 0.3), "low")
        .otherwise("none")
    )


def grounded_confidence(conf: Column, ratio: Column) -> Column:
    """High and medium fall to low under a half; what isn't high or medium falls to none under a quarter."""
    firm = conf.isin("high", "medium")
    return F.when((ratio < 0.5) & firm, "low").when(~((ratio < 0.5) & firm) & (ratio < 0.25), "none").otherwise(conf)


def valid_request(query: Column, top_k: Column) -> Column:
    """What is wrong with a request, null if nothing is."""
    n = F.length(t.squeeze(query))
    return F.when(query.isNull() | (n < 2), "query too short").when(n > 10000, "query too long").when(~top_k.between(1, 50), "top_k out of range")


def document_hit(names: Column, needle: Column) -> Column:
    """Whether some name contains the needle; an empty one always does."""
    return (F.coalesce(needle, F.lit("")) == "") | F.exists(names, lambda n: F.contains(F.lower(n), F.lower(needle)))


def missing_keywords(text: Column, keywords: Column) -> Column:
    """Keywords that the text lacks, upper and lower case alike."""
    return F.filter(keywords, lambda k: ~F.contains(F.lower(text), F.lower(k)))


def bad_vector(c: str | Column) -> Column:
    """Null, empty, or with a component that is null or not finite."""
    c = t.col(c)
    return c.isNull() | (F.size(c) == 0) | F.coalesce(F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def signal_terms(c: str | Column, ents: Column) -> Column:
    """Two entities and long or capitalised words, three in all, each once."""
    ws = F.filter(t.words(c), lambda w: ((F.length(w) > 4) & w.rlike("^\\p{Lu}")) | (F.length(w) > 6))

    def of(two: Column) -> Column:
        fresh = F.filter(ws, lambda w: ~F.exists(two, lambda x: F.lower(x) == F.lower(w)))
        return F.slice(F.concat(two, distinct_ignoring_case(fresh)), 1, 3)

    return t.let(F.slice(ents, 1, 2), of)


def suggestions(c: Column) -> Column:
    """R18."""
    general = F.array(*(F.lit(x) for x in v.SUGGESTIONS["general"]))
    out = general
    for k, xs in v.SUGGESTIONS.items():
        out = F.when(c == k, F.array(*(F.lit(x) for x in xs))).otherwise(out)
    return out


def expand_query(c: str | Column, kind: Column, ents: Column, lookups: tuple[str, ...] = ("lookup",)) -> Column:
    """The query without titles and related terms it lacks, in the order in which they are found, 20, 10 or 8
    at most. `lookups` are the intents that count as lookups."""
    return t.let(F.struct(t.strip_titles(c).alias("q"), kind.alias("kind"), ents.alias("ents")), lambda x: _expanded(x["q"], x["kind"], x["ents"], lookups))


def _expanded(q: Column, kind: Column, ents: Column, lookups: tuple[str, ...]) -> Column:
    arr = lambda s: F.array(*(F.lit(w) for w in s.split()))
    none = F.array().cast("array<string>")
    has = lambda ws: reduce(lambda a, b: a | b, (F.contains(q, F.lit(w)) for w in ws))
    when = lambda cond, xs: F.when(cond, xs).otherwise(none)
    vague = has(v.VAGUE)
    form = F.regexp_extract(q, "(?i)" + v.FORM_NAME, 0)
    steps = lambda head: F.concat(arr(head + " process procedure"), F.array(form), arr("submit approval"))
    for_form = (
        F.when(has(["leave"]), steps("leave application"))
        .when(has(["reimbursement", "claim"]), steps("reimbursement claim"))
        .when(has(["travel"]), steps("travel"))
        .when(has(["grant", "research"]), steps("grant research"))
        .otherwise(F.concat(arr("process procedure application"), F.array(form), arr("submit approval steps")))
    )
    name = when(F.size(ents) > 0, t.name_parts(t.strip_titles(F.get(ents, F.lit(0)))))
    parts = [when((form != "") & has(v.FILLING), for_form)]
    parts += [when(kind == k, arr(s)) for k, s in v.BY_INTENT.items()]
    for n, (ws, s) in enumerate(v.LOOKUPS):
        parts.append(when(kind.isin(*lookups) & has(ws.split(",")), F.concat(arr(s), name) if n == 0 else arr(s)))
    parts += [when(vague & has(ws.split(",")), arr(s)) for ws, s in v.BROAD]
    related = F.concat(*(when(F.contains(q, F.lit(k)), arr(s)) for k, s in v.SYNONYMS.items()))
    terms = t.let(F.concat(*parts), lambda x: F.concat(x, when(vague & (F.size(x) < 5), arr(v.BROADEST)), related))
    fresh = t.let(F.split(q, " "), lambda own: F.array_distinct(F.filter(terms, lambda x: ~F.array_contains(own, F.lower(x)))))

    def cut(x: Column) -> Column:
        most = F.when(vague, 20).when(F.array_contains(x, "faculty") | F.array_contains(x, "professor"), 10).otherwise(8)
        return F.concat_ws(" ", F.array(q), F.slice(x, F.lit(1), most))

    return t.let(fresh, cut)


def understand(c: str | Column, inst: v.Institution = v.Institution()) -> Column:
    """Intent from the raw query, all else from the cleaned and rewritten one; a question about a whole
    document overrides both."""
    first = t.let(t.col(c), lambda raw: F.struct(raw.alias("raw"), t.rewrite_query(t.clean_query(raw)).alias("q")))
    low = lambda x: F.lower(x["q"])
    second = t.let(first, lambda x: F.struct(x["q"].alias("q"), low(x).alias("low"), document_scope(low(x), inst).alias("scope"), intent(F.lower(x["raw"])).alias("kind"), entities(x["q"]).alias("ents"), current_only(low(x)).alias("now")))

    def of(x: Column) -> Column:
        over, none = x["scope"].isNotNull(), F.array().cast("array<string>")
        return F.struct(
            F.when(over, "document_overview").otherwise(x["kind"]).alias("intent"),
            F.when(over, "policies").otherwise(domain(x["low"])).alias("domain"),
            F.when(over, none).otherwise(x["ents"]).alias("entities"),
            F.when(over, False).otherwise(x["now"]).alias("is_current_only"),
            F.when(over, F.create_map(F.lit("document_name"), x["scope"])).otherwise(filters(x["now"])).alias("metadata_filters"),
            F.when(over, F.concat(x["low"], F.lit(" policy guidelines rules procedures sections"))).otherwise(expand_query(x["q"], x["kind"], x["ents"])).alias("expanded_query"),
        )

    return t.let(second, of)
