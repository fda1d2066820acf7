"""Cleaning, tokens, tags and hashes of text as Column functions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as v


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def chain(c: str | Column, steps: list[tuple[str, str]], flags: str = "") -> Column:
    """Replacements in order."""
    c = col(c)
    for pattern, to in steps:
        c = F.regexp_replace(c, flags + pattern, to)
    return c


#: Runs of white space but those that are one space already; what is visible ASCII is passed over first.
RUN = rf"(?=[^!-~])(?: {v.WS}+|(?! ){v.WS}+)"


def squeeze(c: str | Column) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(col(c), RUN, " "))


def words(c: str | Column) -> Column:
    """As Python's split()."""
    return F.filter(F.split(squeeze(c), " "), lambda w: w != "")


def n_words(c: str | Column) -> Column:
    return let(squeeze(c), lambda q: F.when(q == "", 0).otherwise(F.length(q) - F.length(F.replace(q, F.lit(" "), F.lit(""))) + 1))


def token_estimate(c: str | Column) -> Column:
    """1.3 tokens a word, rounded down; null and empty give 0."""
    return F.coalesce(F.floor(n_words(c) * F.lit(1.3)), F.lit(0)).cast("int")


def tail(c: str | Column, tokens: int) -> Column:
    """The last characters, four a token."""
    return F.right(col(c), F.lit(4 * tokens))


def needed(pattern: str) -> str:
    """A word of ASCII letters, in lower case, without which a text can't match; empty if the pattern shows none.

    Groups, classes, escapes and what may be absent are passed over; of the words that are left the longest counts."""
    words, word, k = [""], "", 0
    while k < len(pattern):
        x = pattern[k]
        if x.isascii() and x.isalpha():
            word += x
        elif x == "|":
            return ""
        else:
            words.append(word[:-1] if x in "*?{" else word)
            word = ""
            if x == "\\":
                k += 1
            elif x in "([{":
                k = _end(pattern, k)
        k += 1
    return max([*words, word], key=len).lower()


def _end(pattern: str, k: int) -> int:
    """Where the group, class or count that begins at k ends."""
    if pattern[k] == "{":
        return pattern.index("}", k)
    inside, depth = pattern[k] == "[", 0
    while True:
        if pattern[k] == "\\":
            k += 1
        elif pattern[k] == "]":
            inside = False
            depth -= not depth
        elif pattern[k] == "[":
            inside = True
        elif not inside:
            depth += {"(": 1, ")": -1}.get(pattern[k], 0)
        if not inside and depth <= 0:
            return k
        k += 1


def chain_where(c: str | Column, steps: list[tuple[str, str, str]]) -> Column:
    """Replacements (pattern, to, word) in order, each tried only on texts that have its word in upper or lower case.

    The words are looked for in the text as it was; so a word has no white space, and what is put in has some, which
    can make no such word of what is around it."""

    def step(pattern: str, to: str, word: str):
        def one(x: Column) -> Column:
            done = F.regexp_replace(x["t"], pattern, to)
            return F.struct((F.when(F.contains(x["low"], F.lit(word)), done).otherwise(x["t"]) if word else done).alias("t"), x["low"].alias("low"))

        return one

    # No function stands within another's: a Python function whose argument has such isn't planned by Spark 4.1.
    out = let(col(c), lambda x: F.struct(x.alias("t"), F.lower(x).alias("low")))
    for s in steps:
        out = let(out, step(*s))
    return out["t"]


def strip_page_headers(c: str | Column, inst: v.Institution = v.Institution()) -> Column:
    """T1."""
    steps = [("(?i)" + p, " ", needed(p)) for p in v.page_headers(inst)] + [(r" [ \t]+|\t[ \t]*", " ", "")]
    steps += [(r"(?<!\n)\s+(" + w + r"\s+\d+\s*:)", "\n$1", w.lower()) for w in ("SECTION", "CHAPTER")]
    return chain_where(c, [*steps, (rf"(?i)(?<!\n){v.GAP}(Annexure{v.GAP}{v.UP}+{v.PAD}:)", "\n$1", "annexure")])


def clean_chunk(c: str | Column, inst: v.Institution = v.Institution()) -> Column:
    """T2."""
    c = strip_page_headers(c, inst)
    twice = r"Parameter\s+Details"
    c = chain_where(c, [(rf"(?i)(?:^|\n){v.PAD}{twice}{v.PAD}(?=\n(?:.*\n)?.*?{twice})", "\n", "parameter"), (rf"(?i)(\n\s*{twice}\s*\n)(\s*{twice}\s*\n)+", "$1", "parameter")])
    table = rf"^{v.LET}[A-Za-z\s()/]+\s{{3,}}.+"
    c = F.array_join(F.transform(F.split(c, "\n"), lambda x: F.when(x.rlike(table), x).otherwise(F.regexp_replace(x, RUN, " "))), "\n")
    c = chain_where(c, [(r"\n{3,}", "\n\n", ""), (r"<[^>]+>", "", "<"), ("\xa0", " ", "\xa0"), ("\u200b", "", "\u200b")])
    return F.regexp_replace(c, rf"^{v.WS}+|(?=[^!-~]){v.WS}+$", "")


def strip_tags(c: str | Column) -> Column:
    """T3."""
    return F.regexp_replace(col(c), r"<[^>]+>", "")


def normalise(c: str | Column) -> Column:
    """T5: control characters but the line feed go first, tabs among them, so words around a tab are glued; then
    white space runs are one space."""
    return squeeze(F.regexp_replace(F.regexp_replace(col(c), rf"^{v.WS}+|{v.WS}+$", ""), r"[\x{00}-\x{09}\x{0b}-\x{1f}]", ""))


def safe_utf8(c: str | Column) -> Column:
    """Strings are UTF-8 already; broken bytes become replacement characters."""
    return F.make_valid_utf8(col(c))


def special_chars(c: str | Column) -> Column:
    """Curly quotes are left alone."""
    c = col(c)
    for a, b in v.SPECIAL:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def is_table_row(c: str | Column) -> Column:
    """T8."""
    c = col(c)
    return (F.regexp_count(c, F.lit(r"\|")) >= 2) | (F.regexp_count(c, F.lit("\t")) >= 2) | (F.regexp_count(c, F.lit(v.WS + "{3,}")) >= 2)


ROW = r"^[A-Za-z\d(][^\n]*\s{2,}\S"
ROW_HEAD = r"^(?:Action|Day|Designation|Field|Grade|Leave Type|Location|Parameter|Pay Component|Publication Type|Score Range)\s"


def group_rows(c: str | Column) -> Column:
    """Runs of table rows are one block, every other line is one; blocks are parted by an empty line.

    A row is marked before the lines are joined, so what is to be a single line feed is known without a fold."""
    lines = F.split(col(c), "\n")
    t = F.transform(lines, lambda x: F.trim(x))
    row = F.transform(t, lambda x: (x.rlike(ROW) & (F.length(x) > 20)) | x.rlike(ROW_HEAD))
    parts = F.transform(lines, lambda x, i: F.concat(F.when(i == 0, "").when(F.get(row, i) & F.get(row, i - 1), "\n").otherwise("\n\n"), x))
    return F.array_join(parts, "")


def topic_tags(c: str | Column) -> Column:
    """Terms that the text contains, in the list's order, 15 at most."""
    return let(F.lower(col(c)), lambda low: F.slice(F.array_compact(F.array(*(F.when(F.contains(low, F.lit(k)), k) for k in v.TOPICS))), 1, 15))


def has_steps(c: str | Column) -> Column:
    """T13."""
    return col(c).rlike("(?i)" + "|".join(v.STEPS))


def strip_titles(c: str | Column) -> Column:
    """Lower case, titles out, longer ones first. A title that ends in a point needs a word right after it."""
    return squeeze(chain(F.lower(col(c)), [(rf"\b{t.replace('.', '[.]')}\b", "") for t in v.TITLES]))


def normalise_query(c: str | Column) -> Column:
    """T15."""
    return squeeze(F.regexp_replace(strip_titles(c), r"\([^)]*\)", ""))


def name_parts(c: str | Column) -> Column:
    """First, last, both if there are more than two, and the whole name."""
    c = squeeze(F.regexp_replace(F.regexp_replace(col(c), "(?i)" + v.HONORIFIC, ""), r"\([^)]*\)", ""))

    def parts(p: Column) -> Column:
        n, first, last = F.size(p), F.get(p, F.lit(0)), F.element_at(p, -1)
        both = F.array(F.when(n >= 2, first), F.when(n >= 2, last), F.when(n > 2, F.concat_ws(" ", first, last)), F.array_join(p, " "))
        return F.when((n == 1) & (first == ""), F.array().cast("array<string>")).otherwise(F.array_compact(both))

    return let(F.split(c, " "), parts)


def labelled(c: str | Column, label: str, ignore_case: bool = True) -> Column:
    """What follows a label up to the line's end."""
    return F.trim(F.regexp_extract(col(c), f"{'(?i)' if ignore_case else ''}{label}:\\s*([^\\n]+)", 1))


def research_tags(c: str | Column) -> Column:
    """T18."""
    c = col(c)
    found = F.regexp_extract(c, "(?is)" + v.INTERESTS, 1)
    stop = F.array(*(F.lit(w) for w in "and at for in of on or the to with".split()))
    tags = F.transform(F.split(found, "[,;•\n]"), lambda x: F.lower(F.trim(x)))
    tags = F.filter(tags, lambda x: (F.length(x) > 2) & ~F.array_contains(stop, x))
    pubs = F.lower(F.regexp_extract(c, "(?is)" + v.PUBLICATIONS, 1))
    pubs = F.when(pubs != "", pubs).otherwise(F.lower(F.regexp_extract(c, '(?s)' + v.JSON_PUBLICATIONS, 1)))
    hit = [F.when(pubs.rlike("|".join(w)), f) for f, w in v.FIELD_WORDS]
    none = (F.size(tags) == 0) | ((F.size(tags) == 1) & F.contains(F.get(tags, F.lit(0)), F.lit("not specified")))
    return F.when(none, F.slice(F.array_compact(F.array(*hit)), 1, 5)).otherwise(F.slice(tags, 1, 10))


def form_code(c: str | Column) -> Column:
    """The first code, in upper case; empty if none."""
    return F.upper(F.regexp_extract(col(c), "(?i)" + v.FORM_CODE, 0))


def form_references(c: str | Column) -> Column:
    """The set of references to forms, sorted."""
    c = col(c)
    found = F.concat(*(F.regexp_extract_all(c, F.lit("(?i)" + p), F.lit(0)) for p in (v.CODED_FORM, v.NAMED_FORM)))
    return F.array_sort(F.array_distinct(found))


def clean_query(c: str | Column) -> Column:
    """Leading fillers out, unless nothing is left."""
    steps = [("^" + p.replace(" ", r"\s+") + r"\s+", "") for p in v.FILLERS]
    return let(squeeze(c), lambda q: F.coalesce(F.nullif(squeeze(chain(q, steps, "(?i)")), F.lit("")), q))


def rewrite_query(c: str | Column) -> Column:
    """Rewrites in order."""
    return chain(squeeze(c), v.REWRITES, "(?i)")


def bm25_tokens(c: str | Column) -> Column:
    """T24."""
    c = chain(F.lower(col(c)), [(r'[(){}\[\]|•·,;:!?"]', " "), (r"\s+-\s+", " "), (r"\.(\s|$)", " ")])
    return F.filter(F.split(squeeze(c), " "), lambda w: F.length(w) > 1)


def term_counts(w: Column) -> Column:
    """The distinct words of a list, sorted, with how often each occurs: array of (tok, tf). Runs of the sorted list, so
    nothing but the list itself is needed."""

    def runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda a: F.transform(a, lambda i, j: F.struct(F.get(s, i).alias("tok"), (F.coalesce(F.get(a, j + 1), n) - i).cast("long").alias("tf"))))

    return let(F.sort_array(w), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(F.array().cast("array<struct<tok:string,tf:bigint>>")))


def ground_tokens(c: str | Column) -> Column:
    """T25."""
    stop = F.array(*(F.lit(w) for w in v.GROUND_STOP))
    found = F.regexp_extract_all(F.lower(col(c)), F.lit(v.GROUND_WORD), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def shingles(tokens: Column, n: int = 3) -> Column:
    """Distinct n-grams, or words if there are fewer than n."""


    def grams(w: Column) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) < n, w).otherwise(some)

    return F.array_distinct(let(tokens, grams))


def point_id(c: str | Column) -> Column:
    """A vector's number from the first 16 hexadecimal digits of md5: DECIMAL(20,0), for it may pass 2^63."""
    return F.conv(F.substring(F.md5(col(c)), 1, 16), 16, 10).cast("decimal(20,0)")


def cache_key(prefix: str, c: str | Column) -> Column:
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(col(c), 256), 1, 16))


def repair_json(c: str | Column) -> Column:
    """Fences off, then from the first brace to the last."""
    c = F.trim(col(c))
    c = chain(c, [(r"^```(?:json)?\n?", ""), (r"\n?```$", "")])
    found = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(c)


SECTION = "struct<heading:string,type:string,content:string,items:array<string>,headers:array<string>,rows:array<array<string>>,severity:string>"
ANSWER = f"intent string, title string, subtitle string, sections array<{SECTION}>, footer string, confidence string, fallback string"
#: An answer as a model may send it, with its own names of fields.
LOOSE = (
    "intent string, title string, subtitle string, footer string, confidence string, fallback string, sections array<struct<heading:string,type:string,"
    "content:string,items:string,points:string,list:string,body:string,text:string,description:string,headers:array<string>,rows:array<array<string>>,severity:string>>"
)


def section_type(c: Column) -> Column:
    low = F.lower(c)
    out = low
    for kind, names in v.SECTION_TYPES.items():
        out = F.when(low.isin(names.split()), kind).otherwise(out)
    return out


def parse_answer(c: str | Column, intent: Column) -> Column:
    """Repaired, read with a loose schema, and brought to ANSWER; what can't be read becomes a
    fixed reply with fallback and confidence `none`."""
    a = F.from_json(repair_json(c), LOOSE)

    def as_list(x: Column) -> Column:
        return F.when(x.isNull(), F.lit(None)).when(x.startswith("["), F.from_json(x, "array<string>")).otherwise(F.array(x))

    def fix(s: Column) -> Column:
        kind = F.coalesce(section_type(s["type"]), F.lit("paragraph"))
        listed, plain = kind.isin("bullets", "steps"), kind == "paragraph"
        items = as_list(F.coalesce(s["items"], s["list"], s["points"], s["content"]))
        content = F.coalesce(s["description"], s["text"], s["body"], s["content"])
        # a table's content may be a list of objects
        objects = F.from_json(s["content"], "array<map<string,string>>")
        rows = F.coalesce(F.transform(objects, lambda m: F.map_values(m)), s["rows"], F.array().cast("array<array<string>>"))
        heads = F.coalesce(F.map_keys(F.get(objects, F.lit(0))), s["headers"], F.array().cast("array<string>"))
        low = F.lower(F.coalesce(s["heading"], F.lit("")))
        tone = F.when(low.rlike("warning|caution"), "warning").when(low.rlike("important|critical"), "important").otherwise("info")
        table = kind == "table"
        return F.struct(
            s["heading"].alias("heading"), kind.alias("type"),
            F.when(listed | table, F.lit(None)).when(plain, content).otherwise(s["content"]).alias("content"),
            F.when(listed, items).alias("items"), F.when(table, heads).alias("headers"),
            F.when(table, F.transform(rows, lambda r: F.transform(r, lambda x: F.coalesce(x, F.lit(""))))).alias("rows"),
            F.when(kind == "alert", F.coalesce(s["severity"], tone)).alias("severity"),
        )

    good = a.isNotNull() & a["title"].isNotNull()
    sections = F.when(good, F.coalesce(F.transform(a["sections"], fix), F.array().cast(f"array<{SECTION}>"))).otherwise(F.array().cast(f"array<{SECTION}>"))
    sorry = "The answer could not be put in order. Please put the question in other words."
    return F.struct(
        F.when(good, F.coalesce(a["intent"], intent)).otherwise(intent).alias("intent"),
        F.when(good, a["title"]).otherwise("Response Error").alias("title"),
        F.when(good, a["subtitle"]).alias("subtitle"),
        sections.alias("sections"),
        F.when(good, a["footer"]).alias("footer"),
        F.when(good, F.coalesce(a["confidence"], F.lit("high"))).otherwise("none").alias("confidence"),
        F.when(good, a["fallback"]).otherwise(sorry).alias("fallback"),
    )


def flatten_answer(a: Column) -> Column:
    """All the words of an answer."""
    parts = F.transform(a["sections"], lambda s: F.concat_ws(" ", s["heading"], s["content"], F.array_join(F.coalesce(s["items"], F.array().cast("array<string>")), " ")))
    return F.concat_ws(" ", a["title"], a["subtitle"], a["footer"], a["fallback"], F.array_join(parts, " "))


def profile_text(c: Column) -> Column:
    """Lines from a record of a person (a struct with name, qualification, experience, research_interests,
    publications as a map of lists, awards); fields that say `not specified` are left out."""
    line = lambda name, title: F.when(F.trim(c[name]).isNotNull() & (F.trim(c[name]) != "") & (F.lower(F.trim(c[name])) != "not specified"), F.concat(F.lit(title + ": "), F.trim(c[name])))
    dash = lambda xs: F.transform(xs, lambda x: F.concat(F.lit("  - "), x))
    none = F.array().cast("array<string>")
    pubs = F.flatten(F.transform(F.map_entries(c["publications"]), lambda e: F.when(F.size(e["value"]) > 0, F.concat(F.array(F.concat(F.lit("\n"), F.initcap(e["key"]), F.lit(":"))), dash(e["value"]))).otherwise(none)))
    awards = F.when(F.size(c["awards"]) > 0, F.concat(F.array(F.lit("\nAwards:")), dash(c["awards"]))).otherwise(none)
    head = F.array(F.when(c["name"].isNotNull(), F.concat(F.lit("Name: "), c["name"])), line("qualification", "Qualification"), line("experience", "Experience"), line("research_interests", "Research Interests"))
    return F.array_join(F.concat(F.array_compact(head), F.coalesce(pubs, none), F.coalesce(awards, none)), "\n")
