"""Text functions and classifiers on stated cases."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import chunking as c
from lodestone.functions import classify as p
from lodestone.functions import text as t
from lodestone.functions import vocab as v


def one(spark, make, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("path,want", [("data/raw/faculty_list.csv", "faculty_profile"), ("data/raw/leave_policy.pdf", "hr_policy"), ("data/raw/compendium_forms.pdf", "form_document"), ("data/raw/agreement.pdf", "legal_document"), ("faculty_leave_policy.pdf", "form_document"), ("x/notes.txt", "general_document")])
def test_source_type(spark, path, want):
    assert one(spark, p.source_type, path) == want


@pytest.mark.parametrize("q,want", [("what is hr-la-01?", "form_details"), ("how do i fill the hr-la-01 leave application form?", "procedure"), ("what leave policies apply to faculty?", "general"), ("how does promotion work?", "general"), ("am i eligible for sabbatical leave?", "eligibility"), ("define sabbatical leave", "definition"), ("what's the weather in town today?", "general"), ("what is the leave policy on gratuity", "policy_lookup"), ("", "general")])
def test_intent(spark, q, want):
    assert one(spark, p.intent, q) == want


def test_page_markers_and_repeated_heads(spark):
    assert "Page | 12" not in one(spark, t.clean_chunk, "Some content\nPage | 12\nMore content")
    assert one(spark, t.clean_chunk, "Parameter Details\nParameter Details\nSome value").count("Parameter Details") <= 1
    assert one(spark, t.clean_chunk, "a\xa0 b <i>c</i>\n\n\n\nd​") == "a b c\n\nd"
    assert one(spark, t.strip_page_headers, "x EXU — Employee Resource Book v2 CONFIDENTIAL y  SECTION 3: Z") == "x y\nSECTION 3: Z"


def test_quirks_that_are_kept(spark):
    assert one(spark, t.normalise, "  a\tb\n c ") == "ab c"  # a tab goes first and glues its words
    assert one(spark, t.special_chars, "“a” — ₹5") == "“a” - Rs.5"  # curly quotes stay
    assert one(spark, t.strip_titles, "Dr. X") == ". x"
    assert one(spark, t.token_estimate, "a b c") == 3 and one(spark, t.token_estimate, None) == 0
    assert one(spark, t.name_parts, "Prof. Jane Q Doe") == ["Jane", "Doe", "Jane Doe", "Jane Q Doe"] and one(spark, t.name_parts, "Li") == ["Li"]
    assert one(spark, t.point_id, "abc") == int("900150983cd24fb0", 16)


def test_nulls_and_empty_texts(spark):
    df = spark.createDataFrame([(None,), ("",), ("é",)], "x string")
    x = F.col("x")
    fs = [t.bm25_tokens(x), t.ground_tokens(x), t.shingles(t.ground_tokens(x)), t.topic_tags(x), t.has_steps(x), t.research_tags(x), t.form_references(x), t.rewrite_query(t.clean_query(x)), t.repair_json(x), p.entities(x), p.is_followup(x), p.understand(x), p.size_validity(x), c.pieces(x), c.joined_lines(x), t.group_rows(x)]
    assert df.select(*(f.alias(f"f{n}") for n, f in enumerate(fs))).count() == 3
    assert len(df.select(*(f.alias(f"f{n}") for n, f in enumerate(fs))).collect()) == 3


def test_answers(spark):
    good = one(spark, lambda x: t.parse_answer(x, F.lit("general")), 'x {"title": "T", "sections": [{"type": "Unordered", "content": ["a", "b"]}, {"heading": "CRITICAL", "type": "callout", "content": "c"}, {"type": "matrix", "content": [{"k": "1", "l": null}]}, {"body": "d"}]} y')
    a, b, m, d = good.sections
    assert (a.type, a["items"]) == ("bullets", ["a", "b"]) and (b.type, b.severity) == ("alert", "important")
    assert (m.headers, m.rows) == (["k", "l"], [["1", ""]]) and (d.type, d.content) == ("paragraph", "d")
    for bad in ("no", '{"title": ', None):
        r = one(spark, lambda x: t.parse_answer(x, F.lit("general")), bad)
        assert (r.title, r.confidence, r.sections) == ("Response Error", "none", []) and r.fallback


def test_profile_text(spark):
    kind = "struct<name:string,qualification:string,experience:string,research_interests:string,publications:map<string,array<string>>,awards:array<string>>"
    got = one(spark, t.profile_text, ("A", "PhD", "Not Specified", None, {"journals": ["p", "q"]}, ["w"]), kind)
    assert got == "Name: A\nQualification: PhD\n\nJournals:\n  - p\n  - q\n\nAwards:\n  - w"


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", ["p", "q"]), (2, "b", ["q"]), (3, None, None)], "id int, k string, tags array<string>")
    ids = lambda f, **o: [r.id for r in df.filter(p.payload_filter(f, **o)).collect()]
    assert ids({}) == [1, 2, 3] and ids({"k": "a", "x": None}) == [1] and ids({"tags[]": ["p", "q"]}) == [1] and ids({"tags[]": ["p", "q"]}, any_of=True) == [1, 2] and ids({"k": ["a", "b"]}) == []


# -- chunking


def test_lines():
    assert c.join_lines("Parameter   Value\nlower cell") == "Parameter   Value\nlower cell"
    assert c.join_lines("This is a long\nsentence continued") == "This is a long sentence continued"
    assert c.join_lines("A\n\n(b)\nOf course\nx") == "A\n\n(b) Of course x"


def form(code, title, pages=1):
    head = "EXU — Example University\n"
    return f"{head}{title}\nForm Code:\n{code}\nSECTION A: Applicant Details, name and number\nmore words here\n" + f"{head}and it goes on\nSECTION B: Dates of the leave and days\n" * (pages - 1)


def test_forms():
    two = c.forms(form("HR-LA-01", "LEAVE APPLICATION FORM") + "\n" + form("HR-CO-01", "CONFERENCE REQUEST FORM"))
    whole = [x for x in two if x["chunk_type"] == "form_template"]
    assert [x["form_code"] for x in whole] == ["HR-LA-01", "HR-CO-01"]
    assert [x["section_letter"] for x in two if x["chunk_type"] == "form_section"] == ["A", "A"]
    one_ = c.forms(form("HR-LA-01", "LEAVE APPLICATION FORM", pages=3))
    assert sum(x["chunk_type"] == "form_template" for x in one_) == 1
    assert [x["section_letter"] for x in one_ if x["chunk_type"] == "form_section"] == ["A", "B"]


def test_sections():
    text = "Ten words stand here before the first header of all.\n\nSECTION 1: LEAVE RULES\n\n4.1 Types of leave\nbody one of it\n4.2 Length of leave\nbody two of it\nCHAPTER 2: More\nrest"
    got = c.sections(text, 2000)
    assert [a for a, _ in got] == ["Introduction", "SECTION 1: LEAVE RULES", "CHAPTER 2: More"]
    small = c.sections(text, 12)
    assert [a for a, _ in small] == ["Introduction", "SECTION 1: LEAVE RULES > 4.1 Types of leave", "SECTION 1: LEAVE RULES > 4.2 Length of leave", "CHAPTER 2: More"]
    assert c.sections("plain", 10) == [("", "plain")] and c.headers("\n1. ABC\n", c.MAJOR)[0][2] == "1. ABC"


def test_sizes():
    paras = [f"Paragraph {k} " + "word " * 30 for k in range(20)]
    out = c.by_size("\n\n".join(paras), 100, 10)
    assert all(c.estimate(x) <= 160 for x in out) and all(any(f"Paragraph {k} " in x for x in out) for k in range(20))
    assert all(b.startswith(a[-40:].strip()[:20]) or a[-40:][:10] in b for a, b in zip(out, out[1:]))
    long = " ".join(f"Sentence {k} is here." for k in range(200))
    parts = c.by_sentences(long, 50)
    assert "".join(x.replace(" ", "") for x in parts) == long.replace(" ", "") and all(c.estimate(x) <= 55 for x in parts)
    assert c.by_size("Steps\n1. a\n2. b", 100, 5) == [c.group_rows("Steps\n1. a\n2. b")]
    assert c.by_sentences("one two three", 1) == ["one two three"]


def test_reader_pieces():
    assert c.reader_pieces("short.") == ["short."]
    s = [f"Sentence number {k} of the text." for k in range(200)]
    out = c.reader_pieces(" ".join(s), 300)
    assert all(len(x) <= 300 for x in out) and all(any(x in y for y in out) for x in s)
    for a, b in zip(out, out[1:]):  # each begins with the end of the one before
        assert b.split(". ")[0] in a
    assert c.reader_pieces("x" * 5000) == ["x" * 5000]


def test_profiles():
    text = f"Faculty: A B\nx\n{c.RULE}\nFaculty: C\n" + "w " * 40 + "\nPublications: p q\n"
    got = c.profiles(text, 30)
    assert [(k, part) for k, part, _ in got] == [(0, None), (1, "A"), (1, "B")] and got[2][2].startswith("Faculty: C\n\nPublications:")
    many = c.profile_chunks("N", "u", "Name: N Publications: " + "Title one. " * 400 + "Awards: Prize.")
    assert many[0] == "Faculty: N\nProfile: u\n\nName: N" and "(continued 2)" in many[2] and many[-1].endswith("Awards: Prize.") and all(len(x) <= c.MOST_CHARS for x in many)


def test_chunks_of_documents(spark):
    rows = [(1, "a/faculty_list.csv", f"Faculty: Dr. A Rao\nResearch Interests: optics\n{c.RULE}\nFaculty: B\n"), (2, "a/leave_policy.pdf", "CHAPTER 1: Leave\nUse form A-12 if\n1. this\n2. that"), (3, "a/compendium_forms.pdf", form("HR-LA-01", "LEAVE APPLICATION FORM", 2)), (4, "a/x.txt", None), (5, "a/y.txt", "")]
    got = c.chunk_documents(spark.createDataFrame(rows, "id int, path string, text string")).collect()
    assert sorted((r.id, r.chunk_type) for r in got) == [(1, "full_profile"), (1, "full_profile"), (2, "policy_section"), (3, "form_section"), (3, "form_section"), (3, "form_template")]
    two = next(r for r in got if r.id == 2)
    assert (two.section_title, two.has_steps, two.has_forms, two.form_references) == ("CHAPTER 1: Leave", True, True, ["form A-12"])
    keys = c.chunk_documents(spark.createDataFrame(rows, "id int, path string, text string")).withColumn("split_index", F.lit(None)).select(c.chunk_key().alias("k")).distinct().count()
    assert keys == len(got)


def test_split_for_reader(spark):
    df = spark.createDataFrame([(1, "A sentence that is long enough. " * 100, "T"), (2, "tiny", "U"), (3, None, "V"), (4, "Exactly long enough text", "W")], "id int, text string, section_title string")
    got = c.split_for_reader(df).orderBy("id", "split_index").collect()
    assert [r.id for r in got] == [1, 1, 2, 3, 4] and [r.section_title for r in got[:2]] == ["T (1/2)", "T (2/2)"]
    assert [(r.is_valid, r.discard_reason) for r in got[2:]] == [(False, "too_short"), (False, "empty"), (True, None)]


def test_words_that_patterns_need():
    assert [t.needed(p) for p in ["ab?cd", "(x|y)+abc", "[abc]d{2}efg", "a|bc", r"\[abc\]de", "[]x]abc", r"[^)\]]abc", "((a)[(])bc", "é+"]] == ["cd", "abc", "efg", "", "abc", "abc", "abc", "bc", ""]
    assert all(t.needed(p) for p in v.page_headers(v.Institution()))


def test_replacements_only_where_their_word_is(spark):
    """As without looking for words first, also where one replacement's blank comes between parts of another's pattern."""
    rng = random.Random(6)
    bits = ["EXU", " — ", "Example University", " | ", "HR Department", "Page | 3", "page 7", "www.example.edu", "\n", "© 2020 EXU z", "AY 2020-21", "Tel: 91 a@example.edu b", "\nSECTION 2: A", " SECTION 2: A", " annexure B:", "  ", "\t", "Pa", "ge 12", "Σİ", "CONFIDENTIAL", "Examp", "le", "word"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 20))) for _ in range(500)] + ["", "Example www.example.edu University\nx", None]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    plain = t.chain("text", [(p, " ") for p in v.page_headers(v.Institution())] + [(r"[ \t]+", " ")], "(?i)")
    plain = t.chain(plain, [(r"(?<!\n)\s+(" + w + r"\s+\d+\s*:)", "\n$1") for w in ("SECTION", "CHAPTER")])
    plain = F.regexp_replace(plain, r"(?i)(?<!\n)\s+(Annexure\s+[A-Z]+\s*:)", "\n$1")
    assert df.filter(~plain.eqNullSafe(t.strip_page_headers("text"))).count() == 0
    odd = ["a  b\u3000c\xa0 d\n e\t\tf\x0bg\x1ch \r\n i ", " x ", "", "\u3000", "é   é"]
    for x, got in spark.createDataFrame([(x,) for x in odd], "x string").select("x", t.squeeze("x")).collect():
        assert got == " ".join(x.split())
