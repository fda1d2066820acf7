"""HTML extraction by site template removal.

A tolerant parser turns a page into a stream of text pieces with the span of every element, and hashes each element's
subtree twice, bottom-up: exactly (tags and text), and by its shape (tags and classes, text masked, equal neighbours
once, so that menus of five and of six links have one shape). Spark counts, per host, on how many pages of different
content a hash occurs, and subtrees that recur are deleted:

    outside article and main    what recurs exactly on `min_pages` pages, however many the host has; where the page
                                has an article or main element, also what recurs in shape on that many pages and on
                                `shape_share` of those of its host that have one
    inside article and main     whole blocks that recur exactly in `min_articles` different articles and in
                                `article_share` of those of the host: passages that fewer share are no template

What a page itself marks as no part of the article (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, reader comments) goes as well; that decides alone on hosts too small to count, where the article or main
element, if there is one, is all that stays. Ids are read outside such an element only.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .url_filter import host_and_path

#: Comments, declarations and tags; a tag with an unbalanced quote ends at its first `>`. No alternative is tried twice,
#: so time is linear in a page however broken.
TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(?P<e>/?)(?P<n>[a-zA-Z][^\s/<>]*+)(?P<v>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<e2>/?)(?P<n2>[a-zA-Z][^\s/<>]*+)(?P<v2>[^<>]*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: These break no line of text and end no paragraph either.
FLOWING = INLINE | set("script style template noscript svg iframe button input select textarea object audio video map canvas meta link".split())
#: Elements that are never a part of the article.
DROP = set("head title script style noscript template nav footer aside form iframe svg button select option textarea dialog menu canvas object audio video map noembed noframes datalist".split())
MAIN = {"article", "main"}
#: Start tags that end an open element of one of these names first.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
BOUNDS = {"ul", "ol", "dl", "table", "article", "main", "section", "div", "body", "select", "td", "th"}
WORDS = "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion promoted cookie cookies consent gdpr notice notices alert sidebar menu menus nav navbar navigation topnav breadcrumb breadcrumbs footer masthead comment comments disqus respond replies newsletter subscribe popup modal overlay share sharing social related recommended widget login signup skip".split()
NAMED = re.compile(rf"(?:^|[\s_-])(?:{'|'.join(WORDS)}|side-?bar|(?:site|page|top|global)[_-]?header)(?:$|[\s_-])", re.I)
COMMENT = re.compile(r"(?:^|\s)comments?(?:$|\s)", re.I)
#: Inside these an inline element is a word or link of running text.
PROSE = set("p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote pre figcaption caption".split())
#: Elements that are no blocks of their own inside an article: parts of lists and tables, and headings, recur as words do.
PARTS = set("li dt dd tr td th thead tbody tfoot caption h1 h2 h3 h4 h5 h6 html body head".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}


class Element(NamedTuple):
    name: str
    first: int
    end: int
    #: what is never text, such as scripts; what the page marks as no article; an article or main element; what lies in
    #: one; what has one inside; an inline element in running text
    raw: bool
    marked: bool
    main: bool
    inside: bool
    around: bool
    prose: bool
    exact: int
    shape: int


class Open:
    """An element that isn't closed yet."""

    __slots__ = ("name", "first", "marked", "main", "around", "prose", "text", "hash", "look", "shapes")

    def __init__(self, name: str, first: int, marked: bool, main: bool, prose: bool, classes: str):
        self.name, self.first, self.marked, self.main, self.prose = name, first, marked, main, prose
        self.around = self.text = False
        self.hash = xxhash.xxh64(name)
        self.look, self.shapes = f"{name}.{classes}", []

    def has(self, shape: str) -> None:
        if not self.shapes or self.shapes[-1] != shape:
            self.shapes.append(shape)


class Page:
    """The text pieces of a page, and its elements with text as spans of them. Time is linear in the page."""

    def __init__(self, source: str):
        self.pieces: list[str] = []
        self.elements: list[Element] = []
        self._parse(source)
        self.mains = [e for e in self.elements if e.main and not e.marked]

    def _parse(self, s: str) -> None:
        pieces, stack, at, n = self.pieces, [], 0, len(s)
        #: places on the stack by name, and those of elements that aren't inline
        places: dict[str, list[int]] = {}
        blocks: list[int] = []
        lower = None
        inside = 0

        def put(text: str) -> None:
            pieces.append(text)
            if stack and (words := text.split()):
                top = stack[-1]
                top.text = True
                top.hash.update("\1" + " ".join(words))
                top.has("t")

        def close(k: int) -> None:
            nonlocal inside
            while len(stack) > k:
                o = stack.pop()
                places[o.name].pop()
                if o.name not in INLINE:
                    blocks.pop()
                inside -= o.main
                exact = o.hash.intdigest()
                inline = o.name in INLINE and o.name != "a"
                shape = "t" if inline else xxhash.xxh64_hexdigest(f"{o.look}({','.join(o.shapes)})")
                if stack:
                    up = stack[-1]
                    up.around |= o.main or o.around
                    if o.text:
                        up.text = True
                        up.hash.update(f"\2{exact:x}")
                        up.has(shape)
                if o.text:
                    self.elements.append(Element(o.name, o.first, len(pieces), False, o.marked, o.main, inside > 0, o.around, o.prose, exact, 0 if inline else int(shape, 16)))

        def last(names) -> int:
            return max((places[x][-1] for x in names if places.get(x)), default=-1)

        while at < n:
            m = TOKEN.search(s, at)
            if not m:
                put(html.unescape(s[at:]))
                break
            if m.start() > at:
                text = s[at : m.start()]
                put(html.unescape(text) if "&" in text else text)
            at = m.end()
            name = m["n"] or m["n2"]
            if not name:
                if m.group().startswith("<![CDATA["):
                    put(m.group()[9:].removesuffix("]]>"))
                continue
            name = name.lower()
            block = name not in FLOWING
            if m["e"] or m["e2"]:
                if name == "p" or name == "br":
                    pieces.append(" ")
                if places.get(name):
                    k = places[name][-1]
                    # an inline end tag closes no block
                    if name not in INLINE or not blocks or blocks[-1] < k:
                        close(k)
                if block:
                    pieces.append(" ")
                continue
            if block:
                pieces.append(" ")
            if name in VOID:
                continue
            if name in ENDS or block:
                ends = ENDS.get(name, ())
                while True:
                    k = last((*ends, "p"))
                    if k < 0 or k < last(BOUNDS.difference(ends)):
                        break
                    close(k)
                    if not ends:
                        break
            marked, classes = name in DROP, ""
            main = name in MAIN
            values = m["v"] or m["v2"]
            if values and name not in ("html", "body"):
                for a, *v in ATTRIBUTE.findall(values):
                    a, value = a.lower(), "".join(v)
                    if a == "role":
                        marked |= value.strip().lower() in ROLES
                        main |= value.strip().lower() == "main"
                    elif a == "class":
                        classes = " ".join(sorted(value.split()))
                        marked |= bool((COMMENT if main else NAMED).search(value))
                    elif not inside and not main:
                        marked |= bool(NAMED.search(value))
            if name == "header" and not inside:
                marked = True
            if name in RAW:
                if lower is None:
                    lower = s.lower() if len(s.lower()) == n else s
                end = lower.find(f"</{name}", at)
                first = len(pieces)
                text = s[at : n if end < 0 else end]
                if marked:
                    pieces.append(text)
                else:
                    put(text)
                self.elements.append(Element(name, first, len(pieces), marked, marked, False, inside > 0, False, False, 0, 0))
                if end < 0:
                    break
                at = s.find(">", end) + 1 or n
                continue
            prose = bool(stack) and (stack[-1].prose or stack[-1].name in PROSE)
            places.setdefault(name, []).append(len(stack))
            if name not in INLINE:
                blocks.append(len(stack))
            stack.append(Open(name, len(pieces), marked, main, prose, classes))
            inside += main
        close(0)

    def candidates(self, host: str | None) -> list[tuple[int, int, int]]:
        """Key, first and end piece of what may be a template, and one key without a span for a page with an article."""
        out = [(_host_key(host, 0, ARTICLE), 0, 0)] if self.mains else []
        for e in self.elements:
            if e.raw or e.main or e.around or e.name in WHOLE or e.name in RAW:
                continue
            if e.inside:
                if not (e.marked or e.name in PARTS or e.name in FLOWING):
                    out.append((_host_key(host, e.exact, BLOCK), e.first, e.end))
            elif not (e.name in FLOWING and e.prose):
                out.append((_host_key(host, e.exact, EXACT), e.first, e.end))
                if self.mains and e.name not in FLOWING:
                    out.append((_host_key(host, e.shape, SHAPE), e.first, e.end))
        return out

    def text(self, found: Iterable[tuple[int, int, int]] = (), marks: bool = True) -> str:
        """The main text without the candidates `found`; without marks, only these and what is never text go."""
        keep = bytearray(b"\1") * len(self.pieces)
        counted = False
        for key, _, _ in found:
            counted |= key & 3 == ARTICLE
        if self.mains and marks and not counted:
            keep = bytearray(len(self.pieces))
            for e in self.mains:
                keep[e.first : e.end] = b"\1" * (e.end - e.first)
        for e in self.elements:
            if e.raw or marks and e.marked and (e.name in DROP or not e.around or not self.mains):
                keep[e.first : e.end] = bytes(e.end - e.first)
        whole = bytes(keep)
        for _, a, b in found:
            keep[a:b] = bytes(b - a)
        if self.mains and not any(k and not p.isspace() for p, k in zip(self.pieces, keep)):
            keep = whole  # an article isn't emptied
        return " ".join("".join(p if k else " " if p == " " else "" for p, k in zip(self.pieces, keep)).split())


#: Kinds of keys, their lowest two bits.
EXACT, BLOCK, SHAPE, ARTICLE = range(4)
WHOLE = {"html", "body", "head"}


def _host_key(host: str | None, subtree: int, kind: int) -> int:
    return (xxhash.xxh64_intdigest(f"{host}\n{subtree}\n{kind}") >> 2 << 2 | kind) - (1 << 63)


#: So many templates at most are sent to every executor (8 bytes each); more are joined to their pages instead.
MOST_BROADCAST = 2_000_000


def recurring(pages: DataFrame, host: Column, source: str, min_pages: int, shape_share: float, min_articles: int, article_share: float) -> DataFrame:
    """(key,): host and subtree, hashed together, of subtrees that recur; see the module for the bars.

    Pages of a host with the same text outside their templates count once, in numbers and in what shares are of.
    Counts are combined before they are shuffled, so a host with a third of all pages isn't gathered anywhere.
    """
    from .common import cut

    def subtrees(hosts: pa.Array, sources: pa.Array) -> pa.Array:
        rows = []
        for h, s in zip(hosts.to_pylist(), sources):
            p = Page(s.as_py() or "")
            content = xxhash.xxh64_intdigest(p.text()) - (1 << 63)
            rows.append({"keys": sorted({k for k, _, _ in p.candidates(h)}), "content": content})
        return pa.array(rows, pa.struct([("keys", pa.list_(pa.int64())), ("content", pa.int64())]))

    found = pages.select(host.alias("h"), F.arrow_udf(subtrees, "keys array<long>, content long")(host, F.col(source)).alias("s"))
    each = found.select(F.xxhash64("h").alias("h"), "s.content", F.explode("s.keys").alias("key")).distinct()
    found = cut(each.groupBy("h", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= min(min_pages, min_articles)))
    kind = F.col("key").bitwiseAND(F.lit(3))
    articles = found.filter(kind == ARTICLE).select("h", F.col("n").alias("articles"))
    shared = found.filter(kind.isin(BLOCK, SHAPE)).join(articles, "h")
    block = (kind == BLOCK) & (F.col("n") >= min_articles) & (F.col("n") >= F.col("articles") * article_share)
    shape = (kind == SHAPE) & (F.col("n") >= min_pages) & (F.col("n") >= F.col("articles") * shape_share)
    return found.filter(kind.isin(EXACT, ARTICLE) & (F.col("n") >= min_pages)).select("key").unionByName(shared.filter(block | shape).select("key"))


def extract_text(df: DataFrame, url: str = "url", source: str = "html", key: str = "page_id", out: str = "text", min_pages: int = 5, shape_share: float = 0.5, most_broadcast: int = MOST_BROADCAST, min_articles: int = 20, article_share: float = 0.5, marks: bool = True) -> DataFrame:
    """Adds the main text of each page; see the module's own words for what that is.

    Null and empty pages, and pages without text, have an empty text. Pages without a host form one site. Every row
    is kept, repeated ones too; a column named as `out` is replaced, others pass through; an empty table gives an
    empty table. The bars don't rise with a host's size but where a share is asked for; a host of fewer than
    `min_pages` different pages is left to what its pages mark. With marks=False only counts decide (and scripts and
    the like go), so that their part can be told. `key` isn't looked at.
    """
    from .common import cut, modest_batches

    modest_batches(df)
    host = host_and_path(F.col(url).cast("string"))[0]
    keys = cut(recurring(df, host, source, min_pages, shape_share, min_articles, article_share))
    if keys.count() <= most_broadcast:
        shared = df.sparkSession.sparkContext.broadcast(frozenset(r.key for r in keys.collect()))

        def text(hosts: pa.Array, sources: pa.Array) -> pa.Array:
            known, texts = shared.value, []
            for h, s in zip(hosts.to_pylist(), sources):
                p = Page(s.as_py() or "")
                texts.append(p.text([c for c in p.candidates(h) if c[0] in known] if known else (), marks))
            return pa.array(texts, pa.string())

        return df.withColumn(out, F.arrow_udf(text, "string")(host, F.col(source)))

    def own(hosts: pa.Array, sources: pa.Array) -> pa.Array:
        rows = [sorted({k for k, _, _ in Page(s.as_py() or "").candidates(h)}) for h, s in zip(hosts.to_pylist(), sources)]
        return pa.array(rows, pa.list_(pa.int64()))

    def strip(hosts: pa.Array, sources: pa.Array, found: pa.Array) -> pa.Array:
        texts = []
        for h, s, f in zip(hosts.to_pylist(), sources, found.to_pylist()):
            p, f = Page(s.as_py() or ""), set(f or ())
            texts.append(p.text([c for c in p.candidates(h) if c[0] in f], marks))
        return pa.array(texts, pa.string())

    # Many templates: those of each page are found by a join, and only pages that have some are joined to them.
    page = F.xxhash64(host, F.coalesce(F.col(source), F.lit("")))
    each = df.select(page.alias("__lode_page"), F.explode(F.arrow_udf(own, "array<long>")(host, F.col(source))).alias("key")).distinct()
    mine = each.join(keys, "key").groupBy("__lode_page").agg(F.collect_list("key").alias("__lode_keys"))
    joined = df.withColumn("__lode_page", page).join(mine, "__lode_page", "left")
    return joined.withColumn(out, F.arrow_udf(strip, "string")(host, F.col(source), F.col("__lode_keys"))).drop("__lode_page", "__lode_keys")


def op10(spark, sf_dir: str) -> DataFrame:
    from .common import table

    pages = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
