import hashlib
import re
import zlib

import numpy as np
import pytest

from lodestone.llm import html_text, tiff, url_filter


@pytest.mark.parametrize("n", [0, 1, 2, 5, 100, 4095, 5000, 40000])
def test_codes_round_trip(n):
    rng = np.random.default_rng(n)
    for top in (2, 40, 256):
        d = bytes(rng.integers(0, top, n, dtype=np.uint8))
        assert tiff.unlzw(tiff.lzw(d), n) == d and tiff.unpackbits(tiff.packbits(d, 64), n) == d


def test_known_codes():
    packed = bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA])
    plain = bytes([0xAA] * 3 + [0x80, 0, 0x2A] + [0xAA] * 4 + [0x80, 0, 0x2A, 0x22] + [0xAA] * 10)
    assert tiff.unpackbits(packed, len(plain)) == plain  # the example of Apple's note
    # Clear, 7, 258, 8, 8, 258, 6, 6, end: the example of the format's text
    codes, bits = [256, 7, 258, 8, 8, 258, 6, 6, 257], 0
    for c in codes:
        bits = bits << 9 | c
    data = (bits << 7).to_bytes(11, "big")
    assert tiff.unlzw(data, 10) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tile", [0, 16, 64])
@pytest.mark.parametrize("predictor", [1, 2])
def test_files_round_trip(predictor, tile, order):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 9, (70, 50), dtype=np.uint8), rng.integers(0, 255, (33, 17, 3), dtype=np.uint8)]
    for compression in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
        for big in (False, True):
            got = tiff.read_tiff(tiff.write_tiff(pages, compression, predictor, tile, 16, order, big=big))
            assert (got[0]["pixels"][:, :, 0] == pages[0]).all() and (got[1]["pixels"] == pages[1]).all() and len(got) == 2


def test_pages_of_a_frame(spark):
    good = tiff.write_tiff([np.zeros((4, 8), np.uint8), np.ones((2, 3), np.uint8)])
    loop = bytearray(tiff.write_tiff([np.zeros((2, 2), np.uint8)]))
    loop[-4:] = loop[4:8]
    rows = [(1, good, "p"), (1, good, "p"), (2, None, "q"), (3, b"", "r"), (4, good[:40], "s"), (5, bytes(loop), "t"), (6, b"II*\0\0\0\0\0", "u")]
    df = spark.createDataFrame(rows, "id int, content binary, page string")
    got = tiff.tiff_pages(df).collect()
    assert sorted((r.id, -1 if r.page is None else r.page) for r in got) == [(1, 0), (1, 0), (1, 1), (1, 1), (2, -1), (3, -1), (4, -1), (5, -1), (5, 0), (6, -1)]
    assert all((r.error is None) == (r.page is not None) for r in got) and tiff.tiff_pages(df.limit(0)).count() == 0
    assert {bytes(r.pixels) for r in got if r.id == 1} == {b"\0" * 32, b"\1" * 6}


def test_a_bad_page_costs_no_other(spark):
    pages = [np.full((4, 8), k, np.uint8) for k in range(3)]
    file = tiff.write_tiff(pages, tiff.NONE)

    def entry(page, tag):
        """Where the value of a tag of a page's directory lies."""
        at = int.from_bytes(file[4:8], "little")
        for _ in range(page):
            at = int.from_bytes(file[at + 2 + 12 * int.from_bytes(file[at : at + 2], "little") :][:4], "little")
        for k in range(int.from_bytes(file[at : at + 2], "little")):
            if int.from_bytes(file[at + 2 + 12 * k :][:2], "little") == tag:
                return at + 2 + 12 * k + 8
        raise KeyError(tag)

    def changed(tag, value, page=1):
        out, at = bytearray(file), entry(page, tag)
        out[at : at + 4] = value.to_bytes(4, "little")
        return bytes(out)

    broken = [changed(259, 7), changed(278, 0), changed(257, 2**32 - 1), changed(273, 2**31), changed(256, 0), changed(258, 1), changed(317, 3), changed(279, 3)]
    broken.append(bytes(bytearray(file[: entry(1, 273) - 4]) + (2**32 - 1).to_bytes(4, "little") + file[entry(1, 273) :]))
    tiled = tiff.write_tiff(pages, tiff.DEFLATE, tile=16)
    rows = [(k, b) for k, b in enumerate(broken)] + [(50, tiled)]
    got = tiff.tiff_pages(spark.createDataFrame(rows, "id int, content binary")).collect()
    for k in range(len(broken) - 1):
        mine = sorted((r for r in got if r.id == k), key=lambda r: r.page)
        assert [(r.page, r.error is None, r.pixels is None) for r in mine] == [(0, True, False), (1, False, True), (2, True, False)], k
    last = [(r.page, r.error is None) for r in got if r.id == len(broken) - 1]
    assert last == [(0, True), (None, False)]
    assert sum(r.id == 50 and r.error is None for r in got) == 3
    with pytest.raises(tiff.TiffError):
        tiff.read_tiff(broken[0])
    assert len(tiff._block(zlib.compress(bytes(10**8)), 1000, tiff.DEFLATE)) == 1000


def test_media_query(spark, sf):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    forms = set()
    for r in tiff.op3(spark, sf).collect():
        raw = docs[r.doc_id]
        p = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(p), zlib.crc32(p[-64:]))
        assert r.payload_sha256 == hashlib.sha256(p).hexdigest()
        forms.add(r.feature.split()[0])
    assert len(forms) == 16 and {f.split("/")[0] for f in forms} == {"none", "packbits", "lzw", "deflate"}
    df = spark.createDataFrame([(1, None), (2, ""), (3, "é" * 700_000)], "doc_id int, text string")
    a, b, c = sorted(tiff.media_digest(df).collect())
    assert a[2:] == b[2:] and a.payload_bytes == 64 and c.payload_bytes == -(-1_400_000 // 64) * 64 and "pages=2" in c.feature


def test_hosts_paths_and_rules(spark):
    cases = {
        None: ("", "", None), "": ("", "", None), "nothing": ("", "", None), "http://": ("", "", None),
        "HTTP://WWW.Example.COM/en/a?b#c": ("www.example.com", "/en/a", "www.example.com/en/"),
        "x://m.www.example.com/en/": ("m.www.example.com", "/en/", "www.example.com/en/"),
        "https://a.example.com/en/1": ("a.example.com", "/en/1", "example.com/en/"),
        "https://example.com/en": ("example.com", "/en", "com/"),
        "http://notexample.com?q=/en/": ("notexample.com", "", None),
        "http://b.net/es/#x": ("b.net", "/es/", "net/es/"), "http://bnet/es/": ("bnet", "/es/", None),
        "http://ÀB.net/fr/\nz://y": ("Àb.net", "/fr/\nz://y", "net/fr/"),
    }
    df = spark.createDataFrame([(u, "mine") for u in cases], "url string, host string")
    got = {r.url: r for r in url_filter.judge_urls(df, url_filter.RULES).collect()}
    for u, (host, path, rule) in cases.items():
        assert (got[u].host, got[u].path, got[u].rule) == (host, path, rule), u
        if rule:
            assert got[u].verdict == dict((b, a) for a, b in url_filter.RULES)[rule]
    assert got[None].verdict == "allow" and url_filter.judge_urls(df.limit(0), []).count() == 0


@pytest.mark.parametrize("most", [10**6, 0])
def test_many_rules_are_joined(spark, most, monkeypatch):
    import random

    rng = random.Random(2)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "xa.com", "net", "q.net", "", "z.", "com"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/es/y/z", "/es/"]
    rules = [(rng.choice(("allow", "block")), rng.choice(hosts) + rng.choice(["", *paths])) for _ in range(60)]
    rules += [("block", f"h{k}.org/p{k % 7}/") for k in range(3000)] + [rules[0], ("allow", rules[1][1])]
    urls = [f"http://{h}{p}?q" for h in [*hosts, "www.net", "d.c.b.a.com", "h7.org", "w.h8.org"] for p in [*paths, "/p0/a", "/p1/"]] + [None, "x", "http://a.com/en/"]
    df = spark.createDataFrame([(u, "mine") for u in urls], "url string, rule string")
    monkeypatch.setattr(url_filter, "MOST_BROADCAST", most)
    monkeypatch.setattr(url_filter.joined_rules, "__defaults__", (most,))
    key = lambda r: (r.url or "", r.rule or "", r.verdict, r.host, r.path)
    small = [r for r in rules if not r[1].startswith("h") or r[1].startswith(("h7.", "h8."))]
    assert sorted(map(key, url_filter.judge_urls(df, rules).collect())) == sorted(map(key, url_filter.judge_urls(df, small, in_plan=10**6).collect()))
    table = spark.createDataFrame([("block", "a.com/"), ("allow", "b.a.com/en"), ("allow", "a.com/")], "verdict string, rule string")
    got = {r.url: (r.rule, r.verdict) for r in url_filter.judge_urls(df, table).collect()}
    assert got["http://a.com/en?q"] == ("a.com/", "allow") and got["http://c.b.a.com/en/?q"] == ("b.a.com/en", "allow") and got[None][0] is None
    assert url_filter.judge_urls(df.limit(0), table).count() == 0 and url_filter.judge_urls(df, table.limit(0)).count() == len(urls)


def test_urls_without_a_host_get_the_methods_verdict(spark):
    df = spark.createDataFrame([(None,), ("x",)], "url string")
    bad = [("", "", 1)] * 50 + [("ok.org", "/a", 0)] * 50
    assert {r.verdict for r in url_filter.judge_urls(df, [], bad).collect()} == {"block"}


def brute_score(m, host, path):
    """The regression by plain integers, one n-gram at a time."""
    top = (1 << 64) - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & top
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & top
        return x ^ x >> 31

    total = 0.0
    for salt, text in ((1, host), (2, path)):
        raw, hashes = f"^{text}$".encode(), []
        for n in url_filter.SIZES:
            for k in range(len(raw) - n + 1):
                h = 0
                for c in raw[k : k + n]:
                    h = (h * 0x9E3779B97F4A7C55 + c + 1) & top
                hashes.append(mix((mix((h + n * 0x9E3779B97F4A7C15) & top) + salt * 0x9E3779B97F4A7C15) & top))
        total += sum(float(m.w[h >> 64 - url_filter.BITS]) for h in hashes) / np.sqrt(2 * max(1, len(hashes)))
    return 1 / (1 + np.exp(-total - m.b))


def test_regression_separates_and_equals_brute_force():
    rows = url_filter.labelled_urls()
    train, test = rows[::2], rows[1::2]
    m = url_filter.UrlModel(train)
    s = m.score([r[0] for r in test], [r[1] for r in test])
    assert np.mean((s >= 0.5) == [bool(r[2]) for r in test]) > 0.85
    for (h, p, _), got in list(zip(test, s))[:60]:
        assert abs(brute_score(m, h, p) - got) < 1e-9
    assert m.score([""], [""])[0] < 0.5


def page(body):
    return html_text.Page(body).text()


def test_main_text():
    assert page("") == "" and page("plain &amp; text\n here") == "plain & text here"
    assert page("<nav>a</nav><div class='ad'>b</div><article><h1>T</h1><p><b>x<br>y<p>z <i>q</i>r</article><footer>f") == "T x y z qr"
    assert page("<p>a<script>if (1<2) '</p>'</script>b<style>p{}</style><!-- c -->d</p>") == "abd"
    assert page("<main><p>a</p><form><input>b</form><section class='comments'><p>c</p></section></main>") == "a"
    assert page("<div id=sidebar>a</div><div role=navigation>b</div><div class='cookie-notice'>c</div><p>d") == "d"
    assert page("<article class='has-comments'><header><h1>t</h1></header>u</article><article class='comment'>v</article>") == "t u"
    assert page("<ul><li>1<li>2</ul><table><tr><td>3<td>4</table><p>5 < 6 &lt;b&gt; <a title='>'>7</a>") == "1 2 3 4 5 < 6 <b> 7"
    assert page("<p>a<![CDATA[<b>]]></p><br/>b<unknown>c</unknown><title>t") == "a<b> b c"
    assert page("<div " + "x" * 10000) == "<div " + "x" * 10000


def test_broken_pages_take_no_longer():
    import time

    began = time.time()
    assert page("<div " + 'a="b" ' * 3000).startswith("<div a=")
    assert page("<a" * 30000).startswith("<a<a") and page("<p title='x>y") == "y"
    assert page('<p a="b>c</p>d<p e="f">g') != "" and page("<b>" * 5000 + "x" + "</p>" * 5000) == "x"
    assert len(page("<div><span>w</span> " * 3000).split()) == 3000
    assert html_text.Page("<div>x<i>y</i></div>" * 2000).candidates("h")
    assert time.time() - began < 20
    n = 8000
    for deep in ("<b>" * n + "<h2>x</h2>" * n, "<div>" * n + "</i>" * n + "x", "<div>" * n + "x", "<p><div>" + "<b>" * n + "<h2>x</h2>" * n, "<td><b>" * n + "<tr>x" * n):
        took = {}
        for part in (2, 1):
            cut = deep if part == 1 else deep[: len(deep) // 2]
            began = time.time()
            p = html_text.Page(cut)
            p.candidates("h"), p.text()
            took[part] = time.time() - began
        assert took[1] < 3, deep[:9]


def test_templates_are_removed_either_way(spark):
    rows = []
    for k in range(12):
        rows.append((k, "http://h.org/%d" % k, f"<div><div>Top of site</div><div><p>Story {k}</p><p>Own words {k}.</p></div><div>Bottom &copy;</div></div>"))
        rows.append((100 + k, "http://i.org/%d" % k, "<div>Top of site</div><div><p>One story on many pages</p></div>"))
        rows.append((200 + k, "http://j.org/%d" % k, "<div>x%d</div><article><p>Shared passage</p><p>%d</p></article>" % (k % 2, k)))
    rows += [(300, None, None), (301, "http://h.org/", ""), (302, "http://k.org/1", "<div>Top of site</div>"), (0, "http://h.org/0", rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {k: f"Story {k} Own words {k}." for k in range(12)} | {100 + k: "Top of site One story on many pages" for k in range(12)}
    want |= {200 + k: f"Shared passage {k}" for k in range(12)} | {300: "", 301: "", 302: "Top of site"}
    for most in (1000, 0):
        got = html_text.extract_text(df, most_broadcast=most)
        assert got.count() == len(rows) and {r.page_id: r.text for r in got.collect()} == want
        assert html_text.extract_text(df.limit(0), most_broadcast=most).count() == 0


def test_templates_of_hosts_with_many_copies(spark):
    rows = [(k, "http://h.org/%d" % k, f"<div>Top of site</div><div><p>Story {k % 15}</p></div>") for k in range(10_000)]
    rows += [(20_000 + k, "http://i.org/%d" % k, f"{'<div>Top of site</div>' if k < 6 else ''}<div><p>Page {k}</p></div>") for k in range(4000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_text(df).collect()}
    assert got == {k: f"Story {k % 15}" for k in range(10_000)} | {20_000 + k: f"Page {k}" for k in range(4000)}


def test_blocks_that_a_site_repeats_inside_its_articles(spark):
    box, rare = "<div><p>Read us <b>daily</b></p><ul><li>One<li>Two</ul></div>", "<p>A passage that some share</p>"
    body = lambda k: f"<h1>T {k}</h1><p>Own words {k}.</p>{rare if k % 3 == 0 else ''}<ul><li>Salt<li>Nr {k}</ul>{box}"
    rows = [(k, "http://h.org/%d" % k, f"<nav>m</nav><article>{body(k)}</article>") for k in range(24)]
    rows += [(100 + k, "http://i.org/%d" % k, f"<div role='main'>{body(k)}</div>") for k in range(24)]
    rows += [(200 + k, "http://j.org/%d" % k, "<article><p>One article on many pages</p></article>") for k in range(24)]
    rows += [(300, "http://h.org/box", f"<main>{box}</main>")]
    text = lambda k: f"T {k} Own words {k}.{' A passage that some share' if k % 3 == 0 else ''} Salt Nr {k}"
    want = {k: text(k) for k in range(24)} | {100 + k: text(k) for k in range(24)} | {200 + k: "One article on many pages" for k in range(24)} | {300: "Read us daily One Two"}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (1000, 0):
        assert {r.page_id: r.text for r in html_text.extract_text(df, most_broadcast=most).collect()} == want


def test_ids_and_data_delete_nothing_in_an_article():
    kept = "<h2 id='Related'>Related work</h2><section id='share-prices'>Prices</section><p data-id='ad' data-class='ad'>Data</p>"
    assert page(f"<article>{kept}<p class='ad'>x</p></article>") == "Related work Prices Data"
    assert page("<p data-id='ad'>y</p><div id='ad'>z</div>") == "y"


def test_counts_decide_on_pages_with_an_article(spark):
    """Furniture with nothing that marks it, its text another on every page, before and after an article."""
    links = lambda k: "".join(f"<li><a href=x>L{k}{j}</a>" for j in range(3 + k % 3))
    body = lambda k: f"<h1>T {k}</h1><p>Words of {k}.</p><p>Passage</p>"
    rows = [(k, "http://h.org/%d" % k, f"<div class=a><ul>{links(k)}</ul></div><article>{body(k)}</article><div class=b>Made by {k}</div>{'<p>Only here</p>' if k == 3 else ''}") for k in range(8)]
    rows += [(100 + k, "http://i.org/%d" % k, f"<div>Alone {k}</div><article>{body(k)}</article>") for k in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {k: f"T {k} Words of {k}. Passage" + " Only here" * (k == 3) for k in range(8)} | {100 + k: f"T {k} Words of {k}. Passage" for k in range(3)}
    for most in (1000, 0):
        assert {r.page_id: r.text for r in html_text.extract_text(df, most_broadcast=most).collect()} == want
    plain = {r.page_id: r.text for r in html_text.extract_text(df, marks=False).collect()}
    assert plain == {k: f"Alone {k - 100} {v}" if k >= 100 else v for k, v in want.items()}
    off = {r.page_id: r.text for r in html_text.extract_text(df, marks=False, min_pages=10**9).collect()}
    assert all(off[k] != want[k] for k in want)


def test_counts_alone_on_whole_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html")
    full, counted, off = ({r.page_id: r.text for r in html_text.extract_text(pages, **how).select("page_id", "text").collect()} for how in ({}, {"marks": False}, {"marks": False, "min_pages": 10**9}))
    share = sum(counted[k] == full[k] for k in full) / len(full)
    print("counts alone give the whole result on", share)
    assert share > 0.95 and not any(off[k] == full[k] for k in full)


def test_html_query(spark, sf):
    import html

    for r, p in zip(html_text.op10(spark, sf).orderBy("page_id").collect(), spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id").collect()):
        inner = re.search(r"<article>(.*?)(</article>|$)", p.html, re.S).group(1)
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split()) and r.n_chars == len(r.text)
