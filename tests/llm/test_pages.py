"""WARC archives and main texts."""

import hashlib
import re
from html import unescape

import pytest
import zstandard

from quillspark.llm import htmltext, warc
from quillspark.sources.tables import table

LONG = "<p>" + "word " * 40 + "</p>"
ROWS = [(1, "http://a.example/x y\r\nz", LONG), (2, None, LONG), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "http://é.example/", "é" * 50), (8, "u", "é" * 50), (9, "u", LONG + "x" * 300_000), (10, "u", "\r\n\r\n" * 60)]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, payload string")


def test_archives_round_trip(spark, sf):
    rows = ROWS + [(1000 + r.page_id, r.url, r.html) for r in table(spark, sf, "pages").collect()]
    got = {r.page_id: r for r in warc.read(warc.write(pages(spark, rows))).collect()}
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        first.setdefault(h, i)
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 100 and first[h] != i
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", first[h]) if again else ("response", None))
        assert r.payload is None if again else bytes(r.payload) == data


def test_archives_stand_alone(spark, sf, tmp_path):
    docs = table(spark, sf, "pages")
    paths = warc.export(warc.write(docs), str(tmp_path))
    n = 0
    for p in paths:
        data = open(p, "rb").read()
        assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
        size = int.from_bytes(data[4:8], "little")
        dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        with pytest.raises(zstandard.ZstdError):  # records do need the dictionary
            zstandard.ZstdDecompressor().decompressobj().decompress(data[8 + size :])
        head = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj().decompress(data[8 + size :])
        assert head.startswith(b"WARC/1.1\r\n")
        n += sum(1 for _ in warc.read_archive(data))
    assert n == docs.count()


def test_broken_archives_are_refused():
    record = warc.write_record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest())
    assert warc.read_record(record).payload == b"payload"
    with pytest.raises(ValueError):
        warc.read_record(record.replace(b"payload\r\n\r\n", b"paylobd\r\n\r\n"))
    with pytest.raises(ValueError):
        warc.read_record(record[:-3])
    frame = zstandard.ZstdCompressor().compress(record)
    assert [r.page_id for r in warc.read_archive(frame + frame)] == [1, 1]
    with pytest.raises(ValueError):
        list(warc.read_archive(frame[:-2]))


def test_no_pages(spark):
    assert warc.read(warc.write(pages(spark).limit(0))).count() == 0
    assert htmltext.main_texts(pages(spark).limit(0)).count() == 0


def test_articles_of_the_pages_table(spark, sf):
    got = {r.page_id: r for r in htmltext.main_texts(table(spark, sf, "pages")).collect()}
    for r in table(spark, sf, "pages").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = " ".join(unescape(re.sub(r"<[^>]*>", " ", article.replace("<b>", ""))).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (want, len(want))


CASES = [
    ("<div class='cookie-notice'>c</div><main><h1>A&amp;B &lt;c&gt;</h1><p>one <b>two</b>three<br>four<aside>s</aside><p>five<ul><li>a<li>b</ul><form>f</form><div id='comments'>z</div></main>", "A&B <c> one twothree four five a b"),
    ("plain &amp; simple", "plain & simple"),
    ("<p>a < b and <i>c</i>", "a < b and c"),
    ("<body><script>var x = '<p>no</p>';</script><style>p{}</style><p>yes</p><noscript>no</noscript>", "yes"),
    ("<article><header>h</header><p>t</p><footer>f</footer></article><article><p>u</p></article><p>outside</p>", "t u"),
    ("<article><p>x</p><!-- <p>y</p> --></article>", "x"),
    ("<article><p>x<script>never closed", "x"),
    ("<div role='navigation'>n</div><div class='navBar'>m</div><p hidden>h</p><p>k</p>", "k"),
    ("<p>no break&nbsp;here \t\n there</p>", "no break here there"),
    ("</p></div>stray", "stray"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ("<p title='a>b'>q</p>", "q"),
    (None, ""),
    ("", ""),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_main_text(html, text):
    assert htmltext.main_text(html) == text


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_templates_of_a_host_go(spark, broadcast, monkeypatch):
    monkeypatch.setattr(htmltext, "BROADCAST_HASHES", broadcast)
    box = "<div><b>Read our app</b><p>today</p></div>"
    rows = [(i, f"https://h.example/{i}", f"{box}<div><p>text {i} here</p><p>and said again</p></div><div>{i % 9} end</div>") for i in range(40)]
    rows += [(100 + i, f"https://other{i}.example/", f"{box}<p>alone {i}</p>") for i in range(6)]
    rows += [(200 + i, "https://art.example/", f"<article><p>said again</p><div class='x'><p>box</p></div><p>n {i}</p></article>") for i in range(20)]
    got = {r.page_id: r.text for r in htmltext.main_texts(pages(spark, rows)).collect()}
    assert all("app" not in got[i] and f"text {i} here" in got[i] for i in range(40))
    assert all(got[100 + i] == f"Read our app today alone {i}" for i in range(6))
    assert all(got[200 + i] == f"said again n {i}" for i in range(20))


NAMED = [
    ("<div class='layout has-sidebar'><article><p>a</p></article></div>", "a"),
    ("<body><div class='overflow-hidden'><p>b</p></div>", "b"),
    ("<div class='content-with-sidebar'><p>c</p></div>", "c"),
    ("<body><div class='search-page'><article>d</article></div>", "d"),
    ("<article><h1 class='post-header'>title</h1><h2 class='header'>under</h2><p>e</p></article>", "title under e"),
    ("<div class='search'><div class='sidebar'>s</div><article>f</article></div><p>outside</p>", "f"),
    ("<form id='page'><main><p>g</p></main></form>", "g"),
    ("<main><p>h</p><div class='widget'><article>i</article></div></main>", "h i"),
    ("<div class='sidebar'><article>teaser</article></div><article>j</article>", "j"),
    ("<p>k</p><div class='comments'><article>reader</article></div>", "k"),
    ("<article><p>l</p><div class='Comments'><article>reader</article></div><div class='x share'>s</div></article>", "l"),
    ("<div class='sidebar' role='main'>m</div>", "m"),
]


@pytest.mark.parametrize(("html", "text"), NAMED)
def test_names_of_parts(html, text):
    assert htmltext.main_text(html) == text


def test_words_within_names_are_hints(spark):
    rows = [(i, "https://h.example/", f"<article><p>n {i}</p><p class='share-line'>Share it</p><p>Said again</p></article>") for i in range(8)]
    rows += [(100, "https://alone.example/", rows[0][2])]
    got = {r.page_id: r.text for r in htmltext.main_texts(pages(spark, rows)).collect()}
    assert got == {i: f"n {i} Said again" for i in range(8)} | {100: "n 0 Share it Said again"}


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_templates_of_sections_of_a_large_host_go(spark, broadcast, monkeypatch):
    monkeypatch.setattr(htmltext, "BROADCAST_HASHES", broadcast)
    rows = [(i, f"https://big.example/{i}", f"<div><b>Menu of section {i % 30}</b></div><div>{'Notice of the few' if i % 600 == 1 else 'My own'} {'' if i % 600 == 1 else i}</div><p>text {i}</p>") for i in range(3000)]
    rows += [(9000 + i, "https://small.example/", f"<div>Seldom</div><p>text {i}</p>") for i in range(4)]
    got = {r.page_id: r.text for r in htmltext.main_texts(pages(spark, rows)).collect()}
    assert got == {i: f"text {i}" if i % 600 == 1 else f"My own {i} text {i}" for i in range(3000)} | {9000 + i: f"Seldom text {i}" for i in range(4)}


def test_copies_of_a_page_are_no_template(spark):
    same, bare = "<article><h1>T</h1><div class='body'><p>Hello world same.</p></div></article>", "<div><p>Hello bare same.</p></div>"
    rows = [(i, "https://copies.example/", f"<script>track({i})</script>{same}") for i in range(6)] + [(10 + i, "https://bare.example/", f"<nav>{i}</nav>{bare}") for i in range(6)]
    got = {r.page_id: r.text for r in htmltext.main_texts(pages(spark, rows)).collect()}
    assert got == {i: "T Hello world same." for i in range(6)} | {10 + i: "Hello bare same." for i in range(6)}


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_counting_alone_cleans_pages_without_article(spark, broadcast, monkeypatch):
    monkeypatch.setattr(htmltext, "BROADCAST_HASHES", broadcast)
    html = lambda i: f"<div><span>Home</span> <span>About us</span></div><table><tr><td>Prices of today</td></tr></table><div><h1>Title {i}</h1><p>Body {i}.</p></div><p>All rights ours.</p>"
    rows = [(i, "https://plain.example/", html(i)) for i in range(7)]
    got = {r.page_id: (r.text, r.n_templates) for r in htmltext.main_texts(pages(spark, rows)).collect()}
    assert {i: t for i, (t, _) in got.items()} == {i: f"Title {i} Body {i}." for i in range(7)}
    assert all(n >= 3 for _, n in got.values())
    off = {r.page_id: r.text for r in htmltext.main_texts(pages(spark, rows), min_pages=8).collect()}
    assert all("Home" in t and "Prices" in t and "rights" in t for t in off.values())


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_names_count_where_their_slot_recurs(spark, broadcast, monkeypatch):
    monkeypatch.setattr(htmltext, "BROADCAST_HASHES", broadcast)
    rows = [(i, "https://many.example/", f"<div class='sidebar'>aside {i}</div><p>text {i}</p>") for i in range(6)]
    rows += [(6, "https://many.example/", "<div class='notice'>gone on one</div><p>text 6</p>"), (7, "https://few.example/", "<div class='notice'>gone on the other</div><p>text 7</p>")]
    rows += [(8, "https://many.example/", "<div role='navigation'>n</div><div class='comments'>c</div><p>text 8</p>")]
    rows += [(9, "https://many.example/", "<div class='banner'>the author's own</div><p>text 9</p>"), (10, "https://few.example/", "<div class='promo'>the author's own</div><p>text 10</p>")]
    got = {r.page_id: r.text for r in htmltext.main_texts(pages(spark, rows)).collect()}
    assert got == {i: f"text {i}" for i in range(9)} | {i: f"the author's own text {i}" for i in (9, 10)}


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_recurring_blocks_inside_articles_go_by_counting(spark, broadcast, monkeypatch):
    monkeypatch.setattr(htmltext, "BROADCAST_HASHES", broadcast)
    html = lambda i: f"<article><h1>T {i}</h1><p>One {i}.</p><div><p>Read our other stories</p></div><p>As ever.</p><table><tr><td>Rates {i}</td></tr></table></article>"
    rows = [(i, "https://news.example/", html(i)) for i in range(9)]
    texts = lambda **options: {r.page_id: r.text for r in htmltext.main_texts(pages(spark, rows), **options).collect()}
    assert texts() == {i: f"T {i} One {i}. As ever. Rates {i}" for i in range(9)}
    assert texts(min_pages=10**9) == {i: f"T {i} One {i}. Read our other stories As ever. Rates {i}" for i in range(9)}


BROKEN = ["<a ", "<a '", '<a title="x>', "<!", "<!--", "</", "<div>", "<article>", "</span>", "<p>", "<li>", "<td>", "<b><p>", "<dt><div>", "<script>", "<form><li>", "<div class='ad'>", "a>", "&amp;"]


@pytest.mark.parametrize("part", BROKEN)
def test_broken_pages_take_time_in_proportion(part):
    import time

    def seconds(n):
        html = part * (n // len(part))
        began = time.process_time()
        htmltext.cleaned(html + "</span>" * (n // 100), [0])
        return time.process_time() - began

    seconds(50_000)
    assert min(seconds(400_000) for _ in range(2)) < 4 * min(seconds(200_000) for _ in range(3)) + 0.1


def test_elements_end_as_they_did():
    tree = lambda node: node if isinstance(node, str) else [node.tag, *map(tree, node.kids)]
    show = lambda html: tree(htmltext.parse(html))[1:]
    assert show("<p>a<b>b<div>c</div>d") == [["p", "a", ["b", "b"]], ["div", "c"], "d"]
    assert show("<ul><li>a<div>b<li>c<ul><li>d</ul>e</ul>f") == [["ul", ["li", "a", ["div", "b"]], ["li", "c", ["ul", ["li", "d"]], "e"]], "f"]
    assert show("<dl><dt>a<dd>b<dt>c</dl>") == [["dl", ["dt", "a"], ["dd", "b"], ["dt", "c"]]]
    assert show("<table><tr><td>a<table><tr><td>b</table>c<td>d<tr><th>e</table>") == [["table", ["tr", ["td", "a", ["table", ["tr", ["td", "b"]]], "c"], ["td", "d"]], ["tr", ["th", "e"]]]]
    assert show("<p>a<section>b<p>c<object><p>d</object>e") == [["p", "a"], ["section", "b", ["p", "c", ["object", ["p", "d"]], "e"]]]
    assert show("<a title='x>y'>t</a><i x=\"q>z</i> w") == [["a", "t"], ["i", "z"], " w"]
    assert show("a <3 b < c <! d> e<!-- f > g --> h <!--> i <?x?>j") == ["a <3 b < c ", " e", " h ", " i ", "j"]
    assert show("<b>x</b") == [["b", "x</b"]]


def test_templates_are_found_in_the_pages_table(spark, sf):
    docs = table(spark, f"{sf.rsplit('/', 1)[0]}/sf0.1", "pages")
    assert htmltext.main_texts(docs).filter("n_templates > 0").count() > 100
    assert htmltext.main_texts(docs, min_pages=10**9, slot_pages=10**9).filter("n_templates > 0").count() == 0


def test_archives_begin_with_what_they_are(spark):
    archives = warc.write(pages(spark)).collect()
    for r in archives:
        data = bytes(r.warc)
        at, options = 0, {}
        if int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC:
            at = 8 + int.from_bytes(data[4:8], "little")
            options = {"dict_data": zstandard.ZstdCompressionDict(data[8:at])}
        first = warc.read_record(zstandard.ZstdDecompressor(**options).decompressobj().decompress(data[at:]))
        assert first.kind == "warcinfo" and f"filename: {r.archive}.warc.zst".encode() in first.payload
    assert sum(1 for r in archives for _ in warc.read_archive(bytes(r.warc))) == len(ROWS)
