"""Main text of web pages by removal of site templates.

A page is read into a tree of elements. The hash of an element's subtree stands for its markup and text; Spark
counts on how many different pages of a host each subtree occurs, and subtrees that recur on MIN_PAGES pages are
deleted as template wherever they stand on the page, however many pages the host has: a section's menu on a large host goes as it would
on a host of its own. Pages of equal text are one page, so copies of an article don't make it a template. What remains of the
article, less what HTML itself defines to be none (nav, footer, aside, form, script and the like, landmark roles, hidden elements), is the text.

Elements named as parts of a page (a whole class or id such as sidebar, not has-sidebar) have content of their own on every page, so their subtrees
needn't recur, but their place does: the hash of tag and name, the slot, is counted as well, over the pages of all hosts, since names of parts are shared between
sites. A name counts only if SLOT_PAGES different pages have the slot, whatever the host's size. Reader comments go by name.

The article is the part below the page's article or main element (or the element of that role) if there is one,
else the body. It is looked for outside elements with the name of a part first, then below them; an element that holds an article or main
element never goes by its name, unless it is named as reader comments (which many sites mark up as articles). A paragraph or heading inside such
an article is the author's, even if other pages repeat it; there only whole containers, lists and tables can be template, and what has
a part's word within a name (share-line). Without such an element, paragraphs are counted like everything else.

Two passes read each page: the first yields the hosts' hashes, counted by combined aggregations over (host, hash, page text), so a host with
a third of all pages is no hot task; the second deletes. While all templates are few (they are counted first), every task of the second pass gets
them once; else each page's own hashes are joined with them, so no row or task holds all templates of a host, and pages with their own by a
hash of the page.

Defined cases: null or empty html and pages without text give an empty text; broken markup is read as far as it goes: end tags
without start are ignored, elements left open end with their parent, a < that starts no tag is text; a null url or one
without a host belongs to host ''; equal pages give equal text; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .common import map_batches

#: Different pages of a host from which on a subtree is template, and from which on a named slot is the site's.
MIN_PAGES, SLOT_PAGES = 5, 2
#: Templates are broadcast up to so many hashes in all.
BROADCAST_HASHES = 500_000
#: Elements that never hold article text, whatever they contain.
DROPPED = frozenset("nav header footer aside form script style noscript template iframe object embed svg math canvas audio video button select option datalist textarea input label fieldset dialog menu head title map applet".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a line; all others begin and end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold running text; in an article they are never template.
RUNNING = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr thead tbody tfoot caption blockquote pre figcaption br address".split())
#: Start tags before which an open p ends, as HTML has it.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: Headings go neither by name nor for a word within one.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Roles that HTML defines for what is no article text.
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar alert alertdialog dialog form".split())
#: Names (a whole class or id) that tell an element's part on the page, if its slot recurs; as a word within a longer name they are a hint only.
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot adbox banner sponsor sponsored sponsors promo promos promotion promoted outbrain taboola "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager toc "
    "header masthead topbar footer bottombar sidebar sidebars aside rail widget widgets "
    "cookie cookies consent gdpr notice notices alert popup modal overlay paywall newsletter subscribe subscription signup login toolbar "
    "comment comments commentlist disqus respond replies discussion "
    "share sharing social related recommended recommendations trending contentinfo complementary search hidden".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond replies discussion".split())
#: Node.part: none, by name or a form, reader comments by name, by element or hidden.
NAMED, COMMENTED, CLOSED = 1, 2, 3
#: A tag whose attributes may have > in quotes, and one as it is read once a quote was left open.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>").match
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)([^<>]*+)>").match
#: Start tags that end an open element: which they end, and inside which elements at most.
SIBLINGS = (
    (frozenset(["p"]), None),  # ended by ENDS_P, through elements of a line only
    (frozenset(["li"]), frozenset("ul ol menu".split())),
    (frozenset("dt dd".split()), frozenset(["dl"])),
    (frozenset(["option"]), frozenset("select datalist".split())),
    (frozenset(["tr"]), frozenset(["table"])),
    (frozenset("td th".split()), frozenset(["table"])),
)
GROUP = {tag: i for i, (same, _) in enumerate(SIBLINGS) for tag in same}
STOPS = {tag: [i for i, (_, stop) in enumerate(SIBLINGS) if stop and tag in stop] for _, stop in SIBLINGS if stop for tag in stop}
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I).search for tag in RAW}
NAMES = re.compile(r"\b(class|id|role|itemprop|aria-hidden|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.I)
SPLIT = re.compile(r"[^a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


class Node:
    """kids: nodes and text in page order. part: it is no article text by its name or role. hint: a name has a part's word.
    slot: hash of tag and name if its part rests on a name alone, else 0. main: 2 article, 1 main or content. holds: such an element is below it."""

    __slots__ = ("tag", "part", "main", "hint", "slot", "holds", "kids", "digest")

    def __init__(self, tag: str, part: int = 0, main: int = 0, hint: bool = False, slot: int = 0) -> None:
        self.tag, self.part, self.main, self.hint, self.slot, self.holds, self.kids, self.digest = tag, part, main, hint, slot, False, [], 0

    @property
    def dropped(self) -> bool:
        return self.part > (NAMED if self.holds else 0)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def _hash(text: str, slot: bool) -> int:
    """A signed 64-bit hash, odd for slots and even for subtrees."""
    return ((xxhash.xxh64_intdigest(text) | 2) & ~1 | slot) - (1 << 63)


#: Stands for all hosts together, where slots are counted; no host has this name.
EVERYWHERE = "/"


def _scope(host: Column, digest: Column) -> Column:
    return F.when(F.pmod(digest, F.lit(2)) == 1, EVERYWHERE).otherwise(host)


def _role(tag: str, attributes: str) -> tuple[int, int, bool, int]:
    part, main, hint, slot = NAMED if tag == "form" else CLOSED if tag in DROPPED else 0, {"article": 2, "main": 1}.get(tag, 0), False, 0
    if attributes and part < CLOSED and tag not in ("body", "html"):
        defined = part
        for name, a, b, c in NAMES.findall(attributes):
            value, name = (a or b or c).lower(), name.lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                part = defined = CLOSED
            elif name == "itemprop":
                main = max(main, 2 if value == "articlebody" else 0)
            elif name == "role":
                main = max(main, {"article": 2, "main": 1}.get(value, 0))
                if value in ROLES and tag not in HEADINGS:
                    part = defined = max(defined, NAMED)
            elif name in ("class", "id") and tag not in HEADINGS:
                if not PARTS.isdisjoint(names := value.split()):
                    part = max(part, NAMED if COMMENTS.isdisjoint(names) else COMMENTED)
                    slot = _hash(f"{tag} {name} {' '.join(sorted(PARTS.intersection(names)))}", True)
                hint = hint or not PARTS.isdisjoint(SPLIT.split(CAMEL.sub(" ", a or b or c).lower()))
        slot = slot if part == NAMED and not defined else 0
    if main and part < CLOSED:
        part, hint, slot = 0, False, 0
    return part, main, hint, slot


def _open(above: tuple[int, ...], tag: str, place: int) -> tuple[int, ...]:
    """For an element that opens at a place of the stack: where the open element of each of SIBLINGS is that a start tag inside it would end, else 0."""
    group, stops = GROUP.get(tag), STOPS.get(tag, ())
    if group is None and not stops and (tag in INLINE or not above[0]):
        return above
    out = list(above)
    if tag not in INLINE:
        out[0] = 0
    for i in stops:
        out[i] = 0
    if group is not None:
        out[group] = place
    return tuple(out)


def parse(html: str) -> Node:
    """The tree of a page, in time proportional to its length, however broken it is."""
    root = Node("#root")
    stack, open_, ends, at, text, close = [root], Counter(), [(0,) * len(SIBLINGS)], 0, 0, -1
    tag_at = TAG

    def pop_to(place: int) -> None:
        for node in stack[place:]:
            open_[node.tag] -= 1
        del stack[place:], ends[place:]

    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            m, end = None, html.find("-->", at + 4 if not html.startswith("-->", at + 2) else at + 2)
            end = len(html) if end < 0 else end + 3
        else:
            if close < at:  # the next >, looked for once
                close = html.find(">", at)
            if close < 0:
                break
            m = tag_at(html, at)
            if not m and html[at + 1 : at + 3].lstrip("/")[:1].isalpha() and tag_at is TAG:
                tag_at = PLAIN_TAG  # a quote was left open: from here on a tag ends at the first >
                m = tag_at(html, at)
            if m:
                end = m.end()
            elif html[at + 1 : at + 2] in ("!", "?"):
                end = close + 1
            else:
                at += 1
                continue
        if at > text:
            stack[-1].kids.append(html[text:at])
        text = at = end
        if not m:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_[tag]:
                place = len(stack) - 1
                while stack[place].tag != tag:
                    place -= 1
                pop_to(place)
            continue
        group = 0 if tag in ENDS_P else GROUP.get(tag)
        if group is not None and ends[-1][group]:
            pop_to(ends[-1][group])
        node = Node(tag, *_role(tag, m[3]))
        stack[-1].kids.append(node)
        if node.main:
            for above in reversed(stack):
                if above.holds:
                    break
                above.holds = True
        if tag in VOID or (m[3].endswith("/") and tag not in ("p", "div", "a", "article", "main", "section", "span", "b", "i", *RAW)):
            continue
        if tag in RAW:
            found = RAW_END[tag](html, at)
            end = found.start() if found else len(html)
            node.kids.append(html[at:end])
            text = at = found.end() if found else end
            continue
        ends.append(_open(ends[-1], tag, len(stack)))
        stack.append(node)
        open_[tag] += 1
    if text < len(html):
        stack[-1].kids.append(html[text:])
    return root


def main_of(root: Node) -> tuple[list[Node], bool]:
    """The outermost article elements, else main elements, outside named parts, else below them, else the page; and whether such an element was found."""
    for below, least in ((0, 2), (0, 1), (NAMED, 2), (NAMED, 1)):
        found, open_ = [], [root]
        while open_:
            node = open_.pop()
            if node.part > below:
                continue
            if node.main >= least:
                found.append(node)
            else:
                open_ += [k for k in reversed(node.kids) if not isinstance(k, str)]
        if found:
            return found, True
        if not root.holds:
            break
    return [root], False


def elements(root: Node) -> Iterator[Node]:
    """All elements, parents first. No recursion, however deep the page."""
    open_ = [root]
    while open_:
        node = open_.pop()
        yield node
        open_ += [k for k in node.kids if not isinstance(k, str)]


def digests(root: Node) -> None:
    """Sets the subtree hash of every element: tags and text in order, white space aside."""
    for node in reversed(list(elements(root))):
        parts = [node.tag, *(" ".join(k.split()) if isinstance(k, str) else f"<{k.digest:x}>" for k in node.kids)]
        node.digest = _hash("\0".join(p for p in parts if p), False)


def candidates(root: Node) -> Iterator[Node]:
    """Elements of the whole page that are deleted if they turn out to be template; inside an article those that aren't running text."""
    open_ = [(root, False)]
    while open_:
        node, inside = open_.pop()
        for k in node.kids:
            if isinstance(k, str) or k.tag in VOID or k.tag in RAW:
                continue
            if not (k.main or k.holds or k.tag in ("html", "body", "head")) and (k.hint or not (k.tag in INLINE or (inside and k.tag in RUNNING))):
                yield k
            if k.part < CLOSED:
                open_.append((k, inside or k.main > 0))


def extract(nodes: list[Node], gone: set[int]) -> str:
    """Text of the nodes less dropped parts and those whose id() is in gone, blocks joined by one space."""
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        if text := " ".join(unescape("".join(line)).split()):
            blocks.append(text)
        line.clear()

    for top in nodes:
        open_: list[object] = [top]
        while open_:
            x = open_.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                line.append(x)
            elif not x.dropped and not (gone and id(x) in gone):
                if x.tag not in INLINE:
                    end()
                    open_.append(None)
                open_ += reversed(x.kids)
        end()
    return " ".join(blocks)


def _seen(html: str | None) -> tuple[Node, list[Node]]:
    """A page's tree with digests, and its candidates."""
    root = parse(html or "")
    digests(root)
    return root, list(candidates(root))


def subtrees(html: str | None) -> tuple[int, list[int]]:
    """A hash of the page's text as it is without templates, and the distinct hashes of its candidate subtrees and named slots."""
    root, found = _seen(html)
    text = extract(main_of(root)[0], set())
    return _hash(text, False), sorted({*(k.digest for k in found), *(k.slot for k in elements(root) if k.slot)})


def cleaned(html: str | None, *template: object) -> tuple[str, int]:
    """The page's main text, given the hashes that recur (sorted arrays, or any lists), and how many elements went as template.

    Without any, the page stands alone: nothing was counted, and names count by themselves.
    """
    known = [t if isinstance(t, np.ndarray) else np.array(sorted(t), np.int64) for t in template]
    known = [t for t in known if len(t)]

    def recurs(own: list[int]) -> np.ndarray:
        h, out = np.array(own, np.int64), np.zeros(len(own), bool)
        for t in known:
            out |= t[np.minimum(np.searchsorted(t, h), len(t) - 1)] == h
        return out

    root = parse(html or "")
    named = [k for k in elements(root) if k.slot] if template else []
    for k, shared in zip(named, recurs([k.slot for k in named]), strict=True):
        if not shared:
            k.part = 0
    gone: set[int] = set()
    if known:
        digests(root)
        found = list(candidates(root))
        gone = {id(k) for k, same in zip(found, recurs([k.digest for k in found]), strict=True) if same}
    return extract(main_of(root)[0], gone), len(gone)


def main_text(html: str | None, *template: object) -> str:
    return cleaned(html, *template)[0]


def hashes(pages: DataFrame) -> DataFrame:
    """host, page (a hash of its html), text (of its text), digest: the hashes of each row of pages (host, page, html), once each."""

    def row(host: str, page: str | None, html: str | None) -> Iterator[tuple]:
        text, found = subtrees(html)
        for d in found:
            yield host, page, text, d

    return map_batches(pages.select("host", "page", "html"), "host string, page string, text bigint, digest bigint", lambda: row)


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, slot_pages: int = SLOT_PAGES) -> DataFrame:
    """host, digest: subtrees that recur on min_pages different pages of their host, and slots that do on slot_pages of all hosts (host EVERYWHERE)."""
    rows = pages.select(host_of(F.col("url").cast("string")).alias("host"), F.lit(None).cast("string").alias("page"), F.col("html").cast("string"))
    counted = hashes(rows).groupBy(_scope(F.col("host"), F.col("digest")).alias("host"), "digest").agg(F.countDistinct("text").alias("n"))
    return counted.filter(F.col("n") >= F.when(F.pmod("digest", F.lit(2)) == 1, slot_pages).otherwise(min_pages)).select("host", "digest")


def main_texts(pages: DataFrame, **options: int) -> DataFrame:
    """page_id, url, text, n_chars, n_templates (elements deleted as template) of each row of pages."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    known = stored(templates(pages, **options), "templates")
    schema, size = "page_id bigint, url string, text string, n_chars bigint, n_templates int", lambda r: 64 + len(r[2])
    if known.count() <= BROADCAST_HASHES:
        by_host = known.groupBy("host").agg(F.array_sort(F.collect_list("digest")).alias("templates")).collect()
        shared = pages.sparkSession.sparkContext.broadcast({h: np.array(d, np.int64) for h, d in by_host})  # at most 8 bytes times BROADCAST_HASHES, and the hosts

        def look_up(page_id: int, url: str | None, html: str | None, host: str) -> Iterator[tuple]:
            text, n = cleaned(html, shared.value.get(host, ()), shared.value.get(EVERYWHERE, ()))
            yield page_id, url, text, len(text), n

        return map_batches(rows, schema, lambda: look_up, size)
    rows = rows.withColumn("page", F.md5(F.col("html").cast("binary")))
    own = hashes(rows).withColumn("scope", _scope(F.col("host"), F.col("digest"))).join(known.withColumnRenamed("host", "scope"), ["scope", "digest"]).groupBy("host", "page").agg(F.array_sort(F.collect_set("digest")).alias("templates"))

    def row(page_id: int, url: str | None, html: str | None, known: object) -> Iterator[tuple]:
        text, n = cleaned(html, () if known is None else known)
        yield page_id, url, text, len(text), n

    return map_batches(rows.join(own, ["host", "page"], "left").select("page_id", "url", "html", "templates"), schema, lambda: row, size)
