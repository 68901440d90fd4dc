"""Main text of web pages by equivalence classes of template tokens.

A token is an element with its path of elements, or a text with its path. Tokens of a host's pages that
occur equally often on each page have the same occurrence vector and form a class; a class of several
tokens on at least half of the pages is valid. The valid classes, nested by their paths, are the host's
template: what lies inside a template element and in no deeper one is that element's slot.

1. `templates` finds the valid classes of each host.
2. `slots` adds up over all pages how much text, linked text and repeated text each slot holds.
3. `choose` walks down the nested template from the root, as long as one element holds SHARE_MAIN of the
   text that is neither linked nor repeated: the element it ends at holds the main text. Slots of links in
   it are dropped, and so are texts that belong to the template themselves.
4. Each page's remaining slots are its text. What elements are for (navigation, advert, comments, article) is
   read from tags, roles and whole class names: such parts don't count as text in 3, and an article settles
   what the template leaves open, as on hosts of too few pages for one.

Vectors are never gathered: a token's vector is the XOR of a hash of (page, count), which Spark
aggregates on the map side, so a host with a third of all pages is no larger a row than another. A
host's template is on each of its pages: its tokens are each on half of the pages, so that they are at
most twice as many as a page of the host has on average. Hosts of a few pages use the template of all such
hosts together.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .url_filter import host_of

#: Pages from which a host has a template of its own; the share of them that a valid class, and a text of one, is on.
PAGES, SHARE, SHARE_TEXT = 4, 0.5, 0.8
#: Least tokens of a valid class, and the share of links from which a slot is dropped.
TOKENS, LINKS = 2, 0.6
#: Share of an element's text that an element in it must hold to be the main one instead.
SHARE_MAIN = 0.7

RAW = "script|style|noscript|template|textarea|svg|math|iframe|object|canvas|audio|video|select|button|xmp"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*>",
    re.S | re.I,
)
NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head"}}
BOUNDS = frozenset("table ul ol dl div article main section body html nav aside footer header form blockquote".split())
HEADS, PARAGRAPH, NONE = frozenset("h1 h2 h3 h4 h5 h6 pre hr".split()), frozenset(["p"]), frozenset()
ASIDE = frozenset("nav footer aside form dialog menu head title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that may hold a page's main text as a whole.
HOLDERS = frozenset("html body div section article main td tr table tbody center".split())
#: Words of class names, all of whose words are here or neutral. An article's parts go by the first set and by exact names.
NEVER_TEXT = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promos promotion cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup comment comments commentary discussion disqus replies reply respond responses share sharing social related recommended recommendations widget widgets pagination pager breadcrumb breadcrumbs alert alerts".split())
AROUND_TEXT = frozenset("nav navbar navigation menu menus sidebar sidebars aside footer foot header masthead topbar toolbar banner login notice notices copyright".split())
EXACT = frozenset("nav navbar navigation menu sidebar aside footer notice notices".split())
NEUTRAL = frozenset("site page main top bottom left right box block area section wrapper wrap container inner outer list item items bar panel unit slot form links global primary secondary".split())


def token(*parts: str) -> int:
    return int.from_bytes(blake2b("\x1f".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def is_named(called: str, words: frozenset[str]) -> bool:
    """Whether a class name consists of such words and neutral ones: sidebar and site-header do, with-sidebar and notice-period don't."""
    for name in called.lower().split():
        parts = [p for p in re.split(r"[-_]+", name) if p]
        if any(p in words for p in parts) and all(p in words or p in NEUTRAL or p in NEVER_TEXT or p in AROUND_TEXT for p in parts):
            return True
    return False


class Element:
    """An open element with its path; alike ones of all pages are one object, found from their parent."""

    __slots__ = ("tag", "up", "path", "never", "around", "main", "sig", "inner")

    def __init__(self, tag: str, up: Element | None, names: dict[str, str]) -> None:
        self.tag, self.up = tag, up
        inside = bool(up and up.main)
        role = names.get("role", "")
        own = tag in ("article", "main") or role in ("main", "article") or names.get("itemprop", "").lower() == "articlebody"
        self.main = inside or own
        called = "" if tag in ("html", "body") else f"{names.get('class', '')} {names.get('id', '')}"
        exact = inside and any(c in EXACT for c in called.lower().split())
        self.never = bool(up and up.never) or tag in ASIDE or (tag == "header" and not inside) or role in ROLES or "hidden" in names or names.get("aria-hidden") == "true" or exact or is_named(called, NEVER_TEXT)
        # an article inside a wrapper with such a name is none the less an article
        self.around = not self.main and (bool(up and up.around) or is_named(called, AROUND_TEXT))
        label = tag + "".join(f".{w}" for w in names.get("class", "").split()) + (f"#{names['id']}" if names.get("id") and not re.search(r"\d", names["id"]) else "")
        self.path = (up.path + "/" if up else "") + label + "!" * self.aside + "*" * own
        self.sig = token("e", self.path)
        self.inner: dict[tuple[str, str], Element] = {}

    @property
    def aside(self) -> bool:
        return self.never or self.around

    def child(self, tag: str, attrs: str) -> Element:
        got = self.inner.get((tag, attrs))
        if got is None:
            if len(self.inner) >= 2000:
                self.inner.clear()
            names = {a.lower(): b or c or d or "" for a, b, c, d in NAMES.findall(attrs)}
            got = self.inner[tag, attrs] = Element(tag, self, names)
        return got


ROOT = Element("#", None, {})


class Block:
    __slots__ = ("at", "text", "links")

    def __init__(self, at: Element, text: str, links: int) -> None:
        self.at, self.text, self.links = at, text, links

    @property
    def sig(self) -> int:
        return token("t", self.at.path, self.text)


def parse(page: str) -> tuple[list[Element], list[Block]]:
    """All elements that aren't inline, and all texts between them, in order."""
    stack, elements, blocks = [ROOT], [], []
    parts: list[str] = []
    links, anchor, end = 0, False, 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(stack[-1], text, links))
            parts.clear()
        links = 0

    def say(text: str) -> None:
        nonlocal links
        if text:
            parts.append(text)
            if anchor:
                links += len(text)

    for m in TOKEN.finditer(page):
        say(page[end : m.start()])
        end = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        closing = m["end"] or m["end2"]
        if tag == "a":
            anchor = not closing
        elif tag == "br":
            parts.append(" ")
        elif tag in INLINE or tag in VOID - {"hr"}:
            continue
        elif closing:
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            anchor = False
        else:
            flush()
            shut = CLOSES.get(tag) or (PARAGRAPH if tag in BOUNDS or tag in HEADS else NONE)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in shut:
                    del stack[k:]
                elif stack[k].tag in BOUNDS:
                    break
            anchor = False
            if tag != "hr":
                stack.append(stack[-1].child(tag, m["attrs"] or ""))
                elements.append(stack[-1])
    say(page[end:])
    flush()
    return elements, blocks


def slot_of(at: Element, template: frozenset[int]) -> Element:
    """The deepest template element around, or the root."""
    while at.up is not None and at.sig not in template:
        at = at.up
    return at


#: What a host's template says: its tokens, the element of the main text, headings before it, slots that go, whether repeated texts go.
Template = tuple[frozenset[int], int, frozenset[int], frozenset[int], bool]
NO_TEMPLATE: Template = (frozenset(), ROOT.sig, frozenset(), frozenset(), True)


def choose(rows: list[dict]) -> tuple[int, list[int], list[int], bool]:
    """Main element, headings outside it, slots that go, and whether repeated texts go, from a host's slots."""
    info = {r["slot"]: r for r in rows}
    kids: dict[int, list[int]] = {}
    for r in rows:
        if r["slot"] != ROOT.sig:
            kids.setdefault(r["up"], []).append(r["slot"])
    weight, repeated = {}, {}

    def add_up(top: int) -> None:
        todo = [(top, False)]
        while todo:
            slot, done = todo.pop()
            if not done:
                todo.append((slot, True))
                todo += [(k, False) for k in kids.get(slot, ())]
                continue
            r = info[slot]
            own = 0 if r["aside"] else r["chars"]
            weight[slot] = max(0, own - (0 if r["aside"] else r["links"] + r["repeated"])) + sum(weight[k] for k in kids.get(slot, ()))
            repeated[slot] = (0 if r["aside"] else r["repeated"]) + sum(repeated[k] for k in kids.get(slot, ()))

    at = ROOT.sig
    add_up(at)
    heads: list[int] = []
    while not info[at]["main"]:
        inner = [k for k in kids.get(at, ()) if info[k]["holder"] and not info[k]["aside"]]
        best = max(inner, key=lambda k: (weight[k], k), default=None)
        if best is None or not weight[at] or weight[best] < SHARE_MAIN * weight[at]:
            break
        heads += [k for k in kids[at] if info[k]["heading"] and not info[k]["aside"]]
        at = best
    gone = [s for s, r in info.items() if s != ROOT.sig and r["chars"] and r["links"] >= LINKS * r["chars"]]
    # where most of the main text is repeated, the pages are copies of each other
    return at, heads, gone, repeated[at] <= weight[at]


def extract(page: str, known: Template = NO_TEMPLATE) -> str:
    """The text of the remaining slots, block by block, joined by an empty line."""
    template, main, heads, gone, drop = known
    _, blocks = parse(page)
    wanted: list[Block] = []
    other: list[Block] = []
    for b in blocks:
        if b.at.aside or (drop and b.sig in template):
            continue
        slot = at = slot_of(b.at, template)
        while at.up is not None and at.sig != main:
            at = at.up
        if slot.sig not in gone:
            (wanted if at.sig == main or slot.sig in heads else other).append(b)
    found = wanted
    if other and all(b.at.tag in HEADINGS for b in wanted):  # a page of another make
        some = set(map(id, wanted + other))
        found = [b for b in blocks if id(b) in some]
    length = sum(len(b.text) for b in found)
    article = [b for b in found if b.at.main]
    if article and 2 * sum(len(b.text) for b in article) >= length:
        found = article
    if main == ROOT.sig and not article:  # no template: slots are the page's own elements
        share: dict[int, list[int]] = {}
        for b in found:
            s = share.setdefault(b.at.sig, [0, 0])
            s[0] += len(b.text)
            s[1] += min(b.links, len(b.text))
        found = [b for b in found if share[b.at.sig][1] < LINKS * share[b.at.sig][0]]
    return "\n\n".join(b.text for b in found)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            cols: tuple[list, ...] = ([], [], [], [], [])
            for page, host, html in zip(*(batch.column(k).slice(i, 500).to_pylist() for k in range(3)), strict=True):
                elements, blocks = parse(html or "")
                for kind, found in ((False, elements), (True, blocks)):
                    count = Counter(x.sig for x in found)
                    cols[0].extend([host] * len(count))
                    cols[1].extend([page] * len(count))
                    cols[2].extend(count)
                    cols[3].extend(count.values())
                    cols[4].extend([kind] * len(count))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()), strict=True)], names=["host", "page", "sig", "n", "text"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, template) from pages (page, host, html): the tokens of the valid classes."""
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    token_rows = pages.mapInArrow(_tokens, "host string, page long, sig long, n int, text boolean")
    vectors = token_rows.groupBy("host", "sig", "text").agg(F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.count(F.lit(1)).alias("support")).where("support >= 2")
    often = vectors.join(hosts, "host").where(F.col("support") >= F.col("pages") * F.when(F.col("text"), SHARE_TEXT).otherwise(SHARE))
    classes = often.groupBy("host", "vector", "support").agg(F.collect_list("sig").alias("sigs")).where(F.size("sigs") >= TOKENS)
    return classes.groupBy("host").agg(F.flatten(F.collect_list("sigs")).alias("template"))


SLOTS = ("host", "slot", "up", "chars", "links", "repeated", "main", "aside", "holder", "heading")


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html, template) to the slots of a batch's pages, added up for each host."""
    for batch in batches:
        total: dict[tuple, list] = {}
        for host, html, listed in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            template = frozenset(listed or ())
            elements, blocks = parse(html or "")

            def at(e: Element, host=host, template=template) -> list:
                got = total.get((host, e.sig))
                if got is None:
                    up = slot_of(e.up, template).sig if e.up is not None else 0
                    got = total[host, e.sig] = [up, 0, 0, 0, e.main, e.aside, e.tag in HOLDERS, e.tag in HEADINGS]
                return got

            at(ROOT)
            for e in elements:
                if e.sig in template:
                    at(e)
            for b in blocks:
                slot = slot_of(b.at, template)
                got = at(slot)
                if b.at.aside and not slot.aside:
                    continue
                got[1] += len(b.text)
                if b.sig in template:
                    got[3] += len(b.text)
                else:
                    got[2] += min(b.links, len(b.text))
        cols = list(zip(*[(h, s, *v) for (h, s), v in total.items()], strict=True)) or [[]] * len(SLOTS)
        kinds = (pa.string(), *[pa.int64()] * 5, *[pa.bool_()] * 4)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=list(SLOTS))


def slots(pages: DataFrame) -> DataFrame:
    """SLOTS of each host, from pages (host, html, template)."""
    rows = pages.mapInArrow(_slots, "host string, slot long, up long, chars long, links long, repeated long, main boolean, aside boolean, holder boolean, heading boolean")
    firsts = [F.first(c).alias(c) for c in ("up", "main", "aside", "holder", "heading")]  # alike for an element, wherever it is
    return rows.groupBy("host", "slot").agg(*[F.sum(c).alias(c) for c in ("chars", "links", "repeated")], *firsts)


def _chosen(key: tuple, t: pa.Table) -> pa.Table:
    main, heads, gone, drop = choose(t.to_pylist())
    ids = pa.list_(pa.int64())
    return pa.table({"host": [key[0].as_py()], "main": [main], "heads": pa.array([heads], ids), "gone": pa.array([gone], ids), "drop": [drop]})


def extract_text(pages: DataFrame, html: str = "html", url: str = "url", id_col: str = "page_id") -> DataFrame:
    """(id_col, url, text) per row of pages.

    A null html is an empty page, and its text is empty. Pages whose url has no host share one host.
    Pages are read whole, however long. Repeated rows are extracted alike; pages that mostly repeat one
    another keep their text. An empty table gives no rows."""
    src = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), host_of(F.col(url)).alias("own"), F.col(html).alias("html"))
    small = materialize(src.groupBy("own").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= PAGES).select("own", F.col("own").alias("host")))
    src = src.join(small, "own", "left").select("id", "url", F.coalesce("host", F.lit("*")).alias("host"), "html")
    found = materialize(templates(src.select(F.xxhash64("id", "url").alias("page"), "host", "html")))
    # a host without a class has one slot, the page
    parts = slots(src.select("host", "html").join(found, "host").select("host", "html", "template"))
    chosen = parts.groupBy("host").applyInArrow(_chosen, "host string, main long, heads array<long>, gone array<long>, drop boolean")
    known = materialize(found.join(chosen, "host").select("host", F.struct("template", "main", "heads", "gone", "drop").alias("known")))
    joined = src.join(known, "host", "left").select("id", "url", "html", "known", "host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[str, Template] = {}
            text = []
            for h, k, host in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                if k is None:
                    text.append(extract(h or ""))
                    continue
                t = made.get(host)
                if t is None:
                    t = made[host] = (frozenset(k["template"]), k["main"], frozenset(k["heads"]), frozenset(k["gone"]), k["drop"])
                text.append(extract(h or "", t))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(text, pa.string())], names=["id", "url", "text"])

    out = joined.mapInArrow(run, "id long, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias("url"), "text")
