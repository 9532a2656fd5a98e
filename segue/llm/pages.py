"""Main text of web pages, by removing what sites repeat: hashed element subtrees, counted for every host.

Every page becomes a tree of elements. An element's subtree is hashed with its tag, its class, id and role, its text
and its children; its slot is the chain of such elements that leads to it. For every host Spark counts on how many
pages a subtree stands in a slot. From these counts follow

* repeated subtrees: they stand on LEAST_PAGES pages of the host and on SHARE of all its pages at least,
* template slots: on at least SLOT_SHARE of the slot's pages (LEAST_PAGES or more) stands a subtree that other pages of
  the host have there too, and most of them hold links more than text. What fills such a slot goes even where it
  stands once, as sites draw their links from a pool.

Both go, with all below them. Inside an element that a page marks as its article or main part nothing goes for
repetition but subtrees on MAIN_SHARE of all pages of the host, as documents share passages too. What HTML itself names
as no article (navigation, forms, scripts, asides; footers and headers that are not an article's own heading; classes and
roles such as `sidebar`, `ad`, `comments`, `cookie-notice`) goes on hosts with few pages just the same. If a page marks
an article, what is left outside of it goes too.

Blocks are what lies between the edges of block elements; a line break inside a block is white space.

Defined results: a null html is an empty page and has no text. The host of a url without `://` is empty, and such
pages are one host. Repeated rows count as pages each and have equal results. Very long pages are read whole; elements
that are nested deeper than DEEPEST end blocks but are no elements of their own. Elements that are not closed end with what encloses them. An empty table gives
no rows. Keys of subtrees and slots are 64-bit hashes, which take in the host.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segue.llm.common import written

LEAST_PAGES, SHARE, SLOT_SHARE, MAIN_SHARE = 3, 0.3, 0.5, 0.8
DEEPEST = 200

#: Fixed values of HTML: elements without an end, with raw text, that are no blocks, whose text is not shown, that end an
#: open paragraph, that stay in the head.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
SILENT = RAW | frozenset("head noscript template svg math object audio video canvas map datalist select option button".split())
PARAGRAPH_ENDS = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
#: An element of the first name ends open ones of the second set, up to one of the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
BOUNDS = frozenset("html body article main section div nav aside footer header form table td th ul ol dl".split())
#: Elements, roles, and words of classes and ids, that name no article; names of layouts that only speak of such parts.
NOT_MAIN = frozenset("nav aside footer form menu dialog search fieldset".split())
NOT_MAIN_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form status tooltip".split())
NOT_MAIN_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidebars aside footer header masthead banner ad ads advert adverts advertisement advertising sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login signin share sharing social comment comments respond reply replies disqus "
    "related recommended pagination pager widget widgets toolbar skip copyright colophon".split()
)
HEADINGS = frozenset("header masthead".split())
LAYOUT = re.compile(r"(?:has|with|no|without|layout|page|js)[-_]", re.I)
MAIN = frozenset(("article", "main"))

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*)(?:>|\Z)|<(?:/[^A-Za-z>][^>]*(?:>|\Z)|/>)", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s"'>]+))""", re.I)
#: Words of a name by its signs, and by its capitals.
_WORDS = re.compile(r"[A-Za-z]+"), re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Element:
    __slots__ = ("tag", "names", "up", "depth", "text", "linked", "parts", "hash", "slot", "labelled", "main")

    def __init__(self, tag: str, names: tuple[str, str, str], up: Element | None):
        self.tag, self.names, self.up = tag, names, up
        self.depth = up.depth + 1 if up else 0
        self.text = self.linked = 0  # characters of its text, and of those the linked ones
        self.parts: list = []  # of its hash
        self.hash = self.slot = 0
        self.labelled, self.main = False, bool(up and up.main)


def named_no_article(tag: str, names: tuple[str, str, str], inside_main: bool) -> bool:
    if tag in NOT_MAIN or names[2].lower() in NOT_MAIN_ROLES:
        return True
    if tag in ("html", "body", "main"):
        return False
    words = {w.lower() for x in names[:2] for n in x.split() if not LAYOUT.match(n) for found in _WORDS for w in found.findall(n)} | {tag} & HEADINGS
    return bool(words & NOT_MAIN_WORDS - HEADINGS) or bool(words & HEADINGS) and not inside_main  # an article's own header holds its heading


class Page:
    """The elements of a page, and its blocks: text and the element that holds it."""

    def __init__(self, source: str, host: str):
        self.seed = xxhash.xxh3_64_intdigest(host.encode("utf-8", "surrogatepass"))
        self.root = self.at = Element("", ("", "", ""), None)
        self.elements: list[Element] = []
        self.blocks: list[tuple[str, Element]] = []
        self.open: list[str] = []  # the text of the block at hand, of it linked characters
        self.linked = self.links = self.silent = 0
        self.over: list[str] = []  # open elements that are nested too deep
        self._read(source)
        self._flush()
        while self.at.up:
            self._close()

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            found = _TOKEN.search(source, at)
            if found is None:
                self._say(source[at:])
                return
            if found.start() > at:
                self._say(source[at : found.start()])
            at, tag = found.end(), found[2]
            if tag is None:
                if found[0].startswith("<![CDATA["):
                    self._say(found[0][9:].removesuffix("]]>"))
                continue
            tag = tag.lower()
            if found[0][-1] != ">" and at == end:  # a tag that the page ends in
                return
            if found[1]:
                self._end(tag)
            else:
                self._start(tag, found[3])
                if tag in RAW:
                    own = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I)
                    close = own.search(source, at) if tag != "plaintext" else None
                    at = close.end() if close else end
                    self._end(tag)

    def _say(self, text: str) -> None:
        if not self.silent:
            text = entities.unescape(text) if "&" in text else text
            self.open.append(text)
            self.linked += len(text) if self.links else 0

    def _flush(self) -> None:
        """Ends a block."""
        if self.open:
            text, linked = " ".join("".join(self.open).split()), self.linked
            self.open, self.linked = [], 0
            if text:
                holder = self.at
                while holder.tag in INLINE and holder.up:
                    holder = holder.up
                self.blocks.append((text, holder))
                holder.parts.append(text)
                while holder:
                    holder.text += len(text)
                    holder.linked += min(linked, len(text))
                    holder = holder.up

    def _start(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag == "hr":
                self._flush()
            elif tag == "br":
                self._say(" ")
            return
        if tag not in HEAD:
            self._pop({"head"}, ())
        if tag not in INLINE:
            self._flush()
            if tag in PARAGRAPH_ENDS:
                self._pop({"p"}, BOUNDS)
            if tag in IMPLIED:
                self._pop(*IMPLIED[tag])
        elif tag == "a" and self.links:
            self._end("a")
        if self.at.depth >= DEEPEST:
            self.over.append(tag)
            self.silent += tag in SILENT
            return
        names = ["", "", ""]
        if "=" in attributes:
            for name, *values in _NAMED.findall(attributes):
                names[("class", "id", "role").index(name.lower())] = next((x for x in values if x), "")
        element = Element(tag, tuple(names), self.at)
        element.labelled = self.at.labelled or named_no_article(tag, element.names, self.at.main)
        element.main |= (tag in MAIN or names[2].lower() == "main") and not element.labelled
        self.silent += tag in SILENT
        self.links += tag == "a"
        self.at = element

    def _pop(self, tags: set[str], stops) -> None:
        """Closes an open element of tags, if it is open inside the nearest of stops."""
        element = self.at
        while element.up and element.tag not in stops:
            if element.tag in tags:
                while self.at is not element:
                    self._close()
                self._close()
                element = self.at
                continue
            element = element.up

    def _end(self, tag: str) -> None:
        if tag == "br":
            self._say(" ")
            return
        if tag in self.over:
            while True:
                last = self.over.pop()
                self.silent -= last in SILENT
                if last == tag:
                    break
            if tag not in INLINE:
                self._flush()
            return
        element = self.at
        while element.up and element.tag != tag:
            if tag in INLINE and element.tag not in INLINE:
                return  # ends nothing outside of its block
            element = element.up
        if not element.up:
            if tag == "p":
                self._flush()
            return
        if tag not in INLINE:
            self._flush()
        while self.at is not element:
            self._close()
        self._close()

    def _close(self) -> None:
        element = self.at
        if element.tag not in INLINE:
            self._flush()
        for tag in (*self.over, element.tag):
            self.silent -= tag in SILENT
        self.over = []
        self.links -= element.tag == "a"
        self.at = element.up
        if element.tag in INLINE:
            self.at.parts.extend(element.parts)
            return
        digest = xxhash.xxh3_64(seed=self.seed)
        digest.update("\x1f".join((element.tag, *element.names, *map(str, element.parts))).encode("utf-8", "surrogatepass"))
        element.hash = digest.intdigest()
        self.at.parts.append(element.hash)
        if element.text:
            self.elements.append(element)

    def keyed(self) -> list[Element]:
        """Its elements with text, with keys of slots and, in their slots, of subtrees."""
        def key(*parts) -> int:
            return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts)), seed=self.seed)

        known: dict[int, int] = {id(self.root): self.seed}
        chain: list[Element] = []
        for element in self.elements:
            chain.clear()
            while id(element) not in known:
                chain.append(element)
                element = element.up
            slot = known[id(element)]
            for own in reversed(chain):
                slot = slot if own.tag in INLINE else key(slot, own.tag, *own.names)
                known[id(own)] = own.slot = slot
        for element in self.elements:
            element.hash = key(element.slot, element.hash)
        return self.elements

    def main_text(self, gone: set[int]) -> tuple[str, int, int]:
        """The text that is left, and how many blocks went as repeated and as named."""
        kept, repeated, named = [], 0, 0
        for text, holder in self.blocks:
            element, drop = holder, False
            while element.up and not drop:
                drop = element.hash in gone or element.slot in gone and not element.main
                element = element.up
            if drop:
                repeated += 1
            elif holder.labelled:
                named += 1
            else:
                kept.append((text, holder.main))
        marked = any(main for _, main in kept)
        return "\n".join(text for text, main in kept if main or not marked), repeated, named


def host_of(url_col: str) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty without it."""
    rest = F.expr(f"substring(`{url_col}`, locate('://', `{url_col}`) + 3)")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.col(url_col).contains("://"), host).otherwise(F.lit(""))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


FOUND = pa.list_(pa.struct([("slot", pa.int64()), ("subtree", pa.int64()), ("main", pa.bool_()), ("links", pa.bool_())]))


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every page: its subtrees with their slots, each once, and the page itself as the subtree of its host."""
    for batch in batches:
        hosts, lists = [], []
        for host, source in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            page = Page(source, host)
            root = _signed(page.seed)
            rows = {(root, root): (False, False)}
            for e in page.keyed():
                rows.setdefault((_signed(e.slot), _signed(e.hash)), (e.main, 2 * e.linked >= e.text))
            hosts.append(root)
            lists.append([{"slot": slot, "subtree": key, "main": main, "links": links} for (slot, key), (main, links) in rows.items()])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hosts, pa.int64()), pa.array(lists, FOUND)], names=["own", "host", "found"])


def elements(pages: DataFrame) -> DataFrame:
    """(own, host, found array<struct<slot, subtree, main, links>>), written: the subtrees of pages (own, host, html)."""
    found = pages.select("own", "host", "html").mapInArrow(_elements, "own long, host long, found array<struct<slot: long, subtree: long, main: boolean, links: boolean>>")
    return written(found, "page-elements")


def templates(found: DataFrame) -> DataFrame:
    """(key): the slots and the subtrees that go, by what `elements` found on all pages."""
    counts = written(found.select("host", F.explode("found").alias("e")).select("host", "e.*").groupBy("host", "slot", "subtree").agg(F.count("*").alias("n"), F.max("main").alias("main"), F.max("links").alias("links")), "subtree-counts")
    number = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    slots = counts.where("slot <> host AND NOT main").groupBy("host", "slot").agg(F.sum("n").alias("pages"), number(F.col("n") > 1).alias("again"), number(F.col("links")).alias("links"))
    filled = slots.where((F.col("pages") >= LEAST_PAGES) & (F.col("again") >= SLOT_SHARE * F.col("pages")) & (2 * F.col("links") >= F.col("pages"))).select(F.col("slot").alias("key"))
    sizes = counts.where("slot = host").select("host", F.col("n").alias("pages"))
    often = counts.where((F.col("n") >= LEAST_PAGES) & (F.col("slot") != F.col("host"))).join(sizes, "host")
    share = F.when(F.col("main"), F.lit(MAIN_SHARE)).otherwise(F.lit(SHARE))
    return written(filled.union(often.where(F.col("n") >= share * F.col("pages")).select(F.col("subtree").alias("key"))), "template-keys")


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for host, source, keys in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
            page = Page(source, host)
            page.keyed()
            rows.append(page.main_text({k % (1 << 64) for k in keys or ()}))
        text, repeated, named = ([r[i] for r in rows] for i in range(3))
        columns = [pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array(repeated, pa.int64()), pa.array(named, pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "url", "text", "n_chars", "blocks_repeated", "blocks_named"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars, blocks_repeated, blocks_named): the main text of every page, and how many blocks went as repeated and as named."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(url_col).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("own", F.xxhash64("host", "html"))  # equal pages of a host have equal templates
    found = elements(rows)
    keys = found.select("own", F.explode(F.expr("array_union(found.slot, found.subtree)")).alias("key"))
    gone = keys.join(templates(found), "key").groupBy("own").agg(F.collect_set("key").alias("keys"))
    id_type = pages.schema[id_col].dataType.simpleString()
    sent = rows.join(written(gone, "page-templates"), "own", "left").select("id", "url", "host", "html", "keys")
    return sent.mapInArrow(_extracted, f"id {id_type}, url string, text string, n_chars long, blocks_repeated long, blocks_named long").withColumnRenamed("id", id_col)
