"""Main text of web pages with site template removal.

A first pass hashes the subtree of every container element (tag, text and the
hashes of its children), whatever it is called, and Spark counts, per host, on
how many different pages each hash occurs. Pages with one first heading count
once, so copies of an article do not make its parts look like template. A
subtree that recurs on ``MIN_PAGES`` pages of its host or more is deleted.
Elements that hold an article, a main part, a first heading or most of a page's
text are never template, nor are single paragraphs.

Then goes what the markup itself declares: navigation, footer, aside, form and
the like by tag or role, adverts, sidebars, notices and reader comments by a
container's whole class names. An article that holds most of what is left is
the main text, else all of it is.

White space inside a block becomes one space, blocks are joined by an empty
line, character references are decoded. The html itself is never shuffled: the
second pass sends a page's blocks with the hashes above them to the page's
delete list, the same way at every size. Counts are keyed by host and hash and
partially aggregated, and delete lists are looked up with a salt, so a host with
a third of all pages is no hot task.

Defined results: null or empty html gives an empty text; pages without a host
(null url) count together; repeated pages get equal results; unclosed and stray
tags are tolerated; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import content_key, cut

#: A subtree is template if it occurs on so many different pages of its host.
MIN_PAGES = 4
#: Parts that the pages of one subtree are dealt to when it is looked up.
SALT = 32

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[/!?a-zA-Z][^>]*\Z|[^<]+|<", re.S)
_NAME = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var".split())
#: Elements and roles that are never main text.
DROPPED = frozenset("head nav footer aside form button select option datalist script style noscript template iframe object embed svg canvas audio video map menu dialog textarea title input fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar alert alertdialog dialog form".split())
#: Containers whose class names or id are looked at, and the names that mark them as no main text: as a whole name, or
#: as a word of a compound name.
CONTAINERS = frozenset("div section ul ol dl table td details figure".split())
NAMES = frozenset("ad ads adv advert adverts banner notice notices alert alerts promo promos menu menus nav header footer sidebar sidenav comment comments replies respond social share sharing related widget widgets search pagination pager toolbar popup modal subscribe".split())
COMPOUND = frozenset("advert advertisement adsense sponsored sidebar navbar navigation breadcrumb breadcrumbs cookie cookies gdpr newsletter comments commentlist disqus footer masthead".split())
#: First words that turn a compound name into a statement about the page.
STATES = frozenset("has no is not with without hide show enable disable".split())
#: Start tags that close an open element of these kinds.
CLOSES = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "thead": ("tr",),
    "tbody": ("tr", "thead"),
    "tfoot": ("tr", "tbody"),
    "option": ("option",),
}
#: Single blocks: never template by themselves.
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th tr dt dd figcaption body html article main".split()) | INLINE
_BARRIER = frozenset("table ul ol dl td th div section article main body html".split())


class _Element:
    __slots__ = ("tag", "parent", "dropped", "main", "parts", "size", "held", "core", "hash")

    def __init__(self, tag: str, parent: _Element | None, dropped: bool, main: bool) -> None:
        self.tag, self.parent, self.dropped, self.main = tag, parent, dropped, main
        self.parts: list[str] = []
        self.size = 0
        self.core = tag in ("article", "main")
        self.held = self.core or tag == "h1"
        self.hash = 0


def marked(tag: str, attributes: str) -> bool:
    """Whether role, class names or id say that a container is no main text."""
    for m in _NAME.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            if m[1].lower() == "role":
                if name in ROLES:
                    return True
            elif tag in CONTAINERS:
                words = re.split("[-_]+", name)
                if name in NAMES or words[0] not in STATES and not COMPOUND.isdisjoint(words):
                    return True
    return False


class Page:
    """Blocks (text, innermost block element) in page order, all block elements, and the hash of what names the page."""

    def __init__(self, page: str | None) -> None:
        self.blocks: list[tuple[str, _Element]] = []
        self.elements: list[_Element] = []
        self._parse(page or "")

    def _parse(self, text: str) -> None:
        root = _Element("html", None, False, False)
        stack, buffer, blocks, closed = [root], [], self.blocks, self.elements
        block = root  # innermost block-level element
        heading = title = None

        def flush() -> None:
            nonlocal heading
            if buffer:
                words = " ".join(html.unescape("".join(buffer)).split())
                buffer.clear()
                if words:
                    if heading is None and block.tag == "h1":
                        heading = words
                    blocks.append((words, block))
                    block.parts.append(words)
                    block.size += len(words)

        def close(to: int) -> None:
            """Ends the elements from position ``to`` of the stack."""
            nonlocal block
            if any(e.tag not in INLINE for e in stack[to:]):
                flush()
            while len(stack) > to:
                e = stack.pop()
                if e.tag in INLINE:
                    continue
                e.hash = xxhash.xxh64_intdigest("\1".join([e.tag, *e.parts]), 7) - (1 << 63)
                closed.append(e)
                up = e.parent
                up.parts.append(f"\2{e.hash}")
                up.size += e.size
                up.held |= e.held
                up.core |= e.core
                block = up

        at, size = 0, len(text)
        while at < size:
            m = _TOKEN.match(text, at)
            at = m.end()
            tag = m[2] or m[5]
            if tag is None:
                token = m[0]
                if token[0] != "<" or token == "<":
                    buffer.append(token)
                continue
            tag = tag.lower()
            if m[1] or m[4]:  # end tag
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if tag in INLINE and stack[k].tag not in INLINE:
                        break
                continue
            attributes = m[3] or m[6] or ""
            if tag == "br":
                buffer.append(" ")
            if tag in VOID or attributes.endswith("/") and tag in ("svg", "path"):
                if tag == "hr":
                    flush()
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
                if tag == "title" and title is None:
                    title = text[at : end.start() if end else size].strip()
                at = end.end() if end else size
                continue
            if tag not in INLINE:
                for k in range(len(stack) - 1, 0, -1):  # an open paragraph or its like ends here
                    if stack[k].tag == "p" or stack[k].tag in CLOSES.get(tag, ()):
                        close(k)
                        break
                    if stack[k].tag in _BARRIER:
                        break
                flush()
            inside = stack[-1].main or tag in ("article", "main")
            bad = tag in DROPPED or tag == "header" and not inside or bool(attributes) and tag not in ("body", "html", "article", "main") and marked(tag, attributes)
            element = _Element(tag, block, bad, inside)
            stack.append(element)
            if tag not in INLINE:
                block = element
        close(1)
        flush()
        root.hash = xxhash.xxh64_intdigest("\1".join(root.parts), 7) - (1 << 63)
        closed.append(root)
        self.name = xxhash.xxh64_intdigest(heading or title, 9) - (1 << 63) if heading or title else root.hash

    def may_go(self, e: _Element) -> bool:
        """Whether an element can be template at all."""
        root = self.elements[-1]
        return e.tag not in PLAIN and e.size > 0 and not e.held and (root.held or 2 * e.size <= root.size)

    def containers(self) -> list[int]:
        """Distinct hashes of the elements that may be template."""
        return sorted({e.hash for e in self.elements if self.may_go(e)})

    def _declared(self, e: _Element) -> bool:
        """Whether markup says that an element is no main text. Forms and named containers may hold a page's all, others not."""
        root = self.elements[-1]
        if not e.dropped:
            return False
        if e.tag == "header":
            return not e.core and (not e.held or root.core)
        if e.tag in DROPPED and e.tag not in ("form", "fieldset"):
            return True
        return not e.held and (root.held or 2 * e.size <= root.size)

    def live(self) -> list[tuple[str, list[int], bool]]:
        """(text, hashes of the elements above that may be template, inside an article or main part) of the blocks that markup does not rule out."""
        known: dict[int, tuple[bool, list[int], bool]] = {id(None): (False, [], False)}
        for e in reversed(self.elements):  # from the root down
            gone, up, main = known[id(e.parent)]
            known[id(e)] = gone or self._declared(e), [*up, e.hash] if self.may_go(e) else up, main or e.tag in ("article", "main")
        return [(t, up, main) for t, (gone, up, main) in ((t, known[id(e)]) for t, e in self.blocks) if not gone]


def extract(page: str | None, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The main text of one page without the template subtrees."""
    live = [(t, main) for t, up, main in Page(page).live() if template.isdisjoint(up)]
    main = [t for t, inside in live if inside]
    return "\n\n".join(main if 2 * sum(map(len, main)) >= sum(len(t) for t, _ in live) else [t for t, _ in live])


def host(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def template_subtrees(pages: DataFrame) -> DataFrame:
    """(_k1, _k2, hash) of the template subtrees of ``keyed`` pages."""

    def hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p.containers(), p.name) for p in map(Page, batch.column(3).to_pylist())]
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["_k1", "_k2", "_host", "hashes", "page"])

    seen = cut(pages.select("_k1", "_k2", "_host", "html").mapInArrow(hashes, "_k1 long, _k2 long, _host string, hashes array<long>, page long"))
    each = seen.select("_k1", "_k2", "_host", "page", F.explode("hashes").alias("hash"))
    counts = each.select("_host", "hash", "page").distinct().groupBy("_host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
    dealt = counts.select("_host", "hash", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt"))
    return each.withColumn("_salt", F.pmod("_k1", F.lit(SALT)).cast("int")).join(dealt, ["_host", "hash", "_salt"]).select("_k1", "_k2", "hash")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    keyed = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host().alias("_host"))
    k1, k2 = content_key("_host", "html")
    keyed = keyed.withColumn("_k1", k1).withColumn("_k2", k2)
    lists = template_subtrees(keyed).groupBy("_k1", "_k2").agg(F.collect_set("hash").alias("template"))
    block = pa.list_(pa.struct([("text", pa.string()), ("up", pa.list_(pa.int64())), ("main", pa.bool_())]))

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"text": t, "up": up, "main": main} for t, up, main in Page(p).live()] for p in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, block)], names=["page_id", "url", "_k1", "_k2", "blocks"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields if f.name in ("page_id", "url")}
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, _k1 long, _k2 long, blocks array<struct<text: string, up: array<long>, main: boolean>>"
    cut_up = keyed.select("page_id", "url", "_k1", "_k2", "html").mapInArrow(blocks, schema)
    joined = cut_up.hint("merge").join(lists, ["_k1", "_k2"], "left")
    live = joined.select("page_id", "url", F.when(F.col("template").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda b: ~F.arrays_overlap(b["up"], F.col("template")))).alias("live"))
    live = live.withColumn("inside", F.filter("live", lambda b: b["main"]))
    chars = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, b: n + F.length(b["text"]))
    text = F.array_join(F.transform(F.when(2 * chars("inside") >= chars("live"), F.col("inside")).otherwise(F.col("live")), lambda b: b["text"]), "\n\n")
    return live.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
