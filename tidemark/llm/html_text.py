"""Main text of web pages, without what the pages of a site share.

Every element's subtree (tag, text, children) is hashed, and the pages on which each hash occurs are counted per host in
Spark. Subtrees that recur on many pages of their host are deleted from every page; inside main containers (article or
main) these are whole boxes, while a paragraph that several articles share is text of each. What is left is read as blocks: from the main containers that still hold text, else from the body, without
elements whose tag, role or class names them as site furniture. An inline element in a run of text is judged with that
run, so that sentences stay whole.

Defined cases: a null or empty page has an empty text; unclosed and misnested tags are closed where a browser would;
repeated rows each get their text; the versions of one url count once for their site, and so do the urls of one article
(its longest main container, else its body); a null url is a host of its own, whose pages count by their articles; an
empty table gives an empty result; a page of any length and depth is parsed whole, without recursion.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common as C
from tidemark.llm.url_filter import host_and_path

#: A subtree is the site's when it is on so many of the host's pages, whatever the host's size.
LEAST_PAGES = 3

#: Elements of the HTML standard by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style noscript template iframe object svg canvas audio video select option datalist map".split())
FURNITURE = frozenset("nav header footer aside form button dialog menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
MAIN = frozenset(("article", "main"))
#: Elements that hold blocks: what a site puts into main containers of its pages comes in these.
BOXES = frozenset("article aside details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "header footer masthead sidebar aside widget related recommended comment comments disqus respond reply replies notice notices cookie cookies "
    "consent gdpr popup modal overlay newsletter subscribe signup login search share sharing social toolbar pagination pager discussion discussions".split()
)
#: Words that say nothing of what an element holds: within a main container a name counts as furniture only if all its other
#: words are such, so that "cookie-notice-bar" does and "search-and-rescue" does not.
PLAIN_WORDS = frozenset(
    "area article articles aside background bar block blocks body border bottom box boxes btn button buttons card cards center close col column container "
    "content count cta entry field fields fixed float form full group grid header head heading hidden holder icon icons image img inline inner input item items "
    "js label large layout left link links list main mobile more module new page panel part policy post posts primary region right root row secondary section "
    "site size slot small span sticky stories story style tag tags text thread thumb title toggle top ul unit user view wide wrap wrapper zone".split()
)
#: What closes an open element of each kind.
_ENDS_P = BLOCKS - {"body", "html", "caption", "tbody", "tfoot", "thead", "tr"}
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_WALLS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


class Node:
    __slots__ = ("attrs", "children", "hash", "said", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children, self.hash, self.said = tag, attrs, [], 0, 0

    def names_furniture(self, in_main: bool = False) -> bool:
        if self.tag in FURNITURE or self.attrs.get("role", "").lower() in ROLES or "hidden" in self.attrs or self.attrs.get("aria-hidden") == "true":
            return True
        if self.tag in MAIN or self.tag in ("body", "html"):
            return False
        for name in f"{self.attrs.get('class', '')} {self.attrs.get('id', '')}".lower().split():
            said = {w for w in re.split(r"[^a-z]+", name) if w}
            if not FURNITURE_WORDS.isdisjoint(said) and (not in_main or said <= FURNITURE_WORDS | PLAIN_WORDS):
                return True
        return False


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]

    def _close(self, tags: tuple[str, ...] | frozenset, walls: tuple[str, ...]) -> None:
        """Close the innermost open element of `tags`, and all in it, unless a wall stands between."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in walls:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _ENDS_P:
            self._close(("p",), ("table", "td", "th", "article", "section", "div", "li", "blockquote", "body"))
        if tag in _CLOSES:
            self._close(_CLOSES[tag], _WALLS[tag])
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag not in VOID:
            self._close((tag,), ("td", "th", "table") if tag not in BLOCKS and tag not in ("td", "th") else ())

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parsed(html: str) -> Node:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _walk(root: Node) -> list[Node]:
    """All elements, parents first."""
    out, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        out.append(node)
        waiting += [c for c in node.children if isinstance(c, Node)]
    return out


def hashed(root: Node, host: str = "") -> None:
    """Set every element's hash from its host, tag, text and children, and how many characters of text it has, without an
    argument per level of depth."""
    seed = xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"))
    for node in reversed(_walk(root)):
        made = xxhash.xxh64(node.tag.encode("utf-8", "surrogatepass"), seed=seed)
        for c in node.children:
            if isinstance(c, Node):
                node.said += c.said
                made.update(c.hash.to_bytes(8, "little", signed=True))
            elif said := " ".join(c.split()):
                node.said += len(said)
                made.update(b"\x00" + said.encode("utf-8", "surrogatepass"))
        node.hash = int(np.uint64(made.intdigest()).astype(np.int64))


def _judged(root: Node) -> Iterator[Node]:
    """The elements that may be the site's, parents first: all with text but head and those within a run of text, and of a
    main container's only boxes, as a paragraph, heading or item in it that other articles have too is text. What is taken
    out of an element while it is at hand is not visited."""
    waiting = [(root, False, False)]
    while waiting:
        node, in_run, in_main = waiting.pop()
        if node.tag == "head" or not node.said:
            continue
        whole = node.tag in ("#root", "html", "body")
        in_run = in_run and node.tag not in BLOCKS and node.tag not in ("td", "th")
        if not (whole or in_run) and (node.tag in BOXES or not in_main):
            yield node
        in_run = in_run or (not whole and any(isinstance(c, str) and any(map(str.isalnum, c)) for c in node.children))
        in_main = in_main or node.tag in MAIN
        waiting += [(c, in_run, in_main) for c in node.children if isinstance(c, Node)]


def subtrees(html: str, host: str = "") -> tuple[int, list[int]]:
    """The hash of a page's longest main container (or of its body, without one), and those of all its subtrees that may be
    the site's."""
    root = parsed(html)
    root.children = [c for c in root.children if not (isinstance(c, Node) and c.tag in HIDDEN)]
    for node in root.children:
        if isinstance(node, Node) and node.tag == "html":
            node.children = [c for c in node.children if not (isinstance(c, Node) and c.tag in HIDDEN)]
    hashed(root, host)
    longest = max((n for n in _walk(root) if n.tag in MAIN and n.said), key=lambda n: n.said, default=root)
    return longest.hash, sorted({n.hash for n in _judged(root)})


def _blocks(top: Node) -> str:
    """The blocks of text within top, without hidden elements and those that their names show to be furniture."""
    blocks: dict[int, list[str]] = {}
    block, stack, in_main = 0, [top], top.tag in MAIN
    while stack:
        item = stack.pop()
        if item is None:
            block += 1
        elif isinstance(item, str):
            blocks.setdefault(block, []).append(item)
        elif item is top or not (item.tag in HIDDEN or item.names_furniture(in_main)):
            if item.tag == "br" or item.tag in ("td", "th"):
                blocks.setdefault(block, []).append(" ")
            if item.tag in BLOCKS or item is top:
                block += 1
                stack.append(None)
            stack += reversed(item.children)
    return "\n".join(said for parts in blocks.values() if (said := " ".join("".join(parts).split())))


def main_text(html: str, site: set[int], host: str = "") -> str:
    """The text of a page without the subtrees whose hashes are in `site`."""
    root = parsed(html)
    if site:
        hashed(root, host)
        for node in _judged(root):
            if node.hash in site:
                node.children = [" "]
    mains, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        if node.tag in MAIN:
            mains.append(node)
        elif not (node.tag in HIDDEN or node.names_furniture()):
            waiting += [c for c in reversed(node.children) if isinstance(c, Node)]
    return "\n".join(said for top in mains if (said := _blocks(top))) or _blocks(root)


def extracted(pages: DataFrame, url: str = "url", html: str = "html", least: int = LEAST_PAGES) -> DataFrame:
    """Per row of pages: row (its columns but html), text.

    Pages are parsed twice: for the hashes of their subtrees, and for their text once the site's subtrees are known. So
    the pages go through one shuffle, packed, and are never stored.
    """
    host, _ = host_and_path(F.col(f"`{url}`").cast("string"))
    source = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != html]).alias("row"),
        host.alias("host"),
        F.xxhash64(F.col(f"`{url}`").cast("string"), F.col(f"`{html}`").cast("string")).alias("page"),
        F.when(F.col(f"`{url}`").isNotNull(), F.xxhash64(F.col(f"`{url}`").cast("string"))).alias("url"),
        F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("html"),
    )

    C.small_batches(pages.sparkSession)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.steps(batches, "html"):
            found = [subtrees(h, o) for h, o in zip(batch.column("html").to_pylist(), batch.column("host").to_pylist(), strict=True)]
            bodies, held = pa.array([b for b, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page", "url")), bodies, held], names=["page", "url", "body", "subtrees"])

    # All hashes are made with the host's name, so equal ones are of one host.
    schema = "page bigint, url bigint, body bigint, subtrees array<bigint>"
    seen = C.written(source.select("host", "page", "url", "html").mapInArrow(parse, schema), "pages")
    # One url and one page for each body, whatever the order of rows, then each url once for each subtree: n pages with different urls and bodies.
    once = seen.groupBy("body").agg(F.coalesce(F.min("url"), F.col("body")).alias("url"), F.min_by("subtrees", "page").alias("subtrees"))
    each = once.select("url", F.explode("subtrees").alias("subtree")).distinct()
    often = each.groupBy("subtree").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    site = C.written(often.select("subtree"), "site")
    own = seen.select("page", F.explode("subtrees").alias("subtree"))
    marked = own.join(site, "subtree").groupBy(F.col("page").alias("of")).agg(F.collect_set("subtree").alias("site"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.steps(batches, "html"):
            made = [zlib.compress(h.encode(), 1) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "host", "page")), pa.array(made, pa.binary())], names=["row", "host", "page", "packed"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.steps(batches, "packed"):
            taken = zip(*(batch.column(c).to_pylist() for c in ("packed", "site", "host")), strict=True)
            made = [main_text(zlib.decompress(z).decode(), set(gone or ()), o).encode("utf-8", "replace").decode() for z, gone, o in taken]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(made, pa.string())], names=["row", "text"])

    packed = source.select("row", "host", "page", "html").mapInArrow(pack, T.StructType([*(source.schema[c] for c in ("row", "host", "page")), T.StructField("packed", T.BinaryType())]))
    joined = packed.join(marked, F.col("page") == F.col("of"), "left").select("row", "host", "packed", "site")
    return joined.mapInArrow(finish, T.StructType([source.schema["row"], T.StructField("text", T.StringType())]))
