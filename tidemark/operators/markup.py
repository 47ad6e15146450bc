"""HTML fragments made safe, and markup taken out of plain text.

One tokeniser reads a fragment once: comments and declarations, end tags, start tags with their attributes, text. The
clean fragment is written from its tokens: allowed tags with allowed attributes, all closed in order, nothing of elements
that are dropped whole. Plain text is cleaned by one pass that takes a tag out as its closing sign comes, so that what is
left on both sides may form the next tag at once; no second pass is needed.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.registry import query
from tidemark.sources.tables import read_table

# What a fragment may hold, and what goes with all in it.
ALLOWED = frozenset(
    "p br hr h1 h2 h3 h4 h5 h6 strong em b i u s del ins sub sup small mark abbr blockquote code pre ul ol li dl dt dd "
    "table thead tbody tfoot tr th td a div".split()
)
DROPPED = frozenset(
    "script style iframe frame frameset object embed applet noscript noembed noframes template svg math xml textarea select "
    "option title head base link meta form button".split()
)
NO_CONTENT = frozenset(("base", "link", "meta", "embed", "frame"))  # no end tag, so nothing goes with them
VOID = frozenset(("br", "hr"))
ATTRIBUTES = {"a": ("href", "title", "class"), "abbr": ("title",), "th": ("align", "style"), "td": ("align", "style"), "ol": ("start",), "sup": ("id",), "li": ("id",), "div": ("class",)}
VALUES = {
    "style": re.compile("text-align: (left|right|center);"),
    "class": re.compile("footnote(-ref|-backref)?"),
    "id": re.compile("fn(ref)?:[0-9A-Za-z_-]{1,40}"),
    "align": re.compile("left|right|center", re.I),
    "start": re.compile("[0-9]{1,6}"),
}
SCHEMES = ("http", "https", "mailto", "tel")

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|</(?P<end>[a-z][^\s/>]*)[^>]*(?:>|\Z)"""
    r"""|<(?P<start>[a-z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)"""
    r"""|(?P<text>[^<]+|<)""",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_REFERENCE = re.compile(r"&(?!(?:[a-z][a-z0-9]*|#[0-9]{1,7}|#x[0-9a-f]{1,6});)", re.I)
_UNSEEN = re.compile("[\\x00-\\x20\\x7f-\\x9f\\u200b-\\u200f\\u2028\\u2029\\u00a0\\ufeff]+")


def safe_link(value: str) -> bool:
    """Whether a link is relative or of a safe scheme, once characters are gone that browsers skip in it."""
    said = _UNSEEN.sub("", html.unescape(value)).lower()
    head = re.split("[/?#]", said, maxsplit=1)[0]
    return ":" not in head or head.split(":", 1)[0] in SCHEMES


def _attributes(tag: str, said: str) -> str:
    out = []
    for name, *values in _ATTRIBUTE.findall(said):
        name, value = name.lower(), html.unescape(next((v for v in values if v), ""))
        fits = safe_link(value) if name == "href" else name not in VALUES or VALUES[name].fullmatch(value)
        if name in ATTRIBUTES.get(tag, ()) and fits:
            out.append(f' {name}="{html.escape(value.strip() if name == "href" else value)}"')
    return "".join(out)


def safe_fragment(page: str | None) -> str | None:
    """The fragment with allowed markup only, well formed."""
    if page is None:
        return None
    out, opened, gone, depth = [], [], "", 0
    for m in _TOKEN.finditer(page):
        start, end = (m["start"] or "").lower(), (m["end"] or "").lower()
        if gone:  # inside an element that is dropped: its own tags count, nothing else
            depth += (start == gone and not (m["attrs"] or "").endswith("/")) - (end == gone)
            gone = gone if depth else ""
        elif m["text"]:
            out.append(_REFERENCE.sub("&amp;", m["text"]).replace("<", "&lt;").replace(">", "&gt;"))
        elif start in DROPPED:
            if start not in NO_CONTENT and not m["attrs"].endswith("/"):
                gone, depth = start, 1
        elif start in ALLOWED:
            out.append(f"<{start}{_attributes(start, m['attrs'])}{' /' if start in VOID else ''}>")
            if start not in VOID:
                opened.append(start)
        elif end in opened:
            while (last := opened.pop()) != end:
                out.append(f"</{last}>")
            out.append(f"</{end}>")
    return "".join(out + [f"</{t}>" for t in reversed(opened)])


_TAG = re.compile(r"</?([a-z][a-z0-9:-]*)(?:\s[^<>]*)?/?>|<[!?][^<>]*>", re.I)
_SIGN = re.compile("<!--|[<>]")
_SCRIPT_LINK = re.compile(r"\b(java|vb)\s*script\s*:|\bdata\s*:\s*text/html", re.I)
_CLOSING = {tag: re.compile(rf"<\s*/\s*{tag}\s*>", re.I) for tag in DROPPED - NO_CONTENT}


def plain(text: str | None) -> str | None:
    """The text without markup: comments and dropped elements with their content, all other tags alone. What is left holds
    no tag. Script links are defused."""
    if text is None or ("<" not in text and ":" not in text):
        return text
    out: list[str] = []  # pieces; those that may begin a tag start with <
    begun: list[int] = []  # where such pieces are
    at = 0
    while at < len(text):
        m = _SIGN.search(text, at)
        if m is None:
            out.append(text[at:])
            break
        out.append(text[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            stop = text.find("-->", at)
            at = len(text) if stop < 0 else stop + 3
        elif m[0] == "<":
            begun.append(len(out))
            out.append("<")
        elif begun:
            first = begun.pop()
            tag = _TAG.fullmatch("".join(out[first:]) + ">")
            if tag is None:
                out.append(">")
                begun.clear()  # a tag has no > inside
                continue
            del out[first:]
            name = (tag[1] or "").lower()
            if name in _CLOSING and not tag[0].startswith("</") and not tag[0].endswith("/>"):
                stop = _CLOSING[name].search(text, at)
                at = stop.end() if stop else len(text)
        else:
            out.append(">")
    return _SCRIPT_LINK.sub("blocked:", "".join(out))


def _cleaned(clean):  # noqa: ANN001, ANN202
    """A column function that cleans batches of texts."""

    @F.pandas_udf(T.StringType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(clean)

    return of


@query("txt_html_sanitise")
def txt_html_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", _cleaned(safe_fragment)("html").alias("clean"))


@query("txt_html_to_text")
def txt_html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, text (its hash, white space single): the pages as plain text."""
    text = F.trim(F.regexp_replace(_cleaned(plain)("html"), r"\s+", " "))
    return read_table(spark, sf_dir, "pages").select("page_id", F.md5(text).alias("text"))
