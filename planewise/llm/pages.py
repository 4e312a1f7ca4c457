"""Main text of web pages by site style trees."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planewise.llm.common import split_join, stored

#: A recurring content goes if its importance, in bits, is below this, judged on so many different pages of its host at least.
IMPORTANCE, PAGES = 0.33, 6
#: Weight of what a content tells against the presentation of the element that holds it.
CONTENT_SHARE = 0.9
#: Low contents of all hosts up to which they are broadcast (16 bytes each); more meet their pages by a shuffle.
BROADCAST = 500_000

# Fixed values of HTML: elements without content, with raw content, that stand in a line, and what ends an open one.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table td th article section main aside nav header footer div form body blockquote".split())

# What is never main text, by element, role, and words of class or id.
NOT_TEXT = frozenset("head script style noscript template nav footer aside form iframe svg canvas math button select textarea input object embed dialog menu audio video noembed noframes xmp title".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar form toolbar".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle banner sponsor sponsored sponsors promo promotion promoted"
    " nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager toolbar header masthead topbar footer sidebar aside rail widget widgets"
    " cookie cookies consent gdpr notice notices alert disclaimer popup modal overlay newsletter subscribe subscription signup login search form"
    " comment comments reply replies respond disqus discussion share sharing social related recommended recommendations teaser toc".split()
)
#: Of these, the ones that also count on an element that marks an article.
ARTICLE_NOISE = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related recommended teaser".split())
ROOTS = frozenset(("article", "main"))

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>?)|[^<]++|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[a-z0-9]+")


@dataclass(slots=True)
class Node:
    """An open element: its style path (hashed), whether it is outside the main text, and whether it marks an article."""

    tag: str
    path: int
    out: bool
    root: bool
    children: list[str] = field(default_factory=list)


@dataclass(slots=True)
class Block:
    """Text between two block boundaries, in pieces: style path, text, and whether it is outside the main text."""

    inside: bool
    pieces: list[tuple[int, str, bool]]

    def text(self, low: frozenset[int] = frozenset(), lists: bool = True) -> str:
        return " ".join(unescape("".join(t for path, t, out in self.pieces if not (out and lists) and path not in low)).split())


def _noise(tag: str, attributes: str, in_root: bool) -> tuple[bool, bool, str]:
    """Whether the element is outside the main text by its name or attributes, is a main element, and its style label."""
    out = tag in NOT_TEXT or (tag == "header" and not in_root)
    root, label = tag in ROOTS, tag
    if attributes:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        role = found.get("role", "").strip().lower()
        names = f"{found.get('class', '')} {found.get('id', '')}"
        words = set(WORD.findall(re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", names).lower()))
        root = root or role in ("main", "article")
        if tag not in ("html", "body"):
            bad = ARTICLE_NOISE if root else NOISE - {"header"} if in_root else NOISE
            out = out or role in ROLES or bool(words & bad)
            out = out or "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", "")) is not None
        if found.get("class"):
            label = f"{tag}.{'.'.join(sorted(found['class'].lower().split()))}"
    return out, root and not out, label


def _step(path: int, label: str) -> int:
    """The style path one element further down, as a hash of the path above it and the label."""
    return xxhash.xxh64_intdigest(label.encode("utf-8", "surrogatepass"), path) >> 1


def parse(html: str) -> tuple[list[Block], dict[int, list[str]]]:
    """The page's visible blocks, in order, and what the elements at every style path contain, by the path.

    Lenient as browsers are: elements that are not closed end with what holds them, end tags without an element and
    tags that the end of the page cuts off are dropped.
    """
    stack = [Node("", 0, False, False)]
    held: Counter[str] = Counter()  # open elements by name, so that no end is looked for in vain
    styles: dict[int, list[str]] = {}
    blocks: list[Block] = []
    pieces: list[tuple[int, str, bool]] = []
    raw, at = "", 0

    def boundary() -> None:
        nonlocal pieces
        if pieces:
            blocks.append(Block(stack[-1].root, pieces))
            pieces = []

    def close(upto: int) -> None:
        while len(stack) > upto:
            if stack[-1].tag not in INLINE:
                boundary()
            node = stack.pop()
            held[node.tag] -= 1
            styles.setdefault(node.path, []).extend([*node.children, "/"])

    while at < len(html):
        if raw:
            end = re.compile(rf"</{raw}(?=[\s/>])", re.I).search(html, at)
            at, raw = (end.start() if end else len(html)), ""
            continue
        m = TOKEN.match(html, at)
        at = m.end()
        name = m[2]
        if name is None:
            if not m[0].startswith(("<!", "<?")):
                pieces.append((stack[-1].path, m[0], stack[-1].out))
            continue
        if not m[4]:
            if at < len(html):  # a quote that never ends: the tag ends at the next bracket
                at = html.find(">", m.start()) + 1 or len(html)
            else:
                break
        tag = name.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1) if held[tag] else ():
                if stack[i].tag == tag:
                    close(i)
                    break
            continue
        if tag not in INLINE:
            boundary()
            # a paragraph ends where any block begins; list items and cells end at the next one
            ends = CLOSES.get(tag, frozenset()) | {"p"}
            for i in range(len(stack) - 1, 0, -1) if any(held[e] for e in ends) else ():
                if stack[i].tag in ends:
                    close(i)
                    break
                if stack[i].tag in SCOPES and tag not in ("td", "th", "tr"):
                    break
        elif tag == "br":
            pieces.append((stack[-1].path, " ", stack[-1].out))
        top = stack[-1]
        out, root, label = _noise(tag, m[3], top.root)
        top.children.append(label)
        if tag in VOID:
            continue
        held[tag] += 1
        stack.append(Node(tag, _step(top.path, label), top.out or out, top.root or (root and not top.out)))
        if tag in RAW:
            raw = tag
    close(1)
    boundary()
    return blocks, styles


def main_blocks(blocks: list[Block]) -> list[Block]:
    """Those inside an article or main element; all, where the page has none."""
    shown = [b for b in blocks if not all(out for _, _, out in b.pieces)]
    return [b for b in shown if b.inside] or shown


def contents(blocks: list[Block]) -> dict[int, int]:
    """The hash of what stands at every style path that bears text, in the main part or not."""
    texts: dict[int, list[str]] = {}
    for b in blocks:
        for path, t, _ in b.pieces:
            if not t.isspace():
                texts.setdefault(path, []).append(" ".join(t.split()))
    return {path: xxhash.xxh64_intdigest("\n".join(own).encode("utf-8", "surrogatepass")) >> 1 for path, own in texts.items()}


def main_text(html: str, low: frozenset[tuple[int, int]] = frozenset(), lists: bool = True) -> str:
    """Blocks of the main text without what ``low`` holds, by path and content, one a line.

    Without ``lists``, all visible blocks are kept but those that ``low`` holds.
    """
    blocks = parse(html)[0]
    gone = frozenset(path for path, content in contents(blocks).items() if (path, content) in low) if low else frozenset()
    return "\n".join(t for b in (main_blocks(blocks) if lists else blocks) if (t := b.text(gone, lists)))


def _host() -> F.Column:
    """The host of the url, in lower case and without port; urls without one share the empty host."""
    return F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def style_tree(pages: DataFrame) -> DataFrame:
    """The style tree of every host (columns ``host`` and ``html``), as rows ``host``, ``path``, ``content``, ``pages`` and ``importance``.

    Pages of a host are merged by style path: the chain of element names with their classes.  For each path that
    bears text, pages are counted by what stands there (content) and by what the element that holds it contains
    (presentation).  A row is the most common content of a path.  Its importance is what it tells, -log2 of its share of
    the path's pages, and the entropy of the presentation, in bits: 0 where all pages agree, whatever their
    number.  The entropy of the contents is the mean of what they tell; judging each by its own keeps a title that stands
    beside many equal ones.  Pages with the same main text are copies and count once.  All sums are combined before a
    shuffle, so a host with very many pages is no burden to one task.
    """

    def nodes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for begin in range(0, part.num_rows, 200):
                few = part.slice(begin, 200)
                out: list[list] = [[] for _ in range(5)]
                for host, html in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), strict=True):
                    blocks, styles = parse(html or "")
                    whole = "\n".join(t for b in main_blocks(blocks) if (t := b.text()))
                    page = xxhash.xxh64_intdigest(whole.encode("utf-8", "surrogatepass")) >> 1
                    for path, content in contents(blocks).items():
                        inside = " ".join(styles.get(path, ())).encode("utf-8", "surrogatepass")
                        for column, value in zip(out, (host, path, page, content, xxhash.xxh64_intdigest(inside) >> 1), strict=True):
                            column.append(value)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["host", "path", "page", "content", "style"])

    found = pages.select("host", "html").mapInArrow(nodes, "host string, path long, page long, content long, style long")
    once = found.groupBy("host", "path", "page").agg(F.min("content").alias("content"), F.min("style").alias("style"))
    kinds = once.select("host", "path", F.explode(F.array(F.struct(F.lit(True).alias("is_content"), F.col("content").alias("value")), F.struct(F.lit(False).alias("is_content"), F.col("style").alias("value")))).alias("x"))
    counts = kinds.groupBy("host", "path", "x.is_content", "x.value").agg(F.count("*").cast("double").alias("n"))
    most = F.max(F.when(F.col("is_content"), F.struct("n", "value")))
    total = F.sum(F.when(F.col("is_content"), F.col("n")))
    entropy = F.log2(total) - F.sum(F.when(~F.col("is_content"), F.col("n") * F.log2("n"))) / total
    importance = CONTENT_SHARE * -F.log2(most["n"] / total) + (1 - CONTENT_SHARE) * entropy
    return counts.groupBy("host", "path").agg(most["value"].alias("content"), total.cast("long").alias("pages"), importance.alias("importance"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: float = IMPORTANCE, pages_needed: int = PAGES, lists: bool = True, broadcast: int = BROADCAST) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every page.

    First, contents that the host's style tree finds unimportant go, wherever they stand: those below ``least`` bits, for a
    path of at least ``pages_needed`` different pages; what stands at such a path on the host's other pages
    stays.  Of the rest, the text is that of the article or main element, or else of the page, without what its name,
    role or class mark as menu, header, footer, sidebar, notice, advert, form or comments, which decides where a host has
    few pages or such parts differ from page to page (not if ``lists`` is False).  Character references are decoded,
    white space inside a block becomes one space, and blocks are joined in page order by one line end; nothing
    else is dropped or cut.

    Only what is unimportant travels: it is broadcast if it has at most ``broadcast`` rows; else it meets the pages by host, and
    hosts with very many pages are dealt to many tasks.

    Null html is an empty page with the text ``""``.  Pages without a host in their url share one tree.  Repeated
    rows and null ids keep a row each; an empty table gives an empty result; further columns are not read.
    """
    if least > CONTENT_SHARE * -math.log2(0.5):
        raise ValueError("only the most common content of a path is judged, and another one could be below this")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("host", _host())
    tree = stored(style_tree(rows).where((F.col("pages") >= pages_needed) & (F.col("importance") < least)).select("host", "path", "content"))
    low = tree.groupBy("host").agg(F.collect_set(F.struct("path", "content")).alias("low"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def texts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 200):
                few = part.slice(at, 200)
                out = [main_text(h or "", frozenset((x["path"], x["content"]) for x in found or ()), lists) for h, found in zip(few.column(2).to_pylist(), few.column(3).to_pylist(), strict=True)]
                columns = [few.column(0), few.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    if tree.count() <= broadcast:
        joined = rows.join(F.broadcast(low), "host", "left")
    else:
        sizes = rows.groupBy("host").agg(F.count("*").alias("n"))
        joined = split_join(rows, sizes.join(low, "host", "left"), "host", "n")
    return joined.select("page_id", "url", "html", "low").mapInArrow(texts, f"page_id {kind}, url string, text string, n_chars long")
