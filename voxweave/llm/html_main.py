"""Main text of web pages by tree scoring.

A page is read into a tree. Paragraphs pass points for their length and commas to their ancestors, less with each level;
a container's points are discounted by the share of its text in links. The best container, or the article around it, is
kept with siblings that belong to it, and the text of its blocks is joined in page order. Menus, forms and the like are cut out first,
by element and by the names of classes.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

#: Elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
DROPPED = frozenset("script style noscript template title head nav footer aside form button select option textarea input label fieldset iframe object embed svg canvas audio video dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt"}
PARAGRAPHS = frozenset("p pre blockquote td li dd div section article figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BESIDE = frozenset("p pre ul ol dl table blockquote figure".split())
#: Words of class names and ids that mark what is not part of an article.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments reply replies disqus cookie cookies consent notice notices popup modal overlay share sharing social related recommended newsletter subscribe subscription signup login search pagination pager widget toolbar skip".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_WORD = re.compile(r"[A-Za-z][a-z]+|[A-Z]+")


class Node:
    """An element; ``parts`` holds texts and elements in order."""

    __slots__ = ("tag", "parent", "parts", "dropped", "main", "points", "size", "linked")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.parts = tag, parent, []
        self.dropped = self.main = False
        self.points, self.size, self.linked = 0.0, 0, 0


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _judge(node: Node, tag: str, text: str, in_article: bool) -> None:
    """Whether the element is cut out, or is marked as the main part."""
    node.main = tag in ("article", "main")
    node.dropped = tag in DROPPED or (tag == "header" and not in_article)
    if not text or tag in ("html", "body"):
        return
    found = _attributes(text)
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role") in ROLES or re.search(r"display\s*:\s*none", found.get("style", "")):
        node.dropped = True
    node.main = node.main or found.get("role") == "main" or found.get("itemprop") == "articleBody"
    if not node.main:
        names = {w.lower() for w in _NAME_WORD.findall(f"{found.get('class', '')} {found.get('id', '')}")}
        if names & MARKS and not names & {"article", "content", "main", "post", "body"}:
            node.dropped = True


def parse(page: str) -> Node:
    """The tree of a page. Paragraphs and list items close as in HTML; an end tag without a start is ignored."""
    root = at = Node("html", None)
    depth_of: dict[str, int] = {}
    place, articles = 0, 0

    def close(to: Node) -> None:
        nonlocal at, articles
        while True:
            depth_of[at.tag] -= 1
            articles -= at.tag in ("article", "main")
            done, at = at is to, at.parent
            if done:
                return

    def nearest(tags: tuple[str, ...], stop: frozenset) -> Node | None:
        if not any(depth_of.get(t) for t in tags):
            return None
        x = at
        while x is not root:
            if x.tag in tags:
                return x
            if x.tag in stop:
                return None
            x = x.parent
        return None

    outer = frozenset(("table", "article", "section", "td", "th", "main", "body"))
    lists = frozenset(("ul", "ol", "dl", "table"))
    while True:
        m = _TOKEN.search(page, place)
        end = m.start() if m else len(page)
        if end > place:
            at.parts.append(page[place:end])
        if not m:
            return root
        place = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if depth_of.get(tag):
                x = at
                while x.tag != tag:
                    x = x.parent
                close(x)
            continue
        if tag in CLOSES_P and (x := nearest(("p",), outer)):
            close(x)
        if tag == "li" and (x := nearest(("li",), lists)):
            close(x)
        if tag in ("dd", "dt") and (x := nearest(("dd", "dt"), lists)):
            close(x)
        if tag in ("td", "th", "tr") and (x := nearest(("td", "th") if tag != "tr" else ("tr",), frozenset(("table",)))):
            close(x)
        if tag in ("html", "body", "head") and at is root and tag == "html":
            continue
        node = Node(tag, at)
        attributes = m[3] or m[6] or ""
        _judge(node, tag, attributes, articles > 0)
        at.parts.append(node)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, place)
            node.parts.append(page[place:stop.start() if stop else len(page)])
            place = stop.end() if stop else len(page)
            continue
        at = node
        depth_of[tag] = depth_of.get(tag, 0) + 1
        articles += tag in ("article", "main")


def _walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """Elements that are not cut out, each when it begins (True) and ends (False)."""
    stack: list[tuple[Node, bool]] = [(root, True)]
    while stack:
        node, begins = stack.pop()
        yield node, begins
        if begins:
            stack.append((node, False))
            stack.extend((x, True) for x in reversed(node.parts) if isinstance(x, Node) and not x.dropped)


def score(root: Node) -> Node:
    """Points of all containers; returns the best one."""
    elements = []
    for node, begins in _walk(root):
        if begins:
            elements.append(node)
            continue
        own = "".join(x for x in node.parts if isinstance(x, str))
        shown = len(own) - own.count(" ") if own.strip() else 0
        inner = [x for x in node.parts if isinstance(x, Node) and not x.dropped]
        node.size = shown + sum(x.size for x in inner)
        node.linked = node.size if node.tag == "a" else sum(x.linked for x in inner)
        if node.tag in PARAGRAPHS and node.size and not any(x.tag in BLOCKS and x.size for x in inner):
            commas = own.count(",") + own.count("،") + own.count("、") + sum("".join(y for y in x.parts if isinstance(y, str)).count(",") for x in inner)
            points = (1 + commas + min(node.size / 100, 3)) * (1 - node.linked / node.size)
            up, level = node.parent, 1
            while up is not None and level <= 4:
                up.points += points / (1 if level == 1 else 2 if level == 2 else 3 * (level - 1))
                up, level = up.parent, level + 1
    best, most = root, 0.0
    for node in elements:
        if not node.size or node.tag not in BLOCKS:
            continue
        value = (node.points + (25 if node.main else 0)) * (1 - node.linked / node.size)
        node.points = value
        if value > most:
            best, most = node, value
    return best


def _blocks(nodes: list[Node]) -> list[str]:
    """Texts of blocks in page order, white space folded."""
    out, line = [], []

    def flush() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        if text:
            out.append(text)
        line.clear()

    stack: list = [*reversed(nodes)]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            line.append(x)
        elif x is None:
            flush()
        elif not x.dropped:
            if x.tag == "br":
                line.append(" ")
            block = x.tag in BLOCKS
            if block:
                flush()
                stack.append(None)
            stack.extend(reversed(x.parts))
    flush()
    return out


def _chosen(best: Node) -> list[Node]:
    """The best container, or the article or main part around it, and what belongs to it among its siblings.

    Siblings stay if they score a fifth of the best or more, and as headings, paragraphs, lists, tables and the like with
    few links; a heading after the best stays only if what follows it does. Beside an article or main part only headings
    and articles of a fifth of its text are looked at, as the rest of the page is there.
    """
    x = best
    while x is not None and not (x.main and x.linked < 0.5 * x.size):
        x = x.parent
    best = x or best
    if best.parent is None:
        return [best]
    least = max(10.0, 0.2 * best.points)
    kept, after, follows = [], True, False
    for x in reversed(best.parent.parts):
        if x is best:
            kept.append(x)
            after = False
        elif isinstance(x, Node) and not x.dropped and x.size:
            few = x.linked < 0.25 * x.size
            if x.tag in HEADINGS:
                follows = few and (follows or not after)
            elif best.main:
                follows = few and x.tag == best.tag == "article" and x.size >= 0.2 * best.size
            else:
                follows = x.points >= least or few and x.tag in BESIDE
            if follows:
                kept.append(x)
    return kept[::-1]


def main_text(page: str | None) -> str:
    """The main text of a page: blocks joined by a line break; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    return "\n".join(_blocks(_chosen(score(root))))


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html, ...) -> page_id, url, text, n_chars (code points): one row per input row.

    Null or empty html, and a page without text outside of menus and the like: empty text. If no container has points,
    all that is not cut out is kept. Null or repeated ids and urls: rows are independent. Empty table: no rows. Other
    columns are ignored.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["html"]):
                part = batch.slice(a, b - a)
                texts = [main_text(x) for x in part["html"].to_pylist()]
                yield pa.record_batch({"page_id": part["page_id"], "url": part["url"], "text": pa.array(texts, pa.string()),
                                       "n_chars": pa.array(map(len, texts), pa.int64())})

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
