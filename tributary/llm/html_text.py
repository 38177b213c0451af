"""Main text of web pages by composite text density.

Every node of the page's tree has a density: its characters by its tags, weighed by how many of both belong to
links. The node whose children's densities add up to most is the core of the text. The least density on its path below the body is the
threshold: at each level of that path, what stands beside the path and reaches it belongs to the text as well, and so do headings, and
what lies between two parts that belong. Beside the path within an ``article`` or ``main``, everything belongs that isn't mostly links.

Word lists only take out beforehand what can't be an article wherever it stands. All steps take time in proportion to the page's length,
whatever its markup: tags that don't end, quotes that don't close, and any depth.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Never text of the article.
DROPPED = frozenset("script style noscript template svg math canvas iframe object embed audio video map select option button input textarea label form fieldset nav aside footer menu dialog head title noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
#: A start tag of the first kind ends an open element of the second, unless one of the third lies between.
P_ENDERS = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "body", "html"}
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
#: Words of a class or an id that mark what is no article: fixed values.
MARKS = frozenset("""
ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner popup modal overlay
nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc footer masthead topbar sidebar aside widget widgets
cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login paywall
comment comments commentlist disqus respond reply replies discussion
share sharing social related recommended recommendations skip copyright
""".split())
#: ARIA roles of the same.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Elements that are never dropped for their marks.
KEPT = frozenset("html body article main h1 h2 h3 h4 h5 h6 p b i em strong span a".split()) - {"span", "a", "p"}

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
WORDS = re.compile(r"[a-z0-9]+")


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "article", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, dropped: bool) -> None:
        self.tag, self.parent, self.dropped = tag, parent, dropped
        #: Whether it is, or is within, an article.
        self.article: bool = tag in ("article", "main") or (parent is not None and parent.article)
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _drops(tag: str, attributes: str, parent: Node) -> bool:
    if tag in DROPPED:
        return True
    at = parent.article
    if tag == "header" and not at:  # of the page; an article has its own
        return True
    if not attributes or attributes.isspace():
        return False
    values = {k.lower(): unescape(v.strip("\"'")).lower() for k, v in ATTRIBUTE.findall(attributes)}
    if "hidden" in values or values.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", "")):
        return tag not in ("html", "body")
    if values.get("role") in ROLES:
        return tag not in ("html", "body")
    if tag in KEPT:
        return False
    words = set(WORDS.findall(f"{values.get('class', '')} {values.get('id', '')}"))
    if "header" in words and not at and words.isdisjoint(("article", "content", "entry", "post", "story")):
        return True
    if not words.isdisjoint(("has", "no", "with")):  # as in "with-sidebar"
        words.discard("sidebar")
    return not MARKS.isdisjoint(words)


class Open:
    """The elements that are open. Where each kind was opened last is known, so none is looked for in vain."""

    def __init__(self, root: Node) -> None:
        self.stack, self.places = [root], {}

    @property
    def now(self) -> Node:
        return self.stack[-1]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, tags) -> int:
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=0)

    def close(self, tags, stops=frozenset()) -> None:
        """Closes the innermost element of these kinds and all within it, unless one of the stops lies between."""
        at = self.last(tags)
        if at and at >= self.last(stops):
            for node in self.stack[at:]:
                self.places[node.tag].pop()
            del self.stack[at:]


class Source:
    """The markup from left to right. What isn't found from a place on isn't looked for again."""

    def __init__(self, html: str) -> None:
        self.html, self.none = html, set()

    def find(self, what: str, at: int) -> int:
        if what in self.none:
            return -1
        if (i := self.html.find(what, at)) < 0:
            self.none.add(what)
        return i

    def tag_end(self, at: int) -> int:
        """The place of the > that ends a tag; quotes count behind = only. -1 if none does."""
        html, end = self.html, self.find(">", at)
        i = at
        while end >= 0:
            i = html.find("=", i, end)
            if i < 0:
                break
            i += 1
            while i < end and html[i].isspace():
                i += 1
            if i < end and html[i] in "\"'":
                if (close := self.find(html[i], i + 1)) < 0:
                    break
                i = close + 1
                if i > end:
                    end = self.find(">", i)
        return end


def parse(html: str) -> Node:
    """The tree of a page; elements that are no article are marked dropped, and their text is left out. A tag that never ends is text."""
    source, root, body = Source(html), Node("html", None, False), False
    opened = Open(root)

    def text(s: str) -> None:
        if s and not opened.now.dropped:
            opened.now.children.append(unescape(s) if "&" in s else s)

    at, begun = 0, 0  # what is read, and what of it is text from where on
    while (i := source.find("<", at)) >= 0:
        mark = html[i + 1 : i + 2]
        name = NAME.match(html, i + 2 if mark == "/" else i + 1)
        if html.startswith("<!--", i):
            end = source.find("-->", i + 4)
            end = len(html) if end < 0 else end + 3
        elif name:
            end = source.tag_end(name.end()) + 1
        elif mark in ("!", "?", "/") and mark:
            end = source.find(">", i) + 1
        else:
            at = i + 1
            continue
        if not end:  # no tag, as it never ends
            at = i + 1
            continue
        text(html[begun:i])
        at = begun = end
        tag = name[0].lower() if name else ""
        if mark == "/":
            if tag == "br":
                text(" ")
            elif tag and tag not in ("body", "html"):
                opened.close({tag}, ("body",) if tag in BLOCK else [t for t in ("td", "th", "table", "article", "body") if t != tag])
        elif name and tag in ("html", "body"):
            if tag == "body" and not body:
                del opened.stack[1:]
                opened.places.clear()
                node, body = Node("body", root, False), True
                root.children.append(node)
                opened.push(node)
        elif name:
            attributes = html[name.end() : end - 1]
            if tag in P_ENDERS:
                opened.close({"p"}, ("table", "td", "th", "button", "body", "article", "section", "div", "blockquote", "li"))
            if tag in ENDS:
                opened.close(*ENDS[tag])
            now = opened.now
            node = Node(tag, now, now.dropped or _drops(tag, attributes, now))
            now.children.append(node)
            if tag == "br":
                text(" ")
            elif tag in RAW:
                found = re.compile(rf"</{tag}(?=[\s/>]|$)[^>]*>?", re.I).search(html, at)
                if tag == "textarea" and not node.dropped:
                    node.children.append(unescape(html[at : found.start() if found else len(html)]))
                at = begun = found.end() if found else len(html)
            elif tag not in VOID and not (attributes.endswith("/") and tag not in BLOCK):
                opened.push(node)
    text(html[begun:])
    return root


def _order(root: Node) -> list[Node]:
    """Every kept node, parents first."""
    out, todo = [], [root]
    while todo:
        out.append(x := todo.pop())
        todo += [c for c in reversed(x.children) if isinstance(c, Node) and not c.dropped]
    return out


def measure(root: Node) -> list[Node]:
    """Sets density and total, the children's sum, of every kept node."""
    nodes = _order(root)
    for x in reversed(nodes):
        for c in x.children:
            if isinstance(c, str):
                x.chars += len("".join(c.split()))
            elif not c.dropped:
                x.chars += c.chars
                x.tags += c.tags + 1
                x.link_chars += c.link_chars
                x.link_tags += c.link_tags + (c.tag == "a")
        if x.tag == "a":
            x.link_chars, x.link_tags = x.chars, x.tags
    body = nodes[0]
    share = body.link_chars / body.chars if body.chars else 0.0
    for x in reversed(nodes):
        if x.chars:
            c, t, lc, lt = x.chars, max(x.tags, 1), x.link_chars, x.link_tags
            base = math.log(c * lc / max(c - lc, 1) + share * c + math.e)
            x.density = c / t * math.log(max(c * t / (max(lc, 1) * max(lt, 1)), 1.0)) / base
        inside = [k.density for k in x.children if isinstance(k, Node) and not k.dropped]
        x.total = sum(inside) if inside else x.density
    return nodes


def content(root: Node) -> list[Node | str]:
    """What belongs to the article, in page order: the subtree of the largest sum, and what reaches the threshold of its path to the body."""
    body = next((x for x in root.children if isinstance(x, Node) and x.tag == "body"), root)
    nodes = [x for x in measure(body) if x.chars]
    if not nodes:
        return []
    core = max(nodes, key=lambda x: x.total)
    path, x = [], core
    while x is not None:
        path.append(x)
        x = None if x is body else x.parent
    least = min(x.density for x in path if x is not body or x is core)  # the body's own counts menus, too

    def text_alone(c: Node | str) -> bool:
        return bool(c.strip()) if isinstance(c, str) else not c.dropped and 0 < c.chars > 2 * c.link_chars

    def dense(c: Node | str) -> bool:
        if isinstance(c, str):
            n = len("".join(c.split()))
            return n > 0 and n * math.log(n) >= least
        return text_alone(c) and (c.density >= least or c.tag in HEADINGS)

    def beside(side: list[Node | str], whole: bool) -> list[Node | str]:
        """Of what stands on one side of the path, nearest first."""
        last = len(side) if whole else max((k + 1 for k, c in enumerate(side) if dense(c)), default=0)
        return [c for c in side[:last] if text_alone(c)]

    before: list[Node | str] = []
    after: list[Node | str] = []
    for inner, outer in zip(path, path[1:]):
        i = next(k for k, c in enumerate(outer.children) if c is inner)
        before += beside(outer.children[:i][::-1], outer.article)
        after += beside(outer.children[i + 1 :], outer.article)
    return [*reversed(before), core, *after]


def blocks(parts: list[Node | str]) -> list[str]:
    """The text of each block: white space, line breaks among it, is one space."""
    out: list[str] = []
    run: list[str] = []

    def cut() -> None:
        if run:
            if line := " ".join("".join(run).split()):
                out.append(line)
            run.clear()

    todo: list[Node | str | None] = [*reversed(parts)]
    while todo:
        x = todo.pop()
        if x is None:
            cut()
        elif isinstance(x, str):
            run.append(x)
        elif not x.dropped:
            if x.tag in BLOCK:
                cut()
                todo.append(None)
            todo += reversed(x.children)
    cut()
    return out


def main_text(html: str | None) -> str:
    return "\n".join(blocks(content(parse(html)))) if html else ""


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each page. Null or empty html, and pages of nothing but markup, give an empty text.

    No page is dropped, none is cut; equal pages give equal rows; an empty table gives none. Nothing is shuffled.
    Time and memory are in proportion to a page's length, however deep or broken its markup; of equal sums of densities the first node's counts.
    Null ids and addresses stay null. Other columns are not read, whatever their names.
    """
    small_batches(pages.sparkSession, 500)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(x) for x in batch["html"].tolist()]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": [len(x) for x in texts]})

    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html")).mapInPandas(run, "page_id long, url string, text string, n_chars long")
