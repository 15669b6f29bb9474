"""Main text of web pages by composite text density.

A page becomes a tree. What elements or roles say is no article text goes first: scripts, styles, menus, asides, dialogs,
form controls, hidden elements, headers outside an article, footers outside a quotation. All else is left to densities.
For each node, with C characters, T tags, LC characters and LT tags in links, the density is
C / T x log_b(C / LC x T / LT), where the base b = ln(C / (C - LC) x LC + LC_body / C_body x C + e) makes links count more
where the page has many. A block container whose whole class is one of ``WORDS`` (adverts, notices, comments, sidebars and
so on, beside words of layout), and a form, count as links do: all their characters and tags, so their density is zero. The
sum of its children's densities says how much content a node gathers; the node with the largest sum, of those with
blocks in them, holds the article. The smallest density on the path from the body to that node is the threshold: other subtrees
beside that path belong to the article if they reach it. Where a page has no links the logarithm grows with a node's
size, so a subtree also belongs to it if its characters outside links, by tag, reach the smallest such number on the path;
neither bound takes more of an article away the longer it is. Within an article or main element round the node the
threshold is zero, that is, what is more than links and named parts stays, and so do headings; and so it is where the
body itself is the node. Last, subtrees that count as
links by their name, not by being links, are taken out of what was chosen if they fall short of the threshold.

Names that say less, a class with such a word among others, and ids, which are headings' slugs as often, only set a subtree
aside outside articles: it is not searched for the article nor taken in from beside it, but stays where the article has it
within; if the article is the whole body, only what an id with other words sets aside stays, and that if over half of it is
outside links. Headings keep their text whatever their names, paragraphs whatever their id. What holds more than half of
the page's text is neither set aside nor a form; if all is set aside, nothing is.

Blocks are what block elements separate. Character references are decoded, white space in a block becomes one space.
Reading a page takes time in proportion to its length, whatever its tags, quotes and nesting are.

Defined cases: null and empty pages, and pages without text, give an empty string; unclosed, misnested and unknown elements
are closed by their parents; raw text of a script or style without an end runs to the end of the page, and so does a tag
without an end, which is no text; from a tag whose quotes do not end on, quotes hide no ``>``; of nodes that gather
equally much the first on the page is taken, of equally dense neighbours all; numeric references beyond Unicode become
U+FFFD; repeated rows are a row each; an empty table gives an empty result. Whole pages are read, however long. Extra columns
are ignored, those named text or n_chars too.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import table

# Possessive throughout: no input makes them go back.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"([^\s/=>]++)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))?+)?+")
TELLING = re.compile(r"class|id|role|style|hidden", re.I)
SPACE = re.compile(r"\s+")
NOT_LETTER = re.compile(r"[^a-z]+")
REFERENCE = re.compile(r"&#0*+([0-9]*+)(;?)")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = RAW | frozenset("template head nav aside menu dialog button select option optgroup datalist input".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog toolbar".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "option": ("select",)}
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner banners sponsor sponsored promo promos promotion cookie cookies consent gdpr notice notices alert alerts "
    "comment comments commentlist respond disqus replies sidebar sidebars rail menu menus nav navbar navigation navigations breadcrumb breadcrumbs pagination pager footer footers "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login search searchbox popup popups modal overlay toolbar topbar masthead widget widgets skip paywall outbrain taboola".split()
)
#: What stands beside such words in classes made up of them alone.
FRAME = frozenset("area list box block section wrap wrapper container inner outer panel link links item items bar button buttons icon icons post posts article articles left right bottom site".split())
OUTSIDE_ARTICLE = frozenset({"header", "head", "top"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
NEVER = HEADINGS | {"html", "body", "main"}
CONTAINERS = frozenset("div section ul ol dl table details center".split())
#: How much a node's names say.
BY_ID, BY_CLASS, WHOLE, FORM = 1, 2, 3, 4


class Node:
    __slots__ = ("tag", "parent", "drop", "article", "quoted", "chars", "tags", "link_chars", "link_tags", "blocks", "density", "gathered", "keep", "in_link", "children", "named", "linklike", "aside", "at")

    def __init__(self, tag: str, parent: Node | None, drop: bool, named: int = 0) -> None:
        self.tag, self.parent, self.drop, self.named = tag, parent, drop, named
        self.article = tag in ("article", "main") or (parent is not None and parent.article)
        self.quoted = tag in ("blockquote", "figure") or (parent is not None and parent.quoted)
        self.chars = self.tags = self.link_chars = self.link_tags = self.blocks = self.at = 0
        self.density, self.gathered, self.keep, self.children = 0.0, 0.0, False, []
        self.in_link = self.linklike = self.aside = False


def _judged(tag: str, attributes: str, parent: Node) -> tuple[bool, int]:
    """Whether a node is cut off, and how much its names say against it."""
    if parent.drop or tag in DROPPED:
        return True, 0
    if tag == "header" and not parent.article or tag == "footer" and not parent.quoted:
        return True, 0
    named = FORM if tag == "form" else 0
    if not attributes or not TELLING.search(attributes):
        return False, named
    whole_page = tag in ("html", "body", "main")
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden":
            if not whole_page:
                return True, 0
        elif name == "style":
            if not whole_page and re.search(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", value):
                return True, 0
        elif name == "role":
            if not whole_page and value in ROLES:
                return True, 0
            if not whole_page and value == "form":
                named = FORM
        elif name in ("class", "id") and tag not in NEVER and (tag != "p" or name == "class"):
            for one in value.split():
                parts = NOT_LETTER.sub(" ", one).split()
                # What a block has or lacks is not what it is.
                parts = parts[: next((k for k, x in enumerate(parts) if x in ("has", "with", "no", "without")), None)]
                if not WORDS.isdisjoint(parts):
                    if name == "class" and tag in CONTAINERS and WORDS.union(FRAME).issuperset(parts):
                        named = max(named, WHOLE)
                    elif not parent.article:
                        named = max(named, BY_ID if name == "id" and not WORDS.issuperset(parts) else BY_CLASS)
                elif not parent.article and tag != "article" and not OUTSIDE_ARTICLE.isdisjoint(parts):
                    named = max(named, BY_CLASS)
    return False, named


def parse(html: str) -> tuple[list[Node], list[tuple[int, Node, str]]]:
    """Nodes in order of their start, and events in order of the page: (0, node, text), (1, node, '') start, (2, node, '') end."""
    root = Node("#root", None, False)
    nodes, events, stack = [root], [], [root]
    open_at: dict[str, list[int]] = defaultdict(list)  # places in the stack of each tag's open elements
    blocks = [0]  # and of all open blocks

    def close(n: int) -> None:
        while len(stack) > n:
            node = stack.pop()
            open_at[node.tag].pop()
            if blocks[-1] == len(stack):
                blocks.pop()
            events.append((2, node, ""))

    top = lambda tag: open_at[tag][-1] if open_at[tag] else 0
    at, end, strict, sections, no_raw_end = 0, len(html), True, True, set()
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            events.append((0, stack[-1], html[at:]))
            break
        if lt > at:
            events.append((0, stack[-1], html[at:lt]))
        after = html[lt + 1 : lt + 2]
        if html.startswith("<!--", lt):
            stop = lt + 1 if html.startswith((">", "->"), lt + 4) else html.find("-->", lt + 4)
            at = end if stop < 0 else html.find(">", max(stop, lt + 4)) + 1
            continue
        if sections and html.startswith("<![CDATA[", lt):
            stop = html.find("]]>", lt)
            if stop >= 0:
                events.append((0, stack[-1], html[lt + 9 : stop]))
                at = stop + 3
                continue
            sections = False
        letter = html[lt + 2 : lt + 3] if after == "/" else after
        if not ("a" <= letter <= "z" or "A" <= letter <= "Z"):
            if after in ("!", "?", "/"):  # a declaration, or an end of nothing
                stop = html.find(">", lt)
                at = stop + 1 if stop >= 0 else end
            else:
                events.append((0, stack[-1], "<"))
                at = lt + 1
            continue
        m = TAG.match(html, lt) if strict else None
        if m is None:
            strict = False
            m = PLAIN_TAG.match(html, lt)
            if m is None:
                break
        at = m.end()
        tag, attributes = m[2].lower(), m[3]
        if m[1]:
            k = top(tag)
            # An inline end does not close the block it stands in.
            if k and (tag in BLOCK or k > blocks[-1]):
                close(k)
            continue
        if tag in CLOSES_P and blocks[-1] and stack[blocks[-1]].tag == "p":
            close(blocks[-1])
        if tag in CLOSED_BY:
            scope = max(map(top, SCOPE[tag]))
            inner = [x[i] for x in map(open_at.__getitem__, CLOSED_BY[tag]) if (i := bisect_right(x, scope)) < len(x)]
            if inner:
                close(min(inner))
        parent = stack[-1]
        node = Node(tag, parent, *_judged(tag, attributes, parent))
        node.at = len(parent.children)
        nodes.append(node)
        parent.children.append(node)
        events.append((1, node, ""))
        if tag in RAW:
            stop = None if tag in no_raw_end else re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I).search(html, at)
            if stop is None:
                no_raw_end.add(tag)
            at = stop.end() if stop else end
            events.append((2, node, ""))
        elif tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            events.append((2, node, ""))
        else:
            open_at[tag].append(len(stack))
            if tag in BLOCK:
                blocks.append(len(stack))
            stack.append(node)
    close(1)
    return nodes, events


def _names(nodes: list[Node], events: list[tuple[int, Node, str]]) -> None:
    """Sets ``linklike`` on what counts as links by its name, and ``aside`` on what other names set aside."""
    if any(n.named for n in nodes):
        chars = dict.fromkeys(nodes, 0)
        for kind, node, text in events:
            if kind == 0 and not node.drop:
                chars[node] += len(SPACE.sub("", text))
        own = chars.copy()
        for node in reversed(nodes):
            if node.parent is not None:
                chars[node.parent] += chars[node]
        most = lambda n: 2 * chars[n] > chars[nodes[0]]
        for node in nodes[1:]:
            node.linklike = node.parent.linklike or node.named == WHOLE or node.named == FORM and not most(node)
            node.aside = node.parent.aside or node.named in (BY_ID, BY_CLASS) and not most(node)
        if not any(own[n] for n in nodes if not (n.aside or n.linklike)):
            for node in nodes:
                node.aside = False
    for node in nodes[1:]:
        node.in_link = node.parent.in_link or node.tag == "a" or node.linklike


def densities(nodes: list[Node], events: list[tuple[int, Node, str]]) -> None:
    _names(nodes, events)
    for kind, node, text in events:
        if kind == 0 and not node.drop:
            n = len(SPACE.sub("", text))
            node.chars += n
            if node.in_link:
                node.link_chars += n
    for node in reversed(nodes):
        parent = node.parent
        if parent is not None and not node.drop and (parent.aside or not node.aside):
            parent.chars += node.chars
            parent.link_chars += node.link_chars
            parent.tags += node.tags + 1
            parent.link_tags += node.link_tags + (node.tag == "a" or node.linklike)
            parent.blocks += node.blocks + (node.tag in BLOCK and node.chars > 0)
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in nodes:
        if not node.drop and node.chars:
            node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
            if node.parent is not None and (node.parent.aside or not node.aside):
                node.parent.gathered += max(node.density, 0.0)


def density(c: int, t: int, lc: int, lt: int, share: float) -> float:
    """Composite text density; ``share`` is that of the body's characters that are in links."""
    t = max(t, 1)
    base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
    ratio = math.log(c / max(lc, 1) * t / max(lt, 1))
    return c / t * (ratio / math.log(base) if base > 1.0000001 else ratio)


def choose(nodes: list[Node]) -> None:
    """Sets ``keep`` on the roots of the article's subtrees, and ``drop`` on what is taken out of them."""
    scope = [n for n in nodes if n.chars and not n.drop and not n.aside]
    if sum(n.chars for n in scope if n.linklike and not n.parent.linklike) >= nodes[0].chars:
        return  # no text but what its name takes out
    best = max((n for n in scope if n.blocks), key=lambda n: n.gathered, default=None)
    if best is None or best.gathered <= 0:
        best = max(scope, key=lambda n: (n.gathered, n.density))
    path = _path(best)
    on_path, inner = set(path), [n for n in path if n.tag not in ("#root", "html")]
    threshold = min((n.density for n in inner), default=0.0)
    plain = min((_plain(n) for n in inner), default=0.0)
    best.keep = True
    if best.tag in ("#root", "html", "body"):
        for n in next((n for n in nodes if n.tag == "body"), best).children:  # links alone are no article here either
            n.drop = n.drop or (best.chars > best.link_chars and n.density <= 0 and n.tag in BLOCK and n.tag not in HEADINGS and n.chars > 0)
        for n in nodes[1:]:
            n.drop = n.drop or n.parent.drop or (n.aside and not n.parent.aside and (n.named > BY_ID or 2 * n.link_chars > n.chars))
    for n in path[1:]:
        for child in n.children:
            if child in on_path or not child.chars or child.drop or child.aside or child.linklike:
                continue
            if n.article:
                child.keep = child.density > 0 or child.tag in HEADINGS or child.tag == "header"
            else:
                child.keep = child.density >= threshold or _plain(child) >= plain > 0
        if n.tag == "body":
            break
    # Headings stand right before what they head.
    for n in path[:-1]:
        before = n.parent.children[n.at - 1] if n.at else None
        if before is not None and before.tag in ("h1", "h2") and not before.drop:
            before.keep = True
        if n.tag == "body":
            break
    for n in nodes[1:]:
        n.drop = n.drop or n.parent.drop or (n.linklike and (n.density <= 0 or n.density < threshold))


def _plain(node: Node) -> float:
    """Characters outside links by tag."""
    return (node.chars - node.link_chars) / max(node.tags, 1)


def _path(node: Node) -> list[Node]:
    out = []
    at: Node | None = node
    while at is not None:
        out.append(at)
        at = at.parent
    return out


def decoded(text: str) -> str:
    """The text with its character references replaced."""
    if "&#" in text:
        # Digits that no character has: Python would refuse to read thousands of them.
        text = REFERENCE.sub(lambda m: m[0] if not m[1] else f"&#{m[1]}{m[2]}" if len(m[1]) < 8 else "�", text)
    return unescape(text)


def main_text(html: str | None) -> str:
    """The page's main text, a line a block."""
    if not html:
        return ""
    nodes, events = parse(html)
    densities(nodes, events)
    choose(nodes)
    blocks, held, depth = [], [], int(nodes[0].keep)  # the root has no events of its own

    def flush() -> None:
        if held:
            line = SPACE.sub(" ", decoded("".join(held))).strip()
            held.clear()
            if line:
                blocks.append(line)

    for kind, node, text in events:
        if kind == 0:
            if depth and not node.drop:
                held.append(text)
            continue
        if node.tag in BLOCK:
            flush()
        elif node.tag == "br" and kind == 1 and depth:
            held.append(" ")
        if node.keep:
            if kind == 2:
                flush()
            depth += 1 if kind == 1 else -1
    flush()
    return "\n".join(blocks)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["text"] = [main_text(h) for h in batch.pop("html")]
            batch["page_id"] = batch["page_id"].astype("Int64")
            yield batch

    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return slim.mapInPandas(run, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))


def op3_html_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
