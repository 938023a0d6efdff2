"""Main text of web pages by minimum cut.

A page becomes a row of text blocks. A classifier (weights below) gives each block a cost for either label from its
place in the tree, its length and its links. Costs are capacities from the source (content) and to the sink
(boilerplate); blocks that stand beside each other or under one parent are tied by smoothness edges, stronger the nearer
they are in the tree. The blocks on the source's side of the minimum cut are the main text.

White space inside a block becomes one space, <br> included; blocks are joined by one newline in page order.
Defined results: null, empty and textless pages give an empty text; broken markup is read as far as it goes, unclosed
scripts, styles and comments to the end; repeated rows give equal rows; an empty table gives an empty result; columns
other than id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

# Element names of HTML by how they are read.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td "
                   "template tfoot th thead tr ul").split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = frozenset("ul ol menu dl table select".split())

# Hints of the tree: elements, roles and words of class and id.
OUTSIDE = frozenset("nav footer aside menu dialog search noscript template button select svg object canvas head".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
OUTSIDE_WORDS = frozenset(("ad ads advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs comment comments commentlist consent cookie "
                           "cookies copyright disclaimer disqus footer gdpr hidden legal login masthead menu modal nav navbar navigation newsletter notice notices "
                           "overlay pager pagination paywall popup privacy promo promotion recommended recommendations related replies reply respond rss share "
                           "sharing sidebar signup skip social sponsor sponsored subscribe subscription toc toolbar widget").split())
INSIDE = frozenset("article main".split())
INSIDE_WORDS = frozenset("article articlebody content entry main post story".split())

# Weights of the classifier, in nats for content, and of the edges.
OUTSIDE_COST, INSIDE_GAIN, FORM_COST = -14.0, 7.0, -8.0
BIAS, PER_WORDS, MOST_WORDS, LINK_COST, SENTENCE_GAIN, HEADING_GAIN = -1.5, 1 / 12, 5.0, -6.0, 0.8, 1.0
EDGE, UNIT = 2.0, 1000

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
                   r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def hint(tag: str, attributes: str, inherited: str) -> str:
    """What an element says of the text in it: "out", "form", "in" or what its parent says."""
    if tag in ("html", "body"):
        return inherited
    words, role = set(), ""
    if attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
                return "out"
            if name == "role":
                role = value.lower()
            elif name in ("class", "id", "itemprop"):
                words.update(w.lower() for w in PIECE.findall(value))
                words.add(value.lower())
    if tag in OUTSIDE or role in OUTSIDE_ROLES or words & OUTSIDE_WORDS:
        return "out"
    if tag == "header" or "header" in words:
        return inherited if inherited == "in" else "out"
    if tag == "form":
        return "form"
    if inherited == "out":
        return "out"
    if tag in INSIDE or role in ("main", "article") or words & INSIDE_WORDS:
        return "in"
    return inherited


HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


class Spot:
    """A block element's place in the tree: the block element around it (None at the top) and its depth from 1."""
    __slots__ = ("parent", "depth")

    def __init__(self, parent: Spot | None):
        self.parent, self.depth = parent, parent.depth + 1 if parent else 1


def distance(p: Spot | None, q: Spot | None, most: int) -> int:
    """Steps between two places in the tree, `most` if there are as many or more."""
    steps = 0
    while p is not q and steps < most:
        if q is None or p is not None and p.depth >= q.depth:
            p = p.parent
        else:
            q = q.parent
        steps += 1
    return steps


class Block:
    __slots__ = ("text", "linked", "hint", "spot", "heading")

    def __init__(self, text, linked, hint, spot, heading):
        self.text, self.linked, self.hint, self.spot, self.heading = text, linked, hint, spot, heading


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order, with the places of the elements they stand in."""
    stack: list[tuple[str, str, Spot | None]] = [("", "", None)]  # name, hint, innermost block element
    open_tags: Counter = Counter()
    found: list[Block] = []
    parts: list[str] = []
    linked, at, end = 0, 0, len(page)

    def close_block():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(text, linked, stack[-1][1], stack[-1][2], any(open_tags[h] > 0 for h in HEADINGS)))
            parts.clear()
        linked = 0

    def pop_to(k):
        for e in stack[k:]:
            open_tags[e[0]] -= 1
        del stack[k:]

    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if m[0][0] != "<" or m[0] == "<":
                text = entities.unescape(m[0])
                parts.append(text)
                if open_tags["a"] > 0:
                    linked += len(text.strip())
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            close_block()
        if closing:
            if open_tags[tag] > 0:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                pop_to(k)
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at) if not attributes.endswith("/") or tag != "iframe" else None
            at = stop.end() if stop else end
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in BLOCK and open_tags["p"] > 0:
            k = len(stack) - 1
            while stack[k][0] != "p" and stack[k][0] not in HOLDERS and stack[k][0] not in ("div", "article", "section"):
                k -= 1
            if stack[k][0] == "p":
                pop_to(k)
        if tag in CLOSED_BY:
            k = len(stack) - 1
            while k > 0 and stack[k][0] not in HOLDERS and stack[k][0] not in CLOSED_BY[tag]:
                k -= 1
            if stack[k][0] in CLOSED_BY[tag]:
                pop_to(k)
        stack.append((tag, hint(tag, attributes, stack[-1][1]), Spot(stack[-1][2]) if tag in BLOCK else stack[-1][2]))
        open_tags[tag] += 1
    close_block()
    return found


def content_nats(b: Block) -> float:
    """How much likelier content than boilerplate a block is by itself."""
    words = b.text.count(" ") + 1
    nats = BIAS + min(words * PER_WORDS, MOST_WORDS) + LINK_COST * min(1.0, b.linked / len(b.text))
    if b.text[-1] in ".!?…\"'”»":
        nats += SENTENCE_GAIN
    if b.heading:
        nats += HEADING_GAIN
    return nats + {"out": OUTSIDE_COST, "in": INSIDE_GAIN, "form": FORM_COST}.get(b.hint, 0.0)


def edges_of(found: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness edges (i, j, capacity): to the block before, and to the last block under the same parent."""
    edges, last = [], {}
    far = math.ceil(UNIT * EDGE)    # beyond so many steps every capacity is 1
    for i, b in enumerate(found):
        near = {i - 1} if i else set()
        parent = b.spot.parent if b.spot else None
        if parent in last:
            near.add(last[parent])
        edges += ((j, i, math.ceil(UNIT * EDGE / max(1, distance(b.spot, found[j].spot, far)))) for j in near)
        last[parent] = i
    return edges


def min_cut(costs: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Nodes on the source's side of a minimum cut: `costs` above 0 are capacities from the source, below 0 to the sink.

    Dinic's algorithm: breadth-first levels, then blocking flows along an explicit path.
    """
    n = len(costs)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a, b, there, back):
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)
    for i, c in enumerate(costs):
        if c > 0:
            edge(source, i, c, 0)
        elif c < 0:
            edge(i, sink, -c, 0)
    for i, j, w in edges:
        edge(i, j, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = [source]
        for v in queue:
            for e in out[v]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if not room[e])
                v = to[path[k] ^ 1]
                del path[k:]
            while turn[v] < len(out[v]):
                e = out[v][turn[v]]
                if room[e] and level[to[e]] == level[v] + 1:
                    break
                turn[v] += 1
            else:
                if v == source:
                    break
                level[v] = -1
                v = to[path.pop() ^ 1]
                continue
            path.append(e)
            v = to[e]


def main_text(page: str | None) -> str:
    found = blocks_of(page or "")
    inside = min_cut([round(UNIT * content_nats(b)) for b in found], edges_of(found))
    return "\n".join(b.text for b, k in zip(found, inside) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    def run(ids, urls, htmls):
        texts = [main_text(h) for h in htmls]
        return ids, urls, texts, list(map(len, texts))
    return map_columns(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), run,
                       "page_id long, url string, text string, n_chars long")
