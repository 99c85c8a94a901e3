"""HTML extraction: boosted trees over the nodes of a page's element tree, decoded along the tree.

A page becomes a tree of elements (end tags that authors leave out are supplied, raw elements hold no markup). Each
element is described by the density of its subtree (text by tags, share of links), the tokens of its class, id and role
attributes, its depth, its siblings, and what holds it. Trees boosted on such features say how likely an element belongs
to the article. Decoding then picks the likeliest consistent choice for the whole page: what lies in a dropped element
is dropped, so no ancestor and descendant contradict each other.

The model is trained here, on pages that `example_page` makes up with their article marked.

Edge cases: null or empty html gives the empty text; text without any tag is one block; a fragment without html and
body keeps the text right at its root with the inline elements in it; where nothing would stay, the likeliest element does,
unless that is unlikely too; unclosed and stray tags, cut-off
pages and raw elements without an end are read as browsers do, in the main, in time linear in the page; repeated rows get a row each; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loam.llm.boosting import Trees, fit
from loam.llm.common import rows_of

PAGES = 1200  #: made-up pages that the model is trained on
SEED = 3
LEAST, SURE = 0.1, 0.55  #: where nothing of a page stays, its likeliest element counts as SURE if it is LEAST or more
# Fixed values of HTML: elements without an end tag, elements that hold text alone, inline elements, elements that end an open p.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe noembed noframes xmp".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: what an opening tag closes first, up to an element that bounds it
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}
NEVER = RAW | set("head select button svg math canvas object audio video datalist".split())  #: text in these is no text of the page

_next = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")  #: where markup begins
_name = re.compile(r"</?[a-zA-Z][^\s/>]*+")
_inside = re.compile(r"[^>\"']*+")
_attribute = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_words = re.compile(r"[a-z]+")
_word = re.compile(r"\w")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    tokens: tuple[str, ...] = ()
    runs: list = field(default_factory=list)  #: (place in page order, text) of text right in this element
    last: int = 0  #: one past the last node of the subtree
    marked: bool = False  #: training pages: the article
    start: int = 0  #: places of its tags; an end tag that is left out counts where it would stand
    end: int = 0


def tokens(page: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, name or text, attributes, end) of texts, start tags ("<") and end tags ("</"); comments and the like fall out.

    Linear in the page: a tag ends at the first > outside of quotes. Quotes that never close are no quotes, and neither
    are any once a tag has run to the end of the page; without a > further on, the rest is text. The receiver may send
    a place to go on from.
    """
    at, n, quoted = 0, len(page), True
    last = {c: page.rfind(c) for c in "\"'>"}
    while at < n:
        m = _next.search(page, at)
        start = m.start() if m else n
        kind = m[0] if m else ""
        if kind[-1:].isalpha() and last[">"] < start:
            start = n
        if start > at:
            yield "", page[at:start], "", start
        if start == n:
            return
        if kind == "<!--":
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else n
        elif kind == "<![CDATA[":
            end = page.find("]]>", start + 9)
            at = end + 3 if end >= 0 else n
        elif kind in ("<!", "<?"):
            end = page.find(">", start)
            at = end + 1 if end >= 0 else n
        else:
            name = _name.match(page, start)
            end = name.end()
            while quoted:
                end = _inside.match(page, end).end()
                if end == n or page[end] == ">":
                    quoted = end < n
                    break
                end = (page.find(page[end], end + 1) if end < last[page[end]] else end) + 1
            if not quoted:
                end = page.find(">", name.end())
            shut = kind.startswith("</")
            at = (yield kind[:-1], name[0][2 if shut else 1 :].lower(), page[name.end() : end], end + 1) or end + 1


class _Stack:
    """The open elements, with the places of each tag's and of the blocks among them."""

    def __init__(self) -> None:
        self.nodes: list[int] = []
        self.tags: list[str] = []
        self.of: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, node: int, tag: str) -> None:
        self.of.setdefault(tag, []).append(len(self.nodes))
        if tag not in INLINE:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def pop(self) -> int:
        tag = self.tags.pop()
        self.of[tag].pop()
        if tag not in INLINE:
            self.blocks.pop()
        return self.nodes.pop()

    def top(self, tags) -> int:
        """The place of the innermost element with one of these tags, or 0 (the page)."""
        return max((self.of[t][-1] for t in tags if self.of.get(t)), default=0)

    def outermost(self, tags, above: int) -> int | None:
        """The place of the outermost element with one of these tags within the one at `above`."""
        places = (self.of.get(t, ()) for t in tags)
        return min((own[k] for own in places if (k := bisect_right(own, above)) < len(own)), default=None)


def parse(page: str | None) -> list[Node]:
    """The elements in page order; node 0 is the page itself. A text's place counts the tags and texts before it.

    Linear in the page but for the elements a tag closes, each of which is closed once.
    """
    nodes = [Node("#page", -1, 0)]
    stack = _Stack()
    stack.push(0, "#page")
    place = 0
    page = page or ""

    def close(upto: int) -> None:
        while len(stack.nodes) > upto:
            node = nodes[stack.pop()]
            node.last, node.end = len(nodes), place

    source, goto = tokens(page), None
    while True:
        try:
            kind, tag, attributes, end = source.send(goto)
        except StopIteration:
            break
        goto = None
        place += 1
        if not kind:
            nodes[stack.nodes[-1]].runs.append((place, tag))
            continue
        if kind == "</":
            at = stack.top((tag,))
            if at and (tag not in INLINE or at > stack.blocks[-1]):  # an inline end tag does not reach out of its block
                close(at)
            continue
        if tag not in INLINE:  # inline elements that were left open end with their block
            if tag in ENDS_P and stack.tags[stack.blocks[-1]] == "p":
                close(stack.blocks[-1])
            while len(stack.nodes) > 1 and stack.tags[-1] in INLINE and stack.tags[-1] != "a":
                close(len(stack.nodes) - 1)
        if tag in CLOSES:
            gone, bound = CLOSES[tag]
            at = stack.outermost(gone, stack.top(bound))
            if at is not None:
                close(at)
        found = {}
        if attributes:
            for name, *values in _attribute.findall(attributes):
                found.setdefault(name.lower(), next((v for v in values if v), ""))
        words = tuple(_words.findall(" ".join(found.get(a, "") for a in ("class", "id", "role", "itemprop", "aria-label")).lower()))
        node = Node(tag, stack.nodes[-1], len(stack.nodes), words, marked="data-truth" in found, start=place, end=place)
        nodes.append(node)
        if tag in RAW:
            over = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, end)
            goto = over.end() if over else len(page)
            node.last = len(nodes)
        elif tag in VOID or attributes.rstrip().endswith("/") and tag in {"path", "circle", "rect", "use", "line", "polygon"}:
            node.last = len(nodes)
        else:
            stack.push(len(nodes) - 1, tag)
    close(0)
    return nodes


@dataclass
class Tables:
    """Smoothed shares of article among training elements with a tag or an attribute token."""

    tags: dict[str, float]
    tokens: dict[str, float]
    middle: float


FEATURES = 25


def describe(nodes: list[Node], t: Tables) -> np.ndarray:
    n = len(nodes)
    text, links, tags, commas = np.zeros(n), np.zeros(n), np.ones(n), np.zeros(n)
    for k, node in enumerate(nodes):
        if node.tag not in NEVER:
            for _, run in node.runs:
                text[k] += len(run)
                commas[k] += run.count(",") + run.count(".")
    own = text.copy()
    depth_below, blocks = np.zeros(n), np.zeros(n)
    for k in range(n - 1, 0, -1):
        node, up = nodes[k], nodes[k].parent
        if node.tag == "a":
            links[k] = text[k]
        text[up] += text[k]
        links[up] += links[k]
        tags[up] += tags[k]
        commas[up] += commas[k]
        blocks[up] += node.tag in ENDS_P
        depth_below[up] = max(depth_below[up], depth_below[k] + 1)
    whole = max(1.0, text[0])
    x = np.zeros((n, FEATURES))
    tag_score = np.array([t.tags.get(node.tag, t.middle) for node in nodes])
    low, high, mean = np.full(n, t.middle), np.full(n, t.middle), np.full(n, t.middle)
    for k, node in enumerate(nodes):
        known = [t.tokens[w] for w in node.tokens if w in t.tokens]
        if known:
            low[k], high[k], mean[k] = min(known), max(known), sum(known) / len(known)
    above_low, above_high, above_tag, above_tag_high = low.copy(), high.copy(), tag_score.copy(), tag_score.copy()
    place, count, same, before = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    children: dict[int, int] = {}
    kinds: dict[tuple[int, str], int] = {}
    for k in range(1, n):
        up = nodes[k].parent
        above_low[k], above_high[k] = min(above_low[k], above_low[up]), max(above_high[k], above_high[up])
        above_tag[k], above_tag_high[k] = min(above_tag[k], above_tag[up]), max(above_tag_high[k], above_tag_high[up])
        place[k] = children.get(up, 0)
        children[up] = children.get(up, 0) + 1
        kinds[up, nodes[k].tag] = kinds.get((up, nodes[k].tag), 0) + 1
    running = 0.0
    for k in range(n):
        before[k] = running
        running += own[k]
        if k:
            count[k], same[k] = children[nodes[k].parent], kinds[nodes[k].parent, nodes[k].tag]
    up = np.array([max(0, node.parent) for node in nodes])
    columns = [np.log1p(text), text / tags, links / np.maximum(text, 1), commas / np.maximum(text, 1), np.log1p(tags), np.log1p(own), own / np.maximum(text, 1), text / whole, before / whole, depth_below, blocks, np.array([node.depth for node in nodes], float), place, count, same / np.maximum(count, 1), tag_score, low, high, mean, above_low, above_high, above_tag, above_tag_high, links[up] / np.maximum(text[up], 1), np.log1p(text[up])]
    for c, column in enumerate(columns):
        x[:, c] = column
    return x


def weights(nodes: list[Node]) -> np.ndarray:
    """How much the choice for an element counts: by the text right in it, of which 400 characters say all."""
    return np.array([0.2 * any(_word.search(r) for _, r in node.runs) + min(400, sum(len(r) for _, r in node.runs)) / 100 for node in nodes])


def encouraged(nodes: list[Node], p: np.ndarray) -> np.ndarray:
    """p for a page of which nothing stays, shifted so that its likeliest element with words does, if that is not unlikely at all."""
    best = max((q for node, q in zip(nodes[1:], p[1:], strict=True) if node.tag not in NEVER and any(_word.search(r) for _, r in node.runs)), default=0.0)
    if not LEAST <= best < SURE:
        return p
    odds = p / np.maximum(1 - p, 1e-9) * (SURE / (1 - SURE)) * (1 - best) / best
    return odds / (1 + odds)


def decode(nodes: list[Node], p: np.ndarray) -> np.ndarray:
    """Which elements stay: the likeliest choice in which an element stays only within elements that stay.

    An element speaks for the text right in it, and one with words a little for itself. Bottom-up: the worth of dropping a subtree, and of keeping its top.
    """
    n = len(nodes)
    p = np.clip(p, 1e-6, 1 - 1e-6)
    weight = weights(nodes)
    drop, keep = weight * np.log(1 - p), weight * np.log(p)
    keep[0] = drop[0] = 0.0
    for k in range(n - 1, 0, -1):
        up = nodes[k].parent
        # An element that only holds kept ones need not be article itself: staying costs it nothing beyond its own text.
        drop[up] += drop[k]
        keep[up] += max(keep[k], drop[k])
    stays = np.zeros(n, bool)
    stays[0] = True
    for k in range(1, n):
        stays[k] = stays[nodes[k].parent] and keep[k] >= drop[k] and nodes[k].tag not in NEVER
    return stays


def root_flow(nodes: list[Node]) -> np.ndarray:
    """Of a fragment (no html, no body) with words right at its root: the root, and the inline elements in its text. Nothing of other pages."""
    flow = np.zeros(len(nodes), bool)
    flow[0] = any(_word.search(html.unescape(run)) for _, run in nodes[0].runs) and not any(node.tag in ("html", "body") for node in nodes)
    for k in range(1, len(nodes)):
        flow[k] = flow[nodes[k].parent] and nodes[k].tag in INLINE
    return flow


def blocks_of(nodes: list[Node], wanted: np.ndarray) -> list[str]:
    """Text blocks of the wanted elements in page order: a block ends where a block element starts or ends."""
    out: list[str] = []
    pieces: list[str] = []
    events: list[tuple[int, str | None]] = []  # (place, text, or None where a block ends)
    for k, node in enumerate(nodes):
        if wanted[k]:
            events += node.runs
        if node.tag == "br":
            events.append((node.start, " "))
        elif node.tag not in INLINE and k:
            events += ((node.start, None), (node.end, None))
    events.sort(key=lambda e: e[0])
    for _, run in [*events, (0, None)]:
        if run is not None:
            pieces.append(run)
        elif pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                out.append(text)
    return out


@dataclass
class Extractor:
    trees: Trees
    tables: Tables

    def texts(self, pages: list[str | None]) -> list[str]:
        parsed = [parse(page) for page in pages]
        if not parsed:
            return []
        p = self.trees.predict(np.concatenate([describe(nodes, self.tables) for nodes in parsed]))
        out, at = [], 0
        for nodes in parsed:
            own = p[at : at + len(nodes)]
            at += len(nodes)
            if len(nodes) == 1:  # no element at all: plain text
                out.append("\n".join(blocks_of(nodes, np.ones(1, bool))))
            else:
                flow = root_flow(nodes)
                own = np.where(flow, 1.0, own)
                stays = decode(nodes, own)
                if not any(stays[k] and any(_word.search(r) for _, r in node.runs) for k, node in enumerate(nodes)):
                    stays = decode(nodes, encouraged(nodes, own))
                # Text outside of html and body lies in the body, as browsers read it.
                stays[0] = flow[0] or any(stays[k] for k, node in enumerate(nodes) if node.tag == "body")
                out.append("\n".join(blocks_of(nodes, stays)))
        return out


def example_page(rng: random.Random) -> str:
    """A made-up page whose article carries data-truth."""
    words = ["".join(rng.choice(["an", "the", "er", "on", "ti", "ou", "sch", "lo", "ra", "é", "mi", "ve"]) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    say = lambda a, b: (" ".join(rng.choice(words) for _ in range(rng.randint(a, b)))).capitalize() + rng.choice([".", ".", ", " + rng.choice(words) + ".", "!", ""])
    prose = lambda a, b: " ".join(say(4, 18) for _ in range(rng.randint(a, b)))
    link = lambda: f'<a href="/{rng.choice(words)}">{say(1, 3)}</a>'
    some = lambda *names: rng.choice(names)

    def attribute(*names: str) -> str:
        return rng.choice(["", f' class="{rng.choice(names)}"', f' class="{rng.choice(names)}"', f' id="{rng.choice(names)}"', f' class="{rng.choice(names)} c{rng.randint(1, 99)}"'])

    def nav() -> str:
        items = "".join(f"<li>{link()}</li>" if rng.random() < 0.9 else f"<li>{say(1, 2)}" for _ in range(rng.randint(2, 9)))
        return some(f"<nav{attribute('menu', 'navbar', 'main nav')}><ul>{items}</ul></nav>", f"<div class=\"{some('menu', 'nav', 'navigation', 'topbar', 'breadcrumb', 'breadcrumbs')}\"><ul>{items}</ul></div>", f"<nav>{' | '.join(link() for _ in range(4))}</nav>")

    def junk() -> str:
        text = some(say(3, 9), prose(1, 3))
        return some(
            f"<div class=\"{some('ad', 'ads', 'advert', 'advertisement', 'banner', 'sponsored', 'promo')}\">{text}</div>",
            f"<div class=\"{some('cookie notice', 'notice', 'cookie banner', 'consent', 'alert', 'popup', 'modal', 'gdpr')}\"><p>{text}</p><button>{say(1, 1)}</button></div>",
            f"<form{attribute('search', 'newsletter', 'subscribe', 'signup')}><label>{say(1, 4)}</label><input type=text><p>{text}</p><select><option>{say(1, 1)}<option>{say(1, 1)}</select></form>",
            f"<div class=\"{some('share', 'social', 'related', 'tags', 'widget', 'recommended', 'more', 'author-box')}\"><h3>{say(1, 3)}</h3><ul>{''.join('<li>' + link() for _ in range(rng.randint(1, 6)))}</ul></div>",
            f"<!-- {text} -->",
            f"<script>var s = \"<p>{text}</p>\"; if (a<b) x();</script>",
            f"<style>p{{margin:{rng.randint(0, 9)}}}</style>",
            f"<noscript><p>{text}</p></noscript>",
        )

    def aside() -> str:
        body = some(f"<h3>{say(1, 3)}</h3><ul>{''.join(f'<li>{link()}</li>' for _ in range(rng.randint(2, 8)))}</ul>", f"<p>{prose(1, 4)}</p>", f"<h4>{say(2, 4)}</h4><p>{prose(1, 2)}</p><p>{link()}</p>")
        return some(f"<aside{attribute('sidebar', 'rail', 'related')}>{body}</aside>", f"<div class=\"{some('sidebar', 'side', 'widget area', 'rail', 'secondary')}\">{body}</div>", f"<div id=\"sidebar\">{body}</div>")

    def comments() -> str:
        items = "".join(some(f"<li class=\"comment\"><b>{say(1, 1)}</b><p>{prose(1, 4)}</p></li>", f"<div class=\"{some('comment', 'reply', 'comment body')}\"><p>{prose(1, 4)}</p></div>", f"<article class=\"comment\"><p>{prose(1, 3)}</p></article>") for _ in range(rng.randint(1, 5)))
        return some(f"<section class=\"{some('comments', 'discussion', 'responses')}\"><h2>{say(1, 2)}</h2>{items}</section>", f"<div id=\"{some('comments', 'disqus', 'respond')}\">{items}</div>", f"<ul class=\"comments\">{items}</ul>", f"<ol class=\"commentlist\">{items}</ol>")

    def paragraph() -> str:
        text = say(2, 7) if short or rng.random() < 0.1 else prose(1, 7)
        if rng.random() < 0.2:
            text += f" {link()} {say(2, 5)}"
        return some(f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<p{attribute('text', 'lead', 'intro', 'paragraph')}>{text}</p>", f"<div>{text}</div>" if rng.random() < 0.3 else f"<p><em>{say(2, 4)}</em> {text}</p>")

    def piece() -> str:
        r = rng.random()
        if r < 0.7:
            return paragraph()
        if r < 0.78:
            return f"<h2>{say(2, 6)}</h2>"
        if r < 0.84:
            return f"<{(k := some('ul', 'ol'))}>" + "".join(f"<li>{say(3, 12)}</li>" for _ in range(rng.randint(2, 6))) + f"</{k}>"
        if r < 0.88:
            return f"<blockquote><p>{prose(1, 3)}</p></blockquote>"
        if r < 0.91:
            return f"<figure><img src=x><figcaption>{say(3, 10)}</figcaption></figure>"
        if r < 0.94:
            return "<table>" + "".join(f"<tr><td>{say(1, 3)}</td><td>{say(1, 3)}</td></tr>" for _ in range(rng.randint(2, 5))) + "</table>"
        if r < 0.96:
            return f"<pre><code>{say(4, 20)}</code></pre>"
        return f"<!--junk-->{junk()}"

    short = rng.random() < 0.15
    heading = f"<h1>{say(1 if short else 2, 9)}</h1>" if rng.random() < 0.9 else ""
    if (bare := rng.random()) < 0.12:  # nothing but an article: in an element, right in the body, or as a fragment
        text = heading + some("".join(paragraph() for _ in range(rng.randint(1, 4))), "<br>".join(say(2, 7) if short else prose(1, 3) for _ in range(rng.randint(1, 4))))
        inner = some(f"<article data-truth>{text}</article>", f"<div data-truth>{text}</div>", f"<main data-truth>{text}</main>")
        return some(inner, f"<html><body>{inner}</body></html>") if bare < 0.06 else f"<html><head><title>{say(2, 9)}</title></head><body data-truth>{text}</body></html>"
    body = heading + "".join(piece() for _ in range(rng.choice([0, 1, 1, 1, 2, 2, 3, 4, 6, 8, 12, 20])))
    article = some(f"<article data-truth{attribute('post', 'entry', 'story')}>{body}</article>", f"<article data-truth>{body}</article>", f"<article data-truth>{body}</article>", f"<main data-truth{attribute('content', 'main')}>{body}</main>", f"<div data-truth class=\"{some('content', 'post', 'entry content', 'article body', 'main', 'story', 'text', 'post body')}\">{body}</div>", f"<div data-truth id=\"{some('content', 'main', 'article', 'story')}\">{body}</div>", f"<section data-truth>{body}</section>", f"<div data-truth>{body}</div>")
    if rng.random() < 0.25:
        article = f"<{(k := some('main', 'div', 'section'))}{attribute('wrap', 'container', 'row', 'page')}>{article}{some('', aside(), comments())}</{k}>"
    header = some("", "", f"<header{attribute('site header', 'masthead', 'top')}><h1>{say(1, 3)}</h1><p>{say(2, 8)}</p>{nav()}</header>", f"<header><p>{say(2, 8)}</p></header>", f"<div class=\"{some('header', 'masthead', 'site title', 'logo', 'topbar')}\"><p>{say(2, 8)}</p></div>")
    footer = some(f"<footer>&copy; {say(3, 12)}</footer>", f"<footer{attribute('site footer', 'bottom')}><p>{prose(1, 2)}</p>{nav()}</footer>", f"<div class=\"{some('footer', 'copyright', 'bottom', 'legal')}\">{say(3, 12)}</div>", "")
    before = [x for x in (header, nav() if rng.random() < 0.8 else "") if x] + [junk() for _ in range(rng.choice([0, 0, 1, 1, 2]))] + ([aside()] if rng.random() < 0.2 else [])
    after = [junk() for _ in range(rng.choice([0, 0, 0, 1, 2]))] + ([aside()] if rng.random() < 0.35 else []) + ([comments()] if rng.random() < 0.35 else []) + [footer]
    rng.shuffle(before)
    tail = "</body></html>" if rng.random() < 0.8 else ""
    return f"<!DOCTYPE html><html lang=\"en\"><head><meta charset=\"utf-8\"><title>{say(2, 9)}</title><style>p{{}}</style></head><body>{''.join(before)}{article}{''.join(after)}{tail}"


def truth(nodes: list[Node]) -> np.ndarray:
    """1 for elements of the article but what is no part of it within: junk follows a comment <!--junk--> in `example_page`, known by tag and token."""
    out = np.zeros(len(nodes), bool)
    for k in range(1, len(nodes)):
        node = nodes[k]
        inside = node.marked or out[node.parent]
        foreign = node.tag in NEVER or node.tag in {"form", "aside", "nav", "footer"} or any(w in JUNK for w in node.tokens)
        out[k] = inside and (node.marked or not foreign)
    return out


#: attribute tokens of what example_page puts into articles without being article
JUNK = set("ad ads advert advertisement banner sponsored promo cookie notice consent alert popup modal gdpr search newsletter subscribe signup share social related tags widget recommended more author box".split())


@cache
def trained(pages: int = PAGES, seed: int = SEED) -> Extractor:
    rng = random.Random(seed)
    parsed = [parse(example_page(rng)) for _ in range(pages)]
    labels = [truth(nodes) for nodes in parsed]
    shares: dict[tuple[str, str], list[int]] = {}
    for nodes, own in zip(parsed, labels, strict=True):
        for node, y in zip(nodes, own, strict=True):
            for key in {("tag", node.tag), *(("token", w) for w in node.tokens)}:
                c = shares.setdefault(key, [0, 0])
                c[0] += int(y)
                c[1] += 1
    y = np.concatenate(labels).astype(float)
    middle = float(y.mean())
    smooth = {key: (c[0] + 3 * middle) / (c[1] + 3) for key, c in shares.items()}
    tables = Tables({k: v for (kind, k), v in smooth.items() if kind == "tag"}, {k: v for (kind, k), v in smooth.items() if kind == "token"}, middle)
    x = np.concatenate([describe(nodes, tables) for nodes in parsed])
    weight = np.concatenate([0.2 + weights(nodes) for nodes in parsed])
    return Extractor(fit(x, y, weight), tables)


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, extractor: Extractor | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""
    model = extractor or trained()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches, text=2):
            texts = model.texts([r[2] for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(work, SCHEMA)
