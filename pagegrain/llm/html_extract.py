"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded along the tree.

The trees are trained here on pages that a small generator writes, where every node's
label is known.  Each block element has features of its subtree (text, links, tags),
its place and siblings, and the hashed tokens of its attributes and of those around it.  Decoding maximises the sum of
the nodes' log-odds, weighted by their own text, over the choices keep all, drop
all or go into the children; so no node is kept under a dropped ancestor."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names by role.
SKIPPED = set("script style button input select textarea option noscript template iframe svg canvas object head title".split())
RAW = set("script style title textarea iframe".split())  # up to their own end tag nothing within is markup
UNENDED = {"script", "style"}
IN_HEAD = set("html head base basefont bgsound link meta title noscript noframes style script template".split())
INLINE = set("a abbr b bdi bdo cite code data dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var wbr del big label img br".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
TAGS = ["article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "nav", "header", "footer", "aside", "blockquote", "pre", "table", "td", "figure", "dl", "form"]
TOKEN = re.compile(r"[a-z]+")
AT_ONCE = 4096  # nodes whose features are held at once, or those of one page
SLOTS = 64  # features that attribute tokens are hashed into


class Node:
    __slots__ = ("tag", "parent", "children", "runs", "tokens", "links", "own", "depth", "total", "linked", "nodes", "place", "before")

    def __init__(self, tag, parent, tokens):
        self.tag, self.parent, self.tokens = tag, parent, tokens
        self.children, self.runs = [], []  # runs: texts, and children in page order
        self.links = self.own = self.total = self.linked = self.nodes = self.before = 0
        self.place = len(parent.children) if parent else 0
        self.depth = parent.depth + 1 if parent else 0


class Events(HTMLParser):
    """A page's start tags (tag, attributes), end tags (tag, None) and texts ("", text) in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple] = []

    def handle_starttag(self, tag, attrs):
        self.found.append((tag, attrs))

    def handle_endtag(self, tag):
        self.found.append((tag, None))

    def handle_data(self, data):
        self.found.append(("", data))


def slot(token: str) -> int:
    """The feature of an attribute token: of its first letters, so that forms of a word meet."""
    return zlib.crc32(token[:6].encode()) % SLOTS


def skips(events: list[tuple]) -> dict[int, int]:
    """First and last event of what is left out: elements in SKIPPED that their own end tag closes.

    One without it is no reason to leave anything out, but that a head ends where the page's
    body begins, an option where the next one begins or an element around it ends, and
    that the parser reads a script or style without end up to the end of the page.  An end
    tag that comes after an element around it has ended counts as its own up to there."""
    out: dict[int, int] = {}
    ends: dict[str, list[int]] = {t: [] for t in RAW}
    for i in range(len(events) - 1, -1, -1):
        if events[i][1] is None and events[i][0] in RAW:
            ends[events[i][0]].append(i)
    stack: list[tuple[str, int]] = []  # open elements
    count: Counter = Counter()
    late: dict[str, tuple[int, int]] = {}

    def pop() -> tuple[str, int]:
        count[stack[-1][0]] -= 1
        return stack.pop()

    def close_head(i: int) -> None:
        while (last := pop())[0] != "head":
            pass
        out[last[1]] = i - 1

    i = -1
    while (i := i + 1) < len(events):
        tag, held = events[i]
        if tag == "":
            if stack and stack[-1][0] == "head" and held.strip():
                close_head(i)
        elif held is None:
            if not count[tag]:
                if tag in late:
                    first, last = late.pop(tag)
                    out[first] = last
                continue
            while stack[-1][0] != tag:
                name, first = pop()
                if name == "option":
                    out[first] = i - 1
                elif name in SKIPPED:
                    late[name] = first, i - 1
            name, first = pop()
            if name in SKIPPED:
                out[first] = i
        else:
            if count["head"] and (tag == "body" or (stack[-1][0] == "head" and tag not in IN_HEAD)):
                close_head(i)
            if tag in RAW:
                while ends[tag] and ends[tag][-1] < i:
                    ends[tag].pop()
                if ends[tag]:
                    out[i] = i = ends[tag].pop()
                elif tag in UNENDED:
                    out[i] = i = len(events) - 1
            elif tag not in VOID and tag not in INLINE:
                if stack and (stack[-1][0] == "p" or stack[-1][0] == tag == "option"):
                    name, first = pop()
                    if name == "option":
                        out[first] = i - 1
                stack.append((tag, i))
                count[tag] += 1
    return out


class Dom:
    """A tree of block elements; inline elements' text belongs to the block around them."""

    def __init__(self):
        self.root = self.at = Node("root", None, frozenset())
        self.anchors = 0
        self.open: dict[str, list[Node]] = {}  # open elements of each name, the innermost last

    def leave(self, node: Node) -> None:
        """Close a node and all open ones within it."""
        while self.at is not node.parent:
            self.open[self.at.tag].pop()
            self.at = self.at.parent
        self.anchors = 0

    def feed(self, html: str) -> None:
        """A whole page."""
        parser = Events()
        parser.feed(html)
        parser.close()
        gone, i = skips(parser.found), 0
        while i < len(parser.found):
            tag, held = parser.found[i]
            if i in gone:
                i = gone[i]
            elif tag == "":
                self.handle_data(held)
            elif held is None:
                self.handle_endtag(tag)
            else:
                self.handle_starttag(tag, held)
            i += 1

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.at.runs.append(" ")
            return
        if tag in INLINE:
            if tag == "br":
                self.at.runs.append(" ")
            self.anchors += tag == "a"
            return
        if tag in ("html", "body"):
            return
        if tag in VOID:
            return
        self.anchors = 0
        if self.at.tag == "p":  # a block ends an open paragraph
            self.leave(self.at)
        if tag in CLOSES:
            stop = max((held[-1].depth for t in STOPS[tag] if (held := self.open.get(t))), default=0)
            inner = [held[-1] for t in CLOSES[tag] if (held := self.open.get(t)) and held[-1].depth > stop]
            while inner:
                self.leave(min(inner, key=lambda n: n.depth))
                inner = [held[-1] for t in CLOSES[tag] if (held := self.open.get(t)) and held[-1].depth > stop]
        words = frozenset(slot(w) for name, value in attrs if value and name in ("class", "id", "role", "itemprop", "aria-label") for w in TOKEN.findall(value.lower()))
        node = Node(tag, self.at, words)
        self.at.children.append(node)
        self.at.runs.append(node)
        self.open.setdefault(tag, []).append(node)
        self.at = node

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.at.runs.append(" ")
            return
        if tag in INLINE:
            self.anchors = max(0, self.anchors - (tag == "a"))
            return
        if held := self.open.get(tag):
            self.leave(held[-1])

    def handle_data(self, data):
        self.at.runs.append(data)
        size = len(data.strip())
        self.at.own += size
        if self.anchors:
            self.at.links += size


def parse(html: str) -> Node:
    dom = Dom()
    dom.feed(html)
    return dom.root


def nodes_of(root: Node) -> list[Node]:
    """All nodes, parents first; subtree sums, and how much text begins before a node, are filled in."""
    out, todo, seen = [], [root], 0
    while todo:
        node = todo.pop()
        out.append(node)
        node.before = seen
        seen += node.own
        todo += reversed(node.children)
    for node in reversed(out):
        node.total, node.linked, node.nodes = node.own, node.links, 1
        for c in node.children:
            node.total += c.total
            node.linked += c.linked
            node.nodes += c.nodes
    return out


TRUST = 0.3  # of a container's log-odds, where they are positive, count for each block in it
FORMS = 15  # features before those of names and tokens


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node: subtree and siblings, the element's name and that of the nearest named
    ancestors, and the hashed tokens of its own attributes and of those around it."""
    whole = max(1, nodes[0].total)
    out = np.zeros((len(nodes), FORMS + 2 * (len(TAGS) + SLOTS)), np.float32)
    tags = {id(n): Counter(c.tag for c in n.children) for n in nodes if n.children}
    at = {id(n): i for i, n in enumerate(nodes)}
    own, over = FORMS, FORMS + len(TAGS) + SLOTS
    for i, node in enumerate(nodes):
        up, total = node.parent, max(1, node.total)
        place, same = (len(up.children), tags[id(up)][node.tag]) if up else (0, 0)
        out[i, :FORMS] = (
            node.own, node.total, node.total / whole, node.linked / total, node.total / node.nodes, node.nodes, node.depth, len(node.children), place, same,
            node.total / max(1, up.total) if up else 1, (up.linked / max(1, up.total)) if up else 0, node.place, node.before / whole, node.own / total,
        )
        if up:
            out[i, over:] = np.maximum(out[at[id(up)], own:over], out[at[id(up)], over:])
        if node.tag in TAGS:
            out[i, own + TAGS.index(node.tag)] = 1
        for k in node.tokens:
            out[i, own + len(TAGS) + k] = 1
    return out


class Boosted:
    """Binary log-loss boosting of small regression trees on quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 5, rate: float = 0.3, bins: int = 32):
        flags = np.flatnonzero(((x == 0) | (x == 1)).all(0))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        for f in flags:
            self.edges[f] = np.array([0.5])
        codes, two = self._codes(x, range(x.shape[1])), x[:, flags].astype(np.float64)
        self.bias, self.rate, self.depth = float(np.log(y.mean() / (1 - y.mean()))), rate, depth
        score, self.trees = np.full(len(y), self.bias), []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, p * (1 - p)
            leaf = np.zeros(len(y), np.int64)
            splits = []
            for level in range(depth):
                count = 1 << level
                best_gain, best = np.zeros(count), np.tile([0, bins], (count, 1))
                every = np.arange(count)
                for f in np.setdiff1d(np.arange(x.shape[1]), flags):
                    key = leaf * (bins + 1) + codes[:, f]
                    g = np.cumsum(np.bincount(key, gradient, count * (bins + 1)).reshape(count, -1), 1)
                    h = np.cumsum(np.bincount(key, weight, count * (bins + 1)).reshape(count, -1), 1)
                    gain = g**2 / (h + 1) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                    at = gain.argmax(1)
                    better = gain[every, at] > best_gain + 1e-9
                    best[better] = np.stack([np.full(count, f), at], 1)[better]
                    best_gain = np.maximum(best_gain, gain[every, at])
                # flags: one product gives the sums of all of them, where they are set
                there = (leaf[:, None] == every[None, :]).astype(np.float64)
                all_g, all_h = gradient @ there, weight @ there
                g, h = two.T @ (there * gradient[:, None]), two.T @ (there * weight[:, None])
                gain = g**2 / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g**2 / (all_h + 1)
                if len(flags):
                    at = gain.argmax(0)
                    better = gain[at, every] > best_gain + 1e-9
                    best[better] = np.stack([flags[at], np.zeros(count, np.int64)], 1)[better]
                splits.append(best)
                leaf = 2 * leaf + (codes[np.arange(len(y)), best[leaf, 0]] > best[leaf, 1])
            g, h = np.bincount(leaf, gradient, 1 << depth), np.bincount(leaf, weight, 1 << depth)
            value = rate * g / (h + 1)
            score += value[leaf]
            self.trees.append((splits, value))
        # only the features that trees ask for are coded from now on
        used = np.unique(np.concatenate([best[:, 0] for splits, _ in self.trees for best in splits]))
        self.used = used
        self.trees = [([np.stack([np.searchsorted(used, best[:, 0]), best[:, 1]], 1) for best in splits], value) for splits, value in self.trees]

    def _codes(self, x: np.ndarray, columns) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[f], x[:, f], "left") for f in columns], 1).astype(np.int16)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        codes, score, row = self._codes(x, self.used), np.full(len(x), self.bias), np.arange(len(x))
        for splits, value in self.trees:
            leaf = np.zeros(len(x), np.int64)
            for best in splits:
                leaf = 2 * leaf + (codes[row, best[leaf, 0]] > best[leaf, 1])
            score += value[leaf]
        return np.clip(score, -6, 6)


#: Attribute values as pages have them, for the training pages: of main parts, of side parts, and of either.
MAIN_NAMES = "article article-body content main-content main post post-content post-body story story-body entry entry-content text body-text page-content prose markdown".split()
SIDE_NAMES = {
    "nav": "nav navbar navigation menu main-menu breadcrumb breadcrumbs pagination toolbar tabs".split(),
    "header": "header masthead topbar site-header banner brand".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promo-banner".split(),
    "aside": "sidebar aside side related related-posts share social widget tags trending".split(),
    "notice": "cookie cookie-notice consent notice alert popup modal newsletter subscribe signup login".split(),
    "form": "search search-form contact contact-form login-form signup-form subscribe-form".split(),
    "comments": "comments comment-list discussion discuss thread disqus replies responses respond talkback feedback".split(),
    "footer": "footer site-footer copyright legal colophon disclaimer".split(),
}
EITHER = "wrap wrapper container row col inner box block section group layout page site clearfix with-sidebar has-sidebar comment-enabled comments-open menu-open no-ads ad-free has-footer sticky-header".split()


def written_page(rng: random.Random) -> str:
    """A page whose boilerplate elements carry data-x, for training only.

    Names are missing, wrong for a wrapper or shared by both kinds in many pages, and elements
    are left open, so that the tree's shape has to decide together with them."""
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(80)]
    named, broken = rng.random(), rng.random() < 0.15

    def text(a: int, b: int) -> str:
        return " ".join(rng.choices(words, k=rng.randint(a, b)))

    def attrs(names: list[str], share: float = 0.85) -> str:
        if rng.random() > share * (0.4 + 0.6 * (named > 0.15)):
            return f' class="{" ".join(rng.sample(EITHER, rng.randint(1, 2)))}"' if rng.random() < 0.5 else ""
        more = rng.choice(EITHER) if rng.random() < 0.2 else ""
        return f' {rng.choice(("class", "class", "id"))}="{rng.choice(names)} {more}"'

    def links(n: int) -> str:
        item = rng.choice(("<li><a href='/{0}'>{1}</a></li>", "<li><a href='/{0}'>{1}</a>", "<a href='/{0}'>{1}</a> | "))
        return "<ul>" + "".join(item.format(i, text(1, 4)) for i in range(n)) + "</ul>"

    def side(kind: str) -> str:
        tag = {"nav": "nav", "header": "header", "aside": "aside", "footer": "footer", "comments": "section", "form": "form"}.get(kind, "div")
        tag = tag if kind == "form" or rng.random() < 0.6 else "div"
        name = attrs(SIDE_NAMES[kind], 0.95 if tag == "div" else 0.5)
        told = tag in ("footer", "aside") or any(n in name for n in SIDE_NAMES[kind])  # else its paragraphs could be the article's
        thread = rng.choice(('<div class="comment"><p>{}</p></div>', '<div class="reply"><p>{}</p></div>', '<div class="user-post"><p>{}</p></div>', *(("<div>{}</div>", "<div><p>{}</p></div>") * told)))
        body = {
            "nav": lambda: links(rng.randint(2, 12)),
            "header": lambda: f"<p>{text(1, 8)}</p>{links(rng.randint(0, 6))}",
            "ad": lambda: rng.choice((text(2, 40), f"<p>{text(2, 30)}</p>", f"<a href=x>{text(2, 12)}</a>")),
            "aside": lambda: f"<h3>{text(1, 4)}</h3><p>{text(2, 40)}</p>{links(rng.randint(0, 6))}",
            "notice": lambda: f"<p>{text(4, 40)}</p>",
            "form": lambda: f"<label>{text(1, 5)}</label><input name=q>" + rng.choice(("", f"<p>{text(2, 25)}</p>", f"<div>{text(1, 8)}</div>")) + "<button>ok</button>",
            "footer": lambda: rng.choice((f"&copy; {text(2, 20)}", f"<p>{text(2, 20)}</p>{links(3)}", f"<p>&copy; 20{rng.randint(10, 30)} {text(1, 6)}</p>", "".join(f"<p>{text(5, 60)}</p>" for _ in range(rng.randint(1, 4))) if tag == "footer" else f"&copy; {text(5, 30)}")),
            "comments": lambda: (f"<h3>{text(1, 3)}</h3>" if rng.random() < 0.7 else "") + "".join(thread.format(text(2, 60)) for _ in range(rng.randint(1, 6))),
        }[kind]()
        return f"<{tag} data-x=1{name}>{body}</{tag}>"

    def block() -> str:
        return rng.choice(
            [f"<p>{text(1, 120)}</p>"] * 6
            + [f"<h2>{text(1, 6)}</h2>", f"<blockquote><p>{text(5, 40)}</p></blockquote>", f"<ul><li>{text(2, 20)}</li><li>{text(2, 20)}</li></ul>", f"<p><b>{text(2, 30)}<br>", f"<p>{text(5, 30)} <a href=x>{text(1, 4)}</a> {text(5, 30)}</p>"]
            + [f"<div>{text(8, 60)}</div>", f"<pre>{text(3, 30)}</pre>", f"<table><tr><td>{text(1, 5)}<td>{text(1, 9)}<tr><td>{text(1, 5)}<td>{text(1, 9)}</table>", f"<p>{text(2, 40)}"]
        )

    def parts(kinds: list[str], most: int) -> str:
        return "".join(side(rng.choice(kinds)) for _ in range(rng.randint(0, most)))

    before, within, after = ["nav", "header", "ad", "aside", "notice", "form"], ["aside", "ad", "notice", "form"], ["nav", "ad", "aside", "notice", "comments", "form"]
    def bare() -> str:
        """Main text in its container itself: lines, or a few long stretches."""
        stretch = [text(5, 120) for _ in range(rng.randint(1, 12))]
        return rng.choice(("<br><br>", "<br>", "<br><br><b>" + text(1, 4) + "</b><br>", "\n")).join(stretch)

    form = rng.random()  # most pages have blocks, some bare text, preformatted text or lists of links as what they are about
    title = f"<h1>{text(2, 12)}</h1>" if rng.random() < 0.9 else ""
    if form < 0.7:
        body = title + "".join(block() if rng.random() > 0.08 else side(rng.choice(within)) for _ in range(rng.randint(1, 25)))
    elif form < 0.86:
        body = (title if rng.random() < 0.6 else "") + bare() + "".join(side(rng.choice(within)) + bare() for _ in range(rng.choice((0, 0, 1, 2))))
    elif form < 0.92:
        body = (title if rng.random() < 0.6 else "") + f"<pre>{text(10, 300)}</pre>"
    else:
        body = f"<h1>{text(2, 12)}</h1>" + (f"<p>{text(4, 40)}</p>" if rng.random() < 0.6 else "") + links(rng.randint(4, 15))
    body += side("comments") if rng.random() < 0.25 else ""
    tag = rng.choice(["article"] * 4 + ["main", "div", "div", "div", "section"])
    if form >= 0.92:  # a list of links is content where the page says so
        tag = rng.choice(("article", "article", "main"))
    body = f"<{tag}{attrs(MAIN_NAMES, 0.35 if tag == 'article' else 0.85)}>{body}</{tag}>"
    if rng.random() < 0.06:  # a layout by table cells
        cell = lambda inside: f"<td{attrs(SIDE_NAMES['nav'], 0.4)} data-x=1>{inside}</td>"
        body = f"<table><tr>{cell(links(rng.randint(2, 9)) if rng.random() < 0.5 else ' '.join(f'<a href=/{i}>{text(1, 2)}</a>' for i in range(rng.randint(2, 9))))}<td>{body}</td>{cell(text(2, 25)) if rng.random() < 0.3 else ''}</tr></table>"
    for _ in range(rng.choice((0, 0, 1, 1, 2, 5, 12))):
        body = f'<div class="{" ".join(rng.sample(EITHER, rng.randint(1, 3)))}">{parts(before, 1)}{body}{parts(after, 1)}</div>'
    page = f"{parts(before, 4)}{body}{parts(after, 3)}{side('footer') if rng.random() < 0.8 else ''}"
    if rng.random() < 0.07:  # nothing but text, with or without markup in it
        page = rng.choice((text(20, 400), bare(), f"<pre>{text(20, 300)}</pre>", f"{title}{bare()}", f"<p>{text(20, 90)}</p>"))
        page = (parts(before, 1) if rng.random() < 0.3 else "") + page
    if rng.random() < 0.1:
        page = f"<form>{page}</form>"
    if broken:
        page = page.replace("</p>", "").replace("</li>", "")
    return f"<!DOCTYPE html><html><head><title>{text(2, 9)}</title></head><body>{page}</body></html>"


class _Marked(Dom):
    def handle_starttag(self, tag, attrs):
        before = self.at
        super().handle_starttag(tag, attrs)
        if self.at is not before and any(k == "data-x" for k, _ in attrs):
            self.at.tokens |= {-1}


def trained(pages: int = 700, seed: int = 5) -> Boosted:
    """A model from so many generated pages."""
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        dom = _Marked()
        dom.feed(written_page(rng))
        nodes = nodes_of(dom.root)
        side: dict[int, bool] = {}
        for n in nodes:
            side[id(n)] = -1 in n.tokens or (n.parent is not None and side[id(n.parent)])
        for n in nodes:
            n.tokens -= {-1}
        mixed: dict[int, bool] = {}  # main nodes around side ones: neither label is theirs
        for n in reversed(nodes):
            mixed[id(n)] = any(mixed[id(c)] or (c.total and side[id(c)]) for c in n.children)
        keep = [i for i, n in enumerate(nodes) if n.total and (n.own or side[id(n)] or not mixed[id(n)])]
        xs.append(features(nodes)[keep])
        ys += [0.0 if side[id(nodes[i])] else 1.0 for i in keep]
    return Boosted(np.concatenate(xs), np.array(ys))


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """Which nodes' own text stays: the best consistent choice over the tree."""
    at = {id(n): i for i, n in enumerate(nodes)}
    weight = np.array([n.own ** 0.5 if n.own else 0.0 for n in nodes])
    # in a container that is likely main text a block is given the benefit of the doubt
    trust = np.array([TRUST * max(0.0, float(odds[at[id(n.parent)]])) if n.parent else 0.0 for n in nodes])
    odds = np.clip(odds + trust * (odds > -6), -6, 6)
    gain = odds * np.where(weight > 0, weight, 0.0)
    keep_all, best, choice = gain.copy(), np.zeros(len(nodes)), [0] * len(nodes)
    inner = [0.0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        kids = [at[id(c)] for c in nodes[i].children]
        keep_all[i] += sum(keep_all[k] for k in kids)
        inner[i] = max(gain[i], 0.0) + sum(best[k] for k in kids)
        lean = 0.5 * odds[i] if nodes[i].parent else 0.0  # a container's own odds decide near ties
        options = (0.0 - lean, keep_all[i] + lean, inner[i])
        choice[i] = int(np.argmax(options))
        best[i] = options[choice[i]]
    said, out = {}, []
    for i, n in enumerate(nodes):
        up = said.get(id(n.parent), 2) if n.parent else 2
        own = up if up != 2 else choice[i]
        said[id(n)] = own
        out.append(own == 1 or (own == 2 and bool(gain[i] > 0)))
    return out


def main_text(nodes: list[Node], keep: list[bool]) -> str:
    """Blocks in page order, white space as one space, joined by one newline."""
    kept = {id(n) for n, k in zip(nodes, keep, strict=True) if k}
    out, held = [], []

    def flush():
        if block := " ".join("".join(held).split()):
            out.append(block)
        held.clear()

    todo = [(nodes[0], iter(nodes[0].runs))]
    while todo:
        node, runs = todo[-1]
        for run in runs:
            if isinstance(run, str):
                if id(node) in kept:
                    held.append(run)
            else:
                flush()
                todo.append((run, iter(run.runs)))
                break
        else:
            flush()
            todo.pop()
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row, from its whole html.

    A null or empty html, or one without main text, gives an empty text; n_chars counts
    code points.  Damaged markup is read as far as it goes: a head, button or the
    like whose end tag is missing hides nothing after it; a form is a node like others, so that
    one around a whole page is judged by what it holds.  Repeated rows give equal
    texts; there is no shuffle, and an empty table gives an empty one."""
    model = pages.sparkSession.sparkContext.broadcast(trained())

    def texts(every: list[list[Node]]) -> Iterator[str]:
        odds = model.value.log_odds(np.concatenate([features(nodes) for nodes in every]))
        first = 0
        for nodes in every:
            yield main_text(nodes, decode(nodes, odds[first : first + len(nodes)]))
            first += len(nodes)

    def run(batches):
        for batch in batches:
            out, held, size = [], [], 0
            for html in batch.column(2):
                held.append(nodes_of(parse(html.as_py() or "")))
                size += len(held[-1])
                if size > AT_ONCE:
                    out += texts(held)
                    held, size = [], 0
            out += texts(held) if held else []
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
