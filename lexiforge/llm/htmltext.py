"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded along the tree.

A page is parsed into its block-level nodes. Each node gets features of its subtree (text, link and tag density,
punctuation, headings), its attributes' tokens, its depth and siblings, and its parent. Boosted trees give the chance
that a node belongs to the article or holds it. Decoding takes the likeliest set of nodes that contains the parent of
each node in it, so no node is kept inside a dropped one.

The trees are trained on pages that ``training_pages`` makes by rule, with a mark on every node, and are the same at
each run.

Defined cases: a null or empty page has an empty text; unclosed and stray tags are repaired as browsers do for blocks; a
tag or comment that never ends takes all that follows, and nodes nested more than 512 deep stand beside their parents;
an open head ends at the first tag or text that can't stand in one;
scripts, styles, form controls, comments and the head never give text; repeated rows are extracted one by one; an empty
table gives no rows; further columns are kept out of the result.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .work import ship, tidied

# HTML's elements by how they are treated.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr nobr center".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style noscript template textarea title svg math iframe object select option button canvas audio video head datalist".split())
RAW = frozenset("script style textarea title iframe noscript template xmp noembed noframes".split())
IN_HEAD = frozenset("html head title base link meta style script noscript noframes template".split())
CLOSED_BY_BLOCK = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul details figcaption".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}}
SCOPE = frozenset("table ul ol dl html body div section article aside main nav header footer form td th".split())
TAGS = "article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav header footer aside form table tr td th blockquote pre figure figcaption fieldset body html details summary address".split()
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
#: Attribute tokens that speak for an article.
GOOD = "article content post entry main body story text page prose copy read paragraph hentry blog news".split()
#: Attribute tokens that speak against one, in groups of one feature each.
BAD = ["nav menu navbar navigation breadcrumb breadcrumbs crumbs toc pager pagination links", "header masthead top topbar banner logo brand", "footer bottom foot copyright legal colophon", "sidebar side aside widget rail column related recommended more popular trending teaser", "ad ads adv advert advertisement sponsor sponsored promo promotion promoted affiliate dfp", "comment comments reply replies disqus respond discussion thread reader reactions", "cookie consent gdpr notice alert popup modal overlay banner message warning dialog toast privacy", "share social follow subscribe newsletter signup login register form search tools meta byline tags author"]
_BAD = [frozenset(x.split()) for x in BAD]
_GOOD = frozenset(GOOD)
#: A tag in the states of HTML's tokenizer: a name, then attributes whose values may be quoted. Nothing is read twice.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]++|(?=>)))?+)*+)>""")
_NAMES = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)""", re.IGNORECASE)
#: Nodes deeper than browsers nest them stand beside their parents.
DEEPEST = 512
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARK = re.compile(r'data-y="([01])"')


class Page:
    """Block-level nodes of a page in order, and its text blocks, each at its node."""

    __slots__ = ("attrs", "blocks", "depth", "links", "marks", "parents", "tags")

    def __init__(self):
        self.tags: list[str] = ["#"]
        self.parents: list[int] = [0]
        self.depth: list[int] = [0]
        self.attrs: list[str] = [""]
        self.blocks: list[tuple[int, str, int]] = []
        self.links: list[int] = [0]
        self.marks: list[int] = [1]


def parse(source: str | None) -> Page:
    page = Page()
    if not source:
        return page
    tags, parents, depth, attrs, links, blocks, marks = page.tags, page.parents, page.depth, page.attrs, page.links, page.blocks, page.marks
    stack, names = [0], ["#"]
    words: list[str] = []
    linked = in_link = unread = 0

    def flush() -> None:
        nonlocal linked
        if words:
            text = "".join(words)
            if "&" in text:
                text = _html.unescape(text)
            text = " ".join(text.split())
            if text:
                blocks.append((stack[-1], text, min(linked, len(text))))
            words.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal unread
        for name in names[upto:]:
            unread -= name in UNREAD
        del stack[upto:], names[upto:]

    at = end = 0
    size = len(source)
    while at < size:
        # The text up to the next tag or comment, and where that ends.
        end = source.find("<", end)
        m, stop = None, size
        if end < 0:
            end = size
        else:
            after = source[end + 1 : end + 2]
            if after.isascii() and after.isalpha() or after == "/" and source[end + 2 : end + 3].isascii() and source[end + 2 : end + 3].isalpha():
                m = _TAG.match(source, end)
                stop = m.end() if m else size  # a tag that never ends takes all that follows
            elif after in ("!", "?", "/") and after:
                mark = "-->" if source.startswith("<!--", end) else "]]>" if source.startswith("<![CDATA[", end) else ">"
                stop = source.find(mark, end + 2)
                stop = size if stop < 0 else stop + len(mark)
            else:
                end += 1
                continue
        if names[-1] == "head" and end > at and source[at:end].strip(" \t\n\f\r"):
            close(len(names) - 1)
        if end > at and not unread:
            words.append(source[at:end])
            if in_link:
                linked += end - at
        at = end = stop
        if not m:
            continue
        name = m[2]
        name = name.lower()
        if names[-1] == "head" and (name in ("body", "html", "br") if m[1] else name not in IN_HEAD):
            close(len(names) - 1)
        if name == "br":
            if not unread:
                words.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                in_link = not m[1]
                if in_link and not unread:
                    links[stack[-1]] += 1
            continue
        if m[1]:
            if name in names:
                flush()
                in_link = 0
                close(len(names) - 1 - names[::-1].index(name))
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        flush()
        in_link = 0
        if name in CLOSED_BY_BLOCK or name == "p" or name in HEADINGS:
            # An open paragraph ends where a block begins.
            for i in range(len(names) - 1, 0, -1):
                if names[i] == "p":
                    close(i)
                    break
                if names[i] in SCOPE:
                    break
        if shut := CLOSES.get(name):
            low = None
            for i in range(len(names) - 1, 0, -1):
                if names[i] in shut:
                    low = i
                elif names[i] in SCOPE and names[i] not in ("td", "th"):
                    break
            if low is not None:
                close(low)
        if len(stack) > DEEPEST:
            close(len(names) - 1)
        parents.append(stack[-1])
        depth.append(depth[stack[-1]] + 1)
        tags.append(name)
        attrs.append(m[3])
        links.append(0)
        mark = _MARK.search(m[3]) if "data-y" in m[3] else None
        marks.append(int(mark[1]) if mark else marks[stack[-1]])
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(source, at)
            stop = source.find(">", stop.end()) if stop else -1
            at = end = stop + 1 if stop >= 0 else size
            continue
        if m[3].endswith("/") and name in UNREAD:
            continue
        stack.append(len(tags) - 1)
        names.append(name)
        unread += name in UNREAD
    if not unread:
        flush()
    return page


def _attribute(attr: str) -> tuple[int, ...]:
    """How many good tokens, and how many of each bad group, an attribute string has."""
    return _short(attr) if len(attr) < 300 else _counted(attr)


@lru_cache(maxsize=20_000)
def _short(attr: str) -> tuple[int, ...]:
    return _counted(attr)


def _counted(attr: str) -> tuple[int, ...]:
    tokens = {t.lower() for v in _NAMES.findall(attr) for t in _TOKEN.findall(v)}
    tokens |= {t[:-1] for t in tokens if t.endswith("s") and len(t) > 3}
    return (len(tokens & _GOOD), *(len(tokens & b) for b in _BAD))


_AT = {t: i for i, t in enumerate(TAGS)}
_GROUPS = np.zeros((len(TAGS) + 1, 14))
for _g, _names in enumerate(("article", "main", "section", "div", "p blockquote pre figure figcaption", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "nav", "header", "footer", "aside", "form fieldset", "table tr td th")):
    for _t in _names.split():
        _GROUPS[_AT[_t], _g] = 1
_BOILER = np.array([t in ("nav", "header", "footer", "aside", "form") for t in TAGS] + [False])


def features(pages: list[Page]) -> np.ndarray:
    """A row for each node of each page, in order."""
    n = np.array([len(p.tags) for p in pages])
    base = np.concatenate([[0], np.cumsum(n)])
    total = int(base[-1])
    of = np.repeat(np.arange(len(pages)), n)
    parent = np.concatenate([np.array(p.parents) + b for p, b in zip(pages, base, strict=False)])
    depth = np.concatenate([p.depth for p in pages]).astype(np.float64)
    tag = np.array([_AT.get(t, len(TAGS)) for p in pages for t in p.tags])
    attr = np.array([_attribute(a) if a else (0,) * (1 + len(_BAD)) for p in pages for a in p.attrs], dtype=np.float64)
    own = np.zeros((total, 7))  # characters, linked characters, links, blocks, marks, paragraphs, headings
    for p, b in zip(pages, base, strict=False):
        for node, text, linked in p.blocks:
            row = own[b + node]
            row[0] += len(text)
            row[1] += linked
            row[3] += 1
            row[4] += text.count(".") + text.count(",") + text.count("。")
    own[:, 2] = np.concatenate([p.links for p in pages])
    own[:, 5] = tag == _AT["p"]
    own[:, 6] = _GROUPS[tag, 5]
    under = np.column_stack([own, np.ones(total)])
    roots = base[:-1]
    is_root = np.zeros(total, bool)
    is_root[roots] = True
    by_depth = np.argsort(depth, kind="stable")
    levels = np.searchsorted(depth[by_depth], np.arange(1, int(depth.max()) + 2 if total else 1))
    levels = [by_depth[a:b] for a, b in zip(levels[:-1], levels[1:], strict=True)]  # the roots are the level before
    # From the deepest level up, each node's sums go to its parent.
    for at in levels[::-1]:
        np.add.at(under, parent[at], under[at])
    bad_tag = _BOILER[tag].astype(np.float64)
    above = np.column_stack([attr, bad_tag])
    for at in levels:
        above[at] = np.maximum(above[at], above[parent[at]])
    chars = np.maximum(1, under[:, 0])
    whole = np.maximum(1, under[roots, 0])[of]
    siblings = np.bincount(parent[~is_root], minlength=total)[parent].astype(np.float64)
    order = np.zeros(total)
    first = np.lexsort((np.arange(total), parent))
    first = first[~is_root[first]]
    if len(first):
        starts = np.concatenate([[True], parent[first][1:] != parent[first][:-1]])
        order[first] = np.arange(len(first)) - np.maximum.accumulate(np.where(starts, np.arange(len(first)), 0))
    place = (np.arange(total) - base[of]) / np.maximum(1, n[of])
    dense = lambda i: np.column_stack([np.log1p(under[i, 0]), under[i, 1] / np.maximum(1, under[i, 0]), under[i, 2] / under[i, 7], under[i, 0] / under[i, 7], under[i, 4] / np.maximum(1, under[i, 0]) * 50, np.log1p(under[i, 5]), np.log1p(under[i, 6])])
    everyone = np.arange(total)
    return np.column_stack([_GROUPS[tag], attr, above[parent], dense(everyone), dense(parent), np.log1p(own[:, 0]), own[:, 3], chars / whole, under[:, 0] / np.maximum(1, under[parent, 0]), depth, np.log1p(siblings), order / np.maximum(1, siblings - 1), place, np.log1p(under[:, 7]), _GROUPS[tag[parent]]])


class Trees:
    """Gradient-boosted trees for the log loss, on features cut into at most 32 bins."""

    def __init__(self, rounds: int = 80, levels: int = 4, rate: float = 0.2, least: float = 4.0, bins: int = 32):
        self.rounds, self.levels, self.rate, self.least, self.bins = rounds, levels, rate, least, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        d, bins = x.shape[1], self.bins
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
        b = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)])
        flat = b + np.arange(d) * bins
        share = np.clip(y.mean(), 0.01, 0.99)
        self.start = float(np.log(share / (1 - share)))
        s = np.full(len(y), self.start)
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-s))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**self.levels - 1, np.int64), np.full(2**self.levels - 1, np.inf)
            for level in range(self.levels):
                k, low = 2**level, 2**level - 1
                index = ((node - low)[:, None] * (d * bins) + flat).ravel()
                gs = np.bincount(index, np.repeat(g, d), k * d * bins).reshape(k, d, bins).cumsum(axis=2)
                hs = np.bincount(index, np.repeat(h, d), k * d * bins).reshape(k, d, bins).cumsum(axis=2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < self.least) | (ht - hs < self.least)] = 0
                top = gain.reshape(k, -1).argmax(axis=1)
                for i in range(k):
                    j, c = divmod(int(top[i]), bins)
                    if gain[i, j, c] > 1e-6 and c < len(self.cuts[j]):
                        feature[low + i], cut[low + i] = j, self.cuts[j][c]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - (2**self.levels - 1)
            value = np.bincount(leaf, g, 2**self.levels) / (np.bincount(leaf, h, 2**self.levels) + 1) * self.rate
            s = s + value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        s, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.levels):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            s += value[node - (2**self.levels - 1)]
        return s


def kept(page: Page, odds: np.ndarray) -> np.ndarray:
    """The likeliest choice of nodes in which every chosen node's parent is chosen; the root is."""
    n = len(page.tags)
    gain = odds.copy()
    for i in range(n - 1, 0, -1):
        if gain[i] > 0:
            gain[page.parents[i]] += gain[i]
    keep = gain > 0
    keep[0] = True
    for i in range(1, n):
        keep[i] &= keep[page.parents[i]]
    return keep


def text_of(page: Page, keep: np.ndarray) -> str:
    return "\n".join(text for node, text, _ in page.blocks if keep[node])


def extract(sources: list[str | None], trees: Trees) -> list[str]:
    pages = [parse(s) for s in sources]
    odds = trees.score(features(pages)) if pages else []
    out, at = [], 0
    for p in pages:
        n = len(p.tags)
        out.append(text_of(p, kept(p, odds[at : at + n])))
        at += n
    return out


def training_pages(count: int = 800, seed: int = 41) -> list[str]:
    """Pages made by rule, in many layouts; ``data-y`` marks what is, or holds, the article."""
    rng = np.random.Generator(np.random.PCG64(seed))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p
    stems = ["".join(pick("aeioustrnlmdkpbgvfhé") for _ in range(int(rng.integers(2, 9)))) for _ in range(600)]

    def words(n: int) -> str:
        return " ".join(pick(stems) + (pick(",.") if chance(0.12) else "") for _ in range(max(1, n))).capitalize()

    def prose() -> str:
        n = int(rng.integers(2, 25)) if chance(0.35) else int(rng.integers(20, 140))
        text = words(n) + "."
        if chance(0.2):
            text += f' <a href="/{pick(stems)}">{words(2)}</a> {words(6)}'
        return f"<b>{text}</b>" if chance(0.08) else text

    def attr(names: list[str], bare: float = 0.25) -> str:
        if chance(bare):
            return ""
        name = pick(names)
        name = pick([name, name, f"{pick(stems)}-{name}", f"{name}-{pick(['wrap', 'box', 'inner', 'block', 'area', 'container'])}", f"{name} {pick(stems)}"])
        return f' {pick(["class", "class", "id"])}="{name}"'

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{pick(stems)}">{words(int(rng.integers(1, 7)))}</a></li>' for _ in range(n))

    def boiler(kind: str) -> str:
        if kind == "nav":
            inner = f"<ul>{links(int(rng.integers(2, 12)))}</ul>" if chance(0.7) else " ".join(f'<a href="#">{words(1)}</a>' for _ in range(6))
            tag = pick(["nav", "nav", "div", "ul"])
            return f'<{tag}{attr(["nav", "menu", "navbar", "breadcrumbs", "toc"], 0.2 if tag != "nav" else 0.6)} data-y="0">{inner}</{tag}>'
        if kind == "header":
            tag = pick(["header", "header", "div"])
            return f'<{tag}{attr(["header", "masthead", "topbar", "logo"], 0.5 if tag == "header" else 0.1)} data-y="0"><div>{words(3)}</div>{boiler("nav") if chance(0.5) else ""}{f"<p>{words(8)}</p>" if chance(0.4) else ""}</{tag}>'
        if kind == "footer":
            tag = pick(["footer", "footer", "div"])
            inner = f"&copy; {pick(stems)} &middot; {words(int(rng.integers(3, 14)))}"
            return f'<{tag}{attr(["footer", "bottom", "copyright", "legal"], 0.6 if tag == "footer" else 0.1)} data-y="0">{pick([inner, f"<p>{inner}</p>", f"<p>{words(20)}.</p><ul>{links(4)}</ul>"])}</{tag}>'
        if kind == "aside":
            tag = pick(["aside", "aside", "div", "section"])
            inner = pick([f"<h3>{words(2)}</h3><ul>{links(5)}</ul>", f"<p>{words(30)}.</p>", f"<h4>{words(3)}</h4><p>{words(14)} <a href='#'>{words(3)}</a></p><p>{words(25)}.</p>"])
            return f'<{tag}{attr(["sidebar", "widget", "related", "side", "popular", "recommended", "teaser"], 0.5 if tag == "aside" else 0.05)} data-y="0">{inner}</{tag}>'
        if kind == "ad":
            return f'<div{attr(["ad", "ads", "advert", "sponsored", "promo", "banner", "advertisement"], 0.03)} data-y="0">{pick([words(int(rng.integers(3, 20))) + ".", f"<p>{words(30)}.</p>", f"<a href=x>{words(5)}</a>"])}</div>'
        if kind == "notice":
            tag = pick(["div", "div", "section", "p"])
            return f'<{tag}{attr(["cookie", "notice", "alert", "consent", "popup", "gdpr", "newsletter", "subscribe"], 0.03)} data-y="0">{words(int(rng.integers(6, 40)))}. {"<button>OK</button>" if chance(0.5) else ""}</{tag}>'
        if kind == "form":
            tag = pick(["form", "form", "div"])
            return f'<{tag}{attr(["search", "login", "form", "signup"], 0.5 if tag == "form" else 0.05)} data-y="0"><label>{words(2)}</label><input name=q>{f"<p>{words(10)}.</p>" if chance(0.3) else ""}<button>{words(1)}</button></{tag}>'
        if kind == "share":
            return f'<div{attr(["share", "social", "tools", "byline", "meta", "tags", "author"], 0.03)} data-y="0">{" ".join(f"<a href=x>{words(1)}</a>" for _ in range(int(rng.integers(1, 6))))} {words(3)}</div>'
        one = "".join(pick([f"<div{attr(['comment', 'reply'], 0.4)}><b>{words(2)}</b><p>{words(int(rng.integers(5, 60)))}.</p></div>", f"<li><p>{words(int(rng.integers(5, 60)))}.</p></li>", f"<p>{words(int(rng.integers(5, 40)))}.</p>"]) for _ in range(int(rng.integers(1, 9))))
        tag = pick(["section", "div", "div", "ol", "aside"])
        return f'<{tag}{attr(["comments", "comment", "replies", "disqus", "discussion", "respond", "reader-comments"], 0.03)} data-y="0">{f"<h3>{words(2)}</h3>" if chance(0.6) and tag != "ol" else ""}{one}</{tag}>'

    def article() -> str:
        parts = []
        n = int(rng.integers(1, 3)) if chance(0.3) else int(rng.integers(2, 22))
        for _ in range(n):
            r = rng.random()
            if r < 0.78:
                parts.append(f"<p>{prose()}</p>" if chance(0.9) else f"<p>{prose()}<br>")
            elif r < 0.86:
                parts.append(f"<h{pick('234')}>{words(int(rng.integers(2, 8)))}</h{2}>")
            elif r < 0.92:
                parts.append("<ul>" + "".join(f"<li>{words(int(rng.integers(3, 30)))}</li>" for _ in range(int(rng.integers(2, 7)))) + "</ul>")
            elif r < 0.96:
                parts.append(f"<blockquote><p>{prose()}</p></blockquote>")
            elif r < 0.98:
                parts.append(f"<table><tr><td>{words(3)}</td><td>{words(4)}</td></tr><tr><td>{words(3)}</td><td>{words(2)}</td></tr></table>")
            else:
                parts.append(f"<pre>{words(12)}</pre>")
        if chance(0.12):
            parts = [f"<div>{prose()}</div>" for _ in range(n)]
        if chance(0.05):
            parts = [f"{prose()}<br><br>" for _ in range(n)]
        for kind in ("ad", "share", "aside", "notice", "form"):
            if chance(0.2):
                parts.insert(int(rng.integers(len(parts) + 1)), boiler(kind))
        head = f"<h1>{words(int(rng.integers(3, 12)))}</h1>" if chance(0.75) else ""
        if head and chance(0.12):
            head = f"<header>{head}</header>"
        return head + "".join(parts)

    out = []
    for _ in range(count):
        tag = pick(["article", "article", "main", "div", "div", "section"])
        body = f'<{tag}{attr(["article", "content", "post", "entry", "story", "main", "post-content", "article-body", "text"], 0.5)} data-y="1">{article()}</{tag}>'
        for _ in range(int(rng.integers(0, 3))):
            outer = pick(["div", "main", "div", "section"])
            side = boiler("aside") if chance(0.3) else ""
            body = f'<{outer}{attr(["wrapper", "container", "page", "content", "layout", "row"], 0.5)} data-y="1">{body}{side}{boiler("comments") if chance(0.15) else ""}</{outer}>'
        before = "".join(boiler(k) for k in ("header", "nav", "notice", "ad", "form", "aside") if chance(0.35))
        after = "".join(boiler(k) for k in ("share", "comments", "aside", "ad", "notice", "nav", "footer") if chance(0.35))
        out.append(f"<!DOCTYPE html><html><head><title>{words(4)}</title><script>var a='</p>';</script></head><body>{before}{body}{after}</body></html>")
    return out


@lru_cache(maxsize=1)
def trained() -> Trees:
    pages = [parse(s) for s in training_pages()]
    x = features(pages)
    y = np.concatenate([p.marks for p in pages]).astype(np.float64)
    return Trees().fit(x, y)


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(trained())  # some kilobytes
    rows = pages.select(pages[key].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), pages[html].cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                texts = extract(part.column(2).to_pylist(), trees)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(tidied(run), "page_id long, url string, text string, n_chars long")
