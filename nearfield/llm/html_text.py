"""HTML extraction (operator 7): boosted trees over DOM nodes.

A page becomes a tree of block elements (a forgiving parser closes what HTML
leaves open).  Each node gets features: its tag, what its class, id and role
tokens and those of its ancestors speak of, depth, place among its siblings,
text per tag in its subtree, link and punctuation density, share of the page.
Gradient-boosted trees give the probability that a node's text is main text.

Nodes are then labelled together.  Each is kept whole, dropped whole, or open;
only below an open node may children differ, and each open node has a price.
The labelling of the least total cost is found from the leaves up, so no node
that is kept stands below one that is dropped, or the other way round.

The trees are trained here, on ``TRAINING_PAGES`` generated pages whose parts
are known; the pages to be read take no part in it.

Defined results: null html is empty; a page without main text gives ''; markup
of any sort is accepted, a ``<`` that begins no tag is text.  Rows are read one
by one; other columns stay as they are.
"""

from __future__ import annotations

import html as html_entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nearfield.llm.common import small_arrow
from nearfield.llm.kernels import small_batches

TRAINING_PAGES, TREES, DEPTH, RATE, BINS = 400, 40, 4, 0.25, 32
OPEN_PRICE = 0.7

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIPPED = frozenset("script style template head title select textarea button".split())
#: Nodes of their own that may stand within a paragraph: what they hold is shown in place of something else.
_APART = frozenset("noscript object iframe canvas".split())
_RAW = frozenset("script style textarea title".split())
_BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav aside footer header form fieldset figure figcaption blockquote pre table thead tbody tfoot tr td th address details summary menu dialog hgroup center caption".split()
)
#: What a start tag closes, and the elements that shield what is open outside of them.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|/([a-zA-Z][^\s>]*)[^>]*>|([a-zA-Z][^\s/>]*)([^>]*)>|[!?/][^>]*>)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_TOKEN = re.compile(r"[a-z]+")
_SPACES = re.compile(r"\s+")

#: What attribute tokens speak of.
TOPICS = {
    "main": "article content post entry main story body text",
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs toolbar tabs pagination pager topbar",
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner",
    "side": "aside sidebar side widget rail related recommended complementary trending",
    "comment": "comment comments reply replies respond disqus discussion",
    "edge": "footer foot copyright masthead header site legal contentinfo colophon bottom top",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay subscribe newsletter signup login warning",
    "share": "share sharing social tags byline meta follow",
}
_TOPIC_OF = {word: i for i, words in enumerate(TOPICS.values()) for word in words.split()}
_KINDS = [{"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "dt", "dd"}, {"ul", "ol", "dl", "menu"}, {"div", "section"}, {"article", "main"}, {"nav"}, {"aside"}, {"footer"}, {"header"}, {"form", "fieldset", "dialog"}, {"table", "tr", "td", "th", "tbody"}, {"blockquote", "pre", "figure"}]
_KIND_OF = {tag: i for i, tags in enumerate(_KINDS) for tag in tags}


@dataclass
class Page:
    """Block elements in page order (parents first) and the texts between their edges."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    topics: list[int] = field(default_factory=list)  # a bit for each topic
    mark: list[str] = field(default_factory=list)  # only of generated pages
    pieces: list[tuple[int, str, int]] = field(default_factory=list)  # node, text, characters within links


def _ends(source: str, name: str) -> dict[int, int]:
    """Where the elements of a name begin that have an end tag of their own, and where that ends."""
    begun: list[int] = []
    ends = {}
    for m in re.finditer(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*>", source, re.IGNORECASE):
        if m[1]:
            if begun:
                ends[begun.pop()] = m.end()
        elif not m[0].endswith("/>"):
            begun.append(m.start())
    return ends


def parse(source: str) -> Page:
    page = Page()
    ends: dict[str, dict[int, int]] = {}
    nodes: list[int] = [0]  # open blocks
    stack: list[str] = []  # open elements, blocks and others
    opened: Counter[str] = Counter()  # how often a name is in the stack
    parts: list[str] = []
    linked = 0
    depth_link = 0
    page.tag.append("#")
    page.parent.append(-1)
    page.topics.append(0)
    page.mark.append("")

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACES.sub(" ", html_entities.unescape("".join(parts))).strip()
            if text:
                page.pieces.append((nodes[-1], text, linked))
            parts.clear()
        linked = 0

    def close(to: int) -> None:
        nonlocal depth_link
        while len(stack) > to:
            name = stack.pop()
            opened[name] -= 1
            if name in _BLOCK or name in _APART:
                flush()
                nodes.pop()
            elif name == "a":
                depth_link -= 1

    def close_last(name: str) -> None:
        """Close the innermost element of a name and all within it; looks at those only."""
        if opened[name]:
            i = len(stack) - 1
            while stack[i] != name:
                i -= 1
            close(i)

    at, size = 0, len(source)
    while at < size:
        m = _TAG.search(source, at)
        stop = m.start() if m else size
        if stop > at:
            raw = source[at:stop]
            parts.append(raw)
            if depth_link:
                linked += len(raw)
        if not m:
            break
        at = m.end()
        name = m[1] or m[4]
        if name:
            name = name.lower()
            if name in _SKIPPED:
                if m[0].endswith("/>") and name not in _RAW:
                    continue
                if name == "head":  # what it holds is skipped one by one; it may lack an end tag
                    continue
                parts.append(" ")
                if name in _RAW:
                    end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(source, at)
                    at = end.end() if end else size
                else:  # without an end tag of its own, only the tag goes
                    if name not in ends:
                        ends[name] = _ends(source, name)
                    at = max(at, ends[name].get(m.start(), at))
                continue
            if name in _VOID:
                parts.append(" " if name in ("br", "hr", "wbr", "img") and name != "wbr" else "")
                continue
            if name in _APART and m[0].endswith("/>"):
                continue
            if name in _BLOCK or name in _APART:
                if name in _BLOCK:
                    close_last("p")
                closes, shield = _CLOSES.get(name, ((), ()))
                if any(opened[x] for x in closes):
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i] in shield:
                            break
                        if stack[i] in closes:
                            close(i)
                            break
                flush()
                topics = 0
                attributes = m[2] or m[5] or ""
                for a in _ATTRIBUTE.findall(attributes) if attributes else ():
                    for word in _TOKEN.findall((a[0] or a[1] or a[2]).lower()):
                        if word in _TOPIC_OF:
                            topics |= 1 << _TOPIC_OF[word]
                page.tag.append(name)
                page.parent.append(nodes[-1])
                page.topics.append(topics)
                page.mark.append(attributes.rpartition("data-part=")[2] if "data-part=" in attributes else "")
                nodes.append(len(page.tag) - 1)
            elif name == "a":
                depth_link += 1
            stack.append(name)
            opened[name] += 1
            continue
        if m[3]:
            close_last(m[3].lower())
    close(0)
    flush()
    return page


N_FEATURES = 12 + 2 * len(TOPICS) + 2 * len(_KINDS)


def features(page: Page) -> np.ndarray:
    """One row for each node."""
    n = len(page.tag)
    parent = np.array(page.parent)
    node = np.array([p[0] for p in page.pieces], np.int64)
    length = np.array([len(p[1]) for p in page.pieces], np.float64)
    total = {
        "text": np.bincount(node, length, n) if len(node) else np.zeros(n),
        "link": np.bincount(node, [p[2] for p in page.pieces], n) if len(node) else np.zeros(n),
        "stops": np.bincount(node, [p[1].count(".") + p[1].count(",") for p in page.pieces], n) if len(node) else np.zeros(n),
        "pieces": np.bincount(node, minlength=n).astype(float) if len(node) else np.zeros(n),
        "tags": np.ones(n),
    }
    before = np.concatenate([[0], np.cumsum(length)])
    first = np.full(n, np.inf)
    np.minimum.at(first, node, before[:-1])
    depth = np.zeros(n)
    topics, kinds = np.zeros((n, len(TOPICS))), np.zeros((n, len(_KINDS)))
    for i in range(n):
        bits = page.topics[i]
        while bits:
            low = bits & -bits
            topics[i, low.bit_length() - 1] = 1
            bits ^= low
        k = _KIND_OF.get(page.tag[i])
        if k is not None:
            kinds[i, k] = 1
        if i:
            depth[i] = depth[parent[i]] + 1
    above_topics, above_kinds = topics.copy(), kinds.copy()
    for i in range(1, n):
        above_topics[i] += above_topics[parent[i]]
        above_kinds[i] += above_kinds[parent[i]]
    for i in range(n - 1, 0, -1):
        for values in total.values():
            values[parent[i]] += values[i]
        first[parent[i]] = min(first[parent[i]], first[i])
    siblings = np.bincount(parent[1:], minlength=n)
    order, seen, alike = np.zeros(n), np.zeros(n), np.zeros(n)
    same: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        order[i] = seen[parent[i]]
        seen[parent[i]] += 1
        key = (page.parent[i], page.tag[i])
        same[key] = same.get(key, 0) + 1
    for i in range(1, n):
        alike[i] = same[page.parent[i], page.tag[i]] / siblings[parent[i]]
    count = np.where(parent >= 0, siblings[parent], 1)
    text, whole = total["text"], max(1.0, float(before[-1]))
    plain = [
        depth, count, order / np.maximum(count, 1), alike, np.log1p(text), total["link"] / np.maximum(text, 1), np.log(total["tags"]), text / (total["tags"] + 1),
        total["stops"] / np.maximum(text, 1), text / np.maximum(total["pieces"], 1), np.where(np.isfinite(first), first, whole) / whole, text / whole,
    ]
    return np.concatenate([np.stack(plain, axis=1), topics, np.minimum(above_topics, 2), kinds, np.minimum(above_kinds, 2)], axis=1)


@dataclass
class Trees:
    """Complete binary trees of one depth, as arrays."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - ((1 << DEPTH) - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic gradient boosting with second-order leaves over binned features."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    share = float(y.mean())
    base = math.log(share / (1 - share))
    margin = np.full(n, base)
    inner = (1 << DEPTH) - 1
    made = []
    columns = (np.arange(m) * BINS)[None, :]
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(1 << DEPTH)
        at = np.zeros(n, np.int64)
        for level in range(DEPTH):
            for node in range((1 << level) - 1, (2 << level) - 1):
                rows = np.flatnonzero(at == node)
                if len(rows) < 20:
                    continue
                flat = (binned[rows] + columns).ravel()
                gs = np.bincount(flat, np.repeat(g[rows], m), m * BINS).reshape(m, BINS).cumsum(axis=1)
                hs = np.bincount(flat, np.repeat(h[rows], m), m * BINS).reshape(m, BINS).cumsum(axis=1)
                gt, ht = gs[0, -1], hs[0, -1]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < 1) | (ht - hs < 1)] = -1
                j, b = divmod(int(gain.argmax()), BINS)
                if gain[j, b] > 1e-6 and b < len(edges[j]):
                    feature[node], threshold[node] = j, edges[j][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        at -= inner
        leaf = -RATE * np.bincount(at, g, 1 << DEPTH) / (np.bincount(at, h, 1 << DEPTH) + 1)
        margin += leaf[at]
        made.append((feature, threshold, leaf))
    return Trees(*(np.stack(z) for z in zip(*made, strict=True)), base)


def _sample_page(r: random.Random) -> str:
    """A page of random parts; ``data-part`` tells which elements hold main text."""
    syllables = [c + v for c in ("b", "d", "f", "l", "m", "n", "r", "s", "t", "th", "sch", "qu") for v in ("a", "e", "i", "o", "é", "en")]

    def words(n: int) -> str:
        out = " ".join("".join(r.choice(syllables) for _ in range(r.choice((1, 1, 2, 2, 3, 4)))) for _ in range(n))
        return (out[:1].upper() + out[1:] + ".") if n > 2 else out

    def prose(lo: int, hi: int) -> str:
        return " ".join(words(r.randint(3, 16)) for _ in range(r.randint(lo, hi)))

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(r.randint(1, 3))}</a></li>' for i in range(n))

    def name(*options: str) -> str:
        style = r.random()
        word = r.choice(options)
        return f' class="{word}"' if style < 0.6 else f' id="{word}-{r.randint(1, 9)}"' if style < 0.8 else f' class="x{r.randint(1, 99)} {word}"'

    def other(kind: str) -> str:
        box = r.choice(("div", "section"))
        if kind == "menu":
            return r.choice((f"<nav><ul>{links(r.randint(2, 9))}</ul></nav>", f"<div{name('menu', 'navbar', 'breadcrumb')}><ul>{links(r.randint(2, 9))}</ul></div>", f'<ul role="navigation">{links(4)}</ul>'))
        if kind == "header":
            return r.choice((f"<header><h1>{words(3)}</h1><p>{words(5)}</p></header>", f"<div{name('masthead', 'site-header', 'topbar')}><div>{words(4)}</div></div>", f"<header>{words(2)}<nav><ul>{links(4)}</ul></nav></header>"))
        if kind == "footer":
            return r.choice((f"<footer>&copy; {words(3)} &middot; {prose(1, 4)}</footer>", f"<footer><p>{prose(1, 3)}</p><ul>{links(3)}</ul></footer>", f"<div{name('footer', 'copyright', 'legal')}><p>{prose(1, 3)}</p></div>"))
        if kind == "side":
            inner = r.choice((f"<h3>{words(2)}</h3><ul>{links(5)}</ul>", f"<p>{prose(1, 3)}</p>", f"<h2>{words(2)}</h2><p>{prose(1, 2)}</p><p>{prose(1, 2)}</p>"))
            return r.choice((f"<aside>{inner}</aside>", f"<aside{name('sidebar', 'related')}>{inner}</aside>", f"<{box}{name('sidebar', 'widget', 'related', 'recommended')}>{inner}</{box}>"))
        if kind == "notice":
            return f"<{box}{name('cookie-notice', 'consent', 'alert', 'popup', 'newsletter', 'gdpr-banner')}><p>{prose(1, 3)}</p></{box}>" if r.random() < 0.6 else f"<div{name('cookie', 'notice', 'subscribe')}>{prose(1, 2)}</div>"
        if kind == "advert":
            return r.choice((f"<div{name('ad', 'advert', 'sponsored', 'promo', 'banner-ad')}>{prose(1, 3)}</div>", f"<{box}{name('ads', 'advertisement', 'promo-box')}><p>{prose(1, 3)}</p></{box}>"))
        if kind == "form":
            return f"<form{name('search', 'login', 'signup') if r.random() < 0.5 else ''}><label>{words(2)}</label><input name=q><p>{words(6)}</p></form>"
        if kind == "share":
            return f"<div{name('share', 'social', 'tags')}><ul>{links(3)}</ul></div>"
        n = r.randint(1, 8)
        one = r.choice(("<div class=\"comment\"><b>{a}</b><p>{b}</p></div>", "<li class=\"comment\"><p>{b}</p></li>", "<p>{b}</p>", "<article class=\"comment\"><p>{b}</p></article>"))
        body = "".join(one.format(a=words(1), b=prose(1, 5)) for _ in range(n))
        return f"<{box}{name('comments', 'comment-list', 'replies', 'discussion')}><h3>{words(2)}</h3>{body}</{box}>"

    def content() -> str:
        out = [f"<h1 data-part=1>{words(r.randint(2, 9))}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 14, 30))):
            kind = r.random()
            if kind < 0.72:
                out.append(f"<p data-part=1>{prose(1, 6)}{r.choice(('', '</p>'))}" if r.random() < 0.2 else f"<p data-part=1>{prose(1, 6)}</p>")
            elif kind < 0.78:
                out.append(f"<p data-part=1><b>{prose(1, 3)}<br>")
            elif kind < 0.84:
                out.append(f"<h2 data-part=1>{words(4)}</h2>")
            elif kind < 0.89:
                out.append("<ul data-part=1>" + "".join(f"<li data-part=1>{words(r.randint(2, 9))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote data-part=1><p data-part=1>{prose(1, 3)}</p></blockquote>")
            elif kind < 0.94:
                out.append(f"<div data-part=1>{prose(1, 4)}</div>")
            elif kind < 0.96:
                out.append("<table data-part=1>" + "".join(f"<tr data-part=1><td data-part=1>{words(2)}</td><td data-part=1>{words(2)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                out.append(other(r.choice(("advert", "share", "side", "form", "notice"))))
        return "".join(out)

    body = content()
    if "<" + "p data-part" not in body:
        body += f"<p data-part=1>{prose(1, 4)}</p>"
    mixed = any(x in body for x in ("<aside", "<form", "class=", "id="))
    mark = "" if mixed else " data-part=1"
    main = r.choice((f"<article{mark}>{body}</article>", f"<article{mark}>{body}</article>", f"<main><article{mark}>{body}</article></main>", f"<div{name('content', 'post', 'entry-content', 'article-body', 'story')}{mark}>{body}</div>", f"<main{mark}>{body}</main>", f'<div role="main"{mark}>{body}</div>'))
    kinds = ["menu", "header", "side", "notice", "advert", "form", "share"]
    above = [other(k) for k in r.sample(kinds, r.randint(0, 4))]
    below = [other(k) for k in r.sample([*kinds, "comment", "comment", "footer", "footer"], r.randint(0, 4))]
    inner = "".join([*above, main, *below])
    if r.random() < 0.3:
        inner = f"<div{name('page', 'wrapper', 'site', 'container')}>{inner}</div>"
    return f"<!DOCTYPE html><html><head><title>{words(3)}</title></head><body>{inner}</body></html>"


@lru_cache(maxsize=1)
def trained() -> Trees:
    """The trees, trained once in a process on generated pages of a fixed seed."""
    r = random.Random(20)
    xs, ys = [], []
    for _ in range(TRAINING_PAGES):
        page = parse(_sample_page(r))
        x = features(page)
        n = len(page.tag)
        good, bad = np.zeros(n), np.zeros(n)
        for node, text, _ in page.pieces:
            (good if page.mark[node] else bad)[node] += len(text)
        for i in range(n - 1, 0, -1):
            good[page.parent[i]] += good[i]
            bad[page.parent[i]] += bad[i]
        clear = (good > 0) != (bad > 0)  # nodes with both are neither
        xs.append(x[clear])
        ys.append((good > 0)[clear])
    return boost(np.concatenate(xs), np.concatenate(ys).astype(np.float64))


def keep_nodes(page: Page, margin: np.ndarray) -> np.ndarray:
    """Which nodes' own text is main text, by the labelling of least cost."""
    n = len(page.tag)
    keep = np.logaddexp(0, -margin).tolist()  # cost of keeping and of dropping a node
    drop = np.logaddexp(0, margin).tolist()
    own = [0] * n
    for node, _, _ in page.pieces:
        own[node] = 1
    all_keep, all_drop = [0.0] * n, [0.0] * n
    free = [0.0] * n  # the best of the children together
    has_text = own[:]
    choice = [0] * n  # 1 keep, 0 drop, 2 open
    best = [0.0] * n
    for i in range(n - 1, -1, -1):
        p = page.parent[i]
        if not has_text[i]:
            continue
        all_keep[i] += keep[i]
        all_drop[i] += drop[i]
        split = OPEN_PRICE + free[i] + (min(keep[i], drop[i]) if own[i] else 0.0) if free[i] or i == 0 else math.inf
        options = (all_drop[i], all_keep[i], split)
        choice[i] = min((0, 1, 2), key=options.__getitem__)
        best[i] = options[choice[i]]
        if p >= 0:
            has_text[p] = 1
            all_keep[p] += all_keep[i]
            all_drop[p] += all_drop[i]
            free[p] += best[i]
    kept = np.zeros(n, bool)
    fate = [0] * n
    for i in range(n):
        above = fate[page.parent[i]] if i else 2
        fate[i] = choice[i] if above == 2 else above
        kept[i] = fate[i] == 1 or (fate[i] == 2 and keep[i] < drop[i])
    return kept


def main_texts(sources: list[str], trees: Trees) -> list[str]:
    """The main text of each page."""
    pages = [parse(s) for s in sources]
    rows = [features(p) for p in pages]
    margins = np.split(trees.margin(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1]) if rows else []
    out = []
    for page, margin in zip(pages, margins, strict=True):
        kept = keep_nodes(page, margin)
        out.append(" ".join(text for node, text, _ in page.pieces if kept[node]))
    return out


def extract(pages: DataFrame, source: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text in place of its source."""
    fields = [x for x in pages.columns if x not in (source, out)]
    handle = pages.sparkSession.sparkContext.broadcast(trained())  # TREES * 2**DEPTH nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, source, 1 << 20):
            texts = main_texts([x or "" for x in batch.column(source).to_pylist()], handle.value)
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in fields), pa.array(texts, pa.string()), sizes], [*fields, out, "n_chars"])

    keep = pages.drop("n_chars", out) if out != source else pages.drop("n_chars")
    fields = [x for x in keep.columns if x != source]
    return small_arrow(keep).mapInArrow(run, keep.drop(source).schema.add(out, "string").add("n_chars", "long"))
