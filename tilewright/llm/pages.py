"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded from the root down."""

from __future__ import annotations

import html as entities
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sent

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
NEVER = RAW | frozenset("head template noscript svg math object select option button canvas audio video map".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section search table ul".split())
SIBLING_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
SCOPE = frozenset("table td th ul ol dl article section aside main body html".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|</(?![A-Za-z])[^>]*(?:>|\Z)|<([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(>|\Z)", re.S)
#: A tag whose last quote is never closed ends at its first '>', as far as there is one.
UNQUOTED = re.compile(r"<([A-Za-z][^\s/>]*)([^>]*)(>)")
#: An inline element that was closed before those within it.
GONE = "#gone"
#: Elements that hide what is in them, and what ends them where they were never closed: parts of a page that can't stand in them.
UNCLOSED = NEVER - RAW - {"head", "template"}
STARTS = frozenset("article main section h1 h2 h3 h4 h5 h6 p ul ol dl table blockquote pre body".split())
#: What may stand in a head. Anything else that shows text ends a head that is not closed.
HEAD = frozenset("head base basefont bgsound link meta noframes noscript script style template title".split())
ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
ATTRIBUTE_WORD = re.compile(r"[A-Za-z]+")
SPACES = re.compile(r"\s+")
NO_DIGITS = dict.fromkeys(range(ord("0"), ord("9") + 1))


@dataclass
class Dom:
    """Block-level elements of a page in order; inline ones belong to the block around them. Node 0 is the root.
    texts: (node, inside a link, text) in page order, with (node, False, None) where a block begins or ends."""

    tags: list[str] = field(default_factory=lambda: ["#root"])
    parents: list[int] = field(default_factory=lambda: [0])
    words: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    texts: list[tuple[int, bool, str | None]] = field(default_factory=list)


def parse(page: str) -> Dom:
    """A forgiving parser: unknown, unclosed and misnested tags and a page that breaks off are all read."""
    dom = Dom()
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements with their node
    at, links, hidden = 0, 0, 0  # hidden: open elements that never show text
    open_: dict[str, list[int]] = {}  # the places of each in the stack, so that no tag walks the stack
    n = len(page)

    def text(s: str) -> None:
        if s and hidden and stack[-1][0] == "head" and not s.isspace():
            pop(len(stack) - 1)
        if s and not hidden:
            dom.texts.append((stack[-1][1], links > 0, entities.unescape(s) if "&" in s else s))

    def push(tag: str, node: int) -> None:
        open_.setdefault(tag, []).append(len(stack))
        stack.append((tag, node))

    def pop(k: int) -> None:
        """Closes the open elements from place k on."""
        nonlocal links, hidden
        edge = False
        for tag, _ in stack[k:]:
            if tag != GONE:
                open_[tag].pop()
                links -= tag == "a"
                hidden -= tag in NEVER
                edge = edge or tag not in INLINE
        del stack[k:]
        if edge:
            dom.texts.append((stack[-1][1], False, None))

    def innermost(names: tuple[str, ...] | frozenset) -> int:
        return max((open_[t][-1] for t in names if open_.get(t)), default=0)

    def close(names: tuple[str, ...] | frozenset, scope: frozenset = SCOPE) -> None:
        k = innermost(names)
        if k and k >= innermost(scope):
            pop(k)

    def closes(tag: str) -> bool:
        """Whether the next tag of this name is an end tag."""
        if tag not in tags_of:
            tags_of[tag] = [(m.start(), m[1] == "/") for m in re.finditer(rf"<(/?){re.escape(tag)}(?=[\s/>])", page, re.I)]
        k = bisect_left(tags_of[tag], (at, False))
        return k < len(tags_of[tag]) and tags_of[tag][k][1]

    tags_of: dict[str, list[tuple[int, bool]]] = {}
    while at < n:
        i = page.find("<", at)
        if i < 0:
            text(page[at:])
            break
        text(page[at:i])
        m = TOKEN.match(page, i)
        if m and m[2] and not m[4]:
            m = UNQUOTED.match(page, i) or m
        if not m:
            if i + 1 == n:
                break  # a tag that the page's end cuts off
            text("<")
            at = i + 1
            continue
        at = m.end()
        if m[2]:
            if not m[4]:
                break
            tag = m[2].lower()
            if tag not in HEAD and stack[-1][0] == "head":
                pop(len(stack) - 1)
            if hidden and tag in STARTS:
                k = min(open_[t][0] for t in NEVER if open_.get(t))
                if stack[k][0] in UNCLOSED and not closes(stack[k][0]):
                    pop(k)
            if tag in CLOSES_P:
                close(("p",), SCOPE)
            if tag in SIBLING_ENDS:
                ends = SIBLING_ENDS[tag]
                close(ends, frozenset({"table", "ul", "ol", "dl", "select"}))
            if tag == "a" and links:
                close(("a",), frozenset())
            if tag == "br":
                text(" ")
            void = tag in VOID or m[3].rstrip().endswith("/") and tag in ("svg", "path")
            if tag in INLINE:
                if not void:
                    push(tag, stack[-1][1])
                    links += tag == "a"
                continue
            if void:
                dom.texts.append((stack[-1][1], False, None))
                continue
            found = ATTRIBUTE.findall(m[3]) if "=" in m[3] else ()
            dom.tags.append(tag)
            dom.parents.append(stack[-1][1])
            dom.words.append(tuple(w.lower() for a in found for w in ATTRIBUTE_WORD.findall(a[1] or a[2] or a[3])))
            push(tag, len(dom.tags) - 1)
            hidden += tag in NEVER
            dom.texts.append((stack[-1][1], False, None))
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                at = end.start() if end else n
                pop(len(stack) - 1)
                if end:
                    close_at = page.find(">", at)
                    at = close_at + 1 if close_at >= 0 else n
        elif m[1]:
            tag = m[1].lower()
            if tag == "br":
                text(" ")
            elif tag in INLINE:
                if open_.get(tag) and open_[tag][-1] > innermost(open_.keys() - INLINE):
                    stack[open_[tag].pop()] = (GONE, stack[-1][1])
                    links -= tag == "a"
            else:
                close((tag,), frozenset({"table"}) if tag not in ("table", "html", "body", "article", "main", "section", "div") else frozenset())
    return dom


def blocks(dom: Dom, kept: np.ndarray) -> str:
    """The text of the kept nodes: white space within a block as one space, blocks joined by a newline."""
    out, run = [], []

    def end() -> None:
        if run:
            s = SPACES.sub(" ", "".join(run)).strip()
            if s:
                out.append(s)
            run.clear()

    for node, _, s in dom.texts:
        if s is None:
            end()
        elif kept[node]:
            run.append(s)
    end()
    return "\n".join(out)


# -- features ---------------------------------------------------------------------------------------------------


@dataclass
class Lexicon:
    """Log odds of main text by tag and by attribute word, from the training pages; 0 for unknown ones."""

    tags: dict[str, float]
    words: dict[str, float]


NAMES = ("tag", "tag_low", "tag_high", "word_min", "word_max", "word_low", "word_high", "depth", "chars", "share", "link_share", "tag_count", "per_tag", "marks", "children", "siblings", "same_tag", "sibling_chars", "position", "own_share", "longest", "digits")


def node_features(doms: list[Dom], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, parents, nodes' number where each page begins) of the nodes of all pages, one after the other."""
    sizes = np.array([len(d.tags) for d in doms])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    n = begin[-1]
    parent = np.concatenate([np.array(d.parents) + b for d, b in zip(doms, begin)]) if n else np.zeros(0, int)
    page = np.repeat(np.arange(len(doms)), sizes)
    tag_odds, word_odds = lexicon.tags, lexicon.words
    tag = np.array([tag_odds.get(t, 0.0) for d in doms for t in d.tags])
    lo, hi = np.zeros(n), np.zeros(n)
    at = 0
    for d in doms:
        for w in d.words:
            if w:
                odds = [word_odds.get(x, 0.0) for x in w]
                lo[at], hi[at] = min(0.0, *odds) if len(odds) > 1 else min(0.0, odds[0]), max(0.0, *odds) if len(odds) > 1 else max(0.0, odds[0])
            at += 1
    chars, link, marks, digits = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for d, b in zip(doms, begin):
        for node, inside, s in d.texts:
            if s:
                k = len(s) if not s.isspace() else 0
                if k:
                    chars[b + node] += k
                    if inside:
                        link[b + node] += k
                    marks[b + node] += s.count(".") + s.count(",") + s.count("?") + s.count("!")
                    digits[b + node] += len(s) - len(s.translate(NO_DIGITS))
    own = chars.copy()
    depth, level = np.zeros(n, int), []
    if n:
        rootless = np.ones(n, bool)
        rootless[begin[:-1]] = False
        for k in range(len(doms)):  # parents come before children
            p, dd = doms[k].parents, [0] * sizes[k]
            for i in range(1, sizes[k]):
                dd[i] = dd[p[i]] + 1
            depth[begin[k] : begin[k + 1]] = dd
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2))
        level = [order[cuts[i] : cuts[i + 1]] for i in range(1, depth.max() + 1)]
    count, longest = np.ones(n), own.copy()
    tag_low, tag_high, word_low, word_high = tag.copy(), tag.copy(), lo.copy(), hi.copy()
    for rows in reversed(level):
        for a in (chars, link, marks, digits, count):
            np.add.at(a, parent[rows], a[rows])
        np.maximum.at(longest, parent[rows], longest[rows])
    for rows in level:
        up = parent[rows]
        tag_low[rows], tag_high[rows] = np.minimum(tag_low[rows], tag_low[up]), np.maximum(tag_high[rows], tag_high[up])
        word_low[rows], word_high[rows] = np.minimum(word_low[rows], word_low[up]), np.maximum(word_high[rows], word_high[up])
    inner = np.concatenate(level) if level else np.zeros(0, int)
    children = np.bincount(parent[inner], minlength=n).astype(float)
    names: dict[str, int] = {}
    tag_id = np.array([names.setdefault(t, len(names)) for d in doms for t in d.tags], dtype=int)
    same_key = parent * (len(names) + 1) + tag_id
    _, inverse, same = np.unique(same_key, return_inverse=True, return_counts=True)
    total = chars[begin[:-1]][page]
    per = np.maximum(children[parent], 1)
    x = np.stack(
        [
            tag, tag_low, tag_high, lo, hi, word_low, word_high, depth, np.log1p(chars), chars / np.maximum(total, 1), link / np.maximum(chars, 1), np.log1p(count),
            np.log1p(chars / count), marks / np.maximum(chars, 1) * 100, np.log1p(children), np.log1p(per), same[inverse] / per, np.log1p((chars[parent] - own[parent]) / per),
            (np.arange(n) - begin[:-1][page]) / np.maximum(sizes[page], 1), own / np.maximum(chars, 1), np.log1p(longest), digits / np.maximum(chars, 1),
        ],
        axis=1,
    )
    return x, parent, begin


# -- boosted trees ----------------------------------------------------------------------------------------------


@dataclass
class Boosted:
    """Trees of DEPTH binary tests in heap order, added up to log odds. Each test: x[feature] > threshold goes right."""

    start: float
    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, l2: float = 2.0) -> Boosted:
        """Second-order boosting of the logistic loss; splits are searched over quantile bins."""
        n, k = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        start = float(np.log(p / (1 - p)))
        f = np.full(n, start)
        inner = (1 << depth) - 1
        out_f, out_t, out_l = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, 1 << depth))
        for t in range(trees):
            q = 1 / (1 + np.exp(-f))
            g, h = q - y, np.maximum(q * (1 - q), 1e-6)
            node = np.zeros(n, int)
            for level in range(depth):
                width, first = 1 << level, (1 << level) - 1
                best, arg = np.full(width, 1e-6), [(0, np.inf, bins + 1)] * width
                gt, ht = np.bincount(node, g, width), np.bincount(node, h, width)
                for j in range(k):
                    key = node * (bins + 1) + binned[:, j]
                    gl = np.cumsum(np.bincount(key, g, width * (bins + 1)).reshape(width, -1), axis=1)
                    hl = np.cumsum(np.bincount(key, h, width * (bins + 1)).reshape(width, -1), axis=1)
                    gr, hr = gt[:, None] - gl, ht[:, None] - hl
                    gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - (gt**2 / (ht + l2))[:, None]
                    gain[:, len(edges[j]) :] = -1
                    gain[(hl < 1) | (hr < 1)] = -1
                    b = gain.argmax(1)
                    for w in np.flatnonzero(gain[np.arange(width), b] > best):
                        best[w], arg[w] = gain[w, b[w]], (j, float(edges[j][b[w]]), int(b[w]))
                test = np.array([a[0] for a in arg])[node]
                cut = np.array([a[2] for a in arg])[node]
                for w, a in enumerate(arg):
                    out_f[t, first + w], out_t[t, first + w] = a[0], a[1]
                node = 2 * node + (binned[np.arange(n), test] > cut)
            leaf = -np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + l2) * rate
            out_l[t] = leaf
            f += leaf[node]
        return Boosted(start, out_f, out_t, out_l)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        f, rows = np.full(len(x), self.start), np.arange(len(x))
        depth = self.leaves.shape[1].bit_length() - 1
        for t in range(len(self.features)):
            node = np.zeros(len(x), int)
            for level in range(depth):
                k = (1 << level) - 1 + node
                node = 2 * node + (x[rows, self.features[t][k]] > self.thresholds[t][k])
            f += self.leaves[t][node]
        return f


def decode(log_odds: np.ndarray, parent: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The likeliest labelling of each page's nodes in which nothing under a dropped node is kept: sums of log
    probabilities from the leaves up, then choices from the root down. The root itself is kept."""
    log1, log0 = -np.logaddexp(0, -log_odds), -np.logaddexp(0, log_odds)
    keep, drop = log1.copy(), log0.copy()
    kept = np.zeros(len(parent), bool)
    for s, e in zip(begin[:-1], begin[1:]):
        p, k, d = (parent[s:e] - s).tolist(), keep[s:e].tolist(), drop[s:e].tolist()
        for i in range(e - s - 1, 0, -1):
            k[p[i]] += max(k[i], d[i])
            d[p[i]] += d[i]
        got = [True] * (e - s)
        for i in range(1, e - s):
            got[i] = got[p[i]] and k[i] > d[i]
        kept[s:e] = got
    return kept


# -- training pages ---------------------------------------------------------------------------------------------

#: Pages made up for training, with their main text known by construction.
TRAINING_PAGES = 700

# Names in use for parts of pages.
GOOD_NAMES = "article content post entry story body main text page single copy prose paragraph lead title headline section hentry markdown".split()
BAD_NAMES = {
    "nav": "nav navigation menu navbar breadcrumb breadcrumbs topnav links pager pagination tabs skip toc".split(),
    "header": "header masthead banner top branding logo site".split(),
    "footer": "footer bottom copyright legal colophon imprint foot".split(),
    "aside": "sidebar aside widget related recommended rail secondary popular trending more tags".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsense dfp banner".split(),
    "notice": "cookie consent notice alert popup modal gdpr overlay subscribe paywall message toast".split(),
    "form": "form search login newsletter signup contact subscribe".split(),
    "comments": "comments comment reply replies discussion respond disqus thread reader feedback".split(),
    "share": "share social sharing follow buttons tools print byline meta".split(),
}


class PageMaker:
    """Random pages: words, tags, names, nesting and order vary, and so does how cleanly they are written."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        w = ["".join(r.choice("bdfgklmnprstvw") + r.choice("aeiouäéí") for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(low, high))]
        return " ".join(w).capitalize()

    def sentence(self, low: int = 4, high: int = 18) -> str:
        s = self.words(low, high)
        if self.r.random() < 0.3:
            s = s.replace(" ", ", ", 1)
        return s + self.r.choice([".", ".", ".", "!", "?", " &amp; co."])

    def prose(self) -> str:
        r = self.r
        n = 1 if r.random() < 0.25 else r.randrange(1, 7)
        s = " ".join(self.sentence() for _ in range(n))
        for tag in ("b", "em", "i", "strong"):
            if r.random() < 0.08:
                s = f"<{tag}>{s}" + ("" if r.random() < 0.3 else f"</{tag}>")
        if r.random() < 0.15:
            s += f' <a href="/{self.words(1, 2)}">{self.words(1, 4)}</a> ' + self.sentence()
        if r.random() < 0.15:
            s += "<br>" + (self.sentence() if r.random() < 0.5 else "")
        if r.random() < 0.05:
            s = " | ".join(self.words(1, 2) for _ in range(r.randrange(5, 25)))
        return s

    def names(self, kind: str | None) -> str:
        r = self.r
        if r.random() < 0.3:
            return ""
        pool = BAD_NAMES[kind] if kind else GOOD_NAMES
        n = "-".join(r.sample(pool, r.choice([1, 1, 2]))) + (f" {self.words(1, 2).lower()}" if r.random() < 0.2 else "")
        return f' {r.choice(["class", "class", "id"])}="{n}"'

    def links(self, n: int) -> str:
        one = lambda: f'<a href="/{self.words(1, 2)}">{self.words(1, 4)}</a>'
        kind = self.r.randrange(3)
        if kind == 0:
            return "<ul>" + "".join(f"<li>{one()}</li>" for _ in range(n)) + "</ul>"
        return (" | " if kind == 1 else " ").join(one() for _ in range(n))

    def bad(self, kind: str) -> str:
        r = self.r
        named = self.names(kind)
        sure = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        tag = sure if sure and (r.random() < 0.6 or not named) else "div" if named or kind in ("ad",) else "div"
        if tag == "div" and not named:
            named = f' class="{r.choice(BAD_NAMES[kind])}"'
        if kind == "nav":
            inner = self.links(r.randrange(2, 10))
        elif kind == "header":
            inner = f"<h1>{self.words(1, 4)}</h1>" * r.randrange(2) + f"<p>{self.words(2, 6)}</p>" * r.randrange(2) + self.links(r.randrange(1, 5))
        elif kind == "footer":
            inner = f"&copy; {self.words(1, 3)} &middot; {self.sentence(1, 9)}" if r.random() < 0.6 else f"<p>{self.sentence()}</p>" + self.links(r.randrange(1, 6))
        elif kind == "aside":
            inner = f"<h3>{self.words(1, 3)}</h3>" + (self.links(r.randrange(2, 7)) if r.random() < 0.6 else f"<p>{self.sentence()}</p>" * r.randrange(1, 3))
        elif kind in ("ad", "notice"):
            inner = " ".join(self.sentence(2, 10) for _ in range(r.randrange(1, 4)))
            inner = f"<p>{inner}</p>" if r.random() < 0.4 else inner
            inner += "<button>OK</button>" if kind == "notice" and r.random() < 0.6 else ""
        elif kind == "form":
            inner = f"<label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 2)}</button>" + f"<p>{self.sentence()}</p>" * r.randrange(2)
            tag = "form"
        elif kind == "comments":
            each = lambda: f"<{c}{self.names('comments')}><b>{self.words(1, 2)}</b> <p>{self.prose()}</p></{c}>"
            c = r.choice(["div", "li", "article", "section"])
            inner = f"<h3>{self.words(1, 3)}</h3>" * r.randrange(2) + "".join(each() for _ in range(r.randrange(1, 6)))
            tag = r.choice(["div", "section", "ol"]) if c != "li" else "ol"
            named = f' {r.choice(["class", "id"])}="{r.choice(BAD_NAMES[kind])}"'
        else:
            inner = self.links(r.randrange(1, 5)) if r.random() < 0.6 else self.words(1, 6)
        return f"<{tag}{named}>{inner}</{tag}>"

    def page(self) -> tuple[str, set[str]]:
        """A page in which main text carries marks: the words of main text end in 'q', no others do."""
        r = self.r
        body = [f"<h1>{self.words(2, 12)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice([0, 1, 2, 3, 5, 8, 14])):
            k = r.random()
            if k < 0.72:
                body.append(f"<p>{self.prose()}" + ("" if r.random() < 0.25 else "</p>"))
            elif k < 0.8:
                body.append(f"<h{(h := r.randrange(2, 5))}>{self.words(1, 7)}</h{h}>")
            elif k < 0.86:
                body.append("<ul>" + "".join(f"<li>{self.sentence(2, 9)}</li>" for _ in range(r.randrange(2, 6))) + "</ul>")
            elif k < 0.9:
                body.append(f"<blockquote><p>{self.prose()}</p></blockquote>")
            elif k < 0.94:
                body.append(f"<div>{self.prose()}</div>")
            else:
                body.append("<table><tr>" + "".join(f"<td>{self.words(1, 4)}</td>" for _ in range(4)) + "</tr></table>")
        if not body:
            body = [f"<p>{self.prose()}</p>"]
        body = [re.sub(r"(?<![<&/\w])([a-zäéí]{2,})(?=[^<>]*(?:<|$))", r"\1q", b, flags=re.I) for b in body]
        for kind in r.sample(["ad", "share", "form", "aside", "notice"], r.choice([0, 0, 0, 1, 2])):
            body.insert(r.randrange(1, len(body) + 1), self.bad(kind))
        main = "".join(body)
        wrap = r.choice(["article", "article", "main", "div", "section"])
        named = self.names(None)
        if wrap == "div" and not named:
            named = f' class="{r.choice(GOOD_NAMES)}"'
        main = f"<{wrap}{named}>{main}</{wrap}>"
        if r.random() < 0.3:
            main = f"<div{self.names(None)}>{main}</div>"
        before = [self.bad(k) for k in ("nav", "header", "notice", "ad", "form") if r.random() < 0.45]
        after = [self.bad(k) for k in ("aside", "comments", "ad", "nav", "share", "footer") if r.random() < 0.4]
        if r.random() < 0.25:
            before.append(self.bad("aside"))
        page = "".join(before) + main + "".join(after)
        if r.random() < 0.3:
            page = f"<div{r.choice(['', ' id=wrapper', ' class=container'])}>{page}</div>"
        if r.random() < 0.9:
            page = f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title><script>var t='</p>';</script></head><body>{page}</body></html>"
        return page


def training_set(pages: int = TRAINING_PAGES, seed: int = 7) -> tuple[list[Dom], list[np.ndarray]]:
    """DOMs with their nodes' labels: 1 if main text stands in the node or below, 0 if only other text does, and -1
    for nodes without text, which teach nothing."""
    maker, doms, labels = PageMaker(seed), [], []
    for _ in range(pages):
        d = parse(maker.page())
        good, any_ = np.zeros(len(d.tags), bool), np.zeros(len(d.tags), bool)
        for node, _, s in d.texts:
            if s and not s.isspace():
                any_[node] = True
                good[node] |= bool(re.search(r"\wq\b", s))
        for i in range(len(d.tags) - 1, 0, -1):
            good[d.parents[i]] |= good[i]
            any_[d.parents[i]] |= any_[i]
        doms.append(d)
        labels.append(np.where(any_, good.astype(int), -1))
    return doms, labels


@dataclass
class Extractor:
    lexicon: Lexicon
    trees: Boosted

    @staticmethod
    def train(pages: int = TRAINING_PAGES, seed: int = 7) -> Extractor:
        doms, labels = training_set(pages, seed)
        seen: list[dict[str, list[int]]] = [{}, {}]
        for d, y in zip(doms, labels):
            for tag, words, good in zip(d.tags, d.words, y):
                if good >= 0:
                    for table, keys in zip(seen, ((tag,), words)):
                        for k in keys:
                            table.setdefault(k, [0, 0])[good] += 1
        odds = [{k: float(np.log((g + 0.5) / (b + 0.5))) for k, (b, g) in t.items() if b + g >= 3} for t in seen]
        lexicon = Lexicon(*odds)
        x, _, _ = node_features(doms, lexicon)
        y = np.concatenate(labels)
        return Extractor(lexicon, Boosted.fit(x[y >= 0], y[y >= 0].astype(float)))

    def texts(self, pages: list[str]) -> list[str]:
        doms = [parse(p) for p in pages]
        if not doms:
            return []
        x, parent, begin = node_features(doms, self.lexicon)
        kept = decode(self.trees.log_odds(x), parent, begin)
        return [blocks(d, kept[s:e]) for d, s, e in zip(doms, begin[:-1], begin[1:])]


@lru_cache(1)
def trained() -> Extractor:
    """The extractor with its production parameters, learned once a process."""
    return Extractor.train()


def extract(pages: DataFrame, extractor: Extractor, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """row, a struct of keep's columns, text and n_chars for each row of pages; columns may have any name. Null and blank pages, and such without main text,
    give an empty text; repeated rows stay; an empty table gives an empty one."""
    shared = sent(pages.sparkSession, extractor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = shared()
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                texts = extractor.texts(part.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["row", "text", "n_chars"])

    row = F.struct(*[F.col(f"`{k}`") for k in keep]) if keep else F.lit(None).cast("int")
    slim = pages.select(row.alias("row"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return slim.mapInArrow(run, T.StructType([slim.schema["row"], *T.StructType.fromDDL("text string, n_chars long")]))
