"""Main text of HTML pages by a tree-structured graphical model.

Every DOM node has a hidden state, content or not. Node potentials come from
features of the node (its tag, words in its class and id, link and text
density, length), parent-child potentials from how often states go together.
The graph is the DOM tree, so sum-product messages sent once upward and once
downward give exact marginals. Text whose block has a content marginal of one
half or more is the main text.

A node's features say nothing of the nodes around it but through its text: that
a paragraph of a sidebar is none of the article is left to the messages.
A heading that stands beside an article, outside the list of comments it belongs
to, therefore can't be told from a heading of the article, and stays.

The potentials are trained together on labelled pages: a generator of varied
layouts (articles with menus, sidebars, adverts, comments in boxes or lists, pages
laid out as tables, broken markup) knows which text it wrote as content. Training takes a few hundred small pages on the
driver; extraction is one pass without a shuffle, one page at a time.

Blocks: text is gathered up to the next border of a block element; character
references are decoded, white space inside a block becomes one space, blocks
are joined in page order by a line feed. A line break element is white space.

Defined results: null and empty pages give the empty text; unclosed, crossed or
stray tags are repaired as browsers do for paragraphs, list items, an unclosed
head and drawings, and ignored otherwise; repeated rows are extracted one by one; extra columns are
ignored. Depth has no limit: nothing recurses.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HIDDEN = frozenset("script style noscript template head title svg math iframe object audio video canvas select option button textarea datalist".split())
#: What may stand in a head; anything else ends it. What ends embedded drawings and formulas, unless they hold HTML.
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template noframes head html".split())
FOREIGN = frozenset("svg math".split())
BREAKS_OUT = frozenset("b blockquote body br center code dd div dl dt em h1 h2 h3 h4 h5 h6 hr i img li ol p pre span strong table ul".split())
#: What an opening tag closes, up to the nearest of the second set.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
INLINE_OPEN = frozenset("a b i em strong u s small big font span code tt mark sub sup abbr cite q label".split())

_NAMES_OUT = re.compile(
    r"(?:^|[-_ ])(?:nav\w*|menu\w*|breadcrumbs?|head(?:er)?|foot(?:er)?|masthead|banner|side\w*|aside|widget\w*|related|recommend\w*|share|social|"
    r"ads?|adv\w*|advert\w*|sponsor\w*|promo\w*|popup|modal|cookie\w*|consent|gdpr|notice\w*|alert|newsletter|subscri\w*|sign-?up|login|"
    r"form|search|comments?\w*|repl(?:y|ies)|disqus|discuss\w*|pager|paginat\w*|tags?|meta|byline|toolbar|copyright|legal|disclaimer)(?:$|[-_ \d])", re.I
)
_NAMES_IN = re.compile(r"(?:^|[-_ ])(?:article\w*|content|main|body|post|entry|story|text|page)(?:$|[-_ \d])|(?:article|post|entry|story)-?(?:body|content|text)", re.I)


# -- the tree


class Tree(HTMLParser):
    """Nodes as parallel lists; texts hang on nodes in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.names, self.role = ["#root"], [-1], [""], [""]
        self.texts: list[tuple[int, str]] = []  # (node, text) in page order; an empty text is a border of a block
        self.open = [0]
        self.count: dict[str, int] = {}  # open elements by name, so that no search runs in vain

    def _close(self, depth: int) -> None:
        for node in self.open[depth:]:
            self.count[self.tag[node]] -= 1
        del self.open[depth:]

    def _close_from(self, names: frozenset[str]) -> None:
        """Close the outermost open element of one of these names, with all inside it."""
        for depth in range(1, len(self.open)):
            if self.tag[self.open[depth]] in names:
                self._close(depth)
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.count.get("head") and (tag == "body" or (tag not in IN_HEAD and self.tag[self.open[-1]] == "head")):
            self._close_from(frozenset(["head"]))
        if tag in BREAKS_OUT and any(self.count.get(name) for name in FOREIGN) and not self.count.get("foreignobject"):
            self._close_from(FOREIGN)
        if tag in CLOSES:
            closed, limit = CLOSES[tag]
            held = any(self.count.get(name) for name in closed)
            for depth in range(len(self.open) - 1, 0, -1) if held else ():
                name = self.tag[self.open[depth]]
                if name in limit:
                    break
                if name in closed:
                    self._close(depth)
                    break
        if tag in BLOCK:
            # an open paragraph, with what is open inside it, ends at a block
            for depth in range(len(self.open) - 1, 0, -1) if self.count.get("p") else ():
                name = self.tag[self.open[depth]]
                if name == "p":
                    self._close(depth)
                    break
                if name in BLOCK and name not in INLINE_OPEN:
                    break
            self.texts.append((self.open[-1], ""))
        if tag == "br":
            self.texts.append((self.open[-1], " "))
        if tag in VOID:
            return
        given = {k: v or "" for k, v in attrs}
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.names.append(f"{given.get('class', '')} {given.get('id', '')}".strip())
        hidden = "hidden" in given or given.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", given.get("style", ""))
        self.role.append("hidden" if hidden else given.get("role", ""))
        self.open.append(len(self.tag) - 1)
        self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        # Only foreign elements can close themselves; elsewhere the slash is ignored, as browsers do.
        if any(self.count.get(name) for name in FOREIGN) and self.tag[self.open[-1]] == tag and tag not in VOID:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1) if self.count.get(tag) else ():
            name = self.tag[self.open[depth]]
            if name == tag:
                if tag in BLOCK:
                    self.texts.append((self.open[depth], ""))
                self._close(depth)
                return
            if tag in INLINE_OPEN and name in BLOCK:
                return  # a stray inline end
        if tag == "br":
            self.texts.append((self.open[-1], " "))

    def handle_data(self, data: str) -> None:
        if self.tag[self.open[-1]] == "head" and not data.isspace():
            self._close_from(frozenset(["head"]))
        self.texts.append((self.open[-1], data))


def parse(html: str) -> Tree:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree


# -- features

FEATURES = (
    "bias", "nav", "aside", "footer", "header", "form", "article", "main", "p", "heading", "list", "quote", "pre", "table", "div", "hidden",
    "figure", "names_out", "names_in", "names_both", "links_high", "links_some", "long", "medium", "short", "sentence", "role_out", "inline", "holds_main",
    "linked_cell",
)
_TAG_FEATURE = {
    "nav": "nav", "menu": "nav", "aside": "aside", "footer": "footer", "header": "header", "form": "form", "fieldset": "form", "label": "form",
    "article": "article", "main": "main", "p": "p", "ul": "list", "ol": "list", "li": "list", "dl": "list", "blockquote": "quote", "pre": "pre",
    "table": "table", "tr": "table", "td": "table", "div": "div", "section": "div", "figure": "figure", "figcaption": "figure",
    "dialog": "aside", "address": "footer",
    **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "heading"),
}
_ROLES_OUT = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_AT = {name: i for i, name in enumerate(FEATURES)}


def features(tree: Tree) -> np.ndarray:
    """A row of FEATURES for each node."""
    n = len(tree.tag)
    x = np.zeros((n, len(FEATURES)))
    chars, linked = np.zeros(n), np.zeros(n)
    ends = np.zeros(n)
    for node, text in tree.texts:
        size = len(text) if text.isspace() is False else 0
        chars[node] += size
        if size and text.rstrip().endswith((".", "!", "?", "…")):
            ends[node] += 1
    for node in range(n):
        if tree.tag[node] == "a":
            linked[node] = chars[node]
    for node in range(n - 1, 0, -1):  # children come after parents
        up = tree.parent[node]
        if tree.tag[node] == "a":
            linked[node] = max(linked[node], chars[node])
        if tree.tag[node] not in HIDDEN:
            chars[up] += chars[node]
            linked[up] += linked[node]
            ends[up] += ends[node]
    # Whether a node is around an article or a title, so that its name says little: a page whose class names a menu, say.
    holds = np.zeros(n, bool)
    for node in range(n - 1, 0, -1):
        holds[tree.parent[node]] |= holds[node] or tree.tag[node] in ("article", "main", "h1")
    names_of: dict[str, tuple[bool, bool]] = {}
    for node in range(n):
        tag, names, role = tree.tag[node], tree.names[node], tree.role[node]
        row = x[node]
        row[_AT["bias"]] = 1
        kind = _TAG_FEATURE.get(tag)
        if kind and not (kind == "form" and holds[node]):
            row[_AT[kind]] = 1
        elif tag not in HIDDEN and tag not in BLOCK:
            row[_AT["inline"]] = 1
        if tag in HIDDEN or role == "hidden":
            row[_AT["hidden"]] = 1
        if names and tag not in ("html", "body"):
            if names not in names_of:
                names_of[names] = (bool(_NAMES_OUT.search(names)), bool(_NAMES_IN.search(names)))
            a, b = names_of[names]
            b = b or tag in ("article", "main")
            both = a and (b or holds[node])
            row[_AT["names_both"]], row[_AT["names_out"]], row[_AT["names_in"]] = both, a and not both, b and not a
        if role in _ROLES_OUT:
            row[_AT["role_out"]] = 1
        row[_AT["holds_main"]] = holds[node]
        size = chars[node]
        density = linked[node] / size if size else 0
        row[_AT["links_high"]], row[_AT["links_some"]] = density > 0.6, 0.3 < density <= 0.6
        row[_AT["linked_cell"]] = density > 0.6 and tag in ("td", "th")
        row[_AT["long"]], row[_AT["medium"]], row[_AT["short"]] = size >= 200, 40 <= size < 200, size < 40
        row[_AT["sentence"]] = ends[node] > 0
    return x


# -- the model


@dataclass
class Potentials:
    weights: np.ndarray  # log odds of content from a node's features
    pair: np.ndarray  # log potential of (parent state, child state)


def marginals(tree: Tree, model: Potentials, x: np.ndarray | None = None) -> np.ndarray:
    """The probability of content of each node: messages up the tree, then down."""
    x = features(tree) if x is None else x
    n = len(tree.tag)
    score = np.zeros((n, 2))
    score[:, 1] = x @ model.weights
    score -= score.max(axis=1, keepdims=True)
    own, pair = np.exp(score).tolist(), np.exp(model.pair).tolist()
    (p00, p01), (p10, p11) = pair
    # up: what the subtree of each node says to its parent
    below = [list(v) for v in own]
    up: list[tuple[float, float]] = [(1.0, 1.0)] * n
    for node in range(n - 1, 0, -1):
        b0, b1 = below[node]
        m0, m1 = p00 * b0 + p01 * b1, p10 * b0 + p11 * b1
        s = m0 + m1
        up[node] = m0, m1 = m0 / s, m1 / s
        parent = below[tree.parent[node]]
        parent[0] *= m0
        parent[1] *= m1
        s = parent[0] + parent[1]
        parent[0] /= s
        parent[1] /= s
    # down: what the rest of the tree says to each node
    belief = below
    for node in range(1, n):
        f0, f1 = belief[tree.parent[node]]
        u0, u1 = up[node]
        r0, r1 = f0 / max(u0, 1e-300), f1 / max(u1, 1e-300)
        s = r0 + r1
        r0, r1 = r0 / s, r1 / s
        b0, b1 = belief[node][0] * (r0 * p00 + r1 * p10), belief[node][1] * (r0 * p01 + r1 * p11)
        s = b0 + b1
        belief[node] = [b0 / s, b1 / s]
    return np.array([b[1] for b in belief])


class _Forest:
    """The trees of many pages side by side; a level of all trees is passed at once."""

    def __init__(self, trees: list[Tree]):
        sizes = [len(t.tag) for t in trees]
        starts = np.cumsum([0, *sizes])
        self.parent = np.concatenate([np.where(np.array(t.parent) < 0, -1, np.array(t.parent) + at) for t, at in zip(trees, starts, strict=False)])
        depth = np.zeros(len(self.parent), int)
        for node in range(len(depth)):
            if self.parent[node] >= 0:
                depth[node] = depth[self.parent[node]] + 1
        self.levels = [np.flatnonzero(depth == d) for d in range(depth.max(initial=0) + 1)]

    def expected(self, own: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The marginals of content for log odds ``own`` of the nodes, and the expected counts of (parent, child) states."""
        up, below = np.zeros(len(own)), own.copy()
        for nodes in self.levels[:0:-1]:
            b = below[nodes]
            up[nodes] = np.logaddexp(pair[1, 0], pair[1, 1] + b) - np.logaddexp(pair[0, 0], pair[0, 1] + b)
            np.add.at(below, self.parent[nodes], up[nodes])
        belief, counts = below.copy(), np.zeros((2, 2))
        for nodes in self.levels[1:]:
            rest = belief[self.parent[nodes]] - up[nodes]
            b = below[nodes]
            belief[nodes] = b + np.logaddexp(pair[0, 1], pair[1, 1] + rest) - np.logaddexp(pair[0, 0], pair[1, 0] + rest)
            joint = np.array([[pair[0, 0] + 0 * b, pair[0, 1] + b], [pair[1, 0] + rest, pair[1, 1] + rest + b]])
            joint = np.exp(joint - joint.max(axis=(0, 1)))
            counts += (joint / joint.sum(axis=(0, 1))).sum(axis=2)
        return 1 / (1 + np.exp(-np.clip(belief, -500, 500))), counts


def fit(pages: list[tuple[Tree, np.ndarray]], rounds: int = 240, ridge: float = 0.5, step: float = 0.1) -> Potentials:
    """Node weights and pair potentials together, by the largest likelihood of the labels.

    Its slope is the difference between the features' sums over the labels and
    those expected under the model, which message passing gives exactly. The
    likelihood has one peak; Adam's method climbs it.
    """
    forest = _Forest([t for t, _ in pages])
    x, y = np.vstack([features(t) for t, _ in pages]), np.concatenate([labels for _, labels in pages])
    child = forest.parent >= 0
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[forest.parent[child]].astype(int), y[child].astype(int)), 1)
    w = np.zeros(x.shape[1] + 4)
    mean, spread = np.zeros_like(w), np.zeros_like(w)
    for n in range(1, rounds + 1):
        marginal, counts = forest.expected(x @ w[:-4], w[-4:].reshape(2, 2))
        slope = np.concatenate([x.T @ (y - marginal), (seen - counts).ravel()]) - ridge * w
        mean, spread = 0.9 * mean + 0.1 * slope, 0.99 * spread + 0.01 * slope**2
        rate = step * (1 if n < 0.7 * rounds else 0.2)
        w += rate * (mean / (1 - 0.9**n)) / (np.sqrt(spread / (1 - 0.99**n)) + 1e-9)
    return Potentials(w[:-4], w[-4:].reshape(2, 2))


# -- labelled pages

_SYLLABLES = "an be co da el fi ga ho in ja ko li mo ne or pa qui re su ta un vo wa xe yo za".split()


class _Writer:
    """Writes one page and marks its content with a private character that training removes."""

    MARK = ""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(low, high))]
        return " ".join(out)

    def prose(self, low: int = 1, high: int = 60) -> str:
        text = " ".join(self.words(2, 14).capitalize() + self.r.choice([".", ".", "?", "!", ","]) for _ in range(max(1, self.r.randint(low, high) // 8)))
        return escape(text) + self.r.choice(["", "", " &amp; more", " &nbsp;&hellip;"])

    def name(self, names: str) -> str:
        pick = self.r.choice(names.split())
        return self.r.choice([f' class="{pick}"', f' id="{pick}"', f' class="{pick} x{self.r.randint(1, 9)}"'])

    def menu(self) -> str:
        items = "".join(f'<li><a href="/{i}">{self.words(1, 2)}</a>{self.r.choice(["</li>", ""])}' for i in range(self.r.randint(3, 10)))
        tag = self.r.choice(["<nav>{}</nav>", "<div" + self.name("nav menu navbar topnav breadcrumbs") + ">{}</div>", "<header>{}</header>"])
        return tag.format(f"<ul>{items}</ul>")

    def notice(self) -> str:
        kinds = "ad ads advert sponsored promo cookie-notice banner newsletter popup notice consent"
        tag = self.r.choice(["div", "div", "aside", "section"])
        return f"<{tag}{self.name(kinds)}>{self.r.choice(['', '<p>'])}{self.prose(1, 30)}</{tag}>"

    def sidebar(self) -> str:
        links = "".join(f'<li><a href="#">{self.words(2, 6)}</a></li>' for _ in range(self.r.randint(2, 7)))
        return self.r.choice(["<aside>{}</aside>", "<div" + self.name("sidebar side related widget") + ">{}</div>"]).format(f"<h3>{self.words(1, 3)}</h3><ul>{links}</ul>")

    def form(self) -> str:
        return f'<form action="/s"><label>{self.words(1, 3)}</label><input name="q"><button>{self.words(1, 1)}</button><p>{self.prose(1, 20)}</p></form>'

    def comments(self) -> str:
        if self.r.random() < 0.5:
            return self.comment_list()
        each = "".join(f"<div{self.name('comment reply')}><p>{self.prose(2, 40)}</p></div>" for _ in range(self.r.randint(1, 5)))
        return self.r.choice(["<section{}>{}</section>", "<div{}>{}</div>"]).format(self.name("comments comment-list discussion"), f"<h2>{self.words(1, 2)}</h2>{each}")

    def comment_list(self) -> str:
        r = self.r
        tag, named, inner = r.choice(["ol", "ul"]), r.choice(["", self.name("comment reply depth")]), r.choice(["<p>{}</p>", "<p>{}</p>", "<div>{}</div>", "{}"])
        by = r.choice(["", "<cite>{}</cite> ", "<b>{}</b><br>", "<div class='author'>{}</div>"])
        each = "".join(f"<li{named}>{by.format(self.words(1, 2))}{inner.format(self.prose(2, 60))}{r.choice(['</li>', ''])}" for _ in range(r.randint(1, 6)))
        return f"{r.choice(['', f'<h3>{self.words(1, 2)}</h3>'])}<{tag}{self.name('commentlist comment-list comments replies')}>{each}</{tag}>"

    def cell_menu(self) -> str:
        between = self.r.choice([" ", "<br>", " | ", "<p>"])
        return between.join(f'<a href="/{i}">{self.words(1, 2)}</a>' for i in range(self.r.randint(2, 10)))

    def in_table(self, article: str) -> str:
        """Page and menus as cells of a table, as pages without style sheets have them."""
        r, name = self.r, self.name
        row = [f"<td{r.choice(['', '', name('menu nav left')])}>{self.cell_menu()}</td>", f"<td{r.choice(['', '', name('content main')])}>{article}</td>"]
        if r.random() < 0.4:
            row.append(f"<td>{r.choice([self.cell_menu, self.sidebar, self.notice])()}</td>")
        above = f"<tr><td colspan={len(row)}>{self.cell_menu()}</td></tr>" if r.random() < 0.3 else ""
        return f"<table{r.choice(['', name('layout')])}>{above}<tr>{''.join(row)}</tr></table>"

    def footer(self) -> str:
        return self.r.choice(["<footer>{}</footer>", "<div" + self.name("footer foot copyright") + ">{}</div>"]).format(f"&copy; {self.words(1, 3)} &middot; {self.prose(1, 20)}")

    def block(self) -> str:
        m, r = self.MARK, self.r
        kind = r.random()
        if kind < 0.62:
            link = f' <a href="/x">{m}{self.words(1, 3)}</a> {m}{self.words(1, 5)}' if r.random() < 0.25 else ""
            bold = r.choice(["", "", "<b>", "<em>"])
            return f"<p>{bold}{m}{self.prose(1, 90)}{link}{r.choice(['</p>', '</p>', '<br>'])}"
        if kind < 0.72:
            return f"<h{r.randint(2, 4)}>{m}{self.words(1, 8)}</h{r.randint(2, 4)}>"
        if kind < 0.82:
            return "<ul>" + "".join(f"<li>{m}{self.prose(1, 20)}{r.choice(['</li>', ''])}" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote><p>{m}{self.prose(2, 30)}</p></blockquote>"
        if kind < 0.94:
            return f"<pre>{m}{self.words(3, 20)}</pre>"
        if kind < 0.97:
            return "<dl>" + "".join(f"<dt>{m}{self.words(1, 3)}<dd>{m}{self.prose(1, 20)}" for _ in range(r.randint(1, 4))) + "</dl>"
        return "<table>" + "".join(f"<tr><td>{m}{self.words(1, 3)}<td>{m}{self.words(1, 5)}" for _ in range(r.randint(2, 4))) + "</table>"

    def page(self) -> str:
        r, m = self.r, self.MARK
        body = "".join(self.block() for _ in range(r.randint(1, 12)))
        if r.random() < 0.3:
            body += self.notice()
        if r.random() < 0.15:
            body += self.form()
        article = f"<h1>{m}{self.words(2, 9)}</h1>{body}"
        odd = r.choice(["", "", "", " tags", " has-sidebar", " header-fixed", " menu-open", " share"])
        wrap = r.choice(["<article>{}</article>"] * 3 + [f"<article class='post{odd}'>{{}}</article>", f"<div class='page{odd}'><article>{{}}</article></div>"] + ["<main>{}</main>", "<main><article>{}</article></main>", "<div" + self.name("content article post entry-content main story") + ">{}</div>", "<div>{}</div>"])
        laid = self.in_table(r.choice([article, wrap.format(article)])) if r.random() < 0.12 else wrap.format(article)
        parts = [self.menu()] + [f() for f in (self.notice, self.form, self.sidebar) if r.random() < 0.5] + [laid]
        parts += [f() for f in (self.comments, self.sidebar, self.notice) if r.random() < 0.4] + [self.footer()]
        ends = r.choice(["</head><body>", "</head><body class='no-sidebar menu-fixed'>", "<body>", ""])
        head = f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{x:1}}</style><script>var a='</p>';</script>{ends}"
        inner = "<!-- n -->".join(parts)
        inner = r.choice(["{}"] * 3 + ["<div id='page' class='site{1}'>{0}</div>", "<div class='container'><div class='row'>{0}</div></div>", "<form id='aspnetForm'>{0}</form>"]).format(inner, odd)
        return head + inner + r.choice(["</body></html>", ""])


def labelled_page(seed: int) -> tuple[Tree, np.ndarray]:
    """A page and whether each node is content: it holds marked text, or it has no text and its parent is content."""
    tree = parse(_Writer(seed).page())
    n = len(tree.tag)
    marked, other = np.zeros(n, bool), np.zeros(n, bool)
    for node, text in tree.texts:
        if text.strip():
            (marked if _Writer.MARK in text else other)[node] = True
    label = marked.copy()
    for node in range(n - 1, 0, -1):
        label[tree.parent[node]] |= label[node]
        other[tree.parent[node]] |= other[node]
    for node in range(1, n):
        if not label[node] and (not other[node] or tree.tag[node] in INLINE_OPEN):
            label[node] = label[tree.parent[node]]  # inline leftovers of a content block belong to it
    tree.texts = [(node, text.replace(_Writer.MARK, "")) for node, text in tree.texts]
    return tree, label


@lru_cache(maxsize=4)
def trained(pages: int = 240, seed: int = 1) -> Potentials:
    return fit([labelled_page(seed * 1_000_003 + i) for i in range(pages)])


# -- extraction


def main_text(html: str | None, model: Potentials) -> str:
    if not html:
        return ""
    tree = parse(html)
    probability = marginals(tree, model)
    hidden = [False] * len(tree.tag)
    for node in range(1, len(tree.tag)):
        hidden[node] = hidden[tree.parent[node]] or tree.tag[node] in HIDDEN or tree.role[node] == "hidden"
    # Inline elements share the state of the block they are in.
    block = list(range(len(tree.tag)))
    for node in range(1, len(tree.tag)):
        if tree.tag[node] not in BLOCK and tree.tag[node] not in HIDDEN:
            block[node] = block[tree.parent[node]]
    blocks: list[str] = []
    run: list[str] = []
    for node, text in [*tree.texts, (0, "")]:
        if not text:
            joined = " ".join("".join(run).split())
            if joined:
                blocks.append(joined)
            run = []
        elif not hidden[node] and probability[block[node]] >= 0.5:
            run.append(text)
    return "\n".join(blocks)


def extract(pages: DataFrame, model: Potentials | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [main_text(h, model) for h in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    shown = pages.select(F.col("page_id").cast("bigint"), "url", "html")
    return shown.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
