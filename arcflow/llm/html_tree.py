"""Main text of HTML pages by a tree-structured graphical model.

A page becomes a tree: its block elements, and under them its blocks of text. Every node has a hidden label, content or
not. A node's potential is the sum of weights of its features (tag, names in class, id and role, share of linked text,
length, punctuation); each edge has a parent-child potential by the kind of child. Sum-product messages go up the
trees and down again, level by level for all pages of a batch at once, and give each node's marginal. Blocks of text
whose content marginal is at least `CUT` are the main text.

The weights are those of a conditional random field, trained by gradient ascent on the exact log-likelihood (the same
two passes give its expectations) from labelled pages: `labelled_pages` composes pages with known main text from the
markup that articles, menus, notices, adverts, forms and comments are written in, and `distant_labels` adds at most
`SAMPLE_PAGES` pages of the corpus whose <article> marks the main text.

Text rules: scripts, styles and other raw elements are never text; character references are decoded; white space within
a block becomes one blank; blocks are joined by a line feed in page order; <br> is white space.

Defined results: a null or empty html, or one without content, gives an empty text of 0 characters; unclosed and
unmatched tags are repaired as browsers do; repeated rows give repeated results.
"""

from __future__ import annotations

import html as html_lib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Carry, per_batch, pieces

CUT = 0.5
SAMPLE_PAGES = 100
COMPOSED_PAGES = 900
STEPS, RATE, PENALTY = 300, 0.1, 3e-4

INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is not markup; none of them is text of the page.
RAW = set("script style textarea title xmp iframe noembed noframes".split())
#: Elements that are not text of the page, whatever they hold.
UNSEEN = set("head template svg math object audio video canvas select datalist".split())
#: Elements that can stand in a head; any other one, or text, closes an open head.
IN_HEAD = set("html head base basefont bgsound link meta noframes noscript script style template title".split())
#: What a new element closes: an open element of these names, up to a boundary.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
IN_PARAGRAPH_CLOSE = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
PARAGRAPH_SCOPE = set("button td th table caption object html".split())

TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Kinds of edges, by what the child is: a block of text, an element of running text, a container, any other element.
KINDS = 4
RUNNING = set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table tbody thead tfoot tr td th figure figcaption caption".split())
CONTAINER = set("div section article main center".split())


def kind_of(tag: str) -> int:
    return 0 if tag == "#text" else 1 if tag in RUNNING else 2 if tag in CONTAINER else 3


class Page:
    """Nodes in page order, parents first. Node 0 is the root."""

    __slots__ = ("parent", "tag", "names", "text", "linked")

    def __init__(self):
        self.parent, self.tag, self.names, self.text, self.linked = [-1], ["#root"], [()], [None], [0]

    def add(self, parent: int, tag: str, names: tuple[str, ...] = (), text: str | None = None, linked: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(names)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.parent) - 1


def parse(source: str | None) -> Page:
    page = Page()
    if not source:
        return page
    stack: list[tuple[str, int]] = [("#root", 0)]  # element name and the node of its block
    pieces: list[str] = []
    linked = links = unseen = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            raw = "".join(pieces)
            pieces.clear()
            text = " ".join((html_lib.unescape(raw) if "&" in raw else raw).split())
            if text:
                page.add(stack[-1][1], "#text", (), text, min(linked, len(text)))
            linked = 0

    def pop_to(depth: int) -> None:
        nonlocal links, unseen
        if any(n not in INLINE for n, _ in stack[depth:]):
            flush()
        for n, _ in stack[depth:]:
            links -= n == "a"
            unseen -= n in UNSEEN
        del stack[depth:]

    def leave_head() -> None:
        if stack[-1][0] == "head":
            pop_to(len(stack) - 1)

    while True:
        m = TOKEN.search(source, at)
        end_of_text = m.start() if m else len(source)
        if stack[-1][0] == "head" and source[at:end_of_text].strip():
            leave_head()
        if not unseen and (m is None or m.start() > at):
            piece = source[at:end_of_text]
            pieces.append(piece)
            if links:
                linked += len(piece.strip())
        if m is None:
            break
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    pop_to(depth)
                    break
                if name in INLINE and stack[depth][0] not in INLINE:
                    break
            continue
        if name == "body":
            open_names = [n for n, _ in stack]
            if "head" in open_names and "template" not in open_names:
                pop_to(open_names.index("head"))
        elif name not in IN_HEAD:
            leave_head()
        elif name == "head" and any(n == "head" for n, _ in stack):
            continue
        if name in IN_PARAGRAPH_CLOSE:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    pop_to(depth)
                    break
                if stack[depth][0] in PARAGRAPH_SCOPE:
                    break
        if name in CLOSES:
            closed, scope = CLOSES[name]
            last = 0
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in scope:
                    break
                if stack[depth][0] in closed:
                    last = depth
            if last:
                pop_to(last)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if name in INLINE:
            if name in ("br", "wbr"):
                pieces.append(" " if name == "br" else "")
            elif name not in VOID:
                links += name == "a"
                stack.append((name, stack[-1][1]))
            continue
        flush()
        if name in VOID or name in ("html", "body"):
            continue
        names: tuple[str, ...] = ()
        if m[3] and not m[3].isspace():
            found = [w.lower() for _, v in ATTRIBUTE.findall(m[3]) for w in NAME.findall(v)]
            names = tuple(dict.fromkeys(found))
        unseen += name in UNSEEN
        stack.append((name, page.add(stack[-1][1], name, names)))
    flush()
    return page


# -- features ------------------------------------------------------------------------------------
def features(page: Page) -> list[list[str]]:
    """The names of each node's features."""
    n = len(page.parent)
    chars, linked = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        if page.text[i] is not None:
            chars[i], linked[i] = len(page.text[i]), page.linked[i]
        if i:
            chars[page.parent[i]] += chars[i]
            linked[page.parent[i]] += linked[i]
    out = []
    for i in range(n):
        share = linked[i] / chars[i] if chars[i] else 0.0
        links = "none" if share == 0 else "some" if share < 0.34 else "much" if share < 0.75 else "all"
        size = "0" if not chars[i] else "s" if chars[i] < 40 else "m" if chars[i] < 120 else "l"
        text = page.text[i]
        if text is not None:
            tag = page.tag[page.parent[i]]
            own = ["text", f"text links {links}", f"text size {size}", f"text in {tag}"]
            if text[-1] in ".!?…\"”»。":
                own.append("text stops")
            if "©" in text:
                own.append("text copyright")
        else:
            own = ["element", f"tag {page.tag[i]}", f"links {links}", f"size {size}"]
            own += [f"name {x}" for x in page.names[i]]
            if i:
                own.append(f"tag {page.tag[i]} under {page.tag[page.parent[i]]}")
                own += [f"in name {x}" for x in page.names[page.parent[i]]]
        out.append(own)
    return out


class Forest:
    """The nodes of many pages as arrays, with the nodes of each depth."""

    def __init__(self, pages: list[Page], places: dict[str, int], grow: bool = False):
        parent, kind, rows, columns = [], [], [], []
        self.begin = [0]
        for page in pages:
            base = self.begin[-1]
            parent += [p + base if p >= 0 else -1 for p in page.parent]
            kind += [kind_of(t) for t in page.tag]
            for i, own in enumerate(features(page)):
                for f in own:
                    c = places.setdefault(f, len(places)) if grow else places.get(f)
                    if c is not None:
                        rows.append(base + i)
                        columns.append(c)
            self.begin.append(base + len(page.parent))
        self.parent, self.kind = np.array(parent, np.int64), np.array(kind, np.int64)
        self.rows, self.columns = np.array(rows, np.int64), np.array(columns, np.int64)
        depth = np.zeros(len(parent), np.int64)
        for i, p in enumerate(parent):
            if p >= 0:
                depth[i] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []

    def marginals(self, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of each node's marginal, and the marginals of each node's edge to its parent (n, parent, child).

        edges: [kind, label of parent, label of child]."""
        n = len(self.parent)
        own = np.bincount(self.rows, weights[self.columns], n) if len(self.rows) else np.zeros(n)
        t = edges[self.kind]
        up, belief = np.zeros(n), own.copy()  # belief: of the subtree
        for level in reversed(self.levels[1:]):
            a, e = belief[level], t[level]
            up[level] = np.logaddexp(e[:, 1, 0], e[:, 1, 1] + a) - np.logaddexp(e[:, 0, 0], e[:, 0, 1] + a)
            np.add.at(belief, self.parent[level], up[level])
        total, joint = belief.copy(), np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            e, without = t[level], total[self.parent[level]] - up[level]
            down = np.logaddexp(e[:, 0, 1], e[:, 1, 1] + without) - np.logaddexp(e[:, 0, 0], e[:, 1, 0] + without)
            total[level] = belief[level] + down
            z = e.copy()
            z[:, 1, :] += without[:, None]
            z[:, :, 1] += belief[level][:, None]
            z = np.exp(z - z.max((1, 2), keepdims=True))
            joint[level] = z / z.sum((1, 2), keepdims=True)
        return total, joint


class TreeModel:
    def __init__(self, places: dict[str, int], weights: np.ndarray, edges: np.ndarray):
        self.places, self.weights, self.edges = places, weights, edges

    @classmethod
    def fit(cls, pages: list[Page], labels: list[list[int]]) -> TreeModel:
        """Gradient ascent (with Adam's step sizes) on the penalised log-likelihood."""
        places: dict[str, int] = {}
        forest = Forest(pages, places, grow=True)
        y = np.array([v for own in labels for v in own])
        w, e = np.zeros(len(places)), np.zeros((KINDS, 2, 2))
        inner = np.flatnonzero(forest.parent >= 0)
        seen = np.zeros((KINDS, 2, 2))
        np.add.at(seen, (forest.kind[inner], y[forest.parent[inner]], y[inner]), 1)
        seen_w = np.bincount(forest.columns, y[forest.rows], len(places))
        m, v = np.zeros(w.size + e.size), np.zeros(w.size + e.size)
        scale = max(1, len(pages))
        for step in range(1, STEPS + 1):
            total, joint = forest.marginals(w, e)
            p = 1 / (1 + np.exp(-np.clip(total, -50, 50)))
            gw = seen_w - np.bincount(forest.columns, p[forest.rows], len(places))
            ge = seen.copy()
            for kind in range(KINDS):
                ge[kind] -= joint[inner][forest.kind[inner] == kind].sum(0)
            g = np.concatenate((gw, ge.ravel())) / scale - PENALTY * np.concatenate((w, e.ravel()))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            w, e = w + move[: w.size], e + move[w.size :].reshape(e.shape)
        return cls(places, w, e)

    def extract(self, sources: list[str | None]) -> list[str]:
        pages = [parse(s) for s in sources]
        forest = Forest(pages, self.places)
        total, _ = forest.marginals(self.weights, self.edges)
        cut = np.log(CUT / (1 - CUT))
        out = []
        for page, begin in zip(pages, forest.begin):
            out.append("\n".join(t for i, t in enumerate(page.text) if t is not None and total[begin + i] >= cut))
        return out


# -- labelled pages ------------------------------------------------------------------------------
# Names that pages give to their parts.
CONTENT_NAMES = "content main-content post-content entry-content article-body story-body post-body article-content page-content text entry post story body-text".split()
AROUND = {
    "nav": "nav navbar menu main-menu navigation breadcrumb breadcrumbs topnav tabs pagination pager toc",
    "header": "header site-header masthead top banner logo branding page-header",
    "footer": "footer site-footer bottom copyright colophon legal credits",
    "aside": "sidebar side widget related more-stories popular trending recommended tags rail secondary",
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion banner-ad adsense commercial",
    "notice": "cookie cookies cookie-notice consent gdpr notice alert popup modal overlay subscribe newsletter paywall disclaimer warning",
    "form": "form search login signup contact search-form newsletter-form",
    "comments": "comments comment comment-list commentlist discussion responses replies reader-comments disqus",
    "share": "share social sharing share-buttons social-links follow",
}
TAGS = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "ad": ["div", "aside", "section", "p"], "notice": ["div", "section", "aside", "dialog"], "form": ["form", "div"], "comments": ["section", "div", "ol"], "share": ["div", "ul"]}


def labelled_pages(n: int = COMPOSED_PAGES, seed: int = 5) -> list[tuple[Page, list[int]]]:
    """Composed pages with the label of every node."""
    rng = random.Random(seed)
    out = []
    word = lambda: "".join(rng.choice("aeioulnrstdm") for _ in range(rng.randint(2, 9)))
    sentence = lambda k: " ".join(word() for _ in range(k)).capitalize() + "."

    def prose() -> str:
        return " ".join(sentence(rng.randint(4, 14)) for _ in range(rng.randint(1, 5)))

    def maybe_linked(chance: float, longest: int = 12) -> tuple[str, int]:
        """A text and how many of its characters are linked: none, or all of them with a chance."""
        text = sentence(rng.randint(1, longest))
        if rng.random() < 0.5:
            text = text[:-1]
        return text, len(text) if rng.random() < chance else 0

    for _ in range(n):
        page, labels = Page(), [0]

        def add(parent, tag, label, names=(), text=None, linked=0, page=page, labels=labels):
            labels.append(label)
            return page.add(parent, tag, tuple(names), text, linked)

        def around(parent, kind, add=add):
            tag = rng.choice(TAGS[kind])
            named = kind in ("ad", "notice", "share") or tag in ("div", "section", "ul", "ol", "p") or rng.random() < 0.4
            names = [x for x in rng.choice(AROUND[kind].split()).split("-")] if named else []
            node = add(parent, tag, 0, names)
            if kind in ("nav", "share"):
                inner = node if tag in ("ul", "ol") else add(node, "ul", 0) if rng.random() < 0.7 else node
                for _ in range(rng.randint(2, 8)):
                    text = " ".join(word() for _ in range(rng.randint(1, 3)))
                    add(add(inner, "li", 0), "#text", 0, (), text, len(text))
            elif kind == "comments":
                for _ in range(rng.randint(1, 5)):
                    inner = add(node, rng.choice(["div", "li", "div", "li", "article"]), 0, rng.choice([["comment"], ["comment", "body"], ["reply"]]))
                    for _ in range(rng.randint(1, 2)):
                        add(add(inner, "p", 0), "#text", 0, (), prose())
            elif kind == "form":
                for _ in range(rng.randint(1, 3)):
                    add(add(node, rng.choice(["p", "div", "fieldset", "button"]), 0), "#text", 0, (), " ".join(word() for _ in range(rng.randint(1, 4))))
            elif kind == "footer":
                text = rng.choice(["© " + word(), sentence(4), "© " + sentence(6)])
                add(add(node, "p", 0) if rng.random() < 0.5 else node, "#text", 0, (), text, rng.choice([0, 0, len(text) // 2]))
            elif kind == "header":
                add(add(node, rng.choice(["h1", "div", "p"]), 0), "#text", 0, (), " ".join(word() for _ in range(3)), rng.choice([0, 10]))
            else:
                for _ in range(rng.randint(1, 3)):
                    inner = add(node, rng.choice(["p", "div", "h3", "li"]), 0) if rng.random() < 0.6 else node
                    text = prose() if rng.random() < 0.6 else sentence(rng.randint(2, 6))
                    add(inner, "#text", 0, (), text, rng.choice([0, 0, len(text)]))

        top = 0
        for kind in rng.sample(["nav", "header", "ad", "notice", "form"], rng.randint(0, 4)):
            around(top, kind)
        shell = top
        for _ in range(rng.choice([0, 0, 1, 2])):
            shell = add(shell, "div", 0, rng.choice([[], ["wrapper"], ["container"], ["page"], ["row"], ["layout"]]))
        kind = rng.random()
        if kind < 0.38:
            main = add(add(shell, "main", 1) if rng.random() < 0.3 else shell, "article", 1, rng.choice([[], [], ["post"], ["article"], ["entry"]]))
        elif kind < 0.48:
            main = add(shell, "main", 1)
        elif kind < 0.7:
            main = add(shell, rng.choice(["div", "div", "section"]), 1, rng.choice(CONTENT_NAMES).split("-"))
        else:
            main = shell  # no element of its own
            labels[shell] = 1
        inner = main
        if main != shell and rng.random() < 0.25:
            inner = add(main, "div", 1, rng.choice(CONTENT_NAMES).split("-"))
        if rng.random() < 0.8:
            text = " ".join(word() for _ in range(rng.randint(2, 9)))
            head = add(inner, "header", 1) if main != shell and rng.random() < 0.15 else inner
            add(add(head, "h1", 1), "#text", 1, (), text + rng.choice(["", "."]))
        for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 9])):
            r = rng.random()
            if r < 0.05:
                add(inner, "#text", 1, (), prose())
            elif r < 0.78:
                text = prose() if rng.random() < 0.9 else sentence(rng.randint(1, 5))
                add(add(inner, "p", 1), "#text", 1, (), text, rng.choice([0, 0, 0, min(len(text), 8)]))
            elif r < 0.84:
                add(add(inner, rng.choice(["h2", "h3"]), 1), "#text", 1, (), " ".join(word() for _ in range(3)))
            elif r < 0.9:
                own, linked = add(inner, rng.choice(["ul", "ol"]), 1), rng.choice([0, 0.5, 1])
                for _ in range(rng.randint(2, 5)):
                    item = add(own, "li", 1)
                    holder = add(item, "p", 1) if rng.random() < 0.2 else item
                    add(holder, "#text", 1, (), *maybe_linked(linked))
            elif r < 0.94:
                add(add(add(inner, "blockquote", 1), "p", 1), "#text", 1, (), prose())
            elif r < 0.97:
                own = add(inner, "table", 1)
                for _ in range(rng.randint(1, 3)):
                    line = add(own, "tr", 1)
                    for _ in range(2):
                        add(add(line, "td", 1), "#text", 1, (), *maybe_linked(rng.choice([0, 0, 1]), 2))
            elif r < 0.98:
                own = add(inner, "dl", 1)
                for _ in range(rng.randint(1, 3)):
                    add(add(own, "dt", 1), "#text", 1, (), *maybe_linked(rng.choice([0, 1]), 2))
                    add(add(own, "dd", 1), "#text", 1, (), sentence(8))
            elif r < 0.99 and main != shell:
                own = add(inner, rng.choice(["section", "article", "div"]), 1)
                add(add(own, "h2", 1), "#text", 1, (), *maybe_linked(0.5, 4))
                add(add(own, "p", 1), "#text", 1, (), prose())
            else:
                add(add(add(inner, "figure", 1), "figcaption", 1), "#text", 1, (), *maybe_linked(0.3, 6))
            if main != shell and rng.random() < 0.06:
                around(inner, rng.choice(["ad", "aside", "share", "form", "notice"]))
        if main != shell and rng.random() < 0.15:
            around(inner, "comments")
        for kind in rng.sample(["aside", "comments", "footer", "share", "ad", "form", "nav", "notice"], rng.randint(0, 5)):
            around(rng.choice([top, shell]), kind)
        out.append((page, labels))
    return out


PARTS = set("nav footer aside form button header".split())


def distant_labels(page: Page) -> list[int] | None:
    """Labels of a page whose only <article> marks the main text; None if it has another number of them."""
    if page.tag.count("article") != 1:
        return None
    names = {x for kind in ("ad", "notice", "comments", "share") for w in AROUND[kind].split() for x in w.split("-") if len(x) > 2 or x == "ad"}
    labels = [0] * len(page.tag)
    for i in range(1, len(labels)):
        bad = page.tag[i] in PARTS or bool(names & set(page.names[i]))
        labels[i] = int((labels[page.parent[i]] == 1 or page.tag[i] == "article") and not bad)
    return labels


def fit(pages: DataFrame, html: str = "html") -> TreeModel:
    """Learn from composed pages and a bounded sample of the corpus' own, the first by a hash of the page."""
    source = pages.select(pages[html].cast("string").alias("html")).where("html is not null and length(html) < 200000 and html like '%<article%'")
    sample = source.orderBy(F.xxhash64("html")).limit(SAMPLE_PAGES).collect()
    found = labelled_pages()
    for row in sample:
        page = parse(row["html"])
        labels = distant_labels(page)
        if labels:
            found.append((page, labels))
    return TreeModel.fit([p for p, _ in found], [y for _, y in found])


def extract(pages: DataFrame, model: TreeModel, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """`keep`, text and n_chars of every whole page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    carry = Carry(pages, keep, html=html)
    held, at = carry.held, carry.at["html"]

    def make():
        known = shared.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t for part in pieces([h or "" for h in batch.column(at).to_pylist()]) for t in known.extract(part)]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in held), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*held, "text", "n_chars"])

        return work

    return carry.run(per_batch(make), "text string, n_chars bigint")
