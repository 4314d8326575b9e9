"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded along the tree.

A page is read into a tree of block elements; inline elements count towards their block.  Each node has features of its
tag, attribute words, depth, siblings, ancestors and subtree (text, link and tag density).  The trees give the log odds
that a node belongs to the article.  Decoding keeps a node only together with its ancestors: from the leaves up, every
subtree takes the better of "all of it out" and "this node in, each child its own best", so no kept node can lie in a
dropped one.  The kept blocks' texts are the result.

The fit sees two bounded sets: pages of the table, whose semantic elements (article, main, nav, footer, aside, classed
boxes) label their nodes, and pages written from a small grammar of other layouts and class names, so that the trees also
learn what an article looks like where a page says so only by its names, or by its densities.  Semantic tags are hidden in
part of the training pages for that reason.
"""

import html as html_entities
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES, GRAMMAR_PAGES = 1_000, 1_200

#: fixed values: kinds of elements and words of class names and ids
BLOCKS = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tfoot tr td th nav aside "
                   "header footer form fieldset figure figcaption blockquote pre address center details summary hr dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style noscript template iframe svg math head title textarea select button object canvas audio video".split())
RAW = frozenset("script style title textarea noscript iframe".split())
CLOSED_BY = {"p": BLOCKS - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody"}, "td": {"td", "th", "tr"},
             "th": {"td", "th", "tr"}}
LISTS = frozenset(["ul", "ol", "dl", "table"])
OUT_WORDS = frozenset("ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar "
                      "breadcrumb breadcrumbs sidebar side aside widget related recommended recommendations more share sharing social comment "
                      "comments reply replies respond discussion disqus footer foot bottom header masthead topbar cookie cookies consent gdpr "
                      "notice popup modal overlay newsletter subscribe signup login signin register search form pagination pager tags copyright "
                      "legal disclaimer toolbar skip outbrain taboola alert feedback rating toc links partners dfp adsense teaser".split())
IN_WORDS = frozenset("article content main post entry story body text prose maincontent articlebody postbody blog hentry document page copy".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_STOPS = re.compile(r"[.!?,;:]")


class Page:
    """Block nodes in page order with their texts; ``pieces`` are (node, block number, text)."""

    def __init__(self, source: str):
        self.tag, self.parent, self.words, self.links, self.tags, self.controls = ["#page"], [-1], [()], [0], [0], [0]
        self.pieces: list[tuple[int, int, str]] = []
        self._read(source or "")

    def _text(self, node, block, raw, linked):
        text = html_entities.unescape(raw)
        if text:
            self.pieces.append((node, block, text))
            if linked:
                self.links[node] += len(text.strip())

    def _read(self, source: str):
        stack: list[tuple[str, int]] = [("#page", 0)]  # open elements and the block node each belongs to
        at, block, linked, unread, n = 0, 0, 0, 0, len(source)
        while at < n:
            m = _TOKEN.search(source, at)
            if m is None:
                if not unread:
                    self._text(stack[-1][1], block, source[at:], linked)
                break
            if m.start() > at and not unread:
                self._text(stack[-1][1], block, source[at:m.start()], linked)
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "br":
                    self.pieces.append((stack[-1][1], block, " "))
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        for t, _ in stack[i:]:
                            linked -= t == "a"
                            unread -= t in UNREAD
                        del stack[i:]
                        break
                block += tag in BLOCKS
                continue
            if unread and tag in BLOCKS and tag != "html":  # </head> is optional: a block outside a template ends an open head
                names = [t for t, _ in stack]
                if "head" in names and (tag == "body" or "template" not in names[names.index("head"):]):
                    for u, _ in stack[names.index("head"):]:
                        linked -= u == "a"
                        unread -= u in UNREAD
                    del stack[names.index("head"):]
            if tag in BLOCKS:
                for i in range(len(stack) - 1, 0, -1):
                    t = stack[i][0]
                    if t in CLOSED_BY and tag in CLOSED_BY[t]:
                        for u, _ in stack[i:]:
                            linked -= u == "a"
                            unread -= u in UNREAD
                        del stack[i:]
                        if t in ("p", "li"):
                            break
                    elif t in BLOCKS and not (t in CLOSED_BY and t != "p"):
                        break
                block += 1
            parent = stack[-1][1]
            if tag == "br":
                if not unread:
                    self.pieces.append((parent, block, " "))
                continue
            if tag in ("input", "select", "textarea", "button", "label"):
                self.controls[parent] += 1
            if tag in VOID:
                continue
            node = parent
            if tag in BLOCKS and not unread:
                node = len(self.tag)
                self.tag.append(tag)
                self.parent.append(parent)
                names = [a or b or c for _, a, b, c in _ATTR.findall(m[3])] if m[3] else ()
                self.words.append(tuple(w.lower() for x in names for w in _NAME.findall(x)))
                self.links.append(0)
                self.tags.append(0)
                self.controls.append(0)
            elif not unread:
                self.tags[parent] += 1
            if m[3].endswith("/") and tag not in BLOCKS:
                continue
            stack.append((tag, node))
            linked += tag == "a"
            unread += tag in UNREAD
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                at = end.start() if end else n


def features(page: Page, hide: bool = False) -> np.ndarray:
    """One row for each node; ``hide`` leaves out what semantic tags say."""
    n = len(page.tag)
    own, stops, words = np.zeros(n), np.zeros(n), np.zeros(n)
    for node, _, text in page.pieces:
        own[node] += len(text.strip())
        stops[node] += len(_STOPS.findall(text))
        words[node] += text.count(" ")
    links, tags, controls = (np.array(x, float) for x in (page.links, page.tags, page.controls))
    parent = page.parent
    kind = ["div" if hide and t in ("article", "main", "nav", "aside", "header", "footer") else t for t in page.tag]
    paragraphs = np.array([t == "p" for t in kind], float)
    items = np.array([t == "li" for t in kind], float)
    heads = np.array([t in ("h1", "h2", "h3") for t in kind], float)
    nodes = np.ones(n)
    sums = np.column_stack([own, stops, words, links, tags, controls, paragraphs, items, heads, nodes])
    for i in range(n - 1, 0, -1):
        sums[parent[i]] += sums[i]
    out = np.array([len(OUT_WORDS.intersection(w)) for w in page.words], float)
    into = np.array([len(IN_WORDS.intersection(w)) for w in page.words], float)
    tag_out = np.array([t in ("nav", "aside", "footer", "form", "dialog") for t in kind], float)
    tag_in = np.array([t in ("article", "main") for t in kind], float)
    depth, above_out, above_in = np.zeros(n), np.zeros(n), np.zeros(n)
    index, siblings, alike = np.zeros(n), np.zeros(n), np.zeros(n)
    children: dict[int, list[int]] = {}
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        above_out[i] = above_out[p] + out[p] + tag_out[p]
        above_in[i] = above_in[p] + into[p] + tag_in[p]
        children.setdefault(p, []).append(i)
    before, after = np.zeros(n), np.zeros(n)
    for kids in children.values():
        count: dict[str, int] = {}
        for k in kids:
            count[kind[k]] = count.get(kind[k], 0) + 1
        size = sums[kids, 0]
        index[kids], siblings[kids] = np.arange(len(kids)), len(kids)
        alike[kids] = [count[kind[k]] for k in kids]
        before[kids[1:]], after[kids[:-1]] = size[:-1], size[1:]
    total = max(sums[0, 0], 1)
    text = np.maximum(sums[:, 0], 1)
    one = lambda *names: np.array([t in names for t in kind], float)
    return np.column_stack([
        one("p"), one("h1"), one("h2", "h3", "h4", "h5", "h6"), one("div", "section"), one("ul", "ol", "dl"), one("li", "dt", "dd"), one("table", "tr", "td", "th"),
        one("nav"), one("aside"), one("header"), one("footer"), one("form", "fieldset"), one("article", "main"), one("blockquote", "pre", "figure"),
        out, into, above_out, above_in, depth, index, siblings, alike, np.log1p(before), np.log1p(after),
        np.log1p(own), np.log1p(sums[:, 0]), sums[:, 0] / total, sums[:, 3] / text, sums[:, 4] / text, sums[:, 1] / text, sums[:, 2] / text, sums[:, 5],
        np.log1p(sums[:, 6]), np.log1p(sums[:, 7]), sums[:, 8], sums[:, 9] / text, own / text])


class Trees:
    """Boosted regression trees for the logistic loss on binned features; every tree is complete to ``depth``."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 5.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.trees, self.bias = rounds, depth, rate, bins, ridge, [], 0.0

    def _bin(self, x):
        return np.column_stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)]) if len(x) else np.zeros((0, len(self.cuts)), int)

    def fit(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(x.shape[1])]
        binned, width = self._bin(x), x.shape[1]
        self.bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        f = np.full(len(y), self.bias)
        flat = binned + np.arange(width) * self.bins
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            leaf, splits = np.zeros(len(y), int), []
            for level in range(self.depth):
                k = 1 << level
                code = (leaf[:, None] * (width * self.bins) + flat).ravel()
                shape = (k, width, self.bins)
                gs = np.bincount(code, np.repeat(g, width), k * width * self.bins).reshape(shape).cumsum(2)
                hs = np.bincount(code, np.repeat(h, width), k * width * self.bins).reshape(shape).cumsum(2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs ** 2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt ** 2 / (ht + self.ridge)
                best = gain.reshape(k, -1).argmax(axis=1)
                splits.append((best // self.bins, best % self.bins))
                leaf = 2 * leaf + (binned[np.arange(len(y)), splits[-1][0][leaf]] > splits[-1][1][leaf])
            size = 1 << self.depth
            value = self.rate * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + self.ridge)
            self.trees.append((splits, value))
            f += value[leaf]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        binned, rows, f = self._bin(x), np.arange(len(x)), np.full(len(x), self.bias)
        for splits, value in self.trees:
            leaf = np.zeros(len(x), int)
            for feature, cut in splits:
                leaf = 2 * leaf + (binned[rows, feature[leaf]] > cut[leaf])
            f += value[leaf]
        return f


def decode(parent: list[int], odds: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Kept nodes: the choice of most total log odds in which every kept node's parent is kept; the root always is."""
    n = len(parent)
    gain = odds * weight
    for i in range(n - 1, 0, -1):  # children come after their parents
        if gain[i] > 0:
            gain[parent[i]] += gain[i]
    kept = np.zeros(n, bool)
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[parent[i]] and gain[i] > 0
    return kept


def blocks(page: Page, kept: np.ndarray) -> str:
    """Texts of the kept nodes in page order, each block's white space as single spaces, blocks joined by an empty line."""
    out, last = [], None
    for node, block, text in page.pieces:
        if kept[node]:
            if block != last:
                out.append([])
                last = block
            out[-1].append(text)
    return "\n\n".join(t for t in (" ".join("".join(b).split()) for b in out) if t)


def _weights(page: Page) -> np.ndarray:
    own = np.zeros(len(page.tag))
    for node, _, text in page.pieces:
        own[node] += len(text.strip())
    return 0.2 + np.log1p(own)


def weak_labels(page: Page) -> np.ndarray | None:
    """1 for nodes of the article (and what holds it), 0 for others, from semantic elements and class words; else None."""
    roots = [i for i, t in enumerate(page.tag) if t == "article"] or [i for i, t in enumerate(page.tag) if t == "main"]
    if not roots:
        return None
    y, roots = np.zeros(len(page.tag)), set(roots)
    for i in range(1, len(page.tag)):
        p = page.parent[i]
        out = page.tag[i] in ("nav", "aside", "footer", "form", "header") or OUT_WORDS.intersection(page.words[i])
        y[i] = (i in roots or (y[p] and p != 0)) and not out
    for i in range(len(page.tag) - 1, 0, -1):  # elements around an article are part of the way to it
        if y[i]:
            y[page.parent[i]] = 1
    return y


class Grammar:
    """Writes pages of varied layout whose article is known: ``page()`` gives the source; ``data-y`` marks the article."""

    def __init__(self, seed: int = 1):
        self.rng = np.random.default_rng(seed)
        letters = self.rng.choice(list("abcdeilmnorstu"), (3000, 9))
        self.pool = ["".join(w[:k]) for w, k in zip(letters.tolist(), self.rng.integers(2, 9, 3000))]

    def _pick(self, *options):
        return options[int(self.rng.integers(len(options)))]

    def words(self, low, high):
        n = int(self.rng.integers(low, high))
        w = [self.pool[i] for i in self.rng.integers(len(self.pool), size=n)]
        for i in range(6, n, int(self.rng.integers(6, 14))):
            w[i] += self._pick(".", ",", ".")
        return " ".join(w).capitalize() + self._pick(".", ".", "")

    def links(self, low=3, high=12):
        return "".join(f'<li><a href="#">{self.words(1, 4)}</a></li>' for _ in range(int(self.rng.integers(low, high))))

    def box(self):
        """One piece of boilerplate."""
        a, name = self._pick("div", "div", "section"), self._pick
        return self._pick(
            lambda: f"<nav><ul>{self.links()}</ul></nav>",
            lambda: f'<{a} class="{name("menu", "navbar", "site-nav", "breadcrumbs", "top-menu", "pagination")}"><ul>{self.links()}</ul></{a}>',
            lambda: f'<{a} class="{name("ad", "ads", "advert", "sponsored-box", "ad-banner", "promo")}">{name("", "<p>")}{self.words(3, 30)}</{a}>',
            lambda: f'<aside class="{name("sidebar", "widget", "")}"><h3>{self.words(1, 4)}</h3><ul>{self.links()}</ul><p>{self.words(5, 30)}</p></aside>',
            lambda: f'<{a} class="{name("sidebar", "related-posts", "recommended", "widget-area", "teaser")}"><h3>{self.words(1, 4)}</h3>'
                    + "".join(f'<p><a href="#">{self.words(3, 9)}</a></p>' for _ in range(int(self.rng.integers(1, 5)))) + f"</{a}>",
            lambda: f'<{a} {name("id", "class")}="{name("comments", "comment-list", "discussion", "replies", "disqus_thread")}"><h3>{self.words(1, 3)}</h3>'
                    + "".join(f'<div class="{name("comment", "reply", "comment-body")}"><p>{self.words(4, 50)}</p></div>' for _ in range(int(self.rng.integers(1, 6)))) + f"</{a}>",
            lambda: f'<{a} class="{name("cookie-notice", "notice", "consent", "popup", "newsletter-signup", "alert")}"><p>{self.words(5, 40)}</p>{name("", "<button>OK</button>")}</{a}>',
            lambda: f'<form action="#"><p>{self.words(2, 12)}</p><label>{self.words(1, 3)}</label><input name="q"><button>Go</button></form>',
            lambda: f'<{a} class="{name("share", "social-links", "tags", "login-form", "search-box")}">{self.words(1, 6)} <a href="#">{self.words(1, 3)}</a></{a}>')()

    def paragraph(self):
        text = self.words(1, 90)
        return self._pick(f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}</p>", f"<p><b>{text}<br><p>{self.words(3, 50)}</p>", f"<h2>{self.words(1, 8)}</h2><p>{text}</p>",
                          f"<ul><li>{self.words(2, 25)}</li><li>{self.words(2, 25)}</li></ul>", f"<blockquote><p>{text}</p></blockquote>",
                          f'<p>{text} <a href="#">{self.words(1, 4)}</a> {self.words(2, 20)}</p>', f"<div>{text}</div>")

    def article(self):
        inner = [f"<h1>{self.words(2, 12)}</h1>"] * int(self.rng.random() < 0.85) + [self.paragraph() for _ in range(int(self.rng.integers(1, 12)))]
        if self.rng.random() < 0.3:
            inner.insert(int(self.rng.integers(len(inner))), f"<x-out>{self.box()}</x-out>")
        name = self._pick("content", "post", "entry-content", "article-body", "main-content", "story", "page-text", "")
        tag = self._pick("article", "article", "main", "div", "div", "section")
        return f'<x-in><{tag}{f""" class="{name}" """ if name and (tag != "article" or self.rng.random() < 0.3) else ""}>{"".join(inner)}</{tag}></x-in>'

    def page(self) -> str:
        parts = [self.box() for _ in range(int(self.rng.integers(0, 5)))] + [self.article()] + [self.box() for _ in range(int(self.rng.integers(0, 5)))]
        top = f'<{self._pick("header", "div class=header", "div class=masthead")}><p>{self.words(1, 5)}</p></{self._pick("header", "div")}>' * int(self.rng.random() < 0.5)
        end = self._pick(f"<footer>{self.words(2, 25)}</footer>", f'<div class="footer"><p>{self.words(2, 25)}</p></div>', f"<footer><p>{self.words(2, 25)}</p><ul>{self.links()}</ul></footer>")
        body = "".join(parts)
        for _ in range(int(self.rng.integers(0, 3))):
            body = f'<div class="{self._pick("wrapper", "container", "row", "layout", "page-wrap")}">{body}</div>'
        if self.rng.random() < 0.05:
            body = f"<form>{body}</form>"
        return f"<html><head><title>{self.words(2, 9)}</title></head><body>{top}{body}{end * int(self.rng.random() < 0.9)}</body></html>"


def _grammar_examples(count: int, seed: int = 1):
    """(page, labels): the markers <x-in> and <x-out> become labels and leave no node behind."""
    g = Grammar(seed)
    for _ in range(count):
        source = g.page()
        inside, marks = [], re.split(r"(</?x-(?:in|out)>)", source)
        depth, plain = 0, []
        for part in marks:
            if part.startswith(("<x-", "</x-")):
                depth += {"<x-in>": 1, "</x-in>": -1, "<x-out>": -9, "</x-out>": 9}[part]
            else:
                inside.append((sum(map(len, plain)), depth))
                plain.append(part)
        page = Page("".join(plain))
        starts = [m.start() for m in _TOKEN.finditer("".join(plain)) if m[2] and not m[1] and m[2].lower() in BLOCKS - VOID]
        if len(starts) != len(page.tag) - 1:
            continue
        at = np.searchsorted([p for p, _ in inside], starts, "right") - 1
        y = np.concatenate([[0.0], [float(inside[i][1] == 1) for i in at]])
        for i in range(len(y) - 1, 0, -1):
            if y[i]:
                y[page.parent[i]] = 1
        yield page, y


def fit(pages: DataFrame, train_pages: int = TRAIN_PAGES, grammar_pages: int = GRAMMAR_PAGES) -> Trees:
    """Trees from at most ``train_pages`` pages, those with the smallest hashes of their ids, and the written ones.

    Node features, not pages, reach the driver.
    """
    ids = pages.select("page_id").filter("page_id IS NOT NULL").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(train_pages)
    chosen = pages.select("page_id", "html").join(F.broadcast(ids), "page_id").dropDuplicates(["page_id"]).select(F.col("html").cast("string").alias("html"))

    def nodes(batches):
        for b in batches:
            rows = []
            for i, source in enumerate(b["html"]):
                page = Page(source)
                y = weak_labels(page)
                if y is not None:
                    rows += [(float(v), x.tolist()) for v, x in zip(y, features(page, hide=i % 5 == 4))]
            yield pd.DataFrame(rows, columns=["y", "x"])

    found = chosen.mapInPandas(nodes, "y double, x array<double>").toPandas()
    xs, ys = [np.array(found["x"].tolist(), float)] if len(found) else [], [found["y"].to_numpy(float)] if len(found) else []
    for i, (page, y) in enumerate(_grammar_examples(grammar_pages)):
        xs.append(features(page, hide=i % 4 == 3))
        ys.append(y)
    return Trees().fit(np.vstack(xs), np.concatenate(ys))


def extract_texts(sources: list, model: Trees, group: int = 200) -> list[str]:
    out = []
    for i in range(0, len(sources), group):
        pages = [Page(s) for s in sources[i:i + group]]
        odds = model.log_odds(np.vstack([features(p) for p in pages]))
        at = 0
        for p in pages:
            n = len(p.tag)
            out.append(blocks(p, decode(p.parent, odds[at:at + n], _weights(p))))
            at += n
    return out


def extract(pages: DataFrame, model: Trees) -> DataFrame:
    """``pages`` without html, with text and n_chars (code points); null, empty and text-less pages give an empty text."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def of(sources: pd.Series) -> pd.Series:
        return pd.Series(extract_texts(sources.tolist(), shared.value), dtype=object)

    others = [F.col(f"`{c}`") for c in pages.columns if c not in ("html", "text", "n_chars")]
    done = pages.select(*others, of(F.coalesce(F.col("html").cast("string"), F.lit(""))).alias("text"))
    return done.withColumn("n_chars", F.length("text").cast("long"))
