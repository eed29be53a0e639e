"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read once into leaf blocks: the runs of text between block-level tags, each with its ancestors' tags, class
and id words, and link characters. The CRF's labels are main and other; its features are ancestor tags and names, the
innermost tag and its nearest names, the block's length, links and punctuation, and words of small print; a transition
weight joins neighbours. Viterbi decoding gives the labels, and the main blocks are joined by line feeds.

Training: labelled pages of many layouts made by labelled_pages() (article, headings, lists and tables in it; menus,
headers, footers, sidebars, notices, adverts, forms and comments around and inside it), by the labels' conditional
likelihood (forward and backward sums). No page of the table is needed; own labelled pages can be given instead.

Null, empty and text-free pages have an empty text. Repeated rows give a row each; empty tables give none; other columns
are ignored. Texts of scripts, styles, form controls, templates and comments are never blocks; formulas, drawings and the
texts of embedded objects are text like any other. Very long and deeply nested pages are read in one pass, in linear time. Cut-off markup at the end of a
page is dropped, a cut-off character reference stays as it is. A line break tag counts as white space in its block.
"""

from __future__ import annotations

import html as html_lib
import random
import re
import zlib
from collections import Counter
from functools import lru_cache
from math import exp, log1p

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import mapped, prepare, table

BITS = 14
PAGES, SEED, EPOCHS = 400, 11, 8
#: Training: step size, penalty on the weights.
RATE, PENALTY = 0.3, 1e-3

#: Element names of HTML by their role here.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li legend main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead title tr ul button textarea iframe noscript template".split()
)
SILENT = frozenset("script style template iframe head title textarea select button datalist".split())
RAW = frozenset(["script", "style", "textarea", "title", "iframe"])
SECTIONS = frozenset("article main nav header footer aside form".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


class Node:
    """An open element, as far as its blocks' features need it: what it adds to its ancestors' features, and what holds of all."""

    __slots__ = ("article", "added", "last", "names", "parent", "plain", "z")

    def __init__(self, parent: Node | None, tag: str, words: tuple[str, ...], added: tuple[int, ...]):
        self.parent, self.last, self.added, self.z = parent, tag, added, None
        self.names = words or (parent.names if parent else ())  # of the nearest element that has some
        self.article = tag in ("article", "main") or bool(parent and parent.article)
        self.plain = not words and tag not in SECTIONS and (parent is None or parent.plain)


class Block:
    __slots__ = ("links", "node", "parts")

    def __init__(self, node):
        self.node, self.parts, self.links = node, [], 0

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


@lru_cache(maxsize=50_000)
def _feature(name: str) -> int:
    return zlib.crc32(name.encode()) & ((1 << BITS) - 1)


def blocks(page: str | None) -> list[tuple[str, Node, int]]:
    """Text, innermost element and number of link characters of each leaf block, in page order. Linear in the page."""
    out: list[Block] = []
    root = node = Node(None, "", (), ())
    stack: list[tuple[str, tuple[str, ...], Node]] = []  # tag, name words and the element around it
    open_tags, open_names = Counter(), Counter()
    silent = links = at = 0
    current = Block(root)
    page = page or ""

    def close():
        nonlocal current
        if current.parts:
            out.append(current)
        current = Block(node)

    def said(raw):
        if raw and not silent:
            raw = html_lib.unescape(raw) if "&" in raw else raw
            current.parts.append(raw)
            if links:
                current.links += len(raw.strip())

    def leave(tag):
        """Close the innermost element of this tag, and all within it."""
        nonlocal silent, links, node
        while stack:
            own, words, node = stack.pop()
            open_tags[own] -= 1
            for w in words:
                open_names[w] -= 1
            silent -= own in SILENT
            links -= own == "a"
            if own == tag:
                return

    while True:
        start = page.find("<", at)
        said(page[at:start] if start >= 0 else page[at:])
        if start < 0:
            break
        m = _MARKUP.match(page, start)
        if not m:  # a sign that is no markup
            said("<")
            at = start + 1
            continue
        at = m.end()
        if not m.group(2):
            continue
        tag, ends = m.group(2).lower(), bool(m.group(1))
        if not m.group(4):  # cut off within a tag
            break
        if tag == "br":
            said(" ")
            continue
        if ends:
            if open_tags[tag]:
                leave(tag)
            if tag in BLOCKS:
                close()
            continue
        if stack and stack[-1][0] == tag and tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):  # elements that these end
            leave(tag)
        if tag in BLOCKS and open_tags["p"]:
            leave("p")
        if tag not in VOID and not m.group(3).endswith("/"):
            words = tuple(w for x in _NAMES.findall(m.group(3)) for w in _SPLIT.split("".join(x).lower()) if w)
            added = () if open_tags[tag] or tag in ("html", "body") else (_feature(f"tag {tag}"),)  # pages may leave these out
            added += tuple(_feature(f"name {w}") for w in dict.fromkeys(words) if not open_names[w])
            stack.append((tag, words, node))
            open_tags[tag] += 1
            open_names.update(words)
            node = Node(node, tag if tag not in ("html", "body") else "", words, added)
            silent += tag in SILENT
            links += tag == "a"
        if tag in BLOCKS:
            close()
        if tag in RAW and not m.group(3).endswith("/"):
            end = re.compile(f"</{tag}\\b", re.I).search(page, at)
            if end is None:
                break
            at = end.start()
    close()
    return [(t, b.node, b.links) for b in out if (t := b.text)]


_SMALL = re.compile(r"©|\bcookies?\b|all rights reserved|privacy|subscribe|newsletter|sign up|log ?in\b|advert|sponsored|reply|comments?\b|share this|related|read more|terms of", re.I)


def own_features(item) -> tuple[int, ...]:
    """Hashed features of one block but for its ancestors' tags and names."""
    text, node, links = item
    n = len(text)
    words = text.count(" ") + 1
    own = (min(8, n.bit_length()), round(4 * links / n), min(7, words.bit_length()), text[-1] in ".!?…:;", n < 400 and bool(_SMALL.search(text)))
    return _hashed(node.last, node.names, node.article, node.plain, own)


@lru_cache(maxsize=20_000)
def _hashed(last, names, article, plain, own) -> tuple[int, ...]:
    length, linked, words, ended, small = own
    found = ["bias", f"len {length}", f"links {linked}", f"words {words}", f"ended {ended}", f"small {small}"]
    found += [f"last {last}", f"article {article}", f"pair {last} {linked}", *(f"inner {last} {w}" for w in sorted(set(names)))]
    found += ["plain", f"plain {length} {ended}"] if plain else []
    return tuple(_feature(x) for x in found)


def features(item) -> tuple[int, ...]:
    """All hashed features of one block."""
    out, node = list(own_features(item)), item[1]
    while node is not None:
        out += node.added
        node = node.parent
    return tuple(out)


class Model:
    """Weights of the features for the label main, and of label pairs (row: before; 0 other, 1 main)."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs
        self._list: list[float] | None = None

    def scores(self, items) -> list[float]:
        """Each block's score for main. An element's share is that of the element around it and of what it adds; it is kept
        with the element, so blocks are scored by one model alone."""
        if self._list is None:
            self._list = self.weights.tolist()
        w, out = self._list, []
        for item in items:
            node, above = item[1], []
            while node is not None and node.z is None:
                above.append(node)
                node = node.parent
            z = node.z if node is not None else 0.0
            for node in reversed(above):
                z = node.z = z + sum(w[f] for f in node.added)
            out.append(z + sum(w[f] for f in own_features(item)))
        return out

    def decode(self, items) -> list[int]:
        """Labels of highest joint score (Viterbi); of equal ones other is taken."""
        (oo, om), (mo, mm) = self.pairs.tolist()
        scores, back = (0.0, 0.0), []
        for i, z in enumerate(self.scores(items)):
            if i:
                a, b = scores[0] + oo >= scores[1] + mo, scores[0] + om >= scores[1] + mm
                back.append((0 if a else 1, 0 if b else 1))
                scores = (max(scores[0] + oo, scores[1] + mo), max(scores[0] + om, scores[1] + mm) + z)
            else:
                scores = (0.0, z)
        if not items:
            return []
        out = [int(scores[1] > scores[0])]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]

    def __getstate__(self):
        return {"weights": self.weights, "pairs": self.pairs, "_list": None}


def _added(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    return max(a, b) + log1p(exp(-abs(a - b)))


def marginals(z: list[float], pairs: list[list[float]]) -> tuple[list[float], list[list[float]], float]:
    """By forward and backward sums: each block's probability of main, expected numbers of label pairs, and the log of all labellings' sum."""
    n = len(z)
    ahead, behind = [(0.0, z[0])], [(0.0, 0.0)] * n
    for i in range(1, n):
        o, m = ahead[-1]
        ahead.append((_added(o + pairs[0][0], m + pairs[1][0]), _added(o + pairs[0][1], m + pairs[1][1]) + z[i]))
    for i in range(n - 2, -1, -1):
        o, m = behind[i + 1][0], behind[i + 1][1] + z[i + 1]
        behind[i] = (_added(pairs[0][0] + o, pairs[0][1] + m), _added(pairs[1][0] + o, pairs[1][1] + m))
    total = _added(*ahead[-1])
    main = [exp(ahead[i][1] + behind[i][1] - total) for i in range(n)]
    both = [[0.0, 0.0], [0.0, 0.0]]
    for i in range(1, n):
        for a in (0, 1):
            for b in (0, 1):
                both[a][b] += exp(ahead[i - 1][a] + pairs[a][b] + (z[i] if b else 0.0) + behind[i][b] - total)
    return main, both, total


def train(pages: list[tuple[list, list[int]]], epochs: int = EPOCHS) -> Model:
    """Conditional likelihood of the labels of (blocks, labels), by steps page by page (sizes by AdaGrad) with a penalty."""
    w, pairs = np.zeros(1 << BITS), np.zeros((2, 2))
    seen_w, seen_pairs = np.full(1 << BITS, 1e-2), np.full((2, 2), 1e-2)
    order = random.Random(SEED)
    pages = [([np.array(features(x)) for x in items], gold) for items, gold in pages if items]
    for _ in range(epochs):
        order.shuffle(pages)
        for rows, gold in pages:
            main, both, _ = marginals([float(w[f].sum()) for f in rows], pairs.tolist())
            flat = np.concatenate(rows)
            gap = np.repeat([y - p for y, p in zip(gold, main)], [len(f) for f in rows])
            used, where = np.unique(flat, return_inverse=True)
            g = np.bincount(where, gap) - PENALTY * w[used]
            seen_w[used] += g * g
            w[used] += RATE * g / np.sqrt(seen_w[used])
            g = -np.array(both) - PENALTY * pairs
            np.add.at(g, (gold[:-1], gold[1:]), 1.0)
            seen_pairs += g * g
            pairs += RATE * g / np.sqrt(seen_pairs)
    return Model(w, pairs)


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[tuple[str, str]]:
    """Pages of many layouts with their main texts."""
    rng = random.Random(seed)
    stock = "lorem orbit candle river plain stone velvet harbor mentre eau schung ción the of and la der que walking garden number seven market".split()

    def words(a, b):
        return " ".join(rng.choice(stock) for _ in range(rng.randint(a, b)))

    def sentence():
        return " ".join(words(4, 16).capitalize() + rng.choice("...!?") for _ in range(rng.randint(1, 4)))

    def menu(tag, name):
        items = "".join(f'<li><a href="/{k}">{words(1, 2)}</a></li>' for k in range(rng.randint(2, 8)))
        return f'<{tag}{name}><ul>{items}</ul></{tag}>'

    def named(*names):
        return rng.choice(["", *[f' class="{x}"' for x in names], *[f' id="{x}"' for x in names]])

    def other():
        small = rng.choice([sentence(), words(1, 6), f"{words(1, 3)} &middot; &copy; {words(1, 3)}.example.com", f"&copy; {words(1, 4)}. {sentence()}"])
        return rng.choice(
            [
                lambda: menu("nav", named("menu", "navbar", "main-nav")), lambda: menu("div", ' class="menu"'),
                lambda: f"<header{named('site-header', 'banner')}><a href='/'>{words(1, 3)}</a><p>{words(2, 6)}</p></header>",
                lambda: f"<footer{named('site-footer', 'footer')}>{small}</footer>", lambda: f"<footer><p>{small}</p><p>{sentence()}</p></footer>",
                lambda: f"<aside{named('sidebar', 'related')}><h3>{words(1, 3)}</h3><p>{sentence()}</p></aside>",
                lambda: f'<div class="{rng.choice(["sidebar", "widget", "related", "recommended", "promo"])}"><p>{sentence()}</p></div>',
                lambda: f'<div class="{rng.choice(["ad", "ads", "advert", "advertisement", "sponsored", "banner-ad"])}">{sentence()}</div>',
                lambda: f'<div class="{rng.choice(["cookie", "cookie-notice", "notice", "consent", "gdpr", "popup", "alert"])}"><p>{sentence()}</p><button>OK</button></div>',
                lambda: f'<form action="/s"><label>{words(1, 3)}</label><input type="text"><p>{sentence()}</p></form>',
                lambda: f'<form class="newsletter"><p>{sentence()}</p></form>',
                lambda: comments(),
                lambda: f'<div class="{rng.choice(["share", "social", "breadcrumb", "breadcrumbs", "pagination", "tags", "copyright", "legal"])}"><a href="#">{words(1, 2)}</a> <a href="#">{words(1, 2)}</a></div>',
            ]
        )()

    def comments():
        tag, name = rng.choice(["section", "div"]), rng.choice(["comments", "comment-list", "responses", "reader-comments", "replies"])
        inner = "".join(rng.choice([f'<div class="comment"><b>{words(1, 2)}</b><p>{sentence()}</p></div>', f"<p>{sentence()}</p>", f'<article class="comment"><p>{sentence()}</p></article>']) for _ in range(rng.randint(1, 4)))
        return f'<{tag} {rng.choice(["class", "id"])}="{name}"><h3>{words(1, 2)}</h3>{inner}</{tag}>'

    out = []
    for _ in range(n):
        main: list[str] = []

        def add(tag, text):
            main.append(text)
            return f"<{tag}>{text}</{tag}>"

        body = [add("h1", words(2, 9))] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.7:
                body.append(add("p", sentence() if rng.random() < 0.85 else words(1, 4).capitalize()))
            elif kind < 0.8:
                body.append(add(rng.choice(["h2", "h3"]), words(1, 6)))
            elif kind < 0.88:
                body.append("<ul>" + "".join(add("li", words(2, 9)) for _ in range(rng.randint(1, 4))) + "</ul>")
            elif kind < 0.93:
                body.append("<table><tr>" + "".join(add("td", words(1, 3)) for _ in range(3)) + "</tr></table>")
            else:
                body.append(add("blockquote", sentence()))
            if rng.random() < 0.12:
                body.append(other())
        frame = rng.choice(["article", "article", "article", "main", 'div class="content"', 'div id="article-body"', 'div class="post entry"', "div"])
        if frame != "div" and rng.random() < 0.25:
            body.append(rng.choice([comments(), other()]))
        inner = f"<{frame}>{''.join(body)}</{frame.split()[0]}>"
        before = "".join(other() for _ in range(rng.randint(0, 3)))
        after = "".join(other() for _ in range(rng.randint(0, 3)))
        out.append((f"<!DOCTYPE html><html><head><title>{words(2, 5)}</title><style>p{{}}</style></head><body>{before}{inner}{after}</body></html>", "\n".join(main)))
    return out


def fit(pages: list[tuple[str, str]] | None = None) -> Model:
    """A model from labelled pages: a block is main if it is a line of the page's text, each line used once."""
    rows = []
    for page, text in pages or labelled_pages():
        items, left, gold = blocks(page), text.split("\n"), []
        for block in items:
            main = bool(left) and block[0] == left[0]
            gold.append(int(main))
            if main:
                left.pop(0)
        rows.append((items, gold))
    return train(rows)


def main_text(page: str | None, model: Model) -> str:
    items = blocks(page)
    return "\n".join(b[0] for b, label in zip(items, model.decode(items)) if label)


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row."""
    prepare(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batch):
        texts = [main_text(p, shared.value) for p in batch.column(2).to_pylist()]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    kinds = dict(rows.dtypes)
    return mapped(rows, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), fit())
