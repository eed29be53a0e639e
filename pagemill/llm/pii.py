"""Personal data with a skip-chain conditional random field over the base patterns.

The base patterns find emails, IP addresses, card and phone numbers. The CRF's variables are the text's tokens with a
digit or an at sign, which are the only ones that can hold such data; their labels are the four kinds or none. Factors:
a token's own features (shape, digits, checksum, neighbours), linear-chain factors between tokens that stand next to each
other, and skip factors between a token and an earlier one, however far: one with the same letters and digits, or a
similar one (the same last digits, the same start of an address, or one other character). Loopy belief propagation
(sum-product, ROUNDS rounds, all tokens of a batch at once) spreads the labels; base matches are observed. Tokens that
reach CERTAIN for a kind are added as spans; base spans stay. So a number that was given in full once is also found
where it stands without its mark or in another writing.

Training is piecewise, on at most SAMPLE documents chosen by a hash of the id: the features' weights by logistic
regression, edges as smoothed log-odds of label pairs. Base matches alone would teach that what doesn't match is nothing,
so documents with matches get some of these again without their marks (labelled as what they are), and look-alikes of
other digits (labelled none), and features are learned from unobserved tokens only: a token's form then says little, and
what it is linked to decides.

Null and empty texts have no spans. Repeated rows and null ids give a row each (null ids are not learned from); empty
tables give no rows. Other columns are ignored. Overlapping matches of different kinds all stay, ties in start in the
kinds' order. A token has a bounded number of links, and every step is linear in the text, however long it or a word is.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import chosen, mapped, prepare, table

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
SAMPLE = 3000
FEATURES, ROUNDS, CERTAIN, STEPS = 1 << 12, 8, 0.9, 120
#: How often training gives a match again without its mark, and a look-alike of it.
AGAIN, LOOK_ALIKES = 0.6, 0.4
#: Kinds of edges: neighbours, the same letters and digits, similar ones.
CHAIN, SAME, SIMILAR = range(3)
#: Characters between tokens of one number or of neighbours.
GAP = 3

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_START = re.compile(r"[0-9@]\S*")
_EDGE = ".,;:!?\"'()[]{}<>|*#%$&="
_NO_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_OPEN = re.compile(r"(?<=[^\W\d]) (?=[^\W\d])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from the at signs, so that long words without one cost nothing."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and not _NO_LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """kind, start, end of the base matches, by start and kind."""
    if not text:
        return []
    out = [(EMAIL, a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((IP, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((CARD, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((PHONE, *m.span()))
    return sorted(out, key=lambda x: (x[1], x[0]))


def tokens(text: str) -> list[tuple[int, int]]:
    """Start and end of the tokens with a digit or an at sign, without punctuation around them."""
    out, done = [], 0
    for m in _START.finditer(text):
        a, b = m.span()
        while a > done and not text[a - 1].isspace():
            a -= 1
        done = b
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _shape(token: str) -> str:
    """Runs of letters as one a, each digit as d; runs of more than 20 digits as D."""
    return re.sub(r"d{21,}", "D", re.sub(r"a+", "a", re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "d", token))))


def _word(text: str, at: int, step: int) -> str:
    """The word before (step -1) or after (step 1) a place."""
    width = 32
    while True:
        part = text[max(0, at - width) : at] if step < 0 else text[at : at + width]
        words = part.split(None, 1) if step > 0 else part.rsplit(None, 1)
        whole = at - width <= 0 if step < 0 else at + width >= len(text)
        inner = part.rstrip() if step < 0 else part.lstrip()
        if whole or len(inner.split(None, 1)) > 1:
            return words[0 if step > 0 else -1].lower().strip() if words else ""
        width *= 2


def _features(text: str, a: int, b: int) -> list[int]:
    token = text[a:b]
    digits = "".join(re.findall("[0-9]+", token))
    names = [
        f"shape {_shape(token)}", f"digits {len(digits)}", f"length {(b - a).bit_length()}", f"dots {token.count('.')}", f"at {token.count('@')}",
        f"plus {a > 0 and text[a - 1] == '+' or token[0] == '+'}", f"all {len(digits) == b - a}", f"sum {len(digits) in range(14, 20) and len(digits) == b - a and luhn(digits)}",
        f"before {_word(text, a, -1)}", f"after {_word(text, b, 1)}", "bias",
    ]
    return [zlib.crc32(x.encode()) % FEATURES for x in names]


def _keys(token: str) -> tuple[str, list[str]]:
    """What makes tokens the same, and what makes them similar."""
    same = "".join(c for c in token.lower() if c.isalnum())
    digits = "".join(c for c in same if c.isdigit())
    like = []
    if len(digits) >= 7 and len(digits) * 2 >= len(same):
        like.append(f"end {digits[-7:]}")
    if "@" in token:
        name, _, host = token.lower().partition("@")
        like.append(f"mail {name}@{host.split('.')[0]}")
    if len(same) >= 8:  # with one other character, one half is still the same
        half = len(same) // 2
        like += [f"first {len(same)} {same[:half]}", f"second {len(same)} {same[half:]}"]
    return same, like


def _alike(kind: str, a: str, b: str) -> bool:
    return kind in ("end", "mail") or sum(x != y for x, y in zip(a, b)) <= 1


#: Characters that a piece of a match (an area code, a group of a card's digits) needs to say something by itself.
TELLING = 7


def _links(keys: list[tuple[str, list[str]]], observed: list[int], pieces: list[bool]) -> list[tuple[int, int, int]]:
    """Edges from each token to the nearest same token on the left and the nearest observed ones on either side, likewise similar ones.

    A short piece of a match of several tokens is linked to a same token only where a neighbour is the same, too: 974 of a
    number isn't room 974.
    """
    found: set[tuple[int, int, int]] = set()
    for back in (False, True):
        last: dict[str, int] = {}
        seen: dict[str, int] = {}
        for i in range(len(keys) - 1, -1, -1) if back else range(len(keys)):
            same, like = keys[i]
            if len(same) >= 3:
                for table_, wanted in ((last, not back), (seen, True)):
                    j = table_.get(same)
                    if j is not None and wanted:
                        found.add((min(i, j), max(i, j), SAME))
                last[same] = i
                if observed[i]:
                    seen[same] = i
            for key in like:
                for table_, wanted in ((last, not back), (seen, True)):
                    j = table_.get(key)
                    if j is not None and wanted and keys[j][0] != same and _alike(key.split()[0], same, keys[j][0]):
                        found.add((min(i, j), max(i, j), SIMILAR))
                last[key] = i
                if observed[i]:
                    seen[key] = i
    name = lambda i: keys[i][0] if 0 <= i < len(keys) else ""
    together = lambda i, j: any(name(i + d) and name(i + d) == name(j + d) for d in (-1, 1))
    alone = lambda i, j: (pieces[i] or pieces[j]) and len(keys[i][0]) < TELLING and not together(i, j)
    return sorted((i, j, kind) for i, j, kind in found if kind != SAME or not alone(i, j))


def _pieces(found: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[bool]:
    """Which tokens lie in a span with other tokens."""
    starts = [a for a, _ in found]
    out = [False] * len(found)
    for _, a, b in spans:
        first = bisect_left(starts, a)
        while first and found[first - 1][1] > a:
            first -= 1
        last = bisect_left(starts, b)
        if last - first > 1:
            out[first:last] = [True] * (last - first)
    return out


class Graph:
    """Tokens of some texts with observed labels, features and edges."""

    def __init__(self, texts: list[str | None], bases: list[list[tuple[int, int, int]]], golds: list[list[int]] | None = None):
        """Without golds, texts with all tokens observed are left out: nothing is to infer in them."""
        self.text_of, self.spans, features, observed, edges = [], [], [], [], []
        for k, (text, base) in enumerate(zip(texts, bases)):
            found = tokens(text) if text else []
            covered = _labels(found, base)
            if not found or golds is None and all(covered):
                continue
            first = len(self.spans)
            self.text_of += [k] * len(found)
            self.spans += found
            observed += covered
            features += [_features(text, a, b) for a, b in found]
            edges += [(first + i, first + i + 1, CHAIN) for i in range(len(found) - 1) if found[i + 1][0] - found[i][1] <= GAP]
            edges += [(first + i, first + j, kind) for i, j, kind in _links([_keys(text[a:b]) for a, b in found], covered, _pieces(found, base))]
        self.edges = np.array(edges, np.int64).reshape(-1, 3)
        self.observed = np.array(observed, np.int64)
        self.x = np.array(features, np.int64).reshape(len(self.spans), -1) if self.spans else np.empty((0, 1), np.int64)


def _labels(found, spans) -> list[int]:
    """For each token 1 + the kind of the first of the spans (in order of their starts) that overlaps it, else 0."""
    out, j, open_ = [], 0, []
    for a, b in found:
        while j < len(spans) and spans[j][1] < b:
            open_.append(spans[j])
            j += 1
        open_ = [s for s in open_ if s[2] > a]
        out.append(1 + open_[0][0] if open_ else 0)
    return out


class Model:
    """Weights of the features (rows: labels) and log factors of the edges (kind, label, label)."""

    def __init__(self, weights: np.ndarray, factors: np.ndarray):
        self.weights, self.factors = weights, factors

    def marginals(self, g: Graph) -> np.ndarray:
        """Beliefs of all tokens after ROUNDS rounds of sum-product messages along all edges, both ways."""
        unary = self.weights[:, g.x].sum(axis=2).T
        known = g.observed > 0
        unary[known] = -30.0
        unary[known, g.observed[known]] = 0.0
        n, labels = unary.shape
        if not len(g.edges):
            return _softmax(unary)
        a = np.concatenate([g.edges[:, 0], g.edges[:, 1]])
        b = np.concatenate([g.edges[:, 1], g.edges[:, 0]])
        f = np.concatenate([self.factors[g.edges[:, 2]], self.factors[g.edges[:, 2]].transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(g.edges)) + len(g.edges), np.arange(len(g.edges))])
        messages = np.zeros((len(a), labels))
        for _ in range(ROUNDS):
            belief = unary.copy()
            np.add.at(belief, b, messages)
            out = (belief[a] - messages[back])[:, :, None] + f
            top = out.max(axis=1, keepdims=True)
            out = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
            messages = 0.5 * messages + 0.5 * (out - out.max(axis=1, keepdims=True))
        belief = unary.copy()
        np.add.at(belief, b, messages)
        return _softmax(belief)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def unmarked(kind: int, value: str, rng: random.Random) -> tuple[str, str]:
    """A mention without what the base pattern goes by, and what stands right before it."""
    digits = re.findall("[0-9]+", value)
    if kind == EMAIL:
        name, _, host = value.partition("@")
        return "", f"{name}@{host.split('.')[0]}"
    if kind == IP:
        return "", rng.choice("-,_/").join(digits)
    if kind == CARD:
        number = "".join(digits)
        other = "".join(rng.choice("0123456789") for _ in range(rng.randint(4, 16)))
        return rng.choice([("", rng.choice("./_").join(number[i : i + 4] for i in range(0, len(number), 4))), ("", number + rng.choice("ABX")), (f"{other} ", number)])
    rest = value.lstrip("+").split(None, 1)
    rest = rest[-1] if len(rest) > 1 else "".join(digits)[-10:]
    return "", rng.choice([rest, rest.replace("(", "").replace(") ", rng.choice(".-")).replace("-", "."), "".join(re.findall("[0-9]+", rest))])


def _taught(text: str, rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with some of its matches again without their marks, and look-alikes; and the spans of all but the latter."""
    base = base_spans(text)
    places = [m.start() for m in _OPEN.finditer(text)]
    if not base or not places:
        return text, base
    added = []
    for kind, a, b in rng.sample(base, min(len(base), 6)):
        if rng.random() < AGAIN:
            added.append((rng.choice(places), kind, unmarked(kind, text[a:b], rng)))
        if rng.random() < LOOK_ALIKES:
            other = "".join(rng.choice("0123456789") if c.isdigit() else rng.choice("abcdefghiklmnoprstuw") if c.isalpha() and kind == EMAIL else c for c in text[a:b])
            added.append((rng.choice(places), None, unmarked(kind, other, rng)))
    out, at, size, spans = [], 0, 0, []
    for place, kind, (before, said) in sorted(added, key=lambda x: (x[0], x[2])):
        out += [text[at:place], " ", before, said]
        size += place - at + 1 + len(before)
        if kind is not None:
            spans.append((kind, size, size + len(said)))
        size += len(said)
        at = place
    text = "".join([*out, text[at:]])
    return text, sorted([*base_spans(text), *spans], key=lambda x: (x[1], x[0]))


def train(texts: list[str], seed: int = 3) -> Model:
    """Piecewise training on the base matches of the texts."""
    labels, rng = 1 + len(KINDS), random.Random(seed)
    taught = [_taught(t, rng) for t in texts]
    pairs = np.full((3, labels, labels), 0.1)
    golds = [_labels(tokens(t), spans) for t, spans in taught]
    g = Graph([t for t, _ in taught], [base_spans(t) for t, _ in taught], golds)
    y = np.array([x for gold in golds for x in gold], np.int64)
    if not len(y):
        return Model(np.zeros((labels, FEATURES)), np.zeros((3, labels, labels)))
    for kind in range(3):
        own = g.edges[g.edges[:, 2] == kind]
        np.add.at(pairs[kind], (y[own[:, 0]], y[own[:, 1]]), 1.0)
        if kind != CHAIN:  # either may come first
            np.add.at(pairs[kind], (y[own[:, 1]], y[own[:, 0]]), 1.0)
            pairs[kind] += np.eye(labels)
    share = pairs / pairs.sum(axis=(1, 2), keepdims=True)
    factors = np.log(share) - np.log(share.sum(axis=2, keepdims=True)) - np.log(share.sum(axis=1, keepdims=True))
    weights, grads = np.zeros((labels, FEATURES)), np.full((labels, FEATURES), 1e-6)
    open_ = g.observed == 0  # the features speak only where nothing is observed
    x, target = g.x[open_], np.eye(labels)[y[open_]]
    for _ in range(STEPS if len(x) else 0):
        gap = _softmax(weights[:, x].sum(axis=2).T) - target
        step = np.stack([np.bincount(x.ravel(), np.repeat(gap[:, k], x.shape[1]), FEATURES) for k in range(labels)]) / len(x) + 1e-4 * weights
        grads += step * step
        weights -= 0.2 * step / np.sqrt(grads)
    return Model(weights, np.clip(factors, -4, 4))


#: Most digits of one number of a kind; its tokens are joined up to these.
_MOST = {CARD: 19, PHONE: 15}


def find(texts: list[str | None], model: Model) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int]]]]:
    """Base spans and all spans of each text."""
    bases = [base_spans(t) for t in texts]
    out = [list(b) for b in bases]
    graph = Graph(texts, bases)
    if graph.spans:
        belief = model.marginals(graph)
        label = belief.argmax(axis=1)
        sure = (graph.observed == 0) & (label > 0) & (belief.max(axis=1) >= CERTAIN)
        last = None  # text, kind, token, start and digits of the open span
        for i in np.flatnonzero(sure).tolist():
            k, kind, (a, b) = graph.text_of[i], int(label[i]) - 1, graph.spans[i]
            n = sum(c.isdigit() for c in texts[k][a:b])
            if last and last[:3] == (k, kind, i - 1) and a - graph.spans[i - 1][1] <= GAP and last[4] + n <= _MOST.get(kind, 0):
                out[k].pop()
                a, n = last[3], last[4] + n
            elif kind == PHONE and a and texts[k][a - 1] == "(":
                a -= 1
            out[k].append((kind, a, b))
            last = (k, kind, i, a, n)
    return bases, [sorted(s, key=lambda x: (x[1], x[0])) for s in out]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from a bounded, hashed sample of the documents with a digit or an at sign."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    total = max(1, rows.count())
    return train([r["text"] for r in chosen(rows, "doc_id", F.lit(SAMPLE / total), "text").toLocalIterator()])


def detect(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row (counts of base matches)."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batch):
        bases, spans = find(batch.column(1).to_pylist(), shared.value)
        out = {f"n_{name}": [sum(s[0] == k for s in b) for b in bases] for k, name in enumerate(KINDS)}
        out |= {"base_sha256": [sha256(joined(b).encode()).hexdigest() for b in bases], "spans": [joined(s) for s in spans]}
        return {"doc_id": batch.column(0)} | out

    return mapped(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (overlapping ones as one) replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with the same columns and rows, personal data in text_col masked."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, width = docs.columns.index(text_col), len(docs.columns)

    def run(batch):
        texts = batch.column(at).to_pylist()
        spans = find(texts, shared.value)[1]
        new = [t if not s else mask(t, s) for t, s in zip(texts, spans)]
        return {f"c{i}": new if i == at else batch.column(i) for i in range(width)}

    kinds = [kind for _, kind in docs.dtypes]
    renamed = docs.toDF(*[f"c{i}" for i in range(len(kinds))])
    return mapped(renamed, run, ", ".join(f"c{i} {k}" for i, k in enumerate(kinds))).toDF(*docs.columns)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return detect(docs, fit(docs))
