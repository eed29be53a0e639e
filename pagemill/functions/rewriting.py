"""Rewrites that carry state from left to right: plain Python on one text, with Arrow-batched forms for Spark."""

from __future__ import annotations

import json
import random
import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import functions as F

from pagemill.functions.text import SIGNATURE_HINTS

#: The tag before a tool call; elements that hold signatures, bound text, and inputs that take none.
CALL = "<tool_call>"
SIGNED_TAGS = ("span", "div", "td", "p")
BOUND_TAGS = ("span", "a", "td", "th", "li", "sup", "sub", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "strong", "b", "em", "i", "label", "textarea")
UNNAMED_INPUTS = ("checkbox", "radio", "hidden", "submit", "button", "file")


def repair_json(text: str) -> str:
    """ARR-06: a closing bracket met inside a string ends the string first; escapes are kept whole."""
    out, quoted = [], False
    for piece in re.findall(r'\\.|[^\\]|\\', text, re.S):
        if len(piece) == 2 and not quoted:
            out.append(piece)
            continue
        if piece in "}]" and quoted:
            out.append('"')
            quoted = False
        elif piece == '"':
            quoted = not quoted
        out.append(piece)
    return "".join(out)


def tool_call(text: str | None) -> tuple[str, str] | None:
    """ARR-07: name and JSON arguments of the first tool call in a message that can be read, repaired if need be."""
    text, at = text or "", 0
    decoder = json.JSONDecoder()
    while (tag := text.find(CALL, at)) >= 0:
        at = tag + len(CALL)
        rest = text[at:].lstrip()
        for candidate in (rest, repair_json(rest.partition(CALL.replace("<", "</"))[0])):
            try:  # the decoder stops where the object ends, whatever follows
                call, _ = decoder.raw_decode(candidate)
            except ValueError:
                continue
            if isinstance(call, dict) and isinstance(call.get("name"), str) and "arguments" in call:
                return call["name"], json.dumps(call["arguments"])
    return None


def flatten(value):
    """ARR-05: containers as comma-joined text, without null and empty members; scalars stay."""
    members = value.values() if isinstance(value, dict) else value if isinstance(value, (list, tuple)) else None
    return value if members is None else ", ".join(str(flatten(v)) for v in members if v is not None and v != "")


def strictify(schema):
    """ARR-04: every object node refuses further properties unless it says otherwise."""
    if isinstance(schema, list):
        return [strictify(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    out = {k: strictify(v) for k, v in schema.items()}
    if out.get("type") == "object":
        out.setdefault("additionalProperties", False)
    return out


def signature_svg(name: str, seed: str = "") -> str:
    """STR-15: a hand-drawn line whose course depends on the name and seed alone."""
    rng = random.Random(f"{seed}|{name}")
    x, y = 6.0, 30.0
    path = [f"M{x:.1f} {y:.1f}"]
    for _ in range(max(4, min(14, len(name)))):
        a, b, c, d = (rng.uniform(*r) for r in ((2, 10), (-22, 10), (4, 16), (-10, 22)))
        x, last = x + rng.uniform(8, 16), (x, y)
        y = 30 + rng.uniform(-9, 9)
        path.append(f"C{last[0] + a:.1f} {last[1] + b:.1f} {last[0] + c:.1f} {last[1] + d:.1f} {x:.1f} {y:.1f}")
    return f'<svg viewBox="0 0 {x + 6:.0f} 60" width="180" height="48"><path d="{" ".join(path)}" fill="none" stroke="#1a237e" stroke-width="2"/></svg>'


class Tag:
    """A tag of a page: its place, name (lower case), attributes as they stand, and whether it closes."""

    __slots__ = ("attributes", "closes", "end", "name", "start")

    def __init__(self, m: re.Match):
        self.start, self.end = m.span()
        self.closes, self.name, self.attributes = bool(m.group(1)), m.group(2).lower(), m.group(3)

    def get(self, name: str) -> str | None:
        m = re.search(rf"""(?<![\w-]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", self.attributes)
        return next((x for x in m.groups() if x is not None), None) if m else None


_TAG = re.compile(r"""<(/?)([A-Za-z][\w-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")


def tags(html: str) -> list[Tag]:
    return [Tag(m) for m in _TAG.finditer(html)]


def leaves(html: str, found: list[Tag]):
    """Pairs of an opening tag and its closing tag that have only text between them."""
    for open_, close in zip(found, found[1:]):
        if not open_.closes and close.closes and open_.name == close.name and not open_.attributes.endswith("/"):
            yield open_, close


def spliced(html: str, edits: list[tuple[int, int, str]]) -> str:
    """html with the places start to end replaced, in order of place."""
    out, at = [], 0
    for start, end, new in sorted(edits):
        out += [html[at:start], new]
        at = end
    return "".join([*out, html[at:]])


def inject_signatures(html: str, names: list[str], seed: str = "") -> tuple[str, list[str]]:
    """STR-14: the content of the first element of each signature field becomes a drawing, the element stays; the names used.

    Names that don't speak of a signature and lists are passed over; so is a field whose element holds one of its own kind.
    """
    used, edits, found = [], [], tags(html)
    for name in names:
        if "[]" in name or not any(hint in name.lower() for hint in SIGNATURE_HINTS):
            continue
        for i, tag in enumerate(found):
            if tag.closes or tag.name not in SIGNED_TAGS or tag.get("data-field") != name:
                continue
            end = next((t for t in found[i + 1 :] if t.name == tag.name), None)
            if end is not None and end.closes and not any(a < end.start and tag.end < b for a, b, _ in edits):
                edits.append((tag.end, end.start, signature_svg(name, seed)))
                used.append(name)
                break
    return spliced(html, edits), used


def repair_bindings(html: str) -> tuple[str, dict[str, int]]:
    """STR-16: text-only elements and inputs with a data-field but no expression are bound to it; running it again changes nothing."""
    counts: dict[str, int] = {}
    edits, found = [], tags(html)
    expression = lambda tag: "{{ " + re.sub(r"\{\{\s*(.*?)\s*\}\}", r"\1", tag.get("data-field")) + " }}"
    for open_, close in leaves(html, found):
        if open_.name in BOUND_TAGS and open_.get("data-field") is not None and "{{" not in html[open_.end : close.start]:
            edits.append((open_.end, close.start, expression(open_)))
            counts[open_.name] = counts.get(open_.name, 0) + 1
    for tag in found:
        if tag.name == "input" and not tag.closes and tag.get("data-field") is not None and tag.get("value") is None:
            at = tag.end - 1 - tag.attributes.endswith("/")
            at -= len(html[:at]) - len(html[:at].rstrip())
            edits.append((at, at, f' value="{expression(tag)}"'))
            counts["input"] = counts.get("input", 0) + 1
    return spliced(html, edits), counts


def _rules(style: str):
    """Selectors and declared properties of each rule of a style sheet."""
    for rule in style.split("}"):
        selectors, found, body = rule.partition("{")
        if found:
            yield [x.strip() for x in selectors.split(",")], [x.partition(":")[0].strip().lower() for x in body.split(";")]


def _single_class(selector: str) -> str | None:
    """The class of a selector that is a class alone or a class of one kind of element."""
    element, dot, name = selector.partition(".")
    plain = lambda x, more: all(c.isalnum() or c in more for c in x)
    return name if dot and name and plain(name, "-_") and plain(element, "") and element == element.lower() else None


def underlined_classes(html: str, found: list[Tag] | None = None) -> set[str]:
    """STR-25: classes whose rule in a style element draws a bottom border; selectors of more than a class don't count."""
    found = tags(html) if found is None else found
    out: set[str] = set()
    for k, open_ in enumerate(found):
        if open_.name == "style" and not open_.closes:
            end = next((t.start for t in found[k + 1 :] if t.name == "style" and t.closes), open_.end)
            for selectors, properties in _rules(html[open_.end : end]):
                if any(x.startswith("border-bottom") for x in properties):
                    out |= {c for x in selectors if (c := _single_class(x))}
    return out


def _without(text: str, opening: str, closing: str) -> str:
    """text without what stands between two marks, the marks included."""
    out, at = [], 0
    while (start := text.find(opening, at)) >= 0 and (end := text.find(closing, start + len(opening))) >= 0:
        out.append(text[at:start])
        at = end + len(closing)
    return "".join(out) + text[at:]


def _label(text: str) -> str:
    """A short text as a name: its words, at most six, in lower case; empty where it has no letter or too many words."""
    for marks in (("{{", "}}"), ("{%", "%}"), ("(", ")")):
        text = _without(text, *marks)
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in text).split()
    return "_".join(words).lower()[:40].strip("_") if 0 < len(words) <= 6 and any(c.isalpha() for c in text) else ""


def _named_by(html: str, found: list[Tag], at: int) -> str:
    """The name from the nearest text between two tags that end before a place, at most 400 characters back and 60 long."""
    k = bisect_left(found, at, key=lambda t: t.start) - 1
    while k > 0 and found[k - 1].end > at - 400:
        text = html[found[k - 1].end : found[k].start]
        if len(text) <= 60 and (name := _label(text)):
            return name
        k -= 1
    return ""


def enrich_blanks(html: str) -> tuple[str, int]:
    """STR-17: empty underlined elements and inputs without a field or value get a field, bound to it, named by the nearest
    text before them; names are made unique by _2, _3, ..., without text they are field_1, field_2, ..."""
    found = tags(html)
    lined = underlined_classes(html, found)
    taken = {t.get("data-field") for t in found} - {None}
    places = []
    for open_, close in leaves(html, found):
        drawn = "input-line" in open_.attributes or "border-bottom" in open_.attributes or lined & set((open_.get("class") or "").split())
        if open_.name in ("div", "span") and drawn and open_.get("data-field") is None and not html[open_.end : close.start].strip():
            places.append((open_, close))
    for tag in found:
        if tag.name == "input" and not tag.closes and (tag.get("type") or "").lower() not in UNNAMED_INPUTS and tag.get("data-field") is None and tag.get("value") is None:
            places.append((tag, None))
    edits, unnamed = [], 0
    for tag, close in sorted(places, key=lambda x: x[0].start):
        base = _named_by(html, found, tag.start)
        if not base:
            unnamed += 1
            base = f"field_{unnamed}"
        name, k = base, 2
        while name in taken:
            name, k = f"{base}_{k}", k + 1
        taken.add(name)
        bound = "{{ " + name + " }}"
        at = tag.end - 1 - tag.attributes.endswith("/")
        at -= len(html[:at]) - len(html[:at].rstrip())
        edits.append((at, at, f' data-field="{name}"' + ("" if close else f' value="{bound}"')))
        if close:
            edits.append((tag.end, close.start, bound))
    return spliced(html, edits), len(places)


def homography(seed: str, width: int, height: int, quality: float = 0.7) -> list[float]:
    """MTH-09: a 3x3 matrix (rotation and moved corners, unit square to unit square), by the seed alone."""
    import numpy as np

    rng = random.Random(seed)
    worst = max(0.0, min(1.0, 1 - quality))
    angle, jitter = rng.uniform(-1, 1) * 0.14 * worst, 0.06 * worst
    corners = [(0, 0), (1, 0), (1, 1), (0, 1)]
    ratio = height / max(1, width)
    rows, right = [], []
    for x, y in corners:
        dx, dy = x - 0.5, (y - 0.5) * ratio
        u = 0.5 + dx * np.cos(angle) - dy * np.sin(angle) + rng.uniform(-jitter, jitter)
        v = 0.5 + (dx * np.sin(angle) + dy * np.cos(angle)) / ratio + rng.uniform(-jitter, jitter)
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return [*np.linalg.solve(np.array(rows, float), np.array(right, float)).tolist(), 1.0]


def _texts(function, column):
    """A pandas UDF of a text function; made on call, as it needs a running session."""
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else function(x)), "string")(column)


def _frames(function, columns: str, column):
    names = [c.split()[0] for c in columns.split(", ")]
    return F.pandas_udf(lambda s: pd.DataFrame([function(x or "") for x in s], columns=names), columns)(column)


def repair_json_column(column):
    return _texts(repair_json, column)


def flatten_json_column(column):
    return _texts(lambda x: str(flatten(json.loads(x))), column)


def tool_call_column(column):
    return _frames(lambda x: tool_call(x) or (None, None), "name string, arguments string", column)


def repair_bindings_column(column):
    return _frames(lambda x: (lambda h, c: (h, json.dumps(c)))(*repair_bindings(x)), "html string, counts string", column)


def enrich_blanks_column(column):
    return _frames(enrich_blanks, "html string, added int", column)
