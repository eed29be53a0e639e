"""The number of pages of a PDF file, from its cross-references and its page tree (SRC-15)."""

from __future__ import annotations

import re
import zlib

TOKEN = re.compile(rb"\s*(?:%[^\r\n]*\s*)*(<<|>>|\[|\]|/[^\s<>\[\]()/%{}]*|\d+\s+\d+\s+R(?![A-Za-z])|[+-]?[0-9.]+|\(|<|[A-Za-z]+)")


class Broken(ValueError):
    pass


def _value(data: bytes, at: int):
    """The object at a place and the place after it: dicts, lists, names (as str), numbers, references (as a pair), bytes."""
    m = TOKEN.match(data, at)
    if not m:
        raise Broken("no object where one is due")
    token, at = m[1], m.end()
    if token == b"<<":
        found = {}
        while True:
            m = TOKEN.match(data, at)
            if not m:
                raise Broken("dictionary without end")
            if m[1] == b">>":
                return found, m.end()
            key, at = _value(data, at)
            found[key], at = _value(data, at)
    if token == b"[":
        items = []
        while True:
            m = TOKEN.match(data, at)
            if not m:
                raise Broken("array without end")
            if m[1] == b"]":
                return items, m.end()
            item, at = _value(data, at)
            items.append(item)
    if token == b"(":
        depth, start = 1, at
        while depth:
            c = data[at : at + 1]
            if not c:
                raise Broken("text without end")
            depth += (c == b"(") - (c == b")")
            at += 2 if c == b"\\" else 1
        return data[start : at - 1], at
    if token == b"<":
        end = data.find(b">", at)
        if end < 0:
            raise Broken("text without end")
        return data[at:end], end + 1
    if token[:1] == b"/":
        return token[1:].decode("latin-1"), at
    if token[-1:] == b"R" and token[:1].isdigit():
        return tuple(int(x) for x in token[:-1].split()), at
    try:
        return (float(token) if b"." in token else int(token)), at
    except ValueError:
        return token.decode("latin-1"), at


def _unfiltered(raw: bytes, about: dict) -> bytes:
    """A stream's bytes; only deflate, with or without rows predicted from the row above, is known."""
    kind = about.get("Filter")
    if kind in (None, []):
        return raw
    if kind not in ("FlateDecode", ["FlateDecode"]):
        raise Broken(f"filter {kind}")
    out = zlib.decompressobj().decompress(raw)
    parms = about.get("DecodeParms") or {}
    parms = parms[0] if isinstance(parms, list) else parms
    if parms.get("Predictor", 1) < 10:
        return out
    width = parms.get("Columns", 1)
    rows, before = [], bytes(width)
    for i in range(0, len(out) - width, width + 1):
        line = out[i + 1 : i + 1 + width]
        if out[i] == 2:
            line = bytes((a + b) & 255 for a, b in zip(line, before))
        elif out[i] == 1:
            own = bytearray(line)
            for k in range(1, width):
                own[k] = (own[k] + own[k - 1]) & 255
            line = bytes(own)
        elif out[i]:
            raise Broken("predictor")
        rows.append(line)
        before = line
    return b"".join(rows)


class Pdf:
    """Objects of a file by number, from its tables or streams of cross-references, the last section first."""

    def __init__(self, data: bytes):
        self.data, self.places, self.trailer = data, {}, {}
        end = data.rfind(b"startxref")
        m = re.match(rb"startxref\s+(\d+)", data[end:]) if end >= 0 else None
        if not m:
            raise Broken("no cross-references")
        at, seen = int(m[1]), set()
        while at is not None and at not in seen:
            seen.add(at)
            section = self._section(at)
            self.trailer = section | self.trailer
            if isinstance(section.get("XRefStm"), int) and section["XRefStm"] not in seen:
                seen.add(section["XRefStm"])
                self._section(section["XRefStm"])
            at = section.get("Prev")
        if "Root" not in self.trailer:
            raise Broken("no root")

    def _section(self, at: int) -> dict:
        m = re.compile(rb"\s*xref\s+").match(self.data, at)
        if not m:
            return self._stream_section(at)
        at = m.end()
        while head := re.compile(rb"\s*(\d+)\s+(\d+)\s*\n?").match(self.data, at):
            first, n, at = int(head[1]), int(head[2]), head.end()
            for k in range(n):
                entry = re.compile(rb"\s*(\d{10}) (\d{5}) ([nf])").match(self.data, at)
                if not entry:
                    raise Broken("cross-reference entry")
                if entry[3] == b"n":
                    self.places.setdefault(first + k, (1, int(entry[1]), 0))
                at = entry.end()
        m = re.compile(rb"\s*trailer").match(self.data, at)
        if not m:
            raise Broken("no trailer")
        return _value(self.data, m.end())[0]

    def _stream_section(self, at: int) -> dict:
        about, body = self._object_at(at)
        if not isinstance(about, dict) or about.get("Type") != "XRef":
            raise Broken("no cross-references at their place")
        widths, index = about["W"], about.get("Index") or [0, about["Size"]]
        rows, step, k = _unfiltered(body, about), sum(about["W"]), 0
        for first, n in zip(index[::2], index[1::2]):
            for number in range(first, first + n):
                entry = rows[k * step : (k + 1) * step]
                if len(entry) < step:
                    raise Broken("cross-references are cut off")
                parts, p = [], 0
                for w in widths:
                    parts.append(int.from_bytes(entry[p : p + w], "big") if w else None)
                    p += w
                kind = 1 if parts[0] is None else parts[0]
                if kind in (1, 2):
                    self.places.setdefault(number, (kind, parts[1], parts[2] or 0))
                k += 1
        return about

    def _object_at(self, at: int):
        m = re.compile(rb"\s*\d+\s+\d+\s+obj").match(self.data, at)
        if not m:
            raise Broken("no object at its place")
        value, at = _value(self.data, m.end())
        m = re.compile(rb"\s*stream\r?\n").match(self.data, at)
        if not m or not isinstance(value, dict):
            return value, b""
        size = self.get(value.get("Length"))
        if not isinstance(size, int) or m.end() + size > len(self.data):
            raise Broken("stream is cut off")
        return value, self.data[m.end() : m.end() + size]

    def get(self, value):
        """What a reference points to; any other value is itself."""
        if not isinstance(value, tuple):
            return value
        kind, a, b = self.places.get(value[0], (0, 0, 0))
        if kind == 1:
            return self._object_at(a)[0]
        if kind == 2:  # the b-th object within the stream of object a
            place = self.places.get(a, (0, 0, 0))
            about, body = self._object_at(place[1])
            data = _unfiltered(body, about)
            heads = data[: about["First"]].split()
            return _value(data, about["First"] + int(heads[2 * b + 1]))[0]
        return None


def page_count(data: bytes) -> int:
    """Leaves of the page tree. A file whose references, tree or count don't hold is an error (ValueError)."""
    try:
        pdf = Pdf(data)
        root = pdf.get(pdf.trailer["Root"])
        top = root.get("Pages") if isinstance(root, dict) else None
        open_, seen, n = [top], set(), 0
        while open_:
            ref = open_.pop()
            if ref in seen:
                raise Broken("page tree in a circle")
            if isinstance(ref, tuple):
                seen.add(ref)
            node = pdf.get(ref)
            if not isinstance(node, dict):
                raise Broken("page tree with a missing node")
            if "Kids" in node:
                open_ += pdf.get(node["Kids"])
            else:
                n += 1
        said = pdf.get(pdf.get(top).get("Count"))
    except Broken:
        raise
    except (KeyError, TypeError, AttributeError, IndexError, ValueError, zlib.error, RecursionError) as e:
        raise Broken(f"{type(e).__name__}: {e}") from e
    if said != n:
        raise Broken(f"{n} pages, but the tree says {said}")
    return n
