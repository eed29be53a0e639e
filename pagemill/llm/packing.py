"""Packing along a space-filling curve: similar documents end up in the same sequences.

A document's hashed vector (the mean of fixed random vectors of its token ids) has DIMENSIONS coordinates; their place
on a Hilbert curve of BITS bits a coordinate is the document's key. Documents are range-sorted by key and cut into
sequences of at most LENGTH tokens in that order. Each partition fills its sequences completely; its last tokens go to
sequences of powers of two, which need no padding.

Tokens: texts are cut where the tokenizer's own pattern cuts whatever stands around (white space, digits, letters beside
punctuation), all texts of a batch at once; the tokenizer sees each distinct piece of a batch once (bounded cache of
CACHE pieces), and texts with its special strings are given to it whole. Ids are written to the shared folder once, then
range-partitioned by (key, row, start) into parts of about PART_BYTES, in rows of at most PIECE ids, so a hot key, a group
of copies or a very long text spreads over partitions. A task holds one sequence beside a batch. A very long text is read
in segments of about SEGMENT bytes, cut at white space, so the arrays beside it stay small.

Null and empty texts have the end id alone. Repeated rows and null ids are packed as they are; rows of equal keys keep the
order in which they were read. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import ctypes
import json
import os
import re
import zlib
from contextlib import suppress
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import arrow_schema, materialize, prepare, table

LENGTH, END_ID = 4096, 2
DIMENSIONS, BITS, SCALE = 3, 16, 12.0
CACHE, KEPT, LONGEST = 300_000, 50_000, 40
SEGMENT, PART_BYTES = 4 << 20, 32 << 20
#: Most ids of a row before packing: rows of a bounded size make parts of a bounded size.
PIECE = 4096
#: Stands between pieces that are encoded together; a piece that holds it is encoded alone.
MARK = "\x02"
#: Fixed value: the pattern by which the tokenizer cuts texts. Files with another one get whole texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Classes of bytes. A text ends with 0xFF and stands as 0xFE if it is encoded whole; neither is part of UTF-8.
BLANK, LETTER, DIGIT, APOSTROPHE, SIGN, OTHER, LATIN, OWN = range(8)
_END, _WHOLE = b"\xff", b"\xfe"
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[:128] = SIGN
_CLASS[[9, 10, 11, 12, 13, 32]] = BLANK
_CLASS[97:123], _CLASS[48:58], _CLASS[39], _CLASS[254:] = LETTER, DIGIT, APOSTROPHE, OWN


def _starts() -> np.ndarray:
    """For each class before and class: does a piece start here, whatever else is around?"""
    out = np.zeros((8, 8), bool)
    out[[BLANK, OWN], :] = out[:, [DIGIT, OWN]] = True  # a digit is always alone
    out[DIGIT, [LETTER, APOSTROPHE, SIGN]] = True
    out[[[LETTER], [LATIN]], [APOSTROPHE, SIGN]] = True
    out[SIGN, LETTER] = True  # but an apostrophe may belong to what follows
    out[:, BLANK] = False
    return out.ravel()


#: By eight times the class before, plus the class.
_STARTS = _starts()
#: White space outside ASCII, in UTF-8.
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_WHITE = re.compile(rb"[\t-\r ]")
#: Words of letters that the tokenizer's normalizer leaves as they are, and what its byte alphabet has for bytes of them.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
_ALPHABET = {b: 0x100 + 33 + b - 0x7F for b in range(0x7F, 0xA1)} | {0xAD: 0x100 + 67}


def _spans(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ..., counts[0] numbers in all, then the same for the next ones."""
    stops = np.cumsum(counts, dtype=np.int32)
    out = np.repeat(first - (stops - counts), counts)
    out += np.arange(len(out), dtype=np.int32)
    return out


class Encoder:
    """Token ids of texts by a tokenizers file, with a bounded cache of pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.uint16 if self.size < 1 << 16 else np.uint32
        # The first two characters of special strings: texts with them are encoded whole.
        self.marks = {t.content[:2].encode() for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids[0]
        spec = json.loads(self.tokenizer.to_str())
        self.cuts = PATTERN in json.dumps(spec["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\") and spec["model"].get("end_of_word_suffix") == "</w>"
        if self.cuts:
            # Runs of plain letters need neither normalizer nor pattern, and each one's last token has the word's end.
            spec |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
            self.plain = Tokenizer.from_str(json.dumps(spec))
            self.ends = np.zeros(self.size, bool)
            self.ends[[i for token, i in self.plain.get_vocab().items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, int] = {}
        self._turn()

    def rest(self) -> None:
        """Between tasks, when many workers may be idle, a large cache goes."""
        self.known = self.known if len(self.known) <= KEPT else {}
        if not self.known:
            self._turn()
        self.older = ({}, None, None, None)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # where the C library can give freed memory back
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    def _turn(self) -> None:
        """A new generation of entries; the last one is kept beside it, so that frequent pieces stay."""
        self.older = (self.known, self.ids, self.first, self.count) if self.known else ({}, None, None, None)
        self.known = {}
        self.ids, self.first, self.count = np.empty(1 << 16, self.kind), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.used = self.entries = 0

    def _add(self, flat: np.ndarray, counts: np.ndarray) -> int:
        """New entries with the ids of flat; the first one's number."""
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.entries + len(counts) > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        at = slice(self.entries, self.entries + len(counts))
        self.ids[self.used : self.used + len(flat)] = flat
        self.first[at], self.count[at] = self.used + np.cumsum(counts) - counts, counts
        self.used, self.entries = self.used + len(flat), at.stop
        return at.start

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.kind) for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _letters(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of plain letters, and how many each has."""
        flat = [np.empty(0, self.kind)]
        for i in range(0, len(words), 500):
            line = b" ".join(words[i : i + 500]).decode("latin-1")
            flat.append(np.array(self.plain.encode(line if line.isascii() else line.translate(_ALPHABET), add_special_tokens=False).ids, self.kind))
        flat = np.concatenate(flat)
        counts = np.diff(np.flatnonzero(self.ends[flat]), prepend=-1)
        if len(counts) != len(words) or counts.sum() != len(flat):
            raise ValueError("the tokenizer's words don't end with its mark")
        return flat, counts

    def _pieces(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of any pieces. They are encoded in lines of some hundred, with a mark of one token between them."""
        out = []
        for i in range(0, len(words), 400):
            some = [w.decode("utf-8", "replace") for w in words[i : i + 400]]
            ids = np.array(self.tokenizer.encode(f" {MARK} ".join(some), add_special_tokens=False).ids, self.kind)
            parts = np.split(ids, np.flatnonzero(ids == self.mark))
            found = [parts[0], *[x[1:] for x in parts[1:]]]
            out += found if len(found) == len(some) else self._raw(some)
        return out

    def _numbers(self, pieces: list[bytes], end_id: int) -> np.ndarray:
        """The entry of each piece; new ones are encoded."""
        if len(self.known) > CACHE:
            self._turn()
        known, (older, ids, first, count) = self.known, self.older
        found = list(map(known.get, pieces))
        new = [i for i, x in enumerate(found) if x is None]
        if new and older:
            old = [older.get(pieces[i]) for i in new]
            again = [i for i, x in zip(new, old) if x is not None]
            at = np.array([x for x in old if x is not None], np.int64)
            at = self._add(ids[_spans(first[at], count[at])], count[at])
            for k, i in enumerate(again):
                found[i] = known[pieces[i]] = at + k
            new = [i for i, x in zip(new, old) if x is None]
        if new:
            ascii_words = [i for i in new if pieces[i].isalpha()]
            rest = [i for i in new if not pieces[i].isalpha()]
            letters = ascii_words + [i for i in rest if _PLAIN(pieces[i])]
            rest = [i for i in rest if not _PLAIN(pieces[i])]
            flat, counts = self._letters([pieces[i] for i in letters])
            at = self._add(flat, counts)
            own = {_END: np.array([end_id], self.kind), _WHOLE: np.empty(0, self.kind)}
            others = iter(self._pieces([pieces[i] for i in rest if pieces[i] not in own]))
            ids = [own[pieces[i]] if pieces[i] in own else next(others) for i in rest]
            self._add(np.concatenate(ids) if ids else flat[:0], np.array([len(x) for x in ids], np.int64))
            for k, i in enumerate([*letters, *rest]):
                found[i] = at + k
                if len(pieces[i]) <= LONGEST:
                    known[pieces[i]] = at + k
        return np.array(found, np.int32)

    def encode(self, texts: list[bytes | None], end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8), each with the end id after it, and where each text ends among them."""
        ids, ends, body, whole, size, total = [], [], [], [], 0, 0

        def flush():
            nonlocal size, total
            if body:
                flat, own = self._segment(b"".join(body), whole, end_id)
                ids.append(flat)
                ends.append(own + total)
                total += len(flat)
            body.clear()
            whole.clear()
            size = 0

        for text in texts:
            text = text or b""
            if text and (not self.cuts or any(m in text for m in self.marks)):
                whole.append(text)
                body += [_WHOLE, _END]
                continue
            at = 0
            while len(text) - at > SEGMENT:  # white space is always between pieces
                m = _WHITE.search(text, at + SEGMENT)
                stop = m.start() if m else len(text)
                body.append(text[at:stop])
                flush()
                at = stop
            body += [text[at:] if at else text, _END]
            size += len(text) - at
            if size > SEGMENT:
                flush()
        flush()
        return (np.concatenate(ids), np.concatenate(ends)) if ids else (np.empty(0, self.kind), np.empty(0, np.int64))

    def _segment(self, body: bytes, whole: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of texts, and where each text that ends in it does so."""
        data = _LOWER[np.frombuffer(_WIDE.sub(b" ", body), np.uint8)]
        kinds = _CLASS[data]
        latin = np.flatnonzero(data == 0xC3) + 1  # letters like é; the two signs among them stay as they are
        latin = latin[latin < len(data)]
        latin = latin[(data[latin] != 0x97) & (data[latin] != 0xB7)]
        kinds[latin] = LATIN
        data[latin[data[latin] < 0x9F]] += 0x20
        solid = kinds != BLANK
        kinds[1:] += kinds[:-1] << np.uint8(3)
        starts = _STARTS[kinds][solid]  # only pieces' first bytes start one, and these are solid
        packed = data[solid]
        del data, kinds, solid
        offsets = np.append(np.flatnonzero(starts).astype(np.int32), np.int32(len(packed)))
        words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
        pieces, codes = words.dictionary.to_pylist(), words.indices.to_numpy()
        del words, offsets, packed, starts
        found = self._numbers(pieces, end_id)[codes]
        if whole:
            extra = self._raw([t.decode("utf-8", "replace") for t in whole])
            kept = self.used, self.entries
            at = self._add(np.concatenate(extra), np.array([len(x) for x in extra], np.int64))
            found[codes == pieces.index(_WHOLE)] = np.arange(at, at + len(extra))
            self.used, self.entries = kept  # they are read below, and not kept
        counts = self.count[found]
        stops = np.cumsum(counts)
        return self.ids[_spans(self.first[found], counts)], stops[codes == pieces.index(_END)] if _END in pieces else stops[:0]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def _vectors(size: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((DIMENSIONS, size)).astype(np.float32)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of whole coordinates (Skilling's transposition, vectorised)."""
    x = points.astype(np.int64).T.copy()
    n, q = len(x), np.int64(1) << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), np.int64(1) << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_keys(ids: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """The place on the curve of each document, whose ids end at ends and aren't empty."""
    starts = np.concatenate([[0], ends[:-1]])
    mean = np.stack([np.add.reduceat(v[ids], starts) for v in _vectors(size)], axis=1).astype(np.float64) / (ends - starts)[:, None]
    return hilbert((1 / (1 + np.exp(-SCALE * mean)) * ((1 << BITS) - 1)).astype(np.int64))


def gathered(batches):
    """Texts and document ids of some batches of about SEGMENT bytes together."""
    texts, ids, size = [], [], 0
    for batch in batches:
        if batch.num_rows:
            texts += batch.column(1).cast(pa.binary()).to_pylist()
            ids.append(batch.column(0))
            size += batch.column(1).nbytes
            if size >= SEGMENT:
                yield texts, pa.concat_arrays(ids)
                texts, ids, size = [], [], 0
    if texts:
        yield texts, pa.concat_arrays(ids)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    ddl = f"place bigint, rid bigint, start bigint, doc_tokens bigint, bytes bigint, doc_id {kind}, ids binary"
    schema = arrow_schema(spark, ddl)

    def tokenize(batches):
        from pyspark import TaskContext

        own, rid = encoder(tokenizer_path), TaskContext.get().partitionId() << 36
        for texts, ids_of in gathered(batches):
            ids, ends = own.encode(texts, end_id)
            counts = np.diff(ends, prepend=0)
            cuts = -(-counts // PIECE)
            doc = np.repeat(np.arange(len(texts)), cuts)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * PIECE
            edges = np.append((ends - counts)[doc] + start, len(ids)) * ids.itemsize
            raw = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(edges), pa.py_buffer(ids)])
            place = curve_keys(ids, ends, own.size)[doc]
            columns = [pa.array(place), pa.array(rid + doc), pa.array(start), pa.array(counts[doc]), pa.array(np.diff(edges)), ids_of.take(pa.array(doc)), raw]
            rid += len(texts)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
        own.rest()

    coded = materialize(rows.mapInArrow(tokenize, ddl))
    id_kind = encoder(tokenizer_path).kind
    total = coded.agg(F.sum("bytes")).first()[0] or 0
    parts = max(1, -(-total // PART_BYTES))
    ordered = coded.repartitionByRange(parts, "place", "rid", "start").sortWithinPartitions("place", "rid", "start").select("doc_id", "rid", "start", "doc_tokens", "ids")
    out_ddl = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    out_schema = arrow_schema(spark, out_ddl)

    def fill(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        rows_out: list[tuple] = []
        waiting: list[tuple] = []  # pieces of the open sequence: doc_id, start, ids, doc_tokens
        filled, sequence, last = 0, 0, None

        def close(pieces):
            nonlocal sequence
            at = 0
            for doc_id, start, ids, total in pieces:
                rows_out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, first + sequence, at))
                at += len(ids)
            sequence += 1

        def flush():
            columns = list(zip(*rows_out)) if rows_out else [[]] * len(out_schema)
            rows_out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out_schema)], schema=out_schema)

        for batch in batches:
            for doc_id, rid, start, total, raw in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(raw, id_kind)
                while len(ids):
                    piece, ids = ids[: length - filled], ids[length - filled :]
                    if waiting and last == (rid, start):  # goes on where the last piece ended
                        waiting[-1] = (*waiting[-1][:2], np.concatenate([waiting[-1][2], piece]), total)
                    else:
                        waiting.append((doc_id, start, piece, total))
                    start, filled = start + len(piece), filled + len(piece)
                    last = rid, start
                    if filled == length:
                        close(waiting)
                        waiting, filled = [], 0
            if rows_out:
                yield flush()
        for pieces in powers(waiting):
            close(pieces)
        if rows_out:
            yield flush()

    return ordered.mapInArrow(fill, out_ddl)


def powers(pieces: list[tuple]) -> list[list[tuple]]:
    """The pieces of an unfilled sequence, cut into sequences of falling powers of two."""
    left, out = sum(len(p[2]) for p in pieces), []
    queue = list(reversed(pieces))
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out.append([])
        while room:
            doc_id, start, ids, total = queue.pop()
            if len(ids) > room:
                queue.append((doc_id, start + room, ids[room:], total))
                ids = ids[:room]
            out[-1].append((doc_id, start, ids, total))
            room -= len(ids)
    return out


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
