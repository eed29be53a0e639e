"""Language identification with bit-sliced Bloom filters of n-grams.

One table of SLOTS bit masks serves all languages: an n-gram (N bytes of the lower-case text, letters and blanks) sets
its languages' bits in HASHES slots, and the AND of these slots gives all languages that contain it, in one look-up.
The count of a language is the number of a text's n-grams with its bit; false positives are taken off with the fill of
the language's bits: (count - n * f) / (1 - f), f = fill ** HASHES. The largest corrected count decides.

Learning: n-grams of at most SAMPLE documents of each language on average (chosen by a hash of the id, whole texts) go
to each language where their share is at least KEEP of the largest share. The sample's texts pass through the driver one
by one; it keeps the n-grams' counts. A slot has as many 64-bit words as the languages need.

A text that is null or has no letter gives `und` with score 0. A text without any known n-gram gives the most frequent
language with score 0. Of languages with equal counts the first by name is taken. Very long texts are read whole, all
their n-grams at once. Repeated rows and null ids give a row each (null ids aren't learned from; of repeated ones the
least language and text count); empty tables give no rows; without rows to learn from, everything is `und`. Other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import chosen, held_out, mapped, prepare, table

N, SLOTS, HASHES = 4, 1 << 18, 3
#: Fit bound: documents of a language.
SAMPLE = 1200
WORD = 64
KEEP, LEAST = 0.25, 3
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_TABLE = bytes(i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of all texts as numbers, and the index of each one's text. Runs of other characters are one blank."""
    parts = [b" ".join((" " + t.lower() + " ").encode().translate(_TABLE).split()) for t in texts]
    joined = b" ".join([b"", *parts, b""])
    raw = np.frombuffer(joined, np.uint8)
    if len(raw) < N:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    wide = raw.astype(np.uint32)
    keys = wide[: len(raw) - N + 1].copy()
    for i in range(1, N):
        keys = (keys << np.uint32(8)) | wide[i : len(raw) - N + 1 + i]
    inner = np.ones(len(keys), bool)
    for i in range(1, N - 1):
        inner &= raw[i : len(raw) - N + 1 + i] != 32
    ends = np.cumsum([len(p) + 1 for p in parts])
    owner = np.repeat(np.arange(len(parts)), np.diff(np.concatenate([[0], ends])))
    owner = np.concatenate([owner, [len(parts) - 1]])[: len(keys)]
    return keys[inner], owner[inner]


def tally(texts: list[str]) -> Counter:
    values, counts = np.unique(grams(texts)[0], return_counts=True)
    return Counter(dict(zip(values.tolist(), counts.tolist())))


def _slots(keys: np.ndarray) -> list[np.ndarray]:
    wide = keys.astype(np.uint64)
    return [((wide * np.uint64(m)) >> np.uint64(11)) & np.uint64(SLOTS - 1) for m in _MULTIPLIERS[:HASHES]]


class Filters:
    """The bit-sliced filters of some languages."""

    def __init__(self, samples: dict[str, list[str] | Counter], totals: dict[str, int] | None = None):
        """From texts or n-gram counts of each language; totals: rows of each, where the samples don't say it."""
        self.languages = sorted(samples)
        self.most = max(self.languages, key=lambda x: ((totals or {}).get(x, len(samples[x])), x), default=UNKNOWN)
        shares: list[dict] = []
        for language in self.languages:
            counts = samples[language] if isinstance(samples[language], Counter) else tally(samples[language])
            total = max(1, counts.total())
            shares.append({v: c / total for v, c in counts.items() if c >= LEAST})
        best: Counter = Counter()
        for share in shares:
            for v, s in share.items():
                best[v] = max(best[v], s)
        self.table = np.zeros((max(1, -(-len(shares) // WORD)), SLOTS), np.uint64)
        for i, share in enumerate(shares):
            kept = np.array([v for v, s in share.items() if s >= KEEP * best[v]], np.uint32)
            for at in _slots(kept):
                np.bitwise_or.at(self.table[i // WORD], at, np.uint64(1 << i % WORD))
        fill = np.array([((self.table[i // WORD] >> np.uint64(i % WORD)) & np.uint64(1)).mean() for i in range(len(self.languages))])
        self.false = fill**HASHES
        if len(self.languages) <= 8:
            self.table = self.table.astype(np.uint8)  # a table that stays in the cache

    def counts(self, texts: list[str]) -> np.ndarray:
        """Corrected counts, rows by text and columns by language; the last column is the number of n-grams."""
        keys, owner = grams(texts)
        slots = _slots(keys)
        n = np.bincount(owner, minlength=len(texts)).astype(float)
        out = np.empty((len(texts), len(self.languages) + 1))
        out[:, -1] = n
        for i, f in enumerate(self.false):
            if i % WORD == 0:
                word = self.table[i // WORD]
                masks = word[slots[0]]
                for at in slots[1:]:
                    masks = masks & word[at]
            bits = ((masks >> masks.dtype.type(i % WORD)) & masks.dtype.type(1)).astype(bool)
            out[:, i] = np.maximum(0, (np.bincount(owner[bits], minlength=len(texts)) - n * f) / (1 - f))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Language, score (the winner's part of all languages' counts) and known (the winner's part of the text's n-grams)."""
        known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        out = [(UNKNOWN, 0.0, 0.0)] * len(texts)
        if not known or not self.languages:
            return out
        counts = self.counts([texts[i] for i in known])
        found = counts[:, :-1]
        for i, row, n in zip(known, found, counts[:, -1]):
            top = int(row.argmax())
            if row[top] <= 0:
                out[i] = (self.most, 0.0, 0.0)
            else:
                out[i] = (self.languages[top], float(min(1.0, row[top] / row.sum())), float(row[top] / n))
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters from a bounded sample of each language's rows that are not held out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not totals:
        return Filters({})
    odds = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, min(1.0, SAMPLE / n))])
    some = chosen(rows, "doc_id", F.coalesce(odds[F.col("lang")], F.lit(0.0)), "lang", "text")
    counts: dict[str, Counter] = {}
    held: dict[str, list[str]] = {}
    for row in some.toLocalIterator():
        held.setdefault(row["lang"], []).append(row["text"])
        if sum(map(len, held[row["lang"]])) > 1 << 18:
            counts.setdefault(row["lang"], Counter()).update(tally(held.pop(row["lang"])))
    for language, texts in held.items():
        counts.setdefault(language, Counter()).update(tally(texts))
    return Filters(counts, totals)


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, known for each row of docs, and the columns named in keep."""
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(filters)
    kinds = dict(docs.dtypes)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"), *[F.col(k).alias(f"k_{k}") for k in keep])
    extra = "".join(f", k_{k} {kinds[k]}" for k in keep)

    def label(batch):
        found = model.value.predict(batch.column(1).to_pylist())
        out = {"doc_id": batch.column(0), "held_out": batch.column(2), "lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "known": [x[2] for x in found]}
        return out | {f"k_{k}": batch.column(3 + i) for i, k in enumerate(keep)}

    return mapped(rows, label, f"doc_id {kinds[id_col]}, held_out boolean, lang_pred string, score double, known double{extra}")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).drop("known")
