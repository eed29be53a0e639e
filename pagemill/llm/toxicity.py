"""Toxicity by multiple-instance learning: a document is a bag of sentences, labels are known for bags only.

A sentence's probability is a logistic function of its words and of their first letters (for inflected forms); a
document's is the noisy-or of its sentences, 1 - prod(1 - p). The weights minimise the noisy-or's cross entropy on
document labels, so the model learns itself which sentences offend; these are then located.

Learning takes at most SAMPLE labelled documents of each label on average, chosen by a hash of the id, with their whole
texts, none of them held out; the weight of a label's rows makes up for the sampling. A sentence is the set of its words
and a document the set of its sentences, in learning and in scoring: saying the same again changes nothing.

Null and empty texts have no sentence and get the score 0. Repeated rows and null ids give a row each (null ids aren't
learned from; of repeated ones the least text and the highest label count); empty tables give no rows; without labels of
both kinds every score is 0. Of equally bad sentences the first is the worst one. Very long texts are scored whole, a
sentence at a time. Other columns are ignored, and no other column is ever an input of the score.
"""

from __future__ import annotations

import re
import zlib
from array import array
from math import exp, fsum

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import chosen, held_out, mapped, prepare, table

#: Fit bound: labelled documents of each label.
SAMPLE = 2000
BITS, PREFIXES = 18, (4, 5, 6)
#: Training: steps, step size, penalties on the weights' size (to choose features, to weigh them), and documents that a
#: feature must be seen in.
EPOCHS, RATE, PENALTY, LIGHT, LEAST = 150, 0.1, 3e-4, 1e-5, 4
DECISION = 0.7

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"\w+")
_MASK = (1 << BITS) - 1


def word_features(word: str) -> list[int]:
    """Hashed features of one lower-case word."""
    out = [zlib.crc32(word.encode()) & _MASK]
    out += [zlib.crc32(f"{n}:{word[:n]}".encode()) & _MASK for n in PREFIXES if len(word) > n]
    return out


def sentences(text: str | None) -> list[tuple[int, int, list[str]]]:
    """Start, end and lower-case words of each sentence that has words."""
    out = []
    text = text or ""
    low = text.lower()
    same = len(low) == len(text)
    for m in _SENTENCE.finditer(text):
        words = _WORD.findall(low, m.start(), m.end()) if same else _WORD.findall(m.group().lower())
        if words:
            out.append((m.start(), m.end(), words))
    return out


class Model:
    """Noisy-or of logistic sentence scores."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self._known: dict[str, float] = {}

    def __getstate__(self):
        at = np.flatnonzero(self.weights)
        return {"at": at, "w": self.weights[at], "bias": self.bias}

    def __setstate__(self, s):
        weights = np.zeros(1 << BITS, np.float32)
        weights[s["at"]] = s["w"]
        self.__init__(weights, s["bias"])

    def word(self, word: str) -> float:
        found = self._known.get(word)
        if found is None:
            if len(self._known) > 300_000:
                self._known.clear()
            found = self._known[word] = float(sum(self.weights[f] for f in word_features(word)))
        return found

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability, and start, end and probability of each sentence."""
        clean, parts, known = 1.0, [], {}
        for start, end, words in sentences(text):
            bag = frozenset(words)
            p = known.get(bag)
            if p is None:
                z = self.bias + fsum(map(self.word, bag))  # in any order the same sum
                p = known[bag] = 1 / (1 + exp(-z)) if z > -30 else 0.0
                clean *= 1 - p
            parts.append((start, end, float(p)))
        return float(min(1.0, max(0.0, 1 - clean))), parts


def train(texts: list[str], labels: list[int], class_weights: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Full-batch training with adaptive steps (Adam); the gradient of the noisy-or goes to each sentence by its part."""
    features, sentence_of, doc_of, of_word = array("i"), array("i"), array("i"), {}
    for d, text in enumerate(texts):
        for words in {frozenset(words): None for _, _, words in sentences(text)}:
            for w in sorted(words):
                found = of_word.get(w)
                if found is None:
                    found = of_word[w] = word_features(w)
                features.extend(found)
                sentence_of.extend([len(doc_of)] * len(found))
            doc_of.append(d)
    if not doc_of or len(set(labels)) < 2:
        return Model(np.zeros(1 << BITS, np.float32), -40.0)
    features, sentence_of, doc_of, y = *(np.frombuffer(x, np.int32) for x in (features, sentence_of, doc_of)), np.array(labels, float)
    seen = np.bincount(np.unique(features * np.int64(len(y)) + doc_of[sentence_of]) // len(y), minlength=1 << BITS)
    features, sentence_of = features[seen[features] >= LEAST], sentence_of[seen[features] >= LEAST]
    row_weight = np.where(y == 1, class_weights[1], class_weights[0]) / len(y)
    used, w, b = _descend(features, sentence_of, doc_of, y, row_weight, PENALTY, EPOCHS)
    # The penalty chose the features and made their weights too small; these are learned again without it.
    kept = np.isin(features, used[w != 0])
    used, w, b = _descend(features[kept], sentence_of[kept], doc_of, y, row_weight, LIGHT, 4 * EPOCHS)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w
    return Model(weights, float(b))


def _descend(features, sentence_of, doc_of, y, row_weight, penalty: float, epochs: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The features used, their weights and the bias of least penalised cross entropy."""
    used, column = np.unique(features, return_inverse=True)
    w, b = np.zeros(len(used)), -4.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, epochs + 1):
        z = b + np.bincount(sentence_of, w[column], len(doc_of))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_clean = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y))
        clean = np.exp(log_clean)
        share = np.where(y == 1, -clean / np.maximum(1 - clean, 1e-6), 1.0) * row_weight
        g_sentence = share[doc_of] * p
        g = np.bincount(column, g_sentence[sentence_of], len(used))
        gb = g_sentence.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = RATE / (np.sqrt(v / (1 - 0.99**t)) + 1e-4)
        w -= step * (m / (1 - 0.9**t))
        w = np.sign(w) * np.maximum(0, np.abs(w) - step * penalty)  # most words say nothing and get 0
        b -= RATE * 0.2 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-5)
    return used, w, float(b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from a bounded, hashed sample of the labelled rows that are not held out."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("y IN (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    odds = F.when(F.col("y") == 1, min(1.0, SAMPLE / totals.get(1, 1))).otherwise(min(1.0, SAMPLE / totals.get(0, 1)))
    some = chosen(known, "doc_id", odds, "doc_id", "y")
    # The sample is bounded (2 * SAMPLE ids on average), so its ids may be broadcast.
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(some), "doc_id")
    rows = [(r["text"] or "", r["y"]) for r in chosen(texts, "doc_id", F.lit(1.0), "text", "y").toLocalIterator()]
    # The rows' weights restore the labels' true proportions.
    n = {y: max(1, sum(r[1] == y for r in rows)) for y in (0, 1)}
    total = max(1, sum(totals.values()))
    weights = tuple(totals.get(y, 0) / total * len(rows) / n[y] for y in (0, 1))
    return train([r[0] for r in rows], [r[1] for r in rows], weights)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, and the offending sentences: their number and the worst one's place."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))

    def run(batch):
        out: dict[str, list] = {k: [] for k in ("score", "predicted", "n_offending", "worst_start", "worst_end", "worst_score")}
        for text in batch.column(1).to_pylist():
            p, parts = shared.value.score(text)
            worst = max(parts, key=lambda x: x[2], default=(None, None, None))
            for k, value in zip(out, (p, int(p >= DECISION), sum(x[2] >= 0.5 for x in parts), *worst)):
                out[k].append(value)
        return {"doc_id": batch.column(0), "held_out": batch.column(2)} | out

    return mapped(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int, n_offending bigint, worst_start bigint, worst_end bigint, worst_score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
