import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagemill.llm import fingerprints, ordering, queries, resampling, whitening
from tests.conftest import SF

LONG = " ".join(f"word{i % 997}" for i in range(30_000))
ROWS = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "!!! 123"), (5, LONG), (6, "Same text here again and again for all."), (6, "Same text here again and again for all."),
    (6, "Another text of the same id"), (None, "no id"), (None, None), (8, "Ein kleiner Satz über Straßen.\nUnd noch einer ."), (9, "<|endoftext|> a<s> ▁x \U0001f600 y"), (-7, "漢字 かな 漢字"),
]
SCHEMA = "doc_id long, text string, lang string, part long, score string, rank string, sig string, n long, uid long, weight long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, 1, "x", "y", "z", 3, 4, 5) for i, t in rows], SCHEMA)


# op12


def hashed(values, seed=42):
    """Spark's xxhash64 of several longs: the hash of one is the seed of the next."""
    for v in values:
        seed = xxhash.xxh64(struct.pack("<q", v), seed=seed & (2**64 - 1)).intdigest()
    return seed - 2**64 if seed >= 2**63 else seed


def signature(text, size=5):
    words = [x for x in re.split(r"[ \t\n\x0b\f\r]+", text) if x]
    g = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words]
    g = [x - 2**64 if x >= 2**63 else x for x in g]
    if len(g) < size:
        # an array is hashed element by element
        found = [hashed(g)]
    else:
        found = [hashed(g[i : i + size]) for i in range(len(g) - size + 1)]
    rest = 64 - fingerprints.BIN_BITS
    least: dict = {}
    for h in found:
        b = (h >> rest) + fingerprints.BINS // 2
        least[b] = min(least.get(b, h), h)
    bins = []
    for i in range(fingerprints.BINS):
        a, b = fingerprints.probe(i)
        at = i if i in least else next(p for p in ((a * t + b) % fingerprints.BINS for t in range(fingerprints.BINS)) if p in least)
        bins.append(least[at] & 15)
    return "".join(f"{x:x}" for x in bins)


def alike(a, b):
    p = sum(x == y for x, y in zip(a, b)) / fingerprints.BINS
    return max(0.0, (p - 1 / 16) / (1 - 1 / 16))


def neighbours(rows):
    """The result of op12 by its contract, from a sorted list."""
    key = lambda r: (r[0] is not None, r[0] or 0, hashed_text(r[1] or ""), (r[1] or "").encode())
    rows = sorted(rows, key=key)
    out = []
    for k, (i, text) in enumerate(rows):
        text, other = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        own, new = signature(text), signature(edited)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, new, round(alike(own, new), 9), round(alike(own, signature(other)), 9)))
    return sorted(out, key=str)


def hashed_text(text):
    h = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return h - 2**64 if h >= 2**63 else h


def found_neighbours(df):
    return sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in fingerprints.with_neighbours(df).collect()), key=str)


def test_fingerprints_of_odd_rows_equal_brute_force(spark):
    assert found_neighbours(frame(spark, ROWS)) == neighbours(ROWS)
    assert found_neighbours(frame(spark, ROWS[:1])) == neighbours(ROWS[:1])
    assert found_neighbours(frame(spark, ROWS).limit(0)) == []


def test_fingerprints_of_many_rows_and_one_common_id_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.randint(-(2**62), 2**62) if rng.random() < 0.5 else 77, " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(0, 90)))) for _ in range(700)]
    rows += [(None, rng.choice("xyz")) for _ in range(300)]
    rows += rows[:200]
    assert found_neighbours(frame(spark, rows)) == neighbours(rows)


def test_likeness_follows_the_sets_similarity(spark):
    rng = random.Random(8)
    pairs = []
    for _ in range(150):
        size = rng.choice([8, 20, 60, 300, 2000])
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(size)]
        cut = rng.randint(0, size)
        other = words[:cut] + [f"v{rng.randint(0, 10**6)}" for _ in range(size - cut)]
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (words, other))
        pairs.append((" ".join(words), " ".join(other), len(a & b) / len(a | b), size))
    df = spark.createDataFrame(pairs, "a string, b string, j double, size int")
    df = fingerprints.with_signature(fingerprints.with_signature(df, "a", "x"), "b", "y").select("j", "size", fingerprints.likeness("x", "y").alias("e"))
    errors = [(r["e"] - r["j"], r["size"]) for r in df.collect()]
    assert all(abs(e) < (0.1 if size >= 300 else 0.25) for e, size in errors) and abs(sum(e for e, _ in errors) / len(errors)) < 0.015
    assert all(len(x) == fingerprints.BINS for x in (r["fingerprint"] for r in fingerprints.fingerprint(frame(spark, ROWS)).collect()))


def test_fingerprints_run_without_python(spark):
    plan = fingerprints.with_neighbours(frame(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_order_parts_keep_the_order_and_split_common_values(spark):
    rng = random.Random(1)
    rows = [(7 if i % 3 else rng.randint(0, 1000), rng.randint(0, 10**9)) for i in range(6000)]
    df = spark.createDataFrame(rows, "a long, b long")
    part = ordering.order_parts(df, F.col("a"), F.col("b"), 40)
    got = sorted((r["a"], r["b"], r["p"]) for r in df.withColumn("p", part).collect())
    assert [p for *_, p in got] == sorted(p for *_, p in got)
    assert max(Counter(p for *_, p in got).values()) < 6000 / 40 * 3
    assert df.limit(0).withColumn("p", ordering.order_parts(df.limit(0), F.col("a"), F.col("b"), 40)).count() == 0


# op11


def drawn(rows, target, percent=10, ngram=1, buckets=10_000, least=20):
    """The result of op11 by its contract."""

    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return len(words), Counter(zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, ngram + 1) for i in range(len(words) - k + 1))

    docs, wanted = [features(t) for _, t in rows], [features(t)[1] for t in target]
    s, t = (sum(x, Counter()) for x in ([c for _, c in docs], wanted))
    ns, nt = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log(((t[b] + 1) * ns) / ((s[b] + 1) * nt))) for b in s}
    out = []
    for (i, _), (n, c) in zip(rows, docs):
        weight = sum(gain[b] * k for b, k in c.items())
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def found_drawn(df, target, **how):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in resampling.resample(df, target, **how).collect()), key=str)


@pytest.mark.parametrize("ngram", [1, 2])
def test_resampling_equals_brute_force(spark, ngram):
    rng = random.Random(ngram)
    rows = ROWS + [(rng.randint(0, 300), " ".join(rng.choice(["the", "The", "über", "x-1", "a", "b2", "c", "物"]) + rng.choice(["", str(rng.randint(0, 400))]) for _ in range(rng.randint(0, 60)))) for _ in range(500)]
    target = ["The the 17 a b2 über", None, "", "c c c c 物 the 5 x 1"]
    items = spark.createDataFrame([(k, t, k) for k, t in enumerate(target)], "item_id long, text string, bucket long")
    assert found_drawn(frame(spark, rows), items, ngram=ngram, percent=30) == drawn(rows, target, 30, ngram)
    assert found_drawn(frame(spark, rows), items.limit(0), ngram=ngram) == drawn(rows, [], 10, ngram)
    assert found_drawn(frame(spark, rows).limit(0), items, ngram=ngram) == []


def test_words_from_runs(spark):
    for ngram in (1, 2, 3):
        want = {sum(n - k + 1 for k in range(1, ngram + 1) if n >= k): n for n in range(60)}
        df = spark.createDataFrame([(f,) for f in want], "f long")
        assert {r["f"]: r["n"] for r in df.select("f", resampling.n_words(F.col("f"), ngram).alias("n")).collect()} == want


def test_ties_and_long_texts_of_resampling(spark, monkeypatch):
    rows = [(5, "same words " * 15), (5, "same words " * 15), (None, "same words " * 15)] + [(i, "same words " * 15) for i in range(100, 160)]
    target = spark.createDataFrame([("same",)], "text string")
    monkeypatch.setattr(resampling, "LONG", 10)
    assert found_drawn(frame(spark, rows), target, percent=50) == drawn(rows, ["same"], 50)


def test_resampling_sql_equals_the_query(spark, duck):
    own = resampling.op11_resampling(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    other = duck.sql(queries.oracle_sql()["op11_resampling"]).df().sort_values("doc_id").reset_index(drop=True)
    assert own["rank"].notna().sum() > 5
    for c in other.columns:
        assert np.array_equal(own[c].fillna(-1).astype("int64"), other[c].fillna(-1).astype("int64")), c


# op13


def embeddings(spark, rows, schema="vec_id long, embedding array<float>, label int, n long, component int, x string, w string, deviation string"):
    return spark.createDataFrame([(i, v, 1, 2, 3, "x", "w", "d") for i, v in rows], schema)


def test_whitening_equals_exact_arithmetic(spark):
    rng = random.Random(3)
    rows = [(i if i % 50 else None, [float(np.float32(rng.gauss(0, 1) * (1 + k) + (rng.gauss(0, 3) if k else 0))) for k in range(6)]) for i in range(400)]
    rows += rows[:20]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, [1.0]), (905, []), (906, [1e30] + [0.0] * 5)]
    found = whitening.whiten(embeddings(spark, rows + bad), components=4).collect()
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    n, width = len(x), 6
    total = [sum(r[k] for r in x) for k in range(width)]
    v = np.array([[float(sum((Fraction(n * r[a] - total[a]) * (n * r[b] - total[b]) for r in x), Fraction(0)) / n**3) for b in range(width)] for a in range(width)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    centred = np.array([[float(Fraction(r[k]) - Fraction(total[k], n)) for k in range(width)] for r in x])
    want = np.abs(centred @ vectors[:, :4] / np.sqrt(values[:4]))
    expected = sorted((str(i), k + 1, sum((n * a - s) ** 2 for a, s in zip(r, total)), round(want[j, k], 7)) for j, ((i, _), r) in enumerate(zip(rows, x)) for k in range(4))
    assert sorted((str(r["vec_id"]), r["component"], r["deviation"], round(abs(r["whitened"]), 7)) for r in found) == expected
    assert {r["n"] for r in found} == {n} and max(r["identity_error"] for r in found) < 1e-12
    assert np.allclose([next(r["explained"] for r in found if r["component"] == k + 1) for k in range(4)], values[:4] / np.trace(v), rtol=1e-12)


def test_covariance_is_exact_where_plain_sums_are_not(spark):
    rng = random.Random(9)
    rows = [(i, [10.0**9 + rng.random() * 1e-3, rng.random() * 1e9, 1e-6 * rng.random()]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    n, total = whitening.sums(df, "embedding")
    assert total == [sum((Fraction(v[k]) for _, v in rows), Fraction(0)) for k in range(3)] or all(abs(a - sum((Fraction(v[k]) for _, v in rows), Fraction(0))) < abs(a) * Fraction(1, 2**95) for k, a in enumerate(total))
    high, low = whitening.covariance(df.repartition(7), "embedding", n, total)
    centred = [[Fraction(v[k]) - total[k] / n for k in range(3)] for _, v in rows]
    want = [[sum((c[a] * c[b] for c in centred), Fraction(0)) / n for b in range(3)] for a in range(3)]
    for a in range(3):
        for b in range(3):
            error = Fraction(high[a, b]) + Fraction(low[a, b]) - want[a][b]
            assert error**2 <= want[a][a] * want[b][b] * Fraction(1, 2**130)  # 2^-65 of both deviations


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(embeddings(spark, [(1, [1.0, 2.0])]).limit(0)).count() == 0
    assert whitening.whiten(embeddings(spark, [(1, None), (2, [])])).count() == 0
    one = whitening.whiten(embeddings(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(one) == 4 and {(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(0, None, None, None)}
    flat = whitening.whiten(embeddings(spark, [(i, [float(i), 5.0, -float(i)]) for i in range(50)])).collect()
    assert {r["component"]: r["whitened"] is None for r in flat} == {1: False, 2: True, 3: True} and flat[0]["identity_error"] < 1e-12
    far = whitening.whiten(embeddings(spark, [(1, [2.0**44, 0.0]), (2, [-(2.0**44), 1.0]), (3, [0.0, 0.0])])).collect()
    assert {r["deviation"] for r in far if r["vec_id"] == 1} == {None}


def test_whitened_table(spark):
    found = queries.queries()["op13_whitening"](spark, SF)
    first = found.filter("component = 1").count()
    assert found.count() == 32 * first and found.agg(F.max("identity_error")).first()[0] < 1e-9
    own = found.groupBy("component").agg(F.avg("whitened").alias("m"), F.var_pop("whitened").alias("v")).collect()
    assert all(abs(r["m"]) < 1e-9 and abs(r["v"] - 1) < 1e-9 for r in own)
