import math
import random
import re
from collections import Counter

import pytest

from pagemill.operators.ranked_index import K1, B, RankedIndex


def brute(docs, queries, n):
    words = {i: re.findall(r"[a-z0-9]+", (t or "").lower()) for i, t in docs.items()}
    mean = sum(map(len, words.values())) / max(1, len(words)) or 1.0
    df = Counter(w for x in words.values() for w in set(x))
    out = []
    for q, text in queries:
        scores = {}
        for w in set(re.findall(r"[a-z0-9]+", (text or "").lower())):
            for i, x in words.items():
                if tf := x.count(w):
                    idf = math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5))
                    scores[i] = scores.get(i, 0) + math.floor(1e6 * idf * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(x) / mean))))
        out += [(q, i, s, k + 1) for k, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:n])]
    return sorted(out)


@pytest.fixture()
def made():
    rng = random.Random(6)
    vocabulary = ["the", "of", "and"] * 60 + [f"w{i}" for i in range(150)] + [f"r{i}" for i in range(300)]
    text = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 20, 90, 200])))
    return rng, text, {i: text() for i in range(400)}


def frame(spark, docs):
    return spark.createDataFrame([*docs.items(), (None, "the lost")], "id long, text string")


def test_search_and_refresh_equal_brute_force(spark, tmp_path, made):
    rng, text, docs = made
    docs[3], docs[4] = None, "The THE of-the w1"
    index = RankedIndex(spark, f"file://{tmp_path}/index")
    asked = [(k, text()[:80]) for k in range(12)] + [(20, "the of"), (21, "the w1 r7"), (22, ""), (23, None), (24, "unknownword")]
    queries = spark.createDataFrame(asked, "qid int, text string")
    assert index.search(queries).count() == 0
    assert index.refresh(frame(spark, docs)) == {"new": 400, "changed": 0, "removed": 0, "kept": 0}

    def found(n=5, common=0.05):
        return sorted((r["qid"], r["id"], r["score"], r["rank"]) for r in index.search(queries, n, common).collect())

    want = brute(docs, asked, 5)
    assert found() == want and found(common=2.0) == want and found(common=0.0) == want
    # only what changed is written; the results are those of a new index
    for i in rng.sample(range(400), 30):
        docs[i] = text()
    for i in rng.sample(range(400), 20):
        docs.pop(i, None)
    docs |= {1000 + i: text() for i in range(15)}
    counts = index.refresh(frame(spark, docs))
    assert counts["new"] == 15 and counts["removed"] == 20 and counts["changed"] + counts["kept"] == 380 and counts["changed"] <= 30
    assert spark.read.parquet(f"file://{tmp_path}/index/documents/segment=2").count() == counts["new"] + counts["changed"] + counts["removed"]
    assert found() == brute(docs, asked, 5)
    assert index.refresh(frame(spark, docs))["kept"] == 395 and index.segments() == [1, 2]


def test_a_refresh_that_broke_off_is_not_seen(spark, tmp_path, made):
    _, text, docs = made
    docs = dict(list(docs.items())[:50])
    index = RankedIndex(spark, f"file://{tmp_path}/index")
    index.refresh(frame(spark, docs))
    spark.read.parquet(f"file://{tmp_path}/index/postings/segment=1").write.parquet(f"file://{tmp_path}/index/postings/segment=2")
    queries = spark.createDataFrame([(1, "the w1 w2")], "qid int, text string")
    got = lambda: sorted((r["qid"], r["id"], r["score"], r["rank"]) for r in index.search(queries).collect())
    assert got() == brute(docs, [(1, "the w1 w2")], 5)
    docs[0] = "w1 w2 " * 20
    assert index.refresh(frame(spark, docs))["changed"] == 1 and got() == brute(docs, [(1, "the w1 w2")], 5)


def test_lexical_search_counts_repeated_ids_once_and_deals_by_size(spark, monkeypatch):
    from pagemill.operators import search

    docs = spark.createDataFrame([(i % 50, f"w{i % 7} w{i % 5} common") for i in range(200)], "id long, text string")
    queries = spark.createDataFrame([(q, f"w{q} common") for q in range(7)], "qid long, text string")
    words = {i: {"common", *(f"w{k % m}" for k in range(i, 200, 50) for m in (7, 5))} for i in range(50)}
    want = set()
    for q in range(7):
        best = sorted(((-len(words[i] & {f"w{q}", "common"}), i) for i in words))[:5]
        want |= {(q, i, -s, r + 1) for r, (s, i) in enumerate(best)}
    for most in (search.MOST_WORDS, 3):  # broadcast queries, and a join
        monkeypatch.setattr(search, "MOST_WORDS", most)
        monkeypatch.setattr(search, "TASK_SCORES", 10)
        got = search.lexical_top(queries, docs)
        assert {tuple(r) for r in got.select("qid", "id", "score", "rank").collect()} == want
        assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().toString() and "hashpartitioning(id" in got._jdf.queryExecution().toString()


def test_frequencies_are_counted_within_the_row_without_a_shuffle(spark):
    from pyspark.sql import functions as F

    from pagemill.operators.ranked_index import frequencies

    texts = {1: None, 2: "", 3: "The THE of-the Ärger 7x7 K", 4: "w1 " * 5000 + "w2", 5: "..."}
    rows = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(1).select("id", frequencies(F.lower("text")).alias("f"))
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {r["id"]: (r["f"]["length"], {t["term"]: t["tf"] for t in r["f"]["terms"]}) for r in rows.collect()}
    assert got == {1: (0, {}), 2: (0, {}), 3: (7, {"the": 3, "of": 1, "rger": 1, "7x7": 1, "k": 1}), 4: (5001, {"w1": 5000, "w2": 1}), 5: (0, {})}


def test_common_terms_are_looked_up_some_at_a_time(spark, tmp_path, made, monkeypatch):
    from pagemill.operators import ranked_index

    rng, text, docs = made
    index = RankedIndex(spark, f"file://{tmp_path}/index")
    asked = [(k, text()[:80]) for k in range(12)] + [(21, "the w1 r7 of and")]
    index.refresh(frame(spark, docs))
    for i in rng.sample(range(400), 30):
        docs[i] = text()
    docs.pop(5)
    index.refresh(frame(spark, docs))
    queries = spark.createDataFrame(asked, "qid int, text string")
    for places in (1, 2, ranked_index.PLACES):
        monkeypatch.setattr(ranked_index, "PLACES", places)
        got = sorted((r["qid"], r["id"], r["score"], r["rank"]) for r in index.search(queries).collect())
        assert got == brute(docs, asked, 5)
