import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import chat_format, decontamination, html_extraction, language_id, near_duplicates, packing, pii, quality_rules, token_counts, toxicity
from pagemill.llm.common import chosen
from tests.conftest import SF

tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place long, score string, words string, mark string"
LONG = " ".join(f"word{i % 997}" for i in range(30_000))
ROWS = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "!!! 123"), (5, LONG), (6, "Same text here again and again for all."), (6, "Same text here again and again for all."),
    (7, "Same text here again and again for all."), (None, "no id"), (None, None), (8, "Ein kleiner Satz über Straßen.\nUnd noch einer ."), (9, "<|endoftext|> a<s> ▁x  y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, None, None, 1, "x", "y", "z") for i, t in ROWS], SCHEMA)


def operators(spark):
    filters = language_id.Filters({"en": ["the cat and the dog of the town"] * 5, "de": ["der hund und die katze"] * 5})
    tox = toxicity.train(["you idiot. fine day", "nice day here", "fine weather"] * 8, [1, 0, 0] * 8)
    model = pii.train(["a@b.de and +1 (974) 555-3436 x 12"] * 5)
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string")
    return {
        "tokens": lambda d: token_counts.count_tokens(d, tokenizers.path("piece_bpe_32k.model")),
        "near": near_duplicates.near_duplicates,
        "leaks": lambda d: decontamination.leaks(d, items),
        "toxic": lambda d: toxicity.score(d, tox),
        "pii": lambda d: pii.detect(d, model),
        "quality": quality_rules.quality,
        "language": lambda d: language_id.identify(d, filters),
        "pack": lambda d: packing.pack(d, tokenizers.path("word_bpe_49k.json")),
        "pages": lambda d: html_extraction.extract(d.withColumnsRenamed({"doc_id": "page_id", "source": "url", "text": "html"}), html_extraction.train([])),
        "chat": lambda d: chat_format.parse(d.withColumnRenamed("doc_id", "conv_id").withColumn("part", F.monotonically_increasing_id()), chat_format.Model([[("user", "hi\nyou\nthere")], [("user", "hi")]])),
    }


#: Columns, and their values of the rows with null, empty and repeated text.
ODD = {
    "tokens": (("doc_id", "n_bytes", "n_tokens", "over_limit"), [(1, 0, 0, False), (2, 0, 0, False), (6, 39, 9, False), (6, 39, 9, False)]),
    "near": (("doc_id", "class_id", "n_links"), [(1, 1, 0), (2, 2, 0), (6, 6, 2), (6, 6, 2)]),
    "toxic": (("doc_id", "predicted", "n_offending"), [(1, 0, 0), (2, 0, 0), (6, 0, 0), (6, 0, 0)]),
    "pii": (("doc_id", "n_email", "base_sha256", "spans"), [(i, 0, hashlib.sha256(b"").hexdigest(), "") for i in (1, 2, 6, 6)]),
    "quality": (("doc_id", "n_words", "base_failed", "kept"), [(1, 0, True, False), (2, 0, True, False), (6, 8, True, False), (6, 8, True, False)]),
    "language": (("doc_id", "lang_pred"), [(1, "und"), (2, "und"), (6, "en"), (6, "en")]),
}
NAMES = ["tokens", "near", "leaks", "toxic", "pii", "quality", "language", "pack", "pages", "chat"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_and_empty_tables(spark, odd, name):
    run = operators(spark)[name]
    found = run(odd).collect()
    assert run(odd.limit(0)).count() == 0
    if name == "leaks":
        assert found == []
    elif name == "pack":
        assert Counter(r["doc_id"] for r in found if r["start"] == 0) == Counter(i for i, _ in ROWS)
    elif name == "chat":
        assert Counter(r["conv_id"] for r in found if r["turn"] == 0) == Counter(i for i, _ in ROWS)
    else:
        assert len(found) == len(ROWS)
    if name in ODD:
        assert sorted(({k: r[k] for k in ODD[name][0]} for r in found if r["doc_id"] in (1, 2, 6)), key=str) == sorted((dict(zip(ODD[name][0], x)) for x in ODD[name][1]), key=str)



def test_token_counts_equal_library(spark, odd):
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \n▁\té漢\r.<s>　") for _ in range(rng.randint(0, 60))) for _ in range(300)] + [t for _, t in ROWS]
    texts += [f"{'=' * 300} a{i} {'https://example.org/' * 9}\n{'é' * 60}" for i in range(200)]  # long pre-tokens in many texts
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, path).collect()} == {i: len(own.encode(t or "")) for i, t in enumerate(texts)}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(30, 120))] for _ in range(30)]
    texts = []
    for words in base:
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 6)):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "new"
            texts.append(" ".join(copy))
    hot = [rng.choice(vocabulary) for _ in range(200)]
    texts += [" ".join(hot[:k] + [f"x{k}"] + hot[k + 1 :]) for k in range(0, 200)] + [" ".join(hot)] * 40
    sets = [set(near_duplicates.shingles(t).tolist()) for t in texts]
    links, root = [0] * len(texts), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and common >= 0.8 * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates.near_duplicates(df).collect()}
    assert {i: c for i, (c, _) in found.items()} == {i: find(i) for i in range(len(texts))}
    total = sum(links)
    assert sum(n for _, n in found.values()) >= 0.999 * total and all(found[i][1] <= links[i] for i in found)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(300 + i, 500) for i in range(90)]
    found = {r["rep"]: r["class"] for r in near_duplicates.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(found.values()) == {0, 100, 300} and len(found) == 61 + 80 + 91 and found[0] == 0


def test_near_duplicates_of_repeated_ids(spark):
    rng = random.Random(2)
    a, b, c = (" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(80)) for _ in range(3))
    rows = [("1", a), ("1", b), ("2", a + " end"), ("3", b + " end"), ("4", c), ("4", c), (None, c), ("5", None)]
    found = sorted((r["doc_id"] or "", r["class_id"], r["n_links"]) for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert found == [("", None, 0), ("1", "1", 1), ("1", "1", 1), ("2", "1", 1), ("3", "1", 1), ("4", "4", 1), ("4", "4", 1), ("5", "5", 0)]


def test_near_duplicates_at_a_lower_threshold(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(120)]
        other = list(words)
        for k in range(4):
            other[12 + 30 * k] = "x"
        texts += [" ".join(words), " ".join(other)]
        sets = [set(near_duplicates.shingles(t).tolist()) for t in texts[-2:]]
        assert 0.5 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.75
    found = near_duplicates.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), threshold=0.5).collect()
    assert all(r["n_links"] == 1 for r in found)
    with pytest.raises(ValueError):
        near_duplicates.least_depth(threshold=0.2)


def test_leaks_with_other_values(spark):
    item = "A train leaves Paris at 10 and goes 300 km to Lyon while another leaves Paris at 12 so when do they meet"
    other = item.replace("Paris", "Rome").replace("10", "7").replace("300", "450").replace("12", "9").replace("Lyon", "Milan")
    broken = item.replace("Paris", "Rome", 1).replace("10", "7").replace("Lyon", "Milan")
    clean = "A plane was seen by many people in the morning and nobody knew where it had come from or when it would go"
    docs = spark.createDataFrame([(1, f"Some words first. {other}. And then more."), (2, broken), (3, clean), (4, item.upper()), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    for limit in (decontamination.BROADCAST_WINDOWS, 0):
        found = {r["doc_id"]: r["item_id"] for r in decontamination.leaks(docs, items, broadcast_limit=limit).collect()}
        assert found.keys() & {1, 2, 3} == {1} and found[1] == 7


def test_leaks_in_other_case_with_other_names_and_units(spark):
    item = "A train leaves Paris at 10 and goes 300 km to Lyon while another leaves Paris at 12 so when do they meet"
    texts = {
        1: item, 2: item.lower(), 3: item.upper(), 4: item.title(), 5: item.replace("Paris", "New York").replace("Lyon", "Rio Grande City"),
        6: item.replace("300 km", "190 miles"), 7: item.replace("300 km", "300 hours"), 8: item.replace("leaves Paris at 12", "leaves Rome at 12"),
        9: item.replace("300 km", "300km"), 10: item.replace("km", "\ue000").replace("Paris", "\ue002x"),
    }
    rows = [(i, f"Some words first, then {t} and then more") for i, t in texts.items()] + [(11, "nothing"), (11, item), (11, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string").withColumn("start", F.lit("x")).withColumn("doc_id", F.lit(1))
    found = {r["doc_id"]: r["cover_percent"] for r in decontamination.leaks(docs.withColumn("item_id", F.lit(3)).withColumn("hash", F.lit(0)), items).collect()}
    # Hours for kilometres leave the windows before and behind it; another name in one of two places, one of the halves.
    assert {1, 2, 3, 4, 5, 6, 9, 11} <= found.keys() and all(found[i] == 100 for i in (1, 2, 3, 4, 6, 9, 11)) and found[5] >= 50
    assert found.get(7, 0) < 100 and found.get(8, 0) < 100 and found.get(10, 0) < 100


def test_leaks_don_t_add_up_over_contradicting_alignments(spark):
    item = "take the 5 red boxes from the old shelf and put the 7 blue boxes under the long table near the door"
    half = item.split(" and ")
    docs = {1: f"{half[0].replace('5', '8')} and then rest for a while and put the 7 blue boxes under it", 2: " or ".join([half[0].replace("5", "9"), half[0].replace("5", "8"), half[0].replace("5", "6")])}
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = {r["doc_id"]: r["n_windows"] for r in decontamination.leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), items).collect()}
    assert all(n <= 14 for n in found.values()) and 2 not in found


def plain_canonical(text):
    import regex

    units = "|".join(sorted((u for x in decontamination.UNIT_KINDS.values() for u in x.split()), key=lambda u: (-len(u), u)))
    if regex.search(r"\d", text):
        text = regex.sub(rf"(?<!\S)[^\s\p{{L}}\d]*(\d[\d.,]*)\s{{0,2}}({units})(?![\p{{L}}\p{{N}}])", "\ue000\\1 \ue001\\2", text, flags=regex.I)
        text = regex.sub(r"(?<!\S)[^\s\p{L}\d\ue000]*(\d[^\s\p{L}\ue001]*)(?!\S)", "\ue000\\1 ", text)
        text = regex.sub(r"(?<=\d)[^\s\p{L}\p{N}]+(?=\d)", "", text)
    text = regex.sub(r" (?=\p{Lu}\p{Ll})(?<=[\p{Ll},;] \p{Lu}\p{Ll}+ )", "\ue003", text)
    text = regex.sub("(?<=[\\p{Ll},;] )(\\p{Lu}\\p{Ll}+(?:\ue003\\p{Lu}\\p{Ll}+)*)(?![\\p{L}\\p{N}])", "\ue002\\1", text)
    return [x for x in regex.split(r"[^\p{L}\p{N}\ue000-\ue003]+", text.lower()) if x]


def plain_leaks(docs, items):
    """The definition, pair by pair and place by place."""
    kinds = {u: k for k, x in decontamination.UNIT_KINDS.items() for u in x.split()}
    typed = lambda v: ["\ue001" + kinds[x[1:]] if x[0] == "\ue001" else x[0] if x[0] in "\ue000\ue002" else x for x in v]
    bare = lambda v: [w for x in v for w in x.lstrip("\ue000\ue001\ue002").split("\ue003")]
    right = lambda p: len(set(p)) == len({a for a, _ in p}) == len({b for _, b in p})
    out = {}
    for d, doc in docs.items():
        dv = plain_canonical(doc)
        dt, dr = typed(dv), bare(dv)
        for i, item in items.items():
            iv = plain_canonical(item)
            it, ir = typed(iv), bare(iv)
            found = []
            k = min(8, len(ir))
            places = {a for a in range(len(ir) - k + 1) for b in range(len(dr) - k + 1) if ir[a : a + k] == dr[b : b + k]}
            found.append((len(places), len(ir)))
            k = min(8, len(it))
            starts = range(len(it) - k + 1)
            literals = [sum(x[0] not in "\ue000\ue001\ue002" for x in it[a : a + k]) for a in starts]
            good = [n >= 4 or n == len(it) or len(it) < 8 and n >= 3 for n in literals]
            anchor = literals.index(max(literals)) if len(it) >= 8 and 1 <= max(literals) <= 3 else None
            runs = []
            for shift in range(-len(it), len(dt) + 1):
                fits = lambda a: 0 <= a + shift and dt[a + shift : a + shift + k] == it[a : a + k]  # noqa: B023, E731
                sure = [a for a in starts if good[a] and fits(a) or len(it) < 8 and not good[a] and literals[a] != len(it) and fits(a) and len(dt) == len(it)]
                if not sure and not (anchor is not None and fits(anchor)):
                    continue
                at = lambda x: dv[x + shift] if 0 <= x + shift < len(dv) else None  # noqa: B023, E731
                equal = [at(x) is not None and (dt[x + shift] == it[x] or at(x).lstrip("\ue000\ue001\ue002") == iv[x].lstrip("\ue000\ue001\ue002")) for x in range(len(it))]
                full = sorted({*sure, *(a for a in range(max(1, len(it) - 7)) if (sure or all(equal)) and all(equal[a : a + 8]))})
                pairs = lambda s: [(iv[x], at(x)) for x in sorted({a + j for a in s for j in range(k)}) if iv[x][0] in "\ue000\ue001\ue002"]  # noqa: B023, E731
                chosen = full if right(pairs(full)) else sure if right(pairs(sure)) else []
                if chosen:
                    runs.append((len(chosen), -shift, chosen, pairs(chosen)))
            if runs and not right([p for r in runs for p in r[3]]):
                runs = [max(runs)]
            found.append((len({a for r in runs for a in r[2]}), len(it)))
            cover = max((round(100 * n / max(1, total - 7), 3) for n, total in found if 100 * n / max(1, total - 7) >= 50 or n >= 12), default=None)
            if cover is not None:
                out[d, i] = cover
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(12)
    word = lambda: rng.choice("the a box red train goes far when then it was over under long old door of time".split())
    name, number = lambda: rng.choice(["Anna", "Paris", "New York", "Karl"]), lambda: str(rng.randint(1, 30))
    unit = lambda: f"{number()} {rng.choice(['km', 'kg', 'hours', 'miles'])}"
    say = lambda n, share: " ".join(word() if rng.random() > share else rng.choice((name, number, unit))() for _ in range(n))
    items = {i: say(rng.choice((1, 2, 4, 6, 9, 14, 25)), rng.choice((0, 0.2, 0.5, 0.9))) for i in range(40)}
    docs = {}
    for d in range(240):
        text = items[rng.randrange(40)].split()
        for _ in range(rng.choice((0, 0, 1, 2, 4))):
            at = rng.randrange(len(text))
            text[at] = rng.choice((word(), number(), text[at].upper(), text[at].title(), "Karl"))
        if rng.random() < 0.2:
            text = [x.upper() for x in text]
        if rng.random() < 0.3:
            text = text[len(text) // 2 :]
        docs[d] = " ".join([say(rng.randint(0, 12), 0.2), *text, say(rng.randint(0, 12), 0.2), *(items[rng.randrange(40)].split() if rng.random() < 0.3 else [])])
    tables = [spark.createDataFrame(list(x.items()), f"{k} long, text string") for x, k in ((docs, "doc_id"), (items, "item_id"))]
    wanted = plain_leaks(docs, items)
    for limit in (decontamination.BROADCAST_WINDOWS, 0):
        found = {(r["doc_id"], r["item_id"]): r["cover_percent"] for r in decontamination.leaks(*tables, broadcast_limit=limit).collect()}
        assert found == wanted and len(wanted) > 100


def test_leaks_in_texts_with_very_long_lists_of_names(spark):
    item = "who was the first person that walked over the old red bridge of the town"
    names = " ".join(("Beta", "Alpha")[i % 2] for i in range(20_000))
    docs = spark.createDataFrame([(1, f"these are {names} and then {item} again"), (2, f"these are {names}X and no more")], "doc_id long, text string")
    found = decontamination.leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["cover_percent"]) for r in found] == [(1, 7, 100.0)]
    for r in docs.select("text", decontamination.canonical(F.col("text")).alias("v")).collect():
        assert r["v"] == plain_canonical(r["text"]) and r["v"][2].count("\ue003") == 19_999


def test_leaks_of_items_dense_in_values(spark):
    items = {
        1: "12 15 18 21 24 27 30 33 36 39 42 45",
        2: "Compute 12 + 34 + 56 + 78 + 90 + 11 + 13 + 15 + 17",
        3: "in the class are Anna Bert Carl Dora Emil Fritz Gerd Hans Ida Jana Karl Lisa Mona Nina",
        4: "Given the following numbers add 3 5 7 9 11 13 15 17 19 21 23",
    }
    other = {
        2: "Compute 22 + 44 + 66 + 88 + 99 + 10 + 14 + 16 + 18", 3: "in the class are Otto Paul Rosa Sven Tina Udo Vera Willi Xenia Yvonne Zora Max Tom Kim",
        4: "Given the following numbers add 4 6 8 10 12 14 16 18 20 22 24", 5: "Measured were 1 2 3 4 5 6 7 8 9 10 11 12 13 14", 6: "Compute 22 + 44 + 22 + 88 + 99 + 10 + 14 + 16 + 18",
    }
    texts = {i: f"Some words first. {t} and then more" for i, t in items.items()} | {10 + i: f"Some words first. {t} and then more" for i, t in other.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for limit in (decontamination.BROADCAST_WINDOWS, 0):
        found = {(r["doc_id"], r["item_id"]): r["cover_percent"] for r in decontamination.leaks(docs, table, broadcast_limit=limit).collect()}
        assert found.keys() == {(1, 1), (2, 2), (3, 3), (4, 4), (12, 2), (13, 3), (14, 4)} and all(c <= 100 for c in found.values())


def test_leaks_of_short_items_within_documents(spark):
    items = {1: "What is the capital of France", 2: "what is 12 plus 30", 3: "in 2020", 4: "photosynthesis", 5: "7 8 9", 6: "name the largest planet"}
    texts = {
        1: "Some words first. What is the capital of France? And then more words.", 2: "Some words first. what is 12 plus 30 and then more", 12: "Some words first. what is 7 plus 9 and then more",
        3: "it was in 2020 that all of this was seen", 13: "it was in 2021 that all of this was seen", 23: "in 1999", 4: "plants live by photosynthesis and by water and light", 5: "the row has 7 8 9 in it and ends", 15: "the row has 1 2 3 in it and ends",
        6: "name the largest planet", 7: "name the planet that is largest",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for limit in (decontamination.BROADCAST_WINDOWS, 0):
        found = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, table, broadcast_limit=limit).collect()}
        assert found == {(1, 1), (2, 2), (12, 2), (3, 3), (23, 3), (4, 4), (5, 5), (6, 6)}


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").filter("held_out").select("toxic", "predicted", "score").collect()
    assert all(0 <= r["score"] <= 1 for r in found)
    assert np.mean([r["predicted"] for r in found if r["toxic"]]) >= 0.7 and np.mean([r["predicted"] for r in found if not r["toxic"]]) <= 0.03


def test_toxicity_is_the_noisy_or_of_sentences():
    model = toxicity.train(["you idiot. fine day", "nice day here", "fine weather"] * 40, [1, 0, 0] * 40)
    once, p = model.score("nice day. you idiot! fine")
    assert once == pytest.approx(1 - np.prod([1 - x for _, _, x in p])) and [x[2] for x in p].index(max(x[2] for x in p)) == 1
    assert once > 0.7 > model.score("nice " * 500 + "day " * 500)[0] and model.score("nice. day. here. fine weather. " * 300)[0] < 0.7
    assert model.score("idiot idiot idiot")[0] == model.score("idiot")[0] == model.score("idiot. Idiot!")[0]


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    found = language_id.identify(docs, language_id.fit(docs)).join(docs, "doc_id").filter("held_out").select("lang", "lang_pred").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.97


def related_languages(n):
    """Texts of n languages that share nine tenths of their words."""
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    common = [word() for _ in range(45)]
    texts = {}
    for i in range(n):
        words = common + [word() for _ in range(5)]
        texts[f"l{i:02}"] = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(12)]
    return texts


def test_language_stage_keeps_documents_of_related_languages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(t, x) for x, texts in related_languages(6).items() for t in texts]
    docs = spark.createDataFrame([(i, t, x, "s", len(t)) for i, (t, x) in enumerate(rows)] + [(999, "123 456", "l00", "s", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, SF).collect()}
    assert kept == set(range(len(rows)))


def test_more_languages_than_bits_of_a_word(spark):
    rng = random.Random(70)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    rows = []
    for i in range(70):
        words = [word() for _ in range(20)]
        rows += [(" ".join(rng.choice(words) for _ in range(60)), f"l{i:02}") for _ in range(9)]
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    assert found == {i: x for i, (_, x) in enumerate(rows)}


BASE_PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_base_spans(text):
    out = []
    for k, pattern in enumerate(BASE_PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            if (True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), luhn and 14 <= len(digits) <= 19, 10 <= len(digits) <= 15)[k]:
                out.append((k, *m.span()))
    return sorted(out, key=lambda x: (x[1], x[0]))


def test_pii_base_equals_plain_expressions():
    text = "Mail a.b@c-d.org, x@y z@w.q@e.f; ip 10.0.0.256 1.2.3.4.5; card 4111 1111 1111 1111 or 4111-1111-1111-1112; +1 (974) 555-3436."
    assert Counter(k for k, _, _ in pii.base_spans(text)) == {0: 2, 1: 1, 2: 1, 3: 1}
    rng = random.Random(1)
    for alphabet in ("a.@-+ 1", "0123456789.", "0123456789 -", "+0123456789 ().-", "12. @a+"):
        for _ in range(1500):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50)))
            assert pii.base_spans(t) == plain_base_spans(t), t


def personal_texts(n):
    """Texts with a mention of each kind, and its values."""
    rng = random.Random(n)
    fill = lambda k: " ".join(rng.choice(("some", "words", "that", "say", "nothing", "stand", "here")) for _ in range(k))
    out = []
    for _ in range(n):
        digits = [rng.randrange(10) for _ in range(15)]
        last = -sum(sum(divmod(2 * d, 10)) if i % 2 == 0 else d for i, d in enumerate(reversed(digits))) % 10
        values = [
            f"{rng.choice(('ann', 'bob', 'cid'))}.{rng.randint(1, 99)}@mail{rng.randrange(10)}.example.com", ".".join(str(rng.randrange(256)) for _ in range(4)),
            "".join(map(str, [*digits, last])), f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
        ]
        rng.shuffle(values)
        out.append((f"{fill(6)} " + " ".join(f"{v} {fill(8)}" for v in values) + f" in room {rng.randint(1, 99)} of 2019", values))
    return out


def test_pii_adds_linked_mentions():
    rows = personal_texts(200)
    model = pii.train([t for t, _ in rows[:150]])
    wanted = found = wrong = 0
    for (text, values), (_, others) in zip(rows[150:], rows[:50]):
        again = [next(v for v in values if v[0] == "+").split(None, 1)[1], next(v for v in values if "@" in v).rsplit(".", 2)[0], next(v for v in values if v.count(".") == 3 and "@" not in v).replace(".", "-")]
        alien = [next(v for v in others if v[0] == "+").split(None, 1)[1]]
        text += " and far behind" + " that say nothing" * 40 + "".join(f" {v} is here" for v in (*again, *alien))
        (base,), (spans,) = pii.find([text], model)
        assert set(base) <= set(spans) and base == plain_base_spans(text)
        added = {text[a:b] for k, a, b in spans if (k, a, b) not in base}
        wanted, found, wrong = wanted + len(again), found + len(added & set(again)), wrong + len(added - set(again))
    assert found >= 0.9 * wanted and wrong <= 0.03 * wanted
    # pieces of a number elsewhere: area codes, years, groups of a card's digits
    for text in ("Call +1 (974) 555-3436. Room 974 is on floor 3.", "Call +1 (974) 555-3436 now, it has 974 pages and 555 pictures.", "Pay with 4539 1488 0343 6467 in 1488, or 0343 by post.", "Ring +44 2023 456 789 in 2023."):
        (base,), (spans,) = pii.find([text], model)
        assert spans == base and len(base) == 1, text
    (base,), (spans,) = pii.find(["Call +1 (974) 555-3436. That is (974) 555-3436 at night."], model)
    assert len(spans) == 2


def test_pii_query_columns(spark):
    rows = [(i, t) for i, (t, _) in enumerate(personal_texts(40))] + [(None, "x 1.2.3.4"), (None, "x 1.2.3.4"), (50, "1" * 300_000 + " a" * 5), (51, "a" * 1_000_000), (52, "@a" * 100_000), (53, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = Counter((i, t) for i, t in rows)
    model = pii.fit(df)
    found = pii.detect(df.withColumn("spans", F.lit("x")), model).collect()
    assert len(found) == len(rows)
    by_id = {i: t for i, t in texts}
    for r in found:
        spans = plain_base_spans(by_id[r["doc_id"]]) if (r["doc_id"] or 0) < 50 else []  # the long ones hold nothing
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x for k, _, _ in spans) for x in range(4)]
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest() and set(said.split(",")) <= {*r["spans"].split(","), ""}


def test_fit_samples_are_bounded_whatever_the_ids(spark):
    rows = [(None, "a 1")] * 3000 + [(7, "b 2")] * 3000 + [(i, f"c {i}") for i in range(100, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    texts = [r["text"] for r in chosen(df, "doc_id", F.lit(1.0), "text").collect()]
    assert len(texts) == 301 and texts.count("b 2") == 1 and "a 1" not in texts
    assert len(chosen(df, "doc_id", F.lit(0.1), "text").collect()) < 60


def test_quality_keeps_other_scripts(spark):
    hindi = "यह एक लंबा वाक्य है जो नदी के बारे में कुछ {} बताता है।"
    arabic = "هل تعرف هذه المدينة القديمة التي تقع قرب النهر الكبير رقم {}؟"
    urdu = "یہ ایک لمبا جملہ ہے جو دریا کے بارے میں کچھ {} بتاتا ہے۔"
    mixed = "这 是 一 个 关 于 河 流 的 长 句 子 {}。"
    df = spark.createDataFrame([(k, "\n".join(t.format(i) for i in range(12))) for k, t in enumerate((hindi, arabic, urdu, mixed))], "doc_id long, text string")
    found = quality_rules.quality(df).collect()
    assert all(r["kept_chars"] == r["line_chars"] for r in found) and sum(r["kept"] for r in found) == 4 - sum(r["base_failed"] for r in found)


def test_quality_equals_brute_force(spark):
    rng = random.Random(9)
    texts = ["\n".join(" ".join(rng.choice(["a", "b", "cc", "d.", "é#"]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 12))) for _ in range(120)] + [LONG]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.quality(df).collect():
        t = texts[r["doc_id"]]
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", t) if w]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        count = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(words), sum(map(len, words)), len(covered), len(lines) - len(set(lines)))
        assert r["n_symbols"] == sum(t.count(c) for c in "#*$%&|<>") and r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_quality_cleaned_text(spark):
    lines = ["This is a good line of some words.", "Home | News | Sport | About us | More", "This is a good line of some words.", "All rights reserved by them.", "Short one", "#### $$$$ ||||", "So is this!"]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, None)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in quality_rules.quality(df, cleaned=True).collect()}
    assert found[1]["cleaned"] == "\n".join([lines[0], lines[4], lines[6]]) and found[2]["cleaned"] == "" and found[1]["kept_chars"] == sum(len(lines[i]) for i in (0, 4, 6))


def test_packing_round_trip(spark, odd):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10**9 + i, t) for i, (_, t) in enumerate(ROWS)], "doc_id long, text string"))
    ids = {r["doc_id"]: np.array([*own.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4") for r in docs.collect()}
    at, sequences = {}, {}
    for r in packing.pack(docs, path).orderBy("doc_id", "start").collect():
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert at.get(r["doc_id"], 0) == r["start"] and zlib.crc32(piece.tobytes()) == r["ids_crc32"] and len(ids[r["doc_id"]]) == r["doc_tokens"]
        at[r["doc_id"]] = r["start"] + r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(at[i] == len(x) for i, x in ids.items())
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 4096 and (end & (end - 1)) == 0


def test_packing_ids_equal_library():
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    own, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    rng = random.Random(4)
    signs = [*"aBz09 '.,!\n\téÉ\u0338\u0301<>|…“\xa0\u3000\x1c\x02\x85你×ßΣİ", "'s", "'LL", "don't", "<|endoftext|>", "12.5", "½", "\U0001f600", "K", "Å"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["é" * 50_000, "x " * 30_000 + "<|startoftext|> y", "ab" * 40_000]
    wanted = [[*x.ids, 2] for x in own.encode_batch(texts, add_special_tokens=False)]
    for segment, cache in ((packing.SEGMENT, packing.CACHE), (100, 300)):  # the second cuts long texts and drops pieces
        packing.SEGMENT, kept = segment, (packing.SEGMENT, packing.CACHE)
        packing.CACHE = cache
        try:
            for start in range(0, len(texts), 500):
                ids, ends = encoder.encode([t.encode() for t in texts[start : start + 500]])
                assert [x.tolist() for x in np.split(ids, ends[:-1])] == wanted[start : start + 500]
        finally:
            packing.SEGMENT, packing.CACHE = kept


def test_hilbert_curve():
    n = 4
    points = np.stack(np.meshgrid(*[np.arange(1 << n)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    at = packing.hilbert(points, n)
    assert sorted(at.tolist()) == list(range(1 << 3 * n))  # one place each
    walk = points[np.argsort(at)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()  # in steps of one


def test_packing_neighbours_and_padding(spark):
    rng = random.Random(8)
    topics = [[f"{a}{b}" for b in ("one", "two", "red", "tree", "water", "light")] for a in ("north", "market", "violin", "glacier")]
    texts = [" ".join(rng.choice(topics[i % 4]) for _ in range(60)) for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack(df, tokenizers.path("word_bpe_49k.json"), length=512).orderBy("sequence_id", "offset").collect()
    of_sequence, filled = {}, Counter()
    for r in rows:
        of_sequence.setdefault(r["sequence_id"], []).append(r["doc_id"] % 4)
        filled[r["sequence_id"]] += r["length"]
    same = np.mean([a == b for x in of_sequence.values() for a, b in zip(x, x[1:])])
    assert same > 0.9  # a quarter by chance
    assert all(n & (n - 1) == 0 and n <= 512 for n in filled.values())  # no sequence is padded


def test_html_held_out_layouts():
    model = html_extraction.fit()
    pages = html_extraction.labelled_pages(60, 77)
    assert np.mean([html_extraction.main_text(p, model) == t for p, t in pages]) > 0.9
    page = "<body><nav><a href=x>Menu</a></nav><article><h1>T &amp; é</h1><p>One\n two<br>three. <b>Bold</b> text here.<p>Next &lt;b&gt; one is 3 < 5 so.</article><footer>&copy; x</footer>"
    assert html_extraction.main_text(page, model) == "T & é\nOne two three. Bold text here.\nNext <b> one is 3 < 5 so."


def chat_model(spark):
    turns = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/conversations.parquet")
    return turns, chat_format.fit(chat_format.written(turns))


def canonical(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["part"], r["turn"])):
        out[r["conv_id"]] = out.get(r["conv_id"], "") + r["rendered"]
    return out


def test_html_other_pages():
    model = html_extraction.fit()
    page = "<article><h1>T here is</h1><p>Let <math>x=2</math> be given, <svg><text>label</text></svg> and <object>fallback words</object> too.</p><noscript><p>Without scripts too it is.</p></noscript><form><p>Your name here</p></form></article>"
    assert html_extraction.main_text(page, model) == "T here is\nLet x=2 be given, label and fallback words too.\nWithout scripts too it is."
    page = """<html><body class="home page"><div id="masthead" role="banner"><div class="logo">Site</div></div><div role="navigation" class="nav-menu"><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div>
    <div id="content"><div class="entry-content post"><h2>A day at the river</h2><p>We went to the river in the morning. It was cold there.</p><p>Then the sun came out, and all of us stayed until night.</p></div>
    <div id="comments" class="comments"><h3>2 comments</h3><p>Great text, thanks for it!</p></div></div><div class="sidebar widget"><p>Read other texts.</p></div><div id="footer" class="site-footer">© 2020 Site</div></body></html>"""
    assert html_extraction.main_text(page, model) == "A day at the river\nWe went to the river in the morning. It was cold there.\nThen the sun came out, and all of us stayed until night."
    for deep in ("<article>" + "".join(f"<div class=c{k}>y " for k in range(20_000)) + "</b>" * 20_000, "<p>" + "<i>" * 50_000 + "x" + "</i>" * 50_000):
        start = time.time()
        html_extraction.main_text(deep, model)
        assert time.time() - start < 5


def test_html_field_equals_enumeration():
    rng = random.Random(3)
    for n in (1, 2, 5, 8):
        z, pairs = [rng.gauss(0, 2) for _ in range(n)], [[rng.gauss(0, 2) for _ in range(2)] for _ in range(2)]
        score = {y: sum(a * b for a, b in zip(z, y)) + sum(pairs[a][b] for a, b in zip(y, y[1:])) for y in itertools.product((0, 1), repeat=n)}
        total = np.logaddexp.reduce(list(score.values()))
        main, both, log_sum = html_extraction.marginals(z, pairs)
        assert log_sum == pytest.approx(total) and main == pytest.approx([sum(np.exp(s - total) for y, s in score.items() if y[i]) for i in range(n)])
        assert sum(map(sum, both)) == pytest.approx(n - 1) and both[1][0] == pytest.approx(sum(np.exp(s - total) * sum(x == (1, 0) for x in zip(y, y[1:])) for y, s in score.items()))
        model = html_extraction.Model(np.zeros(1), np.array(pairs))
        model.scores = lambda items: items
        assert tuple(model.decode(z)) == max(score, key=score.get)


def test_chat_roles_and_boundaries_of_logs(spark):
    turns, model = chat_model(spark)
    given = {}
    for r in sorted(turns.collect(), key=lambda r: (r["conv_id"], r["turn"])):
        given[r["conv_id"]] = given.get(r["conv_id"], "") + f"<|im_start|>{r['role']}\n{r['text']}<|im_end|>\n"
    for missing, least in ((0, 0.98), (20, 0.6)):
        logs = chat_format.written(turns, unmarked_percent=missing)
        found = canonical(chat_format.parse(chat_format.transcripts(logs), model).collect())
        assert found.keys() == given.keys()
        assert np.mean([found[k] == given[k] for k in given]) > least
        said = lambda x: [line for line in x.split("\n") if line and not line.startswith("<|im_")]
        kept = [[line.replace("<|im_end|>", "") for line in said(x[k])] for x in (found, given) for k in given]
        assert missing or kept[: len(given)] == kept[len(given) :]
        lines = sum(map(len, kept[len(given) :]))
        assert abs(sum(map(len, kept[: len(given)])) - lines) <= 0.01 * lines  # no line is lost


def test_chat_parts_are_decoded_as_one(spark):
    turns, model = chat_model(spark)
    rows = turns.orderBy("conv_id", "turn").limit(800).collect()
    messages = [(k % 3, k, ("User: ", "Assistant: ", "Note: ", "")[k * 7 % 4] + r["text"]) for k, r in enumerate(rows)] + [(7, 0, "User: hi"), (None, 1, "User: a"), (None, 1, "User: b"), (8, None, None), (9, 5, "x"), (9, 5, "x")]
    df = spark.createDataFrame(messages, "conv_id long, turn long, text string")
    parts = chat_format.transcripts(df).collect()
    assert max(sum(r["conv_id"] == c for r in parts) for c in range(3)) > 2 and sum(r["conv_id"] is None for r in parts) == 2
    found = chat_format.parse(spark.createDataFrame(parts, "conv_id long, part long, text string"), model).collect()
    for conv in (0, 1, 2, 7, 8, 9):
        own = sorted((r["part"], r["text"]) for r in parts if r["conv_id"] == conv)
        assert "\n".join(t for _, t in own) == "\n".join(t or "" for c, k, t in messages if c == conv)
        labels = model.decode(chat_format.observe("\n".join(t for _, t in own)))
        wanted = [chat_format.ROLES[r] for r, starts in labels if starts]
        assert [r["role"] for r in sorted(found, key=lambda r: (r["part"], r["turn"])) if r["conv_id"] == conv and r["opens"]] == wanted
        text = canonical([r for r in found if r["conv_id"] == conv])[conv]
        assert text.count("<|im_start|>") == text.count("<|im_end|>") == len(wanted)


@pytest.mark.parametrize("block", [2, 7, 64])
def test_chat_parts_have_the_whole_transcripts_style(spark, monkeypatch, block):
    """Markers on half of the user turns, on assistant turns only at first, other styles between, blank lines at parts' ends."""
    _, model = chat_model(spark)
    monkeypatch.setattr(chat_format, "BLOCK", block)
    rng = random.Random(block)
    rows = []
    for conv in range(8):
        user, assistant = rng.choice([("User: ", "Assistant: "), ("Q: ", "A: "), ("[USER] ", "[BOT] ")])
        step = 1 if conv % 2 else 1000  # turn numbers as times
        for k in range(150):
            head = (user if rng.random() < 0.5 else "") if k % 2 == 0 else assistant if k < 20 else rng.choice(["", "", "Note: ", "Human: "])
            body = rng.choice(["yes", "what is this?", "a line\nand another one\n", "Fine. " * rng.randint(1, 30), "\n"])
            rows.append((conv, k * step, head + body))
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    found = sorted(chat_format.parse(chat_format.transcripts(df), model).collect(), key=lambda r: (r["conv_id"], r["part"], r["turn"]))
    for conv in range(8):
        whole = "\n".join(t for c, _, t in rows if c == conv)
        wanted = "".join(chat_format.rendered(r, t) for r, _, _, t in chat_format.turns_of(whole, model))
        got = "".join(r["rendered"] for r in found if r["conv_id"] == conv)
        trim = lambda x: re.sub(r"(<\|im_start\|>\w+)\n+", r"\1\n", re.sub(r"\n+<\|im_end", "<|im_end", x))  # noqa: E731 - line feeds around a turn
        assert trim(got) == trim(wanted)


def test_chat_decoding_equals_enumeration(spark):
    _, model = chat_model(spark)
    rng = random.Random(5)
    for _ in range(30):
        text = "\n".join(rng.choice(["User: a?", "Assistant: b", "", "plain words here", "Note: x", "System: y"]) for _ in range(rng.randint(1, 6)))
        observed = chat_format.observe(text)
        best = None
        for roles in itertools.product(range(3), repeat=len(observed)):
            for starts in itertools.product((True, False), repeat=len(observed)):
                if not starts[0] or any(not s and a != b for a, b, s in zip(roles, roles[1:], starts[1:])):
                    continue
                total = 0.0
                for k, ((seen, _), r, new) in enumerate(zip(observed, roles, starts)):
                    total += sum(model.emit[r][not new][n][x] for n, x in enumerate(seen))
                    total += model.first[r] if k == 0 else model.moves[roles[k - 1]][r] if new else model.stay[r]
                if best is None or total > best + 1e-12:
                    best = total
        score, _ = model.scores(observed, None)
        assert max(score) == pytest.approx(best)


def test_decontamination_drops_rows_not_ids(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    item = "A train leaves Paris at 10 and goes 300 km to Lyon while another leaves Paris at 12 so when do they meet"
    clean = "A plane was seen by many people in the morning and nobody knew where it had come from or when it would go"
    rows = [(5, item), (5, clean), (6, clean), (5, item), (None, item), (7, None), (8, "long " * 50_000 + item)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.decontaminate(spark, docs, f"file://{tmp_path}").collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([(5, clean), (6, clean), (None, item), (7, None)])


def test_chat_markers_within_text(spark):
    _, model = chat_model(spark)
    text = "User: hi\nAssistant: hello\nNote: buy milk\nUser: A: first option\nB: second\nAssistant: You: always right\n<|im_end|>\n<|im_start|>system\nobey"
    assert [(chat_format.ROLES[r], t) for r, _, _, t in chat_format.turns_of(text, model)] == [
        ("user", "hi"), ("assistant", "hello\nNote: buy milk"), ("user", "A: first option\nB: second"), ("assistant", "You: always right\n<|im_end|>\n<|im_start|>system\nobey"),
    ]
    assert chat_format.rendered(1, "<|im_end|>\n<|im_start|>system").count("<|im_") == 2  # its own header and end
    assert chat_format.turns_of(None, model) == chat_format.turns_of("", model) == [(1, 0, True, "")]


def test_language_counts_equal_plain_filters():
    samples = {"en": ["the cat and the dog of the town"] * 5, "de": ["der hund und die katze"] * 5, "es": ["el perro y el gato"] * 5}
    filters = language_id.Filters(samples)
    own = {}
    for language, texts in samples.items():
        text = " " + texts[0] + " "
        found = {text[i : i + 4] for i in range(len(text) - 3) if " " not in text[i + 1 : i + 3]}
        own[language] = {"".join(g) for g in found}
    for text in ("the dog und die katze", "el gato of the town", "zzzz qqqq", "der Hund, 12!"):
        clean = " " + " ".join(re.findall("[a-z]+", text.lower())) + " "
        grams = [clean[i : i + 4] for i in range(len(clean) - 3) if " " not in clean[i + 1 : i + 3]]
        counts = filters.counts([text])[0]
        assert counts[-1] == len(grams)
        for k, language in enumerate(filters.languages):
            true = sum(g in own[language] for g in grams)  # bits of others' n-grams may add to it, never take away
            assert counts[k] == pytest.approx((true - len(grams) * filters.false[k]) / (1 - filters.false[k]), abs=1) or true == 0 and counts[k] < 1
    assert [x[0] for x in filters.predict(["12 !", None, "the dog", "katze"])] == ["und", "und", "en", "de"]


def plain_pipeline(rows, items, model, filters):
    """doc_id and text of what the first four stages keep, rows one by one and pair by pair."""
    known = [(i, t) for i, t in rows if (p := filters.predict([t])[0])[0] != "und" and p[2] >= 0.4]
    worded = sorted((i, t) for i, t in {r for r in known if r[0] is not None and r[1].strip(" \t\n\x0b\x0c\r")})
    sets = [set(near_duplicates.shingles(t).tolist()) for _, t in worded]
    root = list(range(len(worded)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    owners = {}
    for k, s in enumerate(sets):
        shared = Counter(j for g in s for j in owners.get(g, ()))
        for j, common in shared.items():
            if common >= 0.8 * (len(s) + len(sets[j]) - common) - 1e-9:
                a, b = find(k), find(j)
                root[max(a, b)] = min(a, b)
        for g in s:
            owners.setdefault(g, []).append(k)
    kept = [r for r in known if r not in set(worded)] + [worded[k] for k in range(len(worded)) if find(k) == k]
    leaked = {d for d, _ in plain_leaks({k: t for k, (i, t) in enumerate(kept) if i is not None}, items)}
    kept = [r for k, r in enumerate(kept) if k not in leaked]
    return Counter((i, pii.mask(t, pii.find([t], model)[1][0])) for i, t in kept)


def test_pipeline_equals_brute_force(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    table = spark.read.parquet(f"{SF}/documents.parquet")
    given = [tuple(r) for r in table.collect()]
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(12).collect()}
    base = given[3][1]
    rows = given + [given[5], given[5]]  # repeated rows
    rows += [(10**6 + k, t, "en", "s", 5) for k, t in enumerate([None, "", " ", "123", base, base + " And one more word.", *(f"{base[:60]} {t} {base[60:90]}" for t in items.values())])]
    rows += [(None, base, "en", "s", 5), (None, base, "en", "s", 5), (given[7][0], base[: len(base) // 2], "en", "s", 5)]
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, table.schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    filters, model = language_id.fit(docs), None
    for name, stage in corpus_pipeline.STAGES[:4]:
        model = pii.fit(docs) if name == "personal_data" else None
        before, docs = docs, stage(spark, docs, folder)
        assert docs.columns == before.columns == table.columns, name
    wanted = plain_pipeline([r[:2] for r in rows], items, model, filters)
    found = docs.collect()
    assert Counter((r["doc_id"], r["text"]) for r in found) == wanted
    assert all(r["n_chars"] == len(r["text"]) for r in found) and len(found) > 100
    packed = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == Counter(i for i, _ in wanted.elements())
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
