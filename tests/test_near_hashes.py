import random

import pytest

from pagemill.operators import dedup, hamming


def rows_of(rng, n, classes=2):
    """Hashes of which many lie near each other, some equal, some null."""
    centres = [rng.getrandbits(64) for _ in range(max(1, n // 12))]
    out = []
    for i in range(n):
        h = rng.choice(centres)
        for b in rng.sample(range(64), rng.choice([0, 0, 2, 4, 7, 9, 15])):
            h ^= 1 << b
        out.append((rng.choice(["a", "b", None][: classes + 1]), i, (h ^ (1 << 63)) - (1 << 63)))
    return out


def distance(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


@pytest.mark.parametrize("limit", [0, 3, 8, 20])
def test_pairs_equal_brute_force(spark, limit):
    rows = rows_of(random.Random(limit), 250)
    df = spark.createDataFrame([*rows, ("a", None, 5), ("a", 999, None)], "cls string, id long, hash long")
    want = sorted((str(c), i, j, distance(h, g)) for c, i, h in rows for d, j, g in rows if i < j and c == d and distance(h, g) <= limit)
    plans = [None, hamming.bands_of(limit, 4), hamming.bands_of(limit, 7)] if limit == 8 else [None]
    for bands in plans:
        assert sorted((str(r["cls"]), r["a"], r["b"], r["distance"]) for r in dedup.near_pairs(df, limit, bands).collect()) == want
    assert dedup.near_pairs(df.limit(0), limit).count() == 0


def test_bands_hold_every_near_pair():
    for limit in range(0, 24):
        for n in range(2, 17):
            bands = hamming.bands_of(limit, n)
            assert sum(b.radius + 1 for b in bands) >= limit + 1 and all(b.radius <= b.width for b in bands)
    assert len({m for m in hamming.Band(0, 16, 2).masks()}) == hamming.Band(0, 16, 2).probes == 137


def test_candidates_are_few(spark):
    rng = random.Random(2)
    n = 6000
    hashes = spark.createDataFrame([("=x", rng.getrandbits(63)) for _ in range(n)], "k string, hash long")
    assert hamming.met(hashes, hamming.plan(8, n)).count() < n * n / 200
    few = hashes.limit(1500)
    assert hamming.met(few, hamming.bands_of(20, 5)).count() < 0.4 * 1500 * 1500


@pytest.mark.parametrize("limit", [0, 8, 20, 64])
def test_blocks_equal_brute_force(spark, limit):
    hashes = sorted({(f"={c}", h) for c, _, h in rows_of(random.Random(limit), 250)} | {("=one", 5)})
    df = spark.createDataFrame(hashes, "k string, hash long")
    want = sorted((c, h, g, distance(h, g)) for c, h in hashes for d, g in hashes if c == d and h < g and distance(h, g) <= limit)
    for block in (7, 50, hamming.BLOCK):
        found = hamming.compared(df, df.groupBy("k").count(), limit, 3, block)
        assert sorted(map(tuple, found.collect())) == want


def test_far_limits_send_no_candidates(spark):
    rng = random.Random(3)
    n = 3000
    hashes = spark.createDataFrame([("=x", rng.getrandbits(63)) for _ in range(n)], "k string, hash long")
    # two fifths of all pairs were rows of a join; now a block is sent once for each block
    plan = hamming.near(hashes, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "bits" not in plan
    pairs = hamming.dealt(hashes, hashes.groupBy("k").count(), 4, 500).collect()
    assert len(pairs) == 21 and sum(len(r["left"]) + len(r["right"] or ()) for r in pairs) == 6 * n


def greedy(rows, limit):
    kept, out = {}, []
    for c, i, h in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0)):
        near = any(distance(h, g) <= limit for g in kept.get(c, ()))
        if not near:
            kept.setdefault(c, []).append(h)
        out.append((str(c), str(i), not near))
    return sorted(out)


@pytest.mark.parametrize("limit, most", [(8, 200_000), (8, 0), (20, 200_000), (20, 40)])
def test_greedy_keep_equals_one_by_one(spark, limit, most):
    rows = rows_of(random.Random(limit + most), 200)
    df = spark.createDataFrame(rows, "cls string, id long, hash long")
    assert sorted((str(r["cls"]), str(r["id"]), r["kept"]) for r in dedup.greedy_keep(df, limit, most).collect()) == greedy(rows, limit)


def test_greedy_keep_keeps_every_row(spark):
    rows = [("a", 1, 0), ("a", 1, 0), ("a", None, 0), ("a", None, 2**40 - 1), (None, 5, 1), (None, 6, 1), ("a", 7, None), (None, None, None)]
    found = dedup.greedy_keep(spark.createDataFrame(rows, "cls string, id long, hash long"), 8).collect()
    got = sorted((str(r["cls"]), str(r["id"]), str(r["hash"]), r["kept"]) for r in found)
    assert got == sorted([("a", "1", "0", True), ("a", "1", "0", False), ("a", "None", "0", False), ("a", "None", str(2**40 - 1), True), ("None", "5", "1", True), ("None", "6", "1", False), ("a", "7", "None", True), ("None", "None", "None", True)])
    assert dedup.greedy_keep(spark.createDataFrame([], "cls string, id long, hash long")).count() == 0
