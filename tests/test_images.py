import math
import random
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from pagemill import catalog
from pagemill.functions import pixels
from pagemill.functions.numeric import warp_box
from pagemill.functions.rewriting import homography
from pagemill.operators import dedup, images, preview


def page(seed, height=96, width=72, channels=3):
    """A page with dark blocks on white."""
    rng = np.random.default_rng(seed)
    out = np.full((height, width, channels), 250, np.uint8)
    for _ in range(12):
        y, x = rng.integers(0, max(1, height - 12)), rng.integers(0, max(1, width - 20))
        out[y : y + rng.integers(2, 12), x : x + rng.integers(4, 20)] = rng.integers(0, 120)
    return out


def jpeg(entropy=b"\x01\x02\xff\x00\x03\xff\xd0\x04\xff\xd1\x05"):
    """The segments of a JPEG file around some coded data."""
    segment = lambda kind, body: b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body
    frame = segment(0xC0, struct.pack(">BHHB", 8, 16, 16, 1) + b"\x01\x11\x00")
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0") + segment(0xDB, bytes(65)) + frame + segment(0xC4, bytes(20)) + segment(0xDA, b"\x01\x01\x00\x00\x3f\x00") + entropy + b"\xff\xd9"


def plain_hash(image):
    """The hash by its definition: averages of 32 x 32 fields, a cosine transform term by term, bits above the median."""
    grey = image[..., 0].astype(float) if image.shape[2] == 1 else image.astype(float) @ np.array([0.299, 0.587, 0.114])
    height, width = grey.shape
    field = [[0.0] * 32 for _ in range(32)]
    for i in range(32):
        for j in range(32):
            total = 0.0
            for y in range(int(i * height / 32), min(height, math.ceil((i + 1) * height / 32))):
                for x in range(int(j * width / 32), min(width, math.ceil((j + 1) * width / 32))):
                    part = min((i + 1) * height / 32, y + 1) - max(i * height / 32, y)
                    total += grey[y, x] * part * (min((j + 1) * width / 32, x + 1) - max(j * width / 32, x))
            field[i][j] = total / (height / 32 * width / 32)
    low = [4 * sum(field[y][x] * math.cos(math.pi * u * (2 * y + 1) / 64) * math.cos(math.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    middle = sorted(low)[31:33]
    value = int("".join("1" if x > sum(middle) / 2 else "0" for x in low), 2)
    return value - (1 << 64) if value >> 63 else value


def test_hashes_equal_a_plain_transform_and_meet_near_images(spark, tmp_path):
    rng = np.random.default_rng(5)
    pages = [page(k, 90 + k, 70, 1 if k % 3 else 3) for k in range(6)]
    near = [np.clip(p.astype(int) + rng.integers(-6, 7, p.shape), 0, 255).astype(np.uint8) for p in pages]
    for k, p in enumerate([*pages, *near]):
        (tmp_path / f"{k:02d}.png").write_bytes(pixels.encode_png(p))
    (tmp_path / "zz.png").write_bytes(b"\x89PNG broken")
    found = {r["path"].rpartition("/")[2]: r["hash"] for r in images.with_hash(images.read_images(spark, str(tmp_path))).select("path", "hash").collect()}
    assert [found[f"{k:02d}.png"] for k in range(12)] == [plain_hash(p) for p in [*pages, *near]] and found["zz.png"] is None
    raw = spark.createDataFrame([(k, pixels.encode_png(p)) for k, p in enumerate([*pages, *near])] + [(98, None), (99, b"no image")], "id long, image binary")
    hashed = images.with_hash(raw).select(F.lit("c").alias("cls"), "id", "hash")
    assert {r["id"]: r["hash"] for r in hashed.collect()} == {**{k: found[f"{k:02d}.png"] for k in range(12)}, 98: None, 99: None}
    kept = {r["id"]: r["kept"] for r in dedup.greedy_keep(hashed, 8).collect()}
    assert all(kept[k] and not kept[k + 6] for k in range(6)) and kept[98] and kept[99]
    assert {(r["a"], r["b"]) for r in dedup.near_pairs(hashed, 8).collect()} >= {(k, k + 6) for k in range(6)}


def test_png_round_trip_and_filters():
    rng = random.Random(3)
    for n in (1, 3):
        image = page(n, 20, 15, n)
        assert np.array_equal(pixels.decode_png(pixels.encode_png(image)), image)
        lines, before = [], np.zeros((16, n), int)  # every filter, by hand
        for y in range(20):
            kind, own = rng.randrange(5), np.zeros((16, n), int)
            own[1:] = image[y]
            left, up, corner = own[:-1], before[1:], before[:-1]
            base = left + up - corner
            far = np.abs(np.stack([base - left, base - up, base - corner]))
            guess = [0 * left, left, up, (left + up) // 2, np.choose(np.argmin(far, axis=0), [left, up, corner])][kind]
            lines.append(bytes([kind]) + ((own[1:] - guess) & 255).astype(np.uint8).tobytes())
            before = own
        whole = pixels.encode_png(image)
        parts = dict(pixels.chunks(whole))
        packed = zlib.compress(b"".join(lines))
        made = whole[:33] + struct.pack(">I", len(packed)) + b"IDAT" + packed + struct.pack(">I", zlib.crc32(packed, zlib.crc32(b"IDAT"))) + whole[-12:]
        assert np.array_equal(pixels.decode_png(made), image) and parts[b"IHDR"][:8] == struct.pack(">II", 15, 20)


def test_whole_images(spark):
    good, photo = pixels.encode_png(page(1)), jpeg()
    rng = random.Random(4)
    flipped = []
    for _ in range(60):
        k = rng.randrange(len(good))
        flipped.append(good[:k] + bytes([good[k] ^ (1 << rng.randrange(8))]) + good[k + 1 :])
    cut = [good[: rng.randrange(len(good))] for _ in range(40)] + [photo[: rng.randrange(len(photo))] for _ in range(40)]
    out_of_turn = jpeg(b"\x01\xff\xd1\x02")
    no_pixels = good[:33] + good[-12:]
    bad = [*flipped, *cut, out_of_turn, no_pixels, b"", b"GIF89a cut", struct.pack("<4sI4s", b"RIFF", 99, b"WEBP"), None]
    assert pixels.image_fault(good) is None and pixels.image_fault(photo) is None and pixels.image_fault(b"GIF89a...;") is None
    assert all(pixels.image_fault(x) for x in bad)
    rows = [(0, [good, photo]), (1, []), (2, None), (3, [good, None]), (4, [good, cut[0]])] + [(10 + k, [x]) for k, x in enumerate(bad)]
    found = {r["id"]: r["ok"] for r in spark.createDataFrame(rows, "id int, images array<binary>").select("id", images.whole(F.col("images")).alias("ok")).collect()}
    assert found.pop(0) and found.pop(1) and not any(found.values())


def test_warped_corners_land_where_the_boxes_are(spark):
    height, width = 200, 150
    image = np.full((height, width, 1), 255, np.uint8)
    image[40:80, 30:90] = 0
    box = [30 / width, 40 / height, 90 / width, 80 / height]
    for seed in ("a", "b", "c"):
        matrix = homography(seed, width, height, 0.4)
        out = pixels.warped(image, matrix)[..., 0]
        ys, xs = np.nonzero(out < 128)
        want = spark.range(1).select(warp_box(F.array(*map(F.lit, box)), F.array(*map(F.lit, matrix))).alias("b")).first()["b"]
        assert np.allclose([xs.min() / width, ys.min() / height, (xs.max() + 1) / width, (ys.max() + 1) / height], want, atol=1.6 / width)
    assert np.array_equal(pixels.warped(image, [1, 0, 0, 0, 1, 0, 0, 0, 1]), image)


def test_blur_is_the_two_dimensional_sum():
    image = page(7, 14, 11, 1)
    weights = np.exp(-0.5 * (np.arange(-3, 4) / 1.0) ** 2)
    weights /= weights.sum()
    framed = np.pad(image[..., 0].astype(float), 3, mode="edge")
    want = [[(framed[y : y + 7, x : x + 7] * np.outer(weights, weights)).sum() for x in range(11)] for y in range(14)]
    assert np.allclose(pixels.blurred(image, 1.0)[..., 0], want)


def test_aged_pages(spark):
    clean = pixels.encode_png(page(2))
    profiles = ["clean_scan", "phone_photo", "old_photocopy", "fax"]
    rows = [(p, k, clean, p, 0.3, k % 2 == 0, 0.5, 11) for k, p in enumerate(profiles)] + [("x", 9, clean, "unknown", 0.3, False, 0.5, 1), ("y", 9, clean[:50], "fax", 0.3, False, 0.5, 1)]
    df = spark.createDataFrame(rows, "doc string, page int, image binary, profile string, quality double, geometric boolean, geo_quality double, seed int")
    first = {r["doc"]: r for r in images.aged_pages(df).collect()}
    again = {r["doc"]: r for r in images.aged_pages(df.repartition(3)).collect()}
    for k, p in enumerate(profiles):
        assert first[p]["aug_ok"] and first[p]["image"] == again[p]["image"] != clean and (first[p]["matrix"] is not None) == (k % 2 == 0)
        assert pixels.decode_png(bytes(first[p]["image"])).shape == (96, 72, 3)
    assert set(np.unique(pixels.decode_png(bytes(first["fax"]["image"])))) == {0, 255}
    assert not first["x"]["aug_ok"] and first["x"]["image"] == clean and "unknown profile" in first["x"]["error"] and first["y"]["error"]
    worst = lambda q: np.abs(pixels.aged(page(2), "clean_scan", q, "s").astype(int) - page(2)).mean()
    assert worst(0.0) > worst(0.9)


def test_boxes_are_drawn_at_pixel_corners(spark):
    clean = page(3, 100, 80)
    answers = spark.createDataFrame([("d", 0, "q", "v", [0.25, 0.1, 0.75, 0.5], 0), ("d", 1, "r", "w", [0.5, 0.5, 1.2, 1.0], 0), ("d", 2, "r", "w", None, 0)], "doc string, pos int, query string, value string, box array<double>, page int")
    sizes = spark.createDataFrame([("d", 0, 80, 100), ("d", 1, 80, 100)], "doc string, page int, width int, height int")
    pages = spark.createDataFrame([("d", 0, pixels.encode_png(clean)), ("d", 1, pixels.encode_png(clean))], "doc string, page int, image binary")
    found = {r["page"]: pixels.decode_png(bytes(r["image"])) for r in images.annotated_pages(pages, preview.annotations(answers, sizes)).collect()}
    want = clean.copy()
    for (x0, y0, x1, y1), colour in (((20, 10, 60, 50), 0), ((40, 50, 96, 100), 1)):
        for y in range(100):
            for x in range(80):
                if x0 <= x <= x1 and y0 <= y <= y1 and not (x0 + 2 <= x <= x1 - 2 and y0 + 2 <= y <= y1 - 2):
                    want[y, x] = images.PALETTE[colour]
    assert np.array_equal(found[0], want) and np.array_equal(found[1], clean)


def test_hashes_of_pictures_with_equal_frequencies_equal_sql(spark, duck, tmp_path):
    """Pictures of one colour, of stripes and symmetrical ones: frequencies that are equal but for rounding."""
    rng = np.random.default_rng(5)
    vectors = [[0.0] * 64, [0.1] * 64, [float("nan")] * 64, [-9.0] * 64, [0.2, -0.2] * 32, ([0.1] * 8 + [-0.1] * 8) * 4]
    vectors += [np.tile(rng.normal(0, 0.1, 8), 8).tolist() for _ in range(4)] + [np.repeat(rng.normal(0, 0.1, 8), 8).tolist() for _ in range(4)]
    vectors += [((a + a[::-1]) / 2).ravel().tolist() for a in rng.normal(0, 0.15, (8, 8, 8))]
    rows = [(k, v, k % 3) for k, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duck.cursor()
    con.sql(f"CREATE TEMP VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("ded02_image_hash", "join12_image_pairs"):
        got = catalog.queries()[name](spark, str(tmp_path))
        want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want), name
