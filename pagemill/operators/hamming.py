"""Pairs of 64-bit hashes within a number of bits (JOIN-12): by an index of bands with probes, or block by block.

The index pays where it meets few candidates. Where the limit is so large that no band tells much, or a class is small, all
pairs of a class are compared: its hashes are dealt to blocks, and pairs of blocks to tasks, so a task holds two blocks at a
time and what is sent is each block once for each block of its class, never a row for a pair that isn't near.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 64
#: Hashes of a block on average; comparisons of one task on average; how many of them cost as much as one row of a join.
BLOCK, TASK_COMPARISONS, COMPARISONS = 2048, 1 << 27, 256
#: Comparisons that numpy makes at once, and rows of a batch; classes whose sizes are broadcast.
STRIP, FEW_CLASSES = 1 << 18, 100_000


@dataclass(frozen=True)
class Band:
    """Bits from `low` on, `width` of them, and within how many of them a probe looks for others."""

    low: int
    width: int
    radius: int

    @property
    def probes(self) -> int:
        return sum(comb(self.width, k) for k in range(self.radius + 1))

    def of(self, value: Column) -> Column:
        return F.shiftrightunsigned(value, self.low).bitwiseAND(F.lit((1 << self.width) - 1).cast("long"))

    def masks(self) -> list[int]:
        return [sum(1 << b for b in bits) for k in range(self.radius + 1) for bits in combinations(range(self.width), k)]


def bands_of(limit: int, n: int) -> list[Band]:
    """Widths add up to 64 and radii to limit - n + 1: of hashes within limit bits, some band is within its radius.

    (Were all beyond, the bits would add up to more than the radii plus n, that is more than limit.) Wider bands get the
    larger radii.
    """
    widths = [BITS * (i + 1) // n - BITS * i // n for i in range(n)]
    lows = [sum(widths[:i]) for i in range(n)]
    spare = limit - n + 1
    order = sorted(range(n), key=lambda i: -widths[i])
    radius = {i: (spare + n - 1 - k) // n for k, i in enumerate(order)}
    # a negative radius: the other bands suffice, this one isn't probed
    return [Band(lows[i], widths[i], radius[i]) for i in range(n) if radius[i] >= 0]


def plan(limit: int, n_rows: int) -> list[Band]:
    """The bands with the fewest probes and met rows for each row, if the hashes of a class of so many rows are spread evenly."""

    return min((bands_of(limit, n) for n in range(2, max(16, limit + 1) + 1) if max(b.probes for b in bands_of(limit, n)) <= 1 << 14), key=lambda bands: cost(bands, n_rows))


def cost(bands: list[Band], n_rows: int) -> float:
    """Probes and met rows for each row of a class of so many rows."""
    return sum(b.probes * (1 + n_rows / 2**b.width) for b in bands)


def class_key(column: str = "cls") -> Column:
    """A text that is equal for equal classes, null ones included."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def met(hashes: DataFrame, bands: list[Band]) -> DataFrame:
    """(k, a, b, band) of distinct hashes (k, hash) of a class where b's band is within the radius of a's: the candidates.

    Each hash is stored once for each band and asks for every value within the radius. The join is by class, band and
    value; a crowded value is split by the runtime's handling of skewed joins.
    """
    stored = hashes.select("k", F.col("hash").alias("b"), F.posexplode(F.array(*[b.of(F.col("hash")) for b in bands])).alias("band", "bits"))
    asked = None
    for i, band in enumerate(bands):
        masks = F.explode(F.expr(f"array({', '.join(f'{m}L' for m in band.masks())})")).alias("mask")
        one = hashes.select("k", F.col("hash").alias("a"), F.lit(i).alias("band"), masks)
        one = one.select("k", "a", "band", band.of(F.col("a")).bitwiseXOR(F.col("mask")).alias("bits"))
        asked = one if asked is None else asked.unionByName(one)
    return asked.join(stored, ["k", "band", "bits"]).filter("a < b").select("k", "a", "b", "band")


def near_hashes(hashes: DataFrame, limit: int, bands: list[Band]) -> DataFrame:
    """(k, a, b, distance) of distinct hashes (k, hash), a < b: each pair once, from its first band within the radius."""
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = F.lit(len(bands))
    for i in reversed(range(len(bands))):
        first = F.when(F.bit_count(bands[i].of(differ)) <= bands[i].radius, i).otherwise(first)
    found = met(hashes, bands).withColumn("distance", F.bit_count(differ).cast("long")).filter(F.col("distance") <= limit)
    return found.filter(first == F.col("band")).select("k", "a", "b", "distance")


def near(hashes: DataFrame, limit: int, bands: list[Band] | None = None) -> DataFrame:
    """(k, a, b, distance) of distinct hashes (k, hash), a < b, each pair once: by the bands, or else by what costs less."""
    sizes = hashes.groupBy("k").count()
    largest, classes, comparisons = sizes.agg(F.max("count"), F.count(F.lit(1)), F.sum(F.col("count").cast("double") ** 2 / 2)).first()
    planned = bands or plan(limit, largest or 0)
    if bands or cost(planned, largest or 0) < (largest or 0) / 2 / COMPARISONS:
        return near_hashes(hashes, limit, planned)
    sizes = sizes.filter("count > 1")
    return compared(hashes, F.broadcast(sizes) if classes <= FEW_CLASSES else sizes, limit, ceil((comparisons or 0) / TASK_COMPARISONS) or 1)


def dealt(hashes: DataFrame, sizes: DataFrame, tasks: int = 1, block: int = BLOCK) -> DataFrame:
    """(k, low, high, left, right): each pair of blocks of a class's distinct hashes (k, hash) once, as arrays; right is null
    where a block meets itself. sizes: (k, count)."""
    blocked = hashes.join(sizes.select("k", F.ceil(F.col("count") / block).alias("blocks")), "k")
    blocked = blocked.groupBy("k", "blocks", F.pmod(F.xxhash64("hash"), F.col("blocks")).alias("own")).agg(F.collect_list("hash").alias("hashes"))
    each = blocked.select("k", "own", "hashes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    each = each.select("k", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "hashes").repartition(tasks, "k", "low", "high")
    side = lambda where: F.first(F.when(F.expr(where), F.col("hashes")), ignorenulls=True)
    return each.groupBy("k", "low", "high").agg(side("own = low").alias("left"), side("own = high AND low < high").alias("right"))


def compared(hashes: DataFrame, sizes: DataFrame, limit: int, tasks: int = 1, block: int = BLOCK) -> DataFrame:
    """What near_hashes gives, from all pairs of a class, pairs of blocks by pairs of blocks."""

    def compare(batches):
        for batch in batches:
            for k, left, right in zip(*(batch.column(c) for c in ("k", "left", "right"))):
                for x, y, distance in _near_places(_numbers(left), _numbers(right), limit):
                    yield pa.RecordBatch.from_arrays([pa.repeat(k, len(x)), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(distance)], ["k", "a", "b", "distance"])

    return dealt(hashes, sizes, tasks, block).mapInArrow(compare, "k string, a bigint, b bigint, distance bigint")


def _numbers(array) -> np.ndarray | None:
    return array.values.to_numpy() if array.is_valid else None


def _near_places(a: np.ndarray, b: np.ndarray | None, limit: int):
    """Near hashes x of a and y of b (null: of a, each pair once) and their distances, some rows of a at a time."""
    other = a if b is None else b
    rows, held, n = max(1, STRIP // len(other)), [], 0
    for first in range(0, len(a), rows):
        far = np.bitwise_count(a[first : first + rows, None].view(np.uint64) ^ other[None, :].view(np.uint64))
        i, j = np.nonzero(far <= limit)
        if b is None:
            once = first + i < j
            i, j = i[once], j[once]
        held.append((a[first + i], other[j], far[i, j].astype(np.int64)))
        n += len(i)
        if n > STRIP or (n and first + rows >= len(a)):
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, n = [], 0
