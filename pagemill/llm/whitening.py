"""Whitening of embeddings: a compensated covariance over all rows, its eigenvectors, and each row's whitened components.

Entries become whole numbers; their sums are exact, so the mean is known to twice a double's digits. Tasks centre their rows
(high and low part) and add up the outer products without rounding error: each centred batch is cut into slices of so few
bits that a product of two slices over the batch is exact in a double, and these products are added to a sum of two
doubles by error-free additions. The tasks' sums, high and low parts, are merged in two steps by matrix row. The eigenvectors
of the covariance (as many numbers as dimensions squared) come from the solver of symmetric matrices that reduces to
tridiagonal form and divides and conquers. The covariance of the whitened rows is then measured by the same means, from what
was written.

Null vectors and those with null, NaN or infinite entries are left out, and so are entries beyond 2^45, whose whole numbers
couldn't be centred exactly. Where lengths differ, the most frequent one counts (of equals the longest), others are left
out. Repeated rows and ids count as often as they are there; null ids stay. Components without variance (constant
dimensions, fewer rows than components, one row) have null as whitened value, and count neither in identity_error nor as one
of unit variance; explained is null where nothing varies. A deviation beyond a long is null. Empty tables give no rows. Other
columns are ignored.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import arrow_schema, materialize, table

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Rows that are multiplied at once (2^9), slices of a number and bits of a slice: 2 * 22 + 9 = 53 bits are exact.
ROWS, SLICES, BITS = 512, 4, 22
#: Keys that the tasks' sums of a matrix row are dealt to before they meet.
DEALS = 32
LARGEST = float(1 << 45)


def two_sum(a, b):
    """a + b as the rounded sum and its exact error."""
    s = a + b
    z = s - a
    return s, (a - (s - z)) + (b - z)


def add(high, low, a, b):
    """(high + low) + (a + b) as such a pair."""
    s, e = two_sum(high, a)
    return two_sum(s, e + (low + b))


def added_up(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the rows as such a pair, by pairs of rows."""
    high, low = x, np.zeros_like(x)
    while len(high) > 1:
        if len(high) % 2:
            high, low = np.vstack([high, np.zeros_like(high[:1])]), np.vstack([low, np.zeros_like(low[:1])])
        high, low = add(high[::2], low[::2], high[1::2], low[1::2])
    return high[0], low[0]


def slices(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """Parts of at most BITS bits, multiples of powers of two that the largest entry of each column fixes, which add up to
    high + low but for less than 2^-(SLICES * BITS - 1) of that entry."""
    exponents = np.frexp(np.max(np.abs(high), axis=0, initial=0.0))[1]
    out = []
    for k in range(SLICES):
        unit = np.ldexp(1.0, exponents - BITS * (k + 1))
        part = np.rint(high / unit) * unit  # powers of two: nothing is rounded but to their multiples
        out.append(part)
        high, low = two_sum(high - part, low)
    return out


class Products:
    """Sum of the outer products of rows, as a pair of matrices."""

    def __init__(self, width: int):
        self.high, self.low = np.zeros((width, width)), np.zeros((width, width))

    def take(self, high: np.ndarray, low: np.ndarray) -> None:
        for at in range(0, len(high), ROWS):
            parts = slices(high[at : at + ROWS], low[at : at + ROWS])
            for i in range(SLICES):
                for j in range(i, SLICES - i):
                    product = parts[i].T @ parts[j]
                    for x in [product] if i == j else [product, product.T]:
                        self.high, self.low = add(self.high, self.low, x, 0.0)


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x (array of long) of the rows that remain; all of one length. Written once, as all passes read them."""
    rows = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    # a null vector or entry makes the condition null, NaN is greater than any number: all are left out
    rows = rows.filter(F.forall("v", lambda c: F.abs(c) <= LARGEST))
    rows = materialize(rows.select("vec_id", F.transform("v", lambda c: F.floor(SCALE * c).cast("long") + SHIFT).alias("x")))
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    return rows.filter(F.size("x") == (sizes["d"] if sizes else 0))


def _matrix(column, kind) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(kind, copy=False)


def sums(rows: DataFrame, column: str) -> tuple[int, list[Fraction]]:
    """Number of rows, and the exact sums of each dimension of an array column of long or double."""
    exact = "bigint" in dict(rows.dtypes)[column]
    schema = arrow_schema(rows.sparkSession, "n long, high array<double>, low array<double>, whole array<long>")

    def one(n, high, low, whole):
        return pa.RecordBatch.from_pydict({"n": [n], "high": [high.tolist()], "low": [low.tolist()], "whole": [whole.tolist()]}, schema=schema)

    def read(batches):
        n, high, low, whole = 0, None, None, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), np.int64 if exact else float)
                if whole is None:
                    high, low, whole = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1], np.int64)
                n += len(x)
                if exact:
                    whole += x.sum(axis=0)
                else:
                    high, low = add(high, low, *added_up(x))
        if n:
            yield one(n, high, low, whole)

    def merge(batches):
        n, held = 0, None
        for batch in batches:
            for r in batch.to_pylist():
                own = [np.array(r[k]) for k in ("high", "low", "whole")]
                held = own if held is None else [*add(held[0], held[1], own[0], own[1]), held[2] + own[2]]
                n += r["n"]
        if n:
            yield one(n, *held)

    found = rows.select(column).mapInArrow(read, schema_ddl := "n long, high array<double>, low array<double>, whole array<long>").repartition(DEALS).mapInArrow(merge, schema_ddl).collect()
    total = [sum((Fraction(x[k]) for r in found for x in (r["whole"], r["high"], r["low"])), Fraction(0)) for k in range(len(found[0]["whole"]))] if found else []
    return sum(r["n"] for r in found), total


def covariance(rows: DataFrame, column: str, n: int, total: list[Fraction]) -> tuple[np.ndarray, np.ndarray]:
    """The covariance (divisor n) of an array column as a pair of matrices; total: the sums of its n rows."""
    width = len(total)
    mean = [x / n for x in total]
    mean_high = np.array([float(x) for x in mean])
    mean_low = np.array([float(x - Fraction(float(x))) for x in mean])
    ddl = "i int, deal int, high array<double>, low array<double>"
    schema = arrow_schema(rows.sparkSession, ddl)

    def read(batches):
        from pyspark import TaskContext

        found, task = Products(width), TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows:
                high, low = two_sum(_matrix(batch.column(0), float), -mean_high)
                found.take(*two_sum(high, low - mean_low))
        if found.high.any() or found.low.any():
            yield pa.RecordBatch.from_pydict({"i": list(range(width)), "deal": [task % DEALS] * width, "high": list(found.high), "low": list(found.low)}, schema=schema)

    def merge(batches):
        held: dict = {}
        for batch in batches:
            for i, deal, high, low in zip(*(batch.column(k).to_pylist() for k in range(4))):
                high, low = np.array(high), np.array(low)
                held[i, deal] = add(*held[i, deal], high, low) if (i, deal) in held else (high, low)
        for (i, deal), (high, low) in held.items():
            yield pa.RecordBatch.from_pydict({"i": [i], "deal": [deal], "high": [high], "low": [low]}, schema=schema)

    once = rows.select(column).mapInArrow(read, ddl).repartition("i", "deal").mapInArrow(merge, ddl)
    twice = once.withColumn("deal", F.lit(0)).repartition("i").mapInArrow(merge, ddl)
    high, low = np.zeros((width, width)), np.zeros((width, width))
    for r in twice.collect():
        high[r["i"]], low[r["i"]] = r["high"], r["low"]
    # divided with its remainder: q + r / n
    q = high / n
    exact = np.vectorize(lambda h, l, x: float(Fraction(h) + Fraction(l) - n * Fraction(x)) / n, otypes=[float])
    return q, exact(high, low, q) if width else low


def eigen(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    full = high + low
    values, found = np.linalg.eigh((full + full.T) / 2)
    return values[::-1], found[:, ::-1]


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each remaining row and component."""
    spark = rows.sparkSession
    x = vectors(rows, id_col, vector_col)
    n, total = sums(x, "x")
    ddl = f"vec_id {x.schema['vec_id'].dataType.simpleString()}, deviation long, w array<double>"
    if not n or not total:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    high, low = covariance(x, "x", n, total)
    values, found = eigen(high, low)
    count, trace = min(components, len(values)), float(np.trace(high) + np.trace(low))
    floor = trace * len(values) * 2.0**-52
    varied = [k for k in range(count) if values[k] > floor]
    turn = found[:, varied] / np.sqrt(values[varied])
    whole = [int(t) for t in total]
    mean = [t / n for t in total]
    mean_high = np.array([float(m) for m in mean])
    mean_low = np.array([float(m - Fraction(float(m))) for m in mean])
    schema = arrow_schema(spark, ddl)
    most = math.isqrt((2**63 - 1) // len(whole))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                own = _matrix(batch.column("x"), np.int64)
                high, low = two_sum(own.astype(float), -mean_high)
                y = (high + (low - mean_low)) @ turn
                if n * (float(np.abs(own).max()) + max(abs(m) for m in mean)) < min(most, 2.0**62):
                    deviation = ((n * own - np.array(whole)) ** 2).sum(axis=1).tolist()
                else:
                    deviation = [sum((n * int(a) - s) ** 2 for a, s in zip(row, whole)) for row in own]
                    deviation = [v if v < 2**63 else None for v in deviation]
                flat = pa.array(y.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1] or 1, dtype=np.int32)), flat) if varied else pa.array([[]] * len(own), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviation, pa.int64()), lists], schema=schema)

    done = materialize(x.mapInArrow(run, ddl))
    error = None
    if varied:
        own_high, own_low = covariance(done, "w", *sums(done, "w"))
        error = float(np.abs((own_high - np.eye(len(varied))) + own_low).max())
    explained = F.array(*[F.lit(max(0.0, float(values[k])) / trace if trace > 0 else None).cast("double") for k in range(count)])
    each = F.posexplode(F.arrays_zip(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.get("w", k)).alias("w"), explained.alias("e"))).alias("k", "of")
    return done.select("vec_id", "deviation", each).select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.col("of.w").alias("whitened"), F.col("of.e").alias("explained"), F.lit(error).cast("double").alias("identity_error")
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
