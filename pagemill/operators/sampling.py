"""Splits, samples and orders that are the same on every run and engine (ORD-01 to ORD-12, SRC-17, PRJ-17, PRJ-18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.tables import materialize


def order_key(seed, *keys: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))


def exact_share(rows: DataFrame, key: str, share: float, seed, name: str = "chosen") -> DataFrame:
    """ORD-05, ORD-06, ORD-09: rows with a flag that holds for exactly round(share * n) of the distinct keys (halves to even).

    A null key is one of the keys (its hash is that of an empty text). The keys and their hashes are written once. The cut-off among
    the hashes comes from a bracket and a count, not from ranking all keys in one task: keys below the bracket are chosen,
    and only those within it are ranked.
    """
    keys = materialize(rows.select(F.col(key).alias("_key")).distinct().withColumn("h", order_key(seed, F.col("_key"))).withColumn("at", F.conv(F.substring("h", 1, 8), 16, 10).cast("long")))
    n = keys.count()
    want = int(keys.sparkSession.range(1).select(F.bround(F.lit(float(share * n)), 0)).first()[0])
    lo, hi = _bracket(want, n)
    below = keys.filter(F.col("at") < lo)
    middle = keys.filter((F.col("at") >= lo) & (F.col("at") < hi))
    rank = F.row_number().over(Window.orderBy("h", "_key"))
    chosen = below.select("_key").union(middle.withColumn("rn", rank).filter(F.col("rn") <= want - below.count()).select("_key")).withColumn(name, F.lit(True))
    found = rows.join(chosen, rows[key].eqNullSafe(chosen["_key"]), "left")
    return found.select(*[rows[c] for c in rows.columns], F.coalesce(chosen[name], F.lit(False)).alias(name))


def _bracket(want: int, n: int) -> tuple[int, int]:
    """Hashes are uniform: the want-th of n lies within 8 standard deviations (at least 64 places) of its share."""
    if n == 0:
        return 0, 0
    spread = max(64.0, 8 * (max(1, want) * (1 - want / (n + 1))) ** 0.5)
    return max(0, int((want - spread) / n * 2**32)), min(2**32, int((want + spread) / n * 2**32) + 1)


def first_rows(rows: DataFrame, n: int, *order) -> DataFrame:
    """ORD-01, ORD-02, ORD-03: the first n rows in order, all for 0."""
    return rows.orderBy(*order).limit(n) if n else rows.orderBy(*order)


def rows_at(rows: DataFrame, positions: list[int], *order) -> DataFrame:
    """SRC-04: the rows at given places (from 0) in order, with their place; at most the rows up to the last place are ranked."""
    first = rows.orderBy(*order).limit(max(positions, default=-1) + 1)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1).filter(F.col("place").isin(*positions))


def bernoulli(share: float, seed, *keys: Column) -> Column:
    """ORD-10: an independent draw for each key."""
    return F.conv(F.substring(order_key(seed, *keys), 1, 8), 16, 10).cast("double") / 4294967296.0 < share


def shuffled(rows: DataFrame, seed, epoch: int, *keys: str) -> DataFrame:
    """ORD-08, ORD-11: another order for each epoch."""
    return rows.orderBy(order_key(int(seed) + epoch, *[F.col(k) for k in keys]), *keys)


def split_by(rows: DataFrame, test: Column) -> DataFrame:
    """ORD-07: rows with part: test where the condition holds, else train (also where it is null)."""
    return rows.withColumn("part", F.when(F.coalesce(test, F.lit(False)), "test").otherwise("train"))


def shuffled_distinct(rows: DataFrame, item: str, seed, doc: str = "doc") -> DataFrame:
    """ORD-11: (doc, items): each document's distinct items in an order by hash."""
    keyed = F.struct(order_key(seed, F.col(item)).alias("h"), F.col(item).alias("x"))
    return rows.groupBy(doc).agg(F.transform(F.array_sort(F.collect_set(keyed)), lambda s: s["x"]).alias("items"))


def members(rows: DataFrame, held: DataFrame, key: str, name: str = "test") -> DataFrame:
    """JOIN-08: rows with a flag: their key is among held's."""
    return rows.join(held.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def without(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """JOIN-09, SET-04: rows whose key isn't among done's; rows with a null key stay."""
    return rows.join(done.select(key), key, "left_anti")


def chunk_of(pos: Column, size: int) -> Column:
    """ORD-12."""
    return F.floor(pos / size)


def sample_n(rows: DataFrame, n: int, seed, *keys: str) -> DataFrame:
    """SRC-17: n rows without replacement (top n by hash: no shuffle of all rows)."""
    return rows.orderBy(order_key(seed, *[F.col(k) for k in keys]), *keys).limit(n)


def draw_slots(slots: DataFrame, pool_size: int, seed) -> DataFrame:
    """PRJ-18: for each slot an ordinal of the pool, with replacement."""
    h = F.conv(F.substring(order_key(seed, F.col("slot")), 1, 8), 16, 10).cast("long")
    return slots.withColumn("ordinal", h % pool_size)


def draw_distinct(slots: DataFrame, pool: DataFrame, key: str, seed) -> DataFrame:
    """PRJ-18: for each slot a row of the pool without replacement where the pool is large enough, else with replacement.

    The slots are few (what one run makes); the pool's first rows by hash are taken, one for each, and repeat beyond it."""
    n, size = slots.count(), pool.count()
    first = pool.orderBy(order_key(seed, F.col(key)), key).limit(n)
    ordinal = F.row_number().over(Window.orderBy(order_key(seed, F.col(key)), key)) - 1  # n rows at most
    slots = slots.withColumn("ordinal", F.row_number().over(Window.orderBy("slot")) - 1)
    if n > size:
        slots = draw_slots(slots.drop("ordinal"), max(1, size), seed)
    return slots.join(first.withColumn("ordinal", ordinal), "ordinal")


def subset(names: Column, seed: Column, lo: int = 2, hi: int = 4) -> Column:
    """PRJ-17: a few scalar names (no []), chosen and counted by hash."""
    scalar = F.filter(names, lambda x: ~x.contains("[]"))
    ranked = F.transform(F.array_sort(F.transform(scalar, lambda x: F.struct(F.md5(F.concat(seed, F.lit("|"), x).cast("binary")).alias("h"), x.alias("x")))), lambda s: s["x"])
    n = F.lit(lo) + F.pmod(F.conv(F.substring(F.md5(seed.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(hi - lo + 1)).cast("int")
    return F.slice(ranked, F.lit(1), n)
