"""Near-duplicate 64-bit hashes and incremental refresh (DED-01 to DED-06, JOIN-03, JOIN-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.operators import hamming


def sign_hash(vector: Column) -> Column:
    """DED-02 for vectors: the signs of up to 64 numbers as bits."""
    return F.aggregate(F.slice(vector, 1, 64), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))


def near_pairs(rows: DataFrame, limit: int = 8, bands: list[hamming.Band] | None = None) -> DataFrame:
    """JOIN-12: (cls, a, b, distance) with a < b of rows (cls, id, hash) within limit bits.

    Distinct hashes are met by an index of bands or block by block, chosen for the limit and the size of the largest class;
    only then are hashes replaced by the ids that have them. Classes that are null are one class; rows without id or hash have no pair,
    and rows of one id none with each other.
    """
    hashes = rows.filter("hash IS NOT NULL").select(hamming.class_key().alias("k"), F.col("hash").cast("long").alias("hash")).distinct()
    near = hamming.near(hashes, limit, bands)
    same = hashes.select("k", F.col("hash").alias("a"), F.col("hash").alias("b"), F.lit(0).cast("long").alias("distance"))
    own = rows.filter("id IS NOT NULL AND hash IS NOT NULL").select(hamming.class_key().alias("k"), "cls", "id", F.col("hash").cast("long").alias("hash"))
    one = own.select("k", "cls", F.col("id").alias("i"), F.col("hash").alias("a"))
    two = own.select("k", F.col("id").alias("j"), F.col("hash").alias("b"))
    met = near.unionByName(same).join(one, ["k", "a"]).join(two, ["k", "b"])
    met = met.filter((F.col("i") < F.col("j")) | ((F.col("i") > F.col("j")) & (F.col("a") != F.col("b"))))
    return met.select("cls", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "distance")


#: Pairs of a class that one task decides; classes with more are decided in rounds.
MOST_PAIRS = 200_000


def _decided(frame):
    """kept of the hashes of one class: frame has their pairs (a before b), all orders as one number."""
    import pandas as pd

    before: dict[int, list[int]] = {}
    for a, b in zip(frame["a"].tolist(), frame["b"].tolist()):
        before.setdefault(b, []).append(a)
    kept: dict[int, bool] = {}
    for x in sorted({*before, *frame["a"].tolist()}):
        kept[x] = not any(kept[a] for a in before.get(x, ()))
    return pd.DataFrame({"k": frame["k"].iloc[0], "place": list(kept), "kept": list(kept.values())})


def greedy_keep(rows: DataFrame, limit: int = 8, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """DED-01: rows with `kept`: in order of id, an item is kept iff no kept item of its class before it is within limit.

    Of equal hashes only the first can be kept, so distinct hashes are decided, in order of their least id (null last). A
    class with at most most_pairs near pairs is decided by one task, larger ones in rounds: an item all of whose earlier
    neighbours are decided is decided. Every row stays: null classes are one class, null ids come after all others (of
    equal places the least hash first, of equal rows each is a row and one is kept), rows without a hash are kept.
    """
    from pagemill.tables import discard, materialize

    own = materialize(rows.withColumn("_k", hamming.class_key()).withColumn("_row", F.monotonically_increasing_id()))
    order = F.struct(F.col("id").isNull(), "id", "_row")
    firsts = materialize(own.filter("hash IS NOT NULL").groupBy(F.col("_k").alias("k"), F.col("hash").cast("long").alias("hash")).agg(F.min(order).alias("first")))
    near = hamming.near(firsts.select("k", "hash"), limit)
    ranked = firsts.select("k", "hash", F.struct(F.col("first.col1"), F.col("first.id"), "hash").alias("place"))
    both = near.join(ranked.select("k", F.col("hash").alias("a"), F.col("place").alias("p")), ["k", "a"]).join(ranked.select("k", F.col("hash").alias("b"), F.col("place").alias("q")), ["k", "b"])
    pairs = materialize(both.select("k", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")))
    large = materialize(pairs.groupBy("k").count().filter(F.col("count") > most_pairs).select("k"))
    # small classes: places become numbers within the class, one task decides
    few = pairs.join(large, "k", "left_anti")
    places = few.select("k", F.explode(F.array("a", "b")).alias("place")).distinct()
    places = materialize(places.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("place")).cast("long")))
    numbered = few.join(places.select("k", F.col("place").alias("a"), F.col("n").alias("x")), ["k", "a"]).join(places.select("k", F.col("place").alias("b"), F.col("n").alias("y")), ["k", "b"])
    done = numbered.select("k", F.col("x").alias("a"), F.col("y").alias("b")).groupBy("k").applyInPandas(_decided, "k string, place long, kept boolean")
    decided = places.join(done.withColumnRenamed("place", "n"), ["k", "n"]).select("k", "place", "kept")
    if not large.isEmpty():
        rest = pairs.join(large, "k", "left_semi")
        later = rest.select("k", F.col("b").alias("place")).distinct().withColumn("later", F.lit(True))
        state = rest.select("k", F.explode(F.array("a", "b")).alias("place")).distinct().join(later, ["k", "place"], "left")
        state = materialize(state.select("k", "place", F.when(F.col("later").isNull(), True).alias("kept")))
        while not state.filter("kept IS NULL").isEmpty():  # each round decides the least open item of every class at least
            before = rest.join(state.select("k", F.col("place").alias("a"), "kept"), ["k", "a"]).groupBy("k", F.col("b").alias("place"))
            seen = before.agg(F.max(F.coalesce("kept", F.lit(False))).alias("near_kept"), F.count_if(F.col("kept").isNull()).alias("open"))
            old, state = state, materialize(state.join(seen, ["k", "place"], "left").select("k", "place", F.coalesce("kept", F.when(F.col("near_kept"), False).when(F.col("open") == 0, True)).alias("kept")))
            discard(old)
        decided = decided.unionByName(state)
    lost = decided.filter("NOT kept").select(F.col("k").alias("_k"), F.col("place.hash").alias("_h"), F.lit(True).alias("lost"))
    first = firsts.select(F.col("k").alias("_k"), F.col("hash").alias("_h"), F.col("first._row").alias("first"))
    out = own.withColumn("_h", F.col("hash").cast("long")).join(first, ["_k", "_h"], "left").join(lost, ["_k", "_h"], "left")
    kept = F.col("_h").isNull() | ((F.col("first") == F.col("_row")) & F.col("lost").isNull())
    return out.select(*rows.columns, kept.alias("kept"))


def refresh_status(old: DataFrame, new: DataFrame) -> DataFrame:
    """DED-04, JOIN-03: (filename, status) of an index against the files: reuse, changed, new, removed."""
    both = old.select("filename", F.col("hash").alias("o")).join(new.select("filename", F.col("hash").alias("n")), "filename", "full_outer")
    status = F.when(F.col("n").isNull(), "removed").when(F.col("o").isNull(), "new").when(F.col("o") == F.col("n"), "reuse").otherwise("changed")
    return both.select("filename", status.alias("status"))


def refreshed(old: DataFrame, new: DataFrame, summarize) -> DataFrame:
    """DED-04, DED-05: the next index: unchanged records as they are, others through summarize (a stage that adds summary and
    error); a record whose summary fails keeps the old one with the error."""
    same = old.join(new.select("filename", "hash"), ["filename", "hash"], "left_semi").withColumn("error", F.lit(None).cast("string"))
    open_ = summarize(new.join(old.select("filename", "hash"), ["filename", "hash"], "left_anti"))
    kept = open_.join(old.select("filename", F.col("hash").alias("old_hash"), F.col("summary").alias("old_summary")), "filename", "left")
    failed = F.col("error").isNotNull()
    kept = kept.filter(~failed | F.col("old_hash").isNotNull())
    redone = kept.select("filename", F.when(failed, F.col("old_hash")).otherwise(F.col("hash")).alias("hash"), F.when(failed, F.col("old_summary")).otherwise(F.col("summary")).alias("summary"), "error")
    return same.select("filename", "hash", "summary", "error").unionByName(redone)


def cached_labels(items: DataFrame, cache: DataFrame, valid: list[str]) -> DataFrame:
    """DED-06: (key, label): the cached label if it is valid, else null (to be asked again)."""
    return items.join(cache.select("key", "label"), "key", "left").withColumn("label", F.when(F.col("label").isin(*valid), F.col("label")))
