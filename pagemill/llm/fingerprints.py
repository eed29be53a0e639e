"""Document fingerprints: one-permutation MinHash with optimal densification, kept as packed low-order bits.

A text's word shingles (five words; the whole text where it has fewer) are hashed once. The upper bits of a hash are its
bin, the least hash of a bin its value, of which four bits are kept. An empty bin takes the value of the first filled bin
of its own probe order, a permutation of all bins: (a * t + b) mod bins with odd a, both by a rule from the bin's number. So
equal texts have equal fingerprints, and two texts agree in a bin with the probability of their sets' similarity J, plus
chance (1/16), which `likeness` takes off: J = (P - 1/16) / (1 - 1/16), 0 at least. With 512 bins its standard deviation is
0.024 at most for texts of some hundred words, and more for short ones, whose bins are filled from few shingles.

Everything is DataFrame expressions. Shingles never leave their row. The next document is found in parts of rows that
follow the ids (one shuffle of texts); the last row of each part is finished with the first of the next part's.

Null texts are empty ones; texts without words have the fingerprint of the empty shingle, so they are alike. Null ids come
first, rows of equal ids by hash and text of their texts; repeated rows are rows of their own, and the next document of
one is its copy. A single row is its own next document. Very long texts are read whole, as arrays of one row. Empty tables
give no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.common import materialize, table
from pagemill.llm.ordering import order_parts, part_count

#: Bins (2^9) and bits kept of each; a long holds 16 bins.
BIN_BITS, KEPT_BITS = 9, 4
BINS, WORD_BINS = 1 << BIN_BITS, 64 // KEPT_BITS
SHINGLE = 5
#: Probes that are tried one by one; beyond, or with fewer filled bins than FEW, the filled bins are searched for the first.
PROBES, FEW = 24, 16
REST = 64 - BIN_BITS
LOW = (1 << REST) - 1


def probe(i: int) -> tuple[int, int]:
    """Step (odd) and start of the probe order of bin i."""
    r = zlib.crc32(f"bin {i}".encode())
    return (r & (BINS - 1)) | 1, (r >> 16) & (BINS - 1)


def _array(values) -> str:
    return f"array({', '.join(map(str, values))})"


def with_signature(rows: DataFrame, text: str, into: str, size: int = SHINGLE) -> DataFrame:
    """rows with a column of the packed bins of column text (not null): array of BINS / 16 longs."""
    columns = rows.columns
    ends = _array(f"{((b << REST) | LOW)}L" for b in range(-BINS // 2, BINS // 2))
    rows = rows.withColumn("_w", F.array_remove(F.split(text, "\\s+"), ""))
    rows = rows.withColumn("_g", F.expr("transform(_w, x -> xxhash64(x))"))  # a word is hashed once, a shingle as its words' hashes
    words = ", ".join(f"_g[i + {k}]" for k in range(size))
    rows = rows.withColumn("_h", F.expr(f"CASE WHEN size(_g) < {size} THEN array(xxhash64(_g)) ELSE transform(sequence(0, size(_g) - {size}), i -> xxhash64({words})) END"))
    # with the greatest hash of each bin added, each bin has a first one
    rows = rows.withColumn("_s", F.expr(f"sort_array(concat(_h, {ends}))"))
    least = f"filter(_s, (x, j) -> NOT shiftright(get(_s, j - 1), {REST}) <=> shiftright(x, {REST}))"
    rows = rows.withColumn("_v", F.expr(f"transform({least}, x -> CASE WHEN x & {LOW}L <> {LOW}L THEN CAST(x & {(1 << KEPT_BITS) - 1} AS int) END)"))
    rows = rows.withColumn("_f", F.expr(f"filter(transform(_v, (x, j) -> j * {1 << KEPT_BITS} + x), x -> x IS NOT NULL)"))
    orders = [probe(i) for i in range(BINS)]
    starts, backs = _array(b for _, b in orders), _array(pow(a, -1, BINS) for a, _ in orders)
    search = f"array_min(transform(_f, y -> (((shiftright(y, {KEPT_BITS}) - {starts}[i]) * {backs}[i]) & {BINS - 1}) * {1 << KEPT_BITS} + (y & {(1 << KEPT_BITS) - 1}))) & {(1 << KEPT_BITS) - 1}"
    tried = ", ".join(f"_v[{_array((a * t + b) % BINS for a, b in orders)}[i]]" for t in range(PROBES))
    dense = f"CASE WHEN size(_f) < {FEW} THEN transform(_v, (x, i) -> coalesce(x, {search})) ELSE transform(_v, (x, i) -> coalesce(x, {tried}, {search})) END"
    rows = rows.withColumn("_d", F.expr(dense))
    packed = f"transform(sequence(0, {BINS // WORD_BINS - 1}), k -> aggregate(slice(_d, k * {WORD_BINS} + 1, {WORD_BINS}), 0L, (a, x) -> shiftleft(a, {KEPT_BITS}) | x))"
    # _d is named twice so that its expression isn't moved into the lambda
    return rows.withColumn(into, F.expr(f"CASE WHEN size(_d) > 0 THEN {packed} END")).select(*columns, into)


def likeness(a: str, b: str) -> Column:
    """Estimated similarity (0 to 1) of two packed signatures; null if either is."""
    folded, step = f"zip_with({a}, {b}, (x, y) -> x ^ y)", KEPT_BITS // 2
    while step:  # any bit of a bin that differs sets the bin's lowest bit
        folded, step = f"transform({folded}, x -> x | shiftright(x, {step}))", step // 2
    ones = int(("0" * (KEPT_BITS - 1) + "1") * WORD_BINS, 2)
    differ = f"aggregate({folded}, 0, (n, x) -> n + bit_count(x & {ones}L))"
    chance = 1.0 / (1 << KEPT_BITS)
    return F.greatest(F.lit(0.0), (1 - F.expr(differ) / float(BINS) - chance) / (1 - chance))


def as_text(signature: str) -> Column:
    """The packed bins as hexadecimal digits, one for each bin."""
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def fingerprint(docs: DataFrame, text_col: str = "text", into: str = "fingerprint", size: int = SHINGLE) -> DataFrame:
    """docs with the fingerprint of a text column (null: empty)."""
    names = [c for c in docs.columns if c != into]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return with_signature(rows, "text", "sig", size).select("row.*", as_text("sig").alias(into))


def _edited(rows: DataFrame, size: int) -> DataFrame:
    """Of rows with text, next_text, sig, next_sig: the edited text's digest and signature, and both likenesses."""
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, length(text) - length(text) div 2), substring(next_text, 1, length(text) div 2))"))
    rows = with_signature(rows, "edited", "edited_sig", size)
    return rows.select("*", F.sha2("edited", 256).alias("edited_sha256"), likeness("sig", "edited_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"))


def with_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each document (integer ids).

    The edited text is the document's whose last half is replaced by as much (or all) of the next document's beginning.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("*", F.xxhash64("text").alias("h"))
    part = order_parts(rows, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.col("h"), part_count(rows))
    rows = with_signature(rows.withColumn("part", part), "text", "sig", size)
    order = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "h", "text")
    rows = rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in ("text", "sig")], F.lag("h").over(order).isNull().alias("first"))
    rows = _edited(rows.withColumn("last", F.col("next_text").isNull()), size)
    done = ["edited_sha256", "edited_sig", "near_edited", "near_next"]
    edge = F.when(F.col("first") | F.col("last"), F.col("text")).alias("text")
    rows = materialize(rows.select("part", "first", "last", "doc_id", F.length("text").cast("long").alias("n_chars"), "sig", *done, edge))
    # one row of each part: the first of the next part (after the last part: of the first one) follows its last row
    firsts = rows.filter("first").select("part", F.col("text").alias("next_text"), F.col("sig").alias("next_sig"))
    parts = firsts.select("part").withColumn("next_part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(0)))))
    lasts = rows.filter("last").drop(*done).join(parts, "part").join(firsts.withColumnRenamed("part", "next_part"), "next_part")
    result = ["doc_id", "n_chars", "sig", *done]
    found = rows.filter("NOT last").select(*result).unionByName(_edited(lasts, size).select(*result))
    return found.select("doc_id", "n_chars", "edited_sha256", as_text("sig").alias("fingerprint"), as_text("edited_sig").alias("edited_fingerprint"), "near_edited", "near_next")


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_neighbours(table(spark, sf_dir, "documents"))
