"""Importance resampling to a target distribution, by inverted postings of feature buckets.

Each text's features (runs of words) are counted by bucket once and written. The counts are turned into postings (bucket,
document, count), shuffled by part of the buckets; a part of common buckets would be one large group, so a part's postings
are dealt to several keys as blocks of many documents. Both corpora's sums of a bucket, added up before the shuffle, meet by
bucket and give its gain; a part's gains (a few hundred numbers) go to each of its keys and are joined to the blocks there,
which emit their documents' contributions. These are added up by document. Draws without replacement are the highest scores
with Gumbel noise of the id's hash; ranks are found in parts that follow the scores.

Null and empty texts have no words: no feature, weight 0, never drawn with min_words above 0. Null ids are hashed as an
empty text and come last in ties. Repeated rows each get a row and a rank. Very long texts are read word by word; a document
is one row with a count for each bucket it has, at most `buckets`. Empty tables give no rows; an empty target has no counts.
Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.common import arrow_schema, mapped, materialize, prepare, table
from pagemill.llm.ordering import order_parts, part_count

BUCKETS, NGRAM, PERCENT, SEED, MIN_WORDS = 10_000, 1, 10, 2024, 20
#: Parts of the buckets; a document gives at most so many contributions.
PARTS = 16
#: Texts of more characters are read word by word, others as one list.
LONG = 1 << 20
#: Features whose buckets a task remembers.
KNOWN = 200_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def runs(text: str | None, ngram: int):
    """All runs of 1 to ngram consecutive words, joined by one space."""
    text = (text or "").translate(LOWER)
    words = WORD.findall(text) if len(text) <= LONG else (m[0] for m in WORD.finditer(text))
    if ngram == 1:
        yield from words
        return
    last: deque = deque(maxlen=ngram)
    for word in words:
        last.append(word)
        for k in range(len(last)):
            yield " ".join(list(last)[k:])


def n_words(n_features: Column, ngram: int) -> Column:
    """Words of a text with so many runs: n words have n + (n - 1) + ... runs; with one word a run they are the same."""
    if ngram == 1:
        return n_features
    short = F.floor((F.sqrt(8 * n_features + 1) - 1) / 2)
    return F.when(n_features <= ngram * (ngram + 1) // 2, short).otherwise((n_features + ngram * (ngram - 1) // 2) / ngram).cast("long")


def counted(docs: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, and the buckets (ascending) and counts of each text."""
    known: dict[str, int] = {}

    def bucket(feature: str) -> int:
        found = known.get(feature)
        if found is None:
            if len(known) >= KNOWN:
                known.clear()
            found = known[feature] = zlib.crc32(feature.encode("utf-8", "surrogatepass")) % buckets
        return found

    def run(batch):
        ends, n, of, counts = [0], [], [], []
        for text in batch.column("text").to_pylist():
            here: dict[int, int] = {}
            total = 0
            for feature, c in Counter(runs(text, ngram)).items():
                b = bucket(feature)
                here[b] = here.get(b, 0) + c
                total += c
            order = sorted(here)
            of += order
            counts += [here[b] for b in order]
            ends.append(len(of))
            n.append(total)
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (of, counts)]
        return {"doc_id": batch.column("doc_id"), "n_features": n, "bucket": lists[0], "count": lists[1]}

    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return mapped(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_features long, bucket array<int>, count array<int>")


def bucket_sums(rows: DataFrame, name: str, buckets: int) -> DataFrame:
    """bucket and the sum of its counts, under a name; a task adds up what it reads before the shuffle."""
    schema = arrow_schema(rows.sparkSession, "bucket int, n long")

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(total, _flat(batch, "bucket"), _flat(batch, "count").astype(np.int64))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], schema=schema)

    return rows.select("bucket", "count").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def _flat(batch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def gains(rows: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, s, t, gain of each bucket that either corpus has: at most `buckets` rows."""
    both = materialize(bucket_sums(rows, "s", buckets).join(bucket_sums(target, "t", buckets), "bucket", "full_outer").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")))
    s, t = both.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    ratio = ((F.col("t") + 1).cast("double") * float(s + buckets)) / ((F.col("s") + 1).cast("double") * float(t + buckets))
    return both.withColumn("gain", F.floor(1000 * F.log(ratio)).cast("long"))


def postings(rows: DataFrame, parts: int, deals: int) -> DataFrame:
    """Blocks of postings: part of the buckets, deal, the documents' uids, and of each posting document (place in uids), bucket
    and count. A block has the postings of one part from one batch of documents."""

    def run(batch):
        uids = batch.column("uid").to_numpy()
        lists = batch.column("bucket")
        bucket, count = _flat(batch, "bucket"), _flat(batch, "count")
        doc = np.repeat(np.arange(len(uids), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
        order = np.argsort(bucket % parts, kind="stable")
        cuts = np.searchsorted((bucket % parts)[order], np.arange(parts + 1))
        out: dict[str, list] = {n: [] for n in ("part", "deal", "uids", "doc", "bucket", "count")}
        for p in range(parts):
            at = order[cuts[p] : cuts[p + 1]]
            if len(at):
                docs, doc_at = np.unique(doc[at], return_inverse=True)
                for name, x in (("part", p), ("deal", zlib.crc32(int(uids[0]).to_bytes(8, "little")) % deals), ("uids", uids[docs]), ("doc", doc_at.astype(np.int32)), ("bucket", bucket[at]), ("count", count[at])):
                    out[name].append(x)
        return out

    return mapped(rows.select("uid", "bucket", "count"), run, "part int, deal int, uids array<long>, doc array<int>, bucket array<int>, count array<int>")


def contributions(blocks: DataFrame, gained: DataFrame, parts: int, deals: int) -> DataFrame:
    """uid, weight: what each block's buckets give its documents."""
    by_part = gained.groupBy((F.col("bucket") % parts).alias("part")).agg(F.sort_array(F.collect_list(F.struct("bucket", "gain"))).alias("g"))
    by_part = by_part.select("part", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"), F.col("g.bucket").alias("known"), F.col("g.gain").alias("gain"))
    met = blocks.join(by_part.hint("merge"), ["part", "deal"])

    def run(batch):
        uids, weights = [], []
        for i in range(batch.num_rows):
            own, doc, bucket, count, known, gain = (batch.column(n)[i].values.to_numpy(zero_copy_only=False) for n in ("uids", "doc", "bucket", "count", "known", "gain"))
            total = np.zeros(len(own), np.int64)
            np.add.at(total, doc, gain[np.searchsorted(known, bucket)] * count)
            uids.append(own)
            weights.append(total)
        return {"uid": np.concatenate(uids), "weight": np.concatenate(weights)}

    return mapped(met.select("uids", "doc", "bucket", "count", "known", "gain"), run, "uid long, weight long")


def weights(docs: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight: the sum of the gains of each document's features; every row of docs has one."""
    rows = materialize(counted(docs, ngram, buckets, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()))
    wanted = counted(target.withColumn("_none", F.lit(None).cast("long")), ngram, buckets, "_none", target_col)
    gained = gains(rows, wanted, buckets)
    deals = max(1, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // PARTS)
    given = contributions(postings(rows, PARTS, deals), gained, PARTS, deals)
    base = rows.select("uid", "doc_id", "n_features", F.lit(0).cast("long").alias("weight"))
    every = base.unionByName(given, allowMissingColumns=True).groupBy("uid")
    return every.agg(F.max("doc_id").alias("doc_id"), F.max("n_features").alias("n_features"), F.sum("weight").alias("weight")).drop("uid")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, ngram: int = NGRAM, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null where it isn't drawn (integer ids)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    rows = materialize(weights(docs, target, ngram, buckets, id_col, text_col, target_col).withColumn("score", F.col("weight") + noise))
    able = n_words(F.col("n_features"), ngram) >= min_words
    ready = rows.filter(able)
    part = order_parts(ready, -F.col("score"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), part_count(rows))
    order = Window.partitionBy("part").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    placed = materialize(ready.withColumn("part", part).withColumn("place", F.row_number().over(order)))
    # the rows of a part are counted, the parts before it added up: as many numbers as there are parts
    before = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("all"))
    rank = F.col("before") + F.col("place")
    ranked = placed.join(F.broadcast(before), "part").withColumn("rank", F.when(rank <= F.floor(percent * F.col("all") / 100), rank).cast("long"))
    out = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*out, "rank").unionByName(rows.filter(~able).select(*out, F.lit(None).cast("long").alias("rank")))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql() -> str:
    code = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(x) // 2), lambda k: 16 * (instr('0123456789ABCDEF', x[2 * k + 1]) - 1) + instr('0123456789ABCDEF', x[2 * k + 2]) - 1)), lambda c, b: {step})"
    step = "xor(c, b)"
    for _ in range(8):  # one bit of the byte at a time, by the checksum's polynomial
        step = f"list_transform([{step}], lambda z: xor(z >> 1, (z & 1) * 3988292384))[1]"
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    ratio = f"((coalesce(t, 0) + 1)::DOUBLE * (SELECT sum(s) + {BUCKETS} FROM source)::DOUBLE) / ((s + 1)::DOUBLE * (SELECT sum(t) + {BUCKETS} FROM wanted)::DOUBLE)"
    hexed = f"('0x' || substr(sha256('{SEED}:' || doc_id::VARCHAR), 1, 8))::BIGINT"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
dw AS (SELECT doc_id, unnest(w) AS word FROM d),
bw AS (SELECT unnest({words}) AS word FROM benchmark),
coded AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw))),
bucket AS (SELECT word, xor({code.format(step=step)}, 4294967295) % {BUCKETS} AS b FROM coded),
source AS (SELECT b, count(*) AS s FROM dw JOIN bucket USING (word) GROUP BY b),
wanted AS (SELECT b, count(*) AS t FROM bw JOIN bucket USING (word) GROUP BY b),
gain AS (SELECT b, CAST(floor(1000 * ln({ratio})) AS BIGINT) AS g FROM source LEFT JOIN wanted USING (b)),
weighed AS (SELECT doc_id, sum(g) AS weight FROM dw JOIN bucket USING (word) JOIN gain USING (b) GROUP BY doc_id),
scored AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln(({hexed} + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weighed USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {PERCENT} * n // 100 THEN r END AS rank FROM scored LEFT JOIN placed USING (doc_id)"""


SQL = _sql()
