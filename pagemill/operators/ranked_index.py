"""A kept inverted index and ranked search by BM25 (ORD-04, refreshed as DED-05 says).

The index is a folder of tables that grow by segments; a refresh writes one segment for what changed. `documents` has the
documents of each segment (hash null: removed) with their terms, `postings` (term, id, tf), `counts` the change of each
term's number of documents, `blocks` the greatest frequency, the least length and the number of documents of each term in
each block of ids. Texts are split and counted within their row, in one pass.
A document's last segment counts, so older postings of a changed document are passed over by (id, segment).

Scores are whole millionths: the sum over the query's distinct terms of floor(10^6 * idf * tf part), so they don't depend on
the order of additions. Common terms (stop words) are not scored everywhere: with the n-th best score over the other terms
as the mark to reach, they are looked up only for documents, and in blocks, that can reach it by the blocks' maxima: a document
has its common terms' scores once, as an array by the term's place, and each query adds up its own places. Results are the
same as with all postings. Terms are runs of a-z and 0-9 in the lower-cased text; null texts have none; rows with a
null id are not indexed, of repeated ids the one with the greatest text counts.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.sources.files import exists
from pagemill.tables import materialize

K1, B = 1.2, 0.75
#: Blocks of ids; terms in more than this part of the documents are common.
BLOCKS, COMMON = 256, 0.05
#: Common terms that are looked up at once.
PLACES = 2048
_TERM = re.compile("[a-z0-9]+")
DOCUMENTS = "id {0}, hash string, length long, terms array<struct<term:string,tf:long>>, segment int"


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def _frequencies(texts: pa.Array) -> pa.Array:
    ends, lengths, names, counts = [0], [], [], []
    for text in texts.to_pylist():
        found = _TERM.findall(text) if text else ()
        tf = Counter(found)
        names += tf.keys()
        counts += tf.values()
        ends.append(len(names))
        lengths.append(len(found))
    pairs = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["term", "tf"])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
    return pa.StructArray.from_arrays([pa.array(lengths, pa.int64()), lists], ["length", "terms"])


def frequencies(lower: Column) -> Column:
    """length and terms (term, tf) of a text in lower case, counted within its row."""
    return F.arrow_udf(_frequencies, "length long, terms array<struct<term:string,tf:long>>")(lower)


def _placed(width: int):
    """Values (place, value) of a row as an array of so many places, null where there is none."""

    def placed(rows: pa.Array) -> pa.Array:
        ends = rows.offsets.to_numpy()
        given = rows.values.slice(ends[0], ends[-1] - ends[0])
        place, value = (given.field(i).to_numpy() for i in (0, 1))
        out, empty = np.zeros((len(rows), width), np.int32), np.ones((len(rows), width), bool)
        at = np.repeat(np.arange(len(rows)), np.diff(ends))
        out[at, place], empty[at, place] = value, False
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), pa.array(out.ravel(), mask=empty.ravel()))

    return F.arrow_udf(placed, "array<int>")


def block_of(id: Column) -> Column:
    return F.pmod(F.xxhash64(id), F.lit(BLOCKS)).cast("int")


def score(tf: Column, length: Column, idf: Column, mean: float, k1: float = K1, b: float = B) -> Column:
    """Millionths that a term with so many occurrences gives a document of a length."""
    return F.floor(F.lit(1e6) * idf * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)))).cast("long")


class RankedIndex:
    """The index in a folder; id_type is the type of its ids."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint"):
        self.spark, self.path, self.id_type = spark, path.rstrip("/"), id_type

    def _table(self, name: str, schema: str) -> DataFrame:
        if not self.segments():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").filter(F.col("segment").isin(self.segments()))

    def segments(self) -> list[int]:
        """Numbers of the finished segments: those whose documents, written last, were committed."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/documents")
        if not exists(self.spark, f"{self.path}/documents"):
            return []
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [str(x.getPath().getName()) for x in fs.listStatus(path)]
        found = sorted(int(m[1]) for n in names if (m := re.fullmatch(r"segment=(\d+)", n)))
        return [n for n in found if exists(self.spark, f"{self.path}/documents/segment={n}/_SUCCESS")]

    def documents(self) -> DataFrame:
        """The documents as they are now: id, hash, length, terms, segment."""
        rows = self._table("documents", DOCUMENTS.format(self.id_type))
        if len(self.segments()) < 2:  # a segment has an id once
            return rows.filter("hash IS NOT NULL")
        last = Window.partitionBy("id").orderBy(F.col("segment").desc())
        return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1 AND hash IS NOT NULL").drop("_n")

    def refresh(self, docs: DataFrame) -> dict[str, int]:
        """Make the index that of docs (id, text); the numbers of new, changed, removed and kept documents.

        Only new and changed texts are split into terms, and only these, with what they replace, are written.
        """
        number = max(self.segments(), default=0) + 1
        now = docs.filter("id IS NOT NULL").groupBy("id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text")).withColumn("new_hash", F.md5("text"))
        both = self.documents().select("id", "hash", F.col("terms.term").alias("old_terms")).join(now, "id", "full_outer")
        status = F.when(F.col("hash").isNull(), "new").when(F.col("new_hash").isNull(), "removed").when(F.col("hash") == F.col("new_hash"), "kept").otherwise("changed")
        both = both.select("id", status.alias("status"), "new_hash", "text", "old_terms")
        # one pass over the texts: those that are kept give a row without terms, to be counted
        fresh = both.withColumn("found", frequencies(F.when(F.col("status").isin("new", "changed"), F.lower("text"))))
        touched = materialize(fresh.select("id", "status", F.col("new_hash").alias("hash"), "found.length", "found.terms", F.when(F.col("status") != "kept", F.col("old_terms")).alias("old_terms")))
        counts = {r["status"]: r["count"] for r in touched.groupBy("status").count().collect()}
        result = {s: counts.get(s, 0) for s in ("new", "changed", "removed", "kept")}
        if not result["new"] + result["changed"] + result["removed"]:
            return result
        touched = touched.filter("status <> 'kept'")
        folder = lambda name: f"{self.path}/{name}/segment={number}"
        postings = touched.select("id", "length", F.explode("terms").alias("t")).select(F.col("t.term").alias("term"), "id", F.col("t.tf").alias("tf"), "length")
        postings.repartitionByRange(F.col("term"), F.col("id")).sortWithinPartitions("term", "id").write.mode("overwrite").parquet(folder("postings"))
        # read in the order of terms, a task has few terms' blocks
        written = self.spark.read.schema(postings.schema).parquet(folder("postings"))
        blocks = written.groupBy("term", block_of(F.col("id")).alias("block")).agg(F.max("tf").alias("most"), F.min("length").alias("least"), F.count(F.lit(1)).alias("n"))
        blocks.sortWithinPartitions("term").write.mode("overwrite").parquet(folder("blocks"))
        gone = touched.filter("old_terms IS NOT NULL").select(F.explode("old_terms").alias("term"), F.lit(-1).cast("long").alias("n"))
        change = self.spark.read.schema(blocks.schema).parquet(folder("blocks")).select("term", "n").unionByName(gone).groupBy("term").agg(F.sum("n").alias("n"))
        change.sortWithinPartitions("term").write.mode("overwrite").parquet(folder("counts"))
        touched.select("id", "hash", "length", "terms").write.mode("overwrite").parquet(folder("documents"))
        return result

    def search(self, queries: DataFrame, n: int = 5, common: float = COMMON) -> DataFrame:
        """(qid, id, score, rank) of the n best documents of each of queries (qid, text); ties by id."""
        live = materialize(self.documents().select("id", "length", "segment"))
        total, mean = live.agg(F.count(F.lit(1)), F.avg("length")).first()
        asked = queries.filter("qid IS NOT NULL").select("qid", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
        known = self._table("counts", "term string, n long, segment int").join(asked.select("term").distinct(), "term", "left_semi")
        df = known.groupBy("term").agg(F.sum("n").alias("df")).filter("df > 0")
        idf = F.log(1 + (F.lit(float(total)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        asked = materialize(asked.join(df, "term").select("qid", "term", idf.alias("idf"), (F.col("df") > common * total).alias("common")))
        mean = float(mean or 1.0) or 1.0
        postings = self._table("postings", "term string, id {}, tf long, length long, segment int".format(self.id_type))
        # postings of documents that a later segment changed or removed
        old = self._table("documents", DOCUMENTS.format(self.id_type)).select("id", "segment")
        old = materialize(old.join(live.select("id", "segment"), ["id", "segment"], "left_anti")) if len(self.segments()) > 1 else None
        current = lambda rows: rows if old is None else rows.join(old, ["id", "segment"], "left_anti")
        value = score(F.col("tf"), F.col("length"), F.col("idf"), mean)
        rare = asked.filter("NOT common").select("qid", "term", "idf")
        part = current(postings.join(rare, "term")).groupBy("qid", "id").agg(F.sum(value).alias("part"))
        part = materialize(part.withColumn("block", block_of(F.col("id"))))
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("part"), "id"))
        mark = part.withColumn("place", place).filter(F.col("place") == n).select("qid", F.col("part").alias("mark"))
        # the most that a query's common terms can add in a block
        stops = asked.filter("common").select("qid", "term", "idf")
        blocks = self._table("blocks", "term string, block int, most long, least long, segment int")
        best = blocks.join(stops, "term").groupBy("qid", "term", "block").agg(F.max(score(F.col("most"), F.col("least"), F.col("idf"), mean)).alias("bound"))
        bound = best.groupBy("qid", "block").agg(F.sum("bound").alias("bound")).join(mark, "qid", "left")
        bound = materialize(bound.select("qid", "block", "bound", F.coalesce("mark", F.lit(0)).alias("mark"), (F.col("bound") >= F.coalesce("mark", F.lit(0))).alias("whole")))
        # in blocks that can reach the mark by common terms alone every document is looked up, elsewhere those that can reach it
        able = materialize(part.join(bound, ["qid", "block"], "left").filter("bound IS NULL OR part + bound >= mark").select("qid", "id", "part", F.expr("bound IS NOT NULL AND NOT whole").alias("open")))
        whole = live.select("id", block_of(F.col("id")).alias("block")).join(bound.filter("whole").select("qid", "block"), "block")
        pairs = able.filter("open").select("qid", "id").unionByName(whole.select("qid", "id"))
        every = able.select("qid", "id", "part")
        # A term gives a document the same for each query. Common terms are few: at most a document's mean number of terms by `common`.
        words = [(r["term"], r["idf"]) for r in stops.select("term", "idf").distinct().orderBy("term").collect()]
        for first in range(0, len(words), PLACES):
            chosen = words[first : first + PLACES]
            places = F.broadcast(self.spark.createDataFrame([(t, x, i) for i, (t, x) in enumerate(chosen)], "term string, idf double, place int"))
            own = stops.select("qid", "term").join(places, "term").groupBy("qid").agg(F.collect_list("place").alias("places"))
            given = current(postings.join(places, "term")).groupBy("id").agg(F.collect_list(F.struct("place", value.cast("int").alias("value"))).alias("given"))
            given = given.select("id", _placed(len(chosen))(F.col("given")).alias("values"))
            sums = F.expr("aggregate(places, CAST(NULL AS bigint), (a, p) -> CASE WHEN values[p] IS NULL THEN a ELSE coalesce(a, 0L) + values[p] END)")
            every = every.unionByName(pairs.join(own, "qid").join(given, "id").select("qid", "id", sums.alias("part")).filter("part IS NOT NULL"))
        scores = every.groupBy("qid", "id").agg(F.sum("part").alias("score"))
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
        return scores.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= n)
