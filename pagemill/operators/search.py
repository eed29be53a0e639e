"""Search over documents (ORD-04, JOIN-10, PRJ-01 to PRJ-03, STR-21)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Words of queries that are broadcast.
MOST_WORDS = 200_000
#: Scores of documents by queries that a task sums up, on average.
TASK_SCORES = 1_000_000


def lexical_top(queries: DataFrame, docs: DataFrame, n: int = 5) -> DataFrame:
    """ORD-04: for each of queries (qid, text) the n documents (id, text) that share most distinct words; ties by id.

    Few queries (up to MOST_WORDS words in all, counted first) are broadcast, so texts stay where they are and only the ids
    with the words that are asked for move; more are met by an equi-join on words. Documents are dealt by id to as many tasks
    as their scores need, so a task's memory doesn't grow with the table, and each task ranks its own before the last rank.
    Rows of one id count as one document, each word once."""
    words = lambda frame, key: frame.select(key, F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))).alias("w")).filter("w != ''")
    asked = words(queries, "qid").distinct()
    seen = words(docs, "id")
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() * queries.count() // TASK_SCORES))
    if asked.limit(MOST_WORDS + 1).count() <= MOST_WORDS:
        seen = seen.join(F.broadcast(asked.select("w").distinct()), "w", "left_semi").repartition(tasks, "id").distinct()
        met = seen.join(F.broadcast(asked), "w")
    else:
        met = seen.distinct().join(asked, "w").repartition(min(tasks, 20_000), "id")
    scores = met.groupBy("qid", "id").agg(F.count(F.lit(1)).alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= n)


def known_paths(ranked: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """JOIN-10: the first n of a model's paths (array `paths`, best first) that exist."""
    rows = ranked.select(F.posexplode("paths").alias("pos", "path")).join(docs.select("path"), "path", "left_semi")
    return rows.orderBy("pos").limit(n)


def list_paths(docs: DataFrame, after: str = "", n: int = 0) -> DataFrame:
    """PRJ-03: paths of the index in order, from the one after a given path, at most n (all for 0): pages of a long listing."""
    out = docs.select("path").filter(F.col("path") > after).distinct().orderBy("path")
    return out.limit(n) if n else out


def index_rows(docs: DataFrame, number: str, name, wanted) -> DataFrame:
    """PRJ-01: number and filename of the documents that an index lists."""
    return docs.filter(wanted).select(F.col(number).alias("number"), name.alias("filename"))


def frequent(rows: DataFrame, key: str, least: int) -> DataFrame:
    """PRJ-15: keys of at least so many rows, with their number."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def details(index: DataFrame, filename: str) -> DataFrame:
    """PRJ-02: number and summary of each page of exactly one record."""
    found = index.filter(F.col("filename") == filename)
    n = found.limit(2).count()
    if n != 1:
        raise LookupError(f"{'no' if not n else 'more than one'} record of {filename!r}")
    return found.select("filename", F.posexplode(F.coalesce("page_summaries", F.array().cast("array<string>"))).alias("page", "summary"))


def catalog_text(docs: DataFrame) -> DataFrame:
    """STR-21: the text of a document's entry; entries are joined by blank lines where a prompt needs them."""
    return docs.select("path", F.concat_ws("\n", F.concat(F.lit("path: "), "path"), F.concat(F.lit("title: "), "title"), F.concat(F.lit("summary: "), "summary")).alias("entry"))
