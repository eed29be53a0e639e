"""Stages that fetch and render: pages over HTTP with a throttle and a cache, page images, page counts (SRC-10, SRC-11,
SRC-14, SRC-15, SNK-09, UDF-36). What touches the network or draws is a callable of the caller's."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.encoding import data_url, is_pdf
from pagemill.functions.pdf import page_count
from pagemill.plans.model_stages import run
from pagemill.sources.files import exists
from pagemill.sources.filings import INTERVAL, Slots
from pagemill.tables import materialize

def fetch(urls: DataFrame, get: Callable[[str], bytes], cache: str = "", interval: float = INTERVAL, partitions: int = 1) -> DataFrame:
    """SRC-10: (url, content, error) of distinct urls. What the cache (a Parquet folder) holds isn't asked for again; new
    contents are appended to it. The interval holds over all partitions, which ask in turn (slots of time), so partitions
    bounds the requests in flight only."""
    spark, wanted = urls.sparkSession, urls.select("url").distinct()
    known = spark.read.parquet(cache) if cache and exists(spark, cache) else spark.createDataFrame([], "url string, content binary")
    begin = time.time() + interval

    def asked_by_partition(frames):
        wait = Slots(begin, TaskContext.get().partitionId(), partitions, interval)
        for frame in frames:
            contents, errors = [], []
            for url in frame["url"]:
                wait()
                try:
                    contents.append(bytes(get(url)))
                    errors.append(None)
                except Exception as e:  # a failure is data here
                    contents.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield frame.assign(content=contents, error=errors)

    open_ = wanted.join(known.select("url"), "url", "left_anti").repartition(partitions)
    new = materialize(open_.mapInPandas(asked_by_partition, "url string, content binary, error string"))
    found = materialize(wanted.join(known.dropDuplicates(["url"]), "url").select("url", "content", F.lit(None).cast("string").alias("error")))
    if cache:
        new.filter("error IS NULL").select("url", "content").write.mode("append").parquet(cache)
    return found.unionByName(new)


def text_of(content: Column) -> Column:
    """UDF-36: bytes as UTF-8 text, what is no UTF-8 as replacement characters."""
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else bytes(x).decode("utf-8", "replace")), "string")(content)


def downloads(urls: DataFrame, get: Callable[[str], bytes], **how) -> DataFrame:
    """SRC-11: fetched files that are PDFs; the rest keeps its row with an error."""
    out = fetch(urls, get, **how)
    return out.withColumn("error", F.coalesce("error", F.when(~is_pdf(F.col("content")), F.lit("not a PDF")))).withColumn("content", F.when(F.col("error").isNull(), F.col("content")))


def page_counts(files: DataFrame, count: Callable[[bytes], int] = page_count) -> DataFrame:
    """SRC-15: files (path, content) with n_pages: of PDFs what their page tree has (or another probe says), 1 for images, null
    with an error where it fails."""
    probed = files.withColumn("pdf", is_pdf(F.col("content")))
    out = run(probed, lambda row: {"n_pages": int(count(bytes(row["content"]))) if row["pdf"] else 1}, "n_pages int")
    return out.drop("pdf")


def page_images(files: DataFrame, draw: Callable[[bytes, int], bytes], start: int = 0, end: int | None = None) -> DataFrame:
    """SRC-14: (path, page, image, data_url, error) of files (path, content, n_pages): pages from start up to end as a slice
    has it (negative ones count from the end). Only these are drawn; draw bounds size and bytes."""
    n = F.col("n_pages")
    at = lambda x: F.greatest(F.lit(0), F.least(n, n + x if x < 0 else F.lit(x)))
    first, stop = at(start), at(end) if end is not None else n
    pages = files.filter(first < stop).withColumn("page", F.explode(F.sequence(first, stop - 1)))
    out = run(pages, lambda row: {"image": bytes(draw(bytes(row["content"]), int(row["page"])))}, "image binary")
    return out.select("path", "page", "image", F.when(F.col("image").isNotNull(), data_url(F.col("image"))).alias("data_url"), "error")


#: What the engine says of a folder that holds no table it can read; any other failure is raised.
UNREADABLE = ("UNABLE_TO_INFER_SCHEMA", "CANNOT_READ_FILE_FOOTER", "FAILED_READ_FILE", "is not a Parquet file", "CANNOT_MERGE_SCHEMA")


def cached_stage(rows: DataFrame, key: str, stage: Callable[[DataFrame], DataFrame], cache: str) -> DataFrame:
    """SNK-09: the stage's result for rows whose key the cache (a Parquet folder) doesn't hold, appended to it, and the cache's
    for the others. A write is seen whole or not at all (Spark's commit).

    A missing cache is empty, and so is one whose files are no table: its folder is kept beside, under a name with
    `.unreadable-` and a number, and a new one begins. Any other failure to read (storage that doesn't answer) is raised,
    and the cache stays as it is. A null key is a key like any other.
    """
    spark = rows.sparkSession
    known = None
    if exists(spark, cache):
        try:
            known = spark.read.parquet(cache)
        except Exception as e:
            if not any(mark in str(e) for mark in UNREADABLE):
                raise
            _put_aside(spark, cache)
    same = lambda a, b: a[key].eqNullSafe(b["_held"])
    if known is None:
        new, held = materialize(stage(rows)), None
    else:
        keys = known.select(F.col(key).alias("_held")).distinct()
        new = materialize(stage(rows.join(keys, same(rows, keys), "left_anti")))
        asked = rows.select(F.col(key).alias("_held")).distinct()
        held = materialize(known.join(asked, same(known, asked), "left_semi"))
    new.write.mode("append").parquet(cache)
    return new if held is None else held.unionByName(new)


def _put_aside(spark, folder: str) -> None:
    """Renames a folder to the first free name with .unreadable-<number>."""
    path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(name)
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    n = 1
    while fs.exists(path(f"{folder.rstrip('/')}.unreadable-{n}")):
        n += 1
    if not fs.rename(path(folder), path(f"{folder.rstrip('/')}.unreadable-{n}")):
        raise OSError(f"{folder} can't be renamed")
