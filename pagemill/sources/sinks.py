"""Sinks (SNK-01 to SNK-11): all by Spark's commit protocol, so a failed write leaves no half table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.sources.files import exists
from pagemill.tables import discard, materialize


def write(df: DataFrame, path: str, rows_per_file: int = 0, mode: str = "overwrite") -> None:
    """SNK-01, SNK-02, SNK-03: fails on a table without rows, before writing."""
    if df.isEmpty():
        raise ValueError("no rows to write")
    writer = df.write.mode(mode)
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(path)


def append_missing(df: DataFrame, path: str, key: str) -> int:
    """SNK-04: append the rows whose key is not there yet, one for each key; their number. Running it again writes nothing.

    A null key is a key like any other: one row of it is written once. Of several rows of a key any one is. Only new rows are
    written out and counted; of the target only the key is read.
    """
    spark = df.sparkSession
    new = df.dropDuplicates([key])
    if exists(spark, path):
        known = spark.read.parquet(path).select(F.col(key).alias("_known"))
        new = new.join(known, new[key].eqNullSafe(known["_known"]), "left_anti")
    new = materialize(new)  # computed once: counted and appended
    found = new.count()
    if found or not exists(spark, path):
        new.write.mode("append").parquet(path)
    discard(new)
    return found


def merge_shards(spark, path: str, out: str, key: str) -> int:
    """SNK-05: shards as one table in order of key; 0 where there are none."""
    if not exists(spark, path):
        return 0
    rows = spark.read.parquet(path)
    rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.mode("overwrite").parquet(out)
    return rows.count()


def write_json(df: DataFrame, path: str) -> None:
    """SNK-06: one JSON document for each row."""
    df.write.mode("overwrite").json(path)


def manifest(rows: DataFrame, flag: str = "augmented") -> DataFrame:
    """SNK-06, AGG-12: counts of all, clean and augmented documents."""
    return rows.agg(F.count(F.lit(1)).alias("count"), F.count_if(~F.col(flag)).alias("clean"), F.count_if(flag).alias("augmented"))


def save_index(df: DataFrame, path: str) -> None:
    """SNK-07: the whole index anew; it must not be read from the same path."""
    df.write.mode("overwrite").parquet(path)


def write_templates(df: DataFrame, path: str) -> None:
    """SNK-08: templates and sidecar data by class folder."""
    df.write.mode("overwrite").partitionBy("class").parquet(path)


def output_name(cls, variant, number):
    """SNK-11: class_variant_0001."""
    return F.format_string("%s_%s_%04d", cls, variant, number)
