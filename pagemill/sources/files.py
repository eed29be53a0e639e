"""Sources: tables, files, sidecars, template pools (SRC-01 to SRC-17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.encoding import is_pdf
from pagemill.functions.text import STORE_EXTENSIONS, discover_fields, extension, file_parts, uncalled_method


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """SRC-01, SRC-02, SRC-03: a Parquet table; columns are pruned and filters pushed by the plan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def template_rows(rows: DataFrame) -> DataFrame:
    """SRC-05: a missing schema is empty, a missing class unknown."""
    return rows.withColumn("schema", F.coalesce("schema", F.array().cast("array<string>"))).withColumn("class", F.coalesce("class", F.lit("unknown")))


def walk(spark: SparkSession, root: str, extensions=STORE_EXTENSIONS) -> DataFrame:
    """SRC-06: path, content of files below root with one of the extensions, in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.filter(extension(F.col("path")).isin(*extensions)).select("path", "modificationTime", "length", "content")


def discover(files: DataFrame, sidecars: DataFrame, variants=("clear", "phone_photo")) -> DataFrame:
    """SRC-07: (cls, number, variants map) of files (path) named by the grammar, of wanted variants, with a sidecar (stem)."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    cls, variant, number = file_parts(stem)
    rows = files.select("path", stem.alias("stem"), cls.alias("cls"), variant.alias("variant"), number.alias("number")).filter(F.col("variant").isin(*variants))
    rows = rows.join(sidecars.select("stem"), "stem", "left_semi")
    return rows.groupBy("cls", "number").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("variant", "path")))).alias("variants"))


def sidecars(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """SRC-08: (good, bad) rows of JSON files, one document each; bad ones with their text."""
    texts = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    rows = texts.withColumn("doc", F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    broken = F.col("doc._corrupt").isNotNull() | F.col("doc").isNull()
    good = rows.filter(~broken).select("doc.*", "path").drop("_corrupt")
    return good, rows.filter(broken).select("path", F.col("value").alias("_corrupt"))


def index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-09: an index file, empty where there is none."""
    return spark.read.schema(schema).option("multiLine", "true").json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def index_map(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """SRC-09, map form: (path, doc) of a JSON object of documents by path."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"path string, doc {value_schema}")
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{value_schema}>")).alias("path", "doc"))


def pdfs(files: DataFrame) -> DataFrame:
    """SRC-11: files whose content is a PDF."""
    return files.filter(is_pdf(F.col("content")))


def template_pool(templates: DataFrame, sidecar_stems: DataFrame, classes: DataFrame, min_fields: int = 3) -> tuple[DataFrame, DataFrame]:
    """SRC-16: (pool, missing classes) of templates (class, stem, html): listed classes, with sidecar, enough fields, no
    uncalled mapping method."""
    rows = templates.join(classes.select("class").distinct(), "class", "left_semi").join(sidecar_stems, "stem", "left_semi")
    rows = rows.filter(~uncalled_method(F.col("html"))).withColumn("fields", discover_fields(F.col("html"))).filter(F.size("fields") >= min_fields)
    return rows, classes.select("class").distinct().join(templates.select("class"), "class", "left_anti")
