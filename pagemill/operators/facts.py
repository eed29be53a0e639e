"""Tagged financial facts and aggregates over documents (JOIN-01, ARR-12, SRC-12, AGG-06 to AGG-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.numeric import with_canonical_values
from pagemill.functions.text import CATALOG_TYPES, humanize_qname


def resolve(facts: DataFrame, contexts: DataFrame, units: DataFrame) -> DataFrame:
    """JOIN-01: facts (fact_id, name, raw_text, scale, sign, format, context, unit) with period, members, measures and value;
    unknown contexts and units leave null and empty. Values that are no number go. Dimension tables join by size (AQE)."""
    rows = facts.join(contexts.select(F.col("id").alias("context"), "period", "members"), "context", "left").join(units.select(F.col("id").alias("unit"), "measures"), "unit", "left")
    empty = F.array().cast("array<string>")
    rows = rows.withColumn("members", F.coalesce("members", empty)).withColumn("measures", F.coalesce("measures", empty))
    rows = with_canonical_values(rows, *(F.col(c) for c in ("raw_text", "scale", "sign", "format", "measures")), drop=True)
    return rows.withColumn("concept", humanize_qname(F.col("name")))


def parse_inline_facts(pages: DataFrame, html: str = "html", key: str = "doc") -> DataFrame:
    """ARR-12: facts of inline XBRL text: one row for each nonFraction element with id and name, with the text before its
    first child."""
    found = F.regexp_extract_all(html, F.lit(r"(?s)<ix:nonFraction\b[^>]*>[^<]*"), F.lit(0))
    rows = pages.select(key, F.posexplode(found).alias("pos", "element"))
    attribute = lambda name: F.nullif(F.regexp_extract("element", rf"\b{name}=[\"']([^\"']*)[\"']", 1), F.lit(""))
    rows = rows.filter(attribute("id").isNotNull() & attribute("name").isNotNull())
    return rows.select(
        key, "pos", attribute("id").alias("fact_id"), attribute("name").alias("name"), attribute("contextRef").alias("context"), attribute("unitRef").alias("unit"),
        attribute("scale").alias("scale"), attribute("sign").alias("sign"), attribute("format").alias("format"), F.regexp_extract("element", "(?s)>([^<]*)$", 1).alias("raw_text"),
    )


def filings(submissions: DataFrame, forms: list[str], per_company: int) -> DataFrame:
    """SRC-12: submissions (cik, ticker, forms, accessions, documents, dates: parallel arrays) to the first filings of a form
    whose document is a web page, in the given order."""
    rows = submissions.select("cik", "ticker", F.posexplode(F.arrays_zip("forms", "accessions", "documents", "dates")).alias("pos", "x"))
    rows = rows.select("cik", "ticker", "pos", F.col("x.forms").alias("form"), F.col("x.accessions").alias("accession"), F.col("x.documents").alias("document"), F.col("x.dates").alias("filing_date"))
    rows = rows.filter(F.col("form").isin(*forms) & F.lower("document").rlike(r"\.html?$"))
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("cik").orderBy("pos"))).filter(F.col("rn") <= per_company)


def ticker_map(text: Column) -> Column:
    """SRC-12: upper-case ticker to ten-digit number, of an object of objects."""
    values = F.map_values(F.from_json(text, "map<string, struct<cik_str:string,ticker:string>>"))
    return F.map_from_entries(F.transform(values, lambda x: F.struct(F.upper(x["ticker"]), F.lpad(x["cik_str"], 10, "0"))))


def single_page_urls(rows: DataFrame, key: Column, at_most: int, limit: int, url: str = "url", pos: str = "pos") -> DataFrame:
    """AGG-06: urls of at most so many rows, one for each key, the first ones in order."""
    counts = rows.groupBy(url).agg(F.count(F.lit(1)).alias("n_rows"), F.min(pos).alias("pos")).filter(F.col("n_rows") <= at_most)
    firsts = counts.withColumn("key", key).groupBy("key").agg(F.min_by(F.struct(url, "n_rows", "pos"), "pos").alias("x"))
    out = firsts.select("key", F.col(f"x.{url}").alias(url), "x.n_rows", "x.pos").orderBy("pos")
    return out.limit(limit) if limit else out


def type_counts(rows: DataFrame, cls: str = "doc_type", known=CATALOG_TYPES) -> DataFrame:
    """AGG-07: documents of each type and whether the type is new to the vocabulary."""
    return rows.groupBy(cls).agg(F.count(F.lit(1)).alias("n")).withColumn("novel", ~F.col(cls).isin(*known))


def page_count(fields: DataFrame, doc: str = "doc") -> DataFrame:
    """AGG-09: pages of a document by its fields, 1 without pages."""
    return fields.groupBy(doc).agg(F.coalesce(F.max("page") + 1, F.lit(1)).alias("n_pages"))


def class_numbers(rows: DataFrame, cls: str = "cls", pos: str = "pos") -> DataFrame:
    """AGG-10: number of each row within its class from 0."""
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(cls).orderBy(pos)) - 1)


def tag_counts(rows: DataFrame, html: str, tags: tuple[str, ...]) -> DataFrame:
    """AGG-14: opened elements by tag over all texts, most first."""
    sums = rows.agg(*[F.sum(F.regexp_count(F.col(html), F.lit(f"(?i)<{t}[\\s>]"))).alias(t) for t in tags])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.col(t).cast("long").alias("n")) for t in tags])).alias("x")).select("x.*")


def status_counts(rows: DataFrame, status: Column) -> DataFrame:
    """AGG-11: rows by status."""
    return rows.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def rows_by_page(rows: DataFrame, value: str, doc: str = "doc", page: str = "page") -> DataFrame:
    """AGG-13: the values of each page of a document in order."""
    return rows.groupBy(doc, page).agg(F.array_sort(F.collect_list(value)).alias("items"))


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    """AGG-15, SET-05: a column's values, each once (nulls too)."""
    return rows.select(column).distinct()


def completeness(frame: DataFrame, wanted: list[str]) -> list[str]:
    """AGG-16: columns that are missing."""
    return [c for c in wanted if c not in frame.columns]


def repair_counts(repaired: DataFrame, counts: str = "counts") -> DataFrame:
    """AGG-14: bound elements of each kind over all pages, from the counts (JSON text) of the pages' repairs; most first."""
    each = repaired.select(F.explode(F.from_json(counts, "map<string, bigint>")).alias("tag", "n"))
    return each.groupBy("tag").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "tag")
