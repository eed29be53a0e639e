"""Stages that make templates, values, queries and catalog entries with a model, and check what it says (UDF-07 to UDF-11,
PRJ-09, STR-09). The model is a callable of a row; everything around the call is expressions."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.numeric import selection_band, uniform
from pagemill.functions.text import fenced, mechanical_query, merge_templates, strip
from pagemill.operators.windows import tiles
from pagemill.plans.model_stages import run
from pagemill.tables import materialize

#: Pages that a model sees at once when it makes a template.
CHUNK_PAGES = 8


def catalog_entries(docs: DataFrame, call: Callable[[dict], str], schema: str) -> tuple[DataFrame, DataFrame]:
    """UDF-07: (entries, failures) of documents (path, n_images, ...): the reply's JSON object by schema with source_path, and
    n_pages as the reply says, else the images sent. No images, no JSON object: a failure with path and error."""

    def asked(row: dict) -> dict:
        if not row["n_images"]:
            raise ValueError("no pages")
        return {"reply": call(row)}

    replies = materialize(run(docs, asked, "reply string"))
    block = fenced(F.col("reply"))
    entry = F.from_json(block, f"{schema}, n_pages int")
    read = replies.withColumn("entry", F.when(F.ltrim(block).startswith("{") & F.try_parse_json(block).isNotNull(), entry))
    good = read.filter("error IS NULL AND entry IS NOT NULL").select(F.col("path").alias("source_path"), F.coalesce("entry.n_pages", F.col("n_images").cast("int")).alias("n_pages"), F.col("entry").dropFields("n_pages").alias("entry"))
    bad = read.filter("error IS NOT NULL OR entry IS NULL").select("path", F.coalesce("error", F.lit("the reply is no JSON object")).alias("error"))
    return good.select("source_path", "n_pages", "entry.*"), bad


def make_templates(docs: DataFrame, call: Callable[[dict], dict], size: int = CHUNK_PAGES) -> DataFrame:
    """UDF-08: (doc, html, fields, error) of documents (doc, n_pages): a call for each run of size pages (it gives html and
    fields), merged in order of pages. A document with a failed run has the error alone."""
    parts = run(tiles(docs, size), call, "html string, fields array<string>")
    own = parts.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("first", "html", "fields"))).alias("chunks"), F.max("error").alias("error"))
    merged = own.withColumn("t", F.when(F.col("error").isNull(), merge_templates(F.transform("chunks", lambda c: F.struct(c["html"].alias("html"), c["fields"].alias("fields"))))))
    return merged.select("doc", "t.html", "t.fields", "error")


def random_values(slots: DataFrame, call: Callable[[dict], str]) -> DataFrame:
    """UDF-09: slots with values (JSON text of an object) and error: the reply's fenced block, else the reply."""

    def asked(row: dict) -> dict:
        return {"reply": call(row)}

    block = fenced(F.col("reply"))
    valid = F.ltrim(block).startswith("{") & F.try_parse_json(block).isNotNull()
    out = run(slots, asked, "reply string").withColumn("values", F.when(valid, block))
    return out.withColumn("error", F.coalesce("error", F.when(F.col("values").isNull(), F.lit("the reply is no JSON object")))).drop("reply")


def selected_queries(fields: Column, proposals: Column, fmt: Column, seed: Column) -> Column:
    """UDF-10: of an array of fields and a model's proposals (array of struct<field, query>) the (field, query) pairs that
    count: known fields, the first proposal of each, in the model's order, at most the band's upper end; below its lower end
    further fields come in order of a hash of the seed, with mechanical queries. Structured names are taken verbatim."""
    lo, hi = selection_band(F.size(fields))
    verbatim = fmt == "structured_field_name"
    known = F.filter(proposals, lambda p: F.array_contains(fields, p["field"]) & (verbatim | (F.coalesce(strip(p["query"]), F.lit("")) != "")))
    names = F.slice(F.array_distinct(F.transform(known, lambda p: p["field"])), F.lit(1), hi)
    first = lambda name: F.get(F.filter(known, lambda p: p["field"] == name), F.lit(0))["query"]
    chosen = F.transform(names, lambda n: F.struct(n.alias("field"), F.when(verbatim, n).otherwise(strip(first(n))).alias("query")))
    left = F.array_except(fields, names)
    shuffled = F.transform(F.array_sort(F.transform(left, lambda f: F.struct(uniform(seed, f).alias("u"), f.alias("f")))), lambda s: s["f"])
    more = F.slice(shuffled, F.lit(1), F.greatest(F.lit(0), lo - F.size(names)))
    return F.concat(chosen, F.transform(more, lambda f: F.struct(f.alias("field"), mechanical_query(f, fmt).alias("query"))))


def generate_queries(rows: DataFrame, call: Callable[[dict], str]) -> DataFrame:
    """UDF-10, UDF-11: rows (fields, fmt, seed, ...) with selected (array of field and query) and error (no JSON object)."""

    def asked(row: dict) -> dict:
        reply = json.loads(call(row))
        if not isinstance(reply, dict):
            raise ValueError("the reply is no JSON object")
        return {"proposals": [{"field": x.get("field"), "query": x.get("query")} for x in reply.get("selected") or [] if isinstance(x, dict)]}

    out = run(rows, asked, "proposals array<struct<field:string,query:string>>")
    return out.withColumn("selected", F.when(F.col("error").isNull(), selected_queries(F.col("fields"), F.col("proposals"), F.col("fmt"), F.col("seed")))).drop("proposals")


def window_rows(windows: DataFrame, images: DataFrame) -> DataFrame:
    """PRJ-09: windows (slug, window, first, last) with all their page images (slug, page, image) in order of pages, and the
    source slug_number; windows with a missing page go, and numbers count what is left."""
    pages = windows.withColumn("page", F.explode(F.sequence("first", "last"))).join(images.select("slug", "page", "image"), ["slug", "page"])
    whole = pages.groupBy("slug", "window", "first", "last").agg(F.array_sort(F.collect_list(F.struct("page", "image"))).alias("p")).filter(F.size("p") == F.col("last") - F.col("first") + 1)
    number = F.row_number().over(Window.partitionBy("slug").orderBy("window")) - 1
    return whole.select("slug", "window", "first", "last", F.transform("p", lambda x: x["image"]).alias("images"), F.concat_ws("_", "slug", number.cast("string")).alias("source"))
