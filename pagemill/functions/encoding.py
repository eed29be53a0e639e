"""Digests, keys, JSON: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill import schemas
from pagemill.functions.numeric import to_thousandths


def content_key(content: Column, name: Column) -> Column:
    """DED-03: six digits of the content's md5 and the base name."""
    return F.concat(F.substring(F.md5(content.cast("binary")), 1, 6), F.lit("_"), F.regexp_extract(name, "[^/]*$", 0))


def url_key(url: Column) -> Column:
    """ARR-08: twelve digits of the sha256."""
    return F.substring(F.sha2(url, 256), 1, 12)


def data_url(content: Column, mime: str = "image/png") -> Column:
    """ARR-09."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.regexp_replace(F.base64(content.cast("binary")), "\\s", ""))


def decode_pdf(cell: Column) -> Column:
    """SRC-13: bytes of a base64 cell or data URL; null unless they are a PDF."""
    content = F.try_to_binary(F.regexp_replace(F.substring_index(cell, ",", -1), "\\s", ""), F.lit("base64"))
    return F.when(is_pdf(content), content)


def is_pdf(content: Column) -> Column:
    """SRC-11: the magic number, after white space."""
    return F.regexp_replace(F.substring(F.hex(F.substring(content, 1, 64)), 1, 128), "^(?:20|0[9ABCD])+", "").startswith("25504446")


def make_target(answers: Column) -> Column:
    """ARR-01: answers as JSON text, boxes in thousandths."""
    part = lambda a: F.struct(a["query"].alias("query"), a["value"].alias("value"), to_thousandths(a["bounding_box"]).alias("box_2d"), a["index"].alias("index"))
    return F.to_json(F.transform(answers, part))


def parse_answers(text: Column) -> Column:
    """ARR-02: answers of JSON text, null where it is no array."""
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, schemas.PREDICTION))  # a lone object would be taken for one


def parse_tolerant(text: Column) -> tuple[Column, Column]:
    """ARR-03: (answers, error): no JSON gives no answers and an error, JSON of another kind no answers, non-objects go."""
    parsed = F.try_parse_json(text)
    items = F.from_json(F.when(F.schema_of_variant(parsed).startswith("ARRAY"), text), "array<string>")
    objects = F.filter(items, lambda x: F.ltrim(x).startswith("{"))
    answers = F.transform(objects, lambda x: F.from_json(x, "query string, value string, box_2d array<int>, index string"))
    return F.coalesce(answers, F.from_json(F.lit("[]"), "array<struct<query:string,value:string,box_2d:array<int>,index:string>>")), F.isnull(parsed)


def reindex(answers: Column, offset: Column) -> Column:
    """ARR-10: answers with page indices moved by offset."""
    return F.transform(answers, lambda a: a.withField("index", (a["index"] + offset).cast("int")))


def join_level(values: Column) -> Column:
    """ARR-05 for one level: values joined by commas without null and empty ones."""
    return F.array_join(F.filter(values, lambda x: x.isNotNull() & (x != "")), ", ")


def path_parts(path: Column) -> Column:
    """ARR-11: steps of a logical path (a, a.b, a[], a[].b): name and whether it is a list."""
    return F.transform(F.split(path, r"\."), lambda x: F.struct(F.regexp_replace(x, r"\[\]$", "").alias("name"), x.endswith("[]").alias("many")))
