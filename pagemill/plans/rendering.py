"""Rendered documents and where their fields are (UDF-13 to UDF-17, UDF-27 to UDF-31, UDF-38, UDF-39).

Drawing is the caller's: a callable for each step. What is here is what the steps agree on: boxes of elements, pages, boxes
under a page's warp, which result counts when a step fails.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import schemas
from pagemill.functions.numeric import page_box, warp_box
from pagemill.functions.rewriting import homography
from pagemill.operators.windows import page_at
from pagemill.plans.model_stages import run

#: Names of the pixel profiles.
PROFILES = ("clean_scan", "phone_photo", "old_photocopy", "fax")
FIELDS = f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in schemas.FIELD.split(', '))}>>"


def render(docs: DataFrame, draw: Callable[[dict], dict]) -> DataFrame:
    """UDF-13: docs with pdf, fields (one for each occurrence: name, value, page, box) and error."""
    return run(docs, draw, f"pdf binary, fields {FIELDS}")


def field_rows(rendered: DataFrame) -> DataFrame:
    """UDF-13: a row for each occurrence of a field, in the document's order."""
    return rendered.select("doc", F.posexplode("fields").alias("pos", "f")).select("doc", "pos", "f.*")


def field_value(control: Column, inner: Column, content: Column) -> Column:
    """UDF-28: a form control's value, else the text shown, else the text content, else empty."""
    some = lambda x: F.nullif(x, F.lit(""))
    return F.coalesce(some(control), some(inner), some(content), F.lit(""))


def element_boxes(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """UDF-17: (doc, id, page, box) of elements (doc, id, hidden, x, y, width, height, children) on pages (doc, starts, width,
    heights). A box without extent is the union of its children's (x, y, width, height); hidden ones and those without any
    extent go. The page is the last one that starts at or above the box, and the box is relative to it."""
    sized = F.filter("children", lambda c: (c["width"] > 0) & (c["height"] > 0))
    own = (F.col("width") > 0) & (F.col("height") > 0)
    edge = lambda f, part: f(F.transform("sized", part))
    rows = elements.filter("NOT hidden").withColumn("sized", F.when(own, F.array(F.struct("x", "y", "width", "height"))).otherwise(sized)).filter(F.size("sized") > 0)
    rows = rows.withColumn("x0", edge(F.array_min, lambda c: c["x"])).withColumn("y0", edge(F.array_min, lambda c: c["y"]))
    rows = rows.withColumn("x1", edge(F.array_max, lambda c: c["x"] + c["width"])).withColumn("y1", edge(F.array_max, lambda c: c["y"] + c["height"]))
    rows = rows.select("doc", "id", "x0", "y0", "x1", "y1").join(pages.select("doc", "starts", F.col("width").alias("page_width"), "heights"), "doc")
    rows = rows.withColumn("page", page_at(F.col("starts"), F.col("y0")).cast("int"))
    box = page_box(F.array("x0", "y0", "x1", "y1"), F.lit(0.0), F.get("starts", F.col("page")), F.col("page_width"), F.get("heights", F.col("page")))
    return rows.select("doc", "id", "page", box.alias("box"))


def augmented(docs: DataFrame, change: Callable[[dict], bytes], warp: Callable[[dict, list], bytes] | None = None) -> DataFrame:
    """UDF-14, UDF-15, UDF-16, UDF-39: docs (doc, pdf, fields, profile, quality, geometric, seed, n_pages, ...) with pdf and
    fields after an optional warp of each page and a change of pixels, aug_ok and error. A failed step leaves the clean
    document with aug_ok false. Pixels leave boxes as they are; a warp moves each page's boxes by its matrix, and its fields
    come by page. An unknown profile is an error."""

    def steps(row: dict) -> dict:
        if row["profile"] not in PROFILES:
            raise ValueError(f"unknown profile {row['profile']!r}")
        pdf, matrices = row["pdf"], None
        if warp is not None and row["geometric"]:
            matrices = [homography(f"{row['seed']}|{page}", 1000, 1414, row["quality"]) for page in range(int(row["n_pages"]))]
            pdf = warp(row, matrices)
        return {"new_pdf": bytes(change(row | {"pdf": pdf})), "matrices": matrices}

    out = run(docs, steps, "new_pdf binary, matrices array<array<double>>").withColumn("aug_ok", F.col("error").isNull())
    moved = F.transform("fields", lambda f: f.withField("bbox", warp_box(f["bbox"], F.get(F.col("matrices"), f["page"]))))
    by_page = F.transform(F.array_sort(F.transform(moved, lambda f, i: F.struct(f["page"].alias("page"), i.alias("i"), f.alias("f")))), lambda s: s["f"])
    fields = F.when(F.col("aug_ok") & F.col("matrices").isNotNull(), by_page).otherwise(F.col("fields"))
    return out.withColumn("fields", fields).withColumn("pdf", F.when(F.col("aug_ok"), F.col("new_pdf")).otherwise(F.col("pdf"))).drop("new_pdf", "matrices")


def joined_pages(docs: DataFrame, bind: Callable[[list[bytes]], bytes]) -> DataFrame:
    """UDF-27, UDF-29: docs (doc, images) with pdf and error; no images are an error."""

    def one(row: dict) -> dict:
        images = [] if row["images"] is None else [bytes(x) for x in row["images"]]
        if not images:
            raise ValueError("no images")
        return {"pdf": bytes(bind(images))}

    return run(docs, one, "pdf binary")


def first_pages(files: DataFrame, draw: Callable[[bytes], bytes | None]) -> DataFrame:
    """UDF-30: files (path, content) with image (null where there is no page) and error."""

    def one(row: dict) -> dict:
        image = draw(bytes(row["content"]))
        return {"image": None if image is None else bytes(image)}

    return run(files, one, "image binary")


def client_of(makers: dict[str, Callable[[], object]]) -> Callable[[str], object]:
    """UDF-31: a function from a backend's name to its client, made once in each process; unknown names are an error."""

    @lru_cache(maxsize=None)
    def client(name: str):
        if name not in makers:
            raise ValueError(f"unknown backend {name!r}; known: {sorted(makers)}")
        return makers[name]()

    return client


def whole_number(x: Column) -> Column:
    """UDF-38: a whole number, 0 where it is none."""
    return F.coalesce(x.try_cast("int"), F.lit(0))


def with_split(rows: DataFrame, value: str) -> DataFrame:
    """UDF-38: rows with a column split: their own, else the value."""
    return rows if "split" in rows.columns else rows.withColumn("split", F.lit(value))
