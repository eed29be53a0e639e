"""Stages on images: perceptual hashes (DED-02), whole files (PRJ-10), aged and warped pages (UDF-14, UDF-15), drawn boxes
(SNK-12, UDF-27). Files are decoded by the engine's image reader, PNG bytes in columns by the stages themselves; a page is
one row, and a batch holds a few pages.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import pixels
from pagemill.functions.rewriting import homography
from pagemill.plans.model_stages import run

#: Colours of boxes by rank, as many as a preview has.
PALETTE = tuple((37 + 83 * i % 211, 29 + 151 * i % 223, 41 + 197 * i % 199) for i in range(14))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, image) of the PNG and JPEG files in a folder, decoded by the engine; what it can't decode has no pixels."""
    return spark.read.format("image").load(path).select(F.col("image.origin").alias("path"), "image")


def _array(value: dict) -> np.ndarray | None:
    """Pixels of the engine's image: rows of blue, green, red (and transparency) or grey."""
    height, width, n = value["height"], value["width"], value["nChannels"]
    if height < 1 or width < 1 or not value["data"]:
        return None
    image = np.frombuffer(value["data"], np.uint8).reshape(height, width, n)
    return image if n == 1 else image[..., 2::-1]


def with_hash(rows: DataFrame, column: str = "image", into: str = "hash") -> DataFrame:
    """DED-02: rows with the 64-bit hash of an image column (the engine's image, or the bytes of a PNG file).

    The brightness, averaged over 32 x 32 fields, is transformed by cosines; a bit says whether one of the 64 lowest
    frequencies exceeds their median. Images of a batch are transformed at once. Null where there is no image to decode.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    raw = rows.schema[column].dataType.simpleString() == "binary"
    full = rows.withColumn(into, F.lit(None).cast("long")).schema
    schema = to_arrow_schema(full)

    def fields(value):
        if value is None:
            return None
        try:
            image = pixels.decode_png(bytes(value)) if raw else _array(value)
        except Exception:  # noqa: BLE001 - no decodable image
            return None
        return None if image is None else pixels.reduced(image)

    def stage(batches):
        for batch in batches:
            found = [fields(v.as_py()) for v in batch.column(column)]
            hashes: list[int | None] = [None] * len(found)
            for shape in {x.shape for x in found if x is not None}:
                at = [i for i, x in enumerate(found) if x is not None and x.shape == shape]
                for i, digest in zip(at, pixels.perceptual_hashes(np.stack([found[i] for i in at])).tolist()):
                    hashes[i] = digest
            column_of = pa.array(hashes, pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, column_of], schema=schema)

    return rows.mapInArrow(stage, full)


def faults(images: Column) -> Column:
    """PRJ-10: of an array of files why each can't be whole (null: it can); a null array is null."""
    check = lambda xs: None if xs is None else [pixels.image_fault(None if x is None else bytes(x)) for x in xs]
    return F.pandas_udf(lambda s: s.map(check), "array<string>")(images)


def whole(images: Column) -> Column:
    """PRJ-10: every image of the row is whole; false for a null array, true for an empty one."""
    return F.coalesce(F.forall(faults(images), lambda x: x.isNull()), F.lit(False))


def with_png(rows: DataFrame, draw: Callable[[dict], np.ndarray], into: str = "image") -> DataFrame:
    """UDF-27: rows with a PNG file of the array that draw gives for a row, and error."""
    return run(rows, lambda row: {into: pixels.encode_png(draw(row))}, f"{into} binary")


def aged_pages(pages: DataFrame) -> DataFrame:
    """UDF-14, UDF-15: pages (doc, page, image as PNG, profile, quality, geometric, geo_quality, seed) with image, matrix (the
    warp of the unit square, null without one), aug_ok and error; a page that fails stays as it was, with aug_ok false.

    The warp comes from seed and page alone, so boxes move by the same matrix (MTH-10) wherever they are.
    """

    def one(row: dict) -> dict:
        image, matrix = pixels.decode_png(bytes(row["image"])), None
        if row["geometric"]:
            height, width, _ = image.shape
            matrix = homography(f"{row['seed']}|{row['page']}", width, height, row["geo_quality"])
            image = pixels.warped(image, matrix)
        image = pixels.aged(image, row["profile"], row["quality"], f"{row['seed']}|{row['page']}")
        return {"changed": pixels.encode_png(image), "matrix": matrix}

    out = run(pages, one, "changed binary, matrix array<double>").withColumn("aug_ok", F.col("error").isNull())
    return out.withColumn("image", F.coalesce("changed", "image")).drop("changed")


def annotated_pages(pages: DataFrame, annotations: DataFrame) -> DataFrame:
    """SNK-12: pages (doc, page, image as PNG) with the boxes of annotations (doc, page, pos, colour, rect) drawn, and error.

    Boxes are drawn in order of pos; the boxes of a page come together in its row. Pages without boxes stay as they are.
    """
    order = F.struct("pos", F.col("rect.x0").alias("x0"), F.col("rect.y0").alias("y0"), F.col("rect.x1").alias("x1"), F.col("rect.y1").alias("y1"), "colour")
    boxes = annotations.groupBy("doc", "page").agg(F.sort_array(F.collect_list(order)).alias("boxes"))
    rows = pages.join(boxes, ["doc", "page"], "left")

    def one(row: dict) -> dict:
        if row["boxes"] is None or not len(row["boxes"]):
            return {"drawn": bytes(row["image"])}
        rects = [(b["x0"], b["y0"], b["x1"], b["y1"]) for b in row["boxes"]]
        return {"drawn": pixels.encode_png(pixels.with_boxes(pixels.decode_png(bytes(row["image"])), rects, [PALETTE[b["colour"] % len(PALETTE)] for b in row["boxes"]]))}

    out = run(rows, one, "drawn binary")
    return out.select(*[c for c in pages.columns if c != "image"], F.coalesce("drawn", "image").alias("image"), "error")
