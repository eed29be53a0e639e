"""What a preview draws, as rows: boxes, labels and colours of answers (SNK-12, AGG-13, WIN-08, MTH-16, UDF-25)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.numeric import pixel_rect
from pagemill.functions.text import truncate

#: Colours that repeat, and a label's most characters.
COLOURS, LABEL = 14, 80


def annotations(answers: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, page, pos, colour, label, rect) of answers (doc, pos, query, value, box, page) on pages (doc, page, width, height).

    A query's colour is its rank by first appearance in the document, modulo COLOURS; labels are cut to LABEL characters.
    Answers without a box of four numbers or without their page aren't drawn.
    """
    own = answers.withColumn("first", F.min("pos").over(Window.partitionBy("doc", "query")))
    ranked = own.withColumn("colour", (F.dense_rank().over(Window.partitionBy("doc").orderBy("first")) - 1) % COLOURS)
    drawn = ranked.filter(F.size("box") == 4).join(pages.select("doc", "page", "width", "height"), ["doc", "page"])
    label = truncate(F.concat_ws(": ", "query", "value"), LABEL - 2)
    return drawn.select("doc", "page", "pos", "colour", label.alias("label"), pixel_rect(F.col("box"), F.col("width"), F.col("height")).alias("rect"))


def boxes_per_page(answers: DataFrame) -> DataFrame:
    """AGG-13: number of answers with a box on each page."""
    return answers.filter(F.size("box") == 4).groupBy("doc", "page").agg(F.count(F.lit(1)).alias("n_boxes"))
