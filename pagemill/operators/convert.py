"""Rows of labelled pages to VQA rows (PRJ-04 to PRJ-10, SET-01, JOIN-02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import strip


def valid_box(box: Column) -> Column:
    """Four doubles, or null."""
    cast = F.transform(box, lambda x: x.try_cast("double"))
    return F.when((F.size(cast) == 4) & F.forall(cast, lambda x: x.isNotNull()), cast)


def convert_rows(rows: DataFrame) -> DataFrame:
    """PRJ-04: pages with key-value pairs to VQA rows; rows without image, pairs or any usable answer go."""
    usable = F.filter("kvps", lambda k: (strip(k["key"]) != "") & valid_box(k["bounding_box"]).isNotNull())
    answer = lambda k: F.struct(strip(k["key"]).alias("query"), F.coalesce(k["value"], F.lit("")).alias("value"), valid_box(k["bounding_box"]).alias("bounding_box"), F.lit(0).alias("index"))
    page = F.coalesce(F.col("page_number").try_cast("int"), F.lit(0))
    out = rows.filter(F.col("image").isNotNull() & (F.size("kvps") > 0)).withColumn("answers", F.transform(usable, answer)).filter(F.size("answers") > 0)
    return out.select(
        F.array("image").alias("images"), F.array_distinct(F.transform("answers", lambda a: a["query"])).alias("queries"), "answers", F.col("hash_name").alias("source"),
        F.lit("original").alias("variant"), page.alias("page_start"), page.alias("page_end"), F.coalesce("split", F.lit("")).alias("split"),
    )


def fields_to_rows(fields: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """PRJ-05, PRJ-06: fields (doc, pos, name, value, page, n_pages) to (doc, queries, n_answers); blank values and pages out
    of range go. With a selection (doc, name, query) only its names stay, under its queries."""
    rows = fields.filter((strip(F.col("value")) != "") & (F.col("page") >= 0) & (F.col("page") < F.col("n_pages")))
    rows = rows.withColumn("query", F.col("name")) if selection is None else rows.join(selection, ["doc", "name"])
    agg = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "query", "value", "page"))).alias("a"))
    return agg.select("doc", F.array_distinct(F.transform("a", lambda x: x["query"])).alias("queries"), F.transform("a", lambda x: F.struct(x["query"].alias("query"), x["value"].alias("value"), x["page"].alias("index"))).alias("answers"))


def assemble(proposals: DataFrame, fields: DataFrame, unanswerable: int = 2) -> DataFrame:
    """PRJ-07, PRJ-08: a model's proposals (window, qpos, query, refs) checked against fields (window, ref, pos, value, page):
    unknown refs go, of repeated refs the first and of repeated fields the last counts, values come from the fields; queries
    without answers go but for the first few that had no refs."""
    last = Window.partitionBy("window", "ref").orderBy(F.desc("pos"))
    known = fields.withColumn("rn", F.row_number().over(last)).filter("rn = 1").select("window", "ref", "value", "page")
    asked = proposals.select("window", "qpos", "query", F.posexplode(F.array_distinct("refs")).alias("apos", "ref"))
    answered = asked.join(known, ["window", "ref"]).select("window", "qpos", "query", "apos", "ref", "value", "page")
    by_window = Window.partitionBy("window").orderBy("qpos")
    none = proposals.filter(F.size("refs") == 0).withColumn("rn", F.row_number().over(by_window)).filter(F.col("rn") <= unanswerable)
    return answered.unionByName(none.select("window", "qpos", "query"), allowMissingColumns=True)


def single_page(evidence: Column) -> Column:
    """PRJ-11: the answer's evidence is on one page."""
    return F.coalesce(F.size(evidence) == 1, F.lit(False))


def of_kinds(language: Column, kind: Column, kinds: tuple[str, ...], wanted: str = "en") -> Column:
    """PRJ-11: a document of a language and of one of some kinds."""
    return F.coalesce((language == wanted) & kind.isin(*kinds), F.lit(False))


def union_checked(*frames: DataFrame, optional: tuple[str, ...] = ("split",)) -> DataFrame:
    """SET-01: frames with the first one's columns in any order; optional columns may be missing, others and other types not."""
    first = frames[0]
    want = {f.name: f.dataType.simpleString() for f in first.schema}
    out = first
    for frame in frames[1:]:
        have = {f.name: f.dataType.simpleString() for f in frame.schema}
        missing, wrong = set(want) - set(have) - set(optional), [c for c in have if c in want and have[c] != want[c]]
        if missing or wrong:
            raise ValueError(f"missing columns {sorted(missing)}, other types {sorted(wrong)}")
        for c in set(optional) & set(want) - set(have):
            frame = frame.withColumn(c, F.lit(None).cast(want[c]))
        out = out.unionByName(frame.select(*want))
    return out
