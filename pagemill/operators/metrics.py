"""Metrics of predicted answers (AGG-01, AGG-02, JOIN-06, JOIN-07). Rows are (doc, pos, query, value, box, index)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.numeric import iou
from pagemill.functions.text import norm, strip


def document_metrics(truth: DataFrame, predicted: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """doc, n_gt, n_pred, tp, precision, recall, f1, iou_sum, iou_n of each document of either side (and of documents).

    The i-th prediction of a (query, value) takes the i-th truth of it; a missing index is page 0. Both sides move once, by
    document: ranks, pairs and sums are made where a document's rows are. Documents without answers score 0.
    """
    side = lambda rows, s: rows.select("doc", F.lit(s).alias("side"), F.coalesce(norm(F.col("query")), F.lit("")).alias("q"), F.coalesce(norm(F.col("value")), F.lit("")).alias("v"), "pos", "box", F.coalesce("index", F.lit(0)).cast("long").alias("index"))
    rows = side(truth, 0).unionByName(side(predicted, 1))
    if documents is not None:
        rows = rows.unionByName(documents.select("doc").distinct().withColumn("side", F.lit(2)), allowMissingColumns=True)
    rows = rows.repartition("doc").withColumn("rank", F.row_number().over(Window.partitionBy("doc", "side", "q", "v").orderBy("pos")))
    of = lambda s: F.max(F.when(F.col("side") == s, F.struct("box", "index")))
    both = rows.groupBy("doc", "q", "v", "rank").agg(of(0).alias("t"), of(1).alias("p"))
    hit = F.col("t").isNotNull() & F.col("p").isNotNull()
    boxed = hit & (F.col("t.index") == F.col("p.index")) & (F.size("p.box") == 4)
    out = both.groupBy("doc").agg(
        F.count("t").alias("n_gt"), F.count("p").alias("n_pred"), F.count_if(hit).alias("tp"),
        F.sum(F.when(boxed, iou(F.col("t.box"), F.col("p.box")))).alias("iou_sum"), F.count_if(boxed).alias("iou_n"),
    )
    p = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0)
    r = F.when(F.col("n_gt") > 0, F.col("tp") / F.col("n_gt")).otherwise(0.0)
    out = out.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.withColumn("f1", f1)


def macro_metrics(per_document: DataFrame) -> DataFrame:
    """One row: mean F1 over documents, mean overlap over matched pairs (0 without any)."""
    return per_document.agg(
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f1_exact_match"), F.coalesce(F.sum("iou_sum") / F.nullif(F.sum("iou_n"), F.lit(0)), F.lit(0.0)).alias("iou"), F.count(F.lit(1)).alias("n_docs"),
    )


def key_metrics(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """The older metric: per key the last prediction counts, keys without case, values with case; nothing is used up."""
    last = predicted.withColumn("k", F.lower(strip(F.col("query"))))
    last = last.withColumn("rn", F.row_number().over(Window.partitionBy("doc", "k").orderBy(F.desc("pos")))).filter("rn = 1")
    met = truth.withColumn("k", F.lower(strip(F.col("query")))).join(last.select("doc", "k", strip(F.col("value")).alias("p_value")), ["doc", "k"], "left")
    gt = met.groupBy("doc").agg(F.count(F.lit(1)).alias("n_gt"), F.count_if(strip(F.col("value")) == F.col("p_value")).alias("tp"))
    out = gt.join(predicted.groupBy("doc").agg(F.count(F.lit(1)).alias("n_pred")), "doc", "full_outer").fillna(0)
    p, r = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0), F.when(F.col("n_gt") > 0, F.col("tp") / F.col("n_gt")).otherwise(0.0)
    return out.select("doc", "n_gt", "n_pred", "tp", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))
