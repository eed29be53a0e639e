"""Page windows (WIN-01 to WIN-09, AGG-04, AGG-05, JOIN-04, JOIN-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tiles(docs: DataFrame, size: int, doc: str = "doc", n: str = "n_pages") -> DataFrame:
    """WIN-01, WIN-05: (doc, first, last) of windows that don't overlap."""
    if size < 1:
        raise ValueError("a window has at least one page")
    rows = docs.filter(F.col(n) > 0).select(doc, n, F.explode(F.sequence(F.lit(0), F.col(n) - 1, F.lit(size))).alias("first"))
    return rows.select(doc, "first", F.least(F.col("first") + size - 1, F.col(n) - 1).alias("last"))


def serving_windows(docs: DataFrame, size: int = 3, stride: int = 1, doc: str = "doc", n: str = "n_pages") -> DataFrame:
    """WIN-03: a window from every stride-th page, shorter ones at the end."""
    rows = docs.filter(F.col(n) > 0).select(doc, n, F.explode(F.sequence(F.lit(0), F.col(n) - 1, F.lit(stride))).alias("first"))
    return rows.select(doc, "first", F.least(F.col("first") + size, F.col(n)).alias("stop"))


def document_windows(rows: DataFrame, budget: int = 3, stride: int = 2, cover_all: bool = False) -> DataFrame:
    """WIN-02: (doc, window, first, stop) over rows (doc, pos from 0, images): from every stride-th row as many rows as fit
    the budget of images (one at least), until a window reaches the end.

    A window stops at the last row with at most budget images between its start and it, which a range frame over the running
    total finds, so a document's rows are never gathered in one value. Rows may stay uncovered where a window is shorter
    than the stride; with cover_all, windows end at the next start at least.
    """
    by_pos = Window.partitionBy("doc").orderBy("pos")
    images = F.col("images").cast("long")
    before = F.coalesce(F.sum(images).over(by_pos.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    rows = rows.select("doc", "pos", "images", before.alias("before"))
    whole = Window.partitionBy("doc")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("total", F.sum(images).over(whole))
    reach = F.max("pos").over(Window.partitionBy("doc").orderBy("before").rangeBetween(0, budget))
    stop = F.when(F.col("total") - F.col("before") <= budget, F.col("n")).otherwise(F.col("reach"))
    rows = rows.withColumn("reach", reach).filter(F.col("pos") % stride == 0)
    rows = rows.withColumn("stop", F.least(F.col("n"), F.greatest(F.col("pos") + (stride if cover_all else 1), stop)).cast("int"))
    rows = rows.withColumn("earlier", F.lag("stop").over(by_pos)).filter("earlier IS NULL OR earlier < n")
    return rows.select("doc", F.floor(F.col("pos") / stride).cast("int").alias("window"), F.col("pos").cast("int").alias("first"), "stop")


def dense_pages(facts: DataFrame, more_than: int = 10) -> DataFrame:
    """AGG-08: pages with more than so many facts."""
    return facts.groupBy("doc", "page").agg(F.count(F.lit(1)).alias("n_facts")).filter(F.col("n_facts") > more_than)


def dense_windows(pages: DataFrame, core: int = 3, cap: int = 5) -> DataFrame:
    """WIN-04: (doc, first, last) over dense pages (doc, page, n_pages): runs of neighbours cut into cores, padded up to cap
    pages with pages after and before in turn (after first), without repeats."""
    by_page = Window.partitionBy("doc").orderBy("page")
    rows = pages.select("doc", "page", "n_pages").distinct().withColumn("island", F.col("page") - F.row_number().over(by_page))
    rows = rows.withColumn("k", F.floor((F.row_number().over(Window.partitionBy("doc", "island").orderBy("page")) - 1) / core))
    cores = rows.groupBy("doc", "island", "k", "n_pages").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    budget = F.lit(cap) - (F.col("b") - F.col("a") + 1)
    room_after, room_before = F.least(F.lit(3), F.col("n_pages") - 1 - F.col("b")), F.least(F.lit(3), F.col("a"))
    after = F.least(room_after, F.greatest(F.ceil(budget / 2), budget - room_before)).cast("int")
    cores = cores.withColumn("after", after).withColumn("before", F.least(room_before, budget - F.col("after")).cast("int"))
    return cores.select("doc", (F.col("a") - F.col("before")).cast("long").alias("first"), (F.col("b") + F.col("after")).cast("long").alias("last")).distinct()


def page_bounds(breaks: Column, total: Column, least: float = 50.0, fixed: float = 1123.0) -> Column:
    """WIN-06: page starts from sorted break positions: a break counts if it lies least below the last one that counted and
    least above the end; with fewer than two pages, starts of slices of fixed height."""
    step = lambda acc, y: F.when((y - F.element_at(acc, -1) >= least) & (y <= total - least), F.concat(acc, F.array(y.cast("double")))).otherwise(acc)
    found = F.aggregate(breaks, F.array(F.lit(0.0)), step)
    slices = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(total / fixed).cast("int")) - 1), lambda i: i * F.lit(float(fixed)))
    return F.when(F.size(found) >= 2, found).otherwise(slices)


def page_at(starts: Column, y: Column) -> Column:
    """JOIN-05: the last page that starts at or above y, the first page before any start."""
    return F.greatest(F.size(F.filter(starts, lambda s: s <= y)) - 1, F.lit(0))


def in_windows(windows: DataFrame, fields: DataFrame) -> DataFrame:
    """JOIN-04: fields (doc, page, ...) in each window (doc, first, last): windows are short, so their pages are exploded to
    an equi-join on (doc, page) rather than a range join."""
    return windows.withColumn("page", F.explode(F.sequence("first", "last"))).join(fields, ["doc", "page"])


def first_rank(rows: DataFrame, item: str = "query", doc: str = "doc", pos: str = "pos", cycle: int = 14) -> DataFrame:
    """WIN-08: (doc, item, color): the rank of a document's items by first appearance, modulo the number of colours."""
    firsts = rows.groupBy(doc, item).agg(F.min(pos).alias("first"))
    return firsts.select(doc, item, ((F.dense_rank().over(Window.partitionBy(doc).orderBy("first")) - 1) % cycle).cast("long").alias("color"))


def image_offsets(rows: DataFrame, doc: str = "doc", pos: str = "pos", images: str = "images") -> DataFrame:
    """WIN-09: rows with the number of images before them in their document."""
    before = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("first_image", F.coalesce(F.sum(images).over(before), F.lit(0)).cast("long"))


def ordered_distinct(rows: DataFrame, item: str = "query", doc: str = "doc", pos: str = "pos") -> DataFrame:
    """SET-03: (doc, items): a document's items in order of first appearance."""
    ordered = F.array_sort(F.collect_list(F.struct(pos, item)))
    return rows.groupBy(doc).agg(F.array_distinct(F.transform(ordered, lambda x: x[item])).alias("items"))


def top_facts(facts: DataFrame, keep: int = 20) -> DataFrame:
    """WIN-07: of rows (window, pos, name, period, value) the first of each (name, period, value), then per window values
    with a blank first, larger numbers first, in order."""
    from pagemill.functions.numeric import magnitude

    first = Window.partitionBy("window", "name", "period", "value").orderBy("pos")
    rows = facts.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")
    order = Window.partitionBy("window").orderBy((F.instr("value", " ") == 0).cast("int"), F.desc(magnitude(F.col("value"))), "pos")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def collapse(rows: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-04, AGG-05: one row for each key of VQA rows (keys, pos, page_start, page_end, n_images, queries, answers): ordered
    union of queries, answers with indices moved by the images before."""
    order = Window.partitionBy(*keys).orderBy("page_start", "pos")
    before = F.coalesce(F.sum("n_images").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("offset", before)
    moved = F.transform("answers", lambda a: a.withField("index", (a["index"] + F.col("offset")).cast("int")))
    sorted_ = F.array_sort(F.collect_list(F.struct("page_start", "pos", "page_end", "queries", moved.alias("answers"))))
    out = rows.groupBy(*keys).agg(sorted_.alias("p"), F.sum("n_images").alias("n_images"))
    part = lambda name: F.transform("p", lambda x: x[name])
    return out.select(
        *keys, "n_images", F.array_distinct(F.flatten(part("queries"))).alias("queries"), F.flatten(part("answers")).alias("answers"),
        F.element_at("p", 1)["page_start"].alias("page_start"), F.element_at("p", -1)["page_end"].alias("page_end"),
    )
