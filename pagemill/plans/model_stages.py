"""Stages that call a model, renderer or image tool (UDF-01 to UDF-34).

A stage is a function of an iterator of Arrow batches; run() maps it over partitions and gives every row a column error:
what fails for a row is told there and never ends the job. deterministic() is the stand-in for tests: its answers come
from the md5 of the input. A caller brings real clients; they are made inside the task, once for each partition, and
the number of partitions bounds the requests in flight.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from pagemill.functions.encoding import parse_answers, reindex
from pagemill.functions.text import normalize_label
from pagemill.operators.windows import serving_windows
from pagemill.tables import materialize


def run(rows: DataFrame, call: Callable[[dict], dict], schema: str, partitions: int = 0) -> DataFrame:
    """UDF-01, UDF-34: rows with the columns of schema (from call, for a row as a dict) and error.

    A row's values are plain Python ones: null is None in any column, arrays are lists, structs dicts, binary is bytes. A
    result that doesn't fit its column is that row's error.
    """
    kept, wanted = rows.columns, StructType.fromDDL(schema)
    full = StructType([*rows.schema.fields, *wanted.fields, StructField("error", StringType())])
    types = to_arrow_schema(full)
    names = wanted.fieldNames()

    def fits(value, kind) -> bool:
        try:
            pa.array([value], kind)
        except (pa.ArrowException, TypeError, ValueError, OverflowError):
            return False
        return True

    def stage(batches):
        for batch in batches:
            found, nothing = [], dict.fromkeys([*names, "error"])
            for row in batch.to_pylist():
                try:
                    answer = nothing | call(row)
                    if wrong := [n for n in names if answer[n] is not None and not fits(answer[n], types.field(n).type)]:
                        raise TypeError(f"result of another type: {', '.join(wrong)}")
                    found.append(answer)
                except Exception as e:  # a row's failure is data here
                    found.append(nothing | {"error": f"{type(e).__name__}: {e}"})
            more = [pa.array([f[n] for f in found], types.field(n).type) for n in [*names, "error"]]
            yield pa.RecordBatch.from_arrays([c.cast(types.field(n).type) for n, c in zip(kept, batch.columns)] + more, schema=types)

    rows = rows.repartition(partitions) if partitions else rows
    return rows.select(*kept).mapInArrow(stage, full)


def deterministic(name: str) -> Callable[[dict], str]:
    """A stand-in model: text that depends on the input alone."""
    return lambda row: f"{name}:{md5(repr(sorted((k, str(v)) for k, v in row.items())).encode()).hexdigest()[:12]}"


def summarize(pages: DataFrame, page_call, document_call) -> DataFrame:
    """UDF-03, UDF-04: pages (path, page, text) to (path, summary, pages): each page once, then each document once."""
    by_page = materialize(run(pages, page_call, "page_summary string"))  # read twice below, called once
    docs = by_page.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page", "page_summary"))).alias("pages"), F.first("error", ignorenulls=True).alias("page_error"))
    docs = docs.withColumn("prompt", F.array_join(F.transform("pages", lambda p: F.coalesce(p["page_summary"], F.lit(""))), "\n"))
    out = materialize(run(docs.select("path", "prompt", "page_error"), document_call, "summary string"))
    return out.join(docs.select("path", "pages"), "path").select("path", "summary", "pages", F.coalesce("error", "page_error").alias("error"))


def classify(docs: DataFrame, call, allowed: list[str] | None = None) -> DataFrame:
    """UDF-06: docs with label: normalised, other if outside the list."""
    out = run(docs, call, "raw_label string").withColumn("label", normalize_label(F.col("raw_label")))
    return out.withColumn("label", F.when(F.col("label").isin(*allowed), F.col("label")).otherwise("other")) if allowed else out


def ask(documents: DataFrame, queries: DataFrame, call, size: int = 3, stride: int = 1, distinct: bool = False) -> DataFrame:
    """UDF-12, WIN-03, ARR-10: answers (doc, query, value, box_2d, index) over windows of documents (doc, n_pages)."""
    windows = serving_windows(documents, size, stride).join(queries, "doc")
    replies = run(windows, call, "reply string")
    answers = replies.withColumn("a", reindex(F.coalesce(parse_answers(F.col("reply")), F.from_json(F.lit("[]"), "array<struct<query:string,value:string,box_2d:array<int>,index:int>>")), F.col("first")))
    out = answers.select("doc", F.explode("a").alias("a")).select("doc", "a.*")
    return out.dropDuplicates(["doc", "query", "value", "index"]) if distinct else out


def first_success(slots: DataFrame, attempts: int, call, schema: str) -> DataFrame:
    """UDF-24: for each slot the first of so many attempts that succeeds (call sees its number as attempt); slots without one
    are left out. The attempts are made in the slot's task, one after another, none after a success."""

    def tried(row: dict) -> dict:
        for attempt in range(attempts - 1):
            try:
                return call(row | {"attempt": attempt}) | {"attempt": attempt}
            except Exception:  # noqa: S112 - the next attempt is the answer; the last one's failure is told
                continue
        return call(row | {"attempt": attempts - 1}) | {"attempt": attempts - 1}

    return run(slots, tried, f"{schema}, attempt int").filter("error IS NULL")


def staged(docs: DataFrame, steps: list[tuple[str, Callable[[dict], dict], str]]) -> DataFrame:
    """UDF-23, UDF-32, UDF-33: steps in a chain; a row that fails keeps the status of its step and skips the rest."""
    out = docs.withColumn("status", F.lit(None).cast("string"))
    for name, call, schema in steps:
        safe = lambda row, call=call: {} if row["status"] else call(row)
        done = run(out, safe, schema)
        out = done.withColumn("status", F.coalesce("status", F.when(F.col("error").isNotNull(), F.lit(name)))).drop("error")
    return out.withColumn("status", F.coalesce("status", F.lit("saved")))


def emit_variants(answers: DataFrame, variants: DataFrame) -> DataFrame:
    """UDF-42, JOIN-11: a window's one result for every variant (doc, variant, n_pages) that has its pages."""
    return answers.join(variants, "doc").filter(F.col("last") < F.col("n_pages"))


def conversation(n_images, prompt, target):
    """UDF-22: user turn with images first, assistant turn with the target."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    images = F.transform(F.sequence(F.lit(1), F.greatest(n_images, F.lit(1))), lambda i: part("image", i.cast("string")))
    user = F.struct(F.lit("user").alias("role"), F.concat(F.slice(images, F.lit(1), n_images), F.array(part("text", prompt))).alias("content"))
    return F.array(user, F.struct(F.lit("assistant").alias("role"), F.array(part("text", target)).alias("content")))
