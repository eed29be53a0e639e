"""The tools that an agent calls over an index of documents (UDF-19): ask, find, preview."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators.preview import annotations
from pagemill.operators.search import known_paths
from pagemill.plans.model_stages import ask
from pagemill.plans.tools import Registry


class Context:
    """What the tools work on: documents (path, title, n_pages), pages (doc, page, width, height) and the models.

    rank: (query, catalog of documents) -> paths, best first; answer: a row with doc, first, stop and queries -> reply.
    """

    def __init__(self, documents: DataFrame, pages: DataFrame, rank: Callable, answer: Callable, save: Callable | None = None):
        self.documents, self.pages, self.rank, self.answer, self.save = documents, pages, rank, answer, save


def registry() -> Registry:
    tools = Registry()

    @tools.tool
    def ask_document(context, document_path: str, queries: list[str]) -> list:
        """Answers about one document, each with its place; queries that it doesn't answer are left out.

        Args:
            document_path: The document's path in the index.
            queries: Questions, or names of fields to read.
        """
        spark = context.documents.sparkSession
        own = context.documents.filter(F.col("path") == document_path).select(F.col("path").alias("doc"), "n_pages")
        if own.isEmpty():
            raise LookupError(f"no document {document_path!r}")
        asked = spark.createDataFrame([(document_path, queries)], "doc string, queries array<string>")
        found = ask(own, asked, context.answer, distinct=True).orderBy("index", "query", "value")
        return [{"query": r["query"], "value": r["value"], "box_2d": r["box_2d"], "meta": {"filename": document_path, "page": r["index"]}} for r in found.collect()]  # one document's answers

    @tools.tool
    def find_documents(context, query: str, n: int = 5) -> list:
        """Documents of the index that suit a description, best first.

        Args:
            query: What is looked for, in any words.
            n: Most documents.
        """
        spark = context.documents.sparkSession
        ranked = spark.createDataFrame([(list(context.rank(query, context.documents)),)], "paths array<string>")
        found = known_paths(ranked, context.documents, n).join(context.documents.select("path", "title"), "path").orderBy("pos")
        return [{"path": r["path"], "title": r["title"]} for r in found.collect()]  # n rows

    @tools.tool
    def visualize_answers(context, items: list, output_path: str) -> str:
        """Draws answers on the page of the first one and gives the picture's path.

        Args:
            items: Answers as ask_document gives them.
            output_path: Where the picture goes.
        """
        page, spark = items[0]["meta"]["page"], context.documents.sparkSession
        rows = [(x["meta"]["filename"], k, x["query"], x["value"], [v / 1000 for v in x["box_2d"]], x["meta"]["page"]) for k, x in enumerate(items) if x["meta"].get("page", 0) == page]
        drawn = annotations(spark.createDataFrame(rows, "doc string, pos int, query string, value string, box array<double>, page int"), context.pages)
        plan = [json.loads(r) for r in drawn.orderBy("pos").toJSON().collect()]  # the given items
        if context.save:
            context.save(plan, output_path)
        return output_path

    return tools
