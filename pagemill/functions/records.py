"""Schemaless value records as VARIANT columns, read by logical paths: a, a.b, a[], a[].b, at any depth (ARR-11).

`[]` after a name says that the value is a list, whose elements become rows. Paths are given once for a table, so each step
is a column or one explode; nothing is parsed a second time.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = re.compile(r"[^.\[\]]+(?:\[\])*")


def steps(path: str) -> list[tuple[str, int]]:
    """Name and number of list levels of each step; a path of another form is an error."""
    parts = path.split(".")
    if not path or any(not STEP.fullmatch(p) for p in parts):
        raise ValueError(f"no logical path: {path!r}")
    return [(p.rstrip("[]"), p.count("[]")) for p in parts]


def parse(text: Column) -> Column:
    """Text as a record (VARIANT); null where it is no JSON."""
    return F.try_parse_json(text)


def _member(value: Column, name: str) -> Column:
    quoted = name.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(value, f"$['{quoted}']", "variant")


def values(rows: DataFrame, record: str, path: str, into: str = "value", place: str = "place") -> DataFrame:
    """rows with a row for each value that a record has at a path: the value (VARIANT) and its places in the lists passed.

    A record without the path has no row; a JSON null is a value. Where a list is due and there is none, there is no row.
    """
    names = rows.columns
    out = rows.withColumn(into, F.col(record)).withColumn(place, F.array().cast("array<int>"))
    for name, levels in steps(path):
        out = out.withColumn(into, _member(F.col(into), name)).filter(F.col(into).isNotNull())
        for _ in range(levels):
            kept = [*names, place]
            items = F.when(F.schema_of_variant(into).startswith("ARRAY"), F.col(into).cast("array<variant>"))
            out = out.select(*kept, F.posexplode(items).alias("_at", into))
            out = out.withColumn(place, F.concat(F.col(place), F.array("_at"))).drop("_at")
    return out


def text_of(value: Column) -> Column:
    """A scalar as text, containers as JSON; a JSON null is null."""
    return F.coalesce(F.try_variant_get(value, "$", "string"), F.when(~F.is_variant_null(value), F.to_json(value)))


def fields(rows: DataFrame, record: str, paths: list[str]) -> DataFrame:
    """rows with a column for each path without lists: the text of its value (null where there is none)."""
    out = rows
    for path in paths:
        if any(levels for _, levels in steps(path)):
            raise ValueError(f"{path!r} has a list; use values()")
        value = F.col(record)
        for name, _ in steps(path):
            value = _member(value, name)
        out = out.withColumn(path.replace(".", "_"), text_of(value))
    return out


def leaves(rows: DataFrame, record: str, key: str, most_depth: int = 64) -> DataFrame:
    """(key, path, places, value): every scalar of the records with its logical path, and empty containers as null.

    Containers are opened level by level until none is left; a level is one explode over what the level before left.
    Deeper ones than most_depth are an error, not a loss.
    """
    from pagemill.tables import materialize

    kind = F.schema_of_variant("v")
    open_ = rows.select(key, F.lit("").alias("path"), F.array().cast("array<int>").alias("places"), F.col(record).alias("v")).filter("v IS NOT NULL")
    found = None
    for _ in range(most_depth):
        level = materialize(open_.withColumn("kind", F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "list")))
        scalars = level.filter("kind IS NULL").select(key, "path", "places", text_of(F.col("v")).alias("value"))
        members = F.map_entries(F.col("v").cast("map<string, variant>"))
        objects = level.filter("kind = 'object'").select(key, "path", "places", F.explode_outer(members).alias("m"))
        lists = level.filter("kind = 'list'").select(key, "path", "places", F.posexplode_outer(F.col("v").cast("array<variant>")).alias("at", "v"))
        empty = objects.filter("m IS NULL").select(key, "path", "places", F.lit(None).cast("string").alias("value"))
        empty = empty.unionByName(lists.filter("at IS NULL").select(key, F.concat("path", F.lit("[]")).alias("path"), "places", F.lit(None).cast("string").alias("value")))
        here = scalars.unionByName(empty)
        found = here if found is None else found.unionByName(here)
        name = F.when(F.col("path") == "", F.col("m.key")).otherwise(F.concat_ws(".", "path", "m.key"))
        below = objects.filter("m IS NOT NULL").select(key, name.alias("path"), "places", F.col("m.value").alias("v"))
        open_ = below.unionByName(lists.filter("at IS NOT NULL").select(key, F.concat("path", F.lit("[]")).alias("path"), F.concat("places", F.array("at")).alias("places"), "v"))
        if level.filter("kind IS NOT NULL").isEmpty():
            return found
    raise ValueError(f"records are nested deeper than {most_depth}")
