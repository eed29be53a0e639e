"""Shared helpers of the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.tables import discard, materialize  # noqa: F401 - used by the operators

#: Rows of one Arrow batch. Texts may be long, so batches stay small.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python stages of this session receive."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def held_out(doc_id) -> F.Column:
    """The rows that no training step may see: crc32 of the id's text, modulo 3, is 1 (null ids count as held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def chosen(rows: DataFrame, key: str, odds, *columns: str) -> DataFrame:
    """A sample for learning: the named columns of the least row of each key whose hash falls under odds.

    Null keys are left out and repeated ones count once, so the sample has at most odds times the rows on average,
    whatever the keys are. Rows come in the order of the keys' hashes.
    """
    chance = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    some = rows.filter(F.col(key).isNotNull() & (chance < odds))
    return some.groupBy(key).agg(F.min(F.struct(*columns)).alias("row")).orderBy(F.xxhash64(key), key).select("row.*")


def per_group(rows: DataFrame, key: str, order: list[str], function, schema: str) -> DataFrame:
    """Deal rows by key and call function(columns as a dict of lists) for runs of whole groups.

    function gets a pyarrow Table of one or more complete groups, sorted by key and order, and returns a dict of
    columns. Memory is bounded by the largest group, which callers bound by salting, plus one batch.
    """
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches):
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key)
            last = keys[batch.num_rows - 1].as_py()
            if held and held[-1].column(key)[0].as_py() == last and keys[0].as_py() == last:
                held.append(batch)
                continue
            start = _run_start(keys, last)
            if start:
                held.append(batch.slice(0, start))
            if held:
                yield from emit(function(pa.Table.from_batches(held)), names, out_schema)
            held = [batch.slice(start)]
        if held:
            yield from emit(function(pa.Table.from_batches(held)), names, out_schema)

    dealt = rows.repartition(F.col(key)).sortWithinPartitions(key, *order)
    out_schema = arrow_schema(rows.sparkSession, schema)
    return dealt.mapInArrow(run, schema)


def _run_start(keys, last) -> int:
    values = keys.to_numpy(zero_copy_only=False)
    other = np.flatnonzero(values != last)
    return int(other[-1]) + 1 if len(other) else 0


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def emit(columns, names, schema):
    if columns is not None and len(columns[names[0]]):
        yield pa.RecordBatch.from_arrays([pa.array(columns[n], type=schema.field(n).type) for n in names], schema=schema)


def mapped(df: DataFrame, function, ddl: str) -> DataFrame:
    """mapInArrow where function turns one RecordBatch into a dict of columns (or None)."""
    schema = arrow_schema(df.sparkSession, ddl)
    names = schema.names

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from emit(function(batch), names, schema)

    return df.mapInArrow(run, ddl)


def groups(values: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal values."""
    if not len(values):
        return []
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    edges = [0, *cuts.tolist(), len(values)]
    return list(zip(edges[:-1], edges[1:]))
