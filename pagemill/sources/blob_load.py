"""Many blobs into a content-addressed store by the executors (DED-03, DED-07): contents never pass the driver.

A data source writer: each task writes its rows' contents under a name of its own and renames them to their place, so a
blob is there whole or not at all, and tasks that run again or twice change nothing. The driver gets a count from each task.
"""

from __future__ import annotations

import os
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from hashlib import md5
from itertools import batched

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


#: Partitions of Spark's reader that a task reads.
READ_TOGETHER = 64
#: Blobs of a batch that a task hands on: so many bytes (and the last blob's), so many rows.
BATCH_BYTES, BATCH_ROWS = 16 << 20, 10_000


def blob_path(name: Column, content: Column) -> Column:
    """DED-03: the place of a blob: six digits of its md5, an underscore and its base name."""
    return F.concat(F.substring(F.md5(content), 1, 6), F.lit("_"), F.regexp_extract(name, "([^/]*)/*$", 1))


@dataclass
class Loaded(WriterCommitMessage):
    blobs: int
    added: int


def _open(root: str):
    """File system and folder of a URI; those that pyarrow knows (local, S3, GCS, HDFS with its client)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


class BlobWriter(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root, self.job = root.rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Loaded:
        from pyarrow import fs as kinds

        fs, root = _open(self.root)
        staged = posixpath.join(root, "_tmp", self.job)
        fs.create_dir(staged, recursive=True)
        blobs = added = 0
        for batch in iterator:
            for name, content in zip(batch.column("name"), batch.column("content")):
                if name.as_py() is None or content.as_py() is None:
                    raise ValueError("a blob needs a name and a content")
                data, base = content.as_py(), posixpath.basename(name.as_py().rstrip("/"))
                path = posixpath.join(root, f"{md5(data).hexdigest()[:6]}_{base}")
                blobs += 1
                if fs.get_file_info(path).type == kinds.FileType.NotFound:
                    own = posixpath.join(staged, uuid.uuid4().hex)
                    with fs.open_output_stream(own) as out:
                        out.write(data)
                    fs.move(own, path)
                    added += 1
        return Loaded(blobs, added)

    def _clean(self) -> None:
        fs, root = _open(self.root)
        fs.delete_dir_contents(posixpath.join(root, "_tmp", self.job), missing_dir_ok=True)
        fs.delete_dir(posixpath.join(root, "_tmp", self.job)) if fs.get_file_info(posixpath.join(root, "_tmp", self.job)).type.name == "Directory" else None

    def commit(self, messages: list) -> None:
        """Removes what tasks that failed left, and notes how many blobs came."""
        self._clean()
        fs, root = _open(self.root)
        fs.create_dir(posixpath.join(root, "_meta"), recursive=True)
        with fs.open_output_stream(posixpath.join(root, "_meta", "last_load")) as out:
            out.write(f"{sum(m.blobs for m in messages if m)} {sum(m.added for m in messages if m)}".encode())

    def abort(self, messages: list) -> None:
        """Blobs that are in place stay (they are whole, and the next try finds them); parts go."""
        self._clean()


class Blobs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blob_store"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> BlobWriter:
        return BlobWriter(self.options["path"])


def load_blobs(rows: DataFrame, root: str) -> tuple[int, int]:
    """DED-07: write the blobs (name, content) to the store at root; how many rows came and how many blobs were new.

    Rows without name or content are an error, and so is a path the executors don't share. Equal rows are one blob.
    """
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(Blobs)
    rows.select("name", "content").write.format("blob_store").mode("append").option("path", root).save()
    fs, base = _open(root.rstrip("/"))
    with fs.open_input_stream(posixpath.join(base, "_meta", "last_load")) as f:
        blobs, added = f.read().split()
    return int(blobs), int(added)


def _contents(root: str, batches: Iterator) -> Iterator:
    """Batches of (path, content) for batches of paths; as they are, also where a name ends in .gz."""
    import pyarrow as pa

    fs, base = _open(root)
    names, contents, held = [], [], 0
    for batch in batches:
        for name in batch.column(0).to_pylist():
            with fs.open_input_stream(posixpath.join(base, name), compression=None) as f:
                contents.append(f.read())
            names.append(name)
            held += len(contents[-1])
            if held >= BATCH_BYTES or len(names) >= BATCH_ROWS:
                yield pa.record_batch({"path": pa.array(names, pa.string()), "content": pa.array(contents, pa.binary())})
                names, contents, held = [], [], 0
    if names:
        yield pa.record_batch({"path": pa.array(names, pa.string()), "content": pa.array(contents, pa.binary())})


def _names(root: str, batches: Iterator) -> Iterator:
    """Batches of the names of a store's blobs; a local folder is never held whole."""
    import pyarrow as pa
    from pyarrow import fs as kinds

    for _ in batches:
        fs, base = _open(root)
        if isinstance(fs, kinds.LocalFileSystem):
            found = (x.name for x in os.scandir(base) if x.is_file())
        else:
            found = (x.base_name for x in fs.get_file_info(kinds.FileSelector(base)) if x.is_file)
        for names in batched(filter(re.compile("[0-9a-f]{6}_").match, found), BATCH_ROWS):
            yield pa.record_batch({"path": pa.array(names, pa.string())})


def get_blobs(paths: DataFrame, root: str) -> DataFrame:
    """(path, content) for each row of paths (path), so of a blob as often as it is asked for; a missing one is an error.

    The tasks that hold the paths read them, a batch of at most BATCH_BYTES and one blob at a time; nothing is listed.
    """
    return paths.select("path").mapInArrow(partial(_contents, root.rstrip("/")), "path string, content binary")


def read_blobs(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all blobs of a store, each once, empty ones, too; listed and read by the executors.

    One task lists the folder and sends the names on, batch by batch, to those that read. Only where pyarrow doesn't know the
    file system, Spark's reader does it; the driver lists the folder then.
    """
    try:
        _open(root.rstrip("/"))
    except (ValueError, OSError):
        return _read_by_spark(spark, root.rstrip("/"))
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = spark.range(0, 1, 1, 1).mapInArrow(partial(_names, root.rstrip("/")), "path string")
    return get_blobs(names.repartition(tasks, "path"), root)


def _read_by_spark(spark: SparkSession, root: str) -> DataFrame:
    """The folder is listed as one path: a path for each blob would be listed by a job of its own, whose tasks send it all back.

    The reader puts only a few small files into a partition, so each task takes READ_TOGETHER of them one after the other. It
    leaves out empty files, which all have one md5.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"{'[0-9a-f]' * 6}_*").load(root)
    tasks = max(spark.sparkContext.defaultParallelism, found.rdd.getNumPartitions() // READ_TOGETHER)
    found = found.coalesce(tasks).select(F.regexp_extract("path", "([^/]*)$", 1).alias("path"), "content")
    empty = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{md5(b'').hexdigest()[:6]}_*")
    listed = empty.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(empty) or []
    names = [(x.getPath().getName(),) for x in listed if x.isFile() and x.getLen() == 0]
    return found.unionByName(spark.createDataFrame(names, "path string").withColumn("content", F.lit(b"")))
