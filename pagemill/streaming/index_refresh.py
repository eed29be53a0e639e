"""The refresh of an index as a stream with state: listings of files come in, changes of the index go out (DED-04, DED-05).

A listing row says that a file was there at a time, with its content's hash. The state of a file is its last hash and time; a
timer removes it when the watermark passes a time in which it wasn't listed. Changes are applied batch by batch to a table
whose versions are named by batch, so a batch that runs again writes the same version from the same one before it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: The state of transformWithState lies in RocksDB.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "filename string, hash string, status string, ms bigint"


class Refresh(StatefulProcessor):
    """Rows (filename, hash, ms: time in milliseconds) of one file to its changes: new, changed, removed; what stays the same gives none."""

    def __init__(self, gone_after_ms: int):
        self.gone_after_ms = gone_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "hash string, ms bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = self.last.get()
        last = None if last is None else (last[0], last[1])
        known, before = last, last[0] if last else None
        # rows of a batch in order of time, of equal times by hash; older ones than the last known say nothing new
        found = sorted((r["ms"], r["hash"]) for r in rows if r["ms"] >= timerValues.getCurrentWatermarkInMs())
        for ms, digest in found:
            if known is None or ms >= known[1]:
                known = (digest, ms)
        if known is not None and found:
            # each call goes to the engine and back; a file has one timer, that of the time in its state
            if known != last:
                self.last.update(known)
            if last is None or known[1] != last[1]:
                if last is not None:
                    self.handle.deleteTimer(last[1] + self.gone_after_ms)
                self.handle.registerTimer(known[1] + self.gone_after_ms)
            if before is None or before != known[0]:
                yield Row(filename=key[0], hash=known[0], status="new" if before is None else "changed", ms=known[1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.last.get()
        if known and expiredTimerInfo.getExpiryTimeInMs() < known[1] + self.gone_after_ms:
            # a timer of an earlier run with a shorter time
            self.handle.registerTimer(known[1] + self.gone_after_ms)
            return
        self.last.clear()
        if known:
            yield Row(filename=key[0], hash=known[0], status="removed", ms=known[1])

    def close(self) -> None:
        pass


def index_changes(listings: DataFrame, late: str = "10 minutes", gone_after_seconds: int = 3600) -> DataFrame:
    """DED-04 as a stream: (filename, hash, status, at) of listings (filename, hash, at).

    Rows older than the watermark (the greatest time but late) are dropped; rows without name, hash or time are no listing.
    A file is removed when the watermark is gone_after_seconds past its last listing, and is new when it comes back.
    """
    listings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = listings.select("filename", "hash", F.col("at").cast("timestamp").alias("at")).filter("filename IS NOT NULL AND hash IS NOT NULL AND at IS NOT NULL")
    keyed = rows.withColumn("ms", F.unix_millis("at")).withWatermark("at", late).groupBy("filename")
    found = keyed.transformWithState(Refresh(gone_after_seconds * 1000), CHANGES, "Update", "EventTime")
    return found.select("filename", "hash", "status", F.timestamp_millis("ms").alias("at"))


class VersionedTable:
    """A table that is written anew for each batch, at batch=<number>; readers take the last whole version."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the versions whose write was committed."""
        path, fs = self._fs()
        if not fs.exists(path):
            return []
        names = [str(x.getPath().getName()) for x in fs.listStatus(path)]
        found = sorted(int(m[1]) for n in names if (m := re.fullmatch(r"batch=(\d+)", n)))
        return [n for n in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={n}/_SUCCESS"))]

    def read(self, before: int | None = None) -> DataFrame | None:
        """The last version, or the last one before a batch; None if there is none."""
        found = [n for n in self.versions() if before is None or n < before]
        return self.spark.read.parquet(f"{self.path}/batch={found[-1]}") if found else None

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        for old in self.versions()[: -self.keep]:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={old}")
            self._fs()[1].delete(folder, True)


def apply_changes(index: DataFrame | None, changes: DataFrame, summarize: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """DED-05: the next index (filename, hash, summary, error) after changes; the last of a file's changes counts.

    New and changed files go through summarize, which adds summary and error. Where it fails, a known record keeps its old
    hash and summary with the error, an unknown one is left out. Records without change stay as they are.
    """
    last = changes.groupBy("filename").agg(F.max_by(F.struct("hash", "status"), F.struct("at", "status", "hash")).alias("c")).select("filename", "c.*")
    done = summarize(last.filter("status <> 'removed'").select("filename", "hash")).select("filename", "hash", "summary", "error")
    if index is None:
        return done.filter("error IS NULL")
    old = index.join(last.select("filename"), "filename", "left_anti").select("filename", "hash", "summary", "error")
    known = done.join(index.select("filename", F.col("hash").alias("h"), F.col("summary").alias("s")), "filename", "left")
    failed = F.col("error").isNotNull()
    known = known.filter(~failed | F.col("h").isNotNull())
    return old.unionByName(known.select("filename", F.when(failed, F.col("h")).otherwise(F.col("hash")).alias("hash"), F.when(failed, F.col("s")).otherwise(F.col("summary")).alias("summary"), "error"))


def refresh_index(changes: DataFrame, table: VersionedTable, summarize: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """A stream of changes applied to a table until what is there has been read. A batch that runs again changes nothing."""

    def upsert(batch: DataFrame, number: int) -> None:
        table.write(apply_changes(table.read(before=number), batch, summarize), number)

    return changes.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
