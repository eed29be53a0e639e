import glob
import os
import shutil
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from pagemill.streaming import incremental, index_refresh

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "filename string, hash string, at timestamp"


def put(spark, folder, name, rows):
    """One file of listings; minutes after the start."""
    made = spark.createDataFrame([(f, h, None if m is None else START + timedelta(minutes=m)) for f, h, m in rows], SCHEMA)
    made.coalesce(1).write.mode("overwrite").parquet(f"{folder}-tmp")
    part = glob.glob(f"{folder}-tmp/part-*")[0]
    os.makedirs(folder, exist_ok=True)
    os.rename(part, f"{folder}/{name}.parquet")


def summarize(rows):
    return rows.withColumn("summary", F.when(F.col("hash") != "bad", F.concat(F.lit("s-"), "hash"))).withColumn("error", F.when(F.col("hash") == "bad", "no model"))


def run(spark, base):
    listings = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    changes = index_refresh.index_changes(listings, late="10 minutes", gone_after_seconds=3600)
    table = index_refresh.VersionedTable(spark, f"file://{base}/index")
    index_refresh.refresh_index(changes, table, summarize, f"file://{base}/state").awaitTermination()
    found = table.read()
    return {} if found is None else {r["filename"]: (r["hash"], r["summary"], r["error"]) for r in found.collect()}


def test_index_follows_listings_through_restarts(spark, tmp_path):
    base = str(tmp_path)
    folder = f"{base}/in"
    put(spark, folder, "1", [("a", "h1", 0), ("b", "h1", 0), ("b", "h2", 5), (None, "x", 1), ("n", None, 1), ("t", "x", None), ("bad", "bad", 2)])
    assert run(spark, base) == {"a": ("h1", "s-h1", None), "b": ("h2", "s-h2", None)}
    # stopped and started again: what is known is state; one file changes, a change that can't be summarized keeps the record
    put(spark, folder, "2", [("a", "h1", 30), ("b", "bad", 30), ("c", "h9", 30)])
    assert run(spark, base) == {"a": ("h1", "s-h1", None), "b": ("h2", "s-h2", "no model"), "c": ("h9", "s-h9", None)}
    # the watermark is at 20 minutes: a row before it is late, an older one than the last known says nothing
    put(spark, folder, "3", [("a", "late", 10), ("c", "old", 25), ("d", "h4", 40)])
    found = run(spark, base)
    assert found["a"] == ("h1", "s-h1", None) and found["c"] == ("h9", "s-h9", None) and found["d"] == ("h4", "s-h4", None)
    # an hour after its last listing (and the watermark's delay) a file goes; d is listed again
    put(spark, folder, "4", [("d", "h4", 100), ("e", "h5", 115)])
    put(spark, folder, "5", [("e", "h5", 116)])
    found = run(spark, base)
    assert set(found) == {"d", "e"}
    versions = index_refresh.VersionedTable(spark, f"file://{base}/index").versions()
    # the last batch runs again, as after a loss between its write and its commit: the same table comes out
    last = max(int(x) for x in os.listdir(f"{base}/state/commits") if x.isdigit())
    for x in (str(last), f".{last}.crc"):
        if os.path.exists(f"{base}/state/commits/{x}"):
            os.remove(f"{base}/state/commits/{x}")
    assert run(spark, base) == found and index_refresh.VersionedTable(spark, f"file://{base}/index").versions()[-1] >= versions[-1]


def test_append_by_key_of_new_files_and_null_keys(spark, tmp_path):
    folder, path = f"{tmp_path}/in", f"file://{tmp_path}/out"
    put(spark, folder, "1", [("a", "1", 0), ("a", "2", 1), (None, "3", 1), (None, "4", 1)])

    def go():
        stream = incremental.read_new_files(spark, folder, SCHEMA, 1)
        incremental.append_by_key(stream, path, "filename", f"file://{tmp_path}/check").awaitTermination()
        return sorted(str(r["filename"]) for r in spark.read.parquet(path).collect())

    assert go() == ["None", "a"] and go() == ["None", "a"]
    put(spark, folder, "2", [("a", "9", 5), (None, "9", 5), ("b", "1", 5)])
    assert go() == ["None", "a", "b"]
    shutil.rmtree(f"{tmp_path}/check")  # everything is read again: nothing is there twice
    assert go() == ["None", "a", "b"]


def test_watermark_of_windowed_counts(spark, tmp_path):
    folder = f"{tmp_path}/in"
    schema = "ts timestamp, event_type string, value double"

    def events(name, rows):
        made = spark.createDataFrame([(START + timedelta(hours=h), "x", v) for h, v in rows], schema)
        made.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/tmp")
        os.makedirs(folder, exist_ok=True)
        os.rename(glob.glob(f"{tmp_path}/tmp/part-*")[0], f"{folder}/{name}.parquet")

    for name, rows in (("1", [(0.1, 1.0), (0.2, 2.0)]), ("2", [(5.0, 5.0)]), ("2b", [(5.1, 0.0)]), ("3", [(0.3, 100.0), (9.0, 7.0)]), ("4", [(20.0, 1.0)])):
        events(name, rows)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)
    query = incremental.windowed_counts(stream).writeStream.outputMode("append").format("memory").queryName("windowed").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = {r["window"]["start"].hour: (r["n"], r["total"]) for r in spark.table("windowed").collect()}
    assert found[0] == (2, 3.0) and found[5] == (2, 5.0)


def test_a_file_costs_few_calls_of_its_state():
    """Each call of the state or a timer goes to the engine and back: three for a new file, four for one that is known."""

    class Engine:
        def __init__(self):
            self.calls, self.value, self.timers = 0, None, set()

        def __getattr__(self, name):
            def call(*args):
                self.calls += 1
                if name == "update":
                    self.value = args[0]
                elif name == "clear":
                    self.value = None
                elif name == "registerTimer":
                    self.timers.add(args[0])
                elif name == "deleteTimer":
                    self.timers.discard(args[0])
                return {"get": self.value, "exists": self.value is not None, "listTimers": list(self.timers)}.get(name)

            return call

    class At:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 0

        def getExpiryTimeInMs(self):  # noqa: N802
            return self.ms

    file, engine = index_refresh.Refresh(1000), Engine()
    file.handle = file.last = engine
    listed = lambda ms, digest: [r["status"] for r in file.handleInputRows(("a",), iter([{"ms": ms, "hash": digest}]), At(0))]
    assert listed(5, "x") == ["new"] and engine.calls == 3 and engine.timers == {1005}
    assert listed(9, "x") == [] and engine.calls == 7 and engine.timers == {1009}
    assert listed(9, "x") == [] and engine.calls == 8 and engine.timers == {1009}
    # a timer of a run with a shorter time doesn't remove the file
    assert list(file.handleExpiredTimer(("a",), At(0), At(500))) == [] and engine.value == ("x", 9)
    assert [r["status"] for r in file.handleExpiredTimer(("a",), At(0), At(1009))] == ["removed"] and engine.value is None
