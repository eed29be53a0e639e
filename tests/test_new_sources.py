import json
import os
import time
import zlib

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill import catalog
from pagemill.functions import pdf, records
from pagemill.plans import fetching, model_stages
from pagemill.sources import blob_load, filings, sinks
from pagemill.sources.blobs import BlobStore
from pagemill.operators import sampling

from .conftest import SF


# filings


def listing(folder, tickers=9):
    (folder / "map.json").write_text(json.dumps({str(i): {"ticker": f"t{i}", "cik_str": 100 + i} for i in range(tickers)}))
    for i in range(tickers):
        recent = {"form": ["10-K", "8-K", "10-K", "10-Q", "10-K"], "accessionNumber": [f"0-{i}-{k}" for k in range(5)], "primaryDocument": ["a.htm", "b.htm", "c.pdf", "d.HTML", "e.htm"], "filingDate": [f"2024-01-0{k + 1}" for k in range(5)]}
        (folder / f"{100 + i}.json").write_text(json.dumps({"filings": {"recent": recent}}))


def test_filings_as_a_source(spark, tmp_path):
    data, log = tmp_path / "data", tmp_path / "log"
    data.mkdir()
    log.mkdir()
    listing(data)
    os.remove(data / "104.json")

    def get(url):
        with open(f"{log}/{time.time_ns()}-{os.getpid()}", "w") as f:
            f.write(f"{time.time()} {url}")
        with open(url, "rb") as f:
            return f.read()

    source = filings.filings(spark, get, map_url=f"{data}/map.json", submissions_url=f"{data}/{{cik}}.json", forms="10-K,10-Q", per_company=2, partitions=4, interval=0.15)
    found = source.collect()
    good = sorted((r["ticker"], r["form"], r["accession"]) for r in found if r["error"] is None)
    assert good == sorted((f"T{i}", form, f"0{i}{k}") for i in range(9) if i != 4 for form, k in (("10-K", 0), ("10-Q", 3)))
    assert [r["ticker"] for r in found if r["error"]] == ["T4"]
    times = sorted(float((log / x).read_text().split()[0]) for x in os.listdir(log) if "map" not in (log / x).read_text())
    assert len(times) == 9 and min(b - a for a, b in zip(times, times[1:])) > 0.1
    before = len(os.listdir(log))
    some = source.filter(F.col("ticker").isin("T1", "T2", "none") & (F.col("form") == "10-K") & (F.col("filing_date") < "2024-01-02"))
    assert sorted(r["ticker"] for r in some.collect()) == ["T1", "T2"]
    assert sum("map" not in (log / x).read_text() for x in sorted(os.listdir(log))[before:]) == 2
    assert filings.filings(spark, get, map_url=f"{data}/map.json", submissions_url=f"{data}/{{cik}}.json", tickers="nobody", interval=0).count() == 0


def test_one_budget_of_requests_over_all_partitions(spark, tmp_path):
    def get(url):
        with open(f"{tmp_path}/{time.time_ns()}-{os.getpid()}", "w") as f:
            f.write(str(time.time()))
        return b"x"

    urls = spark.range(24).select(F.concat(F.lit("u"), "id").alias("url"))
    assert fetching.fetch(urls, get, interval=0.1, partitions=4).filter("error IS NULL").count() == 24
    times = sorted(float((tmp_path / x).read_text()) for x in os.listdir(tmp_path))
    assert len(times) == 24 and sum(b - a < 0.06 for a, b in zip(times, times[1:])) == 0


# blobs


def test_many_blobs_by_the_executors(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    store = BlobStore(spark, root)
    one = store.add("x/n5.bin", b"5-content")
    rows = spark.range(0, 10_000, 1, 4).select(F.concat(F.lit("x/n"), "id", F.lit(".bin")).alias("name"), F.concat("id", F.lit("-content")).cast("binary").alias("content"))
    assert blob_load.load_blobs(rows, root) == (10_000, 9_999)
    assert blob_load.load_blobs(rows.limit(50).union(rows.limit(50)), root) == (100, 0)
    names = set(os.listdir(f"{tmp_path}/store"))
    assert sum("_n" in x and x[0] != "." for x in names) == 10_000 and one in names and store.get(one) == b"5-content"
    back = blob_load.read_blobs(spark, root)
    wanted = rows.select(blob_load.blob_path(F.col("name"), F.col("content")).alias("path"), "content")
    assert back.filter("path LIKE '%7.bin'").join(wanted, ["path", "content"]).count() == 1000 and not os.listdir(f"{tmp_path}/store/_tmp")
    with pytest.raises(Exception, match="name and a content"):
        blob_load.load_blobs(spark.createDataFrame([("a", None)], "name string, content binary"), root)
    assert not os.listdir(f"{tmp_path}/store/_tmp")
    store.write_meta("index", b"m")
    assert store.read_meta("index") == b"m"
    store.remove(one)
    with pytest.raises(FileNotFoundError):
        store.get(one)
    store.delete_meta("index")
    with pytest.raises(FileNotFoundError):
        store.delete_meta("index")


# pages of PDF files


def made_pdf(pages=5, streams=False, count=None, damage=None):
    """A file with a page tree of two levels, with a table or a stream of cross-references."""
    kids = [[], []]
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    for k in range(pages):
        objects[10 + k] = f"<< /Type /Page /Parent {3 + k % 2} 0 R /Note (a \\) b (c)) /Box [0 0 1.5 -2] >>".encode()
        kids[k % 2].append(f"{10 + k} 0 R")
    for k in (0, 1):
        objects[3 + k] = f"<< /Type /Pages /Parent 2 0 R /Kids [{' '.join(kids[k])}] /Count {len(kids[k])} >>".encode()
    objects[2] = f"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count {pages if count is None else count} >>".encode()
    if damage:
        objects.update(damage)
    out, places = b"%PDF-1.5\n", {}
    if not streams:
        for n, body in sorted(objects.items()):
            places[n] = len(out)
            out += f"{n} 0 obj\n".encode() + body + b"\nendobj\n"
        start, size = len(out), max(objects) + 1
        table = b"".join(f"{n} 1\n{places[n]:010d} 00000 n \n".encode() for n in sorted(objects))
        return out + b"xref\n0 1\n0000000000 65535 f \n" + table + f"trailer\n<< /Size {size} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF".encode()
    bodies, heads, at = b"", [], 0
    numbers = sorted(objects)
    for n in numbers:
        heads.append(f"{n} {at}")
        bodies += objects[n] + b"\n"
        at = len(bodies)
    head = (" ".join(heads) + "\n").encode()
    packed = zlib.compress(head + bodies)
    holder, section = 100, len(out)
    out += f"{holder} 0 obj\n<< /Type /ObjStm /N {len(numbers)} /First {len(head)} /Filter /FlateDecode /Length {len(packed)} >>\nstream\n".encode() + packed + b"\nendstream\nendobj\n"
    start = len(out)
    entries, index = [], []
    for i, n in enumerate(numbers):
        index += [n, 1]
        entries.append(bytes([2]) + holder.to_bytes(4, "big") + bytes([i]))
    index += [holder, 1]
    entries.append(bytes([1]) + section.to_bytes(4, "big") + bytes([0]))
    rows, before = b"", bytes(6)
    for e in entries:
        rows += b"\x02" + bytes((a - b) & 255 for a, b in zip(e, before))
        before = e
    packed = zlib.compress(rows)
    about = f"<< /Type /XRef /Size 101 /W [1 4 1] /Index {index} /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 6 >> /Length {len(packed)} >>".replace(",", "")
    return out + f"101 0 obj\n{about}\nstream\n".encode() + packed + f"\nendstream\nendobj\nstartxref\n{start}\n%%EOF".encode()


def test_page_counts_of_files(spark):
    whole = {f"{n}{s}": made_pdf(n, s) for n in (0, 1, 2, 7, 40) for s in (False, True)}
    assert {k: pdf.page_count(v) for k, v in whole.items()} == {f"{n}{s}": n for n in (0, 1, 2, 7, 40) for s in (False, True)}
    updated = made_pdf(3)
    start = len(updated) + 1
    updated += f"\n2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Count 2 >>\nendobj\nxref\n2 1\n{start:010d} 00000 n \ntrailer\n<< /Size 20 /Root 1 0 R /Prev {made_pdf(3).rfind(b'xref', 0, made_pdf(3).rfind(b'startxref'))} >>\nstartxref\n{start + len(b'2 0 obj') + len(b'''\n<< /Type /Pages /Kids [3 0 R] /Count 2 >>\nendobj\n''')}\n%%EOF".encode()
    assert pdf.page_count(updated) == 2
    broken = [made_pdf(5)[:200], made_pdf(5, True)[:-60], made_pdf(5, count=4), b"", b"%PDF-1.4 nothing", made_pdf(4, damage={3: b"<< /Type /Pages /Kids [2 0 R] /Count 2 >>"}), made_pdf(4, damage={12: b"null"})]
    for data in broken:
        with pytest.raises(ValueError):
            pdf.page_count(data)
    files = spark.createDataFrame([("a", whole["7True"]), ("b", whole["2False"]), ("c", b"\x89PNG"), ("d", broken[0])], "path string, content binary")
    found = {r["path"]: (r["n_pages"], r["error"] is None) for r in fetching.page_counts(files).collect()}
    assert found["a"] == (7, True) and found["b"] == (2, True) and found["c"] == (1, True)


# records


RECORDS = [
    (1, {"a": "x", "o": {"p": {"q": 3}}, "s": ["u", None, "v"], "items": [{"n": "i0", "t": [{"k": 1}, {"k": 2}]}, {"n": "i1", "t": []}, {"t": [{"k": 5}]}], "m": [[1, 2], [3]], "d.e": 1}),
    (2, {"a": None, "o": {}, "s": "no list", "items": []}),
    (3, None),
]


def test_values_by_logical_paths(spark):
    df = spark.createDataFrame([(i, None if r is None else json.dumps(r)) for i, r in RECORDS] + [(4, "no json")], "id int, text string").select("id", records.parse(F.col("text")).alias("r"))

    def at(path):
        return sorted((r["id"], tuple(r["place"]), r["t"]) for r in records.values(df, "r", path).select("id", "place", records.text_of(F.col("value")).alias("t")).collect())

    assert at("a") == [(1, (), "x"), (2, (), None)]
    assert at("o.p.q") == [(1, (), "3")]
    assert at("s[]") == [(1, (0,), "u"), (1, (1,), None), (1, (2,), "v")]
    assert at("items[].n") == [(1, (0,), "i0"), (1, (1,), "i1")]
    assert at("items[].t[].k") == [(1, (0, 0), "1"), (1, (0, 1), "2"), (1, (2, 0), "5")]
    assert at("m[][]") == [(1, (0, 0), "1"), (1, (0, 1), "2"), (1, (1, 0), "3")]
    assert at("o.p") == [(1, (), '{"q":3}')]
    out = records.fields(df, "r", ["a", "o.p.q"]).select("id", "a", "o_p_q").collect()
    assert sorted(tuple(x) for x in out) == [(1, "x", "3"), (2, None, None), (3, None, None), (4, None, None)]
    for path in ("", "a..b", "a[", "[]a"):
        with pytest.raises(ValueError):
            records.steps(path)
    with pytest.raises(ValueError):
        records.fields(df, "r", ["s[]"])


def plain_leaves(value, path="", place=()):
    if isinstance(value, dict) and value:
        return [x for k, v in value.items() for x in plain_leaves(v, f"{path}.{k}" if path else k, place)]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in plain_leaves(v, f"{path}[]", (*place, i))] or [(f"{path}[]", place, None)]
    return [(path, place, None if value is None or value == {} else str(value))]


def test_leaves_of_records(spark):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in RECORDS], "id int, text string").select("id", records.parse(F.col("text")).alias("r"))
    found = sorted(((r["id"], r["path"], tuple(r["places"]), r["value"]) for r in records.leaves(df, "r", "id").collect()), key=str)
    assert found == sorted(((i, *x) for i, r in RECORDS for x in plain_leaves(r)), key=str)
    with pytest.raises(ValueError):
        records.leaves(df, "r", "id", most_depth=2)


# rows that used to get lost


def test_null_keys_of_samples_and_appends(spark, tmp_path):
    rows = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3), (None, 4)], "k string, v int")
    chosen = sampling.exact_share(rows, "k", 0.5, 3)
    assert chosen.columns == ["k", "v", "chosen"] and chosen.count() == 4
    assert len({r["k"] for r in chosen.filter("chosen").collect()}) == 2
    path = f"file://{tmp_path}/t"
    assert sinks.append_missing(rows, path, "k") == 3 and sinks.append_missing(rows, path, "k") == 0
    assert sinks.append_missing(rows.limit(0), f"file://{tmp_path}/e", "k") == 0 and spark.read.parquet(path).count() == 3


def test_models_get_nulls_as_none(spark):
    df = spark.createDataFrame([(None, 1.5, [1, None], b"x"), (2, None, None, None)], "i int, f double, a array<int>, b binary")
    seen = model_stages.run(df, lambda row: {"said": repr(sorted(row.items()))}, "said string").collect()
    assert [r["said"] for r in seen] == ["[('a', [1, None]), ('b', b'x'), ('f', 1.5), ('i', None)]", "[('a', None), ('b', None), ('f', None), ('i', 2)]"]
    wrong = model_stages.run(df, lambda row: {"n": "x" if row["i"] else 3}, "n int").collect()
    assert [(r["n"], r["error"] is None) for r in wrong] == [(3, True), (None, False)]


def test_a_cache_that_cannot_be_read_is_put_aside(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / "part-0.parquet").write_bytes(b"this is no table")
    stage = lambda rows: rows.withColumn("label", F.lit("x"))
    keys = spark.createDataFrame([(1,), (None,)], "key int")
    assert fetching.cached_stage(keys, "key", stage, cache).count() == 2
    assert (tmp_path / "cache.unreadable-1" / "part-0.parquet").read_bytes() == b"this is no table"
    assert fetching.cached_stage(keys, "key", lambda rows: 1 / 0 if rows.count() else stage(rows), cache).count() == 2
    os.chmod(tmp_path / "cache", 0o755)


def test_blobs_are_listed_as_one_path(spark, tmp_path):
    """A listing by a path for each blob is a job of as many tasks; files of other names and in folders aren't blobs."""
    root = f"file://{tmp_path}/store"
    rows = spark.range(300).select(F.concat(F.lit("a/"), "id", F.lit(".txt")).alias("name"), F.col("id").cast("string").cast("binary").alias("content"))
    blob_load.load_blobs(rows, root)
    (tmp_path / "store" / "notes.txt").write_text("x")
    (tmp_path / "store" / "_tmp" / "abcdef_part").write_text("x")
    tracker = spark.sparkContext.statusTracker()
    known = set(tracker.getJobIdsForGroup())
    back = blob_load.read_blobs(spark, root)
    assert set(tracker.getJobIdsForGroup()) == known
    found = {r["path"]: bytes(r["content"]) for r in back.collect()}
    assert len(found) == 300 and sorted(int(c) for c in found.values()) == list(range(300))


def test_loaded_blobs_have_a_row_for_each_row_as_the_sql(spark, tmp_path):
    """Repeated rows are one blob each, but every row is read back; so are empty texts and those without a key."""
    rows = [(i, f"text {i}") for i in range(20)] + [(3, "text 3"), (3, "other"), (7, "text 7"), (30, ""), (30, ""), (31, ""), (None, "no key"), (None, ""), (32, None), (-7, "ä😀\n")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        wanted = con.sql(catalog.oracle_sql()["ded07_loaded_blobs"]).fetchall()
    found = [tuple(r) for r in catalog.queries()["ded07_loaded_blobs"](spark, str(tmp_path)).collect()]
    assert len(found) == 29 and sorted(found, key=str) == sorted(wanted, key=str)


def test_blobs_by_their_paths(spark, tmp_path, monkeypatch):
    """As often as asked for, as they are (also with an extension that means packed), in batches of bounded size."""
    root = f"file://{tmp_path}/store/"
    rows = spark.createDataFrame([("x/a.gz", b"no gzip"), ("x/b.txt", b""), ("c", b"\0\xff" * 5000)], "name string, content binary")
    blob_load.load_blobs(rows, root)
    paths = rows.union(rows).select(blob_load.blob_path(F.col("name"), F.col("content")).alias("path"))
    back = [(r["path"][7:], bytes(r["content"])) for r in blob_load.get_blobs(paths, root).collect()]
    assert sorted(back) == sorted(2 * [("a.gz", b"no gzip"), ("b.txt", b""), ("c", b"\0\xff" * 5000)])
    with pytest.raises(Exception, match="FileNotFoundError"):
        blob_load.get_blobs(spark.createDataFrame([("abcdef_none",)], "path string"), root).collect()
    monkeypatch.setattr(blob_load, "BATCH_BYTES", 10_000)
    names = [r["path"] for r in paths.distinct().collect()]
    batches = list(blob_load._contents(root.rstrip("/"), [pa.record_batch({"path": pa.array(sorted(names) * 3)})]))
    assert sum(b.num_rows for b in batches) == 9 and len(batches) >= 3


def test_the_driver_holds_no_names_of_blobs(spark, tmp_path):
    """Names are listed by a task; the driver's plan knows files of the table only, however many blobs there are."""
    root = f"file://{tmp_path}/store"
    rows = spark.range(300).select(F.concat(F.lit("a/"), "id", F.lit(".txt")).alias("name"), F.when(F.col("id") > 9, F.col("id").cast("string")).otherwise("").cast("binary").alias("content"))
    blob_load.load_blobs(rows, root)
    back = blob_load.read_blobs(spark, root)
    assert back.inputFiles() == [] and back.count() == 300 and back.filter("length(content) = 0").count() == 10
    found = catalog.queries()["ded07_loaded_blobs"](spark, SF)
    assert {x.rpartition("/")[2] for x in found.inputFiles()} == {"documents.parquet"}


def test_stores_that_only_spark_reads(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/store"
    rows = spark.range(30).select(F.concat(F.lit("a/"), "id").alias("name"), F.when(F.col("id") > 9, F.col("id").cast("string")).otherwise("").cast("binary").alias("content"))
    blob_load.load_blobs(rows, root)
    wanted = sorted((r["path"], bytes(r["content"])) for r in blob_load.read_blobs(spark, root).collect())

    def unknown(root):
        raise ValueError("a scheme that pyarrow doesn't know")

    monkeypatch.setattr(blob_load, "_open", unknown)
    found = sorted((r["path"], bytes(r["content"])) for r in blob_load.read_blobs(spark, root).collect())
    assert len(found) == 30 and found == wanted
