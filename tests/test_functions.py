import json

import pytest
from pyspark.sql import functions as F

from pagemill.functions import encoding, numeric, rewriting, text
from pagemill.operators import dedup, sampling, windows
from pagemill.plans.tools import Agent, Registry, parse_docstring
from pagemill.sources import sinks
from pagemill.sources.blobs import BlobStore


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "column, want",
    [
        (lambda: text.normalize_label(F.lit(" Tax-Form 2 ")), "tax_form_2"),
        (lambda: text.safe_class(F.lit(" -- ")), "unknown"),
        (lambda: text.humanize_qname(F.lit("us-gaap:NetIncomeLossUSDTotalMember")), "Net Income Loss USD Total"),
        (lambda: text.fenced(F.lit("a ```json\n{}\n``` b")), "{}"),
        (lambda: text.truncate(F.lit("abcdefgh"), 5), "abcd..."),
        (lambda: text.selector(F.lit("items[].name")), '[data-field^="items["][data-field$=".name"]'),
        (lambda: text.logical_name(F.lit("a[12].b")), "a[].b"),
        (lambda: text.unwrap_expression(F.lit("{{ a.b }}")), "a.b"),
        (lambda: text.is_form(F.lit("petition_for_x")), True),
        (lambda: text.is_signature(F.lit("Signed_By")), True),
        (lambda: text.discover_fields(F.lit("<i data-field=\"a\"></i><i data-field='b[{{ loop.index }}]'></i><i data-field='a'>")), ["a", "b[]"]),
        (lambda: numeric.to_thousandths(F.array(F.lit(0.0005), F.lit(0.0015))), [0, 2]),
        (lambda: numeric.iou(F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0))), F.array(*map(F.lit, (0.0, 0.0, 0.5, 1.0)))), 0.5),
        (lambda: encoding.is_pdf(F.lit("\n %PDF-1").cast("binary")), True),
        (lambda: windows.page_bounds(F.array(*map(F.lit, (10.0, 60.0, 90.0, 200.0))), F.lit(230.0)), [0.0, 60.0]),
    ],
)
def test_columns(spark, column, want):
    assert value(spark, column()) == want


def test_tolerant_json(spark):
    df = spark.createDataFrame([("[{\"query\": \"a\"}, 3]",), ("{}",), ("oops",)], "t string")
    answers, error = encoding.parse_tolerant(F.col("t"))
    assert [(r["n"], r["e"]) for r in df.select(F.size(answers).alias("n"), error.alias("e")).collect()] == [(1, False), (0, False), (0, True)]


def test_rewrites():
    assert json.loads(rewriting.repair_json('{"a": "b}')) == {"a": "b"}
    assert rewriting.repair_json('{"a": "b\\"}"}').startswith('{"a"')
    assert rewriting.tool_call('<tool_call>{"name": "f", "arguments": {"x": "1}}</tool_call>') == ("f", '{"x": "1"}')
    assert rewriting.flatten({"a": 1, "b": ["x", None, ""]}) == "1, x"
    assert rewriting.strictify({"type": "object", "properties": {"a": {"type": "object"}}})["properties"]["a"] == {"type": "object", "additionalProperties": False}
    html, used = rewriting.inject_signatures('<span data-field="signature"></span>', ["signature", "x[]"])
    assert used == ["signature"] and "<svg" in html
    fixed, counts = rewriting.repair_bindings('<span data-field="a">x</span><input data-field="b">')
    assert counts == {"span": 1, "input": 1} and rewriting.repair_bindings(fixed)[1] == {}
    assert rewriting.enrich_blanks("Full name: <input type='text'> Full name: <input>")[1] == 2


def test_blob_store(spark, tmp_path):
    store = BlobStore(spark, f"file://{tmp_path}/s")
    path = store.add("a/b/x.bin", b"\x00\x01\xff")
    assert path.endswith("_x.bin") and len(path) == 12 and store.add("x.bin", b"\x00\x01\xff") == path
    assert store.get(path) == b"\x00\x01\xff"
    store.remove(path)
    with pytest.raises(FileNotFoundError):
        store.get(path)
    with pytest.raises(FileNotFoundError):
        store.remove(path)


def test_greedy_keep_decides_long_chains(spark):
    import random

    rng, chain = random.Random(1), [0]
    while len(chain) < 110:  # near its neighbours in the chain alone
        new = chain[-1]
        for bit in rng.sample(range(63), 6):
            new ^= 1 << bit
        if all((new ^ old).bit_count() > 8 for old in chain[:-1]):
            chain.append(new)
    df = spark.createDataFrame([(0, i, h) for i, h in enumerate(chain)], "cls int, id long, hash long")
    assert {r["id"]: r["kept"] for r in dedup.greedy_keep(df).collect()} == {i: i % 2 == 0 for i in range(len(chain))}


def test_greedy_keep_is_first_come(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("a", 3, 0b11111111_11), ("b", 4, 0)], "cls string, id long, hash long")
    assert {r["id"]: r["kept"] for r in dedup.greedy_keep(df).collect()} == {1: True, 2: False, 3: True, 4: True}


def test_refresh_keeps_old_record_on_failure(spark):
    old = spark.createDataFrame([("a", "1", "A"), ("b", "1", "B"), ("gone", "1", "G")], "filename string, hash string, summary string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "filename string, hash string")
    out = dedup.refreshed(old, new, lambda df: df.withColumn("summary", F.lit("new")).withColumn("error", F.when(F.col("filename") == "b", "failed")))
    assert {tuple(r) for r in out.collect()} == {("a", "1", "A", None), ("b", "1", "B", "failed"), ("c", "3", "new", None)}


def test_exact_share_and_append(spark, tmp_path):
    df = spark.range(1000)
    assert sampling.exact_share(df, "id", 0.05, 1).filter("chosen").count() == 50
    path = f"file://{tmp_path}/t"
    assert sinks.append_missing(df, path, "id") == 1000 and sinks.append_missing(df, path, "id") == 0
    with pytest.raises(ValueError):
        sinks.write(df.filter("id < 0"), path)


def test_document_windows_cover_all(spark):
    df = spark.createDataFrame([("d", p, n) for p, n in enumerate([3, 1, 1, 3])], "doc string, pos int, images int")
    assert [(r["first"], r["stop"]) for r in windows.document_windows(df).orderBy("window").collect()] == [(0, 1), (2, 3)]
    assert [(r["first"], r["stop"]) for r in windows.document_windows(df, cover_all=True).orderBy("window").collect()] == [(0, 2), (2, 4)]


def test_tools():
    registry = Registry()

    @registry.tool
    def add(context, a: int, b: int = 1) -> int:
        """Adds.

        Args:
            a: first
              number
            b: second
        """
        return a + b

    schema = registry.schemas()[0]["function"]
    assert schema["parameters"]["required"] == ["a"] and schema["parameters"]["properties"]["a"] == {"type": "integer", "description": "first number"}
    assert registry.dispatch(None, "add", '{"a": 2}') == "3" and registry.dispatch(None, "no", "{}").startswith("Error")
    replies = iter([{"content": '<tool_call>{"name": "add", "arguments": {"a": 4}}</tool_call>'}, {"content": "done"}])
    agent = Agent(lambda m, s: next(replies), registry, None)
    assert agent.run("go") == "done" and agent.messages[-2]["content"] == "5"
    assert parse_docstring("One.") == ("One.", {})
