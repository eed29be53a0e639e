import asyncio
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagemill.functions import numeric, rewriting, text
from pagemill.operators import metrics, sampling, windows
from pagemill.plans import agent_tools, fetching, generation, model_stages, rendering
from pagemill.plans.tools import gather_limited, json_type, parse_docstring
from pagemill.sources import files, sinks
from pagemill.sources.blobs import BlobStore


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, scale, sign, want",
    [
        ("12345678901234567", "12", None, "12345678901234567" + "0" * 12), ("0.123456789012", "0", None, "0.123456789012"), ("5", "-3", "-", "-0.005"),
        ("123456789012345678901234567890.5", None, None, "123456789012345678901234567890.5"), ("0", "3", "-", "0"), ("007.500", None, None, "7.5"), ("1.25e3", None, None, "1250"),
        (".5", "1", None, "5"), ("12", "x", None, None), ("-", None, None, None), ("1.2.3", None, None, None), ("-3", None, "-", "3"), ("100", "30", None, "1" + "0" * 32), ("$1,000", None, None, "1000"),
    ],
)
def test_canonical_values_are_exact(spark, raw, scale, sign, want):
    given = [F.lit(x).cast("string") for x in (raw, scale, sign, None)]
    for drop in (False, True):
        rows = numeric.with_canonical_values(spark.range(1), *given, F.array().cast("array<string>"), drop=drop).collect()
        assert [r["value"] for r in rows] == ([] if drop and want is None else [want])


def test_canonical_values_with_units_and_one_evaluation(spark):
    rows = [("1,234.50", "3", "-", None, ["iso4217:USD"], "USD -1234500"), ("1.234,5", None, None, "ixt:num-comma-decimal", ["xbrli:shares"], "1234.5 shares"), ("—", None, None, None, [], None), ("7", None, None, None, ["iso4217:EUR", "xbrli:shares"], "EUR 7 per share")]
    df = spark.createDataFrame(rows, "raw string, scale string, sign string, fmt string, measures array<string>, want string")
    out = numeric.with_canonical_values(df, *(F.col(c) for c in ("raw", "scale", "sign", "fmt", "measures")))
    assert all(r["value"] == r["want"] for r in out.collect()) and out.columns == [*df.columns, "value"]
    dropped = numeric.with_canonical_values(df, *(F.col(c) for c in ("raw", "scale", "sign", "fmt", "measures")), drop=True)
    plan = dropped._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("repeat(0") == 1 and "lambda" not in plan.replace("measures", "").split("Filter")[-1]


def test_document_metrics_count_answers_without_index(spark):
    schema = "doc int, pos int, query string, value string, box array<double>, index int"
    truth = spark.createDataFrame([(1, 0, "a", "x", [0.0, 0.0, 1.0, 1.0], 0), (1, 1, "b", "y", [0.0] * 4, 1)], schema)
    predicted = spark.createDataFrame([(1, 0, "a", "x", [0.0, 0.0, 1.0, 0.5], None), (1, 1, "b", "y", None, None)], schema)
    docs = spark.createDataFrame([(1,), (2,)], "doc int")
    out = {r["doc"]: r for r in metrics.document_metrics(truth, predicted, docs).collect()}
    assert (out[1]["n_gt"], out[1]["n_pred"], out[1]["tp"], out[1]["iou_n"], out[1]["f1"]) == (2, 2, 2, 1, 1.0) and out[1]["iou_sum"] == pytest.approx(0.5)
    assert (out[2]["n_gt"], out[2]["n_pred"], out[2]["f1"]) == (0, 0, 0.0)
    assert metrics.macro_metrics(metrics.document_metrics(truth, predicted, docs)).first()["f1_exact_match"] == 0.5
    plan = metrics.document_metrics(truth, predicted)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_windows_of_rows_without_images(spark):
    def brute(images, budget, stride):
        out, start = [], 0
        while start < len(images):
            end = total = 0
            for end in range(start, len(images) + 1):
                if end == len(images) or end > start and total + images[end] > budget:
                    break
                total += images[end]
            out.append((start, end))
            if end >= len(images):
                break
            start += stride
        return out

    for images in ([0] * 10, [3, 1, 1, 3], [5, 0, 0, 5, 1, 1, 1, 1], [1] * 9):
        df = spark.createDataFrame([("d", p, n) for p, n in enumerate(images)], "doc string, pos int, images int")
        for budget in (3, 65):
            assert [(r["first"], r["stop"]) for r in windows.document_windows(df, budget).orderBy("window").collect()] == brute(images, budget, 2)


def test_signatures_keep_their_element():
    page = '<div data-field="total">1</div><p data-field="signature">x<br>y</p><div data-field="signed_by"><div>a</div></div>'
    html, used = rewriting.inject_signatures(page, ["total", "signature", "signed_by", "signature[]"])
    assert used == ["signature"] and html.startswith('<div data-field="total">1</div><p data-field="signature"><svg') and html.endswith("</svg></p><div data-field=\"signed_by\"><div>a</div></div>")


def test_bindings_and_blanks():
    page = "<textarea data-field='a'>x</textarea><input type=\"checkbox\" data-field=\"b\"><select data-field='c'>x</select><td data-field=\"d\"><i>x</i></td>"
    fixed, counts = rewriting.repair_bindings(page)
    assert counts == {"textarea": 1, "input": 1} and rewriting.repair_bindings(fixed) == (fixed, {})
    assert '<input type="checkbox" data-field="b" value="{{ b }}">' in fixed and "<textarea data-field='a'>{{ a }}</textarea>" in fixed
    form = '<style>.line{border-bottom:1px} .t td{border-bottom:1px}</style><b>Full name (print):</b><span class="line"></span><div class="t"></div><input type="checkbox"><input value="x"><b>1</b><input>'
    html, added = rewriting.enrich_blanks(form)
    assert added == 2 and '<span class="line" data-field="full_name">{{ full_name }}</span>' in html and '<input data-field="full_name_2" value="{{ full_name_2 }}">' in html
    assert rewriting.underlined_classes(form) == {"line"}


def test_uncalled_methods_and_classes(spark):
    say = lambda x: value(spark, text.uncalled_method(F.lit(x)))
    assert say("{{ a.items }}") and say("{% for k in a.values %}") and not say("{{ a.items() }}") and not say("{{ a.itemsize }}") and not say("a.items")
    assert value(spark, text.border_classes(F.lit(".a, p.b {border-bottom: 1px} .t td {border-bottom: 0} .c {color: red}"))) == ["a", "b"]


def test_merged_templates(spark):
    merge = lambda *chunks: value(spark, text.merge_templates(F.array(*[F.struct(F.lit(h).alias("html"), F.array(*map(F.lit, f)).alias("fields")) for h, f in chunks])))
    one = "<HTML><head><style>a</style></HEAD><body class=x>1</body></HTML>"
    assert merge((one, ["a"]))["html"] == one
    out = merge((one, ["a", "b"]), ("<style>b</style><body>2</body>", ["b", "c"]), ("3", ["a"]))
    assert out["html"] == "<HTML><head><style>a</style>\n<style>b</style>\n</HEAD><body class=x>1\n2\n3</body></HTML>" and out["fields"] == ["a", "b", "c"]
    assert merge(("x", ["a"]), (one, ["a"]))["html"] == "x\n\n" + one


def test_schemas_and_docstrings():
    assert json_type(list[int]) == {"type": "array", "items": {"type": "integer"}} and json_type(list[list[str]])["items"]["items"] == {"type": "string"}
    assert json_type(dict[str, int]) == {"type": "object"} and json_type("x") == {"type": "string"} and json_type(list) == {"type": "array"}
    found = parse_docstring("One\nline.\n\nMore.\n\nNotes here:\n    x: y\n\nArgs:\n    a (int): first\n        more\n\n    b:\n        second\n")
    assert found == ("One\nline.\n\nMore.", {"a": "first more", "b": "second"})


def test_limited_tasks():
    running = most = 0

    def task(k):
        async def run():
            nonlocal running, most
            running += 1
            most = max(most, running)
            await asyncio.sleep(0.001)
            running -= 1
            return k

        return run

    assert asyncio.run(gather_limited([task(k) for k in range(9)], 3)) == list(range(9)) and most == 3


def test_models_are_called_once(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def call(name):
        def run(row):
            (log / f"{name}-{row.get('page', row.get('slot'))}-{row.get('attempt')}-{id(row)}-{len(list(log.iterdir()))}").touch()
            if row.get("attempt", 0) < row.get("slot", 0) % 2:
                raise ValueError("not yet")
            return {"page_summary": "s"} if name == "page" else {"summary": "d"} if name == "doc" else {"value": "v"}

        return run

    pages = spark.createDataFrame([("a", k, "t") for k in range(20)], "path string, page int, text string")
    assert model_stages.summarize(pages, call("page"), call("doc")).count() == 1
    assert sum(f.name.startswith("page") for f in log.iterdir()) == 20
    slots = spark.createDataFrame([(k,) for k in range(10)], "slot int").coalesce(1)
    out = model_stages.first_success(slots, 6, call("slot"), "value string").collect()
    assert [(r["slot"], r["attempt"]) for r in sorted(out)] == [(k, k % 2) for k in range(10)]
    assert sum(f.name.startswith("slot") for f in log.iterdir()) == 15


def test_fetch_with_throttle_and_cache(spark, tmp_path):
    waited, now = [], [0.0]
    wait = fetching.Slots(0.0, 1, 2, 0.5, lambda: now[0], lambda s: (waited.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(3):
        wait()
    assert waited == [0.5, 1.0, 1.0]
    now[0] = 9.9  # late: the next own slot, not all that were missed
    wait()
    assert now[0] == 10.5
    urls, cache = spark.createDataFrame([("a",), ("b",), ("a",), ("bad",)], "url string"), f"file://{tmp_path}/cache"

    def get(url):
        if url == "bad":
            raise OSError("gone")
        return b"%PDF-" + url.encode() + b"\xff"

    first = {r["url"]: (r["content"], r["error"]) for r in fetching.fetch(urls, get, cache, 0).collect()}
    assert first["a"][0] == b"%PDF-a\xff" and first["bad"][1].startswith("OSError") and len(first) == 3

    def never(url):
        raise RuntimeError(f"asked for {url}")

    again = {r["url"]: r["error"] for r in fetching.fetch(urls, never, cache, 0).collect()}
    assert again["a"] is None and again["b"] is None and "asked" in again["bad"]
    assert fetching.fetch(urls, get, cache, 0).filter("url = 'a'").select(fetching.text_of(F.col("content")).alias("t")).first()["t"] == "%PDF-a\ufffd"
    assert {r["url"]: r["error"] for r in fetching.downloads(urls, lambda u: b"no" if u == "b" else get(u), interval=0).collect()}["b"] == "not a PDF"


def test_page_stages_and_cache(spark, tmp_path):
    docs = spark.createDataFrame([("a", b"%PDF-3", 3), ("b", b"\x89PNG", 1)], "path string, content binary, n_pages int")
    assert {r["path"]: r["n_pages"] for r in fetching.page_counts(docs.drop("n_pages"), lambda c: int(c[-1:])).collect()} == {"a": 3, "b": 1}
    drawn = fetching.page_images(docs, lambda c, p: c + str(p).encode(), -2).collect()
    assert sorted((r["path"], r["page"]) for r in drawn) == [("a", 1), ("a", 2), ("b", 0)] and all(r["data_url"].startswith("data:image/png;base64,") for r in drawn)
    calls, cache = [], f"file://{tmp_path}/labels"
    stage = lambda rows: (calls.append(rows.count()), rows.withColumn("label", F.lit("x")))[1]
    keys = spark.range(5).withColumnRenamed("id", "key")
    assert fetching.cached_stage(keys, "key", stage, cache).count() == 5 and fetching.cached_stage(spark.range(8).withColumnRenamed("id", "key"), "key", stage, cache).count() == 8 and calls == [5, 3]


def test_catalog_templates_and_values(spark):
    docs = spark.createDataFrame([("a", 2), ("b", 0), ("c", 1), ("d", 3)], "path string, n_images int")
    replies = {"a": 'x ```json\n{"title": "A", "n_pages": 9}\n```', "c": "no", "d": '{"title": "D"}'}
    good, bad = generation.catalog_entries(docs, lambda row: replies[row["path"]], "title string")
    assert {(r["source_path"], r["n_pages"], r["title"]) for r in good.collect()} == {("a", 9, "A"), ("d", 3, "D")} and {r["path"] for r in bad.collect()} == {"b", "c"}
    pages = spark.createDataFrame([("x", 10), ("y", 3), ("z", 9)], "doc string, n_pages int")

    def template(row):
        if row["doc"] == "z" and row["first"]:
            raise ValueError("no")
        return {"html": f"<html><head></head><body>{row['first']}-{row['last']}</body></html>", "fields": ["a", f"f{row['first']}"]}

    out = {r["doc"]: r for r in generation.make_templates(pages, template).collect()}
    assert out["x"]["html"] == "<html><head></head><body>0-7\n8-9</body></html>" and out["x"]["fields"] == ["a", "f0", "f8"] and out["z"]["html"] is None and "no" in out["z"]["error"]
    slots = spark.createDataFrame([(0,), (1,)], "slot int")
    values = {r["slot"]: (r["values"], r["error"]) for r in generation.random_values(slots, lambda row: '```json\n{"a": 1}\n```' if row["slot"] else "[1").collect()}
    assert values[1] == ('{"a": 1}', None) and values[0][0] is None and values[0][1]
    rows = spark.createDataFrame([(["a", "b", "c", "d"], "question", "s"), (["a"], "structured_field_name", "s")], "fields array<string>, fmt string, seed string")
    asked = generation.generate_queries(rows, lambda row: '{"selected": [{"field": "b", "query": " B? "}, {"field": "q"}, 3, {"field": "a", "query": null}]}').collect()
    assert asked[0]["selected"][0]["query"] == "B?" and len(asked[0]["selected"]) == 2 and asked[1]["selected"][0]["query"] == "a"


def test_agent_tools(spark):
    docs = spark.createDataFrame([("a.pdf", "Tax", 2), ("b.pdf", "Letter", 1)], "path string, title string, n_pages int")
    pages = spark.createDataFrame([("a.pdf", 0, 100, 200), ("a.pdf", 1, 100, 200)], "doc string, page int, width int, height int")
    saved = []
    reply = lambda row: {"reply": '[{"query": "q", "value": "v", "box_2d": [0, 0, 500, 500], "index": 0}]' if row["first"] == 1 else "[]"}
    context = agent_tools.Context(docs, pages, lambda q, d: ["b.pdf", "none", "a.pdf"], reply, lambda plan, path: saved.append((plan, path)))
    tools = agent_tools.registry()
    assert tools.functions["find_documents"](context, "x", 2) == [{"path": "b.pdf", "title": "Letter"}, {"path": "a.pdf", "title": "Tax"}]
    answers = tools.functions["ask_document"](context, "a.pdf", ["q"])
    assert answers == [{"query": "q", "value": "v", "box_2d": [0, 0, 500, 500], "meta": {"filename": "a.pdf", "page": 1}}]
    assert tools.functions["visualize_answers"](context, answers, "o.png") == "o.png" and saved[0][0][0]["rect"]["x1"] == 50.0
    assert tools.dispatch(context, "ask_document", {"document_path": "z", "queries": []}).startswith("Error")


def test_draws_without_replacement(spark):
    slots, pool = spark.range(5).withColumnRenamed("id", "slot"), spark.range(8).withColumnRenamed("id", "item")
    assert len({r["item"] for r in sampling.draw_distinct(slots, pool, "item", 1).collect()}) == 5
    assert sampling.draw_distinct(slots, pool.limit(2), "item", 1).count() == 5


def test_blobs_and_files(spark, tmp_path):
    store = BlobStore(spark, f"file://{tmp_path}/s")
    path = store.add("x/y.bin", b"abc")
    with store.as_local(path) as name:
        assert name.endswith(path) and Path(name).read_bytes() == b"abc"
    assert not Path(name).exists() and store.paths() == [path]
    store.write_meta("m.json", b"{}")
    assert store.read_meta("m.json") == b"{}"
    store.delete_meta("m.json")
    with pytest.raises(FileNotFoundError):
        store.read_meta("m.json")
    for name, content in (("tax_clear_0001.PDF", b"1"), ("tax_phone_photo_0001.png", b"2"), ("tax_clear_0001.txt", b"3")):
        (tmp_path / "files").mkdir(exist_ok=True)
        (tmp_path / "files" / name).write_bytes(content)
    walked = files.walk(spark, f"file://{tmp_path}/files")
    assert walked.count() == 2
    stems = spark.createDataFrame([("tax_clear_0001",), ("tax_phone_photo_0001",)], "stem string")
    assert set(files.discover(walked, stems).first()["variants"]) == {"clear", "phone_photo"}
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"a": 1}')
    (tmp_path / "j" / "b.json").write_text("{oops")
    good, bad = files.sidecars(spark, f"file://{tmp_path}/j", "a int")
    assert [r["a"] for r in good.collect()] == [1] and bad.count() == 1
    assert files.index(spark, f"file://{tmp_path}/none.json", "a int").count() == 0
    (tmp_path / "m.json").write_text('{"p": {"t": "x"}}')
    assert files.index_map(spark, f"file://{tmp_path}/m.json", "struct<t:string>").first()["doc"]["t"] == "x"
    assert files.template_rows(spark.createDataFrame([("t", None, None)], "template string, schema array<string>, class string")).first()[1:] == ([], "unknown")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(k, f"c{k % 2}") for k in range(10)], "k int, class string")
    out = f"file://{tmp_path}/t"
    sinks.write(df, out, rows_per_file=3)
    assert spark.read.parquet(out).count() == 10 and len(list((tmp_path / "t").glob("*.parquet"))) >= 4
    assert sinks.merge_shards(spark, out, f"file://{tmp_path}/m", "k") == 10 and sinks.merge_shards(spark, f"file://{tmp_path}/no", f"file://{tmp_path}/n", "k") == 0
    sinks.save_index(df, f"file://{tmp_path}/i")
    sinks.write_templates(df, f"file://{tmp_path}/w")
    assert {p.name for p in (tmp_path / "w").glob("class=*")} == {"class=c0", "class=c1"} and spark.read.parquet(f"file://{tmp_path}/i").count() == 10
    sinks.write_json(df, f"file://{tmp_path}/jj")
    assert spark.read.json(f"file://{tmp_path}/jj").count() == 10
    assert value(spark, sinks.output_name(F.lit("a"), F.lit("clear"), F.lit(7))) == "a_clear_0007"


def test_rendered_fields_and_warps(spark):
    docs = spark.createDataFrame([("a",), ("bad",)], "doc string")

    def draw(row):
        if row["doc"] == "bad":
            raise ValueError("no layout")
        field = lambda name, page: {"name": name, "value": "v", "page": page, "bbox": [0.2, 0.2, 0.4, 0.4]}
        return {"pdf": b"clean", "fields": [field("x", 1), field("y", 0)]}

    out = rendering.render(docs, draw)
    assert {r["doc"]: r["error"] for r in out.collect()} == {"a": None, "bad": "ValueError: no layout"}
    assert [(r["name"], r["page"]) for r in rendering.field_rows(out).orderBy("pos").collect()] == [("x", 1), ("y", 0)]
    plan = out.drop("error").filter("doc = 'a'").crossJoin(spark.createDataFrame([("fax", True), ("fax", False), ("oil", True), ("clean_scan", True)], "profile string, geometric boolean"))
    plan = plan.withColumn("quality", F.lit(0.3)).withColumn("seed", F.lit("s")).withColumn("n_pages", F.lit(2))

    def change(row):
        if row["profile"] == "clean_scan":
            raise OSError("broken")
        return bytes(row["pdf"]) + b"+"

    found = {(r["profile"], r["geometric"]): r for r in rendering.augmented(plan, change, lambda row, m: b"warped%d" % len(m)).collect()}
    assert bytes(found["fax", True]["pdf"]) == b"warped2+" and [f["name"] for f in found["fax", True]["fields"]] == ["y", "x"] and found["fax", True]["fields"][0]["bbox"] != [0.2, 0.2, 0.4, 0.4]
    assert bytes(found["fax", False]["pdf"]) == b"clean+" and found["fax", False]["fields"][0]["bbox"] == [0.2, 0.2, 0.4, 0.4]
    for key in (("oil", True), ("clean_scan", True)):
        assert not found[key]["aug_ok"] and bytes(found[key]["pdf"]) == b"clean" and found[key]["error"]


def test_element_boxes(spark):
    box = "struct<x:double,y:double,width:double,height:double>"
    rows = [("d", "own", False, 10.0, 110.0, 20.0, 10.0, []), ("d", "union", False, 0.0, 0.0, 0.0, 0.0, [(0.0, 0.0, 10.0, 10.0), (30.0, 20.0, 20.0, 30.0), (0.0, 0.0, 0.0, 0.0)]), ("d", "hidden", True, 1.0, 1.0, 1.0, 1.0, []), ("d", "none", False, 0.0, 0.0, 0.0, 0.0, None)]
    elements = spark.createDataFrame(rows, f"doc string, id string, hidden boolean, x double, y double, width double, height double, children array<{box}>")
    pages = spark.createDataFrame([("d", [0.0, 100.0], 100.0, [100.0, 50.0])], "doc string, starts array<double>, width double, heights array<double>")
    assert {r["id"]: (r["page"], r["box"]) for r in rendering.element_boxes(elements, pages).collect()} == {"own": (1, [0.1, 0.2, 0.3, 0.4]), "union": (0, [0.0, 0.0, 0.5, 0.5])}


def test_small_stages(spark):
    say = lambda *x: value(spark, rendering.field_value(*[F.lit(v).cast("string") for v in x]))
    assert (say("a", "b", "c"), say("", "b", "c"), say(None, "", "c"), say(None, None, None)) == ("a", "b", "c", "")
    docs = spark.createDataFrame([("a", [b"1", b"2"]), ("b", [])], "doc string, images array<binary>")
    assert {r["doc"]: (r["pdf"] and bytes(r["pdf"]), r["error"]) for r in rendering.joined_pages(docs, b"|".join).collect()} == {"a": (b"1|2", None), "b": (None, "ValueError: no images")}
    files = spark.createDataFrame([("a", b"x"), ("b", b"")], "path string, content binary")
    assert {r["path"]: r["image"] and bytes(r["image"]) for r in rendering.first_pages(files, lambda c: c + b"!" if c else None).collect()} == {"a": b"x!", "b": None}
    made = []
    client = rendering.client_of({"local": lambda: made.append(1) or "client"})
    assert client("local") == client("local") == "client" and made == [1]
    with pytest.raises(ValueError):
        client("other")
    assert [value(spark, rendering.whole_number(F.lit(x).cast("string"))) for x in ("7", "x", None)] == [7, 0, 0]
    assert rendering.with_split(docs, "train").first()["split"] == "train"
    assert [(r["place"], r["id"]) for r in sampling.rows_at(spark.range(100), [3, 1], "id").orderBy("place").collect()] == [(1, 1), (3, 3)]
    part = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, None, "x")], "k int, doc string, q string")
    assert {r["k"]: r["part"] for r in sampling.split_by(part, F.col("q") == "x").collect()} == {1: "train", 2: "test", 3: "test"}
