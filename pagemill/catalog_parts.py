"""Queries over the smaller operators and functions; see pagemill.catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.catalog import _LINES, lines, query, snapshots
from pagemill.functions import encoding as enc
from pagemill.functions import numeric as num
from pagemill.functions import rewriting as rw
from pagemill.functions import text as tx
from pagemill.operators import convert, dedup, facts, preview, sampling, search, windows
from pagemill.plans import generation
from pagemill.plans import model_stages as stages
from pagemill.sources.files import table
from pagemill.streaming import incremental


@query(f"""WITH {_LINES}, o AS (SELECT doc, pos // 3 AS "window", pos, query, images, idx, coalesce(sum(images) OVER (PARTITION BY doc, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM lines)
SELECT doc, "window", CAST(sum(images) AS bigint) AS n_images, string_agg(CAST(off AS bigint), ',' ORDER BY pos) AS indices, min(idx) AS page_start, max(idx) AS page_end FROM o GROUP BY doc, "window\"""")
def agg05_collapse_windows(spark, d):
    answer = F.struct("query", "value", F.col("box").alias("bounding_box"), F.lit(0).alias("index"))
    page = F.col("index")
    rows = lines(spark, d).select("doc", F.floor(F.col("pos") / 3).alias("window"), "pos", page.alias("page_start"), page.alias("page_end"), F.col("images").alias("n_images"), F.array("query").alias("queries"), F.array(answer).alias("answers"))
    out = windows.collapse(rows, ["doc", "window"])
    return out.select("doc", "window", "n_images", F.array_join(F.transform("answers", lambda a: a["index"].cast("string")), ",").alias("indices"), "page_start", "page_end")


@query("SELECT doc, first, least(first + 8, n) AS stop FROM (SELECT l_suppkey AS doc, count(*) AS n, unnest(generate_series(0, count(*) - 1, 8)) AS first FROM lineitem GROUP BY 1)")
def win05_template_chunks(spark, d):
    pages = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("doc")).agg(F.count(F.lit(1)).alias("n_pages"))
    return windows.tiles(pages, 8).select("doc", "first", (F.col("last") + 1).alias("stop"))


@query(f"WITH {_LINES} SELECT doc, pos, CAST(coalesce(sum(images) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS first_image FROM lines")
def win09_image_offsets(spark, d):
    return windows.image_offsets(lines(spark, d)).select("doc", F.col("pos").cast("long").alias("pos"), "first_image")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END AS period, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS n_members,
CASE l_returnflag WHEN 'A' THEN 'USD ' ELSE '' END || CAST(l_quantity AS bigint) || CASE l_returnflag WHEN 'N' THEN ' shares' ELSE '' END AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def join01_resolved_facts(spark, d):
    """Orders of status F are the known contexts; the unit of returned lines is unknown."""
    orders = table(spark, d, "orders")
    contexts = orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("period"), F.array("o_orderpriority").alias("members"))
    units = spark.createDataFrame([("A", ["iso4217:USD"]), ("N", ["xbrli:shares"])], "id string, measures array<string>")
    none = F.lit(None).cast("string")
    rows = table(spark, d, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    rows = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit("f").alias("fact_id"), F.lit("us-gaap:Assets").alias("name"), F.col("l_quantity").cast("long").cast("string").alias("raw_text"), none.alias("scale"), none.alias("sign"), none.alias("format"), F.col("l_orderkey").alias("context"), F.col("l_returnflag").alias("unit"))
    out = facts.resolve(rows, contexts, units)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "period", F.size("members").alias("n_members"), "value")


_FACT = "'<ix:nonFraction id=\"f' || l_linenumber || '\" name=\"us-gaap:Cash\" contextRef=\"c' || l_partkey || '\" unitRef=\"' || l_returnflag || '\" scale=\"3\">' || l_suppkey || '</ix:nonFraction>'"


@query("SELECT l_orderkey AS doc, 'f' || l_linenumber AS fact_id, 'c' || l_partkey AS context, l_returnflag AS unit, '3' AS scale, CAST(l_suppkey AS varchar) AS raw_text FROM lineitem")
def arr12_inline_facts(spark, d):
    pages = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_join(F.collect_list(F.expr(_FACT)), "<p>x</p>").alias("html"))
    return facts.parse_inline_facts(pages).select("doc", "fact_id", "context", "unit", "scale", "raw_text")


@query("""WITH l AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id), t AS (SELECT 'doc' || doc_id AS filename, md5(text) AS hash, toxic FROM documents LEFT JOIN l USING (doc_id))
SELECT filename, CASE WHEN toxic = 0 THEN 'old' ELSE 's:' || hash END AS summary FROM t""")
def ded05_refreshed_index(spark, d):
    old, new = snapshots(spark, d)
    summarize = lambda rows: rows.withColumn("summary", F.concat(F.lit("s:"), "hash")).withColumn("error", F.lit(None).cast("string"))
    return dedup.refreshed(old.withColumn("summary", F.lit("old")), new, summarize).select("filename", "summary")


@query("WITH l AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) SELECT doc_id AS key, CASE WHEN toxic = 0 THEN 'label0' END AS label FROM documents LEFT JOIN l USING (doc_id)")
def ded06_cached_labels(spark, d):
    cache = table(spark, d, "labels").groupBy(F.col("doc_id").alias("key")).agg(F.concat(F.lit("label"), F.max("toxic")).alias("label"))
    return dedup.cached_labels(table(spark, d, "documents").select(F.col("doc_id").alias("key")), cache, ["label0"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join09_open_slots(spark, d):
    return sampling.without(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("SELECT pos, path FROM (SELECT unnest([0, 1, 2, 3, 4]) AS pos, unnest(['doc3', 'gone', 'doc1', 'doc10', 'doc2']) AS path) WHERE path IN (SELECT 'doc' || doc_id FROM documents) ORDER BY pos LIMIT 3")
def join10_known_paths(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("path"))
    ranked = spark.createDataFrame([(["doc3", "gone", "doc1", "doc10", "doc2"],)], "paths array<string>")
    return search.known_paths(ranked, docs, 3).select("pos", "path")


@query("SELECT doc_id AS number, 'doc' || doc_id AS filename FROM documents WHERE n_chars IS NOT NULL")
def prj01_index_projection(spark, d):
    return search.index_rows(table(spark, d, "documents"), "doc_id", F.concat(F.lit("doc"), "doc_id"), F.col("n_chars").isNotNull())


@query("SELECT 'conv1' AS filename, row_number() OVER (ORDER BY turn) - 1 AS page, role AS summary FROM conversations WHERE conv_id = 1")
def prj02_details(spark, d):
    """A point lookup: one record is the feature."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("page_summaries"))
    found = search.details(turns.withColumn("filename", F.concat(F.lit("conv"), "conv_id")), "conv1")
    return found.select("filename", F.col("page").cast("long").alias("page"), "summary")


@query(f"WITH {_LINES} SELECT doc, count(DISTINCT query) AS n_queries, count(*) AS n_answers, arg_min(query, pos) AS first_query FROM lines WHERE idx < 6 GROUP BY doc")
def prj05_all_fields(spark, d):
    rows = lines(spark, d).select("doc", "pos", F.col("query").alias("name"), "value", F.col("index").alias("page"), F.lit(6).alias("n_pages"))
    out = convert.fields_to_rows(rows)
    return out.select("doc", F.size("queries").cast("long").alias("n_queries"), F.size("answers").cast("long").alias("n_answers"), F.col("queries")[0].alias("first_query"))


_LABELS = "lower(replace(p_name, ' ', '_')) || CASE p_size % 4 WHEN 0 THEN '_form' WHEN 1 THEN '_signature' ELSE '' END"


@query(f"""WITH p AS (SELECT p_partkey, {_LABELS} AS cls FROM part) SELECT p_partkey, cls IN {tx.FORM_EXACT} OR regexp_matches(cls, '({"|".join(tx.FORM_SUFFIXES)})$') OR regexp_matches(cls, '^({"|".join(tx.FORM_PREFIXES)})') AS form,
regexp_matches(cls, '{"|".join(tx.SIGNATURE_HINTS)}') AS signature, CASE WHEN cls IN {tx.DOCUMENT_TYPES} THEN cls ELSE 'other' END AS gated FROM p""")
def prj12_label_predicates(spark, d):
    cls = F.expr(_LABELS)
    return table(spark, d, "part").select("p_partkey", tx.is_form(cls).alias("form"), tx.is_signature(cls).alias("signature"), tx.gate(cls).alias("gated"))


@query("""WITH n AS (SELECT p_partkey, unnest([p_name, p_brand, p_type, p_mfgr]) AS x FROM (SELECT *, p_brand || '_x' AS p_mfgr FROM part)),
r AS (SELECT p_partkey, x, row_number() OVER (PARTITION BY p_partkey ORDER BY md5(p_partkey || '|' || x), x) AS rn FROM n)
SELECT p_partkey, string_agg(x, ',' ORDER BY rn) AS names FROM r WHERE rn <= 2 + CAST('0x' || substr(md5(CAST(p_partkey AS varchar)), 1, 8) AS bigint) % 3 GROUP BY p_partkey""")
def prj17_field_subset(spark, d):
    key = F.col("p_partkey").cast("string")
    names = F.array("p_name", "p_brand", "p_type", F.concat("p_brand", F.lit("_x")), F.lit("rows[].a"))
    return table(spark, d, "part").select("p_partkey", F.array_join(sampling.subset(names, key), ",").alias("names"))


@query("SELECT o_orderkey AS slot, CAST('0x' || substr(md5('9|' || o_orderkey), 1, 8) AS bigint) % 17 AS ordinal FROM orders")
def prj18_draw_slots(spark, d):
    return sampling.draw_slots(table(spark, d, "orders").select(F.col("o_orderkey").alias("slot")), 17, 9)


@query("SELECT doc_id, CASE WHEN source = 'web' THEN 'train' ELSE 'test' END AS part FROM documents")
def ord07_split_by_column(spark, d):
    return sampling.split_by(table(spark, d, "documents"), F.col("source") != "web").select("doc_id", "part")


@query("SELECT event_id FROM events ORDER BY md5('45|' || event_id), event_id")
def ord08_epoch_order(spark, d):
    return sampling.shuffled(table(spark, d, "events").select("event_id"), 42, 3, "event_id")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY md5('7|' || o_orderkey), o_orderkey) <= round_even(0.5 * count(*) OVER (), 0) AS augmented FROM orders")
def ord09_exact_flags(spark, d):
    return sampling.exact_share(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.5, 7, "augmented")


@query(f"WITH {_LINES} SELECT doc, string_agg(query, ',' ORDER BY md5('5|' || query)) AS queries FROM (SELECT DISTINCT doc, query FROM lines) GROUP BY doc")
def ord11_shuffled_queries(spark, d):
    return sampling.shuffled_distinct(lines(spark, d), "query", 5).select("doc", F.array_join("items", ",").alias("queries"))


@query(f"WITH {_LINES} SELECT doc, string_agg(query, ',' ORDER BY p) AS queries FROM (SELECT doc, query, min(pos) AS p FROM lines GROUP BY ALL) GROUP BY doc")
def set03_ordered_distinct(spark, d):
    return windows.ordered_distinct(lines(spark, d)).select("doc", F.array_join("items", ",").alias("queries"))


@query("""SELECT p_partkey, regexp_replace('rows[' || p_size || '].a', '\\[[0-9]+\\]', '[]') AS logical, 'Net Income ' || p_size AS concept, '[data-field^="rows["][data-field$=".a"]' AS css, p_brand AS inner_text,
'a b ' || p_type AS collapsed, '  - [f' || p_size || '] ' || p_name || ' (m) | value: "' || p_size || '"' AS line, lower(p_brand || '_x') AS normed FROM part""")
def str_labels(spark, d):
    size = F.col("p_size").cast("string")
    none = F.lit(None).cast("string")
    return table(spark, d, "part").select(
        "p_partkey", tx.logical_name(F.concat(F.lit("rows["), size, F.lit("].a"))).alias("logical"), tx.humanize_qname(F.concat(F.lit("us-gaap:NetIncome "), size)).alias("concept"),
        tx.selector(F.lit("rows[].a")).alias("css"), tx.unwrap_expression(F.concat(F.lit("{{ "), "p_brand", F.lit(" }}"))).alias("inner_text"),
        tx.collapse_row(F.concat(F.lit(" a \n\t b  "), "p_type", F.lit(" "))).alias("collapsed"), tx.fact_line(F.concat(F.lit("f"), size), F.col("p_name"), F.array(F.lit("m")), none, size, F.lit("")).alias("line"),
        tx.norm(F.concat(F.lit("\n "), "p_brand", F.lit("_X\t"))).alias("normed"),
    )


@query("SELECT doc_id, '[' || doc_id || ']' AS own, 'x' || doc_id AS whole, lang AS first_block FROM documents")
def str07_fenced_blocks(spark, d):
    key = F.col("doc_id").cast("string")
    own = tx.fenced(F.concat(F.lit("Here:\n```html\nno\n```\n```json\n["), key, F.lit("]\n``` done")))
    return table(spark, d, "documents").select("doc_id", own.alias("own"), tx.fenced(F.concat(F.lit("  x"), key, F.lit("\n"))).alias("whole"), tx.fenced_first(F.concat(F.lit("a\n```json\n"), "lang", F.lit("\n```"))).alias("first_block"))


@query("""SELECT page_id, html AS page, 'p' || page_id AS body_text, contains(html, '<html') AS is_page FROM pages""")
def str08_skeletons(spark, d):
    """Whole pages stay as they are; a fragment gets a page around it."""
    fragment = tx.ensure_skeleton(F.concat(F.lit("<style>p{}</style>p"), F.col("page_id").cast("string")))
    return table(spark, d, "pages").select("page_id", tx.ensure_skeleton(F.col("html")).alias("page"), tx.strip(tx.body_of(fragment)).alias("body_text"), F.contains("html", F.lit("<html")).alias("is_page"))


@query("SELECT doc_id, 'path: doc' || doc_id || chr(10) || 'title: ' || lang || chr(10) || 'summary: ' || source AS entry FROM documents")
def str21_catalog_text(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc"), "doc_id").alias("path"), F.col("lang").alias("title"), F.col("source").alias("summary"))
    return search.catalog_text(docs).select(F.regexp_extract("path", "[0-9]+", 0).cast("long").alias("doc_id"), "entry")


@query("""WITH h AS (SELECT p_partkey, [CAST('0x' || substr(md5(p_partkey || '|profile'), 1, 8) AS bigint), CAST('0x' || substr(md5(p_partkey || '|quality'), 1, 8) AS bigint), CAST('0x' || substr(md5(p_partkey || '|geometric'), 1, 8) AS bigint)] AS h FROM part)
SELECT p_partkey, ['clean_scan', 'phone_photo', 'old_photocopy', 'fax'][h[1] % 4 + 1] AS profile, round(0.25 + 0.65 * (h[2] / 4294967296.0), 3) AS quality, h[3] / 4294967296.0 < 0.5 AS geometric FROM h""")
def mth15_augmentation_plan(spark, d):
    return table(spark, d, "part").select("p_partkey", num.augmentation_plan(F.col("p_partkey")).alias("x")).select("p_partkey", "x.profile", "x.quality", "x.geometric")


@query(f"""WITH {_LINES}, w AS (SELECT doc, pos, x0, y0, x1, y1, 0.9 * x0 + 0.1 * y0 AS a, 0.9 * x0 + 0.1 * y1 AS b FROM lines)
SELECT doc, pos, round(greatest(0, least(1, a)), 6) AS left_edge, round(greatest(0, least(1, y0)), 6) AS top, round(x0 * 1000, 4) AS px, round(greatest(0, y0 * 800 - 12), 4) AS label_y FROM w""")
def mth10_warped_boxes(spark, d):
    m = F.array(*[F.lit(x) for x in (0.9, 0.1, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)])
    rows = lines(spark, d).select("doc", "pos", num.warp_box(F.col("box"), m).alias("w"), num.pixel_rect(F.col("box"), F.lit(1000), F.lit(800)).alias("r"))
    return rows.select("doc", F.col("pos").cast("long").alias("pos"), F.round(F.col("w")[0], 6).alias("left_edge"), F.round(F.col("w")[1], 6).alias("top"), F.round("r.x0", 4).alias("px"), F.round("r.label_y", 4).alias("label_y"))


@query("""SELECT doc_id, greatest(1, CAST(round_even(1000 * s, 0) AS int)) AS width, greatest(1, CAST(round_even(n_chars * s, 0) AS int)) AS height, CAST(doc_id AS double) AS size_of
FROM (SELECT doc_id, n_chars, least(1.0, 1568.0 / greatest(1000, n_chars)::double) AS s FROM documents)""")
def mth14_scaled_sizes(spark, d):
    width, height = num.downscale(F.lit(1000), F.col("n_chars"), 1568)
    return table(spark, d, "documents").select("doc_id", width.alias("width"), height.alias("height"), num.magnitude(F.concat(F.lit("USD -"), "doc_id", F.lit(" or 7"))).alias("size_of"))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS hour, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def stream_windowed_counts(spark, d):
    out = incremental.windowed_counts(table(spark, d, "events"))
    return out.select(F.col("window.start").alias("hour"), "event_type", "n", F.round("total", 3).alias("total"))


@query("SELECT DISTINCT 'conv' || conv_id AS path, 'd' || count(*) OVER (PARTITION BY conv_id) AS summary, count(*) OVER (PARTITION BY conv_id) AS n_pages FROM conversations")
def udf03_summaries(spark, d):
    pages = table(spark, d, "conversations").select(F.concat(F.lit("conv"), "conv_id").alias("path"), F.col("turn").alias("page"), F.col("role").alias("text"))
    out = stages.summarize(pages, lambda row: {"page_summary": row["text"]}, lambda row: {"summary": f"d{row['prompt'].count(chr(10)) + 1}"})
    return out.select("path", "summary", F.size("pages").cast("long").alias("n_pages"))


@query("SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN lang ELSE 'other' END AS label FROM documents")
def udf06_classified(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return stages.classify(docs, lambda row: {"raw_label": f" {str(row['lang']).upper()}."}, ["en", "fr"]).select("doc_id", "label")


@query("SELECT item_id AS slot, item_id % 3 AS attempt FROM benchmark")
def udf24_first_success(spark, d):
    def call(row):
        if row["attempt"] < row["slot"] % 3:
            raise ValueError("not yet")
        return {"value": "v"}

    slots = table(spark, d, "benchmark").select(F.col("item_id").alias("slot"))
    return stages.first_success(slots, 4, call, "value string").select("slot", F.col("attempt").cast("long").alias("attempt"))


@query("SELECT doc_id, CASE WHEN lang = 'fr' THEN 'classify' ELSE 'saved' END AS status FROM documents")
def udf23_staged(spark, d):
    def classify(row):
        if row["lang"] == "fr":
            raise ValueError("unclear")
        return {"cls": row["lang"]}

    steps = [("classify", classify, "cls string"), ("template", lambda row: {"template": row["cls"]}, "template string")]
    return stages.staged(table(spark, d, "documents").select("doc_id", "lang"), steps).select("doc_id", "status")


@query("""SELECT conv_id, turn, '{"a": "' || role || '"}' AS repaired, role || ', b' AS flat FROM conversations""")
def arr06_repaired_json(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", rw.repair_json_column(F.concat(F.lit('{"a": "'), "role", F.lit("}"))).alias("repaired"), rw.flatten_json_column(F.concat(F.lit('{"x": ["'), "role", F.lit('", "", null], "y": {"z": "b"}}'))).alias("flat"))


@query("SELECT doc_id, length(text) > 0 AS stored, substr(md5(text), 1, 6) AS h FROM documents")
def src13_decoded_cells(spark, d):
    cell = F.concat(F.lit("data:application/pdf;base64,"), F.base64(F.concat(F.lit("%PDF-"), "text").cast("binary")))
    pdf = enc.decode_pdf(cell)
    return table(spark, d, "documents").select("doc_id", "text", pdf.alias("pdf")).select("doc_id", (F.length("pdf") > 5).alias("stored"), F.substring(F.md5(F.expr("substring(pdf, 6)")), 1, 6).alias("h"))


@query("""SELECT doc_id, '<p><span data-field="f' || doc_id || '">{{ f' || doc_id || ' }}</span><input data-field=''x[{{ i }}]'' value="{{ x[i] }}"/><b data-field="k">{{ k }}</b></p>' AS html,
'{"span": 1, "input": 1}' AS counts, '<td>Name of ' || lang || ': </td><span class="input-line" data-field="name_of_' || lang || '">{{ name_of_' || lang || ' }}</span><input type="text" data-field="name_of_' || lang || '_2" value="{{ name_of_' || lang || '_2 }}"><input type="radio">' AS enriched,
CAST(2 AS integer) AS added FROM documents""")
def str16_repaired_pages(spark, d):
    """Unbound elements bound to their names, and blanks named by the text before them; Python rewriting in Arrow batches."""
    key = F.col("doc_id").cast("string")
    page = F.concat(F.lit('<p><span data-field="f'), key, F.lit("\">old</span><input data-field='x[{{ i }}]'/><b data-field=\"k\">{{ k }}</b></p>"))
    form = F.concat(F.lit("<td>Name of "), "lang", F.lit(': </td><span class="input-line"> </span><input type="text"><input type="radio">'))
    out = table(spark, d, "documents").select("doc_id", rw.repair_bindings_column(page).alias("r"), rw.enrich_blanks_column(form).alias("e"))
    return out.select("doc_id", "r.html", "r.counts", F.col("e.html").alias("enriched"), "e.added")


@query("""WITH c AS (SELECT doc_id % 50 AS doc, doc_id, '<style>p' || doc_id || '</style>' AS style, 'b' || lang || doc_id AS body, lang FROM documents)
SELECT doc, CASE WHEN count(*) = 1 THEN '<html><head>' || any_value(style) || '</head><body>' || any_value(body) || '</body></html>' ELSE
'<html><head>' || first(style ORDER BY doc_id) || chr(10) || array_to_string(list(style ORDER BY doc_id)[2:], chr(10)) || chr(10) || '</head><body>' || string_agg(body, chr(10) ORDER BY doc_id) || '</body></html>' END AS html,
CAST(count(DISTINCT lang) AS integer) AS n_fields FROM c GROUP BY doc""")
def str09_merged_templates(spark, d):
    page = F.concat(F.lit("<html><head><style>p"), F.col("doc_id").cast("string"), F.lit("</style></head><body>b"), "lang", F.col("doc_id").cast("string"), F.lit("</body></html>"))
    chunks = table(spark, d, "documents").groupBy((F.col("doc_id") % 50).alias("doc")).agg(F.array_sort(F.collect_list(F.struct("doc_id", page.alias("html"), F.array("lang").alias("fields")))).alias("c"))
    merged = tx.merge_templates(F.transform("c", lambda x: F.struct(x["html"].alias("html"), x["fields"].alias("fields"))))
    return chunks.select("doc", merged.alias("m")).select("doc", "m.html", F.size("m.fields").alias("n_fields"))


@query("""WITH l AS (SELECT l_orderkey AS slug, l_linenumber AS page, l_partkey % 5 <> 0 AS there FROM lineitem),
w AS (SELECT slug, unnest(range(1, 7)) AS first FROM (SELECT DISTINCT slug FROM l)),
m AS (SELECT w.slug, first, count(DISTINCT page) AS n FROM w JOIN l ON w.slug = l.slug AND page BETWEEN first AND first + 1 AND there GROUP BY ALL HAVING count(DISTINCT page) = 2)
SELECT slug, first, slug || '_' || (row_number() OVER (PARTITION BY slug ORDER BY first) - 1) AS source FROM m""")
def prj09_window_rows(spark, d):
    li = table(spark, d, "lineitem").filter("l_partkey % 5 <> 0").select(F.col("l_orderkey").alias("slug"), F.col("l_linenumber").cast("long").alias("page")).distinct().withColumn("image", F.lit("x"))
    slugs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("slug")).distinct()
    windows_ = slugs.withColumn("first", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(6).cast("long")))).select("slug", F.col("first").alias("window"), "first", (F.col("first") + 1).alias("last"))
    return generation.window_rows(windows_, li).select("slug", "first", "source")


@query("""WITH q AS (SELECT doc_id, lang, source, n_chars, dense_rank() OVER (PARTITION BY lang ORDER BY f) - 1 AS r FROM (SELECT *, min(doc_id) OVER (PARTITION BY lang, source) AS f FROM documents))
SELECT doc_id, CAST(r % 14 AS integer) AS colour, CASE WHEN length(source || ': ' || n_chars) > 78 THEN substr(source || ': ' || n_chars, 1, 77) || '...' ELSE source || ': ' || n_chars END AS label,
n_chars / 10.0 AS x1, greatest(0.0, 0.5 * 200 - 12) AS label_y FROM q""")
def snk12_annotations(spark, d):
    docs = table(spark, d, "documents")
    box = F.array(F.lit(0.1), F.lit(0.5), F.col("n_chars") / 1000.0, F.lit(0.9))
    answers = docs.select(F.col("lang").alias("doc"), F.col("doc_id").alias("pos"), F.col("source").alias("query"), F.col("n_chars").cast("string").alias("value"), box.alias("box"), F.lit(0).alias("page"))
    pages = docs.select(F.col("lang").alias("doc"), F.lit(0).alias("page"), F.lit(100).alias("width"), F.lit(200).alias("height")).distinct()
    out = preview.annotations(answers, pages)
    return out.select(F.col("pos").alias("doc_id"), "colour", "label", "rect.x1", "rect.label_y")


@query("SELECT doc_id, lang, n_chars % 3 = 1 AS single, lang = 'en' AND source LIKE '%a%' AS wanted FROM documents")
def prj11_predicates(spark, d):
    docs = table(spark, d, "documents")
    kind = F.when(F.col("source").contains("a"), "report")
    evidence = F.sequence(F.lit(1), (F.col("n_chars") % 3).cast("int"))
    evidence = F.when(F.col("n_chars") % 3 == 0, F.array().cast("array<int>")).otherwise(evidence)
    return docs.select("doc_id", "lang", convert.single_page(evidence).alias("single"), convert.of_kinds(F.col("lang"), kind, ("report",)).alias("wanted"))


@query("SELECT doc_id AS path FROM (SELECT lpad(CAST(doc_id AS varchar), 12, '0') AS doc_id FROM documents) WHERE doc_id > '000000000100'")
def prj03_list_paths(spark, d):
    return search.list_paths(table(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path")), "000000000100")


@query("""WITH f AS (SELECT conv_id, list(DISTINCT role || turn ORDER BY role || turn) AS fields FROM conversations GROUP BY conv_id),
b AS (SELECT *, greatest(1, CAST(ceil(0.3 * len(fields)) AS integer)) AS lo FROM f)
SELECT conv_id, CAST(greatest(lo, least(2, greatest(lo, CAST(floor(0.9 * len(fields)) AS integer)))) AS integer) AS n, true AS known FROM b""")
def udf10_selected_queries(spark, d):
    """Two proposals (the last and the first field, one of them again, and an unknown one), clamped to the band."""
    f = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set(F.concat("role", F.col("turn").cast("string")))).alias("fields"))
    say = lambda x, q: F.struct(x.alias("field"), F.lit(q).alias("query"))
    last, first = F.element_at("fields", -1), F.element_at("fields", 1)
    proposals = F.array(say(last, " What? "), say(F.lit("other"), "x"), say(last, "again"), say(first, "Who?"))
    out = f.withColumn("s", generation.selected_queries(F.col("fields"), proposals, F.lit("question"), F.col("conv_id")))
    return out.select("conv_id", F.size("s").alias("n"), (F.forall("s", lambda x: F.array_contains("fields", x["field"])) & (F.col("s")[0]["query"] == "What?")).alias("known"))
