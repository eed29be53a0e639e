"""Benchmark decontamination by template canonicalisation.

Numbers, units and names become typed placeholders (a unit with its kind: length, time, ...; a name is a run of capitalised
words), so that a question asked again with other values has the same template. Windows of WINDOW template tokens of
documents and of benchmark items are hash-joined; on each alignment the slots are compared: an item's value has to stand for
one value of the document, and no two of the item for the same one. This has to hold over all alignments of a document and
an item together; where it doesn't, the alignment with most windows counts alone. The same windows of plain words (case
folded, values as they stand) are joined as well: they find copies in any case, and texts of little but values.
An item is leaked if its windows of either sort cover MIN_COVER percent of it or MIN_RUN windows. A template window with
fewer than MIN_LITERALS words counts where a window with more is met on the same alignment, or where the item's whole
template is (found by its window with most words); items without any word in their windows have nothing but their values.

All of it is DataFrame expressions. The benchmark's windows are counted first and broadcast only up to BROADCAST_WINDOWS
(a bound of 32 bytes each), its texts up to BROADCAST_BYTES; beyond it they are shuffled to sort-merge joins. Slots are
compared only in documents with matching windows. Matches grow with the leaks found, not with pairs of documents. They are
used twice, so they are written to the shared folder once; the documents are cut into windows in a single pass.

Result: a row per document and leaked item (doc_id, item_id, n_windows, cover_percent, n_slots); clean documents have none.
Null and empty texts (also those of punctuation alone) and rows with a null id give no rows; repeated rows of one id count
once, of different texts of one id the one with the larger cover. Very long texts are cut into windows whole. Items shorter
than a window match as a whole anywhere in a document: windows of each of their lengths are joined too, by their words; with
other values from 3 words on (with fewer words, only where they are the whole document). Either table may be empty. Other
columns are ignored. Of alignments with equally many windows the first counts.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.common import materialize, table

#: Template tokens of a window, and how many of them must not be placeholders.
WINDOW, MIN_LITERALS = 8, 4
MIN_COVER, MIN_RUN = 50, 12
#: How an item's window is joined: by its template, by its words, by its template to compare the whole item there, or to whole documents.
TEMPLATE, RAW, ANCHOR, WHOLE = range(4)
BROADCAST_WINDOWS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: Placeholders, and what joins the words of a name: private characters, which texts lose first.
NUM, UNIT, NAME, JOIN = "", "", "", ""
#: What stands between tokens: white space and punctuation. One by one, the Latin ones make a bit table in Java, ranges don't.
BETWEEN = "[" + "".join(f"\\x{c:02x}" for c in (*range(128), 0x85, 0xA0, 0xA1, 0xAB, 0xBB, 0xBF) if not chr(c).isalnum()) + "\\u2010-\\u2027\\u2039\\u203a]+"
#: Units by what they measure.
UNIT_KINDS = {
    "mass": "kg mg g lb lbs oz gram grams kilogram kilograms", "length": "km cm mm m mi ft in mile miles meter meters metre metres kilometer kilometers",
    "volume": "l ml liter liters litre litres", "speed": "mph kmh", "frequency": "hz khz mhz ghz", "data": "kb mb gb tb", "power": "kwh kw w v",
    "money": "usd eur gbp dollar dollars cent cents euro euros pound pounds", "share": "percent",
    "time": "second seconds minute minutes hour hours day days week weeks month months year years",
}
_KIND_OF = {unit: kind for kind, units in UNIT_KINDS.items() for unit in units.split()}
UNITS = "|".join(sorted(_KIND_OF, key=lambda u: (-len(u), u)))
_PLACEHOLDER = "ascii(x) BETWEEN 57344 AND 57346"


def canonical(text: Column) -> Column:
    """The text's tokens in lower case; those of numbers, units and names with their placeholder before them."""
    odd = text.contains(NUM) | text.contains(UNIT) | text.contains(NAME) | text.contains(JOIN)
    text = F.when(odd, F.translate(text, NUM + UNIT + NAME + JOIN, "    ")).otherwise(text)
    numbers = F.regexp_replace(text, f"(?i)(?<!\\S)[^\\s\\p{{L}}\\d]*(\\d[\\d.,]*)\\s{{0,2}}({UNITS})(?![\\p{{L}}\\p{{N}}])", f"{NUM}$1 {UNIT}$2")
    numbers = F.regexp_replace(numbers, f"(?<!\\S)[^\\s\\p{{L}}\\d{NUM}]*(\\d[^\\s\\p{{L}}{UNIT}]*)(?!\\S)", f"{NUM}$1 ")
    numbers = F.regexp_replace(numbers, "(?<=\\d)[^\\s\\p{L}\\p{N}]+(?=\\d)", "")
    t = F.when(text.rlike("\\d"), numbers).otherwise(text)
    t = F.regexp_replace(t, " (?=\\p{Lu}\\p{Ll})(?<=[\\p{Ll},;] \\p{Lu}\\p{Ll}{1,60} )", JOIN)
    # Possessive: otherwise Java's expressions go one call deeper for each word of a name, and a long list of names ends the executor.
    t = F.regexp_replace(t, f" (?=\\p{{Lu}})(?<=[\\p{{Ll}},;] )(\\p{{Lu}}\\p{{Ll}}++(?:{JOIN}\\p{{Lu}}\\p{{Ll}}++(?![\\p{{L}}\\p{{N}}]))*+)(?![\\p{{L}}\\p{{N}}])", f" {NAME}$1")
    return F.array_remove(F.split(F.lower(t), BETWEEN), "")


def template(v: Column) -> Column:
    """Template tokens of canonical ones: placeholders without their values, units with their kinds."""
    kinds = F.create_map(*[F.lit(x) for x in chain(*_KIND_OF.items())])
    kind = lambda x: F.concat(F.lit(UNIT), F.coalesce(F.element_at(kinds, F.substr(x, F.lit(2))), F.lit("")))
    return F.transform(v, lambda x: F.when(F.ascii(x) == 57344, NUM).when(F.ascii(x) == 57345, kind(x)).when(F.ascii(x) == 57346, NAME).otherwise(x))


def words(v: Column) -> Column:
    """Plain words of canonical tokens; a name gives each of its words."""
    bare = lambda x: F.when((F.ascii(x) >= 57344) & (F.ascii(x) <= 57346), F.substr(x, F.lit(2))).otherwise(x)
    return F.flatten(F.transform(v, lambda x: F.split(bare(x), JOIN)))


def _hashes(rows: DataFrame, name: str) -> DataFrame:
    """Adds name_1, name_2, ... up to name_WINDOW: the hashes of all windows of so many tokens of the array in the column name."""
    rows = rows.withColumn(f"{name}_1", F.expr(f"transform({name}, x -> xxhash64(x))"))
    k = 1
    # Each step joins two neighbouring windows of half the length, so a window costs three short hashes and no slice.
    while k < WINDOW:
        h, size = f"{name}_{k}", f"greatest(0, size({name}_{k}) - {k})"
        rows = rows.withColumn(f"{name}_{2 * k}", F.expr(f"zip_with(slice({h}, 1, {size}), slice({h}, {k + 1}, {size}), (x, y) -> xxhash64(x, y))"))
        k *= 2
    return rows


def _span(name: str, length: int) -> str:
    """The hashes of all windows of fewer than WINDOW tokens, each from two of a power of two that overlap."""
    k = 1 << (length.bit_length() - 1)
    size = f"greatest(0, size({name}) - {length - 1})"
    return f"zip_with(slice({name}_{k}, 1, {size}), slice({name}_{k}, {length - k + 1}, {size}), (x, y) -> xxhash64({length}, x, y))"


def _windows(rows: DataFrame, keys: list[str], lengths: list[int], both: bool) -> DataFrame:
    """keys, t, r, n (tokens of that sort), plain, length, raw, hash and start of each window of WINDOW tokens or one of lengths.

    raw: of plain words, else of template tokens. A plain text has the same windows of either; with both they come twice.
    """
    tokens = rows.select(*keys, canonical(F.col("text")).alias("v"))
    tokens = tokens.withColumn("open", F.expr(f"exists(v, x -> {_PLACEHOLDER})"))
    tokens = tokens.withColumn("t", F.when(F.col("open"), template(F.col("v"))).otherwise(F.col("v")))
    tokens = tokens.withColumn("r", F.when(F.col("open"), words(F.col("v"))).otherwise(F.col("v") if both else F.lit(None)))
    tokens = _hashes(_hashes(tokens.select(*keys, "open", "t", "r"), "t"), "r")
    spans = [(WINDOW, raw, f"{'r' if raw else 't'}_{WINDOW}") for raw in (False, True)]
    spans += [(k, raw, _span("r" if raw else "t", k)) for k in lengths for raw in (False, True)]
    # The outer form: from the inner one the optimizer infers a filter on the array, which would make everything twice.
    held = [*keys, "t", "r"] if both else keys
    out = tokens.select(*held, F.size("t").alias("nt"), F.size("r").alias("nr"), (~F.col("open")).alias("plain"), F.posexplode_outer(F.array(*[F.expr(h) for _, _, h in spans])).alias("span", "hashes"))
    length, raw = (F.element_at(F.array(*[F.lit(x[i]) for x in spans]), F.col("span") + 1) for i in (0, 1))
    out = out.select(*held, "nt", "nr", "plain", length.alias("length"), raw.alias("raw"), F.posexplode_outer("hashes").alias("start", "hash"))
    return out.select(*held, F.when(F.col("raw"), F.col("nr")).otherwise(F.col("nt")).alias("n"), "plain", "length", "raw", "start", "hash").filter("hash IS NOT NULL")


def _wanted(items: DataFrame) -> DataFrame:
    """item_id, item_n, item_start, hash and kind of the items' windows.

    Kinds: RAW: by words; TEMPLATE; ANCHOR: the template window with most words of an item without any of that kind, to find
    where its whole template may be, and WHOLE: a short item of few words, whose template counts only where it is the whole
    document.
    """
    rows = _windows(items, ["item_id"], list(range(1, WINDOW)), True).filter(f"length = least(n, {WINDOW})")
    rows = rows.withColumn("literals", F.expr(f"size(filter(slice(t, start + 1, length), x -> NOT ({_PLACEHOLDER})))"))
    own = Window.partitionBy("item_id", "t")
    rows = rows.withColumn("best", F.max(F.when(~F.col("raw"), F.struct("literals", (-F.col("start")).alias("at")))).over(own))
    kind = f"""CASE WHEN raw THEN {RAW} WHEN literals >= {MIN_LITERALS} OR literals = n OR n < {WINDOW} AND literals >= 3 THEN {TEMPLATE}
        WHEN n < {WINDOW} THEN {WHOLE} WHEN best.literals BETWEEN 1 AND {MIN_LITERALS - 1} AND start = -best.at THEN {ANCHOR} END"""
    rows = rows.select("item_id", F.col("n").alias("item_n"), F.col("start").alias("item_start"), "hash", F.expr(kind).alias("kind"))
    return rows.filter("kind IS NOT NULL").distinct()


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_limit: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, item_id, n_windows, cover_percent, n_slots of each leak: the best of an id's texts."""
    out = leaked_texts(docs, items, id_col, text_col, item_id, item_text, broadcast_limit)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("cover_percent", "n_windows", "n_slots")).alias("x"))
    return best.select("doc_id", "item_id", "x.n_windows", "x.cover_percent", "x.n_slots")


def leaked_texts(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_limit: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, th, item_id, n_windows, cover_percent, n_slots of each text with a leak; th: xxhash64 of the text."""
    # A row is known by its id and a hash of its text, as an id may have several texts.
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("th", F.xxhash64("text"))
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    wanted = materialize(_wanted(items))
    small = wanted.count() <= broadcast_limit
    light = small and (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= BROADCAST_BYTES
    lengths = [r["item_n"] for r in wanted.filter(f"item_n < {WINDOW}").select("item_n").distinct().orderBy("item_n").collect()]  # 7 at most
    seen = _windows(docs, ["doc_id", "th"], lengths, False).select("doc_id", "th", "n", "start", "hash", "raw", F.col("plain").alias("doc_plain"))
    met = seen.join(F.broadcast(wanted) if small else wanted, "hash").filter(f"(doc_plain OR raw = (kind = {RAW})) AND (kind <> {WHOLE} OR n = item_n)")
    keys = ["doc_id", "th", "item_id", "item_n", "raw"]
    met = met.select(*keys[:-1], (F.col("kind") == RAW).alias("raw"), "item_start", "kind", (F.col("start") - F.col("item_start")).alias("shift"), "doc_plain").distinct()
    starts = F.array_sort(F.collect_set(F.expr(f"CASE WHEN kind <> {ANCHOR} THEN item_start END")))
    runs = materialize(met.groupBy(*keys, "shift").agg(starts.alias("starts"), F.bool_and(F.col("doc_plain") | F.col("raw")).alias("clear")))
    clear = runs.filter("clear").select(*keys, "shift", "starts", F.expr("CAST(array() AS array<struct<a: string, b: string>>)").alias("pairs"), F.lit(0).cast("long").alias("slots"))
    checked = clear.unionByName(_slots(runs.filter("NOT clear"), docs, items, light))
    held = checked.filter("size(starts) > 0").groupBy(*keys).agg(F.collect_list(F.expr("struct(size(starts) AS size, -shift AS first, starts, pairs, slots)")).alias("runs"))
    used = held.withColumn("used", F.expr(f"CASE WHEN {_right('flatten(runs.pairs)')} THEN runs ELSE array(array_max(runs)) END"))
    out = used.select("doc_id", "th", "item_id", "item_n", F.expr("CAST(size(array_distinct(flatten(used.starts))) AS bigint)").alias("n_windows"), F.expr("aggregate(used.slots, 0L, (a, x) -> a + x)").alias("n_slots"))
    out = out.withColumn("cover_percent", F.round(100 * F.col("n_windows") / F.greatest(F.lit(1), F.col("item_n") - WINDOW + 1), 3))
    return out.filter((F.col("cover_percent") >= MIN_COVER) | (F.col("n_windows") >= MIN_RUN))


def _right(pairs: str) -> str:
    """Pairs of values are a function, and one to one: as many pairs as values on either side."""
    kinds = lambda p: f"size(array_distinct({p}))"
    return f"({kinds(pairs)} = {kinds(f'transform({pairs}, x -> x.a)')} AND {kinds(pairs)} = {kinds(f'transform({pairs}, x -> x.b)')})"


def _slots(runs: DataFrame, docs: DataFrame, items: DataFrame, light: bool) -> DataFrame:
    """runs with the starts that count on each alignment, pairs (values of the item and the document there) and slots (placeholders covered).

    An alignment with a window of enough words, or on which the whole template is equal, takes in all its windows with
    equal templates; if their slots don't agree, only those of enough words, if these don't either, none.
    """
    some = docs.join(runs.select("doc_id", "th").distinct(), ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"])
    own = items.select("item_id", canonical(F.col("text")).alias("it")).distinct().withColumn("im", template(F.col("it")))
    texts = some.select("doc_id", "th", canonical(F.col("text")).alias("dt")).withColumn("dm", template(F.col("dt")))
    both = runs.join(F.broadcast(own) if light else own, "item_id").join(texts, ["doc_id", "th"])
    # A capitalised word may be a name in one text and open the other, so equal values are equal too.
    bare = lambda x: f"ltrim('{NUM}{UNIT}{NAME}', {x})"
    same = f"im[k] <=> get(dm, k + shift) OR {bare('get(it, k)')} <=> {bare('get(dt, k + shift)')}"
    both = both.withColumn("other", F.expr(f"filter(sequence(0, item_n - 1), k -> NOT ({same}))"))
    full = f"""CASE WHEN size(starts) > 0 OR size(other) = 0 THEN
        filter(sequence(0, greatest(0, item_n - {WINDOW})), s -> NOT exists(other, k -> k BETWEEN s AND s + {WINDOW - 1})) ELSE array() END"""
    both = both.withColumn("full", F.expr(f"array_union(starts, {full})"))
    places = lambda s: f"filter(array_distinct(flatten(transform({s}, s -> sequence(s, s + least({WINDOW}, item_n) - 1)))), k -> ascii(get(it, k)) BETWEEN 57344 AND 57346)"
    pairs = lambda s: F.expr(f"transform({places(s)}, k -> struct(get(it, k) AS a, get(dt, k + shift) AS b))")
    both = both.withColumn("full_pairs", pairs("full")).withColumn("starts_pairs", pairs("starts"))
    both = both.withColumn("starts", F.expr(f"CASE WHEN {_right('full_pairs')} THEN full WHEN {_right('starts_pairs')} THEN starts ELSE array() END"))
    both = both.withColumn("pairs", pairs("starts"))
    return both.select("doc_id", "th", "item_id", "item_n", "raw", "shift", "starts", "pairs", F.size("pairs").cast("long").alias("slots"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
