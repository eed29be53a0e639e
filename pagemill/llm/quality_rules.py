"""Quality rules, line first: failing lines are removed, and documents that lose too much text are rejected.

All of it is DataFrame expressions on the text column: no shuffle, no Python. Per line: punctuation (few symbols, not a
run of exclamation marks, an end mark in lines of some length), navigation (separators between short parts) and
boilerplate (licence, cookie and copyright phrases, and lines that repeat an earlier line). The kept lines' characters
against all of them decide, after the base rules.

Null and empty texts have no words and fail the base rules (fewer than 50 words). Repeated rows each get a row, null ids
stay. Of equal lines the first is kept. Very long texts are read whole, within one row's arrays. Empty tables give no rows.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import table

#: In Java's regular expressions this is the six characters x20 and x09 to x0D.
BLANK = "\\s+"
#: Fixed values of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
#: The method's parameters: percent of a line's characters, least words of a line without end mark, percent of text kept.
MAX_SYMBOL_PERCENT, MAX_SHOUT_PERCENT, MIN_SEPARATORS, OPEN_LINE_WORDS, MIN_KEPT_PERCENT = 10, 50, 3, 8, 50
SEPARATORS = "|»›•·"
BOILERPLATE = (
    "licensed under", "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy",
    "accept cookies", "uses cookies", "enable javascript", "lorem ipsum", "subscribe to our", "sign up for", "log in to",
    "copyright (c)", "copyright ©", "powered by", "click here", "read more",
)
#: Marks that end a sentence or a quotation: Latin ones, then those of Indian, Arabic and East Asian scripts.
END = ".!?…:;\"'”’»)]" + "।॥" + "؟۔؛" + "。！？｡」』）…"
PHRASES = "(?i)(?<!\\w)(?:" + "|".join(p.replace("(", "\\(").replace(")", "\\)") for p in BOILERPLATE) + ")"
#: Up to so many different repeated windows at so many places are looked up one by one, more by a sort.
FEW, FEW_PLACES = 16, 64


def _others(text, chars: str):
    """Number of characters of text that are in chars."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def good_line(line, marked):
    """The line rules; each is a condition that a kept line meets. marked: the text has marks or phrases at all."""
    words = F.size(F.array_remove(F.split(line, BLANK), ""))
    bare = F.rtrim(line)
    ended = F.contains(F.lit(END), F.right(bare, F.lit(1))) | (words < OPEN_LINE_WORDS)
    symbols = 100 * _others(line, SYMBOLS) <= MAX_SYMBOL_PERCENT * F.length(line)
    shouts = 100 * _others(line, "!") <= MAX_SHOUT_PERCENT * words
    parts = _others(line, SEPARATORS) < MIN_SEPARATORS
    return ended & (~marked | (symbols & shouts & parts & ~line.rlike(PHRASES)))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_kept_percent: int = MIN_KEPT_PERCENT, cleaned: bool = False) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line_chars, kept_chars, base_failed, kept.

    With cleaned, also the text of the kept lines, joined by line feeds (for rejected documents too).
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("*", F.array_remove(F.split("text", BLANK), "").alias("w"), F.filter(F.split("text", "\n"), lambda x: x.rlike("\\S")).alias("lines"), F.col("text").rlike(f"[{SYMBOLS}!{SEPARATORS}]|{PHRASES}").alias("marked"))
    rows = rows.select("*", F.size("w").alias("n"), F.expr("length(bin(size(w)))").alias("bits"), F.array_distinct("lines").alias("own"))
    # Hashes of the windows. Where some are equal, the repeated ones are found: few by lookup and by coming together, many by a
    # sort of hash and start in one long, which makes equal windows neighbours. Hashes only propose; words are compared.
    starts = "CASE WHEN n < 3 THEN CAST(array() AS array<bigint>) ELSE transform(sequence(0, n - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) END"
    rows = rows.withColumn("h", F.expr(starts)).withColumn("mask", F.expr("shiftleft(1L, bits) - 1"))
    twice = "CASE WHEN size(array_distinct(h)) < size(h) THEN sort_array(h) ELSE CAST(array() AS array<bigint>) END"
    rows = rows.withColumn("s", F.expr(twice))
    rows = rows.withColumn("r", F.expr("CASE WHEN size(s) > 0 THEN array_distinct(filter(s, (x, j) -> j > 0 AND s[j - 1] = x)) ELSE s END"))
    few = "filter(transform(h, (x, i) -> CASE WHEN array_contains(r, x) THEN CAST(i AS bigint) END), x -> x IS NOT NULL)"
    rows = rows.withColumn("f", F.expr(f"CASE WHEN size(r) BETWEEN 1 AND {FEW} THEN {few} ELSE CAST(array() AS array<bigint>) END"))
    rows = rows.withColumn("q", F.expr(f"CASE WHEN size(r) > {FEW} OR size(f) > {FEW_PLACES} THEN sort_array(transform(h, (x, i) -> shiftleft(x, bits) | CAST(i AS bigint))) ELSE CAST(array() AS array<bigint>) END"))
    equal = "h[CAST(x AS int)] = h[CAST(y AS int)]" + "".join(f" AND w[CAST(x AS int) + {k}] = w[CAST(y AS int) + {k}]" for k in range(3))
    few = f"filter(f, x -> exists(f, y -> y <> x AND {equal}))"
    same = "shiftrightunsigned({0}, bits) = shiftrightunsigned({1}, bits) AND w[CAST({0} & mask AS int)] = w[CAST({1} & mask AS int)] AND w[CAST({0} & mask AS int) + 1] = w[CAST({1} & mask AS int) + 1] AND w[CAST({0} & mask AS int) + 2] = w[CAST({1} & mask AS int) + 2]"
    before, after = same.format("q[j - 1]", "x"), same.format("x", "q[j + 1]")
    many = f"sort_array(filter(transform(q, (x, j) -> CASE WHEN (j > 0 AND {before}) OR (j < size(q) - 1 AND {after}) THEN x & mask END), x -> x IS NOT NULL))"
    rows = rows.withColumn("p", F.expr(f"CASE WHEN size(r) = 0 THEN r WHEN size(q) = 0 THEN {few} ELSE {many} END"))
    covered = "aggregate(transform(p, (x, j) -> CASE WHEN j = size(p) - 1 THEN 3L ELSE least(3L, p[j + 1] - x) END), 0L, (a, x) -> a + x)"
    word_chars = F.length(F.array_join("w", "")).cast("long")
    chars = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    good = F.filter("own", lambda x: good_line(x, F.col("marked")))
    out = rows.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        word_chars.alias("word_chars"),
        F.when(F.col("text").rlike(f"[{SYMBOLS}]"), _others(F.col("text"), SYMBOLS)).otherwise(0).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size("own")).cast("long").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
        chars(F.col("lines")).alias("line_chars"),
        chars(good).alias("kept_chars"),
        *([F.array_join(good, "\n").alias("cleaned")] if cleaned else []),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("kept_chars") >= min_kept_percent * F.col("line_chars")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def _sql() -> str:
    count = lambda chars, of="x": f"(length({of}) - length(translate({of}, '{chars}', '')))"
    words = "len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+'))"
    end = END.replace("'", "''")
    phrases = PHRASES.replace("(?<!\\w)", "(?:^|[^0-9A-Za-z_])")
    good = f"(contains('{end}', right(rtrim(x), 1)) OR {words} < {OPEN_LINE_WORDS}) AND 100 * {count(SYMBOLS)} <= {MAX_SYMBOL_PERCENT} * length(x) AND 100 * {count('!')} <= {MAX_SHOUT_PERCENT} * {words} AND {count(SEPARATORS)} < {MIN_SEPARATORS} AND NOT regexp_matches(x, '{phrases}')"
    return f"""
WITH base AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) >= 3),
counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM starts),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM counted WHERE c >= 2) GROUP BY doc_id),
lined AS (SELECT doc_id, sum(length(x)) AS kept_chars FROM (SELECT doc_id, unnest(list_distinct(lines)) AS x FROM base) WHERE {good} GROUP BY doc_id),
facts AS (
  SELECT b.doc_id, CAST(len(w) AS bigint) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS bigint) AS word_chars,
         CAST({count(SYMBOLS, 'text')} AS bigint) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS bigint) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS bigint) AS n_repeat_words, CAST(coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) AS bigint) AS line_chars, CAST(coalesce(l.kept_chars, 0) AS bigint) AS kept_chars
  FROM base b LEFT JOIN covered c ON b.doc_id = c.doc_id LEFT JOIN lined l ON b.doc_id = l.doc_id)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND 100 * kept_chars >= {MIN_KEPT_PERCENT} * line_chars AS kept
FROM facts"""


SQL = _sql()
