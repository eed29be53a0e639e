"""Token counts: pieces are counted once per distinct pre-token and summed over per-document frequencies.

No piece of the vocabulary has a word mark after its start, and none holds a line feed. So merges never cross the
start of a run of blanks or a line feed, and a text's count is the sum over the pre-tokens between them. No ids of
documents are ever made.

Plan: (1) tasks count pre-tokens, one shuffle sums them; (2) the tokenizer sees each distinct pre-token once, and the
table (pretoken, freq, pieces) is written to the shared folder; (3) documents take the counts of the HEAD_SIZE most
frequent pre-tokens from a broadcast dictionary of that bounded size (long ones stand there by a digest), and only their
other pre-tokens are shuffled, to the join with the table. Frequent (hot) pre-tokens thus never reach the join.

Null texts count as empty (0 tokens, 0 bytes). Repeated rows and null ids give a row each. Very long texts and pre-tokens
are counted whole, a text at a time. Empty tables give no rows. Other columns are ignored. Ties in frequency don't matter.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import arrow_schema, mapped, materialize, prepare, table

#: Most entries of the broadcast dictionary, and the longest pre-token that stands there as it is: 200,000 * 65 characters.
HEAD_SIZE, HEAD_CHARS = 200_000, 48
#: Distinct pre-tokens that a task holds before it passes its partial counts on.
FLUSH = 300_000
LIMIT = 4096

_PRETOKEN = re.compile(r" *[^ \n]+| +|\n")
MARK = "▁"


def pretokens(text: str | None) -> list[str]:
    """The text's pre-tokens; the blank that the tokenizer puts before a text is part of the first."""
    return _PRETOKEN.findall(f" {text}".replace(MARK, " ")) if text else []


@lru_cache(maxsize=2)
def load(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if MARK in piece.lstrip(MARK) or "\n" in piece:
            raise ValueError(f"piece {piece!r} crosses pre-tokens")
    return model


def piece_counts(words: list[str], path: str) -> list[int]:
    """Pieces of each pre-token. After a line feed the tokenizer adds no blank; mark and line feed are 2 pieces."""
    return [len(x) - 2 for x in load(path).encode(["\n" + w for w in words], num_threads=1)]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    vocabulary = _vocabulary(rows, model_path)
    head = spark.sparkContext.broadcast(_head(vocabulary))
    id_type = dict(rows.dtypes)["doc_id"]
    ddl = f"rid bigint, doc_id {id_type}, n_bytes bigint, known bigint, pretoken string, freq bigint"
    schema = arrow_schema(spark, ddl)

    def split(batches):
        from pyspark import TaskContext

        get, rid = head.value.get, TaskContext.get().partitionId() << 36
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(ids, batch.column(1).to_pylist()):
                known = 0
                for word, freq in Counter(pretokens(text)).items():
                    n = get(word if len(word) <= HEAD_CHARS else _digest(word))
                    if n is None:
                        for column, value in zip(out, (rid, None, None, 0, word, freq)):
                            column.append(value)
                    else:
                        known += n * freq
                # The document's own row gets a key that is no pre-token, so that such rows spread evenly over the join.
                for column, value in zip(out, (rid, doc_id, len((text or "").encode()), known, f"\n{rid}", 0)):
                    column.append(value)
                rid += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema)], schema=schema)

    parts = rows.mapInArrow(split, ddl)
    joined = parts.join(vocabulary.select("pretoken", "pieces").hint("merge"), "pretoken", "left")
    total = F.sum(F.col("known") + F.col("freq") * F.coalesce("pieces", F.lit(0)))
    summed = joined.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), total.alias("n_tokens"))
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _vocabulary(rows: DataFrame, model_path: str) -> DataFrame:
    """pretoken, freq, pieces of each distinct pre-token of all rows."""
    schema = arrow_schema(rows.sparkSession, "pretoken string, freq bigint")

    def tally(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(pretokens(text))
            if len(seen) > FLUSH:
                yield from flush(seen)
                seen = Counter()
        yield from flush(seen)

    def flush(seen):
        items = list(seen.items())
        for i in range(0, len(items), 20_000):
            words, freqs = zip(*items[i : i + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(freqs, type=pa.int64())], schema=schema)

    def measure(batch):
        words = batch.column(0).to_pylist()
        return {"pretoken": words, "freq": batch.column(1), "pieces": piece_counts(words, model_path)}

    summed = rows.select("text").mapInArrow(tally, "pretoken string, freq bigint").groupBy("pretoken").agg(F.sum("freq").alias("freq"))
    return materialize(mapped(summed, measure, "pretoken string, freq bigint, pieces bigint"))


def _head(vocabulary: DataFrame) -> dict[str, int]:
    """The most frequent pre-tokens: those above the frequency (in steps of an eighth power of 2) that keeps the bound."""
    level = F.floor(F.log2("freq") * 8)
    rows = vocabulary.withColumn("level", level)
    least, held = None, 0
    for row in sorted(rows.groupBy("level").count().collect(), key=lambda r: -r["level"]):  # some 500 levels at most
        held += row["count"]
        if held > HEAD_SIZE:
            break
        least = row["level"]
    if least is None:
        return {}
    key = F.when(F.length("pretoken") <= HEAD_CHARS, F.col("pretoken")).otherwise(F.concat(F.lit("\n"), F.sha2("pretoken", 256)))
    return {r["key"]: r["pieces"] for r in rows.filter(F.col("level") >= least).select(key.alias("key"), "pieces").toLocalIterator()}


def _digest(word: str) -> str:
    """What stands for a long pre-token; no pre-token starts with a line feed and goes on."""
    return "\n" + sha256(word.encode("utf-8", "surrogatepass")).hexdigest()


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
