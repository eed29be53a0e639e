"""N-gram Jaccard join with a MinHash LSH forest, and the classes of near duplicates it gives.

Method. Each text becomes the set of its hashed five-word shingles. Texts of equal sets form one class of copies,
which takes part once, with its number of rows. A forest of TREES tries holds the signatures: tree t's key is a run of
DEPTH min-hashes, and all signatures with the same prefix of that key meet (a prefix of d hashes is a node at depth d; nodes
are met by a hash of their prefix rather than by a sort of all keys, which a shuffle would need as well). Prefixes start at
full depth; the tree whose shortening gains the most recall for the fewest added pairs (counted over all data) is shortened
until a pair at the threshold is found with the target recall. Pairs that meet are pruned by the signature estimate, far
below the threshold (both bounds follow it), and then verified on the exact shingle sets. Each pair is verified only in the
first tree where it meets.

Scale. A bucket of more than BLOCK classes is split into blocks, and pairs of blocks are dealt to different tasks; what
a task emits is one row per linked document, never a row per pair. Texts are shuffled only for documents that have a
partner by estimate. Components come from alternating large-star and small-star steps over distributed edges that are
written to the shared folder after each step; the hubs among their vertices (a bounded number, by their degree) are
broadcast, so no task gets a hub's edges.

Definitions. Words are the runs between white space, in lower case. A text of 1 to 4 words is one shingle. Null and
empty texts (and blank ones) link to nothing: class_id is their own doc_id, n_links 0. Rows with a null id have a null
class_id and 0 links, and are no partners. Every row counts, repeated ones too: rows of one id with the same words are copies
of each other, with different texts they are rows of their own that share an id (and the least id of their class). A class's
id is its least doc_id, whatever its rows' order or ties. Very long texts are read whole. Empty tables give no rows.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import discard, groups, mapped, materialize, per_group, prepare, table

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH = 24, 6
TARGET_RECALL = 0.9999
#: A pair at the threshold has an estimate so many standard deviations below it with probability under 1e-7.
DEVIATIONS = 5.4
BLOCK = 256
#: Components: at most so many vertices are hubs, of at least so many edges.
HUBS, LEAST_HUB = 20_000, 64
#: Distinct shingles whose incidence a task holds as one dense block.
CHUNK = 4096

_SEED = np.random.default_rng(20_240_229)
_A = _SEED.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
_B = _SEED.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def shingle_sets(texts: list[str | None], n: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word n-grams.

    Words are hashed all at once: with powers of an odd base, prefix sums of the bytes give any word's polynomial.
    """
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    out, first = [], 0
    while first < len(raw):
        last, size = first, 0
        while last < len(raw) and (last == first or size + len(raw[last]) < 1 << 18):
            size += len(raw[last]) + 1
            last += 1
        out += _sets(raw[first:last], n)
        first = last
    return out


def _sets(raw: list[bytes], n: int) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    blank = _BLANK[data]
    edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), dtype=np.uint64)])
    h = _mixed((sums[ends] - sums[starts]) * _powers(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw])]))
    rolled = h[: max(0, len(h) - n + 1)].copy()
    for i in range(1, n):
        rolled = rolled * _MIX + h[i : len(h) - n + 1 + i] if len(rolled) else rolled
    rolled = _mixed(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:  # a short text is one shingle
            value = np.uint64(b - a)
            for x in h[a:b]:
                value = np.uint64((int(value) * int(_MIX) + int(x)) & (1 << 64) - 1)
            out.append(np.array([value], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """The set of one text."""
    return shingle_sets([text], n)[0]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of TREES * DEPTH min-hashes, 16 bits each, of non-empty sets."""
    out = np.empty((len(sets), TREES * DEPTH), np.uint16)
    start = 0
    while start < len(sets):  # some tens of thousands of shingles at a time stay in the cache
        end, total = start, 0
        while end < len(sets) and (end == start or total + len(sets[end]) <= 40_000):
            total += len(sets[end])
            end += 1
        flat = np.concatenate(sets[start:end])
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets[start : end - 1]])]).astype(np.int64)
        for k in range(TREES * DEPTH):
            least = np.minimum.reduceat(flat * _A[k] + _B[k], at)
            out[start:end, k] = _mixed(least) >> np.uint64(48)
        start = end
    return out


def tree_keys(sig: np.ndarray, depths: list[int]) -> np.ndarray:
    """For each signature and tree a 64-bit key of the prefix; rows by signature, columns by tree."""
    wide = sig.astype(np.uint64)
    out = np.empty((len(sig), TREES), np.uint64)
    for t in range(TREES):
        key = np.full(len(sig), t + 1, np.uint64) * _MIX
        for d in range(depths[t]):
            key = _mixed(key + wide[:, t * DEPTH + d] + np.uint64(d + 1))
        out[:, t] = key
    return out


def _sigs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, TREES * DEPTH)


def recall(depths: list[int], threshold: float = THRESHOLD) -> float:
    return 1 - float(np.prod([1 - threshold**d for d in depths]))


def least_depth(target: float = TARGET_RECALL, threshold: float = THRESHOLD) -> int:
    """The longest prefix that reaches the target recall if all trees have it."""
    for d in range(DEPTH, 0, -1):
        if recall([d] * TREES, threshold) >= target:
            return d
    raise ValueError(f"{TREES} trees can't reach a recall of {target} at threshold {threshold}")


def least_estimate(threshold: float = THRESHOLD) -> float:
    return threshold - DEVIATIONS * (threshold * (1 - threshold) / (TREES * DEPTH)) ** 0.5


def choose_depths(pairs: dict[tuple[int, int], int], target: float = TARGET_RECALL, threshold: float = THRESHOLD) -> list[int]:
    """Prefix length of each tree: shorten the one with most gain in log miss rate for an added pair until target is reached."""
    depths, least = [DEPTH] * TREES, least_depth(target, threshold)
    while recall(depths, threshold) < target:
        def worth(t):
            d = depths[t]
            if d == least:
                return -1.0
            gain = np.log((1 - threshold**d) / (1 - threshold ** (d - 1)))
            return gain / (1 + pairs.get((t, d - 1), 0) - pairs.get((t, d), 0))

        best = max(range(TREES), key=lambda t: (worth(t), -t))
        depths[best] -= 1
    return depths


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), n_links (other rows at or above the threshold) for each row."""
    signed, found = _classes(_rows(docs, id_col, text_col), threshold)
    found = found.select("mark", F.col("keeper.doc_id").alias("class_id"), "links")
    # Rows without a set get a mark of their own for the join, so that they spread evenly.
    keyed = signed.select("doc_id", F.coalesce("mark", F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.monotonically_increasing_id().cast("string"))).cast("binary")).alias("mark"))
    joined = keyed.join(found.hint("merge"), "mark", "left")
    named = F.col("doc_id").isNotNull()
    return joined.select("doc_id", F.when(named, F.coalesce("class_id", "doc_id")).alias("class_id"), F.when(named, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with docs' columns: that of the least id (and least text hash). Rows without id or words stay."""
    _, found = _classes(_rows(docs, id_col, text_col), threshold)
    keepers = found.select(F.col("keeper.doc_id").alias(id_col), F.col("keeper.th").alias("keeper_th")).distinct()
    columns, rows = docs.columns, docs.withColumn("keeper_th", F.xxhash64(text_col))
    worded = F.col(id_col).isNotNull() & F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # Repeated rows meet within tasks first, so many of one id and text are no hot key.
    once = rows.filter(worded).dropDuplicates([id_col, "keeper_th"])
    kept = once.join(keepers.hint("merge"), [id_col, "keeper_th"], "left_semi").select(*columns)
    return kept.unionByName(rows.filter(~worded).select(*columns))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row is known by its id and a hash of its text, as an id may have several texts."""
    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))


def _classes(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """doc_id, th, mark, sig of each row; mark, keeper (the class's least doc_id and th) and links of each set."""
    signed = materialize(_signed(rows))
    some = signed.filter("mark IS NOT NULL AND doc_id IS NOT NULL")
    sets = some.groupBy("mark").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"))
    # Numbers of the sets; written once, they don't change.
    reps = materialize(sets.select("mark", "first", "copies", "sig", F.monotonically_increasing_id().alias("rep")))
    depths = choose_depths(_pair_counts(reps, least_depth(threshold=threshold)), threshold=threshold)
    partners = materialize(_partners(reps, depths, least_estimate(threshold)))
    linked = materialize(_verified(rows, reps, partners, depths, threshold))
    links = linked.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    known = reps.select("mark", "rep", "first", "copies")
    classes = components(linked.filter("a != b").select("a", "b")).join(known.select("rep", "first").hint("merge"), "rep")
    least = classes.groupBy("class").agg(F.min("first").alias("keeper"))
    classes = classes.select("rep", "class").join(least.hint("merge"), "class").select("rep", "keeper")
    found = known.join(links, "rep", "left").join(classes, "rep", "left")
    return signed, materialize(found.select("mark", F.coalesce("keeper", "first").alias("keeper"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))


def _signed(rows: DataFrame) -> DataFrame:
    def sign(batch):
        texts = batch.column(2).to_pylist()
        sets = shingle_sets(texts)
        full = [s for s in sets if len(s)]
        sigs = iter(signatures(full)) if full else iter(())
        marks, out = [], []
        for s in sets:
            marks.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            out.append(next(sigs).tobytes() if len(s) else None)
        return {"doc_id": batch.column(0), "th": batch.column(1), "mark": marks, "sig": out}

    return mapped(rows, sign, f"doc_id {dict(rows.dtypes)['doc_id']}, th bigint, mark binary, sig binary")


def _pair_counts(reps: DataFrame, least: int) -> dict[tuple[int, int], int]:
    """Pairs that share a prefix, by tree and depth, over all classes of copies."""

    def emit(batch):
        sig = _sigs(batch.column(0))
        keys = [tree_keys(sig, [d] * TREES) for d in range(least, DEPTH + 1)]
        slot = np.arange(TREES * len(keys)).repeat(len(sig))
        return {"slot": slot, "key": np.concatenate([k.T.ravel() for k in keys]).view(np.int64)}

    met = mapped(reps.select("sig"), emit, "slot int, key bigint").groupBy("slot", "key").count().filter("count > 1")
    sums = met.groupBy("slot").agg(F.sum(F.expr("count * (count - 1) / 2")).cast("long").alias("pairs")).collect()  # a row per slot
    return {(r["slot"] % TREES, least + r["slot"] // TREES): r["pairs"] for r in sums}


def _partners(reps: DataFrame, depths: list[int], estimate: float) -> DataFrame:
    """gk (tree and block pair), tree, side, rep: the representatives with a partner there by the estimate."""

    def emit(batch):
        keys = tree_keys(_sigs(batch.column(1)), depths)
        return {"key": keys.ravel().view(np.int64), "tree": np.tile(np.arange(TREES), len(keys)), "rep": batch.column(0).to_numpy().repeat(TREES)}

    rows = mapped(reps.select("rep", "sig"), emit, "key bigint, tree int, rep bigint")
    met = materialize(rows.groupBy("key").count().filter("count > 1"))
    crowded = rows.join(met.hint("merge"), "key")
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    crowded = crowded.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = crowded.select("key", "tree", "rep", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("gk"), "tree", "rep",
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    signed = dealt.join(reps.select("rep", "sig").hint("merge"), "rep")

    def prune(part):
        gk, side, tree = (part.column(c).to_numpy() for c in ("gk", "side", "tree"))
        sig, keys = _sigs(part.column("sig")), None
        keys = tree_keys(sig, depths)
        keep = np.zeros(len(gk), bool)
        for start, end in groups(gk):
            mask = _meets(keys[start:end], side[start:end], int(tree[start]))
            if mask.any():
                i, j = np.nonzero(mask)
                for s in range(0, len(i), 8192):
                    a, b = i[s : s + 8192], j[s : s + 8192]
                    near = (sig[start + a] == sig[start + b]).mean(axis=1) >= estimate
                    keep[start + a[near]] = keep[start + b[near]] = True
        return {"gk": gk[keep], "tree": tree[keep], "side": side[keep], "rep": part.column("rep").to_numpy()[keep]}

    return per_group(signed, "gk", ["rep"], prune, "gk bigint, tree int, side int, rep bigint")


def _meets(keys: np.ndarray, side: np.ndarray, tree: int) -> np.ndarray:
    """Which pairs (upper half, and across the sides if there are two) meet first in this tree."""
    n = len(keys)
    mask = np.triu(np.ones((n, n), bool), 1)
    if side.any():
        mask &= side[:, None] != side[None, :]
    for t in range(tree):
        mask &= keys[:, None, t] != keys[None, :, t]
    return mask


def _verified(rows: DataFrame, reps: DataFrame, partners: DataFrame, depths: list[int], threshold: float) -> DataFrame:
    """a, b, links: a's links found in one group, and the least representative that it is linked with there."""
    wanted = partners.select("rep").distinct()
    facts = reps.select("rep", "copies", "sig", F.col("first.doc_id").alias("doc_id"), F.col("first.th").alias("th")).join(wanted, "rep", "left_semi")
    # Copies of a wanted row carry the same text; one of them is kept.
    facts = rows.join(facts.hint("merge"), ["doc_id", "th"]).dropDuplicates(["rep"]).select("rep", "copies", "sig", "text")
    full = partners.join(facts.hint("merge"), "rep")

    def verify(part):
        gk, side, tree, rep, copies = (part.column(c).to_numpy() for c in ("gk", "side", "tree", "rep", "copies"))
        keys = tree_keys(_sigs(part.column("sig")), depths)
        texts = part.column("text").to_pylist()
        out: tuple[list, list, list] = ([], [], [])
        for start, end in groups(gk):
            sets = shingle_sets(texts[start:end])
            mask = _meets(keys[start:end], side[start:end], int(tree[start]))
            near = similar(sets, mask, threshold)
            if not near.any():
                continue
            near = near | near.T
            weight = near @ copies[start:end]
            root = _roots(near, rep[start:end])
            for k in np.flatnonzero(weight):
                out[0].append(int(rep[start + k]))
                out[1].append(int(root[k]))
                out[2].append(int(weight[k]))
        return {"a": out[0], "b": out[1], "links": out[2]}

    return per_group(full, "gk", ["rep"], verify, "a bigint, b bigint, links bigint")


def similar(sets: list[np.ndarray], mask: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """The pairs of mask whose exact Jaccard similarity is at least threshold."""
    sizes = np.array([len(s) for s in sets])
    mask = mask & (np.minimum.outer(sizes, sizes) >= threshold * np.maximum.outer(sizes, sizes))
    i, j = np.nonzero(mask)
    out = np.zeros_like(mask)
    if len(i) <= 3 * len(sets):
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)])
    else:
        shared, both = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(both, kind="stable")
        both, owner, total = both[order], owner[order], np.zeros(mask.shape, np.float32)
        for first in range(0, len(shared), CHUNK):
            lo, hi = np.searchsorted(both, [first, first + CHUNK])
            block = np.zeros((len(sets), CHUNK), np.float32)
            block[owner[lo:hi], both[lo:hi] - first] = 1
            total += block @ block.T
        common = total[i, j]
    if len(i):
        near = common >= threshold * (sizes[i] + sizes[j] - common) - 1e-9
        out[i[near], j[near]] = True
    return out


def _roots(near: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """The least representative of each row's component."""
    root = rep.copy()
    while True:
        spread = np.minimum(root, np.where(near, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (spread == root).all():
            return root
        root = spread


def components(edges: DataFrame) -> DataFrame:
    """rep, class: the least member of the component of each end of an edge, by large-star and small-star steps."""
    cur = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    seen = None
    while True:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _with_least(both, least, "v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, cur = cur, materialize(large.filter("u != v").distinct())
        discard(old)
        least = cur.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _with_least(cur, least, "true")
        small = small.select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        old, cur = cur, materialize(small.filter("u != v").distinct())
        discard(old)
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return cur.groupBy(F.col("u").alias("rep")).agg(F.min("v").alias("class")).union(cur.select(F.col("v").alias("rep"), F.col("v").alias("class")).distinct())
        seen = now


def _with_least(edges: DataFrame, least: DataFrame, wanted: str) -> DataFrame:
    """The wanted edges (u, v) with m of their u (u, m, n: number of edges). Vertices of many edges come from a broadcast: with
    E edges, fewer than HUBS of them can have more than E / HUBS."""
    least = materialize(least)
    total = least.agg(F.sum("n")).first()[0] or 0
    hub = F.col("n") > max(LEAST_HUB, total // HUBS)
    met = edges.filter(wanted).join(F.broadcast(least.filter(hub).select("u", "m")), "u", "left")
    rest = met.filter("m IS NULL").select("u", "v").join(least.filter(~hub).select("u", "m").hint("merge"), "u")
    return met.filter("m IS NOT NULL").select("u", "v", "m").unionByName(rest.select("u", "v", "m"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
