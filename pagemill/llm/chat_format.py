"""Chat formatting: raw transcripts are parsed into turns by a hidden Markov model, then rendered in a canonical form.

A transcript is one text: turns of some lines, with a speaker marker ("User:", "### Response:", "[BOT]") before most
turns and none before others. The hidden state of a line is its role and whether a turn starts there: a line either
goes on with its predecessor's turn or starts one of any role. It emits its marker, whether a blank line stands before
it, its length and whether it asks. Viterbi decoding gives turns and roles at once. A marker is taken off only where a
turn of its role was decoded; elsewhere it is text ("Note: buy milk") and stays. A marker counts as one only in its
transcript's own style: the form and family of names that most marked lines have, if two roles speak in it or it opens
the text. Control marks within a text are escaped ("<|" as "<\\|"), so no text can open a turn.

Probabilities are counts (with smoothing) of at most SAMPLE rows of whole labelled conversations, chosen by a hash.

Scale: a conversation comes as parts of at most BLOCK messages. A conversation of several parts is decoded as its whole text
would be: the parts' counts of markers, their opening and last lines are gathered first and give the conversation's style;
with it each part gives the best score from each role before it to each role at its end (a 3 x 3 matrix), these are chained
along the conversation, and each part is then decoded between its true roles at both ends. A task holds one part beside a
batch. Where turn numbers are far apart (times), parts are shorter, which changes no result.

Line feeds around a turn are dropped (but for those at a part's end within them), all other text is kept. Null and empty transcripts are one empty turn. Messages of
one turn number stay in the order of their texts, null turn numbers come first, repeated rows are messages of their own;
each row with a null conversation id is a transcript of its own. Equally likely readings: rather no new turn, then the
first role. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import arrow_schema, emit, held_out, mapped, materialize, per_group, prepare, table

ROLES = ("system", "user", "assistant")
SAMPLE, BLOCK = 20_000, 256
#: Speaker names (system, user, assistant) that common transcript formats use together.
FAMILIES = (
    ("system", "user", "assistant"), ("system", "human", "ai"), ("context", "instruction", "response"), ("note", "q", "a"), ("system", "user", "bot"),
    ("context", "question", "answer"), ("system", "customer", "agent"), ("system", "client", "agent"), ("system", "you", "bot"), ("system", "user", "model"),
)
#: Forms of markers; NAME stands for a speaker's name.
FORMS = (r"###\s*(NAME)\s*:?", r"<\|(NAME)\|>", r"\[(NAME)\]:?", r"\*\*(NAME):?\*\*:?", r"(NAME)\s*:")
#: What written() writes: markers of the roles, and what stands between turns.
STYLES = (
    ("System: ", "User: ", "Assistant: ", "\n"), ("System: ", "Human: ", "AI: ", "\n\n"), ("### Context:\n", "### Instruction:\n", "### Response:\n", "\n\n"),
    ("Note: ", "Q: ", "A: ", "\n"), ("<|system|>\n", "<|user|>\n", "<|assistant|>\n", "\n"), ("[SYSTEM] ", "[USER] ", "[BOT] ", "\n\n"),
)
_NAMES = "|".join(sorted({n for f in FAMILIES for n in f}, key=lambda n: (-len(n), n)))
_MARKER = re.compile(r"\s*(?:" + "|".join(f.replace("NAME", _NAMES) for f in FORMS) + r")[ \t]*", re.I)
#: A line's marker: none, one of a role, or one of another style.
NONE, FOREIGN, CLASSES = 0, 4, 5
LENGTHS = 8


def marked(lines: list[str]) -> tuple[list, list]:
    """The marker's match of each line, and its form and name (null without one)."""
    found = [_MARKER.match(x) for x in lines]
    return found, [(next(i for i, g in enumerate(m.groups()) if g), m.group(m.lastindex).lower()) if m else None for m in found]


def opening_of(lines: list[str], said: list) -> tuple[bool, tuple | None]:
    """Whether there is a line that isn't blank, and the first such line's marker."""
    return next(((True, x) for x, line in zip(said, lines) if line.strip()), (False, None))


def style_of(counts, opening: tuple | None) -> tuple[int, tuple[str, ...]] | None:
    """The form and family of names of a transcript: what most marked lines have, if two roles speak in it or it opens the text."""
    own = None
    for form in sorted({f for f, _ in counts}):
        for family in FAMILIES:
            spoken = [counts.get((form, n), 0) for n in family]
            if sum(map(bool, spoken)) > 1 or opening and opening[0] == form and opening[1] in family:
                if own is None or sum(spoken) > own[0]:
                    own = sum(spoken), form, family
    return own and own[1:]


#: For observe(): the style is the text's own.
OWN = object()


def observe(text: str | None, style=OWN, blank: int = 1) -> list[tuple[tuple[int, int, int, int], int]]:
    """For each line: marker class, blank line before, length bucket, asks; and where the text after the marker starts.

    A part of a transcript gets the whole one's style, and whether its predecessor ends with a blank line.
    """
    lines = (text or "").split("\n")
    found, said = marked(lines)
    if style is OWN:
        style = style_of(Counter(x for x in said if x), opening_of(lines, said)[1])
    out = []
    for line, m, x in zip(lines, found, said):
        marker = NONE
        if x:
            marker = 1 + style[1].index(x[1]) if style and x[0] == style[0] and x[1] in style[1] else FOREIGN
        out.append(((marker, blank, min(LENGTHS - 1, len(line).bit_length()), int(line.rstrip().endswith("?"))), m.end() if m else 0))
        blank = int(not line.strip())
    return out


class Model:
    """Log probabilities: the first role, going on or starting a turn of each role, and what lines emit."""

    def __init__(self, conversations: list[list[tuple[str, str | None]]]):
        """From labelled conversations: role and text, marker included, of each turn."""
        first, moves, stays, seen, lines = Counter(), Counter(), Counter(), Counter(), Counter()
        for turns in conversations:
            known = [(ROLES.index(role), (text or "")) for role, text in turns if role in ROLES]
            observed = iter(observe("\n".join(t for _, t in known)) if known else ())
            before = None
            for r, text in known:
                first.update([r] if before is None else [])
                moves.update([] if before is None else [(before, r)])
                for k in range(text.count("\n") + 1):
                    seen.update((r, k > 0, n, x) for n, x in enumerate(next(observed)[0]))
                    lines[r, k > 0] += 1
                stays[r] += text.count("\n")
                before = r
        self.first = [log((first[r] + 0.5) / (first.total() + 1.5)) for r in range(3)]
        ends = [sum(moves[a, b] for b in range(3)) for a in range(3)]
        self.stay = [log((stays[a] + 0.5) / (stays[a] + ends[a] + 1)) for a in range(3)]
        self.moves = [[log((ends[a] + 0.5) / (stays[a] + ends[a] + 1) * (moves[a, b] + 0.05) / (ends[a] + 0.15)) for b in range(3)] for a in range(3)]
        sizes = (CLASSES, 2, LENGTHS, 2)
        self.emit = [[[[log((seen[r, later, n, x] + 0.1) / (lines[r, later] + 0.1 * sizes[n])) for x in range(sizes[n])] for n in range(4)] for later in (False, True)] for r in range(3)]
        self._known: dict[tuple, list] = {}

    def _line(self, seen: tuple[int, int, int, int]) -> list[tuple[float, float]]:
        """For each role the log probability of a line as a turn's first one and as a later one."""
        found = self._known.get(seen)
        if found is None:
            found = self._known[seen] = [tuple(sum(e[n][x] for n, x in enumerate(seen)) for e in self.emit[r]) for r in range(3)]
        return found

    def scores(self, observed, entry: int | None):
        """The best scores of the roles at the end, and the steps back (role before, turn starts) of each line. entry: the role before, None at the start."""
        none = float("-inf")
        score, back = [none if entry is None or r != entry else 0.0 for r in range(3)], []
        stay, moves = self.stay, self.moves
        for k, (seen, _) in enumerate(observed):
            emits, new, step = self._line(seen), [], []
            for r in range(3):
                if k == 0 and entry is None:
                    best, come = self.first[r], r
                else:
                    best, come = none, 0
                    for a in range(3):
                        z = score[a] + moves[a][r]
                        if z > best:
                            best, come = z, a
                start = best + emits[r][0]
                on = score[r] + stay[r] + emits[r][1]
                new.append(max(start, on))
                step.append((come, True) if start > on else (r, False))
            score = new
            back.append(step)
        return score, back

    def decode(self, observed, entry: int | None = None, exit_: int | None = None) -> list[tuple[int, bool]]:
        """Role of each line, and whether a turn starts there, by Viterbi; exit_: the last line's role, where it is known."""
        score, back = self.scores(observed, entry)
        return follow(back, max(range(3), key=lambda r: score[r]) if exit_ is None else exit_)

    def __getstate__(self):
        return self.__dict__ | {"_known": {}}


def follow(back, role: int) -> list[tuple[int, bool]]:
    out = []
    for step in reversed(back):
        before, starts = step[role]
        out.append((role, starts))
        role = before
    return out[::-1]


def turns_of(text: str | None, model: Model, entry: int | None = None, exit_: int | None = None, style=OWN, blank: int = 1, goes_on: bool = False) -> list[tuple[int, int, bool, str]]:
    """role, start, whether it opens a turn, and text without marker of each turn (or rest of one) of a transcript's part.

    Line feeds are dropped where a turn begins and ends, not where it goes over the part's ends."""
    observed = observe(text, style, blank)
    lines, out, at = (text or "").split("\n"), [], 0
    for line, (seen, end), (role, starts) in zip(lines, observed, model.decode(observed, entry, exit_)):
        if starts or not out:
            own = line[end:] if starts and seen[0] == role + 1 else line
            out.append((role, at, starts, [own]))
        else:
            out[-1][3].append(line)
        at += len(line) + 1
    cut = lambda said, begins, ends: (lambda x: x.rstrip("\n") if ends else x)(said.lstrip("\n") if begins else said)
    return [(role, start, opens, cut("\n".join(said), opens, k + 1 < len(out) or not goes_on)) for k, (role, start, opens, said) in enumerate(out)]


def rendered(role: int, text: str, opens: bool = True, closes: bool = True) -> str:
    """The canonical form of a turn; of a part of one without the header or the end."""
    head, tail = (f"<|im_start|>{ROLES[role]}\n" if opens else "\n"), ("<|im_end|>\n" if closes else "")
    return head + text.replace("<|", "<\\|") + tail


def written(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", unmarked_percent: int = 20) -> DataFrame:
    """conv_id, turn, role, text as logs have it: in one of STYLES for each conversation, a part of the markers missing."""
    style = F.pmod(F.xxhash64(F.col(conv_col)), F.lit(len(STYLES)))
    bare = (F.pmod(F.xxhash64(F.col(conv_col), F.col(turn_col), F.lit(1)), F.lit(100)) < unmarked_percent) & (F.coalesce(F.col(turn_col), F.lit(1)) > 0)
    said, gap = F.lit(""), F.lit("")
    for s, (*markers, between) in enumerate(STYLES):
        gap = F.when(style == s, F.lit(between[1:])).otherwise(gap)
        for role, text in zip(ROLES, markers):
            said = F.when((style == s) & (F.col(role_col) == role), F.lit(text)).otherwise(said)
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = F.concat(F.when(bare, F.lit("")).otherwise(said), text, gap)
    return turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), text.alias("text"))


def transcripts(messages: DataFrame) -> DataFrame:
    """conv_id, part, text: messages (conv_id, turn, text) of each conversation in their order, in parts of at most BLOCK."""
    prepare(messages.sparkSession)
    kind = dict(messages.dtypes)["conv_id"]
    rows = messages.select("conv_id", F.floor(F.coalesce(F.greatest(F.col("turn"), F.lit(-1)), F.lit(-1)) / BLOCK).cast("long").alias("block"), "turn", F.coalesce("text", F.lit("")).alias("text"))
    # Rows without conversation are alone: each gets a number of its own.
    lone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).otherwise(-1)
    rows = rows.withColumn("lone", lone)
    dealt = rows.repartition(F.col("conv_id"), F.col("block"), F.col("lone")).sortWithinPartitions("conv_id", "lone", "block", F.col("turn").asc_nulls_first(), "text")
    names, ddl = ("conv_id", "part", "text"), f"conv_id {kind}, part bigint, text string"
    schema = arrow_schema(messages.sparkSession, ddl)

    def join(batches):
        out, held, key, part = ([], [], []), [], None, 0

        def close():
            if held:
                for column, value in zip(out, (key[0], (key[2] + 1 << 32) + part, "\n".join(held))):
                    column.append(value)
                held.clear()

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "lone", "block", "text")]
            for *own, text in zip(*columns):
                if own != key or len(held) == BLOCK:
                    close()
                    key, part = own, part + 1 if own == key else 0
                held.append(text)
            yield from emit(dict(zip(names, out)), names, schema)
            for column in out:
                column.clear()
        close()
        yield from emit(dict(zip(names, out)), names, schema)

    return dealt.mapInArrow(join, ddl)


def fit(labelled: DataFrame) -> Model:
    """A model from a hashed sample of whole conversations (conv_id, turn, role, text); those of more than SAMPLE rows are left out."""
    rows = labelled.select("conv_id", "turn", "role", "text").filter("conv_id IS NOT NULL")
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= SAMPLE)
    total = sizes.agg(F.sum("n")).first()[0] or 1
    chance = F.pmod(F.xxhash64(F.lit(5), "conv_id"), F.lit(1 << 30)) / float(1 << 30)
    some = rows.filter(chance < SAMPLE / total).join(sizes.select("conv_id").hint("merge"), "conv_id", "left_semi")
    talks: dict = {}
    for r in some.toLocalIterator():
        talks.setdefault(r["conv_id"], []).append((r["turn"] is not None, r["turn"] or 0, r["text"] or "", r["role"]))
    return Model([[(role, text) for _, _, text, role in sorted(talks[k], key=lambda x: x[:3])] for k in sorted(talks, key=str)])


def _several(parts: DataFrame) -> DataFrame:
    """conv_id, part, text, opens of the parts of conversations of several parts."""
    several = parts.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("least")).filter("n > 1")
    return parts.join(several.hint("merge"), "conv_id").select("conv_id", "part", "text", (F.col("part") == F.col("least")).alias("opens"))


def _styles(parts: DataFrame) -> DataFrame:
    """conv_id, part, form, family, blank of the parts of conversations of several parts: the style of the whole conversation
    (null: none), from the parts' counts of markers, and whether the part before ends with a blank line."""
    kind = dict(parts.dtypes)["conv_id"]
    rows = _several(parts).select("conv_id", "part", "text")

    def marks(batch):
        out: dict[str, list] = {k: [] for k in ("names", "counts", "begun", "opening", "ends_blank")}
        for text in batch.column(2).to_pylist():
            lines = (text or "").split("\n")
            said = marked(lines)[1]
            counts = Counter(f"{x[0]}:{x[1]}" for x in said if x)
            begun, opening = opening_of(lines, said)
            for c, v in zip(out, (list(counts), list(counts.values()), begun, opening and f"{opening[0]}:{opening[1]}", not lines[-1].strip())):
                out[c].append(v)
        return {"conv_id": batch.column(0), "part": batch.column(1)} | out

    found = mapped(rows, marks, f"conv_id {kind}, part bigint, names array<string>, counts array<bigint>, begun boolean, opening string, ends_blank boolean")
    split = lambda x: (int(x.partition(":")[0]), x.partition(":")[2])

    def gather(held):
        conv, part, names, counts, begun, opening, ends = (held.column(c).to_pylist() for c in ("conv_id", "part", "names", "counts", "begun", "opening", "ends_blank"))
        out: dict[str, list] = {k: [] for k in ("conv_id", "part", "form", "family", "blank")}
        edges = [0, *[i for i in range(1, len(conv)) if conv[i] != conv[i - 1]], len(conv)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            total: Counter = Counter()
            for i in range(lo, hi):
                for name, n in zip(names[i], counts[i]):
                    total[split(name)] += n
            first = next((opening[i] for i in range(lo, hi) if begun[i]), None)
            style = style_of(total, first and split(first))
            for i in range(lo, hi):
                blank = 1 if i == lo else int(ends[i - 1])
                for c, v in zip(out, (conv[i], part[i], style and style[0], style and FAMILIES.index(style[1]), blank)):
                    out[c].append(v)
        return out

    return per_group(found, "conv_id", ["part"], gather, f"conv_id {kind}, part bigint, form int, family int, blank int")


def _style(form: int | None, family: int | None):
    return None if form is None else (form, FAMILIES[family])


def _ends(parts: DataFrame, styles: DataFrame, model: Model) -> DataFrame:
    """conv_id, part, entry, exit, goes_on for the parts of conversations of several parts."""
    shared = parts.sparkSession.sparkContext.broadcast(model)
    kind = dict(parts.dtypes)["conv_id"]
    rows = _several(parts).join(styles.hint("merge"), ["conv_id", "part"]).select("conv_id", "part", "opens", "text", "form", "family", "blank")

    def matrices(batch):
        best, starts = [], []
        for opens, text, form, family, blank in zip(*(batch.column(c).to_pylist() for c in range(2, 7))):
            observed = observe(text, _style(form, family), blank)
            runs = [shared.value.scores(observed, None if opens else a) for a in range(3)]
            best.append([x for score, _ in runs for x in score])
            starts.append([follow(back, r)[0][1] for _, back in runs for r in range(3)])
        return {"conv_id": batch.column(0), "part": batch.column(1), "best": best, "starts": starts}

    tables = mapped(rows, matrices, f"conv_id {kind}, part bigint, best array<double>, starts array<boolean>")

    def chain(held):
        conv, part, best, starts = (held.column(c).to_pylist() for c in ("conv_id", "part", "best", "starts"))
        out = {k: [] for k in ("conv_id", "part", "entry", "exit", "goes_on")}
        edges = [0, *[i for i in range(1, len(conv)) if conv[i] != conv[i - 1]], len(conv)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            score, came = best[lo][:3], []  # the first part has the same scores from any role
            for i in range(lo + 1, hi):
                step = [max(range(3), key=lambda a, r=r, i=i, s=score: s[a] + best[i][3 * a + r]) for r in range(3)]
                score = [score[step[r]] + best[i][3 * step[r] + r] for r in range(3)]
                came.append(step)
            role, on = max(range(3), key=lambda r: score[r]), False
            for i in range(hi - 1, lo - 1, -1):
                entry = came[i - lo - 1][role] if i > lo else None
                for c, v in zip(out, (conv[i], part[i], entry, role, on)):
                    out[c].append(v)
                if i > lo:
                    on, role = not starts[i][3 * entry + role], entry
        return out

    return per_group(tables, "conv_id", ["part"], chain, f"conv_id {kind}, part bigint, entry int, exit int, goes_on boolean")


def parse(parts: DataFrame, model: Model) -> DataFrame:
    """conv_id, part, turn, role, start, opens, rendered, n_chars of each turn of transcripts (conv_id, part, text).

    turn counts from 0 in each part and start is in its text; opens is false for the rest of a turn of the part before.
    """
    prepare(parts.sparkSession)
    shared = parts.sparkSession.sparkContext.broadcast(model)
    kind = dict(parts.dtypes)["conv_id"]
    parts = materialize(parts.select("conv_id", F.col("part").cast("long").alias("part"), "text"))
    styles = materialize(_styles(parts))
    ends = materialize(_ends(parts, styles, model).join(styles.hint("merge"), ["conv_id", "part"]))
    rows = parts.join(ends.hint("merge"), ["conv_id", "part"], "left").select("conv_id", "part", "text", "entry", "exit", F.coalesce("goes_on", F.lit(False)).alias("goes_on"), "form", "family", "blank")

    def run(batch):
        out: dict[str, list] = {k: [] for k in ("conv_id", "part", "turn", "role", "start", "opens", "rendered", "n_chars")}
        for conv, part, text, entry, exit_, goes_on, form, family, blank in zip(*(c.to_pylist() for c in batch.columns)):
            # a conversation of one part has its own text's style
            found = turns_of(text, shared.value, entry, exit_, *(() if blank is None else (_style(form, family), blank, goes_on)))
            for k, (role, start, opens, said) in enumerate(found):
                form = rendered(role, said, opens, not (goes_on and k + 1 == len(found)))
                for c, v in zip(out, (conv, part, k, ROLES[role], start, opens, form, len(form))):
                    out[c].append(v)
        return out

    return mapped(rows, run, f"conv_id {kind}, part bigint, turn bigint, role string, start bigint, opens boolean, rendered string, n_chars bigint")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's conversations as logs have them (one text each, a fifth of the markers missing), parsed into turns.

    A third of the conversations, by held_out() of their ids, is never learned from."""
    logs = written(table(spark, sf_dir, "conversations"))
    return parse(transcripts(logs), fit(logs.filter(~held_out(F.col("conv_id")))))
