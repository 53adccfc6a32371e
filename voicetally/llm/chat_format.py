"""Transcript parsing by a hidden Markov model, and canonical rendering of the turns it finds.

States are (role, first or later line of a turn); a line is seen as its speaker marker, whether the line before it is
blank, its length class and whether it asks. Transition and emission counts come from labelled transcripts (add-one) and all
their roles, Viterbi recovers the states of a whole transcript, and turns are rendered as `<|role|>`, the lines without
marker, `<|end|>`: one row per turn, uncut.

Lines of a transcript are streamed in order, and decoded BATCH lines at a time. A line is settled once the best paths to all
states agree on it, so the path is the best one of the whole transcript, and what is held is what is still open. Blank lines have no state: they belong to the turn they
stand in (before the first turn, to that one) and end no turn of themselves; but one blank line just before the first line
of a turn without marker parts the turns and belongs to neither. Null lines are empty lines, a null transcript id is an id
of its own, a transcript of blank lines only has no turns (one row with a null turn), equal positions are ordered by their
text; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import shuffle_parts

#: Words that mark a speaker, by class.
MARKERS = {"system": ("system", "sys", "context"), "user": ("user", "human", "customer", "question", "q"), "assistant": ("assistant", "ai", "bot", "answer", "a")}
_NAMES = "|".join(sorted((w for ws in MARKERS.values() for w in ws), key=lambda w: (-len(w), w)))
MARKER = rf"(?i)^\s*(?:#+\s*|\*\*|\[|<\|?)?({_NAMES})\s*(?:\*\*)?\s*(?::|\]|\|?>)(?:\*\*)?\s*"
BATCH = 1024
N_MARK, N_LEN = 4, 4
#: n_known counts lines whose role is given, n_unmarked those of them without a marker after a blank line; both with those right.
TURNS = "conv_id long, turn long, role string, rendered string, n_lines long, n_known long, n_right long, n_unmarked long, n_unmarked_right long"
RESULT = "conv_id long, n_lines long, n_turns long, roles string, rendered_sha256 string, n_known long, n_right long, n_unmarked long, n_unmarked_right long"


def observe(lines: DataFrame) -> DataFrame:
    """Adds to (conv_id, pos, line): mark (0 none, 1.. by MARKERS), len class, asks, blank, and body, the line without its marker."""
    line = F.coalesce("line", F.lit(""))
    name = F.lower(F.regexp_extract(line, MARKER, 1))
    mark: Column = F.lit(0)
    for i, words in enumerate(MARKERS.values(), 1):
        mark = F.when(name.isin(*words), i).otherwise(mark)
    n = F.length(line)
    return lines.withColumns({"mark": mark, "len": F.when(n == 0, 0).when(n < 40, 1).when(n < 200, 2).otherwise(3), "asks": F.when(line.rlike(r"\?\s*$"), 1).otherwise(0), "blank": F.when(line.rlike(r"^\s*$"), 1).otherwise(0), "body": F.regexp_replace(line, MARKER, "")})


class Model:
    """Log tables of the chain. State 2 * r is the first line of a turn of roles[r], 2 * r + 1 a later one."""

    def __init__(self, roles: list[str], start, step, mark, length, asks, blank):
        log = lambda counts: np.log((np.asarray(counts, float) + 1) / (np.asarray(counts, float) + 1).sum(axis=-1, keepdims=True))
        self.roles = roles
        self.start, self.step = log(start), log(step)
        self.mark, self.length, self.asks, self.blank = log(mark), log(length), log(asks), log(blank)
        never = -1e9
        self.start[1::2] = never
        of = np.arange(2 * len(roles)) // 2
        self.step[(of[:, None] != of) & (np.arange(len(of)) % 2 == 1)] = never

    def emit(self, mark, length, asks, blank) -> np.ndarray:
        return self.mark[:, mark] + self.length[:, length] + self.asks[:, asks] + self.blank[:, blank]

    def forward(self, emitted: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(state before each line on the best path to each state, best scores after the last line); before: such scores
        after the line before, if there is one."""
        back = np.zeros((emitted.shape[1], len(self.start)), np.int64)
        best = before
        for t in range(len(back)):
            if best is None:
                best = self.start + emitted[:, t]
                continue
            every = best[:, None] + self.step
            back[t] = every.argmax(axis=0)
            best = every.max(axis=0) + emitted[:, t]
        return back, best - best.max()

    @staticmethod
    def settled(back: np.ndarray, last: np.ndarray) -> tuple[int, int]:
        """(lines, state of the last of them) on which the best paths to all states of `last` agree; (0, 0) if on none."""
        now = last
        for t in range(len(back) - 1, -1, -1):
            if (now == now[0]).all():
                return t + 1, int(now[0])
            now = np.unique(back[t][now])
        return 0, 0

    @staticmethod
    def path(back: np.ndarray, state: int) -> np.ndarray:
        """The states that lead to `state` after the last line."""
        out = np.zeros(len(back), np.int64)
        for t in range(len(back) - 1, -1, -1):
            out[t] = state
            state = back[t][state]
        return out

    def decode(self, emitted: np.ndarray) -> np.ndarray:
        back, best = self.forward(emitted, None)
        return self.path(back, int(best.argmax()))


def train(turns: DataFrame, held_out: Column) -> Model:
    """Counts over all labelled lines (conv_id, turn, k, line, role; ordered by turn and k) that are not held out.

    A transcript's lines pass in order, without their text, so that blank lines before them are seen as parse() sees them.
    """

    def tally(batches):
        counts: Counter = Counter()
        now, turn, last, gap = object(), None, None, 0
        for b in batches:
            for conv, t, mark, length, asks, blank, role in zip(*[c.to_pylist() for c in b.columns]):
                if conv != now:
                    now, turn, last, gap = conv, None, "", 0
                if blank:
                    gap = 1
                    continue
                if role is None:
                    last = None
                else:
                    state = (role, int(t == turn))
                    if last == "":
                        counts["start", *state, "", 0] += 1
                    elif last is not None:
                        counts["step", *last, *state] += 1
                    for name, value in (("mark", mark), ("len", length), ("asks", asks), ("blank", gap)):
                        counts[name, *state, "", value] += 1
                    last = state
                turn, gap = t, 0
        rows = [(*k, n) for k, n in counts.items()]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["kind", "role", "later", "next", "value", "n"])

    rows = _in_order(turns.where(~held_out), ["conv_id", "turn", "mark", "len", "asks", "blank", "role"])
    counted = rows.mapInArrow(tally, "kind string, role string, later int, next string, value int, n long")
    found = counted.groupBy("kind", "role", "later", "next", "value").agg(F.sum("n").alias("n")).collect()
    roles = sorted({r["role"] for r in found}) or ["user"]
    at = {r: 2 * i for i, r in enumerate(roles)}
    size = 2 * len(roles)
    tables = {"start": np.zeros((size, 1)), "step": np.zeros((size, size)), "mark": np.zeros((size, N_MARK)), "len": np.zeros((size, N_LEN)), "asks": np.zeros((size, 2)), "blank": np.zeros((size, 2))}
    for r in found:
        column = at[r["next"]] + r["value"] if r["kind"] == "step" else r["value"]
        tables[r["kind"]][at[r["role"]] + r["later"], column] += r["n"]
    return Model(roles, tables["start"][:, 0], tables["step"], tables["mark"], tables["len"], tables["asks"], tables["blank"])


def _in_order(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Observed lines, whole transcripts in one task and in order."""
    spark = lines.sparkSession
    keys = ["conv_id", "turn", "k", "line"]
    return observe(lines).repartition(shuffle_parts(spark), "conv_id").sortWithinPartitions(*keys).select(*columns)


class _Transcript:
    """One transcript as it streams by: open lines, the open turn, and the turns that are done (rows of TURNS)."""

    def __init__(self, key, model: Model):
        self.key, self.model, self.best = key, model, None
        self.back = np.zeros((0, len(model.start)), np.int64)
        self.rows: list[tuple] = []
        self.blanks: list[tuple] = []
        self.turns: list[tuple] = []
        self.n_turns, self.role = 0, None
        self._open()

    def _open(self) -> None:
        self.text: list[str] = []
        self.n = [0, 0, 0, 0]

    def _take(self, body: str, truth, bare: bool = False) -> None:
        self.text.append(body)
        for i, is_so in enumerate((truth is not None, truth is not None and bare)):
            self.n[2 * i] += is_so
            self.n[2 * i + 1] += is_so and truth == self.role

    def _end(self) -> None:
        rendered = "".join([f"<|{self.role}|>\n", *[f"{t}\n" for t in self.text], "<|end|>\n"])
        self.turns.append((self.key, self.n_turns, self.role, rendered, len(self.text), *self.n))
        self.n_turns += 1
        self._open()

    def add(self, row: tuple) -> None:
        mark, length, asks, blank, body, truth = row
        if blank:
            self.blanks.append((body, truth))
            return
        self.rows.append((mark, length, asks, int(bool(self.blanks)), body, truth, self.blanks))
        self.blanks = []
        if len(self.rows) - len(self.back) >= BATCH:
            self._forward()
            n, state = self.model.settled(self.back, np.arange(len(self.model.start)))
            self._settle(self.model.path(self.back[:n], state))

    def _forward(self) -> None:
        new = self.rows[len(self.back) :]
        if new:
            obs = np.array([r[:4] for r in new], np.int64).T
            back, self.best = self.model.forward(self.model.emit(*obs), self.best)
            self.back = np.concatenate([self.back, back])

    def _settle(self, path: np.ndarray) -> None:
        for (mark, *_, gap, body, truth, blanks), state in zip(self.rows, path.tolist()):
            role = self.model.roles[state // 2]
            starts = state % 2 == 0 or role != self.role
            if starts and not mark:
                blanks = blanks[:-1]
            if starts and self.role is not None:
                for b in blanks:
                    self._take(*b)
                blanks = []
                self._end()
            self.role = role
            for b in blanks:
                self._take(*b)
            self._take(body, truth, bool(gap and not mark))
        self.rows, self.back = self.rows[len(path) :], self.back[len(path) :]

    def close(self) -> list[tuple]:
        self._forward()
        if self.rows:
            self._settle(self.model.path(self.back, int(self.best.argmax())))
        for b in self.blanks:
            self._take(*b)
        if self.role is not None:
            self._end()
        else:
            self.turns.append((self.key, None, None, None, len(self.text), *self.n))
        return self.turns


def _turns(batches, model: Model):
    """Lists of rows of TURNS from batches of lines in order."""
    now = None
    for b in batches:
        done = []
        for key, *row in zip(*[c.to_pylist() for c in b.columns]):
            if now is None or key != now.key:
                if now is not None:
                    done += now.close()
                now = _Transcript(key, model)
            now.add(tuple(row))
        if now is not None:
            done, now.turns = done + now.turns, []
        yield done
    if now is not None:
        yield now.close()


_LINE = ["conv_id", "mark", "len", "asks", "blank", "body", "role"]


def parse(lines: DataFrame, model: Model) -> DataFrame:
    """The turns of (conv_id, turn, k, line, role) as the chain recovers them, each with its whole rendering, its lines,
    those whose role is given and those of them that are right. role may be null; it is only compared."""
    known = lines.sparkSession.sparkContext.broadcast(model)

    def walk(batches):
        for done in _turns(batches, known.value):
            yield _rows(done, TURNS)

    return _in_order(lines, _LINE).mapInArrow(walk, TURNS)


def summary(lines: DataFrame, model: Model) -> DataFrame:
    """Per transcript what parse() recovers: all turns' roles, and the digest of all renderings. Both come
    from the turns in the pass that makes them."""
    known = lines.sparkSession.sparkContext.broadcast(model)

    def fold(batches):
        now, sha, sums, roles = None, None, None, []

        def row():
            return (now[0], sums[0], len(roles), ",".join(roles), sha.hexdigest(), *sums[1:])

        for done in _turns(batches, known.value):
            out = []
            for key, turn, role, rendered, *n in done:
                if now is None or now[0] != key:
                    if now is not None:
                        out.append(row())
                    now, sha, sums, roles = (key,), hashlib.sha256(), [0] * 5, []
                if turn is not None:
                    roles.append(role)
                    sha.update(rendered.encode())
                sums = [a + b for a, b in zip(sums, n)]
            yield _rows(out, RESULT)
        if now is not None:
            yield _rows([row()], RESULT)

    return _in_order(lines, _LINE).mapInArrow(fold, RESULT)


def _rows(done: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], {"long": pa.int64(), "string": pa.string()}[t]) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])


#: Marker styles in which transcripts are written, by role.
STYLES = [{"system": "System: ", "user": "User: ", "assistant": "Assistant: "}, {"system": "### Context: ", "user": "### Human: ", "assistant": "### Assistant: "}, {"system": "[sys] ", "user": "Q: ", "assistant": "A: "}, {"system": "<|system|> ", "user": "<|user|> ", "assistant": "<|bot|> "}]


def transcripts(conversations: DataFrame, plain: bool = False) -> DataFrame:
    """Raw transcript lines of a table of turns: a marker in the conversation's style, or, for a tenth of the turns (by a
    hash), none. Half of those without a marker have a blank line before them, the others follow the line before at once. A
    fifth of the turns hold a blank line of their own after their first line, if they have several, so a blank line does not
    tell where a turn starts. Lines keep their turn's role for training and comparison; a blank line between turns has none.
    `kind` tells the lines apart that are of interest: hidden (first of a turn without a marker, after a blank line), silent
    (without one), inner (after a blank line of the turn itself), other. plain: markers at all turns, and texts as they are."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    mark = F.lit("")
    for i, s in enumerate(STYLES):
        for role, text in s.items():
            mark = F.when((style == i) & (F.col("role") == role), text).otherwise(mark)
    h = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(20))
    text = F.coalesce("text", F.lit(""))
    inner = h.between(2, 5) & text.contains("\n") & F.lit(not plain)
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", text.alias("text"), mark.alias("mark"), ((h == 0) & F.lit(not plain)).alias("hidden"), ((h == 1) & F.lit(not plain)).alias("silent"), inner.alias("inner"))
    own = F.when(F.col("inner"), F.regexp_replace("text", r"^([^\n]*)\n", "$1\n\n")).otherwise(F.col("text"))
    c = c.withColumn("t", F.concat(F.when(F.col("hidden"), "\n").when(F.col("silent"), "").otherwise(F.col("mark")), own))
    each = c.select("conv_id", "turn", "role", "hidden", "silent", "inner", F.posexplode(F.split("t", "\n")).alias("k", "line"))
    k = F.col("k") - F.col("hidden").cast("int")
    kind = F.when(F.col("hidden") & (k == 0), "hidden").when(F.col("silent") & (k == 0), "silent").when(F.col("inner") & (k == 2), "inner").otherwise("other")
    return each.select("conv_id", "turn", k.alias("k"), "line", F.when(k >= 0, F.col("role")).alias("role"), kind.alias("kind"))


def recover(spark: SparkSession, conversations: DataFrame, held_out: Column) -> DataFrame:
    lines = transcripts(conversations)
    return summary(lines, train(lines, held_out))
