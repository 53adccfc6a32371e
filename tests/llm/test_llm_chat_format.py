"""The whole query of chat transcripts against a plain version: observations, counts, Viterbi, turns and their digests."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voicetally.llm import chat_format as C

ROLES = ["system", "user", "assistant"]


def conversations(seed=5, n=60):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 9)):
            role = "system" if t == 0 and c % 4 == 0 else ROLES[1 + t % 2]
            text = "\n".join(" ".join(rng.choice(["so", "what", "is", "a", "long", "answer", "bot", "Q:"]) for _ in range(rng.randint(1, 60 if role == "assistant" else 12))) + ("?" if role == "user" and rng.random() < 0.7 else ".") for _ in range(rng.randint(1, 4)))
            rows.append((c, t, role, text, "clash"))
    return [*rows, (900, 0, "user", None, ""), (901, 0, None, "no role\n\n\nhere", ""), (902, 0, "assistant", "\n\n", ""), (None, 0, "user", "User: nobody's", ""), (None, 1, "assistant", "x", ""), (3, 0, "user", "a repeated place", "")]


def observed(line):
    m = re.match(C.MARKER, line)
    mark = next((i for i, w in enumerate(C.MARKERS.values(), 1) if m and m[1].lower() in w), 0)
    n = len(line)
    return mark, 0 if n == 0 else 1 if n < 40 else 2 if n < 200 else 3, int(re.search(r"\?\s*$", line) is not None), re.sub(C.MARKER, "", line)


def plain(lines, held_out):
    """Rows of RESULT from (conv_id, turn, k, line, role), in order."""
    chats = defaultdict(list)
    for conv, turn, k, line, role in sorted(lines, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2], r[3])):
        chats[conv].append((turn, line, role, *observed(line)))
    counts = Counter()
    for conv, rows in chats.items():
        if held_out(conv):
            continue
        turn, last, gap = None, "", 0
        for t, line, role, mark, length, asks, _ in rows:
            if not line.strip():
                gap = 1
                continue
            state = None if role is None else (role, int(t == turn))
            if state:
                if last == "":
                    counts["start", state] += 1
                elif last:
                    counts["step", last, state] += 1
                counts.update([("mark", state, mark), ("len", state, length), ("asks", state, asks), ("blank", state, gap)])
            last, turn, gap = state, t, 0
    roles = sorted({k[1][0] for k in counts}) or ["user"]
    states = [(r, later) for r in roles for later in (0, 1)]
    table = lambda kind, values: [[counts[kind, s, v] for v in values] for s in states]
    model = C.Model(roles, [counts["start", s] for s in states], [[counts["step", a, b] for b in states] for a in states], table("mark", range(C.N_MARK)), table("len", range(C.N_LEN)), table("asks", range(2)), table("blank", range(2)))
    out = []
    for conv, rows in chats.items():
        seen, gap = [], 0
        for i, (_, line, _, mark, length, asks, _) in enumerate(rows):
            if line.strip():
                seen.append((i, mark, length, asks, gap))
            gap = int(not line.strip())
        best, back = None, []
        for _, *o in seen:
            emitted = [model.mark[s, o[0]] + model.length[s, o[1]] + model.asks[s, o[2]] + model.blank[s, o[3]] for s in range(len(states))]
            if best is None:
                best = [model.start[s] + emitted[s] for s in range(len(states))]
                back.append([0] * len(states))
            else:
                back.append([int(np.argmax([best[a] + model.step[a, s] for a in range(len(states))])) for s in range(len(states))])
                best = [best[back[-1][s]] + model.step[back[-1][s], s] + emitted[s] for s in range(len(states))]
                top = max(best)
                best = [b - top for b in best]
        path, state = {}, int(np.argmax(best)) if best else 0
        for (i, *_), b in zip(reversed(seen), reversed(back)):
            path[i] = state
            state = b[state]
        turns, blanks, role = [], [], None
        known = right = bare = bare_right = 0
        for i, (_, line, truth, mark, _, _, body) in enumerate(rows):
            if i not in path:
                blanks.append((body, truth))
                continue
            now, starts = roles[path[i] // 2], path[i] % 2 == 0 or roles[path[i] // 2] != role
            had = bool(blanks)
            if starts and not mark:
                blanks = blanks[:-1]
            if starts and turns:
                turns[-1][1].extend(blanks)
                blanks = []
            if starts:
                turns.append((now, []))
            role = now
            turns[-1][1].extend(blanks)
            blanks = []
            turns[-1][1].append((body, truth))
            if truth is not None and had and not mark:
                bare, bare_right = bare + 1, bare_right + (truth == now)
        loose = [] if turns else blanks
        if turns:
            turns[-1][1].extend(blanks)
        for now, body in turns:
            known += sum(t is not None for _, t in body)
            right += sum(t is not None and t == now for _, t in body)
        known += sum(t is not None for _, t in loose)
        text = "".join(f"<|{r}|>\n" + "".join(f"{x}\n" for x, _ in body) + "<|end|>\n" for r, body in turns)
        out.append((conv, sum(len(b) for _, b in turns) + len(loose), len(turns), ",".join(r for r, _ in turns), hashlib.sha256(text.encode()).hexdigest(), known, right, bare, bare_right))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts,batch", [(1, 1024), (7, 3)])
def test_query_against_a_plain_version(spark, monkeypatch, parts, batch):
    monkeypatch.setattr(C, "BATCH", batch)
    conv = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string, line string").repartition(parts)
    held = F.coalesce(F.col("conv_id") % 4 == 1, F.lit(False))
    lines = [tuple(r)[:5] for r in C.transcripts(conv).collect()]
    got = sorted(map(tuple, C.recover(spark, conv, held).collect()), key=repr)
    assert got == plain(lines, lambda c: c is not None and c % 4 == 1)


def test_blank_lines_do_not_tell_turns(spark):
    """Of each kind there are lines: hidden turns with and without a blank line, and blank lines inside turns."""
    conv = spark.createDataFrame(conversations(n=300), "conv_id long, turn long, role string, text string, line string")
    lines = C.transcripts(conv)
    n = {r["kind"]: r["count"] for r in lines.groupBy("kind").count().collect()}
    assert min(n["hidden"], n["silent"]) > 20 and n["inner"] > n["hidden"]
    model = C.train(lines, F.lit(False))
    right = {}
    for kind in ("hidden", "silent", "inner", "other"):
        r = C.summary(lines.withColumn("role", F.when(F.col("kind") == kind, F.col("role"))), model).agg(F.sum("n_right") / F.sum("n_known")).first()[0]
        right[kind] = r
    assert right["inner"] > 0.8 and right["other"] > 0.9 and right["hidden"] > 0.4
