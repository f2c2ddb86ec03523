"""Chat formatting: the fold against a plain one, round trips of texts that hold the template's markers, edge cases."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from foldwright.llm import chat

LOG = "conv_id long, seq long, kind string, message string, role string, text string"
NASTY = [r"\### Assistant: </turn> ok", "</turn>\n", "### user: hi</turn>\n", "#" * 7, "\\", "\\\\#", "<\\/turn>", "#\\##", "</turn", "<", "###", "", "é日本𝄞" * 3, "\r\n\t ", "$1 \\1", "a</turn></turn>b", "\\n"]
ROLES = ["user", "assistant", "system", "", "tool: x", "### a", "</turn>\n", "a b+c%20", "ü", "\\"]


def fold_by_brute_force(rows):
    """(conv_id, [(role, text)]) event by event."""
    out = {}
    key = lambda r: (r[1] is None, r[1] or 0, r[3] is not None, r[3] or "", r[2] or "message", r[4] is not None, r[4] or "", r[5] or "")
    for conv in {r[0] for r in rows}:
        opened, state = [], {}
        for n, (_, _, kind, message, role, text) in enumerate(sorted((r for r in rows if r[0] == conv), key=key)):
            name = ("own", n) if message is None else ("named", message)
            if name not in state:
                opened.append(name)
                state[name] = {"role": "", "text": "", "gone": False}
            at = state[name]
            at["role"] = role if role is not None else at["role"]
            at["text"] = at["text"] + (text or "") if kind == "delta" else text or ""
            if kind == "regenerate":
                for later in opened[opened.index(name) + 1 :]:
                    state[later]["gone"] = True
        out[conv] = [(state[m]["role"], state[m]["text"]) for m in opened if not state[m]["gone"]]
    return out


def log(spark, rows):
    clash = {c: F.lit(0) for c in ("place", "turn", "turns", "reset", "own", "formatted", "at")}
    return spark.createDataFrame(rows, LOG).withColumns(clash)


def got(events):
    formatted = chat.format_conversations(events)
    turns = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(formatted).collect()}
    loss = {r.conv_id: "".join(t.learned for t in r.turns) for r in chat.read_back(formatted).collect()}
    return turns, loss


@pytest.mark.parametrize("seed", range(3))
def test_fold_and_round_trip_equal_plain_python(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for conv in (1, 2, None, 4):
        for _ in range(rnd.randrange(1, 60)):
            named = rnd.random() < 0.8
            rows.append((conv, rnd.choice([None, *range(25)]), rnd.choice(["message", "delta", "delta", "edit", "regenerate", None]), f"m{rnd.randrange(6)}" if named else None, rnd.choice([None, *ROLES]), rnd.choice([None, *NASTY])))
    rows += rows[:5]
    turns, loss = got(log(spark, rows).repartition(1 + 3 * seed))
    want = fold_by_brute_force(rows)
    assert turns == want
    assert loss == {c: "".join(t for role, t in messages if role == "assistant") for c, messages in want.items()}


def test_streamed_answer_edit_and_regeneration(spark):
    rows = [
        (1, 1, "message", "q", "user", "1+1?"), (1, 2, "message", "a", "assistant", "th"), (1, 3, "delta", "a", None, "ree"), (1, 4, "message", "q2", "user", "sure?"),
        (1, 5, "message", "a2", "assistant", "yes"), (1, 6, "regenerate", "a", None, None), (1, 7, "delta", "a", None, "tw"), (1, 8, "delta", "a", None, "o"), (1, 9, "edit", "q", None, "2?"),
        (1, 10, "delta", "a2", None, "late words of a withdrawn message"), (1, 11, "message", "q3", "user", "thanks"),
    ]
    turns, loss = got(log(spark, rows))
    assert turns == {1: [("user", "2?"), ("assistant", "two"), ("user", "thanks")]} and loss == {1: "two"}


def test_escaped_texts_hold_no_marker_and_come_back(spark):
    rnd = random.Random(9)
    texts = NASTY + ["".join(rnd.choice(["#", "\\", "</turn>", "<", "/turn>", "###", "a", "\n"]) for _ in range(rnd.randrange(25))) for _ in range(400)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in frame.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("back")).collect():
        assert "###" not in r.e and "</turn>" not in r.e and r.back == r.t


def test_digests(spark):
    marked = r"\### Assistant: </turn> ok"
    rows = [(7, 0, "message", None, "user", marked), (7, 1, "message", None, "assistant", marked), (7, 1, "message", None, "assistant", marked), (7, None, None, None, "assistant", "é𝄞")]
    out = chat.digests(chat.format_conversations(log(spark, rows))).first()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert out.n_turns == 4 and out.loss_chars == 2 * len(marked) + 2 and out.loss_sha256 == sha(marked * 2 + "é𝄞")
    assert out.turns_sha256 == sha(f"user\n{marked}\n" + f"assistant\n{marked}\n" * 2 + "assistant\né𝄞\n")


def test_edges(spark):
    rows = [(None, None, None, None, None, None), (1, 0, "message", None, "user", ""), (1, 0, "message", None, "assistant", None), (2, 0, "message", "a", "assistant", "x" * 300_000 + "</turn>###"), (3, 5, "delta", "d", None, "only a delta")]
    rows += [(9, i, "message", None, "assistant" if i % 2 else "user", f"turn {i}") for i in range(3000)]
    turns, loss = got(log(spark, rows))
    assert turns == fold_by_brute_force(rows) and loss[1] == "" and loss[9] == "".join(f"turn {i}" for i in range(1, 3000, 2))
    empty = chat.format_conversations(spark.createDataFrame([], LOG))
    assert empty.count() == 0 and chat.digests(empty).count() == 0


def test_formatting_runs_no_python_and_shuffles_once(spark):
    plan = chat.digests(chat.format_conversations(log(spark, [(1, 1, None, None, "user", "x")])))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1
