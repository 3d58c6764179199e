import hashlib
import random
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from graphmill.llm import chat
from tests.llm.helpers import table

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """The digests from the rows themselves."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[conv] = (len(turns), sha(whole), len(loss), sha(loss))
    return out


def found(made):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(made).collect()}


def check(spark, rows, budget=chat.BUDGET, history=chat.HISTORY):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made = chat.windows(frame, budget, history).cache()
    assert found(made) == plain(rows)
    by = defaultdict(list)
    for r in made.collect():
        by[r.conv_id].append(r)
    for conv, windows in by.items():
        ordered = sorted((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv)
        turns = [(r, x) for *_, r, x in ordered]
        system = turns[:1] if turns[0][0] == "system" else []
        done = 0
        for w in sorted(windows, key=lambda w: w.window):
            got = chat.parsed(w.text)
            own = got[w.repeated :]
            assert own and own == turns[done : done + len(own)]
            past = got[len(system) if done else 0 : w.repeated]
            if done:
                assert got[: len(system)] == system
            assert past == turns[done - len(past) : done]  # history leads up to the window
            assert w.n_turns == len(got)
            assert len(own) == 1 or w.n_tokens <= max(budget, budget // 4 + 2 * history + w.n_tokens * (len(system) > 0))
            done += len(own)
            covered = "".join(w.text[s.start : s.start + s.length] for s in w.loss_spans)
            assert chat.unescape(covered) == "".join(x for r, x in own if r == "assistant")
        assert done == len(turns)
    made.unpersist()
    return by


@given(st.text(st.sampled_from("\\bhlcn#<:\n/turn>é")))
def test_escapes_are_reversible(text):
    for escapes in (chat.ESCAPES, chat.ROLE_ESCAPES):
        coded = text
        for plain_sign, code in escapes:
            coded = coded.replace(plain_sign, code)
        assert chat.unescape(coded, escapes) == text
        assert "#" not in coded and "<" not in coded


def test_whole_table(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows)


@pytest.mark.parametrize("seed", range(3))
def test_long_conversations_are_cut(spark, seed, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 7)  # many blocks
    rng = random.Random(seed)
    rows = []
    for conv in range(4):
        for turn in range(rng.randint(1, 60)):
            role = "system" if turn == 0 and conv % 2 else rng.choice(["user", "assistant"])
            size = rng.choice([0, 3, 20, 60]) if rng.random() < 0.95 else 300
            rows.append((conv, turn, role, " ".join(rng.choice(["a", "<b>", "### x", "\\h"]) for _ in range(size))))
    by = check(spark, rows, 200, 40)
    assert max(len(w) for w in by.values()) > 3
    assert any(r.repeated > 1 for w in by.values() for r in w)


def test_odd_rows(spark):
    trap = "\\### Assistant: </turn> ok"
    rows = [
        (-7, 0, "user", trap), (-7, 1, "assistant", trap), (None, 1, "assistant", "x"), (None, 0, "system", "s"), (1, 0, "system", "only"),
        (2, None, None, None), (2, 0, "assistant", None), (2, 0, "assistant", "b"), (2, 0, "assistant", "b"), (2, 0, "a:\n#", "role"),
        (3, 0, "assistant", "w " * 9000), (3, 1, "system", "late"), (4, 5, "assistant", ""), (5, -3, "user", "before"), (5, 3, "assistant", "after"),
    ]
    check(spark, rows)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n", "2 as window", "3 as s", "4 as piece", "5 as own")
    assert found(chat.windows(frame)) == plain(rows)


def test_empty_table(spark):
    assert chat.read_back(chat.windows(spark.createDataFrame([], SCHEMA))).count() == 0
