from __future__ import annotations

import hashlib
import random

from findrift.llm import chat

ROLES = ["user", "assistant", "system", "to|ol<", None]
SCHEMA = "conv_id long, turn long, role string, text string, formatted string, window long"


def rows_of(rng: random.Random):
    bits = ["</s>[INST] ok [/INST]", "<|end|>", "<|assistant|>x<|end|>", "\\l", "\\\\<", "|>", "\n", "é\U0001f600", "plain words here", "", None]
    out = []
    for conv in [*range(25), None]:
        for turn in range(rng.randrange(1, 12)):
            body = "".join(rng.choice(bits) or "" for _ in range(rng.randrange(5))) if rng.random() < 0.9 else None
            role = "system" if turn == 0 and rng.random() < 0.5 else rng.choice(ROLES)
            out.append((conv, turn, role, body, "clash", 3))
    out += [(500, i, "user" if i % 2 == 0 else "assistant", "word " * 400, "clash", 3) for i in range(40)]  # longer than any window
    return out


def want(rows):
    convs: dict = {}
    for conv, turn, role, text, *_ in rows:
        convs.setdefault(conv, []).append((turn, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_read_back(spark):
    rows = rows_of(random.Random(2))
    df = spark.createDataFrame(rows, SCHEMA)
    for budget, history in ((1, 0), (20, 2), (100, 3), (10**6, 2)):
        got = {r["conv_id"]: r for r in chat.digest(chat.format_chat(df, budget, history)).collect()}
        assert {k: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for k, r in got.items()} == want(rows)


def test_windows_keep_budget_and_system(spark):
    rows = [(1, 0, "system", "be kind", "", 0)] + [(1, i, "user" if i % 2 else "assistant", f"turn number {i} " * 3, "", 0) for i in range(1, 20)]
    windows = chat.format_chat(spark.createDataFrame(rows, SCHEMA), budget=40, history=2).orderBy("window").collect()
    assert len(windows) > 3
    at = 0
    for w in windows:
        turns = chat.parse(w["formatted"])
        assert turns[0] == ("system", "be kind")
        assert w["n_tokens"] <= 40 and w["n_tokens"] == sum(chat.turn_tokens(r, t) for r, t in turns)
        assert w["first_turn"] == at
        at = w["last_turn"] + 1
        fresh = [turns[i] for i in w["fresh"]]
        assert [chat.unescape(w["formatted"][s["start"] : s["end"]]) for s in w["loss"]] == [t for r, t in fresh if r == "assistant"]
    assert at == 20
    # Turns have 12 tokens, the system turn 5: the first window takes it and two turns; each later one repeats
    # it, has room for one turn of history, and takes one turn more.
    assert [(w["first_turn"], w["last_turn"], len(chat.parse(w["formatted"]))) for w in windows] == [(0, 2, 3)] + [(i, i, 3) for i in range(3, 20)]


def greedy(turns, budget, history):
    """Windows as lists of (turn number, is new), by the rules alone."""
    cost = [chat.turn_tokens(r, t) for r, t in turns]
    system = 0 if turns[0][0] == "system" else None
    out, at = [], 0
    while at < len(turns):
        shown = []
        room = budget
        if out:
            past = []
            left = budget - cost[at] - (cost[0] if system == 0 else 0)
            for i in range(at - 1, -1, -1):
                if len(past) == history or i == system or cost[i] > left or i < min(k for k, _ in out[-1] if k != system or len(out) == 1):
                    break
                past.insert(0, i)
                left -= cost[i]
            shown = ([(0, False)] if system == 0 else []) + [(i, False) for i in past]
            room -= sum(cost[i] for i, _ in shown)
        new = []
        while at < len(turns) and (not new or room >= cost[at]):
            new.append((at, True))
            room -= cost[at]
            at += 1
        out.append(shown + new)
    return out


def test_windows_against_a_plain_greedy_choice(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for conv in range(40):
        turns = [("system" if i == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant"]), "w " * rng.choice([0, 1, 3, 8, 30])) for i in range(rng.randrange(1, 25))]
        rows += [(conv, i, r, t, "", 0) for i, (r, t) in enumerate(turns)]
        want[conv] = [[(*turns[i], new) for i, new in w] for w in greedy(turns, 25, 2)]
    got: dict = {}
    for w in chat.format_chat(spark.createDataFrame(rows, SCHEMA), budget=25, history=2).orderBy("conv_id", "window").collect():
        got.setdefault(w["conv_id"], []).append([(*t, i in w["fresh"]) for i, t in enumerate(chat.parse(w["formatted"]))])
    assert got == want


def test_empty_turns_close_windows_too(spark):
    rows = [(1, i, "user", None, "", 0) for i in range(3000)]
    windows = chat.format_chat(spark.createDataFrame(rows, SCHEMA), budget=30, history=0).collect()
    assert len(windows) == 300 and all(w["n_tokens"] == 30 for w in windows)


def test_ties_repeats_and_empty(spark):
    rows = [(1, 0, "user", "b", "", 0), (1, 0, "user", "a", "", 0), (1, 0, "user", "a", "", 0), (1, None, "assistant", None, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    w = chat.format_chat(df).collect()[0]
    assert chat.parse(w["formatted"]) == [("assistant", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert chat.digest(chat.format_chat(df.limit(0))).count() == 0


def test_escape_is_reversible():
    rng = random.Random(1)
    for _ in range(2000):
        s = "".join(rng.choice("\\l<>|p\né") for _ in range(rng.randrange(12)))
        assert chat.unescape(chat.escape(s)) == s and "<" not in chat.escape(s)
