"""Repairs against all sequences of actions, whole and in stretches."""
import itertools
import random

import pytest

from eventscope.llm import chat_repair
from eventscope.llm.chat_repair import CLOSE, INSERT, MERGE_OTHER, MERGE_SAME, RELABEL, ROLES, kind_of, repair

LEGAL_NEXT = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


def legal(roles):
    before = None
    for r in roles:
        if r not in LEGAL_NEXT[before]:
            return False
        before = r
    return not roles or before == "assistant"


def cheapest(roles):
    """Least cost over all action and insertion choices, by plain search."""
    best = {(): 0}            # repaired role sequences' last role -> cost
    states = {None: 0}
    for role in roles:
        own = (role or "").strip().lower()
        nxt = {}

        def offer(state, cost):
            if state not in nxt or cost < nxt[state]:
                nxt[state] = cost

        for state, cost in states.items():
            if state is not None:
                offer(state, cost + (MERGE_SAME if state == own else MERGE_OTHER))
            for n in range(4):
                for empty in itertools.product(ROLES, repeat=n):
                    path, ok = state, True
                    for e in empty:
                        ok &= e in LEGAL_NEXT[path]
                        path = e
                    if ok:
                        for new in LEGAL_NEXT[path]:
                            offer(new, cost + n * INSERT + (0 if new == own else RELABEL))
        states = nxt
    ends = []
    for state, cost in states.items():
        for n in range(4):
            for empty in itertools.product(ROLES, repeat=n):
                path, ok = state, True
                for e in empty:
                    ok &= e in LEGAL_NEXT[path]
                    path = e
                if ok and path == "assistant":
                    ends.append(cost + n * INSERT)
    return min(ends)


def parse(text):
    turns = []
    for part in text.split("<|end|>\n"):
        if part:
            head, body = part.split("|>\n", 1)
            turns.append((head[2:], body[:-1]))
    return turns


def check(spark, rows, parts=3):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, action string").repartition(parts)
    convs = {}
    for r in repair(frame).collect():
        convs.setdefault(r["conv_id"], []).append(r)
    want = {}
    for c, t, role, text, _ in rows:
        want.setdefault(c, []).append((t is not None, t or 0, role is not None, role or "", text, role))
    assert set(convs) == set(want)
    for c, got in convs.items():
        turns = sorted(want[c], key=lambda x: x[:4])
        got.sort(key=lambda r: (r["turn"] is not None, r["turn"] or 0))
        if len({x[1] for x in turns}) == len(turns):
            rendered = parse("".join(r["rendered"] for r in got))
            assert legal([r for r, _ in rendered]), rendered
            assert "".join(b.replace("\n", "") for _, b in rendered) == "".join((x[4] or "") for x in turns)
            cost = 0
            for x, r in zip(turns, got):
                own = (x[5] or "").strip().lower()
                cost += INSERT * r["inserted"]
                cost += {"keep": 0, "relabel": RELABEL, "merge": MERGE_SAME if r["role"] == own else MERGE_OTHER}[r["action"]]
            assert cost == got[0]["conversation_cost"]
        assert {r["conversation_cost"] for r in got} == {cheapest([x[5] for x in turns])}


def corpus():
    rng = random.Random(12)
    roles = ["user", "assistant", "system", "User ", "tool", None, "user", "assistant"]
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(roles), rng.choice(["hi", "", None, "é"]), "x"))
    rows += [(None, t, "user", f"n{t}", "x") for t in range(4)]
    rows += [(500, None, "user", "a", "x"), (500, 1, "assistant", "b", "x")]
    rows += [(501, 1, "user", "same", "x")] * 3
    rows += [(502, t, "assistant" if t % 3 else "user", f"m{t}", "x") for t in range(300)]
    return rows


def test_against_search(spark):
    check(spark, corpus())


def test_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(chat_repair, "STRETCH", 3)
    check(spark, corpus(), 6)


def test_clean_conversations_stay(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a")]
    out = repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("turn").collect()
    assert [r["action"] for r in out] == ["keep"] * 3 and out[0]["conversation_cost"] == 0
    assert "".join(r["rendered"] for r in out) == "<|system|>\ns" + CLOSE + "<|user|>\nu" + CLOSE + "<|assistant|>\na" + CLOSE


def test_empty(spark):
    assert repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("role,kind", [(None, 0), ("", 0), (" SYSTEM\n", 1), ("user", 2), ("Assistant", 3), ("bot", 0)])
def test_kinds(role, kind):
    assert kind_of(role) == kind
