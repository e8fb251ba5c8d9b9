import itertools
import random

import pytest

from siteward.llm import chat_formatting as cf

LEGAL = {0: {1, 2}, 1: {2}, 2: {3}, 3: {2}}


def cheapest(roles):
    """Least cost by trying all numbers of empty turns, roles and joins (Dijkstra over turn and state)."""
    best = {0: 0.0}
    for role in [*roles, "END"]:
        grown = dict(best)
        for _ in range(4):
            for s, c in list(grown.items()):
                for n in LEGAL[s]:
                    grown[n] = min(grown.get(n, 1e9), c + cf.INSERT)
        if role == "END":
            return min(c for s, c in grown.items() if s in (2, 3))
        after = {}
        for s, c in grown.items():
            for to in (1, 2, 3):
                own = cf.ROLES.index(role) + 1 if role in cf.ROLES else 0
                change = 0 if to == own else cf.RELABEL if own else cf.RELABEL_UNKNOWN
                if to in LEGAL[s]:
                    after[to] = min(after.get(to, 1e9), c + change)
                if to == s:
                    after[to] = min(after.get(to, 1e9), c + change + cf.MERGE)
        best = after
    raise AssertionError


def legal(pieces):
    s = 0
    for p in pieces:
        to = cf.ROLES.index(p["new_role"]) + 1
        if "merge" in p["action"]:
            assert to == s
        else:
            assert to in LEGAL[s]
        s = to
    assert s in (2, 3)


@pytest.mark.parametrize("n", range(1, 6))
def test_least_cost_and_legal(n):
    for roles in itertools.product([*cf.ROLES, "tool"], repeat=n):
        pieces = cf.repaired([(k, r, f"t{k}") for k, r in enumerate(roles)], 0, None, True, True)
        legal(pieces)
        assert sum(p["cost"] for p in pieces) == cheapest(roles)


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")


def test_long_conversation_in_parts_equals_whole(spark, monkeypatch):
    monkeypatch.setattr(cf, "PART", 4)
    monkeypatch.setattr(cf, "FAN", 3)
    r = random.Random(5)
    rows = [(c, k, r.choice([*cf.ROLES, "bot", None]), f"c{c}t{k}", "x") for c in range(4) for k in range(r.choice([1, 3, 90, 200]))]
    got = {x.conv_id: x for x in cf.joined(cf.repair_roles(frame(spark, rows))).collect()}
    for c in {x[0] for x in rows}:
        own = [x[1:4] for x in rows if x[0] == c]
        assert got[c].cost == cheapest([cf.known(x[1]) for x in own])
        text = got[c].text
        assert all(x[2] in text for x in own)
        assert text.startswith("<|") and text.endswith("<|end|>\n") and text.count("<|end|>") == text.count("<|user|>") + text.count("<|assistant|>") + text.count("<|system|>")


def test_turns_that_share_a_number_are_dealt_out_by_rank(spark, monkeypatch):
    monkeypatch.setattr(cf, "PART", 4)
    monkeypatch.setattr(cf, "FAN", 3)
    r = random.Random(6)
    rows = [(c, t, r.choice([*cf.ROLES, "bot", None]), f"c{c}n{t}t{k:03}", "x") for c in (1, 2, None) for t in (0, None) for k in range(60)]
    rows += [(5, 0, "user", "same", "x")] * 30 + [(6, k, "user", "six", "x") for k in range(3)]
    pieces = cf.repair_roles(frame(spark, rows))
    sizes = pieces.where("action != 'insert'").groupBy("conv_id", "part").count().collect()
    assert max(x["count"] for x in sizes) <= 8 and sum(x["count"] for x in sizes) == len(rows)
    got = {x.conv_id: x for x in cf.joined(pieces).collect()}
    for c in (1, 2, None, 5, 6):
        own = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is None, x[1] or 0, x[2] is not None, x[2] or "", x[3]))
        assert got[c].cost == cheapest([cf.known(x[2]) for x in own])
        at = [got[c].text.index(x[3]) for x in own]
        assert at == sorted(at) and all(got[c].text.count(x[3]) == sum(y[3] == x[3] for y in own) for x in own)


def test_nulls_repeats_and_order(spark):
    rows = [(1, None, "assistant", "z", "p"), (1, 0, " USER ", "a", "p"), (None, 0, None, None, "p"), (2, 0, "user", "same", "p"), (2, 0, "user", "same", "p"), (3, 0, "system", "only", "p")]
    got = {x.conv_id: (x.cost, x.text) for x in cf.joined(cf.repair_roles(frame(spark, rows))).collect()}
    assert got[1] == (0.0, "<|user|>\na<|end|>\n<|assistant|>\nz<|end|>\n")
    assert got[None] == (1.0, "<|user|>\n<|end|>\n")
    assert got[2] == (1.0, "<|user|>\nsame\n\nsame<|end|>\n")
    assert got[3] == (2.0, "<|system|>\nonly<|end|>\n<|user|>\n<|end|>\n")


def test_empty(spark):
    assert cf.repair_roles(frame(spark, [])).count() == 0


def test_whole_query(spark):
    sf = "/root/testdata/sf0.001"
    turns = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    by = {}
    for t in sorted(turns, key=lambda t: (t.conv_id, t.turn)):
        by.setdefault(t.conv_id, []).append(t)
    got = {x.conv_id: x for x in cf.joined(cf.op3_chat_formatting(spark, sf)).collect()}
    assert set(got) == set(by)
    for c, own in by.items():
        assert got[c].cost == cheapest([cf.known(t.role) for t in own])
