"""Chat formatting by minimum-cost role repair.

Legal conversations are the words of an automaton: a system turn or none, then user and assistant turns that alternate.
Each turn is kept, joined to the turn before it, or given another role, and empty turns may be put in before it; dynamic
programming finds the choices of least total cost. What a turn can do is a 4 x 4 matrix of least costs from state to
state, and matrices of successive turns multiply in (min, +). So long conversations need not be one group: parts of at
most PART turn numbers give a product each, products are combined in groups of FAN, level by level, the states between
them are fixed from the top down, and each part then repairs and renders its own turns.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteward.functions.ranks import numbered
from siteward.llm.common import table
from siteward.session import materialize

ROLES = ["system", "user", "assistant"]
#: Which states may follow which; state 0 is the start, state k + 1 that the last turn has role k.
NEXT = {0: [1, 2], 1: [2], 2: [3], 3: [2]}
ENDS = [2, 3]
MERGE, RELABEL, RELABEL_UNKNOWN, INSERT = 1.0, 3.0, 1.0, 2.0
PART, FAN = 256, 256
FAR = float("inf")


def insertions() -> dict[tuple[int, int], list[int]]:
    """The shortest chain of states put in to get from one state to another; the states on the way and the last."""
    out = {(s, s): [] for s in NEXT}
    for _ in NEXT:
        for (a, b), way in list(out.items()):
            for c in NEXT[b]:
                if (a, c) not in out or len(way) + 1 < len(out[a, c]):
                    out[a, c] = [*way, c]
    return out


INSERTED = insertions()


def choices(role: str | None) -> dict[tuple[int, int], tuple[float, list[int], str]]:
    """{(state, state after the turn): (cost, states put in before it, action)} for a turn of this role."""
    own = ROLES.index(role) + 1 if role in ROLES else 0
    out: dict[tuple[int, int], tuple[float, list[int], str]] = {}
    for (a, b), way in INSERTED.items():
        for to in (1, 2, 3):
            change = 0.0 if to == own else RELABEL if own else RELABEL_UNKNOWN
            word = "keep" if to == own else "relabel"
            for ok, cost, action in ((to in NEXT[b], 0.0, word), (to == b, MERGE, "merge" if to == own else "relabel+merge")):
                new = (INSERT * len(way) + change + cost, way, action)
                if ok and new < out.get((a, to), (FAR,)):
                    out[a, to] = new
    return out


CHOICES = {r: choices(r) for r in [*ROLES, None]}
MATRIX = {r: np.array([[c.get((a, b), (FAR,))[0] for b in range(4)] for a in range(4)]) for r, c in CHOICES.items()}
#: Least cost from a state to a legal end, and the states put in for it.
ENDING = {s: min((INSERT * len(INSERTED[s, e]), INSERTED[s, e]) for e in ENDS if (s, e) in INSERTED) for s in NEXT}


def known(role: str | None) -> str | None:
    r = role.strip().lower() if isinstance(role, str) else None
    return r if r in ROLES else None


def product(matrices: list[np.ndarray]) -> np.ndarray:
    out = matrices[0]
    for m in matrices[1:]:
        out = (out[:, :, None] + m[None, :, :]).min(axis=1)
    return out


def states(matrices: list[np.ndarray], entry: int, leave: int | None) -> list[int]:
    """The states between matrices on a path of least cost from entry to leave, or to the cheapest end; entry first."""
    cost, back = [np.full(4, FAR)], []
    cost[0][entry] = 0
    for m in matrices:
        total = cost[-1][:, None] + m
        back.append(total.argmin(axis=0))
        cost.append(total.min(axis=0))
    at = leave if leave is not None else min(range(4), key=lambda s: cost[-1][s] + ENDING[s][0])
    out = [at]
    for b in reversed(back):
        at = int(b[at])
        out.append(at)
    return out[::-1]


def repaired(turns: list[tuple], entry: int, leave: int | None, first: bool, last: bool) -> list[dict]:
    """Pieces of a part: (turn, role, text) turns in order, between known states. Their `rendered` texts, one after the other,
    are the conversation."""
    path = states([MATRIX[known(t[1])] for t in turns], entry, leave)
    out: list[dict] = []

    def add(turn, role, state, action, cost, text) -> None:
        head = "" if "merge" in action else ("" if first and not out else "<|end|>\n") + f"<|{ROLES[state - 1]}|>\n"
        out.append({"turn": turn, "role": role, "new_role": ROLES[state - 1], "action": action, "cost": cost, "rendered": head + ("\n\n" if "merge" in action else "") + text})

    for (turn, role, text), a, b in zip(turns, path, path[1:]):
        cost, way, action = CHOICES[known(role)][a, b]
        for s in way:
            add(turn, None, s, "insert", INSERT, "")
        add(turn, role, b, action, cost - INSERT * len(way), text or "")
    if last:
        for s in ENDING[path[-1]][1]:
            add(None, None, s, "insert", INSERT, "")
        out[-1]["rendered"] += "<|end|>\n"
    return out


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of sorted batches by key; one group is held at a time."""
    rows = (r for b in batches for r in b.astype(object).where(b.notna(), None).to_dict("records"))
    for key, held in itertools.groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
        yield key, list(held)


def by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def between(units: DataFrame) -> DataFrame:
    """units (conv, part, m) with the states that each part is entered and left in: conv, part, entry, leave (-1: at the
    cheapest end), first, last. No group is over FAN rows."""
    schema = "conv string, part long, entry int, leave int, first boolean, last boolean"
    most = units.agg(F.max("part") - F.min("part")).first()[0] or 0
    # Matrices over a part number that is the same for all of a conversation's top group.
    top = most < FAN

    def matrix(r: dict) -> np.ndarray:
        return np.array(r["m"], float).reshape(4, 4)

    if top:

        def solve(batches):
            for (conv,), rows in groups(batches, ["conv"]):
                s = states([matrix(r) for r in rows], 0, None)
                n = len(rows) - 1
                yield pd.DataFrame([{"conv": conv, "part": r["part"], "entry": s[k], "leave": s[k + 1] if k < n else -1, "first": k == 0, "last": k == n} for k, r in enumerate(rows)])

        return by_key(units, ["conv"], ["part"]).mapInPandas(solve, schema)

    above = units.withColumn("up", F.floor(F.col("part") / FAN))

    def multiply(batches):
        for (conv, up), rows in groups(batches, ["conv", "up"]):
            yield pd.DataFrame([{"conv": conv, "part": up, "m": product([matrix(r) for r in rows]).ravel().tolist()}])

    upper = between(materialize(by_key(above, ["conv", "up"], ["part"]).mapInPandas(multiply, "conv string, part long, m array<double>"), "turns"))
    upper = upper.withColumnRenamed("part", "up")
    both = above.join(upper, (above.conv.eqNullSafe(upper.conv)) & (above.up == upper.up)).select(above.conv, above.up, "part", "m", "entry", "leave", "first", "last")

    def descend(batches):
        for (conv, _), rows in groups(batches, ["conv", "up"]):
            leave, n = rows[0]["leave"], len(rows) - 1
            s = states([matrix(r) for r in rows], rows[0]["entry"], None if leave < 0 else leave)
            yield pd.DataFrame(
                [{"conv": conv, "part": r["part"], "entry": s[k], "leave": leave if k == n else s[k + 1], "first": r["first"] and k == 0, "last": r["last"] and k == n} for k, r in enumerate(rows)]
            )

    return by_key(both, ["conv", "up"], ["part"]).mapInPandas(descend, schema)


def by_rank_where_crowded(turns: DataFrame, order: list[str]) -> DataFrame:
    """turns (conv, part and the columns of `order`) in which no part has more than twice PART turns: conversations with such a part
    are parted by the rank of their turns instead."""
    full = turns.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * PART)
    full = materialize(full.select(F.col("conv").alias("full")).distinct(), "crowded")
    if full.isEmpty():
        return turns
    same = F.col("conv").eqNullSafe(F.col("full"))
    rows = turns.join(full, same, "left_semi").withColumns({"_c": F.coalesce("conv", F.lit("\x00null")), "_u": F.monotonically_increasing_id()})
    ranked = numbered(materialize(rows, "crowded-turns"), ["_c"], [*order, "_u"], "_rank")
    ranked = ranked.withColumn("part", F.floor(F.col("_rank") / PART).cast("long")).select(*turns.columns)
    return turns.join(full, same, "left_anti").unionByName(ranked)


def repair_roles(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Pieces of the repaired conversations: conv_id, part, piece, turn, role (as it was; null for empty turns put in),
    new_role, action (keep, merge, relabel, relabel+merge, insert), cost, rendered. A conversation's rendered texts in the
    order of (part, piece) are its text: each turn is <|role|>, a line feed, the text and <|end|>; joined texts have an
    empty line between them. Roles are compared in lower case without white space around; other roles, and null, may become
    any. Turns go by number, then role and text; null numbers come last; equal rows stay, as turns of their own. A null
    conv_id is a conversation of its own; null texts are empty; an empty table gives an empty one. A part holds the turns of
    PART successive turn numbers, or PART turns in order in conversations where many share a number or have none."""
    t = turns.select(F.col(conv_col).cast("string").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    t = t.withColumn("part", F.when(F.col("turn").isNull(), F.lit(2**53)).otherwise(F.floor(F.col("turn") / PART)).cast("long"))
    t = t.withColumn("late", F.col("turn").isNull())
    order = ["late", "turn", "role", "text"]
    t = by_rank_where_crowded(t, order)

    def multiply(batches):
        for (conv, part), rows in groups(batches, ["conv", "part"]):
            yield pd.DataFrame([{"conv": conv, "part": part, "m": product([MATRIX[known(r["role"])] for r in rows]).ravel().tolist()}])

    several = t.groupBy("conv").agg(F.min("part").alias("p0"), F.max("part").alias("p1"))
    far = materialize(several.where("p0 < p1").select(F.col("conv").alias("far")), "far")
    split = t.join(far, F.col("conv").eqNullSafe(F.col("far")), "left_semi")
    ranked = far.limit(1).count()
    if ranked:
        units = materialize(by_key(split.drop("text").withColumn("text", F.lit("")), ["conv", "part"], order).mapInPandas(multiply, "conv string, part long, m array<double>"), "turns")
        at = materialize(between(units), "states").withColumnsRenamed({"conv": "c", "part": "p"})
        t = t.join(at, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left").drop("c", "p")
    else:
        t = t.withColumns({"entry": F.lit(None).cast("int"), "leave": F.lit(None).cast("int"), "first": F.lit(None).cast("boolean"), "last": F.lit(None).cast("boolean")})

    def render(batches):
        held = []
        for (conv, part), rows in groups(batches, ["conv", "part"]):
            r = rows[0]
            whole = r["entry"] is None
            leave = None if whole or r["leave"] < 0 else int(r["leave"])
            pieces = repaired([(None if x["turn"] is None else int(x["turn"]), x["role"], x["text"]) for x in rows], 0 if whole else int(r["entry"]), leave, whole or r["first"], whole or r["last"])
            held += [{"conv": conv, "part": part, "piece": k, **p} for k, p in enumerate(pieces)]
            if len(held) > 2000:
                yield pd.DataFrame(held)
                held = []
        if held:
            yield pd.DataFrame(held)

    schema = "conv string, part long, piece int, turn long, role string, new_role string, action string, cost double, rendered string"
    out = by_key(t, ["conv", "part"], order).mapInPandas(render, schema)
    return out.withColumn("conv", F.col("conv").cast(turns.schema[conv_col].dataType)).withColumnRenamed("conv", "conv_id")


def joined(pieces: DataFrame) -> DataFrame:
    """(conv_id, cost, text) of conversations that are short enough for one row each."""
    parts = F.array_sort(F.collect_list(F.struct("part", "piece", "rendered")))
    return pieces.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(parts, lambda p: p["rendered"]), "").alias("text"))


def op3_chat_formatting(spark, sf_dir: str) -> DataFrame:
    return repair_roles(table(spark, sf_dir, "conversations"))
