"""The threshold algorithm against scores of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteward.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, id int, x string"


def brute(rows, every, k=5):
    """rows: {id: (label, whole vector)}"""
    out, ids = [], sorted(rows)
    dot = lambda a, b: sum(x * y for x, y in zip(rows[a][1], rows[b][1]))
    for a in ids:
        if a % every:
            continue
        by = sorted((-dot(a, i), i) for i in ids)
        same = [(-s, i) for s, i in by if rows[i][0] == rows[a][0] and i != a][:k]
        for p, i in same:
            window = [(-s, j) for s, j in by if rows[j][0] != rows[a][0] and 80 * p <= -100 * s <= 100 * p][:k]
            out += [(a, i, r, j, p, s) for r, (s, j) in enumerate(window, 1)]
    return sorted(out)


def found(spark, rows, every, label=None):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)
    from siteward.session import materialize

    whole = materialize(hn.prepared(df, "vec_id", "embedding", F.col("label") if label is None else label), "vectors")
    return sorted(tuple(r) for r in hn.hard_negatives(whole, whole.where(f"id % {every} = 0")).collect())


def whole(v):
    return [int(np.floor(256 * float(np.float32(c)))) for c in v]


@pytest.mark.parametrize("seed", range(3))
def test_all_windows_in_many_blocks(spark, monkeypatch, seed):
    monkeypatch.setattr(hn, "CANDIDATES", 40)
    monkeypatch.setattr(hn, "ANCHORS", 4)
    monkeypatch.setattr(hn, "DEPTH", 2)
    r = random.Random(seed)
    # Few different values, so that scores tie, and a third of all rows alike.
    rows = [(k, [0.5, 0.25, 0.5, 0.0] if r.random() < 0.33 else [r.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(4)], r.randrange(3)) for k in range(150)]
    assert found(spark, rows, 10) == brute({k: (c, whole(v)) for k, v, c in rows}, 10)


def test_rows_that_take_no_part(spark):
    good = [(k, [1.0, 0.1 * k, -0.3], k % 2) for k in range(12)]
    bad = [(None, [1.0, 1.0, 1.0], 0), (20, None, 0), (30, [1.0, None, 1.0], 1), (40, [float("nan"), 1.0, 1.0], 1), (50, [float("inf"), 1.0, 1.0], 0), (60, [1.0, 1.0, 1.0], None)]
    want = brute({k: (c, whole(v)) for k, v, c in good}, 10)
    assert want and found(spark, good + bad, 10) == want
    assert found(spark, good + good[3:6], 10) == want  # repeated rows count once
    assert found(spark, [], 10) == [] and found(spark, bad, 10) == []


def test_short_vectors_end_in_zeros_and_large_ones_are_exact(spark):
    rows = [(0, [2.0**22, 2.0**21 + 1], 0), (1, [2.0**22], 0), (2, [2.0**22, 1.0, 3.0], 1), (3, [2.0**22, 1.0], 1), (4, [], 1), (5, [2.0**22, 2.0**21], 1)]
    assert found(spark, rows, 5) == brute({k: (c, whole(v) + [0] * (3 - len(v))) for k, v, c in rows}, 5)


def test_reading_stops_early():
    """One row far above the others in all dimensions is proven the best after the first reading."""
    rng = np.random.default_rng(0)
    x = rng.integers(-5, 6, (5000, 8)).astype(float)
    x[77] = 1000
    lists = hn.Lists(x, np.arange(5000))
    got = lists.best(np.ones(8), 1, [(-np.inf, np.inf)])
    assert got.row[got.score.argmax()] == 77 and got.read < 1000
    # Nothing reaches the window: reading stops when the threshold is below it.
    assert lists.best(np.ones(8), 1, [(9000, np.inf)]).read < 1000


def test_the_query_on_a_table(spark):
    from siteward.llm.registry import QUERIES

    t = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    rows = {r.vec_id: ((r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, whole(r.embedding)) for r in t}
    df = QUERIES["op12_hard_negatives"](spark, "/root/testdata/sf0.001")
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in df.collect()) == brute(rows, 100)
