"""Hard negatives by Fagin's threshold algorithm over blocks of candidates.

Rows are dealt into candidate blocks and, of them, anchors into blocks, too; each pair of blocks is one group. There a
candidate block has a list for each dimension, sorted by that component. For an anchor, lists are read in step, from the top
where the anchor's component is positive and from the bottom where it is negative; each row met is scored at once by its
whole inner product. What no list has shown yet can score at most the sum over the dimensions of the anchor's component times
the last one read: the threshold. Reading stops once it falls strictly below the kth score (of all that have to be found: the
best of the same label, or the best in each window of scores), or below where a window begins. A block's best are joined to
those of the other blocks by rank, so that the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteward.llm.common import table
from siteward.session import materialize

#: Candidates and anchors of a block; depth of the first reading of the lists, which then grows.
CANDIDATES, ANCHORS, DEPTH = 8192, 4096, 32
#: Whole numbers up to this are exact as doubles.
EXACT = 2**53


class Found(NamedTuple):
    score: np.ndarray
    row: np.ndarray
    read: int  # rows scored


class Lists:
    """A block's rows with a sorted list for each dimension. x: whole numbers, a row for each candidate; ids ascend."""

    def __init__(self, x: np.ndarray, rows: np.ndarray):
        # Inner products of doubles are exact below 2^53; beyond, whole numbers are multiplied.
        self.x, self.rows = x, rows
        self.order = np.argsort(x[rows], axis=0, kind="stable")  # positions in rows, ascending by component

    def best(self, q: np.ndarray, k: int, windows: list[tuple]) -> Found:
        """Rows whose score is among the k best (ties: of least row) of at least one of the windows (lowest, highest score)."""
        n, dims = len(self.rows), np.flatnonzero(q)
        top, signs = q[dims], q[dims] > 0
        seen, rows_found, scores_found = np.zeros(n, bool), [], []
        kth, at, step = [-np.inf] * len(windows), 0, DEPTH
        while at < n and len(windows):
            upto = min(n, at + step)
            if len(dims):
                # A list read from its end is the list of the negative component read from its top.
                read = np.where(signs, self.order[n - upto : n - at, dims][::-1], self.order[at:upto, dims])
                new = np.unique(read)
                new = new[~seen[new]]
                last = self.x[self.rows[read[-1]], dims]
                threshold = int(top @ last)
            else:
                new, threshold = np.arange(n), -np.inf  # all rows have the score 0
                upto = n
            seen[new] = True
            got = self.x[self.rows[new]] @ q
            inside = np.zeros(len(new), bool)
            for lo, hi in windows:
                inside |= (got >= lo) & (got <= hi)
            rows_found.append(self.rows[new[inside]])
            scores_found.append(got[inside])
            if upto < n:
                rows_now, scores = np.concatenate(rows_found), np.concatenate(scores_found)
                for w, (lo, hi) in enumerate(windows):
                    of = scores[(scores >= lo) & (scores <= hi)]
                    kth[w] = int(np.partition(of, len(of) - k)[len(of) - k]) if len(of) >= k else -np.inf
                rows_found, scores_found = [rows_now], [scores]
                if all(threshold < max(score, lo) for score, (lo, _) in zip(kth, windows)):
                    break
            at, step = upto, step * 2
        none = np.zeros(0, np.int64)
        return Found(np.concatenate(scores_found) if scores_found else none, np.concatenate(rows_found) if rows_found else none, int(seen.sum()))


def matrix(vectors: list[np.ndarray], others: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Both as matrices of as many columns; a shorter vector ends in zeros. Doubles where all products are exact, else longs."""
    dims = max([1, *map(len, vectors), *map(len, others)])
    out = []
    for of in (vectors, others):
        m = np.zeros((len(of), dims), np.int64)
        lengths = np.array([*map(len, of)], np.int64)
        for n in np.unique(lengths[lengths > 0]):
            of_n = np.flatnonzero(lengths == n)
            m[of_n, :n] = np.stack([of[k] for k in of_n])
        out.append(m)
    most = [float(np.abs(m).max(initial=0)) for m in out]
    return tuple(m.astype(np.float64) for m in out) if most[0] * most[1] * dims < EXACT else tuple(out)


def first_k(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by the smaller id."""
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def prepared(vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = 256) -> DataFrame:
    """(id, label, x): x is floor(scale * component), as longs. Rows with a null id, label, vector or component, or a component
    that is not finite, take no part; of rows with one id, that of least (label, x) stays."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.when(finite, whole).alias("x"))
    return rows.where("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").groupBy("id").agg(F.min(F.struct("label", "x")).alias("r")).select("id", "r.label", "r.x")


def _blocks(rows: DataFrame, size: int, name: str, n: int) -> DataFrame:
    return rows.withColumn(name, F.pmod(F.xxhash64("id", F.lit(name)), F.lit(max(1, -(-n // size)))))


def searched(rows: DataFrame, anchors: DataFrame, k: int, same_label: bool) -> DataFrame:
    """(anchor_id, window, id, score): for each anchor and each of its windows (an array of (key, lo, hi); each block's own) at
    least all that are among the k best of the rows of the same label but itself, or of those of other labels. anchors: id,
    label, x, windows. Each anchor block meets each candidate block, in one group."""
    n, m = rows.count(), anchors.count()
    blocks = max(1, -(-n // CANDIDATES))
    c = _blocks(rows, CANDIDATES, "block", n)
    a = _blocks(anchors.select("id", "label", "x", "windows"), ANCHORS, "anchors", m)
    every = lambda size: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")))
    a = a.select(every(blocks).alias("to_block"), F.col("anchors").alias("of_anchors"), F.col("id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("x").alias("q"), F.col("windows").alias("asked"))
    c = c.withColumn("anchors", every(max(1, -(-m // ANCHORS))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(left) and len(right):
            left, right = left.sort_values("id"), right.sort_values("anchor_label")
            q, x = matrix(right["q"].tolist(), left["x"].tolist())
            ids, labels = left["id"].to_numpy(), left["label"].to_numpy()
            of, lists = None, None
            for k_a, (anchor, label, windows) in enumerate(zip(right["anchor_id"], right["anchor_label"], right["asked"])):
                if label != of:
                    of, lists = label, Lists(x, np.flatnonzero((labels == label) == same_label))
                wants = [(w["key"], -np.inf if w["lo"] is None else w["lo"], np.inf if w["hi"] is None else w["hi"]) for w in windows]
                # The anchor itself is one of its label's rows.
                found = lists.best(q[k_a], k + same_label, [w[1:] for w in wants])
                score, who = found.score, ids[found.row]
                if same_label:
                    score, who = score[who != anchor], who[who != anchor]
                for key, lo, hi in wants:
                    inside = np.flatnonzero((score >= lo) & (score <= hi))
                    best = inside[first_k(score[inside], who[inside], k)]
                    out.append(pd.DataFrame({"anchor_id": anchor, "window": key, "id": who[best], "score": score[best].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"anchor_id": [], "window": [], "id": [], "score": []}).astype("int64")

    return c.groupBy("block", "anchors").cogroup(a.groupBy("to_block", "of_anchors")).applyInPandas(run, "anchor_id long, window long, id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, least_percent: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor, of `anchors` (a subset of
    rows by id), and each of its first `positives` rows of its label: the first `negatives` rows of other labels that score at
    least `least_percent` of the positive and no more than it. Higher scores come first, of equal ones the smaller id; an anchor
    without positives, and a positive without such negatives, has no row. rows: see prepared(), at rest. Inner products must fit
    in a long; shorter vectors count as if zeros followed. An empty table gives an empty one."""
    whole = "array<struct<key:long,lo:long,hi:long>>"
    any_score = anchors.withColumn("windows", F.array(F.struct(F.lit(0).alias("key"), F.lit(None).alias("lo"), F.lit(None).alias("hi"))).cast(whole))
    best = materialize(_ranked(searched(rows, any_score, positives, True), positives).select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    p = F.col("positive_score")
    lo = F.expr(f"-floor(-CAST(positive_score AS DECIMAL(38,0)) * {least_percent} / 100)").cast("long")  # rounded up
    windows = best.where(p >= 0).groupBy("anchor_id").agg(F.collect_set(F.struct(p.alias("key"), lo.alias("lo"), p.alias("hi"))).alias("windows"))
    asked = anchors.join(windows, anchors["id"] == windows["anchor_id"]).select("id", "label", "x", F.col("windows").cast(whole).alias("windows"))
    found = _ranked(searched(rows, asked, negatives, False), negatives)
    out = best.join(found.select("anchor_id", F.col("window").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor_id", "positive_score"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100; labels of rows whose id is divisible by 7 are first moved by one."""
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    rows = materialize(prepared(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label), "vectors")
    return hard_negatives(rows, rows.where("id % 100 = 0"))
