"""Toxicity from a learned lexicon, misspelt terms included, and the context of each hit.

Terms are words and word stems that labelled toxic documents have far more often than others. The lexicon is a trie, and
a Levenshtein automaton of one or two errors runs over all its terms at once: a state is the set of (trie node, errors)
pairs that the letters read so far can lead to. States and their transitions are made when they are first met and kept, so
that a word costs a table look-up a letter and most words end in the dead state after a few. Every term of 5 letters or
more may have errors, unless the sample's other documents have its neighbours about as often as the toxic ones do. Hits
are told apart by their context window: between quotation marks they may be quotation; next to other hits, abuse. A
logistic regression over these counts, fitted on labelled documents, gives the score.
"""

from __future__ import annotations

import functools
import math
import re
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteward.llm.common import table
from siteward.session import discard, materialize

#: The bound of the labelled sample. The lexicon is made of its words, so that this bounds it, too.
TRAIN_DOCS = 8_000
WORD = re.compile(r"[^\W\d_]+")
LETTERS = r"\p{L}+"
#: Marks of quotation: those that open, those that close, and those that do either.
OPENING, CLOSING, EITHER = "“„«‘‹", "”»’›", '"'
WINDOW = 6
#: Counts of a document's hits, and what the weights of their logarithms are drawn to where labels say little; the last is the
#: intercept.
FEATURES = ["plain_exact", "plain_near", "quoted_exact", "quoted_near", "clustered"]
PRIOR = np.array([3.0, 2.0, -0.3, -0.3, 0.7, -4.0])
PLAIN = 2  # the first features, whose weights are not below 0
#: States of the automaton, and words with their errors, that a worker keeps before it begins anew.
STATES, WORDS_KEPT = 20_000, 200_000
#: A word within the errors of another that so many times as many toxic documents have is a misspelling of it.
RARE = 10


def budget(length: int) -> int:
    """The errors that a term of so many letters may have; an error is a letter changed, added or left out."""
    return 0 if length < 5 else 1 if length < 9 else 2


class Term(NamedTuple):
    """A term that a whole word must be, or a stem that it must begin with, with `limit` errors or fewer."""

    text: str
    limit: int
    stem: bool


class Lexicon:
    """Terms as a trie with its Levenshtein automaton."""

    def __init__(self, terms: list[Term]):
        self.root: dict = {"errors": 0}
        for k, (term, limit, stem) in enumerate(terms):
            node = self.root
            node["errors"] = max(node["errors"], limit)
            for c in term:
                node = node.setdefault(c, {"errors": 0})
                node["errors"] = max(node["errors"], limit)
            node.setdefault("terms", []).append((limit, stem, k))
        self.forget()

    def forget(self) -> None:
        self.states: list[tuple] = []
        self.number: dict = {}
        self.accepts: list[tuple[tuple[int, int], ...]] = []  # (errors, number) of the terms met if a word ends here, the best first
        self.next: list[dict[str, int]] = []
        self.dead = self.state({}, {})
        self.start = self.state({id(self.root): (self.root, 0)}, {})

    def state(self, nodes: dict, stems: dict[int, int]) -> int:
        """The number of the state that has these nodes with their least errors; stems: {number: least errors} of those complete."""
        nodes, todo = dict(nodes), list(nodes.values())
        while todo:  # letters left out
            node, errors = todo.pop()
            if errors < node["errors"]:
                for c, child in node.items():
                    if len(c) == 1 and errors + 1 <= child["errors"] and nodes.get(id(child), (0, 9))[1] > errors + 1:
                        nodes[id(child)] = (child, errors + 1)
                        todo.append((child, errors + 1))
        stems, words = dict(stems), {}
        for n, e in nodes.values():
            for limit, stem, k in n.get("terms", ()):
                if e <= limit:
                    of = stems if stem else words
                    of[k] = min(e, of.get(k, e))
        key = (frozenset((k, e) for k, (_, e) in nodes.items()), frozenset(stems.items()))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append((nodes, stems))
            self.accepts.append(tuple(sorted((e, k) for k, e in (stems | words).items())))
            self.next.append({})
        return self.number[key]

    def step(self, state: int, c: str) -> int:
        nodes, stems = self.states[state]
        after: dict = {}

        def reach(node: dict, errors: int) -> None:
            if errors <= node["errors"] and after.get(id(node), (0, 9))[1] > errors:
                after[id(node)] = (node, errors)

        for node, errors in nodes.values():
            if errors < self.root["errors"]:
                for k, child in node.items():
                    if len(k) == 1:
                        reach(child, errors + (k != c))
                reach(node, errors + 1)
            elif c in node:
                reach(node[c], errors)
        to = self.state(after, stems)
        self.next[state][c] = to
        return to

    def met(self, word: str) -> tuple[tuple[int, int], ...]:
        """(errors, number) of the terms that the word meets, the nearest first, of equals the first."""
        if len(self.states) > STATES:
            self.forget()
        state, dead = self.start, self.dead
        for c in word:
            to = self.next[state].get(c)
            state = self.step(state, c) if to is None else to
            if state == dead:
                return ()
        return self.accepts[state]

    def errors(self, word: str) -> int:
        """Errors of the nearest term (0: exact), or -1."""
        found = self.met(word)
        return found[0][0] if found else -1


class Detector:
    """Counts of hits of whole texts, and the score that weights give them."""

    def __init__(self, terms: list[Term], weights: np.ndarray | None = None):
        self.terms, self.weights = terms, weights

    def __reduce__(self):
        return Detector, (self.terms, self.weights)

    @functools.cached_property
    def lexicon(self) -> Lexicon:
        return Lexicon(self.terms)

    @functools.cached_property
    def seen(self) -> dict[str, int]:
        return {}

    def features(self, text: str | None) -> tuple[int, ...]:
        counts = dict.fromkeys(FEATURES, 0)
        if not text or not self.terms:
            return (0,) * len(FEATURES)
        seen, hits = self.seen, []
        words = text.lower().split()
        for k, w in enumerate(words):
            e = seen.get(w)
            if e is None:
                if len(seen) > WORDS_KEPT:
                    seen.clear()
                e = seen[w] = max((self.lexicon.errors(x) for x in WORD.findall(w)), key=lambda e: (e >= 0, -e), default=-1)
            if e >= 0:
                hits.append((k, e))
        for n, (k, e) in enumerate(hits):
            quoted = self.quoted(words, k)
            counts[("quoted_" if quoted else "plain_") + ("near" if e else "exact")] += 1
            near = (n and k - hits[n - 1][0] <= WINDOW) or (n + 1 < len(hits) and hits[n + 1][0] - k <= WINDOW)
            counts["clustered"] += bool(near and not quoted)
        return tuple(counts[f] for f in FEATURES)

    @staticmethod
    def quoted(words: list[str], k: int) -> bool:
        """The window has a mark that opens before the hit and one that closes after it."""
        before, after = words[max(0, k - WINDOW) : k + 1], words[k : k + WINDOW + 1]
        opens = any(w[0] in OPENING + EITHER for w in before)
        closes = any(w.rstrip(".,;:!?")[-1:] in [*CLOSING, EITHER] for w in after)
        return opens and closes

    def score(self, features: tuple[int, ...]) -> float:
        return 1 / (1 + math.exp(-float(self.weights[-1] + np.dot(self.weights[:-1], np.log1p(features)))))


def hit_counts(text: Column, detector: Detector) -> Column:
    """FEATURES of a text column as an array."""

    @F.pandas_udf("array<int>")
    def count(batch: pd.Series) -> pd.Series:
        return pd.Series([detector.features(t) for t in batch], dtype=object)

    return count(text)


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels are never learned: crc32 of the id as text leaves 1 when divided by 3. Null: false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def stems_of(prefixes: list[tuple[str, int]], least: int) -> list[str]:
    """The shortest of the (prefix, documents) pairs, each drawn out to the longest that nearly all of its documents have."""
    count, taken = dict(prefixes), []
    for p in sorted(count, key=lambda p: (len(p), p)):
        if len(p) > least and p[:-1] in count or any(p.startswith(t) for t in taken):
            continue
        longest = p
        while more := [q for q in count if len(q) == len(longest) + 1 and q.startswith(longest) and count[q] >= 0.95 * count[p]]:
            longest = more[0]
        taken.append(longest)
    return taken


def learn_terms(train: DataFrame, stems: tuple[int, int] = (4, 8), share: float = 0.01, least: float = 4.0, near: float = 3.0) -> list[Term]:
    """The terms of a labelled sample. Documents that have a word are counted by label; a term needs 5 toxic documents, this
    share of them, and the log odds `least`. A prefix with all that is a stem if three words of toxic documents share it,
    misspelt ones (within the errors of one RARE times as frequent) not counted. Words with all that are terms, too. A term may have the errors of budget(), or fewer
    where the words that it only meets by them have not the log odds `near`."""
    words = train.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0)))).alias("word"))
    words = materialize(words.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")), "words")
    n = train.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not n[0] or not n[1]:
        discard(words)
        return []
    odds = F.log((F.col("t") + 0.5) / (n[0] + 1)) - F.log((F.col("c") + 0.5) / (n[1] + 1))
    strong = lambda df: df.where((odds >= least) & (F.col("t") >= max(5, share * n[0])))
    # Of the sample's words, whose number its bound limits.
    own = [r.word for r in strong(words.where(F.char_length("word") >= stems[0])).orderBy(F.desc("t"), "word").collect()]
    cut = words.select("word", "t", "c", F.explode(F.sequence(F.lit(stems[0]), F.least(F.char_length("word"), F.lit(stems[1])))).alias("k")).where(F.char_length("word") >= stems[0])
    prefix = strong(cut.groupBy(F.substr("word", F.lit(1), "k").alias("prefix")).agg(F.sum("t").alias("t"), F.sum("c").alias("c"))).select("prefix", F.col("t").alias("n"))
    kinds = cut.where("t > 0").select("word", "t", F.substr("word", F.lit(1), "k").alias("prefix")).join(F.broadcast(prefix), "prefix")
    found: dict[tuple[str, int], list[tuple[str, int]]] = {}
    for r in kinds.orderBy(F.desc("t"), "word").collect():
        known = found.setdefault((r.prefix, r.n), [])
        usual = [Term(w, budget(len(w)), False) for w, t in known if t >= RARE * r.t]
        if len(known) < 3 and (not usual or not Lexicon(usual).met(r.word)):
            known.append((r.word, r.t))
    first = stems_of([k for k, known in found.items() if len(known) >= 3], stems[0])
    terms = [Term(w, budget(len(w)), True) for w in first] + [Term(w, budget(len(w)), False) for w in own if w not in first]
    terms = within_reason(words, terms, n, near)
    discard(words)
    return terms


def within_reason(words: DataFrame, terms: list[Term], n, near: float) -> list[Term]:
    """The terms without the errors by which they meet words that are not more typical of toxic documents by the log odds
    `near`. Words are counted in Spark; a row for each term and number of errors comes back."""
    lexicon = Detector(terms)

    @F.pandas_udf("array<struct<errors:int,term:int>>")
    def near_terms(batch: pd.Series) -> pd.Series:
        found = (lexicon.lexicon.met(w) for w in batch)
        return pd.Series([[{"errors": e, "term": k} for e, k in f if e] if f and f[0][0] else [] for f in found], dtype=object)

    met = words.select("t", "c", F.explode(near_terms("word")).alias("m")).select("t", "c", "m.*").groupBy("term", "errors").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    limits = [t.limit for t in terms]
    for r in met.collect():
        if math.log((r.t + 0.5) / (n[0] + 1)) - math.log((r.c + 0.5) / (n[1] + 1)) < near:
            limits[r.term] = min(limits[r.term], r.errors - 1)
    return [t._replace(limit=k) for t, k in zip(terms, limits)]


def as_misspelt(features: tuple[int, ...]) -> tuple[int, ...]:
    """The features if all exact hits were near ones."""
    exact, near, quoted, quoted_near, clustered = features
    return 0, exact + near, 0, quoted + quoted_near, clustered


def fit_weights(counted: list[tuple[tuple[int, ...], int, int]], rounds: int = 25, pull: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps over (features, toxic documents, other documents), drawn to PRIOR. Few of a sample's
    hits are misspelt, so that each toxic document with hits counts a second time as if all of its were."""
    w = PRIOR.copy()
    if not counted:
        return w
    counted = counted + [(as_misspelt(f), yes, 0) for f, yes, _ in counted if yes and as_misspelt(f) != f]
    x = np.array([[*np.log1p(f), 1] for f, _, _ in counted], float)
    yes, no = np.array([[a, b] for _, a, b in counted], float).T
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (yes - (yes + no) * p) - pull * (w - PRIOR)
        hess = (x * ((yes + no) * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w + step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    w[:PLAIN] = np.maximum(w[:PLAIN], 0.0)
    return w


def train_detector(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = TRAIN_DOCS) -> Detector:
    """Fitted on at most `bound` labelled documents (those of least hash) that are not held out. Repeated labels of a document
    count once, the larger; null labels not at all."""
    ids = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = materialize(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound), "labels")  # at most `bound` rows
    chosen = ids.select(F.col("doc_id").alias("_sw_id"), "toxic")
    text = docs.select(F.col(id_col).alias("_sw_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    train = materialize(text.join(F.broadcast(chosen), F.col("_sw_doc") == F.col("_sw_id")).select("text", "toxic"), "train")
    detector = Detector(learn_terms(train))
    counted = train.select("toxic", hit_counts(F.col("text"), detector).alias("f")).groupBy("f").agg(F.sum("toxic").alias("yes"), F.sum(1 - F.col("toxic")).alias("no"))
    rows = [(tuple(r.f), r.yes, r.no) for r in counted.collect()]  # `bound` rows at most
    detector.weights = fit_weights(rows)
    discard(train)
    discard(ids)
    return detector


def toxicity_score(text: Column, detector: Detector) -> Column:
    """The probability, from 0 to 1, that a text is toxic; null and empty texts get that of a text without hits."""

    @F.pandas_udf("double")
    def score(batch: pd.Series) -> pd.Series:
        of = functools.lru_cache(None)(detector.score)
        return pd.Series([of(detector.features(t)) for t in batch], dtype="float64")

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted. Equal rows stay apart; an empty table gives an empty
    one; without labels of both kinds nothing is learned and all get the same low score."""
    detector = train_detector(docs, labels, id_col, text_col)
    out = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), toxicity_score(F.col(text_col), detector).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that score under the threshold, with their own columns."""
    detector = train_detector(docs, labels, id_col, text_col)
    return docs.where(toxicity_score(F.col(text_col), detector) < threshold)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
