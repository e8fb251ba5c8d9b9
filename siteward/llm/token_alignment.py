"""Alignment of two tokenizers' tokens of the same text by galloping intersection of their byte ends.

Both tokenizers cut the same bytes, so that each gives an ascending list of ends. The shorter list drives: each of its ends is
looked up in the longer one by exponential steps from the last place, then by bisection. Ends that both have cut the tokens
into groups; the ranks found say which tokens of the longer list a token of the shorter one overlaps. Many texts are one list
(each text's ends moved behind those of the last), cut into lanes that gallop side by side; where a lane starts is found by
galloping over the lanes' first ends.

Counts of linked pairs over the corpus are made in parts, bounded by their text: a part's pairs are counted in its task, so that
the shuffle carries a part's different pairs and not its links. A text keeps the numbers, in its part's list, of the pairs that it
has. Totals come back to the parts by a join and meet these numbers: no table of pairs is held whole anywhere.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteward.llm.common import table, tokenizer_path
from siteward.llm.token_counts import PLAIN, load_ranks
from siteward.session import materialize

#: Elements that one lane looks up one after the other; characters of text encoded at once, and of a part (one text may be more).
LANE, CHUNK_CHARS, PART_CHARS = 16, 250_000, 8_000_000
ALIGNED = "id long, part long, n_a long, n_b long, n_groups long, n_links long, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>, groups_sha256 string, n_pairs int, pairs binary, links binary, part_pairs array<long>, part_links array<long>"


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each of the ascending `short`, how many of the ascending `long` are less."""
    out, m = np.zeros(len(short), np.int64), len(long)
    if not len(short) or not m:
        return out
    heads = np.arange(0, len(short), LANE)
    low = gallop(short[heads], long) if len(heads) > 1 else np.zeros(1, np.int64)
    for t in range(min(LANE, len(short))):
        at = heads + t
        at = at[at < len(short)]
        x, lo = short[at], low[: len(at)]
        hi, step, lanes = np.full(len(at), m, np.int64), 1, np.arange(len(at))
        while len(lanes):  # exponential: those whose probe is less go on from behind it, twice as far
            probe = lo[lanes] + step - 1
            inside = probe < m
            less = inside & (long[np.minimum(probe, m - 1)] < x[lanes])
            hi[lanes[inside & ~less]] = probe[inside & ~less]
            lanes, probe = lanes[less], probe[less]
            lo[lanes] = probe + 1
            step *= 2
        lanes = np.flatnonzero(lo < hi)
        while len(lanes):  # bisection
            mid = (lo[lanes] + hi[lanes]) >> 1
            less = long[mid] < x[lanes]
            lo[lanes[less]] = mid[less] + 1
            hi[lanes[~less]] = mid[~less]
            lanes = lanes[lo[lanes] < hi[lanes]]
        out[at] = lo
    return out


class Pair(NamedTuple):
    """What both tokenizers are: A a byte-level .json with the same vocabulary as ranks, or without; B a sentencepiece model."""

    a: str
    b: str
    a_ranks: str | None = None


def byte_level() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """The two tokenizers, and the bytes of each of their tokens."""

    def __init__(self, pair: Pair):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(pair.a)
        self.library.encode_special_tokens = True
        self.ranks = load_ranks(pair.a_ranks) if pair.a_ranks else None
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pair.b)
        letters, vocabulary = byte_level(), self.library.get_vocab()
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b_bytes = []
        for k in range(self.pieces.get_piece_size()):
            piece = self.pieces.id_to_piece(k)
            self.b_bytes.append(bytes([int(piece[3:-1], 16)]) if self.pieces.is_byte(k) else piece.replace("▁", " ").encode())
        self.a_length, self.b_length = (np.array([*map(len, x)], np.int64) for x in (self.a_bytes, self.b_bytes))

    @functools.cached_property
    def written(self) -> tuple[np.ndarray, ...]:
        """Ids as text with what may follow them: for A "," or "|", for B ",", ";" or nothing."""
        a, b = ([*map(str, range(len(x)))] for x in (self.a_bytes, self.b_bytes))
        return tuple(np.array([k + end for k in ids], object) for ids, end in ((a, ","), (a, "|"), (b, ","), (b, ";"), (b, "")))

    def encode_a(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts; by ranks, which is faster, where all engines agree on the classes of a text's characters."""
        out: list = [None] * len(texts)
        rest = []
        for k, t in enumerate(texts):
            if self.ranks and PLAIN.fullmatch(t):
                out[k] = self.ranks.encode_ordinary(t)
            else:
                rest.append(k)
        for k, e in zip(rest, self.library.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)):
            out[k] = e.ids
        return out

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both for each text; none for a text that is null, empty, or not what either's tokens spell after a space."""
        none = np.zeros(0, np.int32)
        a, b = [none] * len(texts), [none] * len(texts)
        some = [k for k, t in enumerate(texts) if t]
        spaced = [" " + texts[k] for k in some]
        for k, text, x, y in zip(some, spaced, self.encode_a(spaced), self.pieces.encode([texts[k] for k in some], num_threads=1)):
            whole = text.encode()
            if b"".join([self.a_bytes[i] for i in x]) == whole and b"".join([self.b_bytes[i] for i in y]) == whole:
                a[k], b[k] = np.array(x, np.int32), np.array(y, np.int32)
        return a, b


@functools.lru_cache(2)
def load_pair(pair: Pair) -> Tokenizers:
    return Tokenizers(pair)


class Alignment:
    """The ids of many texts on both sides, and where they meet."""

    def __init__(self, t: Tokenizers, a: list[np.ndarray], b: list[np.ndarray]):
        self.t = t
        self.n_a, self.n_b = (np.array([*map(len, x)], np.int64) for x in (a, b))
        self.a, self.b = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (a, b))
        # A text has as many bytes on both sides, so that ends of the texts one behind the other ascend on both.
        ends_a, ends_b = np.cumsum(t.a_length[self.a]), np.cumsum(t.b_length[self.b])
        self.a_drives = self.n_a <= self.n_b
        from_a, from_b = np.repeat(self.a_drives, self.n_a), np.repeat(self.a_drives, self.n_b)
        # Positions of the driving and the driven tokens of each text, those of A as they are, those of B as -1 - position.
        self.short = self._woven(np.flatnonzero(from_a), np.flatnonzero(~from_b), self.a_drives)
        self.long = self._woven(np.flatnonzero(~from_a), np.flatnonzero(from_b), ~self.a_drives)
        end = lambda x: np.where(x >= 0, ends_a[np.maximum(x, 0)] if len(ends_a) else 0, ends_b[np.maximum(-1 - x, 0)] if len(ends_b) else 0)
        short, long = end(self.short), end(self.long)
        self.rank = gallop(short, long)
        self.common = long[self.rank] == short if len(short) else np.zeros(0, bool)
        # Ends that both have, as positions on both sides.
        s, g = self.short[self.common], self.long[self.rank[self.common]]
        self.cut_a, self.cut_b = np.maximum(s, g), -1 - np.minimum(s, g)

    def _woven(self, of_a: np.ndarray, of_b: np.ndarray, from_a: np.ndarray) -> np.ndarray:
        """Token positions of A and of B in the order of the texts."""
        n = np.where(from_a, self.n_a, self.n_b)
        side, out = np.repeat(from_a, n), np.empty(int(n.sum()), np.int64)
        out[side], out[~side] = of_a, -1 - of_b
        return out

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each pair of tokens whose bytes overlap: the text's number, A's id, B's id."""
        after = self.rank + self.common
        first = np.concatenate([[0], after[:-1]]) if len(after) else after
        n = self.rank - first + 1
        s = np.repeat(self.short, n)
        g = self.long[np.arange(len(s)) - np.repeat(np.cumsum(n) - n - first, n)] if len(s) else s
        at_a = np.maximum(s, g)
        text = np.searchsorted(np.cumsum(self.n_a), at_a, side="right")
        return text, self.a[at_a], self.b[-1 - np.minimum(s, g)]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Links as (text's number, A's id times the size of B's vocabulary, plus B's id)."""
        text, a, b = self.links()
        return text, a.astype(np.int64) * len(self.t.b_bytes) + b

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's different keys in order with their links, and where each text's begin (and the last's end)."""
        text, key = self.keys()
        size = len(self.t.a_bytes) * len(self.t.b_bytes)
        both, n = np.unique(text * size + key, return_counts=True)
        return both % size, n, np.searchsorted(both, np.arange(len(self.n_a) + 1) * size)

    def per_text(self, ids: bool) -> pd.DataFrame:
        """The columns of ALIGNED that say how a text is aligned; without `ids`, those of ids and cuts are null."""
        until_a, until_b = np.cumsum(self.n_a), np.cumsum(self.n_b)
        starts_a, starts_b = until_a - self.n_a, until_b - self.n_b
        upto = np.searchsorted(self.cut_a, until_a)  # cuts before each text's end
        n_groups = np.diff(upto, prepend=0)
        comma, bar, comma_b, semicolon, nothing = self.t.written
        last_a, last_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        last_a[self.cut_a] = last_b[self.cut_b] = True
        text_a, text_b = np.where(last_a, bar[self.a], comma[self.a]), np.where(last_b, semicolon[self.b], comma_b[self.b])
        text_b[until_b[self.n_b > 0] - 1] = nothing[self.b[until_b[self.n_b > 0] - 1]]
        # In the written form a group's A ids come before its B ids.
        place_a = np.arange(len(self.a)) + np.concatenate([[0], self.cut_b + 1])[np.searchsorted(self.cut_a, np.arange(len(self.a)))]
        place_b = np.arange(len(self.b)) + (self.cut_a + 1)[np.searchsorted(self.cut_b, np.arange(len(self.b)))] if len(self.b) else place_a
        written = np.empty(len(self.a) + len(self.b), object)
        written[place_a], written[place_b] = text_a, text_b
        rows = []
        for k in range(len(self.n_a)):
            a, b, c, n = starts_a[k], starts_b[k], upto[k] - n_groups[k], n_groups[k]
            whole = "".join(written[a + b : until_a[k] + until_b[k]])
            arrays = (self.a[a : until_a[k]], self.b[b : until_b[k]], self.cut_a[c : c + n] + 1 - a, self.cut_b[c : c + n] + 1 - b) if ids else (None,) * 4
            rows.append((self.n_a[k], self.n_b[k], n, self.n_a[k] + self.n_b[k] - n, *arrays, hashlib.sha256(whole.encode()).hexdigest() if whole else ""))
        return pd.DataFrame(rows, columns=["n_a", "n_b", "n_groups", "n_links", "a_ids", "b_ids", "a_cuts", "b_cuts", "groups_sha256"])


def pieces_of(sizes: list[int], limit: int) -> Iterator[slice]:
    """Runs of rows with at most `limit` in all, or of one row."""
    start, total = 0, 0
    for k, n in enumerate(sizes):
        if k > start and total + n > limit:
            yield slice(start, k)
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def merged(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the numbers by key, the keys in order."""
    names, at = np.unique(keys, return_inverse=True)
    return names, np.bincount(at, n, len(names)).astype(np.int64)  # sums far below 2^53


def packed(whole: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold the largest."""
    return whole.astype(np.min_scalar_type(int(whole.max()))).tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // n}").astype(np.int64)


class Part:
    """Aligned chunks that will share a list of pairs."""

    def __init__(self, number: int):
        self.number, self.chars, self.frames, self.found = number, 0, [], []

    def add(self, chars: int, ids: np.ndarray, alignment: Alignment, with_ids: bool) -> None:
        frame = alignment.per_text(with_ids)
        frame.insert(0, "id", ids)
        frame.insert(1, "part", self.number)
        self.chars += chars
        self.frames.append(frame)
        self.found.append(alignment.pairs())

    def rows(self) -> Iterator[pd.DataFrame]:
        """The chunks' rows; the part's last one has its pairs."""
        if not self.frames:
            return
        names, n = merged(*(np.concatenate([f[k] for f in self.found]) for k in (0, 1)))
        for k, (frame, (keys, links, starts)) in enumerate(zip(self.frames, self.found)):
            at = np.searchsorted(names, keys)
            spans = list(zip(starts[:-1].tolist(), starts[1:].tolist()))
            frame["n_pairs"] = np.diff(starts)
            frame["pairs"] = [packed(at[i:j]) if j > i else None for i, j in spans]
            frame["links"] = [packed(links[i:j]) if j > i else None for i, j in spans]
            frame["part_pairs"] = frame["part_links"] = None
            if k == len(self.frames) - 1:
                frame.at[len(frame) - 1, "part_pairs"], frame.at[len(frame) - 1, "part_links"] = names, n
            yield frame


def aligned(docs: DataFrame, pair: Pair, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """ALIGNED for each row of docs: ids of both tokenizers, how many tokens of each lie before the end of each group (a_cuts,
    b_cuts; ids=False leaves these four null), and a digest of the groups. A text that is null, empty, or not spelt by either's
    tokens after one space has no tokens: zeros, empty arrays, ''. Equal rows stay apart; an empty table gives an empty one.

    part: a number for at most PART_CHARS characters of text, or one longer text, that one task read. A part's last row has its
    linked pairs (A's id times the size of B's vocabulary, plus B's id) and how many links hold each; other rows have nulls there.
    n_pairs, pairs, links: how many different pairs a text has, packed their places in that list, and how many links hold each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, part = load_pair(pair), Part(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for rows in pieces_of([len(x or "") for x in batch["text"]], CHUNK_CHARS):
                of = batch.iloc[rows]
                size = int(sum(len(x or "") for x in of["text"]))
                if part.frames and part.chars + size > PART_CHARS:
                    yield from part.rows()
                    part = Part(part.number + 1)
                part.add(size, of["id"].to_numpy(), Alignment(t, *t.encode(of["text"].tolist())), ids)
        yield from part.rows()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, ALIGNED)


def part_pairs(alignments: DataFrame) -> DataFrame:
    """(part, pair, n): how many links of a part hold the two ids, a row for each."""
    both = alignments.where("part_pairs IS NOT NULL").select("part", F.explode(F.arrays_zip("part_pairs", "part_links")).alias("p"))
    return both.select("part", F.col("p.part_pairs").alias("pair"), F.col("p.part_links").alias("n"))


def pair_counts(pairs: DataFrame, b_size: int) -> DataFrame:
    """(pair, count, best): a pair's links over the corpus, and whether no other pair with its B id has more."""
    total = pairs.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair") % b_size)
    most = total.groupBy("b").agg(F.max("count").alias("most"))  # a row for each id of B's vocabulary at most
    return total.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def with_link_counts(alignments: DataFrame, pair: Pair) -> DataFrame:
    """alignments, which must be a table at rest, with n_best and count_sum for each row."""
    t = load_pair(pair)
    pairs = part_pairs(alignments)
    counts = materialize(pair_counts(pairs, len(t.b_bytes)), "pair-counts")
    known = pairs.select(F.col("part").alias("of_part"), "pair").join(counts, "pair")

    def run(docs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("pair")  # the part's list again
        count, best = known["count"].to_numpy(), known["best"].to_numpy()
        rows = []
        for n, pairs, links in zip(docs["n_pairs"], docs["pairs"], docs["links"]):
            at, links = unpacked(pairs, n), unpacked(links, n)
            rows.append((int(links[best[at]].sum()), int(links @ count[at])))
        return docs[columns].assign(n_best=[r[0] for r in rows], count_sum=[r[1] for r in rows])

    columns = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = "id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    some = alignments.where("n_links > 0").select("part", *columns, "n_pairs", "pairs", "links")
    out = some.groupBy("part").cogroup(known.groupBy("of_part")).applyInPandas(run, schema)
    zero = F.lit(0).cast("long")
    return out.unionByName(alignments.where("n_links = 0").select(*columns, zero.alias("n_best"), zero.alias("count_sum")))


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    pair = Pair(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), tokenizer_path("byte_bpe_50k.tiktoken"))
    rest = materialize(aligned(table(spark, sf_dir, "documents"), pair, ids=False).drop("a_ids", "b_ids", "a_cuts", "b_cuts"), "aligned")
    return with_link_counts(rest, pair).withColumnRenamed("id", "doc_id").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
