"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is in a document if the document has at least `threshold` of the item's distinct word shingles. MinHash estimates
resemblance, which says little where a short item meets a long document; so items are partitioned by size, and each size
class cuts the documents into windows of twice its largest item, each beginning half a window after the one before. The
shingles that a document has of an item of n shingles, in a class up to S >= n > S / 2, lie in windows whose resemblances
to the item add up to threshold * n / (2 * S + (1 - threshold) * n) at least, 0.19 at 0.8, so that all `permutations`
minima of all windows differ with probability exp(-0.19 * permutations) at most: 2e-5 with 57, and 1e-9 where n is S. The
smallest items, up to ANCHORED shingles, are found exactly: a document with enough of the shingles has one of any
(n - needed + 1) of them, which are looked up. The items' minima are an index; windows look theirs up, and what meets there
is verified exactly, by the words of the shingles. Items whose index is larger than one broadcast may be are searched in
blocks, one pass after the other, each written before the next index is made; documents are not shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteward.llm.common import table
from siteward.session import materialize

PERMUTATIONS = 57
#: Items of so many distinct shingles or fewer are looked up by their shingles.
ANCHORED = 16
#: Bytes of one block's index: the minima and shingles of its items, and their texts.
BLOCK_BYTES = 64 * 2**20
#: The largest item of a size class over that of the class below.
CLASS_GROWTH = 2
#: Texts whose windows are done together.
TEXTS = 256
LAST = np.uint64(2**64 - 1)


def word_hashes(words: list[bytes], seen: dict[bytes, int]) -> np.ndarray:
    import xxhash

    if len(seen) > 400_000:
        seen.clear()
    digest = xxhash.xxh3_64_intdigest
    out = []
    for w in words:
        h = seen.get(w)
        if h is None:
            h = seen[w] = digest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def words_of(text: str | None) -> list[bytes]:
    """Words are lower-cased and lie between white space."""
    return text.lower().encode("utf-8", "surrogatepass").split() if text else []


def shingle_hashes(words: list[bytes], width: int, seen: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of the word shingles in order. A text of fewer words has one shingle, of all of them; one without words has
    none."""
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words, seen)
    n = max(1, len(h) - width + 1)
    out = np.full(n, len(h) if len(h) < width else width, dtype=np.uint64)
    for k in range(min(width, len(h))):
        out = mixed(out * np.uint64(31) + h[k : k + n])
    return out


def multipliers(count: int) -> np.ndarray:
    r = np.random.default_rng(20240607)
    return r.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Sorted:
    """Numbers of items by hashes that may repeat."""

    def __init__(self, pairs: list[tuple[int, int]]):
        order = np.argsort(np.array([h for h, _ in pairs], np.uint64), kind="stable")
        self.keys = np.array([h for h, _ in pairs], np.uint64)[order]
        self.items = np.array([k for _, k in pairs], np.int64)[order]

    def meet(self, hashes: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(place, items) for the places of hashes that are keys."""
        if not len(self.keys):
            return
        lo = np.searchsorted(self.keys, hashes)
        for w in np.flatnonzero(self.keys[np.minimum(lo, len(self.keys) - 1)] == hashes):
            yield int(w), self.items[lo[w] : np.searchsorted(self.keys, hashes[w], "right")].tolist()


class Index:
    """A block of items: the anchors of small ones and, by size class, the minima of the others under each permutation
    (h * odd number)."""

    def __init__(self, items: list[tuple[object, str | None]], threshold: float, width: int, permutations: int):
        self.args = (items, threshold, width, permutations)
        self.threshold, self.width = threshold, width
        self.odd, self.seen = multipliers(permutations), {}
        self.items: list[tuple[object, np.ndarray, list[bytes]]] = []
        classes: dict[int, list[int]] = {}
        anchors = []
        for item_id, text in items:
            words = words_of(text)
            s = np.unique(shingle_hashes(words, width, self.seen))
            if 0 < len(s) <= ANCHORED:
                anchors += [(h, len(self.items)) for h in s[: len(s) - self.needed(len(s)) + 1]]
            elif len(s):
                classes.setdefault(int(np.ceil(np.log2(len(s)) / np.log2(CLASS_GROWTH))), []).append(len(self.items))
            if len(s):
                self.items.append((item_id, s, words))
        self.anchors = Sorted(anchors)
        self.classes = [(CLASS_GROWTH**c, [Sorted([((self.items[k][1] * m).min(), k) for k in members]) for m in self.odd]) for c, members in sorted(classes.items())]

    def __reduce__(self):
        return Index, self.args

    def needed(self, n: int) -> int:
        """The least count that is `threshold` of n."""
        k = max(0, math.ceil(self.threshold * n) - 1)
        return k if k / n >= self.threshold else k + 1

    def candidates(self, texts: list[np.ndarray]) -> dict[int, set[int]]:
        """{text: items} of those that share an anchor, or a minimum of a window; texts by their shingles, all done at once.
        Each text is cut into the smallest class's pieces, and the minima of a class's pieces are those of two pieces of the
        one below."""
        found: dict[int, set[int]] = {}
        whole = np.cumsum([len(h) for h in texts])
        for w, items in self.anchors.meet(np.concatenate(texts)) if texts else ():
            found.setdefault(int(np.searchsorted(whole, w, "right")), set()).update(items)
        if not self.classes or not texts:
            return found
        small, large = self.classes[0][0], self.classes[-1][0]
        width = [-(-max(1, len(h)) // large) * large for h in texts]
        ends = np.cumsum(width)
        flat = np.empty(ends[-1], np.uint64)
        fill = np.zeros(ends[-1], bool)
        for h, e, w in zip(texts, ends, width):
            flat[e - w : e - w + len(h)] = h
            fill[e - w + len(h) : e] = True
        for p, odd in enumerate(self.odd):
            least = flat * odd
            least[fill] = LAST
            least, size = np.minimum.reduceat(least, np.arange(0, len(least), small)), small
            for wanted, minima in self.classes:
                while size < wanted:
                    least, size = np.minimum(least[::2], least[1::2]), size * 2
                windows = np.minimum(least, np.r_[least[1:], LAST])
                last = ends // size - 1
                windows[last] = least[last]
                for w, items in minima[p].meet(windows):
                    found.setdefault(int(np.searchsorted(ends, w * size, "right")), set()).update(items)
        return found

    def shared(self, words: list[bytes], hashes: np.ndarray, item: int) -> float:
        """The share of the item's shingles that a text has, by their words: those of equal hashes are compared."""
        _, s, own = self.items[item]
        at = np.flatnonzero(s[np.minimum(np.searchsorted(s, hashes), len(s) - 1)] == hashes)
        if len(np.unique(hashes[at])) < self.needed(len(s)):
            return 0.0
        cut = lambda ws, k: tuple(ws[k : k + self.width])
        want = {cut(own, k) for k in range(max(1, len(own) - self.width + 1))}
        return len(want & {cut(words, k) for k in at.tolist()}) / len(want)

    def matches(self, texts: list[str | None]) -> list[list[tuple[object, float]]]:
        """For each whole text, (item_id, containment) of the items that it holds, in order of item_id."""
        words = [words_of(t) for t in texts]
        hashes = [shingle_hashes(w, self.width, self.seen) for w in words]
        out: list[list[tuple[object, float]]] = [[] for _ in texts]
        for t, items in self.candidates(hashes).items():
            for k in items if words[t] else ():
                share = self.shared(words[t], hashes[t], k)
                if share >= self.threshold:
                    out[t].append((self.items[k][0], share))
            out[t].sort()
        return out


def matched(id_type: str) -> str:
    return f"array<struct<item_id:{id_type},containment:double>>"


def contained_items(text: Column, index: Index, id_type: str = "bigint") -> Column:
    """array<struct<item_id, containment>> of a text column; null and empty texts hold nothing."""

    @F.pandas_udf(matched(id_type))
    def search(batch: pd.Series) -> pd.Series:
        texts, out = batch.tolist(), []
        for k in range(0, len(texts), TEXTS):
            out += [[{"item_id": i, "containment": c} for i, c in m] for m in index.matches(texts[k : k + TEXTS])]
        return pd.Series(out, dtype=object)

    return search(text)


def index_bytes(text: Column, permutations: int) -> Column:
    """More than an item takes in an index: its minima, a hash and a word for each shingle, and its text."""
    return 64 + 16 * permutations + 64 * (F.regexp_count(text, F.lit(r"\s+")) + 1) + 2 * F.octet_length(text)


def find_contained(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, width: int = 5, permutations: int = PERMUTATIONS, block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", out: str = "matches") -> DataFrame:
    """docs with `out`: array<struct<item_id, containment>> of the items that each whole text holds, containment being the
    share of the item's distinct shingles. A text or item of fewer than `width` words has one shingle, of all its words, so that
    such an item is only found as a whole text: as a passage it would be no evidence. One without words holds nothing and is held
    nowhere. Of repeated items each counts; null item_ids are left out; ids keep their type."""
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    id_type = items.schema["item_id"].dataType.simpleString()
    total = items.agg(F.sum(index_bytes(F.coalesce("text", F.lit("")), permutations))).first()[0] or 0
    blocks = math.ceil(total / block_bytes)
    if blocks <= 1:
        return docs.withColumn(out, contained_items(F.col(text_col), Index(held(items), threshold, width, permutations), id_type))
    # Slices by hash: a block is one slice of the items, and the driver has one index at a time.
    sliced = materialize(items.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items")
    rows = materialize(docs.withColumn("_sw_n", F.monotonically_increasing_id()), "searched")
    parts = []
    for k in range(blocks):
        index = Index(held(sliced.where(F.col("slice") == k).select("item_id", "text")), threshold, width, permutations)
        one = rows.select("_sw_n", contained_items(F.col(text_col), index, id_type).alias("m")).where(F.size("m") > 0)
        parts.append(materialize(one, "matches"))
        del index
    found = reduce(DataFrame.unionByName, parts).groupBy("_sw_n").agg(F.flatten(F.collect_list("m")).alias("m"))  # a row a block at most
    both = rows.join(found, "_sw_n", "left")
    return both.select(*docs.columns, F.sort_array(F.coalesce("m", F.array().cast(matched(id_type)))).alias(out))


def held(items: DataFrame) -> list[tuple[object, str | None]]:
    """A block's items, whose bytes find_contained() has bounded."""
    return [(r.item_id, r.text) for r in items.collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row for each row of docs: doc_id, n_items, item_ids (ascending), max_containment (0 if none), contaminated."""
    found = find_contained(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, **how)
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_items"),
        F.array_sort(F.transform("matches", lambda m: m["item_id"])).alias("item_ids"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("max_containment"),
        (F.size("matches") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that hold no item, with their own columns."""
    found = find_contained(docs, benchmark, text_col=text_col, out="_sw_matches", **how)
    return found.where(F.size("_sw_matches") == 0).select(*docs.columns)


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
