"""SimHash near-duplicates by a binary-trie self-join of the fingerprints.

Fingerprints are sorted as a binary trie. The join traverses pairs of its nodes together, adds up the bits in which the
two prefixes differ, and leaves a pair of nodes as soon as they differ in more bits than allowed. For the work to spread
over tasks, the bits are cut into `errors + free` blocks: of two fingerprints that link, at least `free` blocks are equal
(pigeonhole), so each choice of `free` blocks makes a trie that has these bits on top, and only nodes that are equal
there are joined. Each such top is a bucket of its own; `free` grows with the number of fingerprints, so that buckets
stay small. A bucket over `bucket_rows` is dealt out in pairs of slices instead. A task keeps only links that connect two
fingerprints which it has not connected yet, and leaves pairs of nodes that it knows to be connected, so that a large
group of copies costs about its size and not its square. Components of the links then give each fingerprint its class.

The pipeline's stage, keep_one_of_each, goes by the texts' sets of five-word shingles: two texts link if their Jaccard
similarity is 0.8 or more, counted exactly. Such texts often differ in 5 to 20 bits, where the trie would have to join about
all with all. Candidates are therefore the trie's links and the pairs that share one of SKETCH_BANDS hashes of SKETCH_ROWS MinHashes.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from siteward.llm.common import table
from siteward.llm.components import components
from siteward.session import discard, materialize

BITS = 64
#: Fingerprints that a bucket should have on average, and so the choice of `free`.
BUCKET = 4096
#: Texts with this similarity or more, as a fraction, are near-copies for keep_one_of_each.
SIMILAR = (4, 5)
#: A pair of similarity s shares no band with probability (1 - s**SKETCH_ROWS)**SKETCH_BANDS: 1.5e-5 at 0.8.
SKETCH_BANDS, SKETCH_ROWS = 28, 5
#: Parts of a set by hash: what two sets have in common is at most the sum of the lesser numbers of their parts.
PARTS = 64
#: Keys that may be broadcast because they are hot.
HOT_KEYS = 10_000


def _digests(text: str | None, width: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text, with repeats, in parts: words between ASCII white space with A-Z lower-cased, shingles
    of `width` words (fewer words: all of them)."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    first = [0, *(ends[:-1] + 1).tolist()]
    last = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(last), 65_536):
        yield np.array([digest(joined[s:e], seed) for s, e in zip(first[k : k + 65_536], last[k : k + 65_536])], dtype="<u8")


def _majority(parts: Iterable[np.ndarray]) -> int:
    """The signed 64-bit number whose bits are 1 if they are in over half of the digests."""
    counts, n = np.zeros(BITS, dtype=np.int64), 0
    for h in parts:
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def simhash(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The fingerprint of a text as a signed 64-bit number: a bit is 1 if it is in over half of the shingles' digests; without
    words 0."""
    return _majority(_digests(text, width, seed))


def shingle_set(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct digests of a text's shingles, ascending."""
    return np.unique(np.concatenate([np.array([], "<u8"), *_digests(text, width, seed)]))


def _set_name(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a whole set, so that equal sets are one node."""
    import xxhash

    return int(np.array([xxhash.xxh64_intdigest(shingles.tobytes(), 7)], "<u8").view("<i8")[0])


def _bands(shingles: np.ndarray) -> np.ndarray:
    """One signed hash for each band of the set's MinHashes; none for an empty set."""
    import xxhash

    if not len(shingles):
        return np.array([], "<i8")
    draw = np.random.Generator(np.random.PCG64(42)).integers(0, 2**64, (2, SKETCH_BANDS * SKETCH_ROWS, 1), dtype=np.uint64)
    least = np.full(SKETCH_BANDS * SKETCH_ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(shingles), 2048):
        least = np.minimum(least, ((shingles[None, k : k + 2048] ^ draw[0]) * (draw[1] | np.uint64(1))).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(SKETCH_BANDS, SKETCH_ROWS))], "<u8").view("<i8")


def fingerprint(text: Column, width: int = 4, seed: int = 42) -> Column:
    """simhash() of a text column; null and empty texts have fingerprint 0."""

    @F.pandas_udf("long")
    def of(batch: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, width, seed) for t in batch], dtype="int64")

    return of(text)


class Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.up[self.up], self.up):
            self.up = up
        return self.up

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def link(self, pairs: np.ndarray) -> list[tuple[int, int]]:
        """Those of the pairs that connect what was not connected."""
        roots = self.roots()
        new = []
        for a, b in pairs[roots[pairs[:, 0]] != roots[pairs[:, 1]]].tolist():
            x, y = self.find(a), self.find(b)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                new.append((a, b))
        return new


def trie_links(values: np.ndarray, tops: np.ndarray, sides: np.ndarray, top_bits: np.ndarray, errors: int, leaf: int = 32, frontier: int = 1 << 15) -> list[tuple[int, int]]:
    """Row numbers of links that connect all rows of a bucket that differ in `errors` bits or fewer.

    values: uint64, sorted inside each bucket; tops: the bucket of each row, ascending; top_bits: equal bits on top of each
    bucket. sides: 0 if a bucket is joined with itself, else 1 and 2 for its two sides, which are sorted one after the
    other and joined with each other."""
    forest, links = Forest(len(values)), []
    n = len(values)
    if not n:
        return []
    edge = np.flatnonzero(np.r_[True, (tops[1:] != tops[:-1]) | (sides[1:] != sides[:-1])])
    lo, hi = edge, np.r_[edge[1:], n]
    alone = sides[lo] == 0
    two = np.flatnonzero((sides[lo][:-1] == 1) & (sides[lo][1:] == 2) & (tops[lo][:-1] == tops[lo][1:])) if len(lo) > 1 else np.array([], int)
    start = np.concatenate([np.c_[lo, hi, lo, hi][alone], np.c_[lo[two], hi[two], lo[two + 1], hi[two + 1]]])
    depth = np.concatenate([top_bits[lo][alone], top_bits[lo[two]]])
    # Node pairs: rows [a, b) with [c, d), the next bit, and the bits that differ so far. The last are taken first.
    stack = [np.c_[start, depth, np.zeros(len(start), int)][k : k + frontier] for k in range(0, len(start), frontier)]
    while stack:
        now = stack.pop()
        size = (now[:, 1] - now[:, 0]) * (now[:, 3] - now[:, 2])
        if (big := size > leaf * leaf * 16).any():
            roots, at = forest.roots(), np.flatnonzero(big)
            one = np.array([(r := roots[a]) == roots[c] and (roots[a:b] == r).all() and (roots[c:d] == r).all() for a, b, c, d in now[at, :4]])
            if one.any():
                keep = np.ones(len(now), bool)
                keep[at[one]] = False
                now, size = now[keep], size[keep]
        done = (size <= leaf) | (now[:, 4] >= BITS)
        if done.any():
            links += forest.link(_near(values, now[done], size[done], errors))
            now = now[~done]
        if not len(now):
            continue
        a, b, c, d, bit, diff = now.T
        mid_ab, mid_cd = _middle(values, a, b, bit), _middle(values, c, d, bit)
        same = (a == c) & (b == d)
        kids = []
        for x, y, p, q, more, which in ((a, mid_ab, c, mid_cd, 0, None), (mid_ab, b, mid_cd, d, 0, None), (a, mid_ab, mid_cd, d, 1, None), (mid_ab, b, c, mid_cd, 1, ~same)):
            ok = (x < y) & (p < q) & (diff + more <= errors)
            if which is not None:
                ok &= which
            kids.append(np.c_[x, y, p, q, bit + 1, diff + more][ok])
        kids = np.concatenate(kids)
        stack += [kids[k : k + frontier] for k in range(0, len(kids), frontier)]
    return links


def _middle(values: np.ndarray, a: np.ndarray, b: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The first row of each node [a, b) whose next bit is 1, by bisection of all nodes at once."""
    lo, hi, shift = a.copy(), b.copy(), (BITS - 1 - bit).astype(np.uint64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        one = ((values[np.minimum(mid, len(values) - 1)] >> shift) & np.uint64(1)).astype(bool)
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def _near(values: np.ndarray, nodes: np.ndarray, size: np.ndarray, errors: int) -> np.ndarray:
    """Pairs of rows of small pairs of nodes that differ in few enough bits. Equal values may come from other slices."""
    k = np.repeat(np.arange(len(nodes)), size)
    at = np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size)
    width = (nodes[:, 3] - nodes[:, 2])[k]
    x, y = nodes[k, 0] + at // width, nodes[k, 2] + at % width
    ok = (np.bitwise_count(values[x] ^ values[y]) <= errors) & (x != y)
    return np.c_[x[ok], y[ok]]


def blocks(count: int) -> list[int]:
    """Lengths of `count` blocks of 64 bits, as equal as can be."""
    return [BITS // count + (k < BITS % count) for k in range(count)]


def permuted(fp: Column, chosen: tuple[int, ...], lengths: list[int]) -> Column:
    """fp with the chosen blocks on top, the others below in order."""
    first = list(itertools.accumulate(lengths, initial=0))
    out, used = F.lit(0).cast("long"), 0
    for k in [*chosen, *(j for j in range(len(lengths)) if j not in chosen)]:
        part = F.shiftrightunsigned(F.shiftleft(fp, first[k]), BITS - lengths[k])
        used += lengths[k]
        out = out.bitwiseOR(F.shiftleft(part, BITS - used))
    return out


def near_links(prints: DataFrame, errors: int = 4, count: int | None = None, bucket_rows: int = 200_000) -> DataFrame:
    """Links (u, v) between the distinct long fingerprints `fp` that connect all pairs of `errors` bits or fewer."""
    spark = prints.sparkSession
    n = prints.count() if count is None else count
    free = 1
    while free < 4 and n / 2 ** (BITS * free // (errors + free)) > BUCKET:
        free += 1
    lengths = blocks(errors + free)
    choices = list(itertools.combinations(range(errors + free), free))
    tops = [sum(lengths[k] for k in c) for c in choices]
    rows = prints.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("trie"), F.lit(tops[k]).alias("bits"), permuted(F.col("fp"), c, lengths).alias("value")) for k, c in enumerate(choices)))).alias("t"))
    rows = rows.select("fp", "t.*").withColumn("top", F.expr(f"shiftrightunsigned(value, {BITS} - bits)"))
    # Buckets over the bound, which are few: each has at least bucket_rows of the rows.
    hot = rows.groupBy("trie", "top").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows)
    hot = hot.select("trie", "top", F.ceil(2 * F.col("n") / bucket_rows).cast("int").alias("slices"))
    hot = materialize(hot, "hot-buckets")
    rows = rows.join(F.broadcast(hot) if hot.count() <= HOT_KEYS else hot, ["trie", "top"], "left")
    # Slice i of a hot bucket goes to each pair (i, j): on side 1 if it is the lesser, on side 2 if the greater, 0 if alone.
    own = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    other = F.explode(F.when(F.col("slices").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("slices") - 1)))
    rows = rows.withColumn("own", F.coalesce(own, F.lit(-1))).withColumn("other", other)
    rows = rows.select("fp", "trie", "bits", "value", "top", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") < F.col("other"), 1).when(F.col("own") > F.col("other"), 2).otherwise(0).alias("side"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * len(choices) // 2_000_000)
    keyed = rows.withColumn("key", F.xxhash64("trie", "top", "i", "j")).select("fp", "bits", "value", "key", "side")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        t = {c: np.concatenate([b[c].to_numpy() for b in held]) for c in ("fp", "bits", "value", "key", "side")}
        value = t["value"].view(np.uint64)
        order = np.lexsort((value, t["side"], t["key"]))
        side = t["side"][order].copy()
        pairs = trie_links(value[order], t["key"][order], side, t["bits"][order].astype(np.int64), errors)
        if pairs:
            p, fp = np.array(pairs), t["fp"][order]
            yield pd.DataFrame({"u": fp[p[:, 0]], "v": fp[p[:, 1]]})

    return keyed.repartition(parts, "key").mapInPandas(join, "u long, v long")


def near_classes(docs: DataFrame, id_col: str, text_col: str, errors: int = 4, width: int = 4, seed: int = 42, bucket_rows: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows has each row's id as doc_id and its fingerprint fp; classes has, for each distinct fp, the
    least doc_id of its class, and n, its rows. Null doc_ids count only where a class has no other."""
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), width, seed).alias("fp")), "fingerprints")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "prints")
    links = near_links(prints.select("fp"), errors, None, bucket_rows)
    roots = components(links)
    classes = prints.join(roots, prints.fp == roots.node, "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows, classes.join(least, "root").select("fp", "n", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", errors: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hexadecimal digits), component_id. Null, empty and word-less
    texts have fingerprint zero and link like others; equal rows stay apart; an empty table gives an empty one. The classes of
    fingerprints with so many rows that there are HOT_KEYS of them at most are broadcast to the rows, the others joined by shuffle."""
    rows, classes = near_classes(docs, id_col, text_col, errors, width, seed)
    classes = materialize(classes, "classes")
    most = max(HOT_KEYS, (classes.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    hot = F.broadcast(classes.where(F.col("n") > most).select("fp", "component_id"))
    rest = rows.join(hot.select("fp"), "fp", "left_anti").join(classes.where(F.col("n") <= most).select("fp", "component_id"), "fp")
    out = rest.select("doc_id", "fp", "component_id").unionByName(rows.join(hot, "fp").select("doc_id", "fp", "component_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def sketch(text: Column, width: int = 5, seed: int = 42) -> Column:
    """A text's fingerprint fp, the hash of its shingle set as node, the set's size, and its bands."""

    @F.pandas_udf("fp long, node long, size int, bands array<long>")
    def of(batch: pd.Series) -> pd.DataFrame:
        rows = []
        for t in batch:
            parts = list(_digests(t, width, seed))
            shingles = np.unique(np.concatenate([np.array([], "<u8"), *parts]))
            rows.append((_majority(parts), _set_name(shingles), len(shingles), _bands(shingles)))
        return pd.DataFrame(rows, columns=["fp", "node", "size", "bands"])

    return of(text)


def shingles_of(text: Column, width: int = 5, seed: int = 42) -> Column:
    """shingle_set() of a text column."""

    @F.pandas_udf("array<long>")
    def of(batch: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, width, seed).view("<i8") for t in batch], dtype=object)

    return of(text)


def similar_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (u, v) of nodes whose sets, (node, shingles), have SIMILAR or more of their union in common."""
    num, den = SIMILAR
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("su")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv")), "v")
    common = F.size(F.array_intersect("su", "sv"))
    return both.where((num + den) * common >= num * (F.size("su") + F.size("sv"))).select("u", "v")


def _sizes_near(a: str, b: str) -> Column:
    """Sets whose sizes differ by more cannot be similar enough."""
    num, den = SIMILAR
    return F.least(a, b) * den >= F.greatest(a, b) * num


def live_parts(sets: DataFrame) -> DataFrame:
    """(node, live): for sets (node, shingles), how many of a set's shingles in each part another of the sets has as well. What no
    other has is found by counting, so that no shingle's sets meet."""
    each = sets.select("node", F.explode("shingles").alias("shingle"))
    alone = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1")
    own = alone.groupBy("node").agg(F.collect_list("shingle").alias("own"))  # a set's own shingles at most

    @F.pandas_udf("array<int>")
    def parts(batch: pd.Series) -> pd.Series:
        return pd.Series([np.bincount(np.asarray(x, dtype=np.int64).view(np.uint64) % np.uint64(PARTS), minlength=PARTS).astype(np.int32) for x in batch], dtype=object)

    shared = F.when(F.col("own").isNull(), F.col("shingles")).otherwise(F.array_except("shingles", "own"))
    return sets.join(own, "node", "left").select("node", parts(shared).alias("live"))


def may_be_similar(size: str, other_size: str, live: str, other_live: str) -> Column:
    """Whether the parts of two sets leave room for enough in common."""
    num, den = SIMILAR
    common = F.aggregate(F.zip_with(live, other_live, lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)
    return (num + den) * common >= num * (F.col(size) + F.col(other_size))


def similar_classes(texts_of: Callable[[DataFrame], DataFrame], nodes: DataFrame, errors: int, width: int) -> DataFrame:
    """(node, root) for the nodes with a near-copy: components of all candidates that are similar by exact count.

    nodes: node, fp, size, bands; texts_of gives (node, text) of a table of some nodes, perhaps more than once. Two rounds check each bucket's sets against one centre only, which
    joins up a large group of near-copies at the cost of its size; then all pairs that share a bucket, are in different
    components by then, and may be similar by the parts of their sets are checked, so that no candidate is left out that could
    still join two components. The bound on pairs is a condition of the join: what it rules out is never a row."""
    alone = nodes.groupBy("fp").agg(F.min("node").alias("rep"))
    near = near_links(alone.select("fp"), errors)
    trie = near.join(alone.select(F.col("fp").alias("u"), F.col("rep").alias("a")), "u").join(alone.select(F.col("fp").alias("v"), F.col("rep").alias("b")), "v").select("a", "b")
    trie = materialize(trie.union(nodes.join(alone, "fp").where("node != rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))), "trie")
    keyed = nodes.select("node", "size", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    buckets = materialize(keyed.join(shared, "key"), "buckets")
    wanted = buckets.select("node").union(trie.select("a")).union(trie.select("b")).distinct()
    sets = texts_of(wanted).select("node", shingles_of(F.col("text"), width).alias("shingles"))
    sets = materialize(sets.dropDuplicates(["node"]), "sets")
    roots, links = None, None
    for step in range(3):
        now = buckets.withColumn("root", F.col("node")) if roots is None else buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        if step < 2:
            centre = now.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "node", F.lit(step)).alias("h"), "node", "size", "root")).alias("c"))
            found = now.join(centre, "key").select("node", "size", "root", F.col("c.node").alias("other"), F.col("c.size").alias("other_size"), F.col("c.root").alias("other_root"))
            found = found.where("root != other_root").where(_sizes_near("size", "other_size"))
        else:
            # Only buckets that more than one component meets in, and only sets of which enough is not theirs alone.
            mixed = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
            now = materialize(now.join(mixed, "key"), "mixed")
            live = live_parts(sets.join(now.select("node").distinct(), "node"))
            now = now.join(live, "node").where(may_be_similar("size", "size", "live", "live"))
            now = materialize(now, "mixed-parts")
            other = now.select("key", F.col("node").alias("other"), F.col("size").alias("other_size"), F.col("root").alias("other_root"), F.col("live").alias("other_live"))
            room = (F.col("root") < F.col("other_root")) & _sizes_near("size", "other_size") & may_be_similar("size", "other_size", "live", "other_live")
            found = now.withColumnRenamed("key", "k").join(other, (F.col("k") == F.col("key")) & room)
        pairs = found.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v"))
        if step == 0:
            pairs = pairs.union(trie.select(F.least("a", "b"), F.greatest("a", "b")))
        new = materialize(similar_links(pairs.distinct(), sets), "similar")
        links = new if links is None else links.union(new)
        roots = components(links)
    return roots


def row_keys(df: DataFrame) -> list[Column]:
    """Two hashes over all columns, which tell unequal rows apart; maps are taken as their sorted entries."""
    cols = [F.sort_array(F.map_entries(f.name)) if isinstance(f.dataType, MapType) else F.col(f.name) for f in df.schema]
    return [F.xxhash64(*cols).alias("_sw_k1"), F.xxhash64(F.lit("_sw"), *cols).alias("_sw_k2")]


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", errors: int = 4, width: int = 5) -> DataFrame:
    """The rows of docs without near-copies, texts whose sets of `width`-word shingles have a Jaccard similarity of 0.8 or more,
    directly or over others: of each class the row of least doc_id stays (null last); of several with that id, the one whose
    columns have the least hash; of equal rows, one. Texts without words are copies of each other.

    Rows are known by hashes of all their columns; whole texts are only moved to be joined with the keys of those that stay, and to
    make the sets of those that share a bucket."""
    cols, keys = docs.columns, ["_sw_k1", "_sw_k2"]
    marked = docs.select("*", *row_keys(docs))
    prints = marked.select(F.col(id_col).alias("doc_id"), *keys, sketch(F.col(text_col), width).alias("s"))
    prints = materialize(prints.select("doc_id", *keys, "s.*"), "sketches")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *keys)).alias("least")
    distinct = materialize(prints.groupBy("node").agg(F.min("fp").alias("fp"), F.max("size").alias("size"), F.max("bands").alias("bands"), least), "distinct")
    discard(prints)

    def texts_of(some: DataFrame) -> DataFrame:
        of = some.join(distinct, "node").select("node", *(F.col(f"least.{k}").alias(k) for k in keys))
        return marked.select(*keys, F.col(text_col).alias("text")).join(of, keys).select("node", "text")

    roots = similar_classes(texts_of, distinct, errors, width)
    classes = distinct.join(roots, "node", "left").select("least", F.coalesce("root", "node").alias("root"))
    stay = classes.groupBy("root").agg(F.min("least").alias("least")).select(*(F.col(f"least.{k}").alias(k) for k in keys))
    # The join has sorted the rows by their keys, so that equal rows lie together.
    kept = marked.join(materialize(stay, "stay"), keys)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    return kept.withColumn("_sw_first", first).where("_sw_first = 1").select(*cols)


def op6_simhash_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
