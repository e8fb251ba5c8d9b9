import numpy as np
import pytest
from pyspark.sql import functions as F

from siteward.llm import simhash as sh


def brute(prints, errors):
    """Least-reachable classes of all pairs."""
    prints = sorted(set(prints))
    up = {p: p for p in prints}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= errors:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


def made_up(n, seed):
    r = np.random.default_rng(seed)
    centres = r.integers(-(2**63), 2**63, n // 6, dtype=np.int64)
    out = []
    for k in range(n):
        x = int(centres[k % len(centres)]) if k % 3 else int(r.integers(-(2**63), 2**63))
        for b in r.integers(0, 64, r.integers(0, 5)):
            x ^= 1 << int(b)
        out.append((x + 2**63) % 2**64 - 2**63)
    return out + [0, -1, 1, -(2**63)]


@pytest.mark.parametrize("bucket_rows", [200_000, 40])
def test_trie_join_links_what_all_pairs_link(spark, bucket_rows):
    prints = made_up(400, 1)
    want = brute(prints, 4)
    df = spark.createDataFrame([(p,) for p in set(prints)], "fp long")
    links = sh.near_links(df, 4, bucket_rows=bucket_rows)
    got = brute_components(set(prints), [tuple(r) for r in links.collect()])
    assert got == want


@pytest.mark.parametrize("free", [2, 3])
def test_more_free_blocks(spark, monkeypatch, free):
    prints = made_up(300, 2)
    monkeypatch.setattr(sh, "BUCKET", {2: 300 / 2**15, 3: 300 / 2**23}[free])
    df = spark.createDataFrame([(p,) for p in set(prints)], "fp long")
    got = brute_components(set(prints), [tuple(r) for r in sh.near_links(df, 4).collect()])
    assert got == brute(prints, 4)


def test_dense_group(spark):
    prints = {x for a in range(40) for b in range(40) if (x := (1 << a) ^ (1 << b)) < 2**63}
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    links = sh.near_links(df, 4).collect()
    assert len(set(brute_components(prints, [tuple(r) for r in links]).values())) == 1
    assert len(links) < 5 * len(prints)


def brute_components(nodes, links):
    up = {p: p for p in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {p: find(p) for p in nodes}


def naive_simhash(text):
    import xxhash

    words = [w for w in __import__("re").findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", "  \t\n", "one", "One two", "a b c d", "a b c d e É Ü ß x", "A\x0bB\x0cC\x85D\xa0E f g h", "w " * 5000 + "end"])
def test_fingerprint_by_definition(text):
    assert sh.simhash(text) % 2**64 == naive_simhash(text)


def test_rows_null_empty_ties_repeats_and_clashing_names(spark):
    long = " ".join(f"w{k}" for k in range(300))
    rows = [(5, long, 9), (3, long + " tail", 9), (3, long + " tail", 9), (8, None, 1), (7, "", 1), (None, "quite another text here", 1), (9, "   ", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int").withColumn("component_id", F.lit("x"))
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in sh.near_duplicates(df).collect()), key=str)
    assert len(got) == 7
    by = {g[0]: g for g in got}
    assert by[5][2] == by[3][2] == 3
    assert by[8][1] == by[7][1] == by[9][1] == "0" * 16 and by[8][2] == 7
    assert by[None][2] is None
    kept = sh.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 7, None]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sh.near_duplicates(df).count() == 0 and sh.keep_one_of_each(df).count() == 0


def test_whole_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    prints = {r.doc_id: sh.simhash(r.text) for r in docs}
    roots = brute(prints.values(), 4)
    least = {}
    for d, p in prints.items():
        least[roots[p]] = min(d, least.get(roots[p], d))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in sh.op6_simhash_neardup(spark, sf).collect()}
    assert got == {d: (f"{p % 2**64:016x}", least[roots[p]]) for d, p in prints.items()}
