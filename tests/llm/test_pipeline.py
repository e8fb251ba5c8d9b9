import random

import pytest

from siteward.llm import simhash as sh

DIR = "/root/testdata/sf0.001"


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x0b", " ").encode().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_kept(docs):
    """Least ids of the classes of all pairs with Jaccard similarity 0.8 or more."""
    sets = {d: shingles(t) for d, t in docs}
    ids = sorted(sets)
    up = {d: d for d in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {d for d in ids if find(d) == d}


def edited(rng, words, n):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"edit{rng.randrange(10**9)}"
    return words


def test_near_duplicates_stage_against_brute_force(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(5)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    at = max(d for d, _ in docs) + 1
    apart = 0
    for n in (40, 120, 300):
        for edits in (1, 2, 3, 4, 5, 6, 8, 10):
            base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            other = edited(rng, base, edits)
            docs += [(at, " ".join(base)), (at + 1, " ".join(other))]
            x, y = shingles(docs[-2][1]), shingles(docs[-1][1])
            if 5 * len(x & y) >= 4 * len(x | y):
                apart += ((sh.simhash(docs[-2][1]) ^ sh.simhash(docs[-1][1])) & (2**64 - 1)).bit_count() > 4
            at += 2
    # Chains: each text is like the one before, the ends are not alike.
    words = [f"c{k}" for k in range(200)]
    for _ in range(12):
        docs.append((at, " ".join(words)))
        words, at = edited(rng, words, 3), at + 1
    # Equal bits from unlike texts of few words must not link.
    docs += [(at, "a b"), (at + 1, "a b c"), (at + 2, "A  b"), (at + 3, None), (at + 4, " ")]
    assert apart >= 5
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [r.doc_id for r in dict(pipeline.STAGES)["near-duplicates"](spark, df, DIR).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_kept(docs)
    assert len(got) < len(docs)


def test_unlike_texts_with_equal_fingerprints_stay(spark, monkeypatch):
    monkeypatch.setattr(sh, "near_links", lambda prints, errors=4, *a, **k: prints.sparkSession.createDataFrame([(u, v) for u in fps for v in fps if u < v], "u long, v long"))
    texts = [" ".join(f"{c}{k}" for k in range(50)) for c in "abc"]
    fps = [sh.simhash(t, 5) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in sh.keep_one_of_each(df).collect()) == [0, 1, 2]
