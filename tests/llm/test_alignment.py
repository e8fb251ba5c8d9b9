"""Galloping alignment against the owners of each byte, and its table contract."""

import bisect
import hashlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siteward.llm import token_alignment as ta
from siteward.llm.common import tokenizer_path

PAIR = ta.Pair(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), tokenizer_path("byte_bpe_50k.tiktoken"))
ODD = [None, "", " ", "\n", "a", "▁", "a▁b", "<|endoftext|> is text", "<s> too </s><0x41>", "naïve café 日本語 　 x", "👩‍👩‍👧 emoji\x00nul", "a" * 3000, "Same text again", "Same text again", "ab " * 400]


@given(st.sets(st.integers(0, 400)), st.sets(st.integers(0, 400)))
@settings(max_examples=200, deadline=None)
def test_gallop_counts_what_is_less(short, long):
    a, b = np.array(sorted(short), np.int64), np.array(sorted(long), np.int64)
    assert ta.gallop(a, b).tolist() == np.searchsorted(b, a).tolist()


def test_gallop_over_lanes_of_lanes():
    rng = np.random.default_rng(1)
    for n, m in ((1, 5000), (5000, 1), (17, 16), (4000, 9000)):
        a, b = (np.unique(rng.integers(0, 30_000, k)) for k in (n, m))
        assert (ta.gallop(a, b) == np.searchsorted(b, a)).all()


def brute(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, sha256) of each text, by the owners of each byte."""
    t = ta.load_pair(PAIR)
    rows = []
    for text in texts:
        a = t.library.encode(" " + (text or ""), add_special_tokens=False).ids
        b = t.pieces.encode(text or "")
        whole = (" " + (text or "")).encode()
        if not text or b"".join(t.a_bytes[i] for i in a) != whole or b"".join(t.b_bytes[i] for i in b) != whole:
            a, b = [], []
        owners = [[k for k, i in enumerate(ids) for _ in of[i]] for ids, of in ((a, t.a_bytes), (b, t.b_bytes))]
        links = [(a[i], b[j]) for i, j in sorted(set(zip(*owners)))]
        ends = [np.cumsum([len(of[i]) for i in ids]).tolist() for ids, of in ((a, t.a_bytes), (b, t.b_bytes))]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        sides = [[[] for _ in cuts] for _ in range(2)]
        for side, ids, e in zip(sides, (a, b), ends):
            for i, x in zip(ids, e):
                side[bisect.bisect_left(cuts, x)].append(str(i))
        written = ";".join(",".join(x) + "|" + ",".join(y) for x, y in zip(*sides))
        rows.append((len(a), len(b), len(cuts), links, hashlib.sha256(written.encode()).hexdigest() if a else ""))
    count = Counter(x for r in rows for x in r[3])
    most = {}
    for (_, j), n in count.items():
        most[j] = max(n, most.get(j, 0))
    return [(a, b, g, len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), sha) for a, b, g, x, sha in rows]


def test_rows_against_the_owners_of_bytes(spark, monkeypatch):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = ODD + docs[:150]
    df = spark.createDataFrame([(k, x, "id", 7) for k, x in enumerate(texts)], "doc_id long, text string, part string, id int").repartition(3)
    for chars in (ta.PART_CHARS, 5000):  # many parts, too
        monkeypatch.setattr(ta, "PART_CHARS", chars)
        from siteward.session import materialize

        rest = materialize(ta.aligned(df, PAIR, ids=False), "aligned")
        got = {r.id: tuple(r)[1:4] + (r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in ta.with_link_counts(rest, PAIR).collect()}
        assert [got[k] for k in range(len(texts))] == brute(texts)


def test_ids_and_cuts_are_the_groups(spark):
    df = spark.createDataFrame([(1, "Overlapping tokens, here"), (2, None)], "doc_id long, text string")
    rows = {r.id: r for r in ta.aligned(df, PAIR).collect()}
    t = ta.load_pair(PAIR)
    r = rows[1]
    assert b"".join(t.a_bytes[i] for i in r.a_ids) == b"".join(t.b_bytes[i] for i in r.b_ids) == b" Overlapping tokens, here"
    assert r.a_cuts[-1] == r.n_a and r.b_cuts[-1] == r.n_b and r.n_groups == len(r.a_cuts) == len(r.b_cuts)
    for i, j in zip(r.a_cuts, r.b_cuts):
        assert sum(len(t.a_bytes[x]) for x in r.a_ids[:i]) == sum(len(t.b_bytes[x]) for x in r.b_ids[:j])
    assert rows[2].a_ids == [] and rows[2].groups_sha256 == ""


def test_an_empty_table(spark):
    from siteward.session import materialize

    none = materialize(ta.aligned(spark.createDataFrame([], "doc_id long, text string"), PAIR, ids=False), "aligned")
    assert ta.with_link_counts(none, PAIR).count() == 0


def test_the_query(spark):
    from siteward.llm.registry import QUERIES

    df = QUERIES["op11_token_alignment"](spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    total = df.agg(F.sum("n_a"), F.sum("n_b"), F.sum("n_groups"), F.sum("n_links")).first()
    assert total[3] == total[0] + total[1] - total[2]
