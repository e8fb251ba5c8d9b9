"""Random-indexing vectors against a plain count, the network on held-out labels, and the table contract."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteward.llm import quality_classifier as qc

SF = "/root/testdata/sf0.1"


def plain_vectors(texts):
    place, sign = qc.index_vectors()
    out = np.zeros((qc.BUCKETS, qc.DIMS))
    for t in texts:
        words = [zlib.crc32(w.lower().encode()) % qc.BUCKETS for w in qc.TOKEN.findall(t or "")]
        for i, w in enumerate(words):
            for v in words[max(0, i - qc.WINDOW) : i + qc.WINDOW + 1]:
                for p, s in zip(place[v], sign[v]):
                    out[w, p] += s
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def test_vectors_are_sums_of_contexts(spark):
    texts = ["One two, two; ONE!! three", "", None, "one", "### ### a1_b 2020 Ünï\n\nnew line", "two one two one"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = plain_vectors(texts)
    for parts in (1, 3):
        assert np.allclose(qc.word_vectors(df.repartition(parts)), want, atol=1e-6)
    assert not qc.word_vectors(df.limit(0)).any()


def test_pooling():
    vectors = np.random.default_rng(0).normal(size=(qc.BUCKETS, qc.DIMS)).astype(np.float32)
    texts = ["Word WORD word 12 mIx ##", None, "", "a a a b"]
    got = qc.features(texts, vectors)
    at = lambda w: vectors[zlib.crc32(w.encode()) % qc.BUCKETS]
    assert np.allclose(got[0, : qc.DIMS], (3 * at("word") + at("12") + at("mix") + at("##")) / 6, atol=1e-5)
    assert np.allclose(got[0, qc.DIMS : qc.DIMS + 6], [1 / 6] * 6)
    assert not got[1].any() and not got[2].any()
    assert got[3, -3:] == pytest.approx([2 / 4, 2 / 4, np.log(5)])


def test_temperature_is_what_sharpness_needs():
    rng = np.random.default_rng(3)
    true = rng.normal(0, 2, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-true))).astype(float)
    assert qc.temperature_of(true * 5, y) == pytest.approx(5, rel=0.1)
    assert qc.temperature_of(true / 2, y) == pytest.approx(0.5, rel=0.1)


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    df = qc.score_quality(docs, labels).join(labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id")
    rows = df.where("held_out").collect()
    good, bad = ([r for r in rows if r.quality == q] for q in (1, 0))
    assert len(good) > 500 and len(bad) > 80 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted for r in good) >= 0.99 * len(good)
    assert sum(r.predicted for r in bad) <= 0.05 * len(bad)
    assert abs(sum(r.score for r in rows) / len(rows) - len(good) / len(rows)) < 0.02


def test_labels_that_are_held_out_are_not_learned(spark):
    docs = spark.createDataFrame([(k, "good words here" if k % 2 else "### ### !!") for k in range(400)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    turned = labels.withColumn("quality", F.when(qc.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in qc.score_quality(docs, x).collect()} for x in (labels, turned))
    assert a == b
    assert all((s > 0.7) == bool(k % 2) for k, s in a.items())


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "text", "y"), (2, "text", None), (2, "text", None)], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = qc.score_quality(docs, none).collect()
    assert len(rows) == 5 and {r.score for r in rows} == {0.5} and not any(r.predicted for r in rows)
    one = spark.createDataFrame([(2, 1, 0), (2, None, 0), (9, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert all(r.score > 0.5 for r in qc.score_quality(docs, one).collect())
    assert qc.score_quality(docs.limit(0), one).count() == 0
