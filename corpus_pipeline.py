"""A training corpus from documents: quality rules, toxicity, near-duplicates, decontamination, encoding.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and is the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteward.llm.common import table
from siteward.llm.decontamination import drop_contaminated
from siteward.llm.quality_rules import keep_good
from siteward.llm.sentencepiece_stream import encoded
from siteward.llm.simhash import keep_one_of_each
from siteward.llm.toxicity import keep_clean
from siteward.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs, width=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encoded(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]
#: SQL has no SimHash, no learned scores and no merges; tests/llm/test_pipeline.py holds the near-duplicates stage against brute
#: force, tests/llm/test_texts.py the columns and ids of all.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
