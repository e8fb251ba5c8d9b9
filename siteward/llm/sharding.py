"""Sharding by weighted rendezvous hashing of stable record keys.

Each shard s draws u in (0, 1) for a key from a hash of both; the shard with the largest weight / -ln(u) takes the row. A
new shard can only win rows for itself, and no other row moves. Everything is a projection; numbering the rows of a shard
without gaps takes counts by (shard, bucket), whose sums give each bucket its first slot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteward.llm.common import table
from siteward.session import materialize

#: 2 ** 53, the number of distinct draws.
DRAWS = 9007199254740992.0


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard, 0 to len(weights) - 1, of a key (its string form; null is a key of its own). Weights over 0."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be over 0, one for each shard")
    text = F.coalesce(key.cast("string"), F.lit("\x00null"))

    def score(s: int) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(text, F.lit(f"shard-{s}")), 11).cast("double") + 0.5) / DRAWS
        return -F.lit(float(weights[s])) / F.log(u)

    return F.greatest(*(F.struct(score(s).alias("score"), F.lit(s).alias("shard")) for s in range(len(weights)))).getField("shard") if len(weights) > 1 else F.lit(0)


def number_gapless(rows: DataFrame, group: str, order: Sequence[str], out: str = "slot", buckets: int = 1024) -> DataFrame:
    """rows with a number from 0 without gaps in each group. No task gets a whole group: rows that agree in all columns
    become one with a count, buckets of a hash are numbered apart and begin where the smaller ones end, and a count is
    spread out again in steps of 65,536. Order inside a bucket: by `order`, then all columns."""
    cols = rows.columns
    counted = materialize(rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")), "slots")
    sizes = counted.groupBy(group, "_b").agg(F.sum("_n").alias("_size"))
    first = sizes.select(group, "_b", (F.sum("_size").over(Window.partitionBy(group).orderBy("_b")) - F.col("_size")).alias("_first"))  # buckets rows a group at most
    by = Window.partitionBy(group, "_b").orderBy(*order, *cols).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_at", F.coalesce(F.sum("_n").over(by), F.lit(0)))
    f = first.select(F.col(group).alias("_g"), F.col("_b").alias("_fb"), "_first")
    placed = placed.join(F.broadcast(f) if buckets <= 4096 else f, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_fb")))
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(65_536).cast("long")))
    spread = placed.withColumn("_step", step).withColumn("_k", F.explode(F.sequence("_step", F.least(F.col("_step") + 65_535, F.col("_n") - 1))))
    return spread.select(*cols, (F.col("_first") + F.col("_at") + F.col("_k")).cast("long").alias(out))


def shard_rows(docs: DataFrame, weights: Sequence[float], grown: Sequence[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1; null text: 1), text_crc32 (null: that of no bytes, 0), law, shard, slot, grown_shard
    (the shard under the weights `grown`). The law is `key`: the key and the weights decide, not the text, so rows of one
    doc_id go together; null doc_ids share a shard. Rows equal in doc_id and text get slots of their own."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous_shard(F.col(id_col), weights).alias("shard"),
        rendezvous_shard(F.col(id_col), grown).alias("grown_shard"),
    )
    return number_gapless(rows, "shard", ["doc_id"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), [1.0] * 16, [1.0] * 17)
