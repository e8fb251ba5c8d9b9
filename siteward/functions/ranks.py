"""Running sums, ranks and quantiles without a group in one task.

Rows are dealt out by ranges of (group, order), so that a group of any size is as many tasks as it needs; what lies before
a range comes from a table of one sum for each group and range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteward.session import materialize


#: Up to this size by Spark's own estimate a group may be one task's; ranges would cost a sample, a write and a read for nothing.
SMALL_BYTES = 32 * 2**20


def with_groups(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """df joined with `other` by equal keys, null being equal to null; the keys of df stay."""
    renamed = other.select(*(F.col(c).alias(f"_k{k}") if c in keys else F.col(c) for k, c in enumerate(other.columns)))
    places = {c: f"_k{k}" for k, c in enumerate(other.columns) if c in keys}
    return df.join(renamed, [F.col(c).eqNullSafe(F.col(places[c])) for c in keys]).drop(*places.values())


def running(df: DataFrame, group: list[str], order: list[str], amount: str, name: str = "below", parts: int | None = None) -> DataFrame:
    """df with `name`: the sum of the long `amount` over the rows of the same group (null is one, too) that come before this one by
    `order`, which should tell a group's rows apart. Small tables are one window, others go over ranges; parts: always so many."""
    spark, zero = df.sparkSession, F.lit(0).cast("long")
    before_this = lambda *keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if parts is None and int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= SMALL_BYTES:
        return df.withColumn(name, F.coalesce(F.sum(amount).over(before_this(*group)), zero))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = materialize(df.repartitionByRange(parts, *group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = cut.groupBy(*group, "_range").agg(F.sum(amount).alias("_sum"))
    upto = F.sum("_sum").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    before = sums.select(*group, "_range", F.coalesce(upto, zero).alias("_before"))  # a row for each group and range
    out = with_groups(cut.withColumn("_inside", F.coalesce(F.sum(amount).over(before_this("_range", *group)), zero)), before, [*group, "_range"])
    return out.withColumn(name, F.col("_inside") + F.col("_before")).select(*df.columns, name)


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "number") -> DataFrame:
    """df with `name`: 0, 1, 2 ... in each group by `order`."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), group, order, "_one", name).drop("_one")


def value_ranks(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, n, below): how often each value comes and how many rows of the group lie below it. Rows are counted by
    value, partly before the shuffle; running sums go over ranges of values."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    return running(counts, group, [value], "n")


def quantiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """A row for each group with the exact quantiles {column: share}, interpolated between neighbours. Nulls are skipped."""
    v = value_ranks(df.where(F.col(value).isNotNull()), group, value)
    total = v.groupBy(*group).agg((F.sum("n") - 1).alias("_last"))
    v = with_groups(v, total, group) if group else v.join(F.broadcast(total))
    picks = []
    for c, p in shares.items():
        for end, at in (("lo", F.floor(F.col("_last") * p)), ("hi", F.ceil(F.col("_last") * p))):
            picks.append(F.max(F.when((F.col("below") <= at) & (at < F.col("below") + F.col("n")), F.col(value))).alias(f"_{c}_{end}"))
    g = v.groupBy(*group).agg(F.max("_last").alias("_last"), *picks)
    between = lambda c, p: F.col(f"_{c}_lo") + (F.col(f"_{c}_hi") - F.col(f"_{c}_lo")) * (F.col("_last") * p - F.floor(F.col("_last") * p))
    return g.select(*group, *(between(c, p).alias(c) for c, p in shares.items()))
