"""The study's inputs as the driver tables have them: people, sites, the hourly field, arrivals and roads.

Each is a projection, so that filters and columns reach the scan. The SQL beside each DataFrame is the oracle's CTE of the
same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The unhealthy level of the field, ug/m3, and the hours of the event.
UNHEALTHY = 55.5
START = "2024-01-01 00:00:00"
HOURS = 312
COUNTY = "click"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """person_id, lon, lat, band, speed_mps and four flags of each customer."""
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        k.alias("person_id"),
        (F.lit(-123.0) + (k * 7919 % 10007) / F.lit(10007.0)).alias("lon"),
        (F.lit(45.2) + (k * 104729 % 10009) / F.lit(20018.0)).alias("lat"),
        F.col("c_mktsegment").alias("band"),
        F.col("c_nationkey").alias("seed"),
        (F.lit(0.4) + (k * 31 % 181) / F.lit(100.0)).alias("speed_mps"),
        (k % 7 == 0).alias("mobility_limited"),
        (k % 11 < 2).alias("asthma"),
        (k % 13 == 5).alias("copd"),
        (k % 5 < 2).alias("chronic"),
        (F.lit(18) + k * 17 % 70).alias("age_years"),
    )


PEOPLE = """people AS (SELECT c_custkey AS person_id, -123.0::DOUBLE + (c_custkey * 7919 % 10007) / 10007.0::DOUBLE AS lon,
  45.2::DOUBLE + (c_custkey * 104729 % 10009) / 20018.0::DOUBLE AS lat, c_mktsegment AS band, c_nationkey AS seed, 0.4::DOUBLE + (c_custkey * 31 % 181) / 100.0::DOUBLE AS speed_mps,
  c_custkey % 7 = 0 AS mobility_limited, c_custkey % 11 < 2 AS asthma, c_custkey % 13 = 5 AS copd, c_custkey % 5 < 2 AS chronic, 18 + c_custkey * 17 % 70 AS age_years FROM customer)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, name, lon, lat, capacity (null: unlimited), operating, reserve, opened and closed hours of each supplier."""
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        k.alias("site_id"),
        F.col("s_name").alias("name"),
        (F.lit(-123.0) + (k * 6007 % 1009) / F.lit(1009.0)).alias("lon"),
        (F.lit(45.2) + (k * 3001 % 1013) / F.lit(2026.0)).alias("lat"),
        F.when(k % 41 != 0, F.lit(5) + k % 11).alias("capacity"),
        (k % 9 != 4).alias("operating"),
        F.when(k % 3 == 0, F.lit(24) * (k % 5)).alias("open_hour"),
        F.when(k % 4 == 1, F.lit(120) + k % 50).alias("close_hour"),
    )


SITES = """sites AS (SELECT s_suppkey AS site_id, s_name AS name, -123.0::DOUBLE + (s_suppkey * 6007 % 1009) / 1009.0::DOUBLE AS lon,
  45.2::DOUBLE + (s_suppkey * 3001 % 1013) / 2026.0::DOUBLE AS lat, CASE WHEN s_suppkey % 41 <> 0 THEN 5 + s_suppkey % 11 END AS capacity, s_suppkey % 9 <> 4 AS operating,
  CASE WHEN s_suppkey % 3 = 0 THEN 24 * (s_suppkey % 5) END AS open_hour, CASE WHEN s_suppkey % 4 = 1 THEN 120 + s_suppkey % 50 END AS close_hour FROM supplier)"""


def monitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """county, monitor_id, ts and concentration of each event."""
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("county"), F.col("user_id").alias("monitor_id"), "ts", F.col("value").alias("c"))


MONITORS = "monitors AS (SELECT event_type AS county, user_id AS monitor_id, ts, value AS c FROM events)"


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, person_id, tick, tie and priority of each line item."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("site_id"),
        F.col("l_orderkey").alias("person_id"),
        F.datediff("l_shipdate", F.lit("1992-01-01")).cast("long").alias("tick"),
        F.col("l_linenumber").alias("tie"),
        (F.col("l_returnflag") == "R").alias("priority"),
        F.col("l_partkey").alias("tie2"),
        F.col("l_extendedprice").alias("price"),
    )


ARRIVALS = """arrivals AS (SELECT l_suppkey AS site_id, l_orderkey AS person_id, datediff('day', DATE '1992-01-01', l_shipdate::DATE) AS tick, l_linenumber AS tie,
  l_returnflag = 'R' AS priority, l_partkey AS tie2, l_extendedprice AS price FROM lineitem)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order as a resident's outcome: run (arm, seed), state, distance, dose, arrival."""
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        k.alias("person_id"),
        F.substring("o_orderpriority", 1, 1).alias("arm"),
        (F.year("o_orderdate") - 1990).cast("long").alias("seed"),
        F.when(F.col("o_orderstatus") == "F", "SHELTERED").when(F.col("o_orderstatus") == "O", "REFUSED_ALL_FULL").otherwise("UNREACHABLE").alias("state"),
        (F.col("o_totalprice") / 10).alias("distance_m"),
        (F.col("o_totalprice") / 100 + k % 97).alias("dose_ug"),
        (k * 37 % 18720).alias("arrive_tick"),
        (k * 11 % 400).alias("depart_tick"),
        F.col("o_custkey").alias("start_id"),
        (k % 7 == 0).alias("mobility_limited"),
        (k % 11 < 2).alias("asthma"),
        (k % 13 == 5).alias("copd"),
        (k % 5 < 2).alias("chronic"),
        (F.lit(18) + k * 17 % 70).alias("age_years"),
    )


OUTCOMES = """outcomes AS (SELECT o_orderkey AS person_id, substr(o_orderpriority, 1, 1) AS arm, (year(o_orderdate) - 1990)::BIGINT AS seed,
  CASE o_orderstatus WHEN 'F' THEN 'SHELTERED' WHEN 'O' THEN 'REFUSED_ALL_FULL' ELSE 'UNREACHABLE' END AS state, o_totalprice / 10 AS distance_m, o_totalprice / 100 + o_orderkey % 97 AS dose_ug,
  o_orderkey * 37 % 18720 AS arrive_tick, o_orderkey * 11 % 400 AS depart_tick, o_custkey AS start_id, o_orderkey % 7 = 0 AS mobility_limited, o_orderkey % 11 < 2 AS asthma,
  o_orderkey % 13 = 5 AS copd, o_orderkey % 5 < 2 AS chronic, 18 + o_orderkey * 17 % 70 AS age_years FROM orders)"""


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected edges (a, b, length_m) between sites (even node ids) and parts (odd ones): the least price of a pair."""
    e = read(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b"))
    return e.agg(F.floor(F.min("l_extendedprice")).cast("long").alias("length_m"))


ROADS = "roads AS (SELECT l_suppkey * 2 AS a, l_partkey * 2 + 1 AS b, floor(min(l_extendedprice))::BIGINT AS length_m FROM lineitem GROUP BY ALL)"
