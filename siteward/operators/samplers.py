"""Samplers of people: each draw hangs on (seed, stream, person, attempt) only, whatever the order or partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteward.catalog import query
from siteward.operators.relations import _uniform_sql, uniform
from siteward.operators.stand_ins import read

# Comfortable speeds in m/s by decade from 20-29 to 80 and over; spread, impaired walkers, COPD, and the guard.
MEN = (1.358, 1.433, 1.434, 1.433, 1.339, 1.262, 0.968)
WOMEN = (1.341, 1.337, 1.390, 1.313, 1.241, 1.132, 0.943)
SPREAD, COPD_SLOWER = 0.13, 0.19
IMPAIRED_MEAN, IMPAIRED_SD = 0.95, 0.32
SLOWEST, FASTEST = 0.40, 2.20
TRIES = 100


def normal(seed: int, stream: str, key: Column, attempt: Column) -> Column:
    """A standard normal draw by the polar angle and radius of two uniform ones."""
    u, v = uniform(seed, f"{stream}-r", key, attempt), uniform(seed, f"{stream}-a", key, attempt)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def _normal_sql(seed: int, stream: str, key: str, attempt: str) -> str:
    both = f"{key} || '|' || {attempt}"
    return f"sqrt(-2 * ln(1 - {_uniform_sql(seed, f'{stream}-r', f'({both})')})) * cos({2 * math.pi!r}::DOUBLE * {_uniform_sql(seed, f'{stream}-a', f'({both})')})"


def truncated_normal(seed: int, stream: str, key: Column, mean: Column, sd: Column) -> Column:
    """The first of TRIES draws between SLOWEST and FASTEST, or else the mean, clamped. Later draws are only made where the first
    fails."""
    draw = lambda k: mean + sd * normal(seed, stream, key, k)
    ok = lambda v: (v >= SLOWEST) & (v <= FASTEST)
    later = F.get(F.filter(F.transform(F.sequence(F.lit(1), F.lit(TRIES - 1)), draw), ok), F.lit(0))
    return F.when(ok(draw(F.lit(0))), draw(F.lit(0))).otherwise(F.coalesce(later, F.greatest(F.lit(SLOWEST), F.least(F.lit(FASTEST), mean))))


def _truncated_sql(seed: int, stream: str, key: str, mean: str, sd: str) -> str:
    return f"coalesce(list_filter(list_transform(range({TRIES}), lambda k: {mean} + {sd} * {_normal_sql(seed, stream, key, 'k')}), lambda v: v >= {SLOWEST}::DOUBLE AND v <= {FASTEST}::DOUBLE)[1], greatest({SLOWEST}::DOUBLE, least({FASTEST}::DOUBLE, {mean})))"


def speed_mean(age: Column, sex: Column, copd: Column) -> Column:
    """The mean of a decade and sex; of others, that of both; less with COPD, SLOWEST at least."""
    row = F.greatest(F.lit(0), F.least(F.lit(6), F.floor(age / 10) - 2)).cast("int")
    men, women = (F.get(F.array(*map(F.lit, t)), row) for t in (MEN, WOMEN))
    mean = F.when(sex == "M", men).when(sex == "F", women).otherwise((men + women) / 2)
    return F.when(copd, F.greatest(F.lit(SLOWEST), mean - COPD_SLOWER)).otherwise(mean)


_WHO = "who AS (SELECT c_custkey, 18 + c_custkey * 17 % 70 AS age, CASE c_custkey % 20 WHEN 0 THEN 'O' WHEN 1 THEN 'F' WHEN 2 THEN 'F' WHEN 3 THEN 'F' WHEN 4 THEN 'F' WHEN 5 THEN 'F' ELSE 'M' END AS sex, c_custkey % 13 = 5 AS copd, c_custkey % 7 = 0 AS impaired FROM customer)"
_ROW = "greatest(0, least(6, age // 10 - 2))"
_TABLE = lambda t: f"[{', '.join(f'{x}::DOUBLE' for x in t)}][{_ROW} + 1]"
_SEXED = f"CASE sex WHEN 'M' THEN {_TABLE(MEN)} WHEN 'F' THEN {_TABLE(WOMEN)} ELSE ({_TABLE(MEN)} + {_TABLE(WOMEN)}) / 2 END"
_MEAN = f"CASE WHEN copd THEN greatest({SLOWEST}::DOUBLE, {_SEXED} - {COPD_SLOWER}::DOUBLE) ELSE {_SEXED} END"


def _who(spark, sf_dir):
    k = F.col("c_custkey")
    sex = F.when(k % 20 == 0, "O").when(k % 20 <= 5, "F").otherwise("M")
    return read(spark, sf_dir, "customer").select("c_custkey", (18 + k * 17 % 70).alias("age"), sex.alias("sex"), (k % 13 == 5).alias("copd"), (k % 7 == 0).alias("impaired"))


@query("rnd_speed_mean", f"WITH {_WHO} SELECT c_custkey, round(CASE WHEN impaired THEN {IMPAIRED_MEAN}::DOUBLE ELSE {_MEAN} END, 6) AS mean_mps FROM who")
def rnd_speed_mean(spark, sf_dir):
    """The mean speed by age, sex and COPD; that of impaired walkers replaces it."""
    mean = F.when(F.col("impaired"), F.lit(IMPAIRED_MEAN)).otherwise(speed_mean(F.col("age"), F.col("sex"), F.col("copd")))
    return _who(spark, sf_dir).select("c_custkey", F.round(mean, 6).alias("mean_mps"))


@query("rnd_trunc_normal", f"WITH {_WHO}, m AS (SELECT c_custkey, CASE WHEN impaired THEN {IMPAIRED_MEAN}::DOUBLE ELSE {_MEAN} END AS m, CASE WHEN impaired THEN {IMPAIRED_SD}::DOUBLE ELSE {SPREAD}::DOUBLE * ({_MEAN}) END AS sd FROM who) SELECT c_custkey, round({_truncated_sql(42, 'speed', 'c_custkey', 'm', 'sd')}, 6) AS speed_mps FROM m")
def rnd_trunc_normal(spark, sf_dir):
    """Walking speeds, drawn anew until they are believable."""
    mean = F.when(F.col("impaired"), F.lit(IMPAIRED_MEAN)).otherwise(speed_mean(F.col("age"), F.col("sex"), F.col("copd")))
    w = _who(spark, sf_dir).withColumn("m", mean).withColumn("sd", F.when(F.col("impaired"), F.lit(IMPAIRED_SD)).otherwise(SPREAD * F.col("m")))
    return w.select("c_custkey", F.round(truncated_normal(42, "speed", F.col("c_custkey"), F.col("m"), F.col("sd")), 6).alias("speed_mps"))


@query("rnd_streams", f"WITH u AS (SELECT {_uniform_sql(42, 'attributes', 'c_custkey')} AS a, {_uniform_sql(42, 'decisions', 'c_custkey')} AS b, {_uniform_sql(43, 'attributes', 'c_custkey')} AS c, {_uniform_sql(42, 'attributes', 'c_custkey')} AS again FROM customer) SELECT count(*) AS n, count(*) FILTER (a = again) AS same, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, count(*) FILTER (a = b OR a = c) AS shared, round(corr(a, b), 6) AS r_streams, round(corr(a, c), 6) AS r_seeds FROM u")
def rnd_streams(spark, sf_dir):
    """Streams and seeds that have nothing to do with each other, and draws that come again."""
    k = F.col("c_custkey")
    u = read(spark, sf_dir, "customer").select(uniform(42, "attributes", k).alias("a"), uniform(42, "decisions", k).alias("b"), uniform(43, "attributes", k).alias("c"), uniform(42, "attributes", k).alias("again"))
    return u.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("again")).alias("same"), F.round(F.avg("a"), 6).alias("mean_a"), F.round(F.avg("b"), 6).alias("mean_b"), F.count_if((F.col("a") == F.col("b")) | (F.col("a") == F.col("c"))).alias("shared"), F.round(F.corr("a", "b"), 6).alias("r_streams"), F.round(F.corr("a", "c"), 6).alias("r_seeds"))
