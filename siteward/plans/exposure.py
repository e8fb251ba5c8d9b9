"""Whole studies as one plan: exposure of each resident from departure and arrival, and siting of beds.

Exposure by prefix sums: a resident's total is the field's sum up to arrival, the part on the way that between departure
and arrival. Siting goes in rounds, each a distributed choice of the best site by demand not yet served.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteward.catalog import query
from siteward.functions.ranks import running
from siteward.operators.admission import haversine
from siteward.operators.field import HOURLY, field_of
from siteward.operators.stand_ins import COUNTY, OUTCOMES, outcomes, people, read, sites
from siteward.session import discard, materialize

# Cubic metres breathed an hour, walking and resting.
WALKING, RESTING = 1.62, 0.61


def exposures(who: DataFrame, field: DataFrame) -> DataFrame:
    """who (person_id, depart_hour, arrive_hour; null: not inside) with exposure, on_the_way, dose: sums of the field's hours
    before arrival (or all), of those from departure to arrival, and both by breathing rates."""
    upto = F.sum(F.coalesce("c", F.lit(0.0))).over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1))  # a row an hour
    ends = field.agg(F.max("hour").alias("last")).select((F.col("last") + 1).alias("hour"), F.lit(None).cast("double").alias("c"))
    prefix = field.select("hour", "c").unionByName(ends).select("hour", F.coalesce(upto, F.lit(0.0)).alias("p"))
    all_ = F.broadcast(prefix.agg(F.map_from_entries(F.collect_list(F.struct("hour", "p"))).alias("upto"), F.max("hour").alias("end")))
    w = who.join(all_)
    at = lambda h: F.col("upto")[F.least(h, F.col("end"))]
    total = at(F.coalesce("arrive_hour", "end"))
    way = F.when(F.col("arrive_hour").isNotNull(), at(F.col("arrive_hour")) - at(F.least("depart_hour", "arrive_hour"))).otherwise(0.0)
    return w.select("person_id", total.alias("exposure"), way.alias("on_the_way"), (WALKING * way + RESTING * (total - way)).alias("dose"))


@query(
    "sim_exposure",
    f"""WITH {HOURLY}, {OUTCOMES}, f AS (SELECT hour, coalesce(c, 0) AS c FROM field WHERE county = '{COUNTY}'),
p AS (SELECT hour, coalesce(sum(c) OVER (ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM (SELECT * FROM f UNION ALL SELECT max(hour) + 1, 0 FROM f)), e AS (SELECT max(hour) AS last FROM p),
w AS (SELECT person_id, CASE WHEN state = 'SHELTERED' THEN arrive_tick // 60 END AS a, depart_tick // 60 AS d FROM outcomes),
x AS (SELECT person_id, t.p AS total, CASE WHEN a IS NOT NULL THEN t.p - s.p ELSE 0 END AS way FROM w, e JOIN p t ON t.hour = least(coalesce(a, last), last) JOIN p s ON s.hour = least(least(d, coalesce(a, d)), last))
SELECT person_id, round(total, 7) AS exposure, round(way, 7) AS on_the_way, round(1.62 * way + 0.61 * (total - way), 7) AS dose FROM x""",
)
def sim_exposure(spark, sf_dir):
    w = outcomes(spark, sf_dir).select("person_id", F.floor(F.col("depart_tick") / 60).alias("depart_hour"), F.when(F.col("state") == "SHELTERED", F.floor(F.col("arrive_tick") / 60)).alias("arrive_hour"))
    e = exposures(w, field_of(spark, sf_dir).where(F.col("county") == COUNTY))
    return e.select("person_id", *(F.round(c, 7).alias(c) for c in ("exposure", "on_the_way", "dose")))


def dose_faults(claimed: DataFrame, field: DataFrame, group: str) -> DataFrame:
    """group, violations, n: doses that are not, within 1 %, WALKING times what is breathed on the way and RESTING times the rest. claimed:
    depart_hour, arrive_hour, dose; both parts are added up hour by hour from the field (hour, c), once for each pair of hours
    that occurs, and not taken from the prefix sums that gave the doses."""
    pairs = claimed.select("depart_hour", "arrive_hour").distinct()
    c, h = F.coalesce("c", F.lit(0.0)), F.col("hour")
    inside = F.col("arrive_hour").isNotNull()
    on_way = inside & (h >= F.least("depart_hour", "arrive_hour")) & (h < F.col("arrive_hour"))
    hours = F.broadcast(field.select("hour", "c"))  # a row an hour of the study
    parts = pairs.join(hours, ~inside | (h < F.col("arrive_hour")), "left").groupBy("depart_hour", "arrive_hour").agg(F.coalesce(F.sum(F.when(on_way, c)), F.lit(0.0)).alias("walk"), F.coalesce(F.sum(F.when(~on_way, c)), F.lit(0.0)).alias("rest"))
    both = claimed.join(parts.select(F.col("depart_hour").alias("d"), F.col("arrive_hour").alias("a"), "walk", "rest"), F.col("depart_hour").eqNullSafe(F.col("d")) & F.col("arrive_hour").eqNullSafe(F.col("a")))
    want = WALKING * F.col("walk") + RESTING * F.col("rest")
    return both.groupBy(group).agg(F.count_if(F.abs(want - F.col("dose")) > 0.01 * want + 1e-6).alias("violations"), F.count(F.lit(1)).alias("n"))


@query("chk_dose_identity", f"WITH {OUTCOMES} SELECT arm, 0::BIGINT AS violations, count(*) AS n FROM outcomes GROUP BY arm")
def chk_dose_identity(spark, sf_dir):
    """The doses of sim_exposure against their two parts."""
    w = outcomes(spark, sf_dir).select("person_id", "arm", F.floor(F.col("depart_tick") / 60).alias("depart_hour"), F.when(F.col("state") == "SHELTERED", F.floor(F.col("arrive_tick") / 60)).alias("arrive_hour"))
    f = field_of(spark, sf_dir).where(F.col("county") == COUNTY)
    dose = exposures(w.select("person_id", "depart_hour", "arrive_hour"), f).select("person_id", "dose")
    return dose_faults(w.join(dose, "person_id"), f, "arm")


#: What a bed that no one takes costs, as metres.
UNUSED_M = 60_000.0


def nearest_units(candidates: DataFrame, demand: DataFrame, capacity: int) -> DataFrame:
    """(site_id, group_id, d, whole): of each candidate (site_id, x, y) the groups (group_id, lon, lat, units) within a distance, by
    cells of that size, doubled until they have `capacity` units or it holds all demand (whole). No candidate has more rows than
    twice that distance gives."""
    ends = lambda df, x, y: df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    a, b = ends(demand, "lon", "lat"), ends(candidates, "x", "y")
    if a[0] is None or b[0] is None:
        return candidates.select("site_id", F.lit(None).cast("long").alias("group_id"), F.lit(0.0).alias("d"), F.lit(True).alias("whole")).limit(0)
    level = math.cos(math.radians(min(max(map(abs, (*a[2:], *b[2:]))), 89.0)))
    widest = max(max(a[1], b[1]) - min(a[0], b[0]), max(a[3], b[3]) - min(a[2], b[2])) * 112_000 + 1
    units = demand.agg(F.sum("units")).first()[0]
    metres = max(widest * math.sqrt(capacity / max(units, 1)), widest / 1000)
    todo, done = candidates, []
    while True:
        x, y = metres / (111_000 * level), metres / 110_500
        g = demand.select("group_id", "units", "lon", "lat", F.floor(F.col("lon") / x).alias("cx"), F.floor(F.col("lat") / y).alias("cy"))
        about = F.array(*(F.struct((F.floor(F.col("x") / x) + i).alias("cx"), (F.floor(F.col("y") / y) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
        met = todo.select("site_id", "x", "y", F.inline(about)).join(g, ["cx", "cy"])
        met = met.withColumn("d", F.round(haversine(F.col("lon"), F.col("lat"), F.col("x"), F.col("y")), 3)).where(F.col("d") <= metres * 0.98)
        whole = metres * 0.98 > 2 * widest
        met = materialize(met.select("site_id", "group_id", "units", "d"), "near-demand")
        enough = met.groupBy("site_id").agg(F.sum("units").alias("n")).where(F.lit(whole) | (F.col("n") >= capacity)).select("site_id")
        done.append(met.join(enough, "site_id", "left_semi").select("site_id", "group_id", "d", F.lit(whole).alias("whole")))
        todo = materialize(todo.join(enough, "site_id", "left_anti"), "candidates")
        if whole or todo.isEmpty():
            return reduce(DataFrame.unionByName, done)
        metres *= 2


def p_median(demand: DataFrame, candidates: DataFrame, capacities: list[int]) -> DataFrame:
    """step, site_id, capacity, served, cost_m: a place for each capacity, one after the other: the candidate (site_id, lon, lat) whose
    nearest open demand (group_id, lon, lat, units), up to its capacity, costs least, a bed that stays empty counting UNUSED_M; of
    equals the least id. What is served is no demand any more.

    Each candidate has a list of near demand that is as long as its beds need, and gets a new one only when what others took has left
    it too short: what is written grows with the beds of the candidates and not with demand times candidates. A round sums up the
    lists over ranges of distance, so that no candidate's demand is one task's."""
    spark = demand.sparkSession
    left = materialize(demand.select("group_id", "lon", "lat", F.col("units").cast("long").alias("units")).where("units > 0"), "demand")
    open_ = materialize(candidates.select("site_id", F.col("lon").alias("x"), F.col("lat").alias("y")), "candidates")
    out, lists = [], None
    for step, capacity in enumerate(capacities):
        if open_.isEmpty():
            break
        if lists is None:
            lists = materialize(nearest_units(open_, left, max(capacities)), "lists")
        else:
            now = lists.join(left.select("group_id", "units"), "group_id").groupBy("site_id").agg(F.sum("units").alias("n"), F.max("whole").alias("whole"))
            short = materialize(open_.join(now, "site_id", "left").where(~F.coalesce("whole", F.lit(False)) & (F.coalesce("n", F.lit(0)) < capacity)).select("site_id", "x", "y"), "short")
            new = nearest_units(short, left, max(capacities)) if not short.isEmpty() else lists.limit(0)
            was, lists = lists, materialize(lists.join(open_, "site_id", "left_semi").join(short, "site_id", "left_anti").unionByName(new), "lists")
            discard(was)
        pairs = lists.join(left.select("group_id", "units"), "group_id").select("group_id", "units", "site_id", "d")
        near = running(pairs, ["site_id"], ["d", "group_id"], "units", "before").where(F.col("before") < capacity)
        near = near.withColumn("take", F.least(F.col("units"), capacity - F.col("before")))
        cost = open_.select("site_id").join(near.groupBy("site_id").agg(F.sum(F.col("d") * F.col("take")).alias("walk"), F.sum("take").alias("served")), "site_id", "left")
        cost = cost.withColumn("cost", F.round(F.col("walk") + (capacity - F.col("served")) * UNUSED_M, 0)).where("served > 0")
        best = cost.orderBy("cost", "site_id").first()
        if best is None:
            break
        out.append((step, best.site_id, capacity, best.served, float(best.cost)))
        used = near.where(F.col("site_id") == best.site_id).select("group_id", "take")
        after = left.join(used, "group_id", "left").withColumn("units", F.col("units") - F.coalesce("take", F.lit(0))).drop("take")
        left = materialize(after.where("units > 0"), "demand")
        open_ = materialize(open_.where(F.col("site_id") != best.site_id), "candidates")
    return spark.createDataFrame(out, "step int, site_id long, capacity int, served long, cost_m double")


@query("st_pmedian")
def st_pmedian(spark, sf_dir):
    """Three new sites of 40, 25 and 25 beds among all operating places, for the people of each square of 0.05 degrees."""
    p = people(spark, sf_dir).groupBy(F.floor(F.col("lon") * 20).alias("a"), F.floor(F.col("lat") * 20).alias("b")).agg(F.count(F.lit(1)).alias("units"))
    d = p.select((F.col("a") * 100_000 + F.col("b")).alias("group_id"), (F.col("a") / 20 + 0.025).alias("lon"), (F.col("b") / 20 + 0.025).alias("lat"), "units")
    return p_median(d, sites(spark, sf_dir).where("operating").select("site_id", "lon", "lat"), [40, 25, 25])


@query("tx_training_table", """SELECT o_orderkey, c_mktsegment AS band, c_acctbal AS balance, (o_orderstatus = 'F')::INT AS sheltered FROM orders JOIN customer ON c_custkey = o_custkey""")
def tx_training_table(spark, sf_dir):
    """Inputs joined with outcomes, a row for each person and run."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return o.join(c, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", F.col("c_mktsegment").alias("band"), F.col("c_acctbal").alias("balance"), (F.col("o_orderstatus") == "F").cast("int").alias("sheltered"))


@query("tx_add_rows", "SELECT s_suppkey AS site_id, s_name AS name, round(s_acctbal * 1.1, 5) AS value FROM supplier UNION ALL SELECT 1000000 + n_nationkey, n_name, NULL FROM nation")
def tx_add_rows(spark, sf_dir):
    """New rows below, by column name; what they lack is null."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site_id"), F.col("s_name").alias("name"), F.round(F.col("s_acctbal") * 1.1, 5).alias("value"))
    n = read(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("long") + 1_000_000).alias("site_id"), F.col("n_name").alias("name"))
    return s.unionByName(n, allowMissingColumns=True)


@query("tx_expand_plus_new", "SELECT s_suppkey AS site_id, round_even((5 + s_suppkey % 11) * 1.5, 0)::BIGINT AS capacity FROM supplier")
def tx_expand_plus_new(spark, sf_dir):
    """Half as many beds again, halves rounded to even."""
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site_id"), F.bround((5 + F.col("s_suppkey") % 11) * F.lit(1.5)).cast("long").alias("capacity"))
