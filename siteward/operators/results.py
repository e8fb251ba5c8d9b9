"""Outcome aggregates, result tables and statistics over runs (arm, seed).

Every loop over runs is a groupBy; medians and quantiles are exact per group, and group tables overlap where they do in the
study. Doubles are rounded so that the order of summation does not show.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteward.catalog import query
from siteward.functions.ranks import quantiles, value_ranks
from siteward.operators.stand_ins import OUTCOMES, outcomes, read

STATES = ["SHELTERED", "REFUSED_ALL_FULL", "UNREACHABLE", "WALKING"]
VULNERABLE = "age_years >= 55 OR mobility_limited OR asthma OR copd OR chronic"
HAZARD = "copd OR asthma OR age_years >= 65 OR mobility_limited"
#: name: predicate; a resident is in all groups that hold.
GROUPS = {
    "all": "true",
    "under 55": "age_years < 55",
    "55 to 64": "age_years BETWEEN 55 AND 64",
    "65 and over": "age_years >= 65",
    "mobility": "mobility_limited",
    "no mobility limit": "NOT mobility_limited",
    "asthma": "asthma",
    "copd": "copd",
    "respiratory": "asthma OR copd",
    "chronic": "chronic",
    "vulnerable": VULNERABLE,
    "none": f"NOT ({VULNERABLE})",
}
STRATA = {"mobility": "mobility_limited", "asthma": "asthma", "copd": "copd", "chronic": "chronic", "respiratory": "asthma OR copd", "older": "age_years >= 55", "vulnerable": VULNERABLE}


@query("agg_census", f"WITH {OUTCOMES}, v(state) AS (VALUES {', '.join(f"('{s}')" for s in STATES)}), runs AS (SELECT DISTINCT arm, seed FROM outcomes) SELECT arm, seed, state, count(person_id) AS n FROM runs CROSS JOIN v LEFT JOIN outcomes USING (arm, seed, state) GROUP BY ALL")
def agg_census(spark, sf_dir):
    """Counts by state with zeros for states that do not occur."""
    o = outcomes(spark, sf_dir).groupBy("arm", "seed").agg(*(F.count_if(F.col("state") == s).alias(s) for s in STATES))
    return o.select("arm", "seed", F.explode(F.array(*(F.struct(F.lit(s).alias("state"), F.col(s).alias("n")) for s in STATES))).alias("x")).select("arm", "seed", "x.*")


@query("agg_summary", f"""WITH {OUTCOMES} SELECT arm, count(*) AS n, round(avg(dose_ug), 4) AS mean, round(min(dose_ug), 4) AS low, round(quantile_cont(dose_ug, 0.25), 4) AS p25, round(quantile_cont(dose_ug, 0.5), 4) AS median,
 round(quantile_cont(dose_ug, 0.75), 4) AS p75, round(quantile_cont(dose_ug, 0.9), 4) AS p90, round(max(dose_ug), 4) AS high, round(sum(dose_ug), 2) AS total FROM outcomes GROUP BY arm""")  # fmt: skip
def agg_summary(spark, sf_dir):
    o = outcomes(spark, sf_dir)
    g = o.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("dose_ug"), 4).alias("mean"), F.round(F.min("dose_ug"), 4).alias("low"), F.round(F.max("dose_ug"), 4).alias("high"), F.round(F.sum("dose_ug"), 2).alias("total"))
    q = quantiles(o, ["arm"], "dose_ug", {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9})
    return g.join(q, "arm", "left").select("arm", "n", "mean", "low", *(F.round(c, 4).alias(c) for c in ("p25", "median", "p75", "p90")), "high", "total")


@query("agg_gini", f"WITH {OUTCOMES}, r AS (SELECT arm, dose_ug AS x, row_number() OVER (PARTITION BY arm ORDER BY dose_ug) AS i, count(*) OVER (PARTITION BY arm) AS n FROM outcomes) SELECT arm, round(CASE WHEN avg(x) = 0 THEN 0 ELSE sum((2.0 * i - n - 1) * x) / (any_value(n)::DOUBLE * any_value(n) * avg(x)) END, 6) AS gini FROM r GROUP BY arm")
def agg_gini(spark, sf_dir):
    """Closed form over counts by value: the ranks of n equal values from b + 1 add up to n * b + n * (n + 1) / 2."""
    v = value_ranks(outcomes(spark, sf_dir), ["arm"], "dose_ug")
    ranks = F.col("n") * F.col("below") + F.col("n") * (F.col("n") + 1) / 2
    s = v.groupBy("arm").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("dose_ug")).alias("s"), F.sum(ranks * F.col("dose_ug")).alias("rs"))
    return s.select("arm", F.round(F.when(F.col("s") == 0, 0.0).otherwise((2 * F.col("rs") - (F.col("n") + 1) * F.col("s")) / (F.col("n") * F.col("s"))), 6).alias("gini"))


@query("agg_pct_nearest", f"WITH {OUTCOMES}, r AS (SELECT arm, dose_ug, row_number() OVER (PARTITION BY arm ORDER BY dose_ug) AS i, count(*) OVER (PARTITION BY arm) AS n FROM outcomes) SELECT arm, round(max(dose_ug), 4) AS p90 FROM r WHERE i = round_even(0.9::DOUBLE * (n - 1), 0)::BIGINT + 1 GROUP BY arm")
def agg_pct_nearest(spark, sf_dir, p: float = 0.9):
    """The nearest-rank percentile with rounding half to even."""
    v = value_ranks(outcomes(spark, sf_dir), ["arm"], "dose_ug")
    total = v.groupBy("arm").agg((F.bround(F.lit(p) * (F.sum("n") - 1)) + 1).cast("long").alias("at"))
    hit = v.join(F.broadcast(total), "arm").where("below < at AND at <= below + n")
    return hit.select("arm", F.round("dose_ug", 4).alias("p90"))


def in_groups(df: DataFrame, groups: dict[str, str], name: str = "grp") -> DataFrame:
    """A row for each group that a row is in."""
    return df.withColumn(name, F.explode(F.filter(F.array(*(F.when(F.expr(p), F.lit(k)) for k, p in groups.items())), lambda g: g.isNotNull())))


def _groups_sql(groups: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT *, '{k}' AS grp FROM outcomes WHERE {p}" for k, p in groups.items())


@query("agg_group_outcomes", f"""WITH {OUTCOMES}, g AS ({_groups_sql(GROUPS)}), t AS (SELECT arm, count(*) AS total FROM outcomes GROUP BY arm)
SELECT arm, grp, count(*) AS n, round(100.0 * count(*) / any_value(total), 4) AS share, count(*) FILTER (state = 'SHELTERED') AS sheltered, round(100.0 * count(*) FILTER (state = 'SHELTERED') / count(*), 4) AS pct,
 count(*) FILTER (state = 'REFUSED_ALL_FULL') AS refused, round(avg(distance_m), 3) AS mean_distance, round(avg(dose_ug), 3) AS mean_dose FROM g JOIN t USING (arm) GROUP BY arm, grp""")  # fmt: skip
def agg_group_outcomes(spark, sf_dir):
    g = in_groups(outcomes(spark, sf_dir), GROUPS).groupBy("arm", "grp").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "SHELTERED").alias("sheltered"), F.count_if(F.col("state") == "REFUSED_ALL_FULL").alias("refused"), F.round(F.avg("distance_m"), 3).alias("mean_distance"), F.round(F.avg("dose_ug"), 3).alias("mean_dose"))
    everyone = g.where("grp = 'all'").select("arm", F.col("n").alias("total"))
    out = g.join(F.broadcast(everyone), "arm").withColumns({"share": F.round(100 * F.col("n") / F.col("total"), 4), "pct": F.round(100 * F.col("sheltered") / F.col("n"), 4)})
    return out.drop("total")


@query("agg_strata", f"""WITH {OUTCOMES}, s AS ({' UNION ALL '.join(f"SELECT arm, '{k}' AS stratum, coalesce({p}, false) AS member, state, dose_ug FROM outcomes" for k, p in STRATA.items())})
SELECT arm, stratum, member, count(*) AS n, count(*) FILTER (state = 'SHELTERED') AS sheltered, round(avg(dose_ug), 3) AS mean_dose FROM s GROUP BY ALL""")  # fmt: skip
def agg_strata(spark, sf_dir):
    """Seven strata, each with its members and the rest."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("stratum"), F.coalesce(F.expr(p), F.lit(False)).alias("member")) for k, p in STRATA.items())))
    s = outcomes(spark, sf_dir).select("arm", "state", "dose_ug", each.alias("s")).select("arm", "state", "dose_ug", "s.*")
    return s.groupBy("arm", "stratum", "member").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "SHELTERED").alias("sheltered"), F.round(F.avg("dose_ug"), 3).alias("mean_dose"))


@query("prj_stratum", f"WITH {OUTCOMES} SELECT person_id, list_filter([{', '.join(f"CASE WHEN {p} THEN '{k}' END" for k, p in STRATA.items())}], lambda x: x IS NOT NULL) AS strata FROM outcomes")
def prj_stratum(spark, sf_dir):
    return outcomes(spark, sf_dir).select("person_id", F.filter(F.array(*(F.when(F.expr(p), F.lit(k)) for k, p in STRATA.items())), lambda g: g.isNotNull()).alias("strata"))


@query("prj_vulnerable", f"WITH {OUTCOMES} SELECT person_id, {VULNERABLE} AS vulnerable, {HAZARD} AS hazard FROM outcomes")
def prj_vulnerable(spark, sf_dir):
    """The two flags of vulnerability, which differ."""
    return outcomes(spark, sf_dir).select("person_id", F.expr(VULNERABLE).alias("vulnerable"), F.expr(HAZARD).alias("hazard"))


HEADLINE = "count(*) AS n, count(*) FILTER (state = 'SHELTERED') AS inside, round(100.0 * count(*) FILTER (state = 'SHELTERED') / count(*), 4) AS pct, round(avg(distance_m), 3) AS mean_distance, round(avg(dose_ug), 3) AS mean_dose"


def headline(o: DataFrame) -> DataFrame:
    inside = F.count_if(F.col("state") == "SHELTERED")
    return o.groupBy("arm", "seed").agg(F.count(F.lit(1)).alias("n"), inside.alias("inside"), F.round(100 * inside / F.count(F.lit(1)), 4).alias("pct"), F.round(F.avg("distance_m"), 3).alias("mean_distance"), F.round(F.avg("dose_ug"), 3).alias("mean_dose"))


@query("agg_run_headline", f"WITH {OUTCOMES} SELECT arm, seed, {HEADLINE} FROM outcomes GROUP BY arm, seed")
def agg_run_headline(spark, sf_dir):
    return headline(outcomes(spark, sf_dir))


@query("agg_rollup_seeds", f"""WITH {OUTCOMES}, h AS (SELECT arm, seed, {HEADLINE} FROM outcomes GROUP BY arm, seed)
SELECT arm, seed::VARCHAR AS seed, inside::DOUBLE AS inside, mean_dose FROM h UNION ALL SELECT arm, 'min', min(inside)::DOUBLE, min(mean_dose) FROM h GROUP BY arm
UNION ALL SELECT arm, 'mean', round(avg(inside), 4), round(avg(mean_dose), 4) FROM h GROUP BY arm UNION ALL SELECT arm, 'max', max(inside)::DOUBLE, max(mean_dose) FROM h GROUP BY arm""")  # fmt: skip
def agg_rollup_seeds(spark, sf_dir):
    """The rows of the runs with rows for the least, the mean and the largest of each arm below."""
    h = headline(outcomes(spark, sf_dir))
    a = h.groupBy("arm").agg(*(f(c).cast("double").alias(f"{n}_{c}") for n, f in (("min", F.min), ("mean", lambda c: F.round(F.avg(c), 4)), ("max", F.max)) for c in ("inside", "mean_dose")))
    rows = a.select("arm", F.explode(F.array(*(F.struct(F.lit(n).alias("seed"), F.col(f"{n}_inside").alias("inside"), F.col(f"{n}_mean_dose").alias("mean_dose")) for n in ("min", "mean", "max")))).alias("r")).select("arm", "r.*")
    return h.select("arm", F.col("seed").cast("string").alias("seed"), F.col("inside").cast("double").alias("inside"), "mean_dose").unionByName(rows)


@query("agg_range_text", f"WITH {OUTCOMES}, h AS (SELECT arm, seed, count(*) FILTER (state = 'SHELTERED') AS inside FROM outcomes GROUP BY arm, seed) SELECT arm, min(inside) || ' - ' || max(inside) AS inside_range FROM h GROUP BY arm")
def agg_range_text(spark, sf_dir):
    return headline(outcomes(spark, sf_dir)).groupBy("arm").agg(F.format_string("%d - %d", F.min("inside"), F.max("inside")).alias("inside_range"))


@query("agg_pool", f"WITH {OUTCOMES}, h AS (SELECT arm, seed, count(*) AS n, count(*) FILTER (state = 'SHELTERED') AS k FROM outcomes GROUP BY arm, seed) SELECT arm, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k, round(sum(k) / sum(n), 6) AS p FROM h GROUP BY arm")
def agg_pool(spark, sf_dir):
    h = headline(outcomes(spark, sf_dir)).groupBy("arm").agg(F.sum("n").alias("n"), F.sum("inside").alias("k"))
    return h.withColumn("p", F.round(F.col("k") / F.col("n"), 6))


@query("agg_start_points", f"WITH {OUTCOMES} SELECT start_id, count(*) AS n FROM outcomes GROUP BY start_id")
def agg_start_points(spark, sf_dir):
    return outcomes(spark, sf_dir).groupBy("start_id").agg(F.count(F.lit(1)).alias("n"))


@query("agg_distinct", f"WITH {OUTCOMES} SELECT arm, count(DISTINCT seed) AS seeds, count(DISTINCT start_id) AS starts, min(state) = max(state) AS constant_state, md5(string_agg(DISTINCT state, ',' ORDER BY state)) AS states_md5 FROM outcomes GROUP BY arm")
def agg_distinct(spark, sf_dir):
    return outcomes(spark, sf_dir).groupBy("arm").agg(F.count_distinct("seed").alias("seeds"), F.count_distinct("start_id").alias("starts"), (F.min("state") == F.max("state")).alias("constant_state"), F.md5(F.array_join(F.sort_array(F.collect_set("state")), ",")).alias("states_md5"))


def order_free_digest(cols: list[str]) -> list[Column]:
    """Columns whose equality says that groups hold the same rows as often: the count, and the sum of the four 15-digit parts
    of each row's sha2, added up without order so that no group is gathered."""
    h = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols)), 256)
    part = lambda k: F.conv(F.substring(h, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")
    return [F.count(F.lit(1)).alias("n"), *(F.sum(part(k)).alias(f"h{k}") for k in range(4))]


def wrapped(total: Column) -> Column:
    """A whole decimal of 0 or more as the signed long that it is modulo 2^64; below 2^63 itself."""
    low = total % F.lit(str(2**64)).cast("decimal(20,0)")
    return F.when(low >= F.lit(str(2**63)).cast("decimal(20,0)"), low - F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(low).cast("long")


@query("agg_hash_group", f"""WITH {OUTCOMES}, h AS (SELECT arm, sha256(concat_ws(chr(31), coalesce(person_id::VARCHAR, chr(0)), coalesce(state, chr(0)))) AS h FROM outcomes)
SELECT arm, count(*) AS n, sum(('0x' || substr(h, 1, 12))::BIGINT)::BIGINT AS h0, sum(('0x' || substr(h, 13, 12))::BIGINT)::BIGINT AS h1 FROM h GROUP BY arm""")  # fmt: skip
def agg_hash_group(spark, sf_dir):
    """Digests of the arms as longs: sums beyond 2^63, which the SQL's BIGINT has no room for, are taken modulo 2^64."""
    g = outcomes(spark, sf_dir).groupBy("arm").agg(*order_free_digest(["person_id", "state"]))
    return g.select("arm", "n", wrapped(F.col("h0")).alias("h0"), wrapped(F.col("h1")).alias("h1"))


@query("agg_realised_marginals", f"WITH {OUTCOMES}, b AS (SELECT arm, mobility_limited::INT + asthma::INT + copd::INT + chronic::INT AS barriers, mobility_limited, asthma FROM outcomes) SELECT arm, round(avg(mobility_limited::INT), 6) AS mobility, round(avg(asthma::INT), 6) AS asthma, round(avg((barriers >= 1)::INT), 6) AS any_barrier, round(avg((barriers >= 2)::INT), 6) AS two_barriers FROM b GROUP BY arm")
def agg_realised_marginals(spark, sf_dir):
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    barriers = reduce(lambda a, b: a + b, (F.col(c).cast("int") for c in ("mobility_limited", "asthma", "copd", "chronic")))
    return outcomes(spark, sf_dir).groupBy("arm").agg(share(F.col("mobility_limited")).alias("mobility"), share(F.col("asthma")).alias("asthma"), share(barriers >= 1).alias("any_barrier"), share(barriers >= 2).alias("two_barriers"))


@query("win_rank_avg", f"WITH {OUTCOMES} SELECT person_id, rank() OVER (PARTITION BY arm ORDER BY dose_ug) + (count(*) OVER (PARTITION BY arm, dose_ug) - 1) / 2.0::DOUBLE AS avg_rank FROM outcomes")
def win_rank_avg(spark, sf_dir):
    """Average ranks of ties, from counts by value."""
    o = outcomes(spark, sf_dir)
    v = value_ranks(o, ["arm"], "dose_ug").select("arm", "dose_ug", (F.col("below") + (F.col("n") + 1) / 2).alias("avg_rank"))
    return o.join(v, ["arm", "dose_ug"]).select("person_id", "avg_rank")


@query("agg_corr", f"""WITH {OUTCOMES}, r AS (SELECT arm, dose_ug, age_years, rank() OVER (PARTITION BY arm ORDER BY dose_ug) + (count(*) OVER (PARTITION BY arm, dose_ug) - 1) / 2.0 AS rd,
 rank() OVER (PARTITION BY arm ORDER BY age_years) + (count(*) OVER (PARTITION BY arm, age_years) - 1) / 2.0 AS ra FROM outcomes) SELECT arm, round(corr(dose_ug, age_years), 6) AS pearson, round(corr(rd, ra), 6) AS spearman FROM r GROUP BY arm HAVING count(*) > 2""")  # fmt: skip
def agg_corr(spark, sf_dir):
    o = outcomes(spark, sf_dir).select("arm", "dose_ug", "age_years")
    for c in ("dose_ug", "age_years"):
        o = o.join(value_ranks(o, ["arm"], c).select("arm", c, (F.col("below") + (F.col("n") + 1) / 2).alias(f"r_{c}")), ["arm", c])
    return o.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("dose_ug", "age_years"), 6).alias("pearson"), F.round(F.corr("r_dose_ug", "r_age_years"), 6).alias("spearman")).where("n > 2").drop("n")


@query("agg_histogram", f"WITH {OUTCOMES}, b AS (SELECT least(19, greatest(0, floor(distance_m / 2500)))::BIGINT AS bin, floor(log10(greatest(dose_ug, 1)) * 4)::BIGINT AS log_bin FROM outcomes) SELECT bin, log_bin, count(*) AS n FROM b GROUP BY ALL")
def agg_histogram(spark, sf_dir):
    """Equal-width and log-spaced bins at once."""
    o = outcomes(spark, sf_dir)
    return o.groupBy(F.least(F.lit(19), F.greatest(F.lit(0), F.floor(F.col("distance_m") / 2500))).alias("bin"), F.floor(F.log10(F.greatest("dose_ug", F.lit(1))) * 4).alias("log_bin")).agg(F.count(F.lit(1)).alias("n"))


BANDS = "CASE WHEN distance_m <= 0 THEN NULL WHEN distance_m <= 8000 THEN '(0,8]' WHEN distance_m <= 16000 THEN '(8,16]' WHEN distance_m <= 32000 THEN '(16,32]' ELSE '(32,' END"


@query("agg_banding", f"WITH {OUTCOMES} SELECT arm, {BANDS} AS band, count(*) AS n, round(100.0 * count(*) FILTER (state = 'SHELTERED') / count(*), 4) AS pct FROM outcomes WHERE ({BANDS}) IS NOT NULL GROUP BY ALL")
def agg_banding(spark, sf_dir):
    o = outcomes(spark, sf_dir).withColumn("band", F.expr(BANDS)).where("band IS NOT NULL")
    return o.groupBy("arm", "band").agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.count_if(F.col("state") == "SHELTERED") / F.count(F.lit(1)), 4).alias("pct"))


@query("agg_person_hours", f"WITH {OUTCOMES} SELECT arm, sum(greatest(arrive_tick - depart_tick, 0))::BIGINT AS minutes_outdoors, coalesce(sum(greatest(arrive_tick - depart_tick, 0)) FILTER (state = 'SHELTERED'), 0)::BIGINT AS sheltered_minutes FROM outcomes GROUP BY arm")
def agg_person_hours(spark, sf_dir):
    m = F.greatest(F.col("arrive_tick") - F.col("depart_tick"), F.lit(0))
    return outcomes(spark, sf_dir).groupBy("arm").agg(F.sum(m).alias("minutes_outdoors"), F.coalesce(F.sum(F.when(F.col("state") == "SHELTERED", m)), F.lit(0)).alias("sheltered_minutes"))


@query("agg_hour_headcount", f"""WITH {OUTCOMES}, s AS (SELECT arm, depart_tick // 60 AS a, greatest(ceil(arrive_tick / 60.0)::BIGINT, depart_tick // 60) AS b FROM outcomes),
d AS (SELECT arm, a AS hour, 1 AS x FROM s UNION ALL SELECT arm, b, -1 FROM s), h AS (SELECT arm, hour, sum(x) AS x FROM d GROUP BY ALL)
SELECT arm, hour, sum(x) OVER (PARTITION BY arm ORDER BY hour)::BIGINT AS outdoors FROM h""")  # fmt: skip
def agg_hour_headcount(spark, sf_dir):
    """People outdoors from each hour on in which the number changes: +1 and -1 by hour, added up; windows hold hours only."""
    a = F.floor(F.col("depart_tick") / 60)
    steps = F.array(F.struct(a.alias("hour"), F.lit(1).alias("x")), F.struct(F.greatest(F.ceil(F.col("arrive_tick") / 60), a).alias("hour"), F.lit(-1).alias("x")))
    h = outcomes(spark, sf_dir).select("arm", F.explode(steps).alias("s")).groupBy("arm", "s.hour").agg(F.sum("s.x").alias("x"))
    return h.select("arm", "hour", F.sum("x").over(Window.partitionBy("arm").orderBy("hour")).alias("outdoors"))


@query("agg_cum_curve", f"WITH {OUTCOMES} SELECT arm, t, count(*) FILTER (state = 'SHELTERED' AND arrive_tick <= t * 60) AS inside, round(100.0 * count(*) FILTER (state = 'SHELTERED' AND arrive_tick <= t * 60) / count(*), 4) AS pct FROM outcomes, range(0, 241, 24) AS g(t) GROUP BY arm, t")
def agg_cum_curve(spark, sf_dir):
    """The share inside by each hour of a grid: one pass with a conditional count for each."""
    grid = list(range(0, 241, 24))
    o = outcomes(spark, sf_dir).groupBy("arm").agg(F.count(F.lit(1)).alias("n"), *(F.count_if((F.col("state") == "SHELTERED") & (F.col("arrive_tick") <= t * 60)).alias(f"t{t}") for t in grid))
    x = o.select("arm", "n", F.explode(F.array(*(F.struct(F.lit(t).cast("long").alias("t"), F.col(f"t{t}").alias("inside")) for t in grid))).alias("x"))
    return x.select("arm", "x.t", "x.inside", F.round(100 * F.col("x.inside") / F.col("n"), 4).alias("pct"))


GAP = "100.0 * (avg(CASE WHEN NOT mobility_limited THEN (state = 'SHELTERED')::INT END) - avg(CASE WHEN mobility_limited THEN (state = 'SHELTERED')::INT END))"


def gap(flag: str = "mobility_limited") -> Column:
    """Points by which those without the flag are sheltered more often."""
    inside = (F.col("state") == "SHELTERED").cast("int")
    return 100 * (F.avg(F.when(~F.col(flag), inside)) - F.avg(F.when(F.col(flag), inside)))


@query("agg_gap", f"WITH {OUTCOMES} SELECT arm, seed, round({GAP}, 4) AS gap_pp FROM outcomes GROUP BY ALL")
def agg_gap(spark, sf_dir):
    return outcomes(spark, sf_dir).groupBy("arm", "seed").agg(F.round(gap(), 4).alias("gap_pp"))


@query("agg_deltas", f"WITH {OUTCOMES}, h AS (SELECT arm, round(avg(dose_ug), 1) AS d FROM outcomes GROUP BY arm) SELECT x.arm AS arm_a, y.arm AS arm_b, round(x.d - y.d, 1) AS delta FROM h x JOIN h y ON x.arm < y.arm")
def agg_deltas(spark, sf_dir):
    """Differences of rounded means; arms are few."""
    h = outcomes(spark, sf_dir).groupBy("arm").agg(F.round(F.avg("dose_ug"), 1).alias("d"))
    y = h.select(F.col("arm").alias("arm_b"), F.col("d").alias("d_b"))
    return h.join(F.broadcast(y), F.col("arm") < F.col("arm_b")).select(F.col("arm").alias("arm_a"), "arm_b", F.round(F.col("d") - F.col("d_b"), 1).alias("delta"))


@query("agg_window_decomp", f"""WITH {OUTCOMES}, d AS (SELECT arm, seed, avg(dose_ug) AS dose, avg(dose_ug * 0.3) AS walk, count(*) FILTER (abs(dose_ug * 0.3 + dose_ug * 0.7 - dose_ug) > 0.01 * dose_ug) AS bad FROM outcomes GROUP BY arm, seed)
SELECT x.seed, round(x.dose / y.dose, 6) AS ratio, round(x.walk / x.dose, 6) AS walk_share, x.bad + y.bad AS violations FROM d x JOIN d y ON x.seed = y.seed WHERE x.arm = '1' AND y.arm = '2'""")  # fmt: skip
def agg_window_decomp(spark, sf_dir):
    walk, dose = F.col("dose_ug") * 0.3, F.col("dose_ug")
    bad = F.count_if(F.abs(walk + dose * 0.7 - dose) > 0.01 * dose)
    d = outcomes(spark, sf_dir).where("arm IN ('1', '2')").groupBy("arm", "seed").agg(F.avg(dose).alias("dose"), F.avg(walk).alias("walk"), bad.alias("bad"))
    x, y = d.where("arm = '1'").alias("x"), d.where("arm = '2'").alias("y")
    return x.join(y, F.col("x.seed") == F.col("y.seed")).select("x.seed", F.round(F.col("x.dose") / F.col("y.dose"), 6).alias("ratio"), F.round(F.col("x.walk") / F.col("x.dose"), 6).alias("walk_share"), (F.col("x.bad") + F.col("y.bad")).alias("violations"))


@query("agg_sweep", f"""WITH {OUTCOMES}, h AS (SELECT arm, seed, 100.0 * count(*) FILTER (state = 'SHELTERED') / count(*) AS pct, {GAP} AS gap FROM outcomes GROUP BY arm, seed),
t AS (SELECT avg(pct) AS target FROM h WHERE arm = '3') SELECT arm, round(avg(pct), 4) AS mean, round(min(pct), 4) AS low, round(max(pct), 4) AS high, round(avg(gap), 4) AS mean_gap, min(pct) >= any_value(target) AS reaches FROM h, t GROUP BY arm""")  # fmt: skip
def agg_sweep(spark, sf_dir):
    h = outcomes(spark, sf_dir).groupBy("arm", "seed").agg((100 * F.count_if(F.col("state") == "SHELTERED") / F.count(F.lit(1))).alias("pct"), gap().alias("gap"))
    target = F.broadcast(h.where("arm = '3'").agg(F.avg("pct").alias("target")))
    g = h.groupBy("arm").agg(F.round(F.avg("pct"), 4).alias("mean"), F.round(F.min("pct"), 4).alias("low"), F.round(F.max("pct"), 4).alias("high"), F.round(F.avg("gap"), 4).alias("mean_gap"), F.min("pct").alias("least"))
    return g.join(target).withColumn("reaches", F.col("least") >= F.col("target")).drop("least", "target")


@query("agg_score_metrics", f"""WITH {OUTCOMES} SELECT arm, seed, round(avg((state = 'SHELTERED')::INT), 6) AS access, round(avg((state = 'SHELTERED')::INT) FILTER (copd), 6) AS access_copd, round(avg(dose_ug) FILTER (state <> 'SHELTERED'), 7) AS dose_outside,
 round(avg(distance_m) FILTER (state = 'SHELTERED' AND mobility_limited), 7) AS walk_mobility, count(*) FILTER (state = 'UNREACHABLE') AS unreachable FROM outcomes GROUP BY arm, seed""")  # fmt: skip
def agg_score_metrics(spark, sf_dir):
    inside = (F.col("state") == "SHELTERED").cast("int")
    return outcomes(spark, sf_dir).groupBy("arm", "seed").agg(
        F.round(F.avg(inside), 6).alias("access"),
        F.round(F.avg(F.when(F.col("copd"), inside)), 6).alias("access_copd"),
        F.round(F.avg(F.when(F.col("state") != "SHELTERED", F.col("dose_ug"))), 7).alias("dose_outside"),
        F.round(F.avg(F.when((F.col("state") == "SHELTERED") & F.col("mobility_limited"), F.col("distance_m"))), 7).alias("walk_mobility"),
        F.count_if(F.col("state") == "UNREACHABLE").alias("unreachable"),
    )


@query("win_minmax_per_seed", f"WITH {OUTCOMES}, h AS (SELECT arm, seed, count(*) FILTER (state = 'SHELTERED') AS inside FROM outcomes GROUP BY arm, seed) SELECT arm, seed, inside, min(inside) OVER (PARTITION BY arm) AS low, max(inside) OVER (PARTITION BY arm) AS high FROM h")
def win_minmax_per_seed(spark, sf_dir):
    w = Window.partitionBy("arm")
    return headline(outcomes(spark, sf_dir)).select("arm", "seed", "inside", F.min("inside").over(w).alias("low"), F.max("inside").over(w).alias("high"))


# Statistics on counts and on sums of products.

Z = 1.959963984540054


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """The Wilson interval of k of n."""
    p, z2 = k / n, Z * Z
    mid, half = (p + z2 / (2 * n)) / (1 + z2 / n), Z / (1 + z2 / n) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return mid - half, mid + half


WILSON = "(p + {z2} / (2 * n)) / (1 + {z2} / n) {sign} {z} / (1 + {z2} / n) * sqrt(p * (1 - p) / n + {z2} / (4.0 * n * n))"


def _wilson_sql(sign: str) -> str:
    return WILSON.format(z2=repr(Z * Z) + "::DOUBLE", z=repr(Z) + "::DOUBLE", sign=sign)


def two_by_two(spark, sf_dir) -> DataFrame:
    """arm with a, b (mobility-limited: inside, not) and c, d (others)."""
    m, i = F.col("mobility_limited"), F.col("state") == "SHELTERED"
    return outcomes(spark, sf_dir).groupBy("arm").agg(F.count_if(m & i).alias("a"), F.count_if(m & ~i).alias("b"), F.count_if(~m & i).alias("c"), F.count_if(~m & ~i).alias("d"))


TABLE22 = "t22 AS (SELECT arm, count(*) FILTER (mobility_limited AND state = 'SHELTERED')::DOUBLE AS a, count(*) FILTER (mobility_limited AND state <> 'SHELTERED')::DOUBLE AS b, count(*) FILTER (NOT mobility_limited AND state = 'SHELTERED')::DOUBLE AS c, count(*) FILTER (NOT mobility_limited AND state <> 'SHELTERED')::DOUBLE AS d FROM outcomes GROUP BY arm)"


@query("st_wilson", f"WITH {OUTCOMES}, {TABLE22}, k AS (SELECT arm, a / (a + b) AS p, a + b AS n FROM t22) SELECT arm, round({_wilson_sql('-')}, 6) AS low, round({_wilson_sql('+')}, 6) AS high FROM k")
def st_wilson(spark, sf_dir):
    lo, hi = wilson(F.col("a"), F.col("a") + F.col("b"))
    return two_by_two(spark, sf_dir).select("arm", F.round(lo, 6).alias("low"), F.round(hi, 6).alias("high"))


@query("st_newcombe", f"""WITH {OUTCOMES}, {TABLE22}, k AS (SELECT arm, 1 AS g, a / (a + b) AS p, a + b AS n FROM t22 UNION ALL SELECT arm, 2, c / (c + d), c + d FROM t22), w AS (SELECT arm, g, p, {_wilson_sql('-')} AS l, {_wilson_sql('+')} AS u FROM k)
SELECT x.arm, round(x.p - y.p, 6) AS diff, round(x.p - y.p - sqrt(pow(x.p - x.l, 2) + pow(y.u - y.p, 2)), 6) AS low, round(x.p - y.p + sqrt(pow(x.u - x.p, 2) + pow(y.p - y.l, 2)), 6) AS high FROM w x JOIN w y ON x.arm = y.arm AND x.g = 1 AND y.g = 2""")  # fmt: skip
def st_newcombe(spark, sf_dir):
    """The interval of a difference of shares from the two Wilson intervals."""
    n1, n2 = F.col("a") + F.col("b"), F.col("c") + F.col("d")
    (l1, u1), (l2, u2) = wilson(F.col("a"), n1), wilson(F.col("c"), n2)
    p1, p2 = F.col("a") / n1, F.col("c") / n2
    low, high = p1 - p2 - F.sqrt(F.pow(p1 - l1, 2) + F.pow(u2 - p2, 2)), p1 - p2 + F.sqrt(F.pow(u1 - p1, 2) + F.pow(p2 - l2, 2))
    return two_by_two(spark, sf_dir).select("arm", F.round(p1 - p2, 6).alias("diff"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


HALDANE = "h AS (SELECT arm, a, b, c, d, CASE WHEN least(a, b, c, d) = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS z FROM t22)"


@query("st_rr_or", f"""WITH {OUTCOMES}, {TABLE22}, {HALDANE} SELECT arm, round(a / (a + b) / (c / (c + d)), 6) AS rr, round(exp(ln(a / (a + b) / (c / (c + d))) - {Z} * sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d))), 6) AS rr_low,
 round((a + z) * (d + z) / ((b + z) * (c + z)), 6) AS odds_ratio, round(exp(ln((a + z) * (d + z) / ((b + z) * (c + z))) + {Z} * sqrt(1 / (a + z) + 1 / (b + z) + 1 / (c + z) + 1 / (d + z))), 6) AS or_high FROM h""")  # fmt: skip
def st_rr_or(spark, sf_dir):
    """Risk ratio, and odds ratio with a half added to all cells only where one is empty."""
    a, b, c, d = (F.col(x) for x in "abcd")
    z = F.when(F.least(a, b, c, d) == 0, 0.5).otherwise(0.0)
    rr, odds = a / (a + b) / (c / (c + d)), (a + z) * (d + z) / ((b + z) * (c + z))
    rr_low = F.exp(F.log(rr) - Z * F.sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d)))
    or_high = F.exp(F.log(odds) + Z * F.sqrt(1 / (a + z) + 1 / (b + z) + 1 / (c + z) + 1 / (d + z)))
    return two_by_two(spark, sf_dir).select("arm", F.round(rr, 6).alias("rr"), F.round(rr_low, 6).alias("rr_low"), F.round(odds, 6).alias("odds_ratio"), F.round(or_high, 6).alias("or_high"))


@query("st_five_scales", f"""WITH {OUTCOMES}, {TABLE22} SELECT arm, round(100 * (c / (c + d) - a / (a + b)), 6) AS gap_pp, round(b / (a + b) / (d / (c + d)), 6) AS rr_out, round(a / (a + b) / (c / (c + d)), 6) AS rr_in, round(b * c / (a * d), 6) AS odds_ratio,
 b::BIGINT AS excluded, round(b / (b + d), 6) AS share_of_excluded, round(b / (b + d) / ((a + b) / (a + b + c + d)), 6) AS lift FROM t22""")  # fmt: skip
def st_five_scales(spark, sf_dir):
    a, b, c, d = (F.col(x) for x in "abcd")
    r = lambda x, n: F.round(x, 6).alias(n)
    return two_by_two(spark, sf_dir).select("arm", r(100 * (c / (c + d) - a / (a + b)), "gap_pp"), r(b / (a + b) / (d / (c + d)), "rr_out"), r(a / (a + b) / (c / (c + d)), "rr_in"), r(b * c / (a * d), "odds_ratio"), b.alias("excluded"), r(b / (b + d), "share_of_excluded"), r(b / (b + d) / ((a + b) / (a + b + c + d)), "lift"))


#: The two-sided 95 % points of Student's t by degrees of freedom.
T95 = [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228]


@query("st_seed_t", f"""WITH {OUTCOMES}, h AS (SELECT arm, seed, 100.0 * count(*) FILTER (state = 'SHELTERED') / count(*) AS pct FROM outcomes GROUP BY arm, seed), s AS (SELECT arm, count(*) AS n, avg(pct) AS m, stddev_samp(pct) / sqrt(count(*)) AS se FROM h GROUP BY arm)
SELECT arm, n, round(m, 6) AS mean, round(m - se * coalesce([{', '.join(map(str, T95))}][n - 1], 1.96), 6) AS low, round(m + se * coalesce([{', '.join(map(str, T95))}][n - 1], 1.96), 6) AS high FROM s""")  # fmt: skip
def st_seed_t(spark, sf_dir):
    h = outcomes(spark, sf_dir).groupBy("arm", "seed").agg((100 * F.count_if(F.col("state") == "SHELTERED") / F.count(F.lit(1))).alias("pct"))
    s = h.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.avg("pct").alias("m"), (F.stddev_samp("pct") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    t = F.coalesce(F.get(F.array(*map(F.lit, T95)), (F.col("n") - 2).cast("int")), F.lit(1.96))
    return s.select("arm", "n", F.round("m", 6).alias("mean"), F.round(F.col("m") - F.col("se") * t, 6).alias("low"), F.round(F.col("m") + F.col("se") * t, 6).alias("high"))


@query("st_two_sample_z", f"""WITH {OUTCOMES}, s AS (SELECT arm, avg(dose_ug) FILTER (asthma) AS m1, var_samp(dose_ug) FILTER (asthma) AS v1, count(*) FILTER (asthma) AS n1, avg(dose_ug) FILTER (NOT asthma) AS m0, var_samp(dose_ug) FILTER (NOT asthma) AS v0, count(*) FILTER (NOT asthma) AS n0 FROM outcomes GROUP BY arm)
SELECT arm, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 5) AS z, abs((m1 - m0) / sqrt(v1 / n1 + v0 / n0)) <= 3 AS ok FROM s""")  # fmt: skip
def st_two_sample_z(spark, sf_dir):
    """The negative control: asthma must not matter for the dose."""
    x1, x0 = F.when(F.col("asthma"), F.col("dose_ug")), F.when(~F.col("asthma"), F.col("dose_ug"))
    s = outcomes(spark, sf_dir).groupBy("arm").agg(((F.avg(x1) - F.avg(x0)) / F.sqrt(F.var_samp(x1) / F.count(x1) + F.var_samp(x0) / F.count(x0))).alias("z"))
    return s.select("arm", F.round("z", 5).alias("z"), (F.abs("z") <= 3).alias("ok"))


@query("st_binom_gate", f"WITH {OUTCOMES}, s AS (SELECT arm, count(*) AS n, avg(copd::INT) AS p FROM outcomes GROUP BY arm) SELECT arm, round(p, 6) AS p, round((p - 1 / 13.0) / sqrt(1 / 13.0 * 12 / 13.0 / n), 5) AS z, abs(p - 1 / 13.0) <= 3 * sqrt(1 / 13.0 * 12 / 13.0 / n) AS ok FROM s")
def st_binom_gate(spark, sf_dir, expected: float = 1 / 13):
    s = outcomes(spark, sf_dir).groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("copd").cast("int")).alias("p"))
    se = F.sqrt(F.lit(expected * (1 - expected)) / F.col("n"))
    return s.select("arm", F.round("p", 6).alias("p"), F.round((F.col("p") - expected) / se, 5).alias("z"), (F.abs(F.col("p") - expected) <= 3 * se).alias("ok"))


@query("st_benefit_allocation", f"""WITH {OUTCOMES}, h AS (SELECT arrive_tick // 1440 AS day, avg(dose_ug) FILTER (arm = '1') AS x, avg(dose_ug) FILTER (arm = '2') AS y FROM outcomes GROUP BY day),
s AS (SELECT day, coalesce(x, 0) - coalesce(y, 0) AS b FROM h) SELECT day, round(b, 4) AS benefit, round(b / sum(abs(b)) OVER (), 5) AS share FROM s""")  # fmt: skip
def st_benefit_allocation(spark, sf_dir):
    x = lambda a: F.coalesce(F.avg(F.when(F.col("arm") == a, F.col("dose_ug"))), F.lit(0.0))
    h = outcomes(spark, sf_dir).groupBy(F.floor(F.col("arrive_tick") / 1440).alias("day")).agg((x("1") - x("2")).alias("b"))
    total = F.broadcast(h.agg(F.sum(F.abs("b")).alias("t")))
    return h.join(total).select("day", F.round("b", 4).alias("benefit"), F.round(F.col("b") / F.col("t"), 5).alias("share"))


@query("st_retry", f"WITH {OUTCOMES} SELECT arm, round(avg((state = 'SHELTERED')::INT) FILTER (depart_tick > 200), 6) AS retry_share FROM outcomes GROUP BY arm")
def st_retry(spark, sf_dir):
    """The share of those who were refused once and still got in."""
    return outcomes(spark, sf_dir).groupBy("arm").agg(F.round(F.avg(F.when(F.col("depart_tick") > 200, (F.col("state") == "SHELTERED").cast("int"))), 6).alias("retry_share"))


FEATURES = ["mobility_limited", "asthma", "copd", "chronic"]


@query("st_design", f"WITH {OUTCOMES} SELECT person_id, [1.0::DOUBLE, {', '.join(f'{f}::INT::DOUBLE' for f in FEATURES)}, (age_years - 50) / 10.0::DOUBLE] AS x FROM outcomes")
def st_design(spark, sf_dir):
    return design(outcomes(spark, sf_dir)).select("person_id", "x")


def design(o: DataFrame) -> DataFrame:
    return o.withColumn("x", F.array(F.lit(1.0), *(F.col(f).cast("double") for f in FEATURES), (F.col("age_years") - 50) / 10.0))


def moments(df: DataFrame, k: int, weight: Column, y: Column):
    """X'WX and X'Wy in one aggregate; the driver gets k * (k + 1) numbers."""
    import numpy as np

    xx = [F.sum(weight * F.col("x")[i] * F.col("x")[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
    row = df.agg(*xx, *(F.sum(weight * F.col("x")[i] * y).alias(f"b{i}") for i in range(k)), F.sum(weight * y * y).alias("yy"), F.count(F.lit(1)).alias("n"), F.sum(weight * y).alias("sy")).first()
    a = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    return a, np.array([row[f"b{i}"] for i in range(k)], float), row


@query("st_ols")
def st_ols(spark, sf_dir):
    """Least squares of dose on the design: term, estimate, standard error, R squared."""
    import numpy as np

    d = design(outcomes(spark, sf_dir)).select("x", "dose_ug")
    k = 2 + len(FEATURES)
    a, b, row = moments(d, k, F.lit(1.0), F.col("dose_ug"))
    beta = np.linalg.solve(a, b)
    rss = row.yy - beta @ b
    se = np.sqrt(np.diag(np.linalg.inv(a)) * rss / (row.n - k))
    r2 = 1 - rss / (row.yy - row.sy**2 / row.n)
    return spark.createDataFrame([(t, float(x), float(s), float(r2)) for t, x, s in zip(["intercept", *FEATURES, "age"], beta, se)], "term string, estimate double, se double, r2 double")


@query("st_logit")
def st_logit(spark, sf_dir, rounds: int = 25):
    """Logistic regression by reweighted least squares: each round is one aggregate of X'WX over the table."""
    import numpy as np

    d = design(outcomes(spark, sf_dir)).select("x", (F.col("state") == "SHELTERED").cast("double").alias("y")).cache()
    k, beta = 2 + len(FEATURES), np.zeros(2 + len(FEATURES))
    for _ in range(rounds):
        u = reduce(lambda s, i: s + F.lit(float(beta[i])) * F.col("x")[i], range(k), F.lit(0.0))
        p = 1 / (1 + F.exp(-u))
        w = p * (1 - p)
        a, b, _ = moments(d, k, w, u + (F.col("y") - p) / w)
        new = np.linalg.solve(a, b)
        done = np.abs(new - beta).max() < 1e-10
        beta = new
        if done:
            break
    se = np.sqrt(np.diag(np.linalg.inv(a)))
    d.unpersist()
    return spark.createDataFrame([(t, float(x), float(s), float(x / s)) for t, x, s in zip(["intercept", *FEATURES, "age"], beta, se)], "term string, estimate double, se double, z double")


@query("agg_freeway_bytype", "SELECT l_returnflag AS type, count(*) AS n, round(sum(l_quantity) / 1000, 4) AS km FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY l_returnflag")
def agg_freeway_bytype(spark, sf_dir):
    """What the freeway filter leaves out, by type."""
    return read(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "N")).groupBy(F.col("l_returnflag").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity") / 1000, 4).alias("km"))


@query("flt_freeway", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')")
def flt_freeway(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").where(~F.col("l_returnflag").isin("A", "N")).select("l_orderkey", "l_linenumber", "l_quantity")
