"""Projections, small functions, transforms and checks of the study's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteward.catalog import query
from siteward.functions.ranks import numbered, running
from siteward.operators.admission import HAVERSINE, haversine
from siteward.operators.relations import _uniform_sql, norm_name, uniform
from siteward.operators.stand_ins import ARRIVALS, MONITORS, OUTCOMES, PEOPLE, SITES, arrivals, monitors, outcomes, people, read, sites
from siteward.session import discard, materialize

# Names of states, and of the classes of a daily series with their bounds in ug/m3.
STATE_NAMES = {"SHELTERED": "Got inside", "REFUSED_ALL_FULL": "Turned away", "UNREACHABLE": "Could not reach"}
CATEGORIES = [("good", 0.0, 12.0), ("moderate", 12.1, 35.4), ("usg", 35.5, 55.4), ("unhealthy", 55.5, 150.4), ("very_unhealthy", 150.5, 250.4), ("hazardous", 250.5, 500.4)]
#: A day's shape by hour, divided by its mean.
_SHAPE = (1.15, 1.18, 1.20, 1.20, 1.18, 1.14, 1.08, 1.00, 0.92, 0.85, 0.80, 0.78, 0.77, 0.78, 0.82, 0.87, 0.93, 0.99, 1.05, 1.10, 1.13, 1.15, 1.16, 1.17)
DIURNAL = [x / (sum(_SHAPE) / len(_SHAPE)) for x in _SHAPE]


def label(c: Column, names: dict[str, str]) -> Column:
    """The name of a code, or the code where it has none."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in names.items() for x in p)), c), c)


@query("prj_case_map", f"WITH {OUTCOMES} SELECT person_id, CASE state WHEN 'SHELTERED' THEN 'Got inside' WHEN 'UNREACHABLE' THEN 'Could not reach' ELSE state END AS outcome FROM outcomes")
def prj_case_map(spark, sf_dir):
    """Codes to names, others as they are."""
    return outcomes(spark, sf_dir).select("person_id", label(F.col("state"), {k: v for k, v in STATE_NAMES.items() if k != "REFUSED_ALL_FULL"}).alias("outcome"))


@query("prj_hazard_vuln", f"WITH {OUTCOMES} SELECT person_id, copd OR asthma OR age_years >= 65 OR mobility_limited AS hazard, age_years >= 55 OR mobility_limited OR asthma OR copd OR chronic AS vulnerable FROM outcomes WHERE (copd OR asthma OR age_years >= 65 OR mobility_limited) <> (age_years >= 55 OR mobility_limited OR asthma OR copd OR chronic)")
def prj_hazard_vuln(spark, sf_dir):
    """Those whom the hazard's and the report's vulnerability tell apart."""
    hazard, vulnerable = "copd OR asthma OR age_years >= 65 OR mobility_limited", "age_years >= 55 OR mobility_limited OR asthma OR copd OR chronic"
    return outcomes(spark, sf_dir).select("person_id", F.expr(hazard).alias("hazard"), F.expr(vulnerable).alias("vulnerable")).where("hazard != vulnerable")


@query("prj_duplicate_legacy", f"WITH {OUTCOMES} SELECT person_id, age_years, asthma, copd, age_years AS age, asthma AS has_asthma, copd AS has_copd FROM outcomes")
def prj_duplicate_legacy(spark, sf_dir):
    """Three columns under their old names as well."""
    return outcomes(spark, sf_dir).select("person_id", "age_years", "asthma", "copd", F.col("age_years").alias("age"), F.col("asthma").alias("has_asthma"), F.col("copd").alias("has_copd"))


@query("prj_units", f"WITH {OUTCOMES} SELECT person_id, round(distance_m / 1000, 2) AS km, round((arrive_tick - depart_tick) / 60.0, 1) AS hours FROM outcomes")
def prj_units(spark, sf_dir):
    return outcomes(spark, sf_dir).select("person_id", F.round(F.col("distance_m") / 1000, 2).alias("km"), F.round((F.col("arrive_tick") - F.col("depart_tick")) / 60.0, 1).alias("hours"))


@query("flt_county", f"WITH {MONITORS} SELECT monitor_id, ts, c FROM monitors WHERE lower(county) = lower('PURCHASE')")
def flt_county(spark, sf_dir):
    return monitors(spark, sf_dir).where(F.lower("county") == F.lower(F.lit("PURCHASE"))).select("monitor_id", "ts", "c")


@query("flt_county_envelope", f"WITH {PEOPLE} SELECT person_id, lon, lat FROM people WHERE lon BETWEEN -122.93 AND -121.82 AND lat BETWEEN 45.43 AND 45.73")
def flt_county_envelope(spark, sf_dir):
    """Places inside a county's box; others are bad geocodes."""
    return people(spark, sf_dir).where("lon BETWEEN -122.93 AND -121.82 AND lat BETWEEN 45.43 AND 45.73").select("person_id", "lon", "lat")


@query("fn_haversine", f"WITH p AS (SELECT c_custkey AS person_id, (-123 + c_custkey % 97 / 100.0)::FLOAT::DOUBLE AS lon, (45 + c_custkey % 89 / 100.0)::FLOAT::DOUBLE AS lat FROM customer), s AS (SELECT -122.68::DOUBLE AS lon, 45.52::DOUBLE AS lat) SELECT person_id, round({HAVERSINE}, 3) AS metres FROM p, s")
def fn_haversine(spark, sf_dir):
    """Great-circle metres; single-precision coordinates are made double before anything else."""
    k = F.col("c_custkey")
    lon, lat = ((F.lit(a) + k % m / 100.0).cast("float").cast("double") for a, m in ((-123, 97), (45, 89)))
    return read(spark, sf_dir, "customer").select(k.alias("person_id"), F.round(haversine(lon, lat, F.lit(-122.68), F.lit(45.52)), 3).alias("metres"))


@query("fn_date_parse", "SELECT o_orderkey, date_trunc('minute', o_orderdate + to_minutes((o_orderkey % 1440)::INT)) AS at FROM orders")
def fn_date_parse(spark, sf_dir):
    """A day and a time of which the first five characters count."""
    at = F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.date_format(at, "yyyy-MM-dd").alias("day"), F.concat(F.date_format(at, "HH:mm"), F.lit(":59.7")).alias("time"))
    return o.select("o_orderkey", F.to_timestamp_ntz(F.concat_ws(" ", "day", F.substring("time", 1, 5)), F.lit("yyyy-MM-dd HH:mm")).alias("at"))


@query("fn_decay", "SELECT p_partkey, round(pow(2.0, -1.0 / p_size), 9) AS factor FROM part")
def fn_decay(spark, sf_dir):
    """What an hour leaves of a quantity that halves in so many."""
    return read(spark, sf_dir, "part").select("p_partkey", F.round(F.pow(F.lit(2.0), -1.0 / F.col("p_size")), 9).alias("factor"))


def within_category(category: Column, position: Column) -> Column:
    """The value at a position from 0 to 1 between a category's bounds; null for other categories."""
    return reduce(lambda c, r: c.when(category == r[0], F.lit(r[1]) + position * F.lit(r[2] - r[1])), CATEGORIES[1:], F.when(category == CATEGORIES[0][0], F.lit(CATEGORIES[0][1]) + position * F.lit(CATEGORIES[0][2] - CATEGORIES[0][1])))


_CATS = f"cats(k, name, lo, hi) AS (VALUES {', '.join(f"({k}, '{n}', {lo}::DOUBLE, {hi}::DOUBLE)" for k, (n, lo, hi) in enumerate(CATEGORIES))})"


@query("fn_category_interp", f"WITH {_CATS} SELECT n_nationkey, name AS category, round(lo + n_nationkey / 25.0::DOUBLE * (hi - lo), 6) AS c FROM nation JOIN cats ON k = n_nationkey % 6")
def fn_category_interp(spark, sf_dir):
    name = F.get(F.array(*(F.lit(c[0]) for c in CATEGORIES)), F.col("n_nationkey") % 6)
    return read(spark, sf_dir, "nation").select("n_nationkey", name.alias("category")).select("n_nationkey", "category", F.round(within_category(F.col("category"), F.col("n_nationkey") / 25.0), 6).alias("c"))


@query("src_category_series", f"WITH {_CATS}, d AS (SELECT n_nationkey AS day, round(lo + CASE WHEN n_nationkey = 13 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END * (hi - lo), 1) AS c FROM nation JOIN cats ON k = n_nationkey % 6) SELECT day, h AS hour, round(c * ([{', '.join(f'{x!r}::DOUBLE' for x in DIURNAL)}])[h + 1], 6) AS c FROM d, range(24) AS g(h)")
def src_category_series(spark, sf_dir):
    """An hourly series from days' categories: a place in the category, times the day's shape."""
    k = F.col("n_nationkey")
    name = F.get(F.array(*(F.lit(c[0]) for c in CATEGORIES)), k % 6)
    d = read(spark, sf_dir, "nation").select(k.alias("day"), F.round(within_category(name, F.when(k == 13, 0.8).otherwise(0.5)), 1).alias("c"))
    return d.select("day", "c", F.posexplode(F.array(*map(F.lit, DIURNAL))).alias("hour", "f")).select("day", F.col("hour").cast("long").alias("hour"), F.round(F.col("c") * F.col("f"), 6).alias("c"))


@query("fn_escape", """SELECT o_orderkey, '{"note":"a \\"' || o_orderstatus || '\\"\\n' || o_orderkey || '"}' AS json, replace('x, ' || o_orderpriority || ',y', ',', ' ') AS csv FROM orders""")
def fn_escape(spark, sf_dir):
    """Text made safe: quotes and line ends for JSON, commas for CSV."""
    note = F.concat(F.lit('a "'), "o_orderstatus", F.lit('"\n'), F.col("o_orderkey").cast("string"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(note.alias("note"))).alias("json"), F.replace(F.concat(F.lit("x, "), "o_orderpriority", F.lit(",y")), F.lit(","), F.lit(" ")).alias("csv"))


#: Columns that hold wall-clock times.
WALL_CLOCK = r"(^|_)(time|date|wall|timestamp)(_|$)|date$"


_KEPT = {"orders": ["o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"], "events": ["event_id", "event_type", "props", "ts", "user_id", "value"]}


@query("fn_regex_excl_cols", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count({c}) AS filled, count(DISTINCT {c}) AS different FROM {t}" for t, names in _KEPT.items() for c in names))
def fn_regex_excl_cols(spark, sf_dir):
    """What a comparison looks at: of each column whose name does not say that it holds times, how many rows have it and how many
    values differ. Each table is read once, the kept columns only; values are told apart by their text."""
    import re

    out = []
    for t in _KEPT:
        df = read(spark, sf_dir, t)
        kept = [c for c in df.columns if not re.search(WALL_CLOCK, c)]
        cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in kept))).alias("c")).select("c.*")
        values = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))  # partly before the shuffle
        of = values.groupBy("column").agg(F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("filled"), F.count("value").alias("different"))
        out.append(of.select(F.lit(t).alias("table"), "column", "filled", "different"))
    return out[0].unionByName(out[1])


@query("win_seq_number", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS number FROM orders")
def win_seq_number(spark, sf_dir):
    """Numbers in the order of creation, over ranges of it and not in one window."""
    return numbered(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "number")


FLAGS = ("mobility_limited", "asthma", "copd", "chronic")


@query("st_marginal_or", f"WITH {OUTCOMES}, g AS (" + " UNION ALL ".join(f"SELECT arm, '{f}' AS flag, count(*) FILTER ({f} AND state = 'SHELTERED') AS a, count(*) FILTER ({f} AND state <> 'SHELTERED') AS b, count(*) FILTER (NOT {f} AND state = 'SHELTERED') AS c, count(*) FILTER (NOT {f} AND state <> 'SHELTERED') AS d FROM outcomes GROUP BY arm" for f in FLAGS) + ") SELECT arm, flag, round(a::DOUBLE * d / nullif(b::DOUBLE * c, 0), 6) AS odds_ratio FROM g")
def st_marginal_or(spark, sf_dir):
    """Odds ratios without regard to anything else; null where a cell of the divisor is empty."""
    inside = F.col("state") == "SHELTERED"
    cells = [F.count_if(x).alias(f"{f}_{k}") for f in FLAGS for k, x in enumerate((F.col(f) & inside, F.col(f) & ~inside, ~F.col(f) & inside, ~F.col(f) & ~inside))]
    g = outcomes(spark, sf_dir).groupBy("arm").agg(*cells)
    of = lambda f: F.try_divide(F.col(f"{f}_0").cast("double") * F.col(f"{f}_3"), F.col(f"{f}_1").cast("double") * F.col(f"{f}_2"))
    return g.select("arm", F.explode(F.array(*(F.struct(F.lit(f).alias("flag"), F.round(of(f), 6).alias("odds_ratio")) for f in FLAGS))).alias("r")).select("arm", "r.*")


# Shares of the age bands, mobility limits under and from 55 years on, and the share that they should give.
BAND_SHARES, P_UNDER, P_OVER, P_ALL = (0.527, 0.423, 0.050), 0.1522, 0.3478, 0.192


@query("st_mixture_check", f"""WITH {OUTCOMES}, n AS (SELECT arm, count(*)::DOUBLE AS n, avg((age_years >= 55)::INT) AS older, avg(mobility_limited::INT) AS realised, avg((asthma OR copd OR chronic OR mobility_limited)::INT) AS any_flag,
  1 - (1 - avg(asthma::INT)) * (1 - avg(copd::INT)) * (1 - avg(chronic::INT)) * (1 - avg(mobility_limited::INT)) AS union_of FROM outcomes GROUP BY arm),
m AS (SELECT *, (1 - older) * {P_UNDER}::DOUBLE + older * {P_OVER}::DOUBLE AS implied FROM n)
SELECT arm, round(implied, 6) AS implied, round(sqrt(implied * (1 - implied) / n), 6) AS se, abs(implied - {P_ALL}::DOUBLE) > 2 * sqrt(implied * (1 - implied) / n) AS off, round({P_ALL}::DOUBLE / ((1 - older) + {P_OVER / P_UNDER!r}::DOUBLE * older), 6) AS p_under_fixed,
  round((realised - (1 - realised) * 0) * 0.95::DOUBLE + (1 - realised) * 1.35::DOUBLE, 6) AS mean_speed, round(any_flag - union_of, 6) AS dependence FROM m""")  # fmt: skip
def st_mixture_check(spark, sf_dir):
    """Closed forms against shares: the limit that the conditional ones imply, what would mend them, a mixture's mean speed, and by
    how much a union of flags is not that of independent ones."""
    share = lambda c: F.avg(c.cast("int"))
    flags = [F.col(c) for c in ("asthma", "copd", "chronic", "mobility_limited")]
    n = outcomes(spark, sf_dir).groupBy("arm").agg(F.count(F.lit(1)).cast("double").alias("n"), share(F.col("age_years") >= 55).alias("older"), share(F.col("mobility_limited")).alias("realised"), share(reduce(lambda a, b: a | b, flags)).alias("any_flag"), (1 - reduce(lambda a, b: a * b, (1 - share(f) for f in flags))).alias("union_of"))
    m = n.withColumn("implied", (1 - F.col("older")) * P_UNDER + F.col("older") * P_OVER)
    se = F.sqrt(F.col("implied") * (1 - F.col("implied")) / F.col("n"))
    fixed = P_ALL / ((1 - F.col("older")) + P_OVER / P_UNDER * F.col("older"))
    return m.select("arm", F.round("implied", 6).alias("implied"), F.round(se, 6).alias("se"), (F.abs(F.col("implied") - P_ALL) > 2 * se).alias("off"), F.round(fixed, 6).alias("p_under_fixed"), F.round(F.col("realised") * 0.95 + (1 - F.col("realised")) * 1.35, 6).alias("mean_speed"), F.round(F.col("any_flag") - F.col("union_of"), 6).alias("dependence"))


@query("tx_policy_join", "SELECT s_suppkey, s_name, CASE n_regionkey WHEN 0 THEN 'admit' WHEN 1 THEN 'refuse' ELSE '' END AS pet_intake FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey < 2")
def tx_policy_join(spark, sf_dir):
    """Policies by names that are written differently on both sides; sites without one keep a blank."""
    n = read(spark, sf_dir, "nation").where("n_regionkey < 2").select(norm_name(F.concat(F.lit("The "), "n_name", F.lit(" House!"))).alias("k"), F.when(F.col("n_regionkey") == 0, "admit").otherwise("refuse").alias("pet_intake"))
    all_ = read(spark, sf_dir, "nation").select("n_nationkey", norm_name(F.concat(F.lit("the-"), F.upper("n_name"), F.lit(" house"))).alias("k"))
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("n_nationkey")).join(all_, "n_nationkey", "left")
    return s.join(n, "k", "left").select("s_suppkey", "s_name", F.coalesce("pet_intake", F.lit("")).alias("pet_intake"))


def person_sheet(o: DataFrame) -> DataFrame:
    """A person and run in words and round numbers."""
    yes = lambda c: F.when(F.col(c), "yes").otherwise("no")
    return o.select(
        F.col("person_id").alias("Person"),
        F.concat(F.lit("Scenario "), F.col("arm")).alias("Scenario"),
        F.col("seed").alias("Seed"),
        label(F.col("state"), STATE_NAMES).alias("Outcome"),
        F.col("age_years").alias("Age"),
        yes("mobility_limited").alias("Limited mobility"),
        F.round(F.col("distance_m") / 1000, 2).alias("Walk (km)"),
        F.round("dose_ug", 0).cast("long").alias("Inhaled dose (ug)"),
    )


_SHEET = "SELECT person_id AS \"Person\", 'Scenario ' || arm AS \"Scenario\", seed AS \"Seed\", CASE state WHEN 'SHELTERED' THEN 'Got inside' WHEN 'REFUSED_ALL_FULL' THEN 'Turned away' WHEN 'UNREACHABLE' THEN 'Could not reach' ELSE state END AS \"Outcome\", age_years AS \"Age\", CASE WHEN mobility_limited THEN 'yes' ELSE 'no' END AS \"Limited mobility\", round(distance_m / 1000, 2) AS \"Walk (km)\", round(dose_ug, 0)::BIGINT AS \"Inhaled dose (ug)\" FROM outcomes"


@query("tx_person_sheet", f"WITH {OUTCOMES} {_SHEET}")
def tx_person_sheet(spark, sf_dir):
    return person_sheet(outcomes(spark, sf_dir))


def absorb(demand: DataFrame, where: DataFrame) -> DataFrame:
    """(group_id, site_id, units, dist_m): demand (group_id, lon, lat, units), the largest first, of equals the least id, takes what it
    needs of the nearest site (site_id, lon, lat, capacity) with room, of equals the least id, and goes on to the next; what finds
    no room is left out. Rounds: each group takes along its whole list what those before it left by the last round. The first
    group is right at once, another one a round after those before it, so that rounds are as many as groups at most, and few
    where they seldom meet."""
    sites_ = where.select("site_id", F.col("lon").alias("s_lon"), F.col("lat").alias("s_lat"), F.col("capacity").cast("long").alias("capacity")).where("capacity > 0")
    ranked = materialize(numbered(demand.withColumn("_neg", -F.col("units")), [], ["_neg", "group_id"], "rank").drop("_neg"), "demand")
    ranked = running(ranked, [], ["rank"], "units", "others")
    pairs = sites_.crossJoin(F.broadcast(ranked)).withColumn("d", F.round(haversine(F.col("lon"), F.col("lat"), F.col("s_lon"), F.col("s_lat")), 6))
    pairs = materialize(pairs.select("group_id", "rank", "units", "others", "site_id", "capacity", "d"), "choices")
    # Those before a group take no more than they need: beyond what all of them and it need, nothing is asked for.
    pairs = running(pairs, ["group_id"], ["d", "site_id"], "capacity", "nearer").where("nearer < others + units")
    now = materialize(pairs.select("group_id", "rank", "units", "site_id", "capacity", "d", F.lit(0).cast("long").alias("given")), "given")
    while True:
        left = running(now, ["site_id"], ["rank"], "given", "before").withColumn("room", F.greatest(F.lit(0), F.col("capacity") - F.col("before")))
        took = running(left, ["group_id"], ["d", "site_id"], "room", "ahead")
        given = F.greatest(F.lit(0), F.least(F.col("room"), F.col("units") - F.col("ahead")))
        new = materialize(took.select("group_id", "rank", "units", "site_id", "capacity", "d", given.alias("given"), (given != F.col("given")).alias("changed")), "given")
        discard(now)
        if new.where("changed").isEmpty():
            return new.where("given > 0").select("group_id", "site_id", F.col("given").alias("units"), F.col("d").alias("dist_m"))
        now = new.drop("changed")
        now._siteward_path = new._siteward_path


@query("st_greedy_absorb")
def st_greedy_absorb(spark, sf_dir):
    """The people of each square of 0.1 degrees and what the sites take of them."""
    p = people(spark, sf_dir).groupBy(F.floor(F.col("lon") * 10).alias("x"), F.floor(F.col("lat") * 10).alias("y")).agg(F.count(F.lit(1)).alias("units"))
    d = p.select((F.col("x") * 10_000 + F.col("y")).alias("group_id"), (F.col("x") / 10 + 0.05).alias("lon"), (F.col("y") / 10 + 0.05).alias("lat"), "units")
    return absorb(d, sites(spark, sf_dir).where("operating AND capacity IS NOT NULL"))


#: Closures of a run: blockages, pushes, reroutes and stuck events as the driver's table has them.
_SE = "se AS (SELECT l_suppkey % 3 AS run, l_linenumber % 3 AS pushes, l_partkey % 2 AS reroutes, l_linenumber % 3 + l_partkey % 2 + (l_orderkey % 977 = 0)::INT AS blockages, CASE WHEN l_orderkey % 4 = 0 AND l_linenumber % 3 > 0 THEN 1 ELSE 0 END AS stuck, l_linenumber * 24 AS hour, least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b FROM lineitem)"


@query(
    "chk_se",
    f"""WITH {_SE}, r AS (SELECT run, count(*) AS n, count(*) FILTER (blockages <> pushes + reroutes) AS undecided, count(*) FILTER (stuck > pushes) AS too_stuck, sum(stuck)::DOUBLE AS stuck, sum((pushes > 0)::INT)::DOUBLE AS pushers, count(DISTINCT hour) AS waves, max(hour) AS last_hour,
  count(DISTINCT (a, b)) AS pairs FROM se GROUP BY run)
SELECT run, 'one decision a blockage' AS name, undecided = 0 AS ok, undecided::DOUBLE AS detail FROM r UNION ALL SELECT run, 'stuck only after a push', too_stuck = 0, too_stuck::DOUBLE FROM r
UNION ALL SELECT run, 'share stuck', abs(stuck / pushers - 0.25) <= 3 * sqrt(0.25 * 0.75 / pushers) + 0.0005, round(stuck / pushers, 6) FROM r UNION ALL SELECT run, 'waves', waves = 7, waves::DOUBLE FROM r UNION ALL SELECT run, 'within the run', last_hour < 456, last_hour::DOUBLE FROM r UNION ALL SELECT run, 'distinct pairs', pairs <= n, pairs::DOUBLE FROM r""",
)
def chk_se(spark, sf_dir, p_stuck: float = 0.25, waves: int = 7, hours: int = 456):
    """A closure run's counters and schedule: every blockage one decision, stuck only after a push and as often as it should be,
    the waves, and the pairs."""
    li = read(spark, sf_dir, "lineitem")
    push, other = F.col("l_linenumber") % 3, F.col("l_partkey") % 2
    se = li.select((F.col("l_suppkey") % 3).alias("run"), push.alias("pushes"), other.alias("reroutes"), (push + other + (F.col("l_orderkey") % 977 == 0).cast("int")).alias("blockages"), F.when((F.col("l_orderkey") % 4 == 0) & (push > 0), 1).otherwise(0).alias("stuck"), (F.col("l_linenumber") * 24).alias("hour"), F.least("l_suppkey", "l_partkey").alias("a"), F.greatest("l_suppkey", "l_partkey").alias("b"))
    r = se.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("blockages") != F.col("pushes") + F.col("reroutes")).alias("undecided"), F.count_if(F.col("stuck") > F.col("pushes")).alias("too_stuck"), F.sum("stuck").cast("double").alias("stuck"), F.count_if(F.col("pushes") > 0).cast("double").alias("pushers"), F.count_distinct("hour").alias("waves"), F.max("hour").alias("last"), F.count_distinct(F.struct("a", "b")).alias("pairs"))
    share = F.col("stuck") / F.col("pushers")
    tests = [
        ("one decision a blockage", F.col("undecided") == 0, F.col("undecided")),
        ("stuck only after a push", F.col("too_stuck") == 0, F.col("too_stuck")),
        ("share stuck", F.abs(share - p_stuck) <= 3 * F.sqrt(F.lit(p_stuck * (1 - p_stuck)) / F.col("pushers")) + 0.0005, F.round(share, 6)),
        ("waves", F.col("waves") == waves, F.col("waves")),
        ("within the run", F.col("last") < hours, F.col("last")),
        ("distinct pairs", F.col("pairs") <= F.col("n"), F.col("pairs")),
    ]
    return r.select("run", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), ok.alias("ok"), d.cast("double").alias("detail")) for n, ok, d in tests))).alias("c")).select("run", "c.*")


#: Waves of a schedule: (wave, activation hour, named streets), attempts, and the share of nodes that may be cut off.
WAVES, ATTEMPTS, MAY_LOSE = [(1, 4, 2), (2, 120, 3), (3, 300, 3)], 25, 0.02


def draw_closures(pool: DataFrame, edges: DataFrame, nodes: DataFrame, seed: int, waves=tuple(WAVES), attempts: int = ATTEMPTS, may_lose: float = MAY_LOSE) -> DataFrame:
    """(wave, activation_hour, name, seq, a, b, attempt): distinct names of the pool (name, seq, a, b) for each wave and one edge of
    each name, by hashes of (seed, attempt); drawn anew, `attempts` times at most, until all of them together cut off no more than
    that share of the nodes, or one, from the largest component of the edges (a, b)."""
    from siteward.operators.graph import components

    total = sum(n for *_, n in waves)
    largest = lambda e: components(e).groupBy("component").count().agg(F.max("count")).first()[0] or 0
    before = largest(edges)
    for attempt in range(1, attempts + 1):
        one = pool.groupBy("name").agg(F.min_by(F.struct("seq", "a", "b"), F.struct(uniform(seed, f"edge-{attempt}", F.col("name"), F.col("seq")), "seq")).alias("e"))
        drawn = one.withColumn("u", uniform(seed, f"name-{attempt}", F.col("name"))).orderBy("u", "name").limit(total)
        cut = materialize(numbered(drawn, [], ["u", "name"]).select("name", "number", "e.*"), "closures")
        if cut.count() < total:
            raise ValueError(f"{total} names are needed; the pool has fewer")
        left = edges.join(cut.select("a", "b"), ["a", "b"], "left_anti")
        if before - largest(left) <= max(may_lose * before, 1):
            bounds = [sum(n for *_, n in waves[: k + 1]) for k in range(len(waves))]
            pick = lambda values: reduce(lambda c, k: c.when(F.col("number") < bounds[k], values[k]), range(1, len(waves)), F.when(F.col("number") < bounds[0], values[0]))
            return cut.select(pick([w for w, *_ in waves]).alias("wave"), pick([h for _, h, _ in waves]).alias("activation_hour"), "name", "seq", "a", "b", F.lit(attempt).alias("attempt"))
    raise RuntimeError(f"{attempts} draws all cut off too much")


@query("tx_closure_draw")
def tx_closure_draw(spark, sf_dir, seed: int = 1):
    """Named streets, among pairs of one edge, closed in three waves."""
    from siteward.operators.network import graph

    g = graph(spark, sf_dir)
    e = g.edges.where("a != b").select("seq", "name", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    single = e.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.first("seq").alias("seq"), F.first("name").alias("name")).where("n = 1 AND name IS NOT NULL")
    return draw_closures(materialize(single.select("name", "seq", "a", "b"), "pool"), materialize(e.select("a", "b").distinct(), "pairs"), g.nodes, seed)
