"""First-come admission, reserves, apportionment and the access census.

Nothing is replayed on a clock: who is admitted follows from ranks of arrivals, and re-routing from rounds of proposals.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteward.catalog import query
from siteward.functions.ranks import numbered, quantiles
from siteward.operators.field import HOURLY, field_of
from siteward.session import discard, materialize
from siteward.operators.stand_ins import ARRIVALS, COUNTY, PEOPLE, SITES, UNHEALTHY, arrivals, people, sites

EARTH_M = 6_371_000.0
#: Sites that are broadcast to people: beyond, nearest sites come from a grid join.
BROADCAST_SITES = 200
#: People whose candidates are one task's where a ring has nine cells of a site each; fewer where it has more.
PEOPLE_A_TASK = 20_000
#: Tasks of a round at most: with more candidates, tasks sort on disk.
MOST_TASKS = 20_000
#: Sites whose cells are broadcast, about 50 MB; beyond, people and sites are shuffled by cells.
BROADCAST_CELLS = 500_000


def haversine(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle metres."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


HAVERSINE = f"2 * {EARTH_M} * asin(sqrt(least(pow(sin(radians(s.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - p.lon) / 2), 2), 1.0)))"


def nearest_site(who: DataFrame, where: DataFrame, n_sites: int | None = None, cell: float | None = None) -> DataFrame:
    """who with site_id, dist_m of the nearest site by great-circle distance; of equals the least id. Up to BROADCAST_SITES
    sites are one broadcast array of structs, scanned by each person; beyond, sites go into cells of a grid and rings of
    cells are searched outward until no nearer site can lie beyond the ring."""
    n = where.count() if n_sites is None else n_sites
    s = where.select("site_id", F.col("lon").alias("s_lon"), F.col("lat").alias("s_lat"))
    if n <= BROADCAST_SITES:
        listed = F.broadcast(s.agg(F.collect_list(F.struct("site_id", "s_lon", "s_lat")).alias("_all")))  # at most BROADCAST_SITES structs
        dist = F.transform("_all", lambda x: F.struct(F.round(haversine(F.col("lon"), F.col("lat"), x["s_lon"], x["s_lat"]), 6).alias("dist_m"), x["site_id"].alias("site_id")))
        best = who.join(listed).withColumn("_b", F.array_min(dist))
        return best.select(*who.columns, F.col("_b.site_id").alias("site_id"), F.col("_b.dist_m").alias("dist_m"))
    return nearest_by_rings(who, s, cell)


def beyond(reach: float) -> Column:
    """A site `reach` degrees away, by latitude or by the shorter longitude, is at least so many metres from (lon, lat)."""
    return F.radians(F.lit(reach)) * EARTH_M * F.cos(F.radians(F.abs("lat") + reach)) * 0.999


def nearest_by_rings(who: DataFrame, s: DataFrame, cell: float | None = None, metric=haversine, beyond=beyond, allowed: Column | None = None) -> DataFrame:
    """who (person_id, unique; lon, lat, others) with site_id, dist_m of the site (site_id, s_lon, s_lat, others) of least
    metric(lon, lat, s_lon, s_lat), rounded to 6 places, of equals the least id; null where none is `allowed`, a condition on both
    sides' columns. beyond(reach): the least metric of sites more than so many degrees away. Rows without a place are kept, with
    nulls. metric and beyond may use other columns of both sides. cell: degrees; by default such that a site has about one."""
    def into_cells(df: DataFrame, x: str, y: str, names: tuple[str, str]) -> DataFrame:
        return df.withColumns({names[0]: F.floor(F.col(x) / cell), names[1]: F.floor(F.col(y) / cell)})

    cols = who.columns
    s = materialize(s, "ring-sites")
    left = materialize(who, "ring-left")
    box = lambda df, x, y: df.agg(F.min(x), F.max(x), F.min(y), F.max(y), F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()), F.count(F.lit(1))).first()
    a, b = box(left, "lon", "lat"), box(s, "s_lon", "s_lat")
    nowhere = lambda df: df.select(*cols, F.lit(None).cast(s.schema["site_id"].dataType).alias("site_id"), F.lit(None).cast("double").alias("dist_m"))
    if not a[4] or not b[4]:
        return nowhere(left)
    widest = max(max(a[1], b[1]) - min(a[0], b[0]), max(a[3], b[3]) - min(a[2], b[2]))
    crowd = lambda: b[4] / s.select(F.floor(F.col("s_lon") / cell), F.floor(F.col("s_lat") / cell)).distinct().count()
    if cell:
        in_cell = crowd()
    else:
        cell = max(b[1] - b[0], b[3] - b[2], widest / 100, 1e-6) / math.sqrt(b[4])
        # Sites that fill their box unevenly, as a strip does, get smaller cells: one site in each that has any, about.
        cell /= math.sqrt(crowd())
        in_cell = 1
    # Those without a place have no round to wait for.
    done = [nowhere(left.where("lon IS NULL OR lat IS NULL"))] if a[4] < a[5] else []
    left = left.where("lon IS NOT NULL AND lat IS NOT NULL")
    cells, left = into_cells(s, "s_lon", "s_lat", ("cx", "cy")), into_cells(left, "lon", "lat", ("px", "py"))
    # Spark takes a person's cells for one row: without a hint it may broadcast people, many times larger than it believes.
    how = "broadcast" if b[5] <= BROADCAST_CELLS else "merge"
    ring, many = 1, a[4]
    while True:
        # In each round a task has so many candidates, whatever files people come from; they stay there when their sites have been found.
        each = max(9, min(b[4], in_cell * (2 * ring + 1) ** 2))
        left = left.repartition(min(many, MOST_TASKS, math.ceil(many * each / (9 * PEOPLE_A_TASK))), "person_id")
        whole = (ring - 1) * cell > widest  # the ring holds all sites
        offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-ring, ring + 1) for j in range(-ring, ring + 1)))
        probe = left.withColumn("_o", F.explode(offsets)).withColumns({"cx": F.col("px") + F.col("_o.i"), "cy": F.col("py") + F.col("_o.j")})
        near = probe.join(cells.hint(how), ["cx", "cy"]).withColumn("_d", F.struct(F.round(metric(F.col("lon"), F.col("lat"), F.col("s_lon"), F.col("s_lat")), 6).alias("dist_m"), "site_id"))
        if allowed is not None:
            near = near.where(allowed)
        best = near.groupBy("person_id").agg(F.min("_d").alias("_d"))
        # A site beyond the ring is at least `ring` cells away.
        sure = F.lit(True) if whole else F.coalesce(F.col("_d.dist_m") <= beyond(ring * cell), F.lit(False))
        found = materialize(left.join(best, "person_id", "left").withColumn("_sure", sure), "ring")
        done.append(found.where("_sure").select(*cols, "_d.site_id", "_d.dist_m"))
        left = found.where("NOT _sure").drop("_d", "_sure")
        many = 0 if whole else left.count()
        if not many:
            return reduce(DataFrame.unionByName, done)
        ring *= 2
        if ring > 8:  # few are left far from all sites: wider cells instead of many
            cell, ring = cell * 8, 1
            in_cell = crowd()
            cells, left = into_cells(s, "s_lon", "s_lat", ("cx", "cy")), into_cells(left, "lon", "lat", ("px", "py"))


NEAREST = f"""near AS (SELECT person_id, site_id, dist_m FROM (SELECT p.person_id, s.site_id, round({HAVERSINE}, 6) AS dist_m FROM people p, sites s WHERE s.operating)
  QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY dist_m, site_id) = 1)"""


@query("jn_cross_nearest", f"WITH {PEOPLE}, {SITES}, {NEAREST} SELECT person_id, site_id, round(dist_m, 3) AS dist_m FROM near")
def jn_cross_nearest(spark, sf_dir):
    near = nearest_site(people(spark, sf_dir).select("person_id", "lon", "lat"), sites(spark, sf_dir).where("operating"))
    return near.select("person_id", "site_id", F.round("dist_m", 3).alias("dist_m"))


@query("jn_knn_grid", f"WITH {PEOPLE}, {SITES}, {NEAREST} SELECT person_id, site_id, round(dist_m, 3) AS dist_m FROM near")
def jn_knn_grid(spark, sf_dir):
    """The same by rings of grid cells, as for any number of sites."""
    s = sites(spark, sf_dir).where("operating").select("site_id", F.col("lon").alias("s_lon"), F.col("lat").alias("s_lat"))
    near = nearest_by_rings(people(spark, sf_dir).select("person_id", "lon", "lat"), s)
    return near.select("person_id", "site_id", F.round("dist_m", 3).alias("dist_m"))


def admit(arrived: DataFrame, key: str, capacity: Column, order: list[str]) -> DataFrame:
    """arrived with rank (1 is first at its site) and admitted: the first `capacity` arrivals; null capacity admits all."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return arrived.withColumn("rank", r.cast("long")).withColumn("admitted", capacity.isNull() | (F.col("rank") <= capacity))


def admit_first(arrived: DataFrame, capacities: DataFrame, key: str, order: list[str], salt: int = 16) -> DataFrame:
    """The admitted rows only, without a whole site in one task: each of `salt` slices of a site keeps its own first
    `capacity` rows (a rank limit that Spark applies before the shuffle too), and the site ranks what the slices keep. Rows of
    sites without a limit are not ranked. capacities (key, capacity) has a row a site; Spark chooses how to join it."""
    a = arrived.join(capacities.select(key, "capacity"), key).withColumn("_s", F.pmod(F.xxhash64(*order), F.lit(salt)))
    first = lambda df, slices: df.withColumn("_r", F.row_number().over(Window.partitionBy(key, slices).orderBy(*order))).where("capacity IS NULL OR _r <= capacity")
    # Sites without a limit stay in their slices, so that arrivals are read once.
    part = first(first(a, "_s").withColumn("_s", F.when(F.col("capacity").isNull(), F.col("_s"))), "_s")
    return part.drop("_s", "_r", "capacity")


ORDER = ["tick", "person_id", "tie", "tie2", "price"]
RANKED = f"ranked AS (SELECT a.*, capacity, row_number() OVER (PARTITION BY site_id ORDER BY {', '.join(ORDER)}) AS rank FROM arrivals a JOIN sites USING (site_id))"


@query("win_first_come", f"WITH {ARRIVALS}, {SITES}, {RANKED} SELECT site_id, person_id, tick, tie, tie2 FROM ranked WHERE capacity IS NULL OR rank <= capacity")
def win_first_come(spark, sf_dir):
    caps = sites(spark, sf_dir).select("site_id", "capacity")
    return admit_first(arrivals(spark, sf_dir), caps, "site_id", ORDER).select("site_id", "person_id", "tick", "tie", "tie2")


@query(
    "win_reserve",
    f"""WITH {ARRIVALS}, {SITES}, {RANKED}, r AS (SELECT *, floor(capacity * 0.3)::BIGINT AS reserve FROM ranked WHERE capacity IS NOT NULL),
a AS (SELECT *, rank <= capacity - reserve AS open_door, row_number() OVER (PARTITION BY site_id, priority, rank <= capacity - reserve ORDER BY {', '.join(ORDER)}) AS k FROM r)
SELECT site_id, person_id, tick, tie, tie2, CASE WHEN open_door THEN 'open' ELSE 'reserved' END AS door FROM a WHERE open_door OR priority AND k <= reserve""",
)
def win_reserve(spark, sf_dir):
    """The first capacity - reserve arrivals of any class, then the next `reserve` of the priority class."""
    caps = sites(spark, sf_dir).where("capacity IS NOT NULL").select("site_id", "capacity", F.floor(F.col("capacity") * 0.3).alias("reserve"))
    a = arrivals(spark, sf_dir)
    first = admit_first(a, caps.select("site_id", (F.col("capacity") - F.col("reserve")).alias("capacity")), "site_id", ORDER).withColumn("door", F.lit("open"))
    rest = a.where("priority").join(first.where("priority").select("site_id", *ORDER), ["site_id", *ORDER], "left_anti")
    more = admit_first(rest, caps.select("site_id", F.col("reserve").alias("capacity")), "site_id", ORDER).withColumn("door", F.lit("reserved"))
    return first.unionByName(more).select("site_id", "person_id", "tick", "tie", "tie2", "door")


@query("sim_reserve", f"WITH {SITES} SELECT site_id, capacity, CASE WHEN capacity IS NOT NULL THEN least(greatest(floor(capacity * 0.1)::BIGINT, 0), capacity) END AS reserve, capacity - least(greatest(floor(capacity * 0.1)::BIGINT, 0), capacity) AS open_beds FROM sites")
def sim_reserve(spark, sf_dir):
    r = F.when(F.col("capacity").isNotNull(), F.least(F.greatest(F.floor(F.col("capacity") * 0.1), F.lit(0)), F.col("capacity")))
    return sites(spark, sf_dir).select("site_id", "capacity", r.alias("reserve"), (F.col("capacity") - r).alias("open_beds"))


@query("sim_open_window", f"WITH {SITES} SELECT site_id, coalesce(open_hour, -1e18)::DOUBLE AS open_tick, coalesce(close_hour * 60, 1e18)::DOUBLE AS close_tick, coalesce(open_hour, -1e18) < coalesce(close_hour, 1e18) AS ever_open FROM sites")
def sim_open_window(spark, sf_dir):
    s = sites(spark, sf_dir)
    lo, hi = F.coalesce("open_hour", F.lit(-1e18)), F.coalesce("close_hour", F.lit(1e18))
    return s.select("site_id", lo.alias("open_tick"), F.coalesce(F.col("close_hour") * 60, F.lit(1e18)).alias("close_tick"), (lo < hi).alias("ever_open"))


@query("flt_operating_open", f"WITH {SITES} SELECT site_id, capacity FROM sites WHERE operating AND coalesce(open_hour <= 100, true) AND coalesce(100 < close_hour, true) AND coalesce(capacity > 6, true)")
def flt_operating_open(spark, sf_dir):
    t = F.lit(100)
    return sites(spark, sf_dir).where(F.col("operating") & F.coalesce(F.col("open_hour") <= t, F.lit(True)) & F.coalesce(t < F.col("close_hour"), F.lit(True)) & F.coalesce(F.col("capacity") > 6, F.lit(True))).select("site_id", "capacity")


DEPART = f"depart AS (SELECT min(hour) AS depart_hour FROM field WHERE county = '{COUNTY}' AND c >= {UNHEALTHY})"


def departure(spark, sf_dir) -> DataFrame:
    """depart_hour: the first hour at the unhealthy level while some operating site is open. One row."""
    f = field_of(spark, sf_dir).where((F.col("county") == COUNTY) & (F.col("c") >= UNHEALTHY)).select("hour")
    s = sites(spark, sf_dir).where("operating").select(F.coalesce("open_hour", F.lit(-1)).alias("a"), F.coalesce("close_hour", F.lit(10**9)).alias("b")).distinct()
    return f.join(F.broadcast(s), (F.col("a") <= F.col("hour")) & (F.col("hour") < F.col("b")), "left_semi").agg(F.min("hour").alias("depart_hour"))


LATCH = f"depart AS (SELECT min(hour) AS depart_hour FROM field WHERE county = '{COUNTY}' AND c >= {UNHEALTHY} AND EXISTS (SELECT 1 FROM sites WHERE operating AND coalesce(open_hour, -1) <= hour AND hour < coalesce(close_hour, 1000000000)))"


@query("sim_departure_latch", f"WITH {HOURLY}, {SITES}, {LATCH} SELECT depart_hour, depart_hour * 60 AS depart_tick FROM depart")
def sim_departure_latch(spark, sf_dir):
    return departure(spark, sf_dir).select("depart_hour", (F.col("depart_hour") * 60).alias("depart_tick"))


@query("sim_walk", f"WITH {PEOPLE}, {SITES}, {NEAREST} SELECT person_id, site_id, (60 + greatest(1, ceil(dist_m / (speed_mps * 60))) - 1)::BIGINT AS arrive_tick FROM near JOIN people USING (person_id)")
def sim_walk(spark, sf_dir, plan_tick: int = 60):
    """The arrival tick in closed form: the plan's tick counts as the first of the walk, and a walk of no length takes one."""
    p = people(spark, sf_dir)
    legs = nearest_site(p.select("person_id", "lon", "lat", "speed_mps"), sites(spark, sf_dir).where("operating"))
    return legs.select("person_id", "site_id", (F.lit(plan_tick) + F.greatest(F.lit(1), F.ceil(F.col("dist_m") / (F.col("speed_mps") * 60))) - 1).cast("long").alias("arrive_tick"))


@query("sim_group_speed", f"WITH {PEOPLE} SELECT person_id, round(CASE WHEN asthma THEN greatest(0.4, speed_mps - 0.35) ELSE speed_mps END, 6) AS speed FROM people")
def sim_group_speed(spark, sf_dir):
    """People with dependants walk slower, 0.40 m/s at least."""
    return people(spark, sf_dir).select("person_id", F.round(F.when(F.col("asthma"), F.greatest(F.lit(0.4), F.col("speed_mps") - 0.35)).otherwise(F.col("speed_mps")), 6).alias("speed"))


@query(
    "access_census",
    f"""WITH {HOURLY}, {PEOPLE}, {SITES}, {LATCH}, {NEAREST},
walk AS (SELECT person_id, site_id, band, depart_hour * 60 + greatest(1, ceil(dist_m / (speed_mps * 60)))::BIGINT - 1 AS arrive_tick FROM near JOIN people USING (person_id), depart),
ranked AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY arrive_tick, person_id) AS rank FROM walk)
SELECT band, count(*) AS people, count(*) FILTER (capacity IS NULL OR rank <= capacity) AS sheltered, count(*) FILTER (rank > capacity) AS refused, min(arrive_tick) AS first_arrival
FROM ranked JOIN sites USING (site_id) GROUP BY band""",
)
def access_census(spark, sf_dir):
    """Hourly field, departure, nearest site, first-come capacity and the census of outcomes by band."""
    p, s = people(spark, sf_dir), sites(spark, sf_dir)
    near = nearest_site(p.select("person_id", "lon", "lat", "speed_mps", "band"), s.where("operating")).join(F.broadcast(departure(spark, sf_dir)))
    tick = F.col("depart_hour") * 60 + F.greatest(F.lit(1), F.ceil(F.col("dist_m") / (F.col("speed_mps") * 60))) - 1
    walk = materialize(near.select("person_id", "site_id", "band", tick.cast("long").alias("arrive_tick")), "walk")
    inside = admit_first(walk, s.select("site_id", "capacity"), "site_id", ["arrive_tick", "person_id"]).groupBy("band").agg(F.count(F.lit(1)).alias("sheltered"))
    everyone = walk.groupBy("band").agg(F.count(F.lit(1)).alias("people"), F.min("arrive_tick").alias("first_arrival"))
    return everyone.join(inside, "band", "left").select("band", "people", F.coalesce("sheltered", F.lit(0)).alias("sheltered"), (F.col("people") - F.coalesce("sheltered", F.lit(0))).alias("refused"), "first_arrival")


def apportion(rows: DataFrame, weight: str, total: int, tie: str, group: str | None = None) -> DataFrame:
    """rows with share: whole numbers in proportion to weight that add up to total; what floors leave over goes to the largest
    fractions, of equals to the least `tie`. Ranks go over ranges of fractions. A group's sums are one row."""
    sums = rows.groupBy(*([group] if group else [])).agg(F.sum(weight).alias("_all"))
    r = rows.join(F.broadcast(sums), group) if group else rows.join(F.broadcast(sums))
    exact = F.lit(total) * F.col(weight)
    r = r.withColumns({"_floor": F.expr(f"({total} * {weight}) div _all"), "_rest": exact % F.col("_all")})
    left = r.groupBy(*([group] if group else [])).agg((F.lit(total) - F.sum("_floor")).alias("_left"))
    r = r.join(F.broadcast(left), group) if group else r.join(F.broadcast(left))
    r = numbered(r.withColumn("_neg", -F.col("_rest")), [group] if group else [], ["_neg", tie], "_rank")
    return r.withColumn("share", (F.col("_floor") + (F.col("_rank") < F.col("_left")).cast("long")).cast("long")).drop("_all", "_floor", "_rest", "_left", "_neg", "_rank")


@query("win_largest_remainder", f"""WITH {SITES}, s AS (SELECT site_id, capacity, 1009 * capacity // sum(capacity) OVER () AS fl, 1009 * capacity % sum(capacity) OVER () AS rest FROM sites WHERE capacity IS NOT NULL)
SELECT site_id, capacity, (fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, site_id) <= 1009 - sum(fl) OVER () THEN 1 ELSE 0 END)::BIGINT AS share FROM s""")  # fmt: skip
def win_largest_remainder(spark, sf_dir):
    return apportion(sites(spark, sf_dir).where("capacity IS NOT NULL").select("site_id", "capacity"), "capacity", 1009, "site_id")


@query("tx_scale_capacity", f"""WITH {SITES}, t AS (SELECT sum(capacity) AS old, round(sum(capacity) * 1.2)::BIGINT AS new FROM sites), s AS (SELECT site_id, capacity, new, new * capacity // old AS fl, new * capacity % old AS rest FROM sites, t WHERE capacity IS NOT NULL)
SELECT site_id, capacity, (fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, site_id) <= new - sum(fl) OVER () THEN 1 ELSE 0 END)::BIGINT AS share FROM s""")  # fmt: skip
def tx_scale_capacity(spark, sf_dir, scale: float = 1.2):
    """Capacities scaled in proportion to a rounded total, which is met exactly."""
    s = sites(spark, sf_dir).where("capacity IS NOT NULL").select("site_id", "capacity")
    total = s.agg(F.round(F.sum("capacity") * scale).cast("long")).first()[0] or 0
    return apportion(s, "capacity", total, "site_id")


@query("win_equal_split", f"WITH {SITES} SELECT site_id, (1000 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY site_id) <= 1000 % count(*) OVER () THEN 1 ELSE 0 END)::BIGINT AS share FROM sites WHERE operating")
def win_equal_split(spark, sf_dir):
    s = sites(spark, sf_dir).where("operating").select("site_id", F.lit(1).cast("long").alias("one"))
    # Equal weights leave equal fractions, so the first by id get one more.
    return apportion(s, "one", 1000, "site_id").select("site_id", "share")


@query("chk_budget", f"WITH {SITES} SELECT sum(capacity)::BIGINT AS total, 1009 AS target, count(*) FILTER (capacity < 0) AS negative FROM sites")
def chk_budget(spark, sf_dir):
    return sites(spark, sf_dir).agg(F.sum("capacity").alias("total"), F.lit(1009).alias("target"), F.count_if(F.col("capacity") < 0).alias("negative"))


@query("agg_shelter", f"""WITH {ARRIVALS}, {SITES}, {RANKED}, a AS (SELECT * FROM ranked WHERE capacity IS NULL OR rank <= capacity)
SELECT s.site_id, s.capacity, count(a.person_id) AS admitted, round(avg(a.price), 4) AS mean_distance, round(count(a.person_id) / nullif(s.capacity, 0)::DOUBLE, 6) AS utilization,
  min(a.tick) AS first_arrival, round(quantile_cont(a.tick, 0.5), 4) AS median_arrival, max(a.tick) AS last_arrival FROM sites s LEFT JOIN a USING (site_id) GROUP BY s.site_id, s.capacity""")  # fmt: skip
def agg_shelter(spark, sf_dir):
    s = sites(spark, sf_dir).select("site_id", "capacity")
    inside = materialize(admit_first(arrivals(spark, sf_dir), s, "site_id", ORDER).select("site_id", "price", "tick"), "inside")
    per = inside.groupBy("site_id").agg(F.count(F.lit(1)).alias("admitted"), F.round(F.avg("price"), 4).alias("mean_distance"), F.min("tick").alias("first_arrival"), F.max("tick").alias("last_arrival"))
    middle = quantiles(inside.select("site_id", "tick"), ["site_id"], "tick", {"median_arrival": 0.5}).withColumn("median_arrival", F.round("median_arrival", 4))
    out = s.join(per, "site_id", "left").join(middle, "site_id", "left").withColumn("admitted", F.coalesce("admitted", F.lit(0)))
    return out.withColumn("utilization", F.round(F.try_divide("admitted", F.col("capacity").cast("double")), 6))


def deferred_acceptance(choices: DataFrame, capacities: DataFrame) -> DataFrame:
    """person_id, site_id, tick, attempt of who gets in where: choices (person_id, attempt, site_id, tick) are each person's
    sites in the order of trial with the arrival tick there. All propose; each site keeps its first `capacity` by (tick,
    person_id); the rejected propose to their next site, which is later. A round has the newly rejected and the holders of the
    sites that they ask; each ends some person's wish for some site, so that rounds end."""
    choices = materialize(choices.select("person_id", "attempt", "site_id", "tick"), "choices")
    asking = choices.groupBy("person_id").agg(F.min("attempt").alias("attempt")).join(choices, ["person_id", "attempt"])
    cols = ["person_id", "site_id", "tick", "attempt"]
    held = None
    while True:
        asked = materialize(asking.select(*cols), "asking")
        if asked.isEmpty():
            return held if held is not None else asked
        sites_asked = asked.select("site_id").distinct()
        pool = asked if held is None else held.join(sites_asked, "site_id", "left_semi").select(*cols).unionByName(asked)
        kept = admit_first(pool, capacities, "site_id", ["tick", "person_id"]).select(*cols)
        kept = materialize(kept if held is None else kept.unionByName(held.join(sites_asked, "site_id", "left_anti").select(*cols)), "held")
        out = pool.join(kept.select("person_id", "attempt"), ["person_id", "attempt"], "left_anti").select("person_id", F.col("attempt").alias("was"))
        later = choices.join(out, "person_id").where("attempt > was").groupBy("person_id").agg(F.min("attempt").alias("attempt"))
        asking = materialize(later, "later").join(choices, ["person_id", "attempt"])
        if held is not None:
            discard(held)
        discard(asked)
        held = kept


@query("agg_bincount", f"WITH {PEOPLE}, {SITES}, {NEAREST} SELECT site_id, count(*) AS residents, round(avg(dist_m), 3) AS mean_dist_m FROM near GROUP BY site_id")
def agg_bincount(spark, sf_dir):
    near = nearest_site(people(spark, sf_dir), sites(spark, sf_dir).where("operating"))
    return near.groupBy("site_id").agg(F.count(F.lit(1)).alias("residents"), F.round(F.avg("dist_m"), 3).alias("mean_dist_m"))


@query("gr_lower_bound", f"WITH {PEOPLE}, {SITES}, {NEAREST} SELECT count(*) AS people, round(avg(dist_m), 3) AS mean_dist_m FROM near")
def gr_lower_bound(spark, sf_dir):
    """The mean walk if capacities did not matter."""
    near = nearest_site(people(spark, sf_dir), sites(spark, sf_dir).where("operating"))
    return near.agg(F.count(F.lit(1)).alias("people"), F.round(F.avg("dist_m"), 3).alias("mean_dist_m"))
