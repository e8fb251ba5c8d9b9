"""The hourly field and what is read off it: gaps, episodes, plateaus, prefix exposure, decay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteward.catalog import query
from siteward.operators.stand_ins import COUNTY, HOURS, MONITORS, START, UNHEALTHY, monitors


def by_hour():
    """The field has one row for each hour of the event, so a county's window holds HOURS rows at any input size."""
    return Window.partitionBy("county").orderBy("hour")


def hour_index(ts, start: str = START):
    """Whole hours since start, toward zero; the callers drop negative ones."""
    return F.timestamp_diff("HOUR", F.lit(start).cast("timestamp_ntz"), ts)


def hourly_field(monitors: DataFrame, scale: float = 1.0, hours: int = HOURS, start: str = START) -> DataFrame:
    """county, hour, c: the mean over monitors of each hour from 0 to hours - 1, times scale. NaN and null measurements are
    skipped; an hour without any is a gap, c null. Counties without measurements do not occur."""
    m = monitors.withColumn("hour", hour_index(F.col("ts"), start)).where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("hour") < hours) & ~F.isnan("c"))
    mean = m.groupBy("county", "hour").agg((F.avg("c") * scale).alias("c"))
    grid = monitors.select("county").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(hours - 1).cast("long"))))
    return grid.join(mean, ["county", "hour"], "left")


HOURLY = f"""{MONITORS}, hours AS (SELECT county, hour, avg(c) AS c FROM (SELECT county, datesub('hour', TIMESTAMP '{START}', ts) AS hour, c FROM monitors WHERE ts >= TIMESTAMP '{START}' AND NOT isnan(c))
  WHERE hour < {HOURS} GROUP BY county, hour),
field AS (SELECT county, g.hour, c FROM (SELECT DISTINCT county FROM monitors) AS m CROSS JOIN range({HOURS}) AS g(hour) LEFT JOIN hours USING (county, hour))"""


def field_of(spark, sf_dir: str) -> DataFrame:
    return hourly_field(monitors(spark, sf_dir))


@query("agg_hourly_mean", f"WITH {HOURLY} SELECT county, hour, round(c, 6) AS c FROM field")
def agg_hourly_mean(spark, sf_dir):
    return field_of(spark, sf_dir).select("county", "hour", F.round("c", 6).alias("c"))


@query("agg_peak", f"WITH {HOURLY} SELECT county, round(greatest(coalesce(max(c), 0), 0), 6) AS peak, arg_max(hour, (c, -hour)) FILTER (c IS NOT NULL) AS peak_hour FROM field GROUP BY county")
def agg_peak(spark, sf_dir):
    f = field_of(spark, sf_dir)
    return f.groupBy("county").agg(F.round(F.greatest(F.coalesce(F.max("c"), F.lit(0.0)), F.lit(0.0)), 6).alias("peak"), F.max_by("hour", F.struct("c", -F.col("hour"))).alias("peak_hour"))


@query("flt_time_window", f"WITH {MONITORS} SELECT county, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM monitors WHERE ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{START}' + INTERVAL {HOURS} HOUR GROUP BY county")
def flt_time_window(spark, sf_dir):
    """The half-open window of the event; the range of ts reaches the scan."""
    start = F.lit(START).cast("timestamp_ntz")
    m = monitors(spark, sf_dir).where((F.col("ts") >= start) & (F.col("ts") < start + F.expr(f"INTERVAL {HOURS} HOUR")))
    return m.groupBy("county").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("sim_field_gap", f"WITH {HOURLY} SELECT county, count(*) FILTER (c IS NULL) AS gaps, round(sum(coalesce(c, 0)), 7) AS integral FROM field GROUP BY county")
def sim_field_gap(spark, sf_dir):
    """A missing hour counts as 0 and is counted."""
    return field_of(spark, sf_dir).groupBy("county").agg(F.count_if(F.col("c").isNull()).alias("gaps"), F.round(F.sum(F.coalesce("c", F.lit(0.0))), 7).alias("integral"))


def islands(field: DataFrame, level: float = UNHEALTHY) -> DataFrame:
    """county, first_hour, last_hour, hours, mean_c of each longest run of hours at the level or over it."""
    over = field.where(F.col("c") >= level).withColumn("g", F.col("hour") - F.row_number().over(by_hour()))
    return over.groupBy("county", "g").agg(F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"), F.count(F.lit(1)).alias("hours"), F.avg("c").alias("mean_c")).drop("g")


@query(
    "win_islands",
    f"""WITH {HOURLY} SELECT county, min(hour) AS first_hour, max(hour) AS last_hour, count(*) AS hours, round(avg(c), 6) AS mean_c
FROM (SELECT *, hour - row_number() OVER (PARTITION BY county ORDER BY hour) AS g FROM field WHERE c >= {UNHEALTHY}) GROUP BY county, g""",
)
def win_islands(spark, sf_dir):
    return islands(field_of(spark, sf_dir)).withColumn("mean_c", F.round("mean_c", 6))


def episode(field: DataFrame, level: float = UNHEALTHY, sustain: int = 3, from_hour: int = 0) -> DataFrame:
    """county, start_hour, end_hour of the first run that begins at from_hour or later with `sustain` hours at the level."""
    ahead = Window.partitionBy("county").orderBy("hour").rowsBetween(0, sustain - 1)
    f = field.withColumn("held", F.coalesce(F.min(F.coalesce("c", F.lit(-1.0))).over(ahead) >= level, F.lit(False)) & (F.count(F.lit(1)).over(ahead) == sustain))
    start = f.where(F.col("held") & (F.col("hour") >= from_hour)).groupBy("county").agg(F.min("hour").alias("start_hour"))
    runs = islands(field, level)
    return start.join(runs, "county").where("start_hour BETWEEN first_hour AND last_hour").select("county", "start_hour", F.col("last_hour").alias("end_hour"))


@query(
    "win_episode",
    f"""WITH {HOURLY}, f AS (SELECT *, min(coalesce(c, -1)) OVER w >= 50 AND count(*) OVER w = 2 AS held FROM field WINDOW w AS (PARTITION BY county ORDER BY hour ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)),
s AS (SELECT county, min(hour) AS start_hour FROM f WHERE held AND hour >= 24 GROUP BY county),
i AS (SELECT county, min(hour) AS a, max(hour) AS b FROM (SELECT *, hour - row_number() OVER (PARTITION BY county ORDER BY hour) AS g FROM field WHERE c >= 50) GROUP BY county, g)
SELECT county, start_hour, b AS end_hour FROM s JOIN i USING (county) WHERE start_hour BETWEEN a AND b""",
)
def win_episode(spark, sf_dir):
    return episode(field_of(spark, sf_dir), 50.0, 2, 24)


@query(
    "win_plateau",
    f"""WITH {HOURLY}, days AS (SELECT county, hour // 24 AS day, avg(c) AS c FROM field GROUP BY ALL),
p AS (SELECT county, day, avg(c) OVER w AS mean_c, count(*) OVER w AS n FROM days WINDOW w AS (PARTITION BY county ORDER BY day ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
SELECT county, day AS first_day, round(mean_c, 6) AS mean_c FROM p WHERE n = 3 QUALIFY row_number() OVER (PARTITION BY county ORDER BY round(mean_c, 9) DESC, day) = 1""",
)
def win_plateau(spark, sf_dir, k: int = 3):
    """The k successive days of the largest mean; of equals the earliest."""
    days = field_of(spark, sf_dir).groupBy("county", F.floor(F.col("hour") / 24).alias("day")).agg(F.avg("c").alias("c"))
    w = Window.partitionBy("county").orderBy("day").rowsBetween(0, k - 1)
    p = days.select("county", "day", F.avg("c").over(w).alias("mean_c"), F.count(F.lit(1)).over(w).alias("n")).where(F.col("n") == k)
    best = p.groupBy("county").agg(F.max_by(F.struct("day", "mean_c"), F.struct(F.round("mean_c", 9), -F.col("day"))).alias("b"))
    return best.select("county", F.col("b.day").alias("first_day"), F.round("b.mean_c", 6).alias("mean_c"))


def decayed(field: DataFrame, half_life: float = 24.0, level: float = UNHEALTHY) -> DataFrame:
    """The field with z: each hour's z is 2 ** (-1 / half_life) of the last, plus 1/24 where c is at the level. Closed form:
    a running sum of x * 2 ** (hour / half_life), scaled back."""
    x = F.when(F.col("c") >= level, 1 / 24).otherwise(0.0)
    grown = F.sum(x * F.pow(F.lit(2.0), F.col("hour") / half_life)).over(by_hour())
    return field.withColumn("z", grown * F.pow(F.lit(2.0), -F.col("hour") / half_life))


@query("win_decay", f"WITH {HOURLY} SELECT county, hour, round(sum(CASE WHEN c >= {UNHEALTHY} THEN 1 / 24 ELSE 0 END * pow(2.0, hour / 24)) OVER (PARTITION BY county ORDER BY hour) * pow(2.0, -hour / 24), 6) AS z FROM field")
def win_decay(spark, sf_dir):
    return decayed(field_of(spark, sf_dir)).select("county", "hour", F.round("z", 6).alias("z"))


@query(
    "win_prefix",
    f"""WITH {HOURLY} SELECT county, hour, round(sum(coalesce(c, 0)) OVER w, 7) AS exposure, sum(CASE WHEN c > {UNHEALTHY} THEN 1 ELSE 0 END) OVER w::BIGINT AS hours_above
FROM field WINDOW w AS (PARTITION BY county ORDER BY hour)""",
)
def win_prefix(spark, sf_dir):
    f = field_of(spark, sf_dir)
    return f.select("county", "hour", F.round(F.sum(F.coalesce("c", F.lit(0.0))).over(by_hour()), 7).alias("exposure"), F.sum(F.when(F.col("c") > UNHEALTHY, 1).otherwise(0)).over(by_hour()).alias("hours_above"))


@query("win_lag_seam", f"WITH {HOURLY} SELECT county, hour, round(c, 6) AS c, round(before, 6) AS before, round(after, 6) AS after FROM (SELECT *, lag(c) OVER w AS before, lead(c) OVER w AS after FROM field WINDOW w AS (PARTITION BY county ORDER BY hour)) WHERE hour % 72 = 0")
def win_lag_seam(spark, sf_dir):
    """The values before and after each seam."""
    f = field_of(spark, sf_dir).withColumns({"before": F.lag("c").over(by_hour()), "after": F.lead("c").over(by_hour())}).where("hour % 72 = 0")
    return f.select("county", "hour", *(F.round(k, 6).alias(k) for k in ("c", "before", "after")))


@query("agg_daily_category", f"""WITH {HOURLY}, d AS (SELECT county, hour // 24 AS day, avg(c) AS c FROM field GROUP BY ALL)
SELECT county, CASE WHEN c IS NULL THEN 'none' WHEN c < 12.1 THEN 'good' WHEN c < 35.5 THEN 'moderate' WHEN c < 55.5 THEN 'sensitive' WHEN c < 150.5 THEN 'unhealthy' WHEN c < 250.5 THEN 'very unhealthy' ELSE 'hazardous' END AS category, count(*) AS days FROM d GROUP BY ALL""")  # fmt: skip
def agg_daily_category(spark, sf_dir):
    d = field_of(spark, sf_dir).groupBy("county", F.floor(F.col("hour") / 24).alias("day")).agg(F.avg("c").alias("c"))
    kind = F.expr("CASE WHEN c IS NULL THEN 'none' WHEN c < 12.1 THEN 'good' WHEN c < 35.5 THEN 'moderate' WHEN c < 55.5 THEN 'sensitive' WHEN c < 150.5 THEN 'unhealthy' WHEN c < 250.5 THEN 'very unhealthy' ELSE 'hazardous' END")
    return d.groupBy("county", kind.alias("category")).agg(F.count(F.lit(1)).alias("days"))


def stretched(field: DataFrame, first_day: int, days: int, times: int, hours: int = HOURS, scale: float = 1.0) -> DataFrame:
    """The field with the plateau (days from first_day) tiled `times` times; later days move back, the tail is cut, all is
    scaled. A table of days says which day each comes from."""
    last = first_day + days
    n = hours // 24
    plan = [(d, d if d < last else first_day + (d - first_day) % days if d < first_day + days * times else d - days * (times - 1)) for d in range(n)]
    spark = field.sparkSession
    table = F.broadcast(spark.createDataFrame(plan, "to_day long, day long"))
    src = field.withColumn("day", F.floor(F.col("hour") / 24))
    return src.join(table, "day").select("county", (F.col("to_day") * 24 + F.col("hour") % 24).alias("hour"), (F.col("c") * scale).alias("c"), F.col("hour").alias("from_hour"))


@query("tx_stretch", f"""WITH {HOURLY}, plan AS (SELECT d AS to_day, CASE WHEN d < 5 THEN d WHEN d < 9 THEN 3 + (d - 3) % 2 ELSE d - 4 END AS day FROM range({HOURS} // 24) AS r(d))
SELECT county, to_day * 24 + hour % 24 AS hour, round(c * 1.5, 6) AS c, hour AS from_hour FROM field JOIN plan ON hour // 24 = day""")  # fmt: skip
def tx_stretch(spark, sf_dir):
    return stretched(field_of(spark, sf_dir), 3, 2, 3, scale=1.5).withColumn("c", F.round("c", 6))


@query("chk_fidelity", f"""WITH {HOURLY}, plan AS (SELECT d AS to_day, CASE WHEN d < 5 THEN d WHEN d < 9 THEN 3 + (d - 3) % 2 ELSE d - 4 END AS day FROM range({HOURS} // 24) AS r(d)),
s AS (SELECT county, to_day * 24 + hour % 24 AS hour, c FROM field JOIN plan ON hour // 24 = day)
SELECT county, count(*) FILTER (s.hour < 120 AND s.c IS DISTINCT FROM f.c) AS changed_before, count(DISTINCT s.hour) = {HOURS} AND count(*) = {HOURS} AS contiguous,
  count(*) FILTER (s.c NOT IN (SELECT c FROM field WHERE c IS NOT NULL)) AS without_source FROM s JOIN field f USING (county, hour) GROUP BY county""")  # fmt: skip
def chk_fidelity(spark, sf_dir):
    """The stretched field keeps what comes before, has each hour once, and has no value that the source lacks."""
    f = field_of(spark, sf_dir)
    s = stretched(f, 3, 2, 3)
    values = f.select(F.col("c").alias("v")).where("c IS NOT NULL").distinct()
    both = s.join(f.select("county", "hour", F.col("c").alias("old")), ["county", "hour"]).join(values, F.col("c") == F.col("v"), "left")
    return both.groupBy("county").agg(
        F.count_if((F.col("hour") < 120) & ~F.col("c").eqNullSafe(F.col("old"))).alias("changed_before"),
        ((F.count_distinct("hour") == HOURS) & (F.count(F.lit(1)) == HOURS)).alias("contiguous"),
        F.count_if(F.col("c").isNotNull() & F.col("v").isNull()).alias("without_source"),
    )


@query("fn_hour_index", f"WITH {MONITORS} SELECT datesub('hour', TIMESTAMP '2024-01-10 12:30:00', ts) AS hour, count(*) AS n FROM monitors GROUP BY ALL")
def fn_hour_index(spark, sf_dir):
    return monitors(spark, sf_dir).groupBy(hour_index(F.col("ts"), "2024-01-10 12:30:00").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query("fn_time_for_tick", f"WITH {MONITORS} SELECT datesub('minute', TIMESTAMP '{START}', ts) AS tick, TIMESTAMP '{START}' + to_minutes(datesub('minute', TIMESTAMP '{START}', ts)) AS local_time, count(*) AS n FROM monitors GROUP BY ALL")
def fn_time_for_tick(spark, sf_dir):
    start = F.lit(START).cast("timestamp_ntz")
    tick = F.timestamp_diff("MINUTE", start, F.col("ts"))
    return monitors(spark, sf_dir).groupBy(tick.alias("tick"), F.timestamp_add("MINUTE", tick, start).alias("local_time")).agg(F.count(F.lit(1)).alias("n"))


#: The breakpoints of concentration and index of the air quality index for PM2.5.
AQI = [(0.0, 12.0, 0, 50), (12.1, 35.4, 51, 100), (35.5, 55.4, 101, 150), (55.5, 150.4, 151, 200), (150.5, 250.4, 201, 300), (250.5, 350.4, 301, 400), (350.5, 500.4, 401, 500)]


def aqi(c):
    """Index of a concentration, linear between breakpoints, of one decimal; 500 beyond the last."""
    c = F.floor(c * 10) / 10
    out = F.when(c.isNull(), F.lit(None).cast("double"))
    for c0, c1, i0, i1 in AQI:
        out = out.when(c <= c1, F.round((i1 - i0) / (c1 - c0) * (c - c0) + i0))
    return out.otherwise(500.0)


def _aqi_sql() -> str:
    cases = " ".join(f"WHEN v <= {c1}::DOUBLE THEN round({(i1 - i0) / (c1 - c0)!r}::DOUBLE * (v - {c0}::DOUBLE) + {i0})" for c0, c1, i0, i1 in AQI)
    return f"CASE WHEN v IS NULL THEN NULL {cases} ELSE 500.0 END"


@query("fn_aqi", f"WITH {HOURLY}, v AS (SELECT county, hour, floor(c * 10) / 10 AS v FROM field) SELECT county, hour, ({_aqi_sql()})::DOUBLE AS aqi FROM v")
def fn_aqi(spark, sf_dir):
    return field_of(spark, sf_dir).select("county", "hour", aqi(F.col("c")).alias("aqi"))
