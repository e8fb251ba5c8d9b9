"""Distances on the ellipsoid, the normal distribution function, and nearest sites under a stretched metric."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteward.catalog import query
from siteward.operators.admission import BROADCAST_SITES, nearest_by_rings
from siteward.operators.stand_ins import PEOPLE, SITES, people, read, sites

# The WGS84 ellipsoid, and the weight of a degree of latitude against one of longitude at the study's place.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
LATITUDE_WEIGHT = 1.42
#: Terms of the normal distribution's series, enough for 8 standard deviations; beyond, it is 0 or 1 to ten places.
TERMS, FAR = 120, 8.0


def ellipsoid_inverse(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of geodesics between points in degrees, and the azimuths (radians) at which they set out, by iterating the longitude
    on the auxiliary sphere (Vincenty 1975); to about 0.1 mm. NaN where an end is NaN or the ends are so nearly antipodal that the iteration does not settle."""
    a, f = WGS84_A, WGS84_F
    b = a * (1 - f)
    u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(x))) for x in (lat1, lat2))
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    span = np.radians((lon2 - lon1 + 180) % 360 - 180)
    lam = span.copy()
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
            cs = su1 * su2 + cu1 * cu2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss > 0, cu1 * cu2 * sl / ss, 0.0)
            c2 = 1 - sa * sa
            cm = np.where(c2 > 1e-15, cs - 2 * su1 * su2 / c2, 0.0)
            c = f / 16 * c2 * (4 + f * (4 - 3 * c2))
            new = span + (1 - c) * f * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
            moved = np.abs(new - lam)
            lam = new
            if not (moved > 1e-12).any():
                break
        q = c2 * (a * a - b * b) / (b * b)
        big = 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q)))
        small = q / 1024 * (256 + q * (-128 + q * (74 - 47 * q)))
        turn = small * ss * (cm + small / 4 * (cs * (2 * cm * cm - 1) - small / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
        azimuth = np.arctan2(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
        return np.where(moved <= 1e-12, b * big * (sigma - turn), np.nan), np.where(moved <= 1e-12, azimuth, np.nan)


def ellipsoid_metres(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """The lengths of ellipsoid_inverse()."""
    return ellipsoid_inverse(lon1, lat1, lon2, lat2)[0]


def ellipsoid_direct(lon1: np.ndarray, lat1: np.ndarray, azimuth: np.ndarray, metres: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Where geodesics from points in degrees end that set out at an azimuth (radians) and are so long, by iterating the arc on the
    auxiliary sphere; to about 0.1 mm. NaN where anything is NaN."""
    a, f = WGS84_A, WGS84_F
    b = a * (1 - f)
    with np.errstate(all="ignore"):
        u = np.arctan((1 - f) * np.tan(np.radians(lat1)))
        su, cu, sz, cz = np.sin(u), np.cos(u), np.sin(azimuth), np.cos(azimuth)
        start = np.arctan2(su, cu * cz)
        sa = cu * sz
        c2 = 1 - sa * sa
        q = c2 * (a * a - b * b) / (b * b)
        big = 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q)))
        small = q / 1024 * (256 + q * (-128 + q * (74 - 47 * q)))
        arc = metres / (b * big)
        for _ in range(rounds):
            ss, cs, cm = np.sin(arc), np.cos(arc), np.cos(2 * start + arc)
            new = metres / (b * big) + small * ss * (cm + small / 4 * (cs * (2 * cm * cm - 1) - small / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
            moved, arc = np.abs(new - arc), new
            if not (moved > 1e-13).any():
                break
        ss, cs, cm = np.sin(arc), np.cos(arc), np.cos(2 * start + arc)
        lat2 = np.arctan2(su * cs + cu * ss * cz, (1 - f) * np.hypot(sa, su * ss - cu * cs * cz))
        c = f / 16 * c2 * (4 + f * (4 - 3 * c2))
        lon = np.arctan2(ss * sz, cu * cs - su * ss * cz) - (1 - c) * f * sa * (arc + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
        return (lon1 + np.degrees(lon) + 540) % 360 - 180, np.degrees(lat2)


def geodesic(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points on WGS84; null where ellipsoid_metres() has none."""

    @F.pandas_udf("double")
    def metres(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(ellipsoid_metres(*(x.to_numpy(np.float64) for x in (a, b, c, d))))

    return F.nanvl(metres(lon1, lat1, lon2, lat2), F.lit(None).cast("double"))


@query("fn_geodesic")
def fn_geodesic(spark, sf_dir):
    """Metres on the ellipsoid from each person to a fixed point; SQL has no iteration in a row, so tests hold known lengths."""
    p = people(spark, sf_dir).select("person_id", "lon", "lat")
    return p.select("person_id", F.round(geodesic("lon", "lat", F.lit(-122.5), F.lit(45.5)), 4).alias("metres"))


def step_along(lon1: Column, lat1: Column, lon2: Column, lat2: Column, metres: Column) -> Column:
    """A struct (lon, lat, left) of who has gone so many metres of the geodesic from the first point to the second, and what is left of
    it: the second point and 0 for whoever gets there. Nulls where ellipsoid_inverse() has no length or anything is null."""

    @F.pandas_udf("lon double, lat double, left double")
    def moved(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, m: pd.Series) -> pd.DataFrame:
        x1, y1, x2, y2, go = (x.to_numpy(np.float64) for x in (a, b, c, d, m))
        whole, azimuth = ellipsoid_inverse(x1, y1, x2, y2)
        lon, lat = ellipsoid_direct(x1, y1, azimuth, go)
        there = go >= whole
        return pd.DataFrame({"lon": np.where(there, x2, lon), "lat": np.where(there, y2, lat), "left": np.where(there, 0.0, whole - go)})

    s = moved(lon1, lat1, lon2, lat2, metres)
    none = F.lit(None).cast("double")
    return F.struct(*(F.nanvl(s[k], none).alias(k) for k in ("lon", "lat", "left")))


@query("fn_geodesic_step")
def fn_geodesic_step(spark, sf_dir, minutes: int = 60):
    """Where each person is who walks towards a fixed point, after so many minutes."""
    p = people(spark, sf_dir).select("person_id", step_along("lon", "lat", F.lit(-122.5), F.lit(45.5), F.col("speed_mps") * 60 * minutes).alias("s"))
    return p.select("person_id", F.round("s.lon", 9).alias("lon"), F.round("s.lat", 9).alias("lat"), F.round("s.left", 4).alias("left_m"))


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function by its series x + x^3/3 + x^5/15 + ..., nested from the last term on, in built-in
    functions only; the list of divisors is a constant."""
    odd = F.array(*(F.lit(2.0 * n + 1) for n in range(TERMS, 0, -1)))
    chain = F.aggregate(odd, F.lit(1.0), lambda s, k: 1 + s * (x * x) / k)
    inside = 0.5 + F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * x * chain
    return F.when(x > FAR, 1.0).when(x < -FAR, 0.0).otherwise(F.least(F.greatest(inside, F.lit(0.0)), F.lit(1.0)))


SERIES = f"0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, {TERMS + 1}), lambda n: sign(z) * exp((2 * n + 1) * ln(greatest(abs(z), 1e-300)) - (lgamma(2 * n + 2) - n * ln(2) - lgamma(n + 1)))))"


@query("fn_norm_cdf", f"SELECT c_custkey, round(CASE WHEN z > {FAR} THEN 1 WHEN z < -{FAR} THEN 0 ELSE least(greatest({SERIES}, 0), 1) END, 8) AS p FROM (SELECT c_custkey, c_acctbal / 2000 AS z FROM customer)")
def fn_norm_cdf(spark, sf_dir):
    who = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").repartition("c_custkey")  # one file would be one task
    return who.select("c_custkey", F.round(normal_cdf(F.col("c_acctbal") / 2000), 8).alias("p"))


def stretched(lon1, lat1, lon2, lat2) -> Column:
    """Degrees of longitude, one of latitude counting LATITUDE_WEIGHT."""
    return F.sqrt(F.pow(lon2 - lon1, F.lit(2.0)) + F.pow(LATITUDE_WEIGHT * (lat2 - lat1), F.lit(2.0)))


def nearest_stretched(who: DataFrame, where: DataFrame, most: int = BROADCAST_SITES) -> DataFrame:
    """person_id, site_id, dist of the nearest site under stretched(); of equals the least id. Up to `most` sites are a
    broadcast array, beyond that rings of grid cells are searched."""
    s = where.select("site_id", F.col("lon").alias("s_lon"), F.col("lat").alias("s_lat"))
    if where.count() > most:
        found = nearest_by_rings(who.select("person_id", "lon", "lat"), s, None, stretched, lambda reach: F.lit(reach * 0.999))
        return found.select("person_id", "site_id", F.col("dist_m").alias("dist"))
    listed = F.broadcast(s.agg(F.collect_list(F.struct("site_id", "s_lon", "s_lat")).alias("all")))  # at most `most` structs
    dist = F.transform("all", lambda x: F.struct(F.round(stretched(F.col("lon"), F.col("lat"), x["s_lon"], x["s_lat"]), 6).alias("dist"), x["site_id"].alias("site_id")))
    return who.join(listed).withColumn("_b", F.array_min(dist)).select("person_id", "_b.site_id", "_b.dist")


@query("jn_knn_anisotropic", f"""WITH {PEOPLE}, {SITES} SELECT person_id, site_id, dist FROM (SELECT person_id, site_id, round(sqrt(pow(s.lon - p.lon, 2) + pow({LATITUDE_WEIGHT}::DOUBLE * (s.lat - p.lat), 2)), 6) AS dist FROM people p, sites s WHERE operating)
QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY dist, site_id) = 1""")  # fmt: skip
def jn_knn_anisotropic(spark, sf_dir):
    return nearest_stretched(people(spark, sf_dir), sites(spark, sf_dir).where("operating"))
