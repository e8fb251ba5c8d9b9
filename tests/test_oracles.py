"""Each query against its SQL in DuckDB on the smallest tables, and hand-made cases of the stateful operators."""

import datetime
import decimal
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from siteward import catalog, operators, plans, sources, streaming  # noqa: F401
from siteward.operators import admission, field, geometry, graph

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, list):
        return [plain(x) for x in v]
    return v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    result = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0


def admitted_in_time_order(choices, capacity):
    """One arrival after the other, as on a clock: (person, site) pairs."""
    import heapq

    heap = [(t[0][1], p, 0) for p, t in choices.items() if t]
    heapq.heapify(heap)
    left, out = dict(capacity), set()
    while heap:
        _, p, k = heapq.heappop(heap)
        site = choices[p][k][0]
        if left[site] > 0:
            left[site] -= 1
            out.add((p, site))
        elif k + 1 < len(choices[p]):
            heapq.heappush(heap, (choices[p][k + 1][1], p, k + 1))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_deferred_acceptance_is_the_clock(spark, seed):
    r = random.Random(seed)
    capacity = {s: r.randint(0, 3) for s in range(4)}
    choices = {}
    for p in range(25):
        order, tick, tries = r.sample(range(4), r.randint(1, 4)), 0, []
        for s in order:
            tick += r.randint(1, 9)
            tries.append((s, tick))
        choices[p] = tries
    rows = [(p, k, s, t) for p, tries in choices.items() for k, (s, t) in enumerate(tries)]
    c = spark.createDataFrame(rows, "person_id long, attempt int, site_id long, tick long")
    caps = spark.createDataFrame(list(capacity.items()), "site_id long, capacity int")
    got = {(x.person_id, x.site_id) for x in admission.deferred_acceptance(c, caps).collect()}
    assert got == admitted_in_time_order(choices, capacity)


def test_one_bed_two_reroute(spark):
    rows = [(p, k, s, t) for p in (1, 2, 3) for k, (s, t) in enumerate([(10, 5 + p), (20, 30 + p)])]
    c = spark.createDataFrame(rows, "person_id long, attempt int, site_id long, tick long")
    caps = spark.createDataFrame([(10, 1), (20, None)], "site_id long, capacity int")
    got = {(x.person_id, x.site_id) for x in admission.deferred_acceptance(c, caps).collect()}
    assert got == {(1, 10), (2, 20), (3, 20)}


def test_components_of_a_path_and_a_loop(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in (100, 101, 102)}


def test_shortest_with_and_without_an_edge(spark):
    edges = spark.createDataFrame([(1, 2, 5), (2, 3, 5), (1, 3, 20), (3, 4, 1), (5, 6, 1)], "a long, b long, length_m long")
    src = spark.createDataFrame([(1,)], "node long")
    dist = lambda e: {r.node: r.dist_m for r in graph.shortest(e, src).collect()}
    assert dist(edges) == {1: 0, 2: 5, 3: 10, 4: 11}
    assert dist(edges.where("NOT (a = 2 AND b = 3)")) == {1: 0, 2: 5, 3: 20, 4: 21}


def test_islands_and_episode(spark):
    values = [60, 10, None, 60, 60, 60, 60, 10]
    f = spark.createDataFrame([("x", h, None if v is None else float(v)) for h, v in enumerate(values)], "county string, hour long, c double")
    assert {(r.first_hour, r.last_hour) for r in field.islands(f).collect()} == {(0, 0), (3, 6)}
    assert [(r.start_hour, r.end_hour) for r in field.episode(f).collect()] == [(3, 6)]


def test_apportion_meets_a_prime_total(spark):
    s = spark.createDataFrame([(k, k % 5 + 1) for k in range(30)], "site_id long, capacity long")
    assert admission.apportion(s, "capacity", 1013, "site_id").agg(F.sum("share")).first()[0] == 1013


def test_rings_find_far_sites(spark):
    who = spark.createDataFrame([(1, -123.0, 45.0), (2, -100.0, 30.0)], "person_id long, lon double, lat double")
    s = spark.createDataFrame([(7, -122.99, 45.01), (8, -90.0, 20.0)], "site_id long, s_lon double, s_lat double")
    got = {r.person_id: r.site_id for r in admission.nearest_by_rings(who, s, 0.05).collect()}
    assert got == {1: 7, 2: 8}


def test_known_geodesics(spark):
    rows = [(0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 90.0), (5.0, 5.0, 5.0, 5.0), (179.5, 0.0, -179.5, 0.0), (0.0, 0.0, 179.9, 0.1), (None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").select(geometry.geodesic("a", "b", "c", "d").alias("m"))
    got = [r.m for r in df.collect()]
    assert [round(x, 3) for x in got[:4]] == [111319.491, 10001965.729, 0.0, 111319.491]
    assert got[4:] == [None, None]


def test_steps_along_geodesics(spark):
    r = random.Random(8)
    rows = [(r.uniform(-180, 180), r.uniform(-89, 89), r.uniform(-180, 180), r.uniform(-89, 89), r.uniform(0, 9e6)) for _ in range(200)]
    rows += [(0.0, 0.0, 2.0, 0.0, 111319.4908), (0.0, 0.0, 0.0, 90.0, 5e6), (10.0, 20.0, 10.0, 20.0, 0.0), (179.9, 0.0, -179.9, 0.0, 2e4), (1.0, 1.0, 1.001, 1.0, 1e6), (None, 0.0, 1.0, 1.0, 1.0), (0.0, 0.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, m double")
    df = df.withColumn("s", geometry.step_along(*(F.col(c) for c in "abcdm"))).select("*", geometry.geodesic("a", "b", "c", "d").alias("whole"), geometry.geodesic("a", "b", "s.lon", "s.lat").alias("gone"), geometry.geodesic("s.lon", "s.lat", "c", "d").alias("rest"))
    got = df.collect()
    for x in got[:-2]:
        # The way gone and the way that is left are one geodesic.
        assert abs(x.gone - min(x.m, x.whole)) < 1e-3 and abs(x.rest - x.s.left) < 1e-3 and abs(x.gone + x.rest - x.whole) < 2e-3
    assert abs(got[200].s.lon - 1) < 1e-8 and got[204].s.left == 0 and got[204].s.lon == 1.001
    assert [tuple(x.s) for x in got[-2:]] == [(None,) * 3] * 2


def test_normal_distribution(spark):
    import math

    xs = [-40.0, -8.0, -3.0, -0.5, 0.0, 1.96, 7.9, 40.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(geometry.normal_cdf(F.col("x")).alias("p")).collect()
    assert all(abs(r.p - 0.5 * (1 + math.erf(x / math.sqrt(2)))) < 1e-10 for r, x in zip(got, xs))


def test_stretched_nearest_by_rings_is_the_broadcast_one(spark):
    r = random.Random(4)
    who = spark.createDataFrame([(k, r.uniform(-123, -122), r.uniform(45, 46)) for k in range(60)], "person_id long, lon double, lat double")
    s = spark.createDataFrame([(k, r.uniform(-123, -122), r.uniform(45, 46)) for k in range(40)], "site_id long, lon double, lat double")
    got = [sorted(tuple(x) for x in geometry.nearest_stretched(who, s, most).collect()) for most in (100, 10)]
    assert got[0] == got[1] and len(got[0]) == 60


def test_digests_beyond_a_long_wrap(spark):
    from siteward.operators.results import wrapped

    for n in (0, 5, 2**63 - 1, 2**63, 2**64 - 1, 3 * 2**64 + 7, 10**25):
        got = spark.range(1).select(wrapped(F.lit(str(n)).cast("decimal(38,0)")).alias("w")).first().w
        assert got == (n + 2**63) % 2**64 - 2**63


@pytest.mark.parametrize("name", ("sim_awareness", "fn_norm_cdf"))
def test_people_of_one_file_are_dealt_out(spark, name):
    assert "RepartitionByExpression" in catalog.QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()


def test_asked_pairs_are_not_made(spark):
    assert "Join Inner" not in catalog.QUERIES["gr_has_edge"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
