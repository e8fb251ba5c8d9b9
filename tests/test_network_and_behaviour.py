"""Places, trees, ways and admissions against plain programs on small hand-made cases."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from siteward.functions import ranks
from siteward.operators import admission, behaviour, network
from siteward.operators.admission import nearest_by_rings


def metres(a, b):
    phi = math.radians((a[1] + b[1]) / 2)
    e2 = (1 / 298.257223563) * (2 - 1 / 298.257223563)
    bend = 1 - e2 * math.sin(phi) ** 2
    x = math.radians(b[0] - a[0]) * math.cos(phi) * 6378137.0 / math.sqrt(bend)
    y = math.radians(b[1] - a[1]) * 6378137.0 * (1 - e2) / bend**1.5
    return math.hypot(x, y)


@pytest.mark.parametrize("seed", range(2))
def test_places_are_those_of_claims_in_order(spark, seed):
    r = random.Random(seed)
    claims = [(r.randrange(3), k, -122 + r.gauss(0, 0.002), 45 + r.gauss(0, 0.0015)) for k in range(150)]
    claims += [(0, 200 + k, *claims[k][2:]) for k in range(20)]
    places: dict[int, list] = {}
    for attr, k, lon, lat in claims:
        if not any(metres((lon, lat), p[1:]) <= 100 for p in places.setdefault(attr, [])):
            places[attr].append((k, lon, lat))
    got, assigned = network.cluster_claims(spark.createDataFrame(claims, "attr long, claim long, lon double, lat double"))
    assert {(x.attr, x.place) for x in got.collect()} == {(a, p[0]) for a, ps in places.items() for p in ps}
    rows = {(x.attr, x.lon, x.lat): x.place for x in assigned.collect()}
    for attr, _, lon, lat in claims:
        assert rows[attr, lon, lat] == next(p[0] for p in places[attr] if metres((lon, lat), p[1:]) <= 100)
    empty = network.cluster_claims(spark.createDataFrame([], "attr long, claim long, lon double, lat double"))
    assert empty[0].count() == 0 and empty[1].count() == 0


@pytest.mark.parametrize("lat", (80.0, 89.9995, 90.0, 120.0))
def test_places_at_high_latitudes(spark, lat):
    r = random.Random(9)
    wide = 0.002 / max(abs(math.cos(math.radians(lat))), 1e-4)
    claims = [(r.randrange(2), k, -122 + r.gauss(0, wide), lat + r.gauss(0, 0.0015)) for k in range(120)]
    places: dict[int, list] = {}
    for attr, k, lon, y in claims:
        if not any(metres((lon, y), p[1:]) <= 100 for p in places.setdefault(attr, [])):
            places[attr].append((k, lon, y))
    got, assigned = network.cluster_claims(spark.createDataFrame(claims, "attr long, claim long, lon double, lat double"))
    assert {(x.attr, x.place) for x in got.collect()} == {(a, p[0]) for a, ps in places.items() for p in ps}
    rows = {(x.attr, x.lon, x.lat): x.place for x in assigned.collect()}
    for attr, _, lon, y in claims:
        assert rows[attr, lon, y] == next(p[0] for p in places[attr] if metres((lon, y), p[1:]) <= 100)


def test_trees_by_tiles_are_dijkstras(spark):
    r = random.Random(3)
    n = 60
    where = {k: (r.uniform(0, 1), r.uniform(0, 1)) for k in range(n)}
    edges = {(min(a, b), max(a, b)): r.randrange(1, 500) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(110)) if a != b}
    sources = [(7, 0, -1, -1), (8, 5, -1, -1), (9, 0, *next(e for e in edges if 0 in e))]

    def plain(start, ban, most):
        dist, heap = {start: 0}, [(0, start)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for (a, b), w in edges.items():
                if u in (a, b) and (a, b) != ban:
                    v = b if u == a else a
                    if d + w <= most and d + w < dist.get(v, math.inf):
                        dist[v] = d + w
                        heapq.heappush(heap, (d + w, v))
        return dist

    streets = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a long, b long, cm long")
    tiles = spark.createDataFrame([(k, int(x * 3) * 10 + int(y * 3)) for k, (x, y) in where.items()], "node long, tile long")
    src = spark.createDataFrame(sources, "source long, node long, ban_a long, ban_b long")
    for most in (None, 900):
        got = {(x.source, x.node): x.dist for x in network.trees(streets, tiles, src, most).collect()}
        want = {(s, v): d for s, start, a, b in sources for v, d in plain(start, (a, b), most or math.inf).items()}
        assert got == want


@pytest.mark.parametrize("most", (2_000, 30, 0))
def test_nearest_by_way_is_dijkstras(spark, monkeypatch, most):
    monkeypatch.setattr(network, "MERGE_NODES", most)
    r = random.Random(5)
    n = 120
    where = {k: (r.uniform(0, 1), r.uniform(0, 2)) for k in range(n)}
    edges = {}
    for a in range(n):
        for b in sorted(range(n), key=lambda v: math.dist(where[a], where[v]))[1 : 2 + r.randrange(3)]:
            edges[min(a, b), max(a, b)] = r.randrange(1, 6)
    starts = [(40, 3), (41, 3), (-7, 80), (9, 50), (12, 119)]
    label, heap = {}, sorted((0, s, v) for s, v in starts)
    while heap:
        d, s, u = heapq.heappop(heap)
        if u in label:
            continue
        label[u] = (d, s)
        for (a, b), w in edges.items():
            if u in (a, b):
                heapq.heappush(heap, (d + w, s, b if u == a else a))
    streets = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a long, b long, cm long")
    tiles = spark.createDataFrame([(k, int(x * 5) * 100_000 + int(y * 5) - 3) for k, (x, y) in where.items()], "node long, tile long")
    found = network.nearest_by_way(streets, tiles, spark.createDataFrame(starts, "site_id long, node long")).collect()
    assert {x.node: (x.dist, x.site_id) for x in found} == label and len(found) == len(label) > 60


def test_all_ways_go_over_a_tile_once(spark, monkeypatch):
    def no(*_):
        raise AssertionError("searched tile by tile")

    monkeypatch.setattr(network, "search_tile", no)
    monkeypatch.setattr(network, "SLICE", 4)
    monkeypatch.setattr(network, "BUNDLE", 8)
    r = random.Random(6)
    n = 90
    where = {k: (r.uniform(0, 1), r.uniform(0, 2)) for k in range(n)}
    far = {(a, b): 0 if a == b else math.inf for a in range(n) for b in range(n)}
    edges = {}
    for a in range(n - 1):
        for b in sorted(range(n - 1), key=lambda v: math.dist(where[a], where[v]))[1 : 2 + r.randrange(3)]:
            edges[min(a, b), max(a, b)] = r.randrange(1, 60)
    for (a, b), w in edges.items():
        far[a, b] = far[b, a] = w
    for k in range(n):
        for a in range(n):
            for b in range(n):
                far[a, b] = min(far[a, b], far[a, k] + far[k, b])
    starts = [(300 + k, r.randrange(n - 1)) for k in range(20)] + [(500, n - 1)]
    streets = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a long, b long, cm long")
    tiles = spark.createDataFrame([(k, int(x * 4) * 100_000 + int(y * 4) - 3) for k, (x, y) in where.items()], "node long, tile long")
    found = network.trees(streets, tiles, spark.createDataFrame(starts, "source long, node long")).collect()
    got = {(x.source, x.node): x.dist for x in found}
    assert got == {(s, b): far[v, b] for s, v in starts for b in range(n) if far[v, b] < math.inf} and len(got) == len(found)


def test_sites_with_one_door_are_one_search(spark, monkeypatch):
    from types import SimpleNamespace

    searched = []
    monkeypatch.setattr(network, "doors", lambda *_: spark.createDataFrame([(5, 1), (6, 1), (7, 2)], "site_id long, node long"))
    monkeypatch.setattr(network, "trees", lambda streets, tiles, sources: (searched.extend(sources.collect()), sources.withColumn("dist", F.lit(0)))[1])
    got = {tuple(x) for x in network.site_trees(spark, "", SimpleNamespace(streets=None, tiles=None)).collect()}
    assert got == {(5, 1, 0), (6, 1, 0), (7, 2, 0)} and len(searched) == 2


def test_ways_by_doubling(spark):
    tree = spark.createDataFrame([(k, 1, k, k - 1 if k else None) for k in range(37)] + [(100, 2, 0, None)], "node long, site_id long, dist long, up long")
    got = {x.node: x.steps for x in network.paths(tree).collect()}
    assert got == {k: list(range(k, -1, -1)) for k in range(37)} | {100: [100]}


def test_ways_are_written_by_stops(spark, monkeypatch):
    monkeypatch.setattr(network, "STOP", 8)
    kept, write = [], network.materialize
    monkeypatch.setattr(network, "materialize", lambda df, name="step": kept.append((name, write(df, name))) or kept[-1][1])
    monkeypatch.setattr(network, "discard", lambda df: None)
    tree = spark.createDataFrame([(k, 1, k, k - 1 if k else None) for k in range(150)] + [(900, 2, 0, None)], "node long, site_id long, dist long, up long")
    got = {x.node: x.steps for x in network.paths(tree).collect()}
    assert got == {k: list(range(k, -1, -1)) for k in range(150)} | {900: [900]}
    # All ways have 11,326 nodes.
    assert max(df.agg(F.sum(F.size("steps"))).first()[0] for name, df in kept if "steps" in df.columns) < 2_500


def test_rings_keep_those_without_a_place(spark):
    who = spark.createDataFrame([(1, 0.0, 0.0, 5), (2, 3.0, 3.0, 1), (3, 179.0, -80.0, 5)], "person_id long, lon double, lat double, level int")
    s = spark.createDataFrame([(7, 0.1, 0.1, 9), (8, 0.5, 0.5, 3)], "site_id long, s_lon double, s_lat double, need int")
    got = {x.person_id: x.site_id for x in nearest_by_rings(who, s, None, allowed=F.col("level") >= F.col("need")).collect()}
    assert got == {1: 8, 2: None, 3: 8}
    assert [x.site_id for x in nearest_by_rings(who, s.limit(0)).collect()] == [None] * 3
    assert nearest_by_rings(who.limit(0), s).count() == 0


def test_people_of_one_file_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(admission, "PEOPLE_A_TASK", 10)
    who = spark.range(200).coalesce(1).select(F.col("id").alias("person_id"), (F.col("id") / 200).alias("lon"), F.lit(45.0).alias("lat"))
    s = spark.range(30).select(F.col("id").alias("site_id"), (F.col("id") / 30).alias("s_lon"), F.lit(45.0).alias("s_lat"))
    each = [x["count"] for x in nearest_by_rings(who, s).groupBy(F.input_file_name()).count().collect()]
    assert sum(each) == 200 and max(each) <= 30


def test_people_of_a_wider_ring_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(admission, "PEOPLE_A_TASK", 20)
    # All sites are further off than the first ring and within the second.
    who = spark.range(60).coalesce(1).select(F.col("id").alias("person_id"), (F.col("id") / 60).alias("lon"), F.lit(45.1).alias("lat"))
    s = spark.range(30).select(F.col("id").alias("site_id"), (F.col("id") / 30).alias("s_lon"), F.lit(45.0).alias("s_lat"))
    got = nearest_by_rings(who, s).select("person_id", "site_id", F.input_file_name().alias("f")).collect()
    assert len(got) == 60 and all(abs(x.site_id * 2 - x.person_id) <= 1 for x in got)
    each = [sum(x.f == f for x in got) for f in {x.f for x in got}]
    assert len(each) >= 5 and max(each) <= 20


def test_rings_shuffled_by_cells_and_half_places(spark, monkeypatch):
    monkeypatch.setattr(admission, "BROADCAST_CELLS", 0)
    who = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, None), (3, None, None), (4, 0.6, 0.6)], "person_id long, lon double, lat double")
    s = spark.createDataFrame([(7, 0.1, 0.1), (8, 0.5, 0.5), (9, 0.0, None)], "site_id long, s_lon double, s_lat double")
    assert {x.person_id: x.site_id for x in nearest_by_rings(who, s).collect()} == {1: 7, 2: None, 3: None, 4: 8}
    assert [x.site_id for x in nearest_by_rings(who, s.where("site_id = 9")).collect()] == [None] * 4


@pytest.mark.parametrize("seed", range(2))
def test_many_sites_by_rings_are_the_nearest(spark, seed):
    r = random.Random(seed)
    who = [(k, r.gauss(-122, 0.5), r.gauss(45, 0.5)) for k in range(80)]
    where = [(k, r.gauss(-122, 0.5), r.gauss(45, 0.5)) for k in range(admission.BROADCAST_SITES + 1)]
    w, s = spark.createDataFrame(who, "person_id long, lon double, lat double"), spark.createDataFrame(where, "site_id long, lon double, lat double")
    got = {x.person_id: x.site_id for x in admission.nearest_site(w, s).collect()}
    far = lambda x, y, v, w: math.asin(math.sqrt(math.sin(math.radians(w - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(w)) * math.sin(math.radians(v - x) / 2) ** 2))
    assert got == {k: min(where, key=lambda p: far(x, y, p[1], p[2]))[0] for k, x, y in who}


def on_the_clock(who, where):
    """Admission one arrival after the other."""
    beds = {s["site_id"]: s["capacity"] for s in where}
    sites = {s["site_id"]: s for s in where}
    end, heap = {}, []

    def plan(p, lon, lat, t, tried, n):
        while True:
            now = [s for s in where if s["site_id"] not in tried and (s["opens"] or 0) <= t < (s["closes"] or 10**9)]
            if now:
                break
            later = [s["opens"] for s in where if s["site_id"] not in tried and s["opens"] is not None and s["opens"] > t and s["opens"] < (s["closes"] or 10**9)]
            if not later:
                end[p["person_id"]] = ("REFUSED_ALL_FULL" if tried else "UNREACHABLE", None, *n)
                return
            t, n = min(later), (n[0], n[1], 0, n[3] + 1)
        d, s = min((round(dist(lon, lat, s["lon"], s["lat"]), 6), s["site_id"]) for s in now)
        heapq.heappush(heap, (t + max(1, math.ceil(d / (p["speed_mps"] * 60))) - 1, p["person_id"], s, tried | {s}, n))

    def dist(lon, lat, x, y):
        a = math.sin(math.radians(y - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(y)) * math.sin(math.radians(x - lon) / 2) ** 2
        return 2 * 6_371_000.0 * math.asin(math.sqrt(min(a, 1.0)))

    people = {p["person_id"]: p for p in who}
    for p in who:
        plan(p, p["lon"], p["lat"], p["tick"], frozenset(), (0, 0, 0, 0))
    while heap:
        t, k, s, tried, n = heapq.heappop(heap)
        p, site = people[k], sites[s]
        policy = (p["has_pet"] and not site["pets"]) or (p["dependants"] and site["adults_only"])
        shut = not (site["opens"] or 0) <= t < (site["closes"] or 10**9)
        if not policy and not shut and (beds[s] is None or beds[s] > 0):
            if beds[s] is not None:
                beds[s] -= 1
            end[k] = ("SHELTERED", s, *n)
        else:
            plan(p, site["lon"], site["lat"], t + 1, tried, (n[0] + 1, n[1] + policy, n[2] + 1, n[3]))
    return end


@pytest.mark.parametrize("seed", range(3))
def test_admissions_are_those_of_the_clock(spark, seed):
    r = random.Random(seed)
    who = [{"person_id": k, "lon": r.uniform(0, 0.1), "lat": r.uniform(0, 0.1), "speed_mps": r.uniform(0.5, 2), "tick": r.randrange(50), "has_pet": r.random() < 0.2, "dependants": r.random() < 0.2} for k in range(60)]
    where = [{"site_id": k, "lon": r.uniform(0, 0.1), "lat": r.uniform(0, 0.1), "capacity": r.choice([0, 1, 3, 8, None if seed == 1 else 2]), "opens": r.choice([20, 40, 400]), "closes": r.choice([None, 60, 5000]), "pets": r.random() < 0.7, "adults_only": r.random() < 0.2} for k in range(7)]
    got = behaviour.admissions(spark.createDataFrame(who, "person_id long, lon double, lat double, speed_mps double, tick long, has_pet boolean, dependants boolean"), spark.createDataFrame(where, "site_id long, lon double, lat double, capacity int, opens long, closes long, pets boolean, adults_only boolean"), tile_sites=2).collect()
    assert len(got) == len(who)
    assert {x.person_id: (x.state, x.site_id, x.refusals, x.policy_refusals, x.counter, x.waits) for x in got} == on_the_clock(who, where)


def test_long_chains_of_rejections(spark):
    """Each arrival puts out the one before, along a row of a hundred sites with one bed."""
    n = 100
    choices = [(p, k, p + k, 2 * (n - p) + 3 * k) for p in range(n) for k in range(n - p)]
    c = spark.createDataFrame(choices, "person_id long, attempt int, site_id long, tick long")
    caps = spark.createDataFrame([(s, 1) for s in range(n)], "site_id long, capacity int")
    got = {(x.person_id, x.site_id) for x in admission.deferred_acceptance(c, caps).collect()}
    left, want, heap = dict.fromkeys(range(n), 1), set(), [(2 * (n - p), p, 0) for p in range(n)]
    heapq.heapify(heap)
    while heap:
        t, p, k = heapq.heappop(heap)
        if left[p + k]:
            left[p + k] -= 1
            want.add((p, p + k))
        elif p + k + 1 < n:
            heapq.heappush(heap, (2 * (n - p) + 3 * (k + 1), p, k + 1))
    assert got == want


def test_running_sums_and_quantiles(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), r.choice([1.5, 2.0, 7.25, r.random()])) for _ in range(300)] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    for parts in (None, 1, 7):
        got = {(v.g, v.x): (v.n, v.below) for v in ranks.running(df.where("x IS NOT NULL").groupBy("g", "x").agg(F.count(F.lit(1)).alias("n")), ["g"], ["x"], "n", parts=parts).collect()}
        for (g, x), (n, below) in got.items():
            mine = [v for h, v in rows if h == g and v is not None]
            assert (n, below) == (mine.count(x), sum(v < x for v in mine))
    q = {v.g: (v.lo, v.mid, v.hi) for v in ranks.quantiles(df, ["g"], "x", {"lo": 0.0, "mid": 0.37, "hi": 1.0}).collect()}
    for g in ("a", "b", None):
        mine = sorted(v for h, v in rows if h == g and v is not None)
        at = 0.37 * (len(mine) - 1)
        k = int(at)
        assert q[g] == pytest.approx((mine[0], mine[k] + (mine[k + 1] - mine[k]) * (at - k), mine[-1]))
    assert sorted(v.number for v in ranks.numbered(df.where("x IS NOT NULL").select("x").distinct(), [], ["x"]).collect()) == list(range(df.select("x").distinct().count() - 1))


def test_refusals_are_rows(spark):
    d = "/root/testdata/sf0.001"
    ends = {r.person_id: r for r in behaviour.study(spark, d).collect()}
    seen = {}
    for r in behaviour.sim_refusals(spark, d).collect():
        seen.setdefault(r.person_id, []).append((r.nth, r.site_id))
    assert {k: len(v) for k, v in seen.items()} == {k: e.refusals for k, e in ends.items() if e.refusals}
    assert all([n for n, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in seen.values())
    assert all(ends[k].state != "SHELTERED" or ends[k].site_id not in {s for _, s in v} for k, v in seen.items())


def test_choices_without_refusing_sites(spark):
    r = random.Random(2)
    # A third of all people at one point.
    who = [(k, -122.5, 45.5, k % 7) if k % 3 == 0 else (k, r.uniform(-122.7, -122.3), r.uniform(45.4, 45.6), k % 7) for k in range(90)]
    where = [(k, r.uniform(-122.7, -122.3), r.uniform(45.4, 45.6), (None, 0, 2, 5)[k % 4]) for k in range(12)]
    w = spark.createDataFrame([*who, (900, None, None, 1)], "person_id long, lon double, lat double, tick int")
    s = spark.createDataFrame(where, "site_id long, lon double, lat double, capacity int")

    def metres(p, q):
        a = math.sin(math.radians(q[2] - p[2]) / 2) ** 2 + math.cos(math.radians(p[2])) * math.cos(math.radians(q[2])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * 6_371_000 * math.asin(math.sqrt(a))

    asked = {}
    for p in who:
        asked.setdefault(min(where, key=lambda q: (round(metres(p, q), 6), q[0]))[0], []).append((p[3], p[0]))
    beds = {q[0]: q[3] for q in where}
    refused = {(p, q) for q, line in asked.items() if beds[q] is not None for _, p in sorted(line)[beds[q] :]}
    got = behaviour.turned_away(w, s)
    assert {tuple(x) for x in got.collect()} == refused and refused
    want = {(p[0], q[0]) for p in who for q in where if metres(p, q) <= 9_000} - refused
    left = behaviour.choices_left(w, s, got.unionByName(got), 9_000).collect()
    assert {(x.person_id, x.site_id) for x in left} == want and len(left) == len(want)
    nothing = got.limit(0)
    assert behaviour.choices_left(w, s, nothing, 9_000).count() == len(want | {(p, q) for p, q in refused if metres(who[p], where[q]) <= 9_000})
    assert behaviour.choices_left(w.limit(0), s, nothing).isEmpty() and behaviour.turned_away(w, s.limit(0)).isEmpty()


@pytest.mark.parametrize("place", ((-122.5, 45.5), (179.95, -20.0), (10.0, 89.5)))
def test_choices_are_counted_without_pairs(spark, monkeypatch, place):
    monkeypatch.setattr(behaviour, "BLOCK_SITES", 20)
    monkeypatch.setattr(behaviour, "CROWD", 7)
    r = random.Random(4)
    turned = lambda x: (x + 180) % 360 - 180
    spot = lambda: (turned(place[0] + r.uniform(-0.3, 0.3)), place[1] + r.uniform(-0.2, 0.2))
    who, where = [(k, *spot()) for k in range(40)] + [(77, None, 1.0)], [(k, *spot()) for k in range(300)]
    w, s = spark.createDataFrame(who, "person_id long, lon double, lat double"), spark.createDataFrame(where, "site_id long, lon double, lat double")
    refused = spark.createDataFrame([(k % 40, k * 7 % 300) for k in range(600)] * 2, "person_id long, site_id long")
    want = {}
    for x in behaviour.choices_left(w, s, refused, 9_000).collect() if place[1] < 80 and place[0] < 0 else by_hand(who, where, {tuple(x) for x in refused.collect()}, 9_000):
        want.setdefault(x[0], []).append((x[2], x[1]))
    got = {x.person_id: (x.choices, x.first_choice, x.ids) for x in behaviour.choices_counted(w, s, refused, 9_000).collect()}
    assert got == {k: (len(v), min(v)[1], sum(i for _, i in v)) for k, v in want.items()} and len(got) > 30
    assert behaviour.choices_counted(w, s.limit(0), refused).isEmpty() and behaviour.choices_counted(w.limit(0), s, refused).isEmpty()


def by_hand(who, where, refused, most):
    for p, x, y in who[:-1]:
        for q, v, u in where:
            a = math.sin(math.radians(u - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(u)) * math.sin(math.radians(v - x) / 2) ** 2
            d = 2 * 6_371_000 * math.asin(math.sqrt(a))
            if d <= most and (p, q) not in refused:
                yield p, q, round(d, 6)


def test_a_search_ends_at_its_goal():
    import pandas as pd

    n = 200
    edges = pd.DataFrame([(a, b, 10, 1, 1) for k in range(n) for a, b in ((k, k + 1), (k + 1, k))], columns=["src", "dst", "cm", "tile", "to_tile"])
    state = pd.DataFrame([(7, 0, 1, 0, True, -1, -1, 3)], columns=["source", "node", "tile", "dist", "new", "ban_a", "ban_b", "goal"])
    got = network.search_tile(state, edges, None)
    assert dict(zip(got["node"], got["dist"]))[3] == 30
    assert len(got) <= 4
    all_ = network.search_tile(state.assign(goal=network.NOWHERE), edges, None)
    assert len(all_) == n


def test_a_map_keeps_few_sites_of_a_door():
    import numpy as np
    import pandas as pd

    n = 1500
    r = np.random.default_rng(1)
    rows = pd.DataFrame({"site_id": range(n), "lon": r.random(n), "lat": 45 + r.random(n), "capacity": 1, "opens": 0, "closes": 9, "pets": True, "adults_only": False, "own": True, "m_level": 0, "x": 0, "y": 0})
    m = behaviour.Map(rows, behaviour.Grid(1.0, (0.0, 1.0, 45.0, 46.0)), behaviour.Hours([(0, n)], [(9, n)]))
    for door in range(40):
        got = list(m.by_distance(0.5, 45.5, door))
        assert sorted(k for k, _ in got) == list(range(n)) and [d for _, d in got] == sorted(d for _, d in got)
    assert len(m.between) == 40 and sum(x.nbytes for known in m.between.values() for x in known) <= 40 * 12 * behaviour.NEAR
