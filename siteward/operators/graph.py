"""Road-graph operators: degrees, components, shortest paths by relaxation rounds, closures, fragments.

Nothing is held whole: components alternate large and small stars, shortest paths relax a frontier of improved (source,
node) pairs, and each round's improvements are written to the shared folder. network.py builds graphs from streets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteward.catalog import query
from siteward.operators.stand_ins import ROADS, SITES, roads, sites
from siteward.session import discard, materialize


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "length_m").unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"), "length_m"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node that each node of the edges (a, b) reaches. Large-star, then small-star rounds until
    nothing changes; a node's neighbours meet only in a minimum, which is partly taken before the shuffle."""
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    was = None
    for _ in range(max_rounds):
        sym = now.select("u", "v").union(now.select(F.col("v"), F.col("u")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        new = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        discard(now)
        now = new
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == was:
            nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
            return nodes.join(now, nodes.node == now.u, "left").select("node", F.coalesce("v", "node").alias("component"))
        was = state
    raise RuntimeError(f"no fixpoint in {max_rounds} rounds")


def shortest(edges: DataFrame, sources: DataFrame, max_m: float | None = None, max_rounds: int = 500) -> DataFrame:
    """(source, node, dist_m) of all nodes that each source reaches. sources: node, and source where it is not the node itself; several
    nodes of one source are one start. A round takes only what the last one improved along the edges; what is known is compared by a
    group with the candidates, and only improvements are written. max_m bounds the distance. For graphs of few hops: rounds are as
    many as edges on a way."""
    e = materialize(both_ways(edges), "edges")
    start = sources.select(F.col("source" if "source" in sources.columns else "node").alias("source"), "node", F.lit(0).cast("long").alias("dist_m")).distinct()
    known = new = materialize(start, "dist")
    for _ in range(max_rounds):
        step = new.join(e, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node"), (F.col("dist_m") + F.col("length_m")).alias("dist_m"))
        if max_m is not None:
            step = step.where(F.col("dist_m") <= max_m)
        both = known.withColumn("r", F.lit(0)).unionByName(step.withColumn("r", F.lit(1)))
        best = both.groupBy("source", "node").agg(F.min(F.struct("dist_m", "r")).alias("b"))
        new = materialize(best.where("b.r = 1").select("source", "node", "b.dist_m"), "dist")
        if new.isEmpty():
            return known.groupBy("source", "node").agg(F.min("dist_m").alias("dist_m"))
        known = known.unionByName(new)
    raise RuntimeError(f"no fixpoint in {max_rounds} rounds")


#: Labels of the nodes of an edge table (a, b) by relaxing a least label, as SQL.
def _labels_sql(name: str, edges: str, nodes: str = "SELECT a AS node FROM roads UNION SELECT b FROM roads") -> str:
    return f"""{name}(node, component) AS MATERIALIZED (WITH RECURSIVE t(node, component) USING KEY (node) AS (SELECT node, node FROM ({nodes}) UNION
  (SELECT e.v, min(t.component) FROM t JOIN {edges} e ON e.u = t.node JOIN recurring.t AS cur ON cur.node = e.v WHERE t.component < cur.component GROUP BY e.v)) SELECT * FROM t)"""


_BOTH = "d AS (SELECT a AS u, b AS v FROM roads UNION ALL SELECT b, a FROM roads)"


@query("gr_components", f"WITH RECURSIVE {ROADS}, {_BOTH}, {_labels_sql('c', 'd')} SELECT node, component FROM c")
def gr_components(spark, sf_dir):
    return components(roads(spark, sf_dir))


@query("gr_degree", f"WITH {ROADS}, e AS (SELECT a AS node, length_m FROM roads UNION ALL SELECT b, length_m FROM roads) SELECT node, count(*) AS degree, sum(length_m)::BIGINT AS metres FROM e GROUP BY node")
def gr_degree(spark, sf_dir):
    return both_ways(roads(spark, sf_dir)).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.sum("length_m").alias("metres"))


@query("gr_has_edge", f"WITH {ROADS} SELECT s_suppkey * 2 AS a, p_partkey * 2 + 1 AS b FROM supplier, part WHERE (s_suppkey + p_partkey) % 97 = 0 AND EXISTS (SELECT 1 FROM roads WHERE a = s_suppkey * 2 AND b = p_partkey * 2 + 1)")
def gr_has_edge(spark, sf_dir):
    """Which asked-for pairs are edges. The pairs are stated by a rule, which edges are held against: nothing is made of all pairs."""
    from siteward.operators.stand_ins import read

    asked = roads(spark, sf_dir).select("a", "b").where((F.expr("a div 2") + F.expr("(b - 1) div 2")) % 97 == 0)
    s = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("a"))
    p = read(spark, sf_dir, "part").select((F.col("p_partkey") * 2 + 1).alias("b"))
    return asked.join(s, "a", "left_semi").join(p, "b", "left_semi").select("a", "b")


@query("gr_sssp_relax", f"""WITH RECURSIVE {ROADS}, {SITES}, d AS (SELECT a AS u, b AS v, length_m AS w FROM roads UNION ALL SELECT b, a, length_m FROM roads),
t(node, dist) USING KEY (node) AS (SELECT site_id * 2, 0::BIGINT FROM sites WHERE operating UNION (SELECT d.v, min(t.dist + d.w) FROM t JOIN d ON d.u = t.node LEFT JOIN recurring.t AS cur ON cur.node = d.v WHERE cur.dist IS NULL OR t.dist + d.w < cur.dist GROUP BY d.v))
SELECT node, dist AS dist_m FROM t""")  # fmt: skip
def gr_sssp_relax(spark, sf_dir):
    """The way of each node to the nearest operating site, over the whole graph: all sites are the start of one search."""
    start = sites(spark, sf_dir).where("operating").select((F.col("site_id") * 2).alias("node"), F.lit(0).cast("long").alias("source"))
    return shortest(roads(spark, sf_dir), start).select("node", "dist_m")


@query("gr_block", f"WITH {ROADS}, c AS (SELECT a, b, CASE WHEN (a + b) % 5 = 0 THEN 24 ELSE 72 END AS hour FROM roads WHERE (a * 7 + b) % 11 = 0), v AS (SELECT DISTINCT hour, dense_rank() OVER (ORDER BY hour) AS version FROM c) SELECT version, count(*) AS open_edges, sum(length_m)::BIGINT AS metres FROM v, roads r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.a = r.a AND c.b = r.b AND c.hour <= v.hour) GROUP BY version")
def gr_block(spark, sf_dir):
    """Open edges by version of the cumulative closures: an edge is open in the versions before its own."""
    r = roads(spark, sf_dir).withColumn("hour", F.when((F.col("a") * 7 + F.col("b")) % 11 == 0, F.when((F.col("a") + F.col("b")) % 5 == 0, 24).otherwise(72)))
    versions = cumulative_versions(r.where("hour IS NOT NULL").select("hour").distinct())
    open_ = r.join(F.broadcast(versions.withColumnRenamed("hour", "wave")), F.col("hour").isNull() | (F.col("hour") > F.col("wave")))
    return open_.groupBy("version").agg(F.count(F.lit(1)).alias("open_edges"), F.sum("length_m").alias("metres"))


def cumulative_versions(hours: DataFrame) -> DataFrame:
    """hour, version: closures' hours, which are few, ranked from 1."""
    from pyspark.sql import Window

    return hours.withColumn("version", F.dense_rank().over(Window.orderBy("hour")).cast("long"))


@query("win_cum_closures", f"WITH {ROADS}, c AS (SELECT a, b, (a + b) % 4 * 24 AS hour FROM roads WHERE (a * 7 + b) % 11 = 0), v AS (SELECT hour, dense_rank() OVER (ORDER BY hour) AS version FROM (SELECT DISTINCT hour FROM c)) SELECT version, count(*) AS blocked FROM v JOIN c ON c.hour <= v.hour GROUP BY version")
def win_cum_closures(spark, sf_dir):
    """Edges blocked by each wave or an earlier one: counts by wave, added up."""
    from pyspark.sql import Window

    c = roads(spark, sf_dir).where("(a * 7 + b) % 11 = 0").groupBy(((F.col("a") + F.col("b")) % 4 * 24).alias("hour")).count()
    w = Window.orderBy("hour")
    return c.select(F.dense_rank().over(w).cast("long").alias("version"), F.sum("count").over(w).alias("blocked"))


@query("agg_component_ledger", f"""WITH RECURSIVE {SITES}, {ROADS}, {_BOTH}, {_labels_sql('c', 'd')},
l AS (SELECT component, count(*) FILTER (node % 2 = 1) AS residents, count(site_id) AS sites, coalesce(sum(capacity), 0)::BIGINT AS capacity FROM c LEFT JOIN sites ON site_id * 2 = node GROUP BY component)
SELECT component, residents, sites, capacity, least(residents, capacity) AS servable, residents - least(residents, capacity) AS stranded FROM l""")  # fmt: skip
def agg_component_ledger(spark, sf_dir):
    """By component: residents, sites, beds, who can be served and who is stranded."""
    c = components(roads(spark, sf_dir))
    s = sites(spark, sf_dir).select((F.col("site_id") * 2).alias("node"), "site_id", "capacity")
    g = c.join(s, "node", "left").groupBy("component").agg(F.count_if(F.col("node") % 2 == 1).alias("residents"), F.count("site_id").alias("sites"), F.coalesce(F.sum("capacity"), F.lit(0)).alias("capacity"))
    served = F.least("residents", "capacity")
    return g.withColumns({"servable": served, "stranded": F.col("residents") - served})


#: What stays open: roads that are not part of a region's closure.
_OPEN = "NOT (b % 31 = 1 OR (a % 6 = 4 AND b % 5 <> 2))"


@query("gr_fragment_check", f"""WITH RECURSIVE {ROADS}, {_BOTH}, o AS (SELECT a AS u, b AS v FROM roads WHERE {_OPEN} UNION ALL SELECT b, a FROM roads WHERE {_OPEN}), {_labels_sql('c0', 'd')}, {_labels_sql('c', 'o')},
f AS (SELECT c0.component AS before, c.component AS after, count(*) AS k FROM c JOIN c0 USING (node) GROUP BY ALL)
SELECT before AS component, sum(k)::BIGINT AS nodes, max(k) AS main_fragment, (sum(k) - max(k))::BIGINT AS lost, count(*) AS fragments FROM f GROUP BY before""")  # fmt: skip
def gr_fragment_check(spark, sf_dir):
    """What closing edges does to each component: its main fragment, and the nodes cut off from it."""
    e = materialize(roads(spark, sf_dir), "roads")  # read in four places
    before = components(e)
    after = components(e.where(_OPEN)).withColumnRenamed("component", "after")
    k = before.join(after, "node", "left").groupBy("component", F.coalesce("after", "node").alias("after")).agg(F.count(F.lit(1)).alias("k"))
    return k.groupBy("component").agg(F.sum("k").alias("nodes"), F.max("k").alias("main_fragment"), (F.sum("k") - F.max("k")).alias("lost"), F.count(F.lit(1)).alias("fragments"))
