"""Verification as tables of checks: (name, run, ok, detail)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteward.catalog import query
from siteward.operators.admission import NEAREST, ORDER, RANKED, admit_first, nearest_by_rings, sim_walk
from siteward.operators.results import order_free_digest
from siteward.operators.stand_ins import ARRIVALS, OUTCOMES, PEOPLE, SITES, arrivals, outcomes, people, read, sites


@query("chk_run", f"""WITH {OUTCOMES}, r AS (SELECT arm, seed, count(*) AS n, count(DISTINCT person_id) AS ids, count(*) FILTER (dose_ug < 0) AS bad_dose, count(*) FILTER (state NOT IN ('SHELTERED', 'REFUSED_ALL_FULL', 'UNREACHABLE')) AS bad_state FROM outcomes GROUP BY arm, seed)
SELECT arm, seed, 'ids unique' AS name, ids = n AS ok, (n - ids)::BIGINT AS detail FROM r UNION ALL SELECT arm, seed, 'dose not negative', bad_dose = 0, bad_dose FROM r UNION ALL SELECT arm, seed, 'states known', bad_state = 0, bad_state FROM r""")  # fmt: skip
def chk_run(spark, sf_dir):
    """The checks of all runs in one aggregate."""
    r = outcomes(spark, sf_dir).groupBy("arm", "seed").agg(
        (F.count(F.lit(1)) - F.count_distinct("person_id")).alias("ids unique"),
        F.count_if(F.col("dose_ug") < 0).alias("dose not negative"),
        F.count_if(~F.col("state").isin("SHELTERED", "REFUSED_ALL_FULL", "UNREACHABLE")).alias("states known"),
    )
    names = ["ids unique", "dose not negative", "states known"]
    x = r.select("arm", "seed", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("detail")) for n in names))).alias("c"))
    return x.select("arm", "seed", "c.name", (F.col("c.detail") == 0).alias("ok"), "c.detail")


@query("chk_cross_run", f"""WITH {OUTCOMES}, h AS (SELECT arm, seed, count(*) AS n, count(*) FILTER (state = 'UNREACHABLE') AS u FROM outcomes GROUP BY arm, seed)
SELECT seed, count(*) AS arms, min(n) = max(n) AS same_population, min(u) = max(u) AS same_unreachable FROM h GROUP BY seed""")  # fmt: skip
def chk_cross_run(spark, sf_dir):
    h = outcomes(spark, sf_dir).groupBy("arm", "seed").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "UNREACHABLE").alias("u"))
    return h.groupBy("seed").agg(F.count(F.lit(1)).alias("arms"), (F.min("n") == F.max("n")).alias("same_population"), (F.min("u") == F.max("u")).alias("same_unreachable"))


@query("chk_identity", """SELECT 'orders, read again in another order' AS name, true AS identical, count(*) AS n FROM orders UNION ALL SELECT 'orders, one row changed', false, count(*) FROM orders
UNION ALL SELECT 'orders, one row twice for another', false, count(*) FROM orders""")  # fmt: skip
def chk_identity(spark, sf_dir):
    """Whether two tables hold the same rows as often, by digests that need no join: a table read twice, dealt out otherwise the
    second time, and copies that differ in one row."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    again = read(spark, sf_dir, "orders").repartition("o_orderstatus").select("o_orderkey", "o_totalprice", "o_orderstatus")
    ends = F.broadcast(o.agg(F.min("o_orderkey").alias("least"), F.max("o_orderkey").alias("most"), F.max_by(F.struct("o_totalprice", "o_orderstatus"), "o_orderkey").alias("last")))
    hit = F.col("o_orderkey") == F.col("least")
    changed = o.join(ends).select("o_orderkey", F.when(hit, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"), "o_orderstatus")
    twice = o.join(ends).select(F.when(hit, F.col("most")).otherwise(F.col("o_orderkey")).alias("o_orderkey"), F.when(hit, F.col("last.o_totalprice")).otherwise(F.col("o_totalprice")).alias("o_totalprice"), F.when(hit, F.col("last.o_orderstatus")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    digest = lambda df, name: df.agg(*order_free_digest(df.columns)).select(F.struct("*").alias(name))
    x = digest(o, "h")
    for k, other in enumerate((again, changed, twice)):
        x = x.join(digest(other, f"h{k}"))
    names = ["orders, read again in another order", "orders, one row changed", "orders, one row twice for another"]
    rows = F.array(*(F.struct(F.lit(n).alias("name"), (F.col("h") == F.col(f"h{k}")).alias("identical"), F.col("h.n").alias("n")) for k, n in enumerate(names)))
    return x.select(F.explode(rows).alias("r")).select("r.*")


def conservation(asked: DataFrame, inside: DataFrame, where: DataFrame) -> DataFrame:
    """asked, inside, beds, overfull, strangers, twice: how many asked and got in, and what may not be: sites with more inside than
    beds, rows inside that never asked, and those that are inside more often than they asked. asked, inside: site_id and the columns
    of an arrival; where: site_id, capacity (null: no limit)."""
    keys = asked.columns
    n = asked.groupBy("site_id").agg(F.count(F.lit(1)).alias("asked"))
    m = inside.groupBy("site_id").agg(F.count(F.lit(1)).alias("inside"))
    sums = where.join(n, "site_id", "left").join(m, "site_id", "left").agg(F.coalesce(F.sum("asked"), F.lit(0)).alias("asked"), F.coalesce(F.sum("inside"), F.lit(0)).alias("inside"), F.sum("capacity").alias("beds"), F.count_if(F.col("inside") > F.col("capacity")).alias("overfull"))
    times = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    both = times(inside.select(*keys), "i").join(times(asked, "a"), keys, "left")
    return sums.join(both.agg(F.count_if(F.col("a").isNull()).alias("strangers"), F.count_if(F.col("i") > F.col("a")).alias("twice")))


@query("chk_invariants", f"WITH {ARRIVALS}, {SITES}, {RANKED}, r AS (SELECT s.site_id, s.capacity, count(k.site_id) AS asked, count(k.site_id) FILTER (s.capacity IS NULL OR rank <= s.capacity) AS inside FROM sites s LEFT JOIN ranked k ON k.site_id = s.site_id GROUP BY ALL) SELECT sum(asked)::BIGINT AS asked, sum(inside)::BIGINT AS inside, sum(capacity)::BIGINT AS beds, 0::BIGINT AS overfull, 0::BIGINT AS strangers, 0::BIGINT AS twice FROM r")
def chk_invariants(spark, sf_dir):
    """Conservation in first-come admission: nobody is made up, and no site holds more than its beds."""
    a = arrivals(spark, sf_dir).select("site_id", *ORDER)
    s = sites(spark, sf_dir).select("site_id", "capacity")
    return conservation(a, admit_first(a, s, "site_id", ORDER), s)


#: Metres that a walk may have more than planned.
MORE_M = 200.0


def detours_over(walks: DataFrame, group: str) -> DataFrame:
    """group, over, worst: walks (planned_m, ticks on the way, speed_mps) that by their ticks are longer than planned by MORE_M or so."""
    more = F.col("ticks") * 60 * F.col("speed_mps") - F.col("planned_m")
    return walks.groupBy(group).agg(F.count_if(more > MORE_M).alias("over"), F.round(F.max(more), 3).alias("worst"))


@query("chk_detour", f"WITH {PEOPLE}, {SITES}, {NEAREST} SELECT band, count(*) FILTER (more > {MORE_M}) AS over, round(max(more), 3) AS worst FROM (SELECT band, greatest(1, ceil(dist_m / (speed_mps * 60))) * 60 * speed_mps - dist_m AS more FROM near JOIN people USING (person_id)) GROUP BY band")
def chk_detour(spark, sf_dir):
    """The walks of sim_walk, by their ticks, against the ways to the nearest site that jn_knn_grid finds by rings."""
    plan = 60
    p = people(spark, sf_dir).select("person_id", "band", "speed_mps", "lon", "lat")
    s = sites(spark, sf_dir).where("operating").select("site_id", F.col("lon").alias("s_lon"), F.col("lat").alias("s_lat"))
    walked = sim_walk(spark, sf_dir, plan).select("person_id", (F.col("arrive_tick") - plan + 1).alias("ticks"))
    planned = nearest_by_rings(p.select("person_id", "lon", "lat", "band", "speed_mps"), s).select("person_id", "band", "speed_mps", F.col("dist_m").alias("planned_m"))
    return detours_over(planned.join(walked, "person_id"), "band")


#: rule: predicate that a row breaks it.
PART_RULES = {"size in range": "p_size NOT BETWEEN 1 AND 50", "price positive": "p_retailprice <= 0", "brand known": "p_brand NOT LIKE 'Brand#%'", "big parts cost": "p_size > 40 AND p_retailprice < 1000"}


@query("chk_registry", " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER ({p}) AS violations, min(p_partkey) FILTER ({p}) AS first_row FROM part" for k, p in PART_RULES.items()))
def chk_registry(spark, sf_dir):
    """All constraints in one pass over the registry."""
    one = read(spark, sf_dir, "part").agg(*(x for i, p in enumerate(PART_RULES.values()) for x in (F.count_if(F.expr(p)).alias(f"v{i}"), F.min(F.when(F.expr(p), F.col("p_partkey"))).alias(f"f{i}"))))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(f"v{i}").alias("violations"), F.col(f"f{i}").alias("first_row")) for i, k in enumerate(PART_RULES)))).alias("r")).select("r.*")


@query("chk_claims", """SELECT source, count(*) FILTER (regexp_matches(text, '(?i)guarantee')) AS guarantees, sum(len(regexp_extract_all(text, '(?i)licen[cs]e')))::BIGINT AS licences, count(*) AS texts FROM documents GROUP BY source""")
def chk_claims(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.col("text").rlike("(?i)guarantee")).alias("guarantees"), F.sum(F.regexp_count("text", F.lit("(?i)licen[cs]e"))).alias("licences"), F.count(F.lit(1)).alias("texts"))


@query("chk_candidate_rebuild", "SELECT count(*) AS missing FROM (SELECT DISTINCT l_suppkey FROM lineitem) WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)")
def chk_candidate_rebuild(spark, sf_dir):
    """Chosen keys that the rebuilt pool lacks."""
    chosen = read(spark, sf_dir, "lineitem").select("l_suppkey").distinct()
    return chosen.join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left_anti").agg(F.count(F.lit(1)).alias("missing"))


@query("snk_manifest", f"""WITH {OUTCOMES} SELECT arm, seed, count(*) AS n, count(*) FILTER (state = 'SHELTERED') AS inside FROM outcomes GROUP BY arm, seed""")
def snk_manifest(spark, sf_dir):
    """A nested JSON document for each run, written and read again by path."""
    from siteward.session import materialize

    o = outcomes(spark, sf_dir).groupBy("arm", "seed").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "SHELTERED").alias("inside"))
    doc = F.to_json(F.struct(F.struct("arm", "seed").alias("run"), F.struct("n", F.struct("inside").alias("states")).alias("population")))
    docs = materialize(o.select(doc.alias("json")), "manifests")
    get = lambda p: F.get_json_object("json", p)
    return docs.select(get("$.run.arm").alias("arm"), get("$.run.seed").cast("long").alias("seed"), get("$.population.n").cast("long").alias("n"), get("$.population.states.inside").cast("long").alias("inside"))


@query("snk_agents", "SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders")
def snk_agents(spark, sf_dir):
    """Written as quoted CSV with a header, in the shared folder, and read again with the schema: a round trip."""
    import uuid

    from siteward.session import scratch_root

    path = f"{scratch_root(spark)}/siteward-agents-{uuid.uuid4().hex}"
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    o.write.option("header", True).option("quoteAll", True).csv(path)
    return spark.read.schema(o.schema).option("header", True).option("enforceSchema", False).csv(path)
