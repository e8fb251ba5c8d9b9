"""Joins, sets, top-k, sampling and scalar functions of the study on the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteward.catalog import query
from siteward.functions.ranks import numbered
from siteward.operators.stand_ins import OUTCOMES, PEOPLE, SITES, outcomes, people, read, sites

R_MERCATOR = 6378137.0


@query("jn_equi_hash", "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def jn_equi_hash(spark, sf_dir):
    """Spark picks the strategy: broadcast where the statistics allow it, else sort-merge with skew handling."""
    return read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_mktsegment")


def norm_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


@query("jn_equi_norm", "SELECT s_suppkey, coalesce(n_name, '') AS nation FROM supplier LEFT JOIN nation ON regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') = 'nation' || s_nationkey")
def jn_equi_norm(spark, sf_dir):
    """A left join on names in lower case without other signs; unmatched names give an empty policy."""
    n = read(spark, sf_dir, "nation").select(norm_name(F.col("n_name")).alias("k"), "n_name")
    s = read(spark, sf_dir, "supplier").withColumn("k", F.concat(F.lit("nation"), F.col("s_nationkey").cast("string")))
    return s.join(F.broadcast(n), "k", "left").select("s_suppkey", F.coalesce("n_name", F.lit("")).alias("nation"))


@query("jn_semi", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def jn_semi(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey").join(read(spark, sf_dir, "lineitem").where("l_quantity > 49"), F.col("p_partkey") == F.col("l_partkey"), "left_semi")


@query("jn_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def jn_anti(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey").join(read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


#: id: (pattern, case-insensitive) of claims that a text may not make.
RULES = {"R1": ("guarantee[ds]?", True), "R2": ("[0-9]{4}-[0-9]{2}-[0-9]{2}", False), "R3": ("licen[cs]ed? under", True), "R4": ("[A-Z]{6,}", False)}


@query("jn_text_regex", " UNION ALL ".join(f"SELECT '{k}' AS rule, doc_id, len(regexp_extract_all(text, '{'(?i)' * i}{p}'))::BIGINT AS hits FROM documents WHERE regexp_matches(text, '{'(?i)' * i}{p}')" for k, (p, i) in RULES.items()))
def jn_text_regex(spark, sf_dir):
    """Rule by document, as an array of the few rules in each row: the texts are read once."""
    hits = F.array(*(F.struct(F.lit(k).alias("rule"), F.regexp_count("text", F.lit("(?i)" * i + p)).cast("long").alias("hits")) for k, (p, i) in RULES.items()))
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(hits, lambda h: h["hits"] > 0)).alias("h"))
    return d.select("h.rule", "doc_id", "h.hits")


@query("fn_regex_count_lines", r"SELECT doc_id, (len(string_split(text[:greatest(instr(text, 'icense') - 1, 0)], chr(10))))::BIGINT AS line, trim(regexp_replace(text, '\s+', ' ', 'g'))[:90] AS head FROM documents WHERE instr(text, 'icense') > 0")
def fn_regex_count_lines(spark, sf_dir):
    """The line of the first hit, and 90 characters with white space collapsed."""
    at = F.instr("text", "icense")
    line = (F.regexp_count(F.substring(F.col("text"), F.lit(1), at - 1), F.lit("\n")) + 1).cast("long")
    return read(spark, sf_dir, "documents").where(at > 0).select("doc_id", line.alias("line"), F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 90).alias("head"))


@query("jn_self_compare", """WITH x AS (SELECT o_orderkey AS k, o_totalprice AS p, o_orderstatus AS s FROM orders WHERE o_orderkey % 10 <> 3), y AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p, o_orderstatus AS s FROM orders WHERE o_orderkey % 10 <> 4)
SELECT count(*) FILTER (x.k IS NULL) AS only_right, count(*) FILTER (y.k IS NULL) AS only_left, count(*) FILTER (x.k IS NOT NULL AND y.k IS NOT NULL AND x.p IS DISTINCT FROM y.p) AS price_differs, count(*) FILTER (x.k IS NOT NULL AND y.k IS NOT NULL AND x.s IS DISTINCT FROM y.s) AS status_differs FROM x FULL JOIN y USING (k)""")  # fmt: skip
def jn_self_compare(spark, sf_dir):
    """A run against a changed copy: rows on one side only, and unequal columns. Grouped by key instead of a full join."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"), F.col("o_orderstatus").alias("s"))
    x = o.where("k % 10 != 3").withColumn("left", F.lit(True))
    y = o.where("k % 10 != 4").withColumns({"p": F.when(F.col("k") % 50 == 0, F.col("p") + 1).otherwise(F.col("p")), "left": F.lit(False)})
    side = lambda c, l: F.max(F.when(F.col("left") == l, F.col(c)))  # noqa: E731,E741
    g = x.unionByName(y).groupBy("k").agg(F.max("left").alias("in_x"), (~F.min("left")).alias("in_y"), side("p", True).alias("p1"), side("p", False).alias("p2"), side("s", True).alias("s1"), side("s", False).alias("s2"))
    both = F.col("in_x") & F.col("in_y")
    return g.agg(F.count_if(~F.col("in_x")).alias("only_right"), F.count_if(~F.col("in_y")).alias("only_left"), F.count_if(both & ~F.col("p1").eqNullSafe(F.col("p2"))).alias("price_differs"), F.count_if(both & ~F.col("s1").eqNullSafe(F.col("s2"))).alias("status_differs"))


@query("jn_asof_hour", "WITH t AS (SELECT o_orderkey, o_orderkey * 37 % 43200 AS tick FROM orders), h AS (SELECT datesub('hour', TIMESTAMP '2024-01-01', ts) AS hour, avg(value) AS c FROM events WHERE ts >= TIMESTAMP '2024-01-01' GROUP BY hour) SELECT o_orderkey, tick, round(c, 6) AS c FROM t LEFT JOIN h ON tick // 60 = hour")
def jn_asof_hour(spark, sf_dir):
    """The field at a tick: the as-of join of a step function is an equality of hours."""
    h = read(spark, sf_dir, "events").groupBy(F.timestamp_diff("HOUR", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts")).alias("hour")).agg(F.avg("value").alias("c"))
    t = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 37 % 43200).alias("tick"))
    return t.join(h, F.floor(F.col("tick") / 60) == F.col("hour"), "left").select("o_orderkey", "tick", F.round("c", 6).alias("c"))


@query("jn_interval_exposure", """WITH h AS (SELECT datesub('hour', TIMESTAMP '2024-01-01', ts) AS hour, avg(value) AS c FROM events WHERE ts >= TIMESTAMP '2024-01-01' GROUP BY hour), t AS (SELECT o_orderkey, o_orderkey * 11 % 300 AS a, o_orderkey * 11 % 300 + o_orderkey * 7 % 200 AS b FROM orders)
SELECT o_orderkey, a, b, round(coalesce(sum(c), 0), 7) AS exposure FROM t LEFT JOIN h ON hour >= a AND hour < b GROUP BY ALL""")  # fmt: skip
def jn_interval_exposure(spark, sf_dir):
    """Sums of the field over each person's hours as a difference of two prefix sums, both looked up by equality."""
    h = read(spark, sf_dir, "events").groupBy(F.timestamp_diff("HOUR", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts")).alias("hour")).agg(F.avg("value").alias("c"))
    grid = h.agg(F.max("hour").alias("last")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("last") + 1, F.lit(500).cast("long")))).alias("hour"))
    upto = F.sum(F.coalesce("c", F.lit(0.0))).over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1))  # a row an hour
    prefix = F.broadcast(grid.join(h, "hour", "left").select("hour", F.coalesce(upto, F.lit(0.0)).alias("p")))
    k = F.col("o_orderkey")
    t = read(spark, sf_dir, "orders").select("o_orderkey", (k * 11 % 300).alias("a"), (k * 11 % 300 + k * 7 % 200).alias("b"))
    pa, pb = prefix.select(F.col("hour").alias("a"), F.col("p").alias("pa")), prefix.select(F.col("hour").alias("b"), F.col("p").alias("pb"))
    return t.join(pa, "a").join(pb, "b").select("o_orderkey", "a", "b", F.round(F.col("pb") - F.col("pa"), 7).alias("exposure"))


@query("jn_shelter_agents", "SELECT s_suppkey, round(avg(l_extendedprice), 3) AS mean_travel FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE l_linestatus = 'F' GROUP BY s_suppkey")
def jn_shelter_agents(spark, sf_dir):
    """Averages by site first; the join then meets a row for each site."""
    per = read(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").groupBy("l_suppkey").agg(F.round(F.avg("l_extendedprice"), 3).alias("mean_travel"))
    return read(spark, sf_dir, "supplier").join(per, F.col("s_suppkey") == F.col("l_suppkey")).select("s_suppkey", "mean_travel")


# Sets.

A, B = "SELECT l_partkey AS k FROM lineitem WHERE l_quantity < 5", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45"


def _two(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    k = read(spark, sf_dir, "lineitem")
    return k.where("l_quantity < 5").select(F.col("l_partkey").alias("k")), k.where("l_quantity > 45").select(F.col("l_partkey").alias("k"))


@query("set_union_all", f"SELECT 'a' AS tag, k FROM ({A}) UNION ALL SELECT 'b', k FROM ({B})")
def set_union_all(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return a.select(F.lit("a").alias("tag"), "k").unionByName(b.select(F.lit("b").alias("tag"), "k"))


@query("set_distinct", "SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem")
def set_distinct(spark, sf_dir):
    """Undirected pairs once."""
    return read(spark, sf_dir, "lineitem").select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).distinct()


@query("set_intersect", f"{A} INTERSECT {B}")
def set_intersect(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return a.intersect(b)


@query("set_except", f"SELECT 'a' AS side, k FROM ({A} EXCEPT {B}) UNION ALL SELECT 'b', k FROM ({B} EXCEPT {A})")
def set_except(spark, sf_dir):
    """The symmetric difference, by one shuffle: keys that only one side has."""
    a, b = _two(spark, sf_dir)
    g = a.select("k", F.lit("a").alias("s")).unionByName(b.select("k", F.lit("b").alias("s"))).groupBy("k").agg(F.min("s").alias("side"), F.max("s").alias("m"))
    return g.where("side = m").select("side", "k")


@query("set_equal", f"WITH a AS (SELECT DISTINCT k FROM ({A})), b AS (SELECT DISTINCT k FROM ({B})) SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, NOT EXISTS (SELECT k FROM a EXCEPT SELECT k FROM b) AND NOT EXISTS (SELECT k FROM b EXCEPT SELECT k FROM a) AS equal")
def set_equal(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    g = a.select("k", F.lit(1).alias("s")).unionByName(b.select("k", F.lit(2).alias("s"))).groupBy("k").agg(F.bit_or("s").alias("s"))
    return g.agg(F.count_if(F.col("s") != 2).alias("n_a"), F.count_if(F.col("s") != 1).alias("n_b"), (F.count_if(F.col("s") != 3) == 0).alias("equal"))


# Top-k, sorts and samples.


@query("top_k", "(SELECT 'high' AS side, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5) UNION ALL (SELECT 'low', o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5)")
def top_k(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    high = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).withColumn("side", F.lit("high"))
    return high.unionByName(o.orderBy("o_totalprice", "o_orderkey").limit(5).withColumn("side", F.lit("low")))


@query("top_argmax", "SELECT c_mktsegment, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS best, arg_min(c_custkey, (c_acctbal, c_custkey)) AS worst FROM customer GROUP BY c_mktsegment")
def top_argmax(spark, sf_dir):
    return read(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("best"), F.min_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("worst"))


@query("top_limit_nodeorder", "SELECT p_partkey, p_brand FROM part WHERE p_size > 20 ORDER BY p_partkey LIMIT 500")
def top_limit_nodeorder(spark, sf_dir):
    return read(spark, sf_dir, "part").where("p_size > 20").select("p_partkey", "p_brand").orderBy("p_partkey").limit(500)


@query("sort_multi", "SELECT row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_type <> 'STANDARD', p_name, p_partkey) AS at, p_brand, p_partkey FROM part")
def sort_multi(spark, sf_dir):
    """A place in an order of several keys, over ranges of it."""
    p = read(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", (F.col("p_type") != "STANDARD").alias("odd"), "p_name")
    return numbered(p, ["p_brand"], ["p_size", "odd", "p_name", "p_partkey"]).select((F.col("number") + 1).alias("at"), "p_brand", "p_partkey")


@query("win_dedup_first", "SELECT p_brand, min(p_partkey) AS first_part FROM part GROUP BY p_brand")
def win_dedup_first(spark, sf_dir):
    """The first row of each cell in node order, as a minimum rather than a sort."""
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("first_part"))


def uniform(seed: int, stream: str, *key: Column) -> Column:
    """A draw in [0, 1) that depends on the seed, the stream and the key only: the same in any order and partitioning."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *(k.cast("string") for k in key))), 1, 13), 16, 10).cast("double")
    return h / float(16**13)


def _uniform_sql(seed: int, stream: str, key: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', '{stream}', {key}::VARCHAR)), 1, 13))::BIGINT::DOUBLE / {float(16**13)!r})"


@query("smp_uniform_replace", f"WITH n AS (SELECT count(*) AS n FROM supplier) SELECT c_custkey, 1 + floor({_uniform_sql(42, 'start', 'c_custkey')} * n)::BIGINT AS start_id FROM customer, n")
def smp_uniform_replace(spark, sf_dir):
    """Start points drawn with replacement."""
    n = F.broadcast(read(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n")))
    return read(spark, sf_dir, "customer").join(n).select("c_custkey", (1 + F.floor(uniform(42, "start", F.col("c_custkey")) * F.col("n"))).alias("start_id"))


@query("smp_seeded_no_replace", f"SELECT p_partkey FROM part ORDER BY {_uniform_sql(42, 'pool', 'p_partkey')}, p_partkey LIMIT 46")
def smp_seeded_no_replace(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey").orderBy(uniform(42, "pool", F.col("p_partkey")), "p_partkey").limit(46)


@query("smp_stratified", f"SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY {_uniform_sql(42, 'strata', 'p_partkey')}, p_partkey) <= 2")
def smp_stratified(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_brand", "p_partkey", uniform(42, "strata", F.col("p_partkey")).alias("u"))
    return p.withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy("u", "p_partkey"))).where("r <= 2").select("p_brand", "p_partkey")


@query("smp_rows_plus_worst", f"(SELECT o_orderkey FROM orders ORDER BY {_uniform_sql(42, 'rows', 'o_orderkey')}, o_orderkey LIMIT 20) UNION (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)")
def smp_rows_plus_worst(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    some = o.orderBy(uniform(42, "rows", F.col("o_orderkey")), "o_orderkey").limit(20).select("o_orderkey")
    return some.union(o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1).select("o_orderkey")).distinct()


# Samplers.

#: Shares of the age bands and of conditions.
AGE_BANDS = [("18-44", 0.527), ("45-64", 0.423), ("65+", 0.050)]
ASTHMA, COPD, CHRONIC = 0.15, 0.105, 0.391


@query("rnd_categorical", f"SELECT c_custkey, CASE WHEN u < 0.527 THEN '18-44' WHEN u < 0.95 THEN '45-64' ELSE '65+' END AS age_band FROM (SELECT c_custkey, {_uniform_sql(42, 'age', 'c_custkey')} AS u FROM customer)")
def rnd_categorical(spark, sf_dir):
    u = uniform(42, "age", F.col("c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey", F.when(u < 0.527, "18-44").when(u < 0.95, "45-64").otherwise("65+").alias("age_band"))


@query("rnd_population", f"SELECT c_custkey, {_uniform_sql(42, 'asthma', 'c_custkey')} < {ASTHMA} AS asthma, {_uniform_sql(42, 'copd', 'c_custkey')} < {COPD} AS copd, {_uniform_sql(42, 'chronic', 'c_custkey')} < {CHRONIC} AS chronic, {_uniform_sql(42, 'sex', 'c_custkey')} < 0.5 AS female FROM customer")
def rnd_population(spark, sf_dir):
    """Attributes from a stream each, so that arms share one population."""
    d = lambda s, p: (uniform(42, s, F.col("c_custkey")) < p).alias(s)
    return read(spark, sf_dir, "customer").select("c_custkey", d("asthma", ASTHMA), d("copd", COPD), d("chronic", CHRONIC), (uniform(42, "sex", F.col("c_custkey")) < 0.5).alias("female"))


@query("rnd_decision", f"SELECT c_custkey, {_uniform_sql(7, 'aware', 'c_custkey')} < 0.6 AS aware, {_uniform_sql(7, 'pet', 'c_custkey')} < 0.12 AS pet, {_uniform_sql(7, 'heavy', 'c_custkey')} < 0.3 AS heavy FROM customer")
def rnd_decision(spark, sf_dir):
    d = lambda s, p: (uniform(7, s, F.col("c_custkey")) < p).alias(s)
    return read(spark, sf_dir, "customer").select("c_custkey", d("aware", 0.6), d("pet", 0.12), d("heavy", 0.3))


@query("sim_departure_hazard", f"""WITH h AS (SELECT c_custkey, hour FROM customer, range(48) AS g(hour)), d AS (SELECT c_custkey, hour, {_uniform_sql(42, 'hazard', "c_custkey || '|' || hour")} < 1 / (1 + exp(-(-4.0 + 0.05 * hour))) AS leaves FROM h)
SELECT c_custkey, min(hour) FILTER (leaves) AS depart_hour FROM d GROUP BY c_custkey""")  # fmt: skip
def sim_departure_hazard(spark, sf_dir):
    """Hourly Bernoulli draws; the first that succeeds, found inside each row's array of hours."""
    k = F.col("c_custkey")
    go = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(47).cast("long")), lambda h: uniform(42, "hazard", k, h) < 1 / (1 + F.exp(-(F.lit(-4.0) + 0.05 * h))))
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_min(go).alias("depart_hour"))


# Scalar functions.


@query("fn_mercator", f"WITH {PEOPLE} SELECT person_id, round(radians(lon) * {R_MERCATOR}, 3) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * {R_MERCATOR}, 3) AS y FROM people")
def fn_mercator(spark, sf_dir):
    return people(spark, sf_dir).select("person_id", F.round(F.radians("lon") * R_MERCATOR, 3).alias("x"), F.round(F.log(F.tan(F.pi() / 4 + F.radians("lat") / 2)) * R_MERCATOR, 3).alias("y"))


@query("fn_mercator_inv", f"WITH {PEOPLE} SELECT person_id, round(lon, 9) AS lon, round(lat, 9) AS lat FROM people")
def fn_mercator_inv(spark, sf_dir):
    """There and back."""
    p = people(spark, sf_dir).select("person_id", (F.radians("lon") * R_MERCATOR).alias("x"), (F.log(F.tan(F.pi() / 4 + F.radians("lat") / 2)) * R_MERCATOR).alias("y"))
    return p.select("person_id", F.round(F.degrees(F.col("x") / R_MERCATOR), 9).alias("lon"), F.round(F.degrees(F.atan(F.sinh(F.col("y") / R_MERCATOR))), 9).alias("lat"))


@query("fn_dist_local", f"WITH {PEOPLE} SELECT person_id, round(sqrt(pow((lon + 122.5) * (111412.84 * cos(radians(lat)) - 93.5 * cos(3 * radians(lat))), 2) + pow((lat - 45.5) * (111132.92 - 559.82 * cos(2 * radians(lat))), 2)), 3) AS metres FROM people")
def fn_dist_local(spark, sf_dir):
    """Metres to a point by the lengths of a degree at the latitude."""
    f = F.radians("lat")
    x = (F.col("lon") + 122.5) * (111412.84 * F.cos(f) - 93.5 * F.cos(3 * f))
    y = (F.col("lat") - 45.5) * (111132.92 - 559.82 * F.cos(2 * f))
    return people(spark, sf_dir).select("person_id", F.round(F.sqrt(x * x + y * y), 3).alias("metres"))


@query("fn_polyline_len", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT vec_id, round(list_sum(list_transform(range(1, len(v)), lambda i: abs(v[i + 1] - v[i]))), 5) AS length, len(v)::BIGINT AS n FROM e")
def fn_polyline_len(spark, sf_dir):
    """The sum of steps along an array."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    e = read(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    steps = F.zip_with(F.slice("v", 2, F.size("v") - 1), F.slice("v", 1, F.size("v") - 1), lambda a, b: F.abs(a - b))
    return e.select("vec_id", F.round(F.aggregate(steps, F.lit(0.0), lambda s, x: s + x), 5).alias("length"), F.size("v").cast("long").alias("n"))


@query("fn_reverse_coords", "SELECT vec_id, list_reverse(embedding::DOUBLE[])[1:3] AS head FROM embeddings")
def fn_reverse_coords(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.reverse(F.transform("embedding", lambda x: x.cast("double"))), 1, 3).alias("head"))


@query("fn_pair_key", "SELECT least(o_custkey, o_orderkey) || '-' || greatest(o_custkey, o_orderkey) AS pair FROM orders")
def fn_pair_key(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.concat_ws("-", F.least("o_custkey", "o_orderkey").cast("string"), F.greatest("o_custkey", "o_orderkey").cast("string")).alias("pair"))


@query("fn_logistic", "SELECT c_custkey, round(1 / (1 + exp(-c_acctbal / 1000)), 9) AS p FROM customer")
def fn_logistic(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", F.round(1 / (1 + F.exp(-F.col("c_acctbal") / 1000)), 9).alias("p"))


@query("fn_utility", f"WITH {SITES} SELECT site_id, round(-0.5 * (1000.0 * site_id) / (3600 * 1.2) + 0.3 * ln(greatest(1, coalesce(capacity, 10000))), 6) AS v FROM sites")
def fn_utility(spark, sf_dir):
    v = -0.5 * (1000.0 * F.col("site_id")) / (3600 * 1.2) + 0.3 * F.log(F.greatest(F.lit(1), F.coalesce("capacity", F.lit(10000))))
    return sites(spark, sf_dir).select("site_id", F.round(v, 6).alias("v"))


@query("fn_decimal_scale", "SELECT l_orderkey, l_linenumber, regexp_replace(round(l_discount::DECIMAL(18,4) * 1.255::DECIMAL(6,3) * 1000, 1)::DECIMAL(18,1)::VARCHAR, '\\.0$', '') AS scaled FROM lineitem")
def fn_decimal_scale(spark, sf_dir):
    """Exact scaling, half up to one place, without a trailing .0."""
    x = F.round(F.col("l_discount").cast("decimal(18,4)") * F.lit("1.255").cast("decimal(6,3)") * 1000, 1).cast("decimal(18,1)").cast("string")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.regexp_replace(x, r"\.0$", "").alias("scaled"))


@query("fn_sha256", "SELECT doc_id, sha256(coalesce(text, ''))[:12] AS version FROM documents")
def fn_sha256(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), 1, 12).alias("version"))


@query("fn_norm_name", "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS name FROM part")
def fn_norm_name(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", norm_name(F.col("p_name")).alias("name"))


@query("fn_truthy", "SELECT event_id, lower(trim(event_type)) IN ('click', 'view', 'yes', 'true', '1') AS truthy FROM events")
def fn_truthy(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.lower(F.trim("event_type")).isin("click", "view", "yes", "true", "1").alias("truthy"))


@query("fn_json_path", "SELECT event_id, coalesce((props->>'$.k')::BIGINT, -1) AS k, props->>'$.none' AS missing FROM events")
def fn_json_path(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(-1)).alias("k"), F.get_json_object("props", "$.none").alias("missing"))


@query("fn_seed_derive", "SELECT c_custkey, (c_nationkey::BIGINT * 1000003 + 17) AS seed, (c_nationkey::BIGINT * 1000003 + 17 + 7919) AS decision_seed FROM customer")
def fn_seed_derive(spark, sf_dir):
    s = F.col("c_nationkey").cast("long") * 1000003 + 17
    return read(spark, sf_dir, "customer").select("c_custkey", s.alias("seed"), (s + 7919).alias("decision_seed"))


@query("fn_shift_days", "SELECT o_orderkey, (o_orderdate::DATE + 3)::DATE AS shifted FROM orders")
def fn_shift_days(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", F.date_add(F.col("o_orderdate").cast("date"), 3).alias("shifted"))


@query("fn_tick_for_date", "SELECT o_orderkey, datesub('hour', TIMESTAMP '1995-01-01', o_orderdate) * 60 AS tick FROM orders")
def fn_tick_for_date(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", (F.timestamp_diff("HOUR", F.lit("1995-01-01").cast("timestamp_ntz"), F.col("o_orderdate")) * 60).alias("tick"))


@query("fn_format", "SELECT o_orderkey, printf('%.2f', o_totalprice) AS price FROM orders")
def fn_format(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", F.format_string("%.2f", "o_totalprice").alias("price"))


@query("fn_seg_intersect", f"""WITH {PEOPLE}, q AS (SELECT person_id, lon AS ax, lat AS ay, lon + 0.2 AS bx, lat - 0.15 AS cy FROM people), o AS (SELECT person_id, (bx - ax) * (45.2 - ay) - (cy - ay) * (-122.6 - ax) AS d1, (bx - ax) * (45.8 - ay) - (cy - ay) * (-122.4 - ax) AS d2,
 0.2 * (ay - 45.2) - 0.6 * (ax + 122.6) AS d3, 0.2 * (cy - 45.2) - 0.6 * (bx + 122.6) AS d4 FROM q) SELECT person_id, d1 * d2 < 0 AND d3 * d4 < 0 AS crosses FROM o""")  # fmt: skip
def fn_seg_intersect(spark, sf_dir):
    """Whether a person's segment crosses the river segment, by orientations."""
    ax, ay, bx, by = F.col("lon"), F.col("lat"), F.col("lon") + 0.2, F.col("lat") - 0.15
    d1, d2 = (bx - ax) * (45.2 - ay) - (by - ay) * (-122.6 - ax), (bx - ax) * (45.8 - ay) - (by - ay) * (-122.4 - ax)
    d3, d4 = 0.2 * (ay - 45.2) - 0.6 * (ax + 122.6), 0.2 * (by - 45.2) - 0.6 * (bx + 122.6)
    return people(spark, sf_dir).select("person_id", ((d1 * d2 < 0) & (d3 * d4 < 0)).alias("crosses"))


@query("prj_coalesce_name", "SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_size % 5 = 0 THEN ' ' ELSE p_name END), ''), nullif(trim(CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END), ''), 'unnamed street') AS street FROM part")
def prj_coalesce_name(spark, sf_dir):
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return read(spark, sf_dir, "part").select("p_partkey", F.coalesce(blank(F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.col("p_name"))), blank(F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_brand"))), F.lit("unnamed street")).alias("street"))


@query("prj_type_guard", "SELECT event_id, try_cast(CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE value::VARCHAR END AS DOUBLE) AS v FROM events")
def prj_type_guard(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("value").cast("string")).try_cast("double").alias("v"))


@query("prj_zero_div_guard", "SELECT c_custkey, round(c_acctbal / nullif(c_custkey % 4, 0), 6) AS ratio FROM customer")
def prj_zero_div_guard(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", F.round(F.try_divide("c_acctbal", F.col("c_custkey") % 4), 6).alias("ratio"))


@query("prj_clip", "SELECT c_custkey, least(greatest(c_acctbal, 0), 5000)::DOUBLE AS clipped FROM customer")
def prj_clip(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", F.least(F.greatest("c_acctbal", F.lit(0.0)), F.lit(5000.0)).alias("clipped"))


@query("prj_approx_eq", "SELECT l_orderkey, l_linenumber, coalesce(abs(l_tax - l_discount) <= greatest(0.005, 0.3 * greatest(abs(l_tax), abs(l_discount))), false) AS near FROM lineitem")
def prj_approx_eq(spark, sf_dir):
    a, b = F.col("l_tax"), F.col("l_discount")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(F.abs(a - b) <= F.greatest(F.lit(0.005), 0.3 * F.greatest(F.abs(a), F.abs(b))), F.lit(False)).alias("near"))


@query("flt_bbox", f"WITH {PEOPLE}, {SITES}, b AS (SELECT min(lon) + 0.3 AS x0, max(lon) - 0.3 AS x1, min(lat) AS y0, max(lat) AS y1 FROM people) SELECT site_id FROM sites, b WHERE lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1")
def flt_bbox(spark, sf_dir):
    """Sites inside the box of demand; the box is one row."""
    b = F.broadcast(people(spark, sf_dir).agg((F.min("lon") + 0.3).alias("x0"), (F.max("lon") - 0.3).alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1")))
    return sites(spark, sf_dir).join(b).where("lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1").select("site_id")


@query("flt_terminal_state", f"WITH {OUTCOMES} SELECT person_id FROM outcomes WHERE state = 'SHELTERED'")
def flt_terminal_state(spark, sf_dir):
    return outcomes(spark, sf_dir).where("state = 'SHELTERED'").select("person_id")
