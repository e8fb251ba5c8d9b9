"""File sources: tolerant and strict CSV, XML parameters, run directories.

The queries write a driver table in the dialect to the shared folder and read it back, so that the oracle is the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from siteward.catalog import query
from siteward.session import scratch_root


def all_strings(names: list[str]) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The header's names, without a byte order mark; of several files, of the first by name."""
    first = spark.read.text(path).limit(1).first()
    if first is None:
        raise ValueError(f"{path} is empty")
    row = spark.createDataFrame([(first[0].lstrip("﻿"),)], "line string")
    n = len(first[0].split(","))
    fields = row.select(F.from_csv("line", F.lit(", ".join(f"c{k} string" for k in range(n)))).alias("c")).select("c.*").first()
    return [x.lstrip("\ufeff").strip() for x in fields if x is not None]


def read_tolerant(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """Header CSV, all strings, trimmed even inside quotes: blank lines are skipped, short rows padded with "", surplus fields
    dropped, "" is an escaped quote, and missing values are ""."""
    names = names or header_of(spark, path)
    raw = spark.read.schema(all_strings(names)).option("header", True).option("escape", '"').option("mode", "PERMISSIVE").option("nullValue", "\x00").option("emptyValue", "")
    rows = raw.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return rows.select(*(F.coalesce(F.trim(F.col(f"`{n}`")), F.lit("")).alias(n) for n in names))


def read_strict(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Header CSV with exactly the given columns; a wrong field count, a repeated or unknown header or an empty file fails."""
    header = header_of(spark, path)
    if len(set(header)) != len(header):
        raise ValueError(f"repeated header in {path}")
    if header != names:
        raise ValueError(f"columns {header}, not {names}")
    return spark.read.schema(all_strings(names)).option("header", True).option("enforceSchema", False).option("escape", '"').option("mode", "FAILFAST").csv(path)


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns cast where they can be; blanks and what is no value become null."""
    return df.withColumns({c: F.nullif(F.trim(c), F.lit("")).try_cast(t) for c, t in types.items()})


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/siteward-{name}-{uuid.uuid4().hex}"


def _orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


@query("src_csv_tolerant", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def src_csv_tolerant(spark, sf_dir):
    path = _scratch(spark, "tolerant")
    o = _orders(spark, sf_dir).select("o_orderkey", F.concat(F.lit("  "), "o_orderpriority", F.lit(" ")).alias("o_orderpriority"), "o_totalprice")
    o.write.option("header", True).option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return typed(read_tolerant(spark, path, o.columns), {"o_orderkey": "long", "o_totalprice": "double"})


@query("src_csv_strict", "SELECT p_partkey, p_name, p_brand FROM part")
def src_csv_strict(spark, sf_dir):
    path = _scratch(spark, "strict")
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand")
    p.write.option("header", True).option("escape", '"').csv(path)
    return typed(read_strict(spark, path, p.columns), {"p_partkey": "long"})


@query("src_params_xml", "SELECT s_suppkey AS value, 'capacity' || s_suppkey AS name FROM supplier")
def src_params_xml(spark, sf_dir):
    """Parameters as XML attributes."""
    path = _scratch(spark, "params")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    s.select(F.concat(F.lit("capacity"), F.col("s_suppkey").cast("string")).alias("_name"), F.col("s_suppkey").alias("_value")).write.format("xml").option("rowTag", "parameter").option("rootTag", "sweep").save(path)
    x = spark.read.format("xml").option("rowTag", "parameter").schema("_name string, _value long").load(path)
    return x.select(F.col("_value").alias("value"), F.col("_name").alias("name"))


@query("src_run_dir", "SELECT o_orderkey, substr(o_orderpriority, 1, 1) AS arm, year(o_orderdate)::INT AS seed FROM orders")
def src_run_dir(spark, sf_dir):
    """Runs as partitions (arm, seed) of one table: a run is chosen by pruning directories, not by reading files."""
    path = _scratch(spark, "runs")
    o = _orders(spark, sf_dir).select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("arm"), F.year("o_orderdate").alias("seed"))
    o.repartition("arm", "seed", F.pmod("o_orderkey", F.lit(8))).write.partitionBy("arm", "seed").parquet(path)
    return spark.read.schema("o_orderkey long, arm string, seed int").parquet(path)


def written(df: DataFrame, name: str, **options) -> str:
    """df as quoted CSV with a header and lines ended by CR LF, the first name with a byte order mark (inside its quotes, where Spark
    can put it); the path."""
    path = _scratch(df.sparkSession, name)
    df.toDF("\ufeff" + df.columns[0], *df.columns[1:]).write.options(header=True, quoteAll=True, escape='"', lineSep="\r\n", emptyValue="", nullValue="").options(**options).csv(path)
    return path


@query("snk_csv_dialect", """SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN '' WHEN n_nationkey % 5 = 1 THEN 'say "' || n_name || '", twice' ELSE n_name || ', x' END AS n_name FROM nation""")
def snk_csv_dialect(spark, sf_dir):
    """All fields quoted, a byte order mark, lines ended by CR LF; quotes, commas and blanks come back as they were, null as blank."""
    k = F.col("n_nationkey")
    name = F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 == 1, F.concat(F.lit('say "'), "n_name", F.lit('", twice'))).otherwise(F.concat("n_name", F.lit(", x")))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", name.alias("n_name"))
    return typed(read_tolerant(spark, written(n, "dialect"), n.columns), {"n_nationkey": "int"})


@query("src_param_default", "SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey ELSE 42 END AS seed FROM customer")
def src_param_default(spark, sf_dir):
    """Runs' parameters from XML files: one that a run does not name has its default."""
    path = _scratch(spark, "run-params")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("_run"), F.lit("randomSeed").alias("_name"), F.lit("int").alias("_type"), F.col("n_nationkey").cast("string").alias("_value"))
    n.write.format("xml").option("rowTag", "parameter").option("rootTag", "sweep").save(path)
    params = spark.read.format("xml").option("rowTag", "parameter").schema("_run int, _name string, _type string, _value string").load(path)
    seed = params.where("_name = 'randomSeed'").select(F.col("_run").alias("c_nationkey"), F.col("_value").try_cast("int").alias("seed"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    return c.join(seed, "c_nationkey", "left").select("c_custkey", F.coalesce("seed", F.lit(42)).alias("seed"))


AQS = ["State Code", "County Code", "Site Num", "Date Local", "Time Local", "Sample Measurement", "County Name"]


def read_measurements(spark: SparkSession, path: str, county: str) -> DataFrame:
    """site, ts, c of one county, its name compared without case; rows whose time or value cannot be read are left out."""
    rows = read_tolerant(spark, path).where(F.lower("County Name") == county.lower())
    at = F.try_to_timestamp(F.concat_ws(" ", "Date Local", F.substring("Time Local", 1, 5)), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")
    return rows.select(F.col("Site Num").try_cast("long").alias("site"), at.alias("ts"), F.nullif("Sample Measurement", F.lit("")).try_cast("double").alias("c")).where("ts IS NOT NULL AND c IS NOT NULL")


@query("src_aqs", "SELECT user_id AS site, date_trunc('minute', ts) AS ts, value AS c FROM events WHERE event_type = 'click' AND event_id % 17 <> 0 AND event_id % 19 <> 0 AND value IS NOT NULL")
def src_aqs(spark, sf_dir):
    """The monitors' file, with blank and unreadable measurements."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.when(F.col("event_id") % 17 == 0, "").when(F.col("event_id") % 19 == 0, "n/a").otherwise(F.col("value").cast("string"))
    cols = [F.lit("41"), F.lit("051"), F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm"), value, F.initcap("event_type")]
    return read_measurements(spark, written(e.select(*(c.alias(n) for c, n in zip(cols, AQS))), "aqs"), "CLICK")


@query("src_encampments", "SELECT event_id::VARCHAR AS inc_id, value AS lon, value / 2 AS lat FROM events WHERE event_id % 4 <> 0 AND event_id % 9 <> 0")
def src_encampments(spark, sf_dir):
    """Start points; malformed rows are left out without a word."""
    k = F.col("event_id")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.when(k % 4 == 0, "?").otherwise(F.col("value").cast("string")).alias("lon"), F.when(k % 9 == 0, "").otherwise((F.col("value") / 2).cast("string")).alias("lat"), k.cast("string").alias("inc_id"))
    rows = read_tolerant(spark, written(e, "encampments"))
    return rows.select("inc_id", *(F.nullif(c, F.lit("")).try_cast("double").alias(c) for c in ("lon", "lat"))).where("lon IS NOT NULL AND lat IS NOT NULL")


@query("src_shelters", "SELECT s_suppkey::VARCHAR AS shelter_id, s_acctbal AS lon, s_acctbal + 1 AS lat, CASE WHEN s_suppkey % 4 <> 0 THEN 5 + s_suppkey % 11 END::INT AS capacity, s_suppkey % 3 < 2 AS operating, s_suppkey % 10 = 3 AS adults_only FROM supplier WHERE s_suppkey % 13 <> 5")
def src_shelters(spark, sf_dir):
    """Sites: a blank capacity is none, the status is compared without case, and a place without coordinates is left out."""
    k = F.col("s_suppkey")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        k.cast("string").alias("shelter_id"),
        F.when(k % 13 == 5, "").otherwise(F.col("s_acctbal").cast("string")).alias("lon"),
        (F.col("s_acctbal") + 1).cast("string").alias("lat"),
        F.when(k % 4 == 0, "").otherwise((5 + k % 11).cast("string")).alias("capacity"),
        F.when(k % 3 == 0, "Operating ").when(k % 3 == 1, "operating").otherwise("standby").alias("status"),
        F.when(k % 10 == 3, "TRUE").when(k % 10 == 4, "no").alias("adults_only"),
    )
    rows = read_tolerant(spark, written(s, "shelters"))
    rows = typed(rows, {"lon": "double", "lat": "double", "capacity": "int"}).where("lon IS NOT NULL AND lat IS NOT NULL")
    return rows.select("shelter_id", "lon", "lat", "capacity", (F.lower("status") == "operating").alias("operating"), F.lower("adults_only").isin("true", "yes", "1", "y").alias("adults_only"))


def read_closures(spark: SparkSession, path: str, end_hour: int) -> DataFrame:
    """node_a, node_b, activation_hour, after_end; a node or hour that is no number, or an hour below 0, fails with its line."""
    rows = read_tolerant(spark, path)
    number = lambda c, t: F.coalesce(F.nullif(c, F.lit("")).try_cast(t), F.raise_error(F.concat(F.lit(f"{c} is no number: "), F.to_json(F.struct(*rows.columns)))).cast(t))
    hour = number("activation_hour", "int")
    out = rows.select(number("node_a", "long").alias("node_a"), number("node_b", "long").alias("node_b"), hour.alias("activation_hour"))
    ok = F.when(F.col("activation_hour") < 0, F.raise_error(F.concat(F.lit("negative hour at "), "node_a", F.lit(" "), "node_b")).cast("int")).otherwise(F.col("activation_hour"))
    return out.select("node_a", "node_b", ok.alias("activation_hour"), (F.col("activation_hour") >= end_hour).alias("after_end"))


@query("src_closures", "SELECT l_suppkey AS node_a, l_partkey AS node_b, (l_linenumber * 24)::INT AS activation_hour, l_linenumber * 24 >= 100 AS after_end FROM lineitem")
def src_closures(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("node_a"), F.col("l_partkey").alias("node_b"), (F.col("l_linenumber") * 24).alias("activation_hour"), F.lit("local").alias("kind"))
    return read_closures(spark, written(c, "closures"), 100)


#: Values that the registries' columns may have.
CLASSES, YES_NO = ["M", "L", "C", "A", "F"], ["yes", "no"]


@query(
    "src_registry",
    """WITH v AS (SELECT p_partkey AS id, CASE WHEN p_size % 17 = 0 THEN 'Q' ELSE ['M', 'L', 'C', 'A', 'F'][p_partkey % 5 + 1] END AS class, CASE WHEN p_size % 11 = 0 THEN '' ELSE 'doi' END AS doi, CASE WHEN p_size % 19 = 0 THEN 'maybe' ELSE 'yes' END AS moves FROM part)
SELECT 'evidence class' AS rule, count(*) FILTER (class NOT IN ('M', 'L', 'C', 'A', 'F')) AS violations FROM v UNION ALL SELECT 'source of literature', count(*) FILTER (class = 'L' AND doi = '') FROM v UNION ALL SELECT 'yes or no', count(*) FILTER (moves NOT IN ('yes', 'no')) FROM v UNION ALL SELECT 'unique ids', count(*) - count(DISTINCT id) FROM v""",
)
def src_registry(spark, sf_dir):
    """A registry of variables, read strictly and held against its rules."""
    k = F.col("p_partkey")
    v = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        k.cast("string").alias("variable_id"),
        F.when(F.col("p_size") % 17 == 0, "Q").otherwise(F.get(F.array(*map(F.lit, CLASSES)), (k % 5).cast("int"))).alias("evidence_class"),
        F.when(F.col("p_size") % 11 == 0, "").otherwise("doi").alias("doi_or_dataset"),
        F.when(F.col("p_size") % 19 == 0, "maybe").otherwise("yes").alias("affects_movement"),
    )
    path = _scratch(spark, "registry")
    v.write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)
    r = read_strict(spark, path, v.columns).select("variable_id", "evidence_class", F.coalesce("doi_or_dataset", F.lit("")).alias("doi"), "affects_movement")
    one = r.agg(
        F.count_if(~F.col("evidence_class").isin(CLASSES)).alias("evidence class"),
        F.count_if((F.col("evidence_class") == "L") & (F.col("doi") == "")).alias("source of literature"),
        F.count_if(~F.col("affects_movement").isin(YES_NO)).alias("yes or no"),
        (F.count(F.lit(1)) - F.count_distinct("variable_id")).alias("unique ids"),
    )
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").alias("violations")) for c in one.columns))).alias("r")).select("r.*")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def variant(spark: SparkSession, path: str, layer: bool) -> str:
    """The path, or that of its _elayer variant, which must be there."""
    if not layer:
        return path
    if not exists(spark, f"{path}_elayer"):
        raise FileNotFoundError(f"{path}_elayer")
    return f"{path}_elayer"


@query("src_variant_file", "SELECT s_suppkey::VARCHAR AS shelter_id, CASE WHEN s_suppkey % 2 = 0 THEN 'admit' ELSE 'refuse' END AS pet_intake, true AS layer FROM supplier UNION ALL SELECT s_suppkey::VARCHAR, '', false FROM supplier")
def src_variant_file(spark, sf_dir):
    """One file of sites with the policies of a variant and one without, chosen by a flag."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("shelter_id"), F.when(F.col("s_suppkey") % 2 == 0, "admit").otherwise("refuse").alias("pet_intake"))
    path = _scratch(spark, "sites")
    s.drop("pet_intake").write.option("header", True).csv(path)
    s.write.option("header", True).csv(f"{path}_elayer")
    both = read_tolerant(spark, variant(spark, path, True), s.columns).withColumn("layer", F.lit(True))
    plain = read_tolerant(spark, variant(spark, path, False), ["shelter_id"]).select("shelter_id", F.lit("").alias("pet_intake"), F.lit(False).alias("layer"))
    return both.unionByName(plain)


#: Scenario codes: (name, file of sites). Others are the first.
SCENARIOS = {k: (f"arm-{chr(65 + k % 21)}", f"sites_{chr(97 + k % 21)}.csv") for k in range(21)}


@query("src_scenario_registry", f"WITH r(code, name, file) AS (VALUES {', '.join(f"({k}, '{n}', '{f}')" for k, (n, f) in SCENARIOS.items())}) SELECT c_custkey, coalesce(name, 'arm-A') AS name, coalesce(file, 'sites_a.csv') AS file FROM customer LEFT JOIN r ON code = c_nationkey")
def src_scenario_registry(spark, sf_dir):
    """A code's scenario and its file; an unknown code is the first arm's."""
    r = spark.createDataFrame([(k, *v) for k, v in SCENARIOS.items()], "c_nationkey int, name string, file string")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    return c.join(F.broadcast(r), "c_nationkey", "left").select("c_custkey", F.coalesce("name", F.lit(SCENARIOS[0][0])).alias("name"), F.coalesce("file", F.lit(SCENARIOS[0][1])).alias("file"))


def guarded(code, least: int, most: int, name: str):
    """The code; one out of range fails."""
    return F.when((code >= least) & (code <= most), code).otherwise(F.raise_error(F.concat(F.lit(f"{name} out of range: "), F.coalesce(code.cast("string"), F.lit("null")))).cast("int"))


@query("src_selector_guard", "SELECT c_custkey, c_nationkey AS code FROM customer")
def src_selector_guard(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select("c_custkey", guarded(F.col("c_nationkey"), 0, 24, "scenarioCode").alias("code"))


@query("src_run_rawtext", "SELECT o_orderkey::VARCHAR AS id, CASE o_orderkey % 4 WHEN 0 THEN 'NA' WHEN 1 THEN '' WHEN 2 THEN '007' ELSE 'null' END AS raw FROM orders")
def src_run_rawtext(spark, sf_dir):
    """All columns as they are written: NA, null, blanks and leading zeros are text."""
    k = F.col("o_orderkey")
    o = _orders(spark, sf_dir).select(k.cast("string").alias("id"), F.when(k % 4 == 0, "NA").when(k % 4 == 1, "").when(k % 4 == 2, "007").otherwise("null").alias("raw"))
    return read_tolerant(spark, written(o, "rawtext"), o.columns)


def resolve_run(spark: SparkSession, name: str, roots: list[str]) -> str:
    """The folder of a run: the name itself if it is a path that is there, else the first root, in order, that has it directly or
    under one more folder; of several there the first by name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for pattern in [name, *(f"{r}/{deep}{name}" for r in roots for deep in ("", "*/"))]:
        if pattern == name and "/" not in name:
            continue
        p = jvm.org.apache.hadoop.fs.Path(pattern)
        found = p.getFileSystem(conf).globStatus(p)
        if found is not None and len(found):
            return sorted(f.getPath().toString() for f in found)[0]
    raise FileNotFoundError(f"{name} is in none of {roots}")


@query("src_run_resolve", "SELECT 'run-' || o_orderstatus AS run, CASE o_orderstatus WHEN 'O' THEN 'second' ELSE 'first' END AS root, count(*) AS n FROM orders GROUP BY ALL")
def src_run_resolve(spark, sf_dir):
    """Runs by name under several roots, some of them one folder deeper."""
    root = _scratch(spark, "roots")
    o = _orders(spark, sf_dir).select("o_orderkey", "o_orderstatus")
    for status, where in (("F", "first"), ("O", "second/deeper"), ("P", "first/other")):
        o.where(F.col("o_orderstatus") == status).drop("o_orderstatus").write.parquet(f"{root}/{where}/run-{status}")
    out = []
    for status in ("F", "O", "P"):
        path = resolve_run(spark, f"run-{status}", [f"{root}/first", f"{root}/second"])
        out.append(spark.read.schema("o_orderkey long").parquet(path).agg(F.lit(f"run-{status}").alias("run"), F.lit("second" if "/second/" in path else "first").alias("root"), F.count(F.lit(1)).alias("n")))
    return out[0].unionByName(out[1]).unionByName(out[2]).where("n > 0")


#: What a claim's status may be.
STATUSES = ["forbidden", "superseded", "allowed"]


def checked_rules(c: DataFrame) -> DataFrame:
    """Claims with what is left out as it counts. A claim without a pattern, with an unknown status, or a superseded one without
    replacement fails."""
    bad = F.col("pattern").isNull() | F.col("id").isNull() | ~F.coalesce(F.col("status").isin(STATUSES), F.lit(False)) | ((F.col("status") == "superseded") & F.col("replacement").isNull())
    status = F.when(bad, F.raise_error(F.concat(F.lit("bad claim "), F.coalesce("id", F.lit("without id")))).cast("string")).otherwise(F.col("status"))
    return c.select("id", "pattern", F.coalesce("regex", F.lit(False)).alias("regex"), F.coalesce("case_insensitive", F.lit(False)).alias("case_insensitive"), status.alias("status"), "replacement")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A registry of claims in YAML's flow style, which is JSON: id, pattern, status and the flags, which are false by default."""
    schema = "deliverables array<string>, claims array<struct<id:string,pattern:string,regex:boolean,case_insensitive:boolean,status:string,replacement:string,note:string>>"
    return checked_rules(spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("claims")))


#: A line of a block: what it is indented by, whether an item begins, its key, and its value; a value in quotes may hold anything.
ENTRY = r"""^( *)(- +)?([A-Za-z_][A-Za-z0-9_]*):(?: +('(?:[^']|'')*'|"(?:[^"\\]|\\.)*"|[^'"#].*?))?(?: *| +#.*)$"""


def read_block_rules(spark: SparkSession, path: str) -> DataFrame:
    """The same registry in YAML's block style: under `claims:`, items of `key: value` lines, values plain or in quotes. Comments and
    empty lines are skipped; other top-level keys are, with what is under them. Another kind of line under claims, or a key twice in
    an item, fails with its file and number. An empty list of claims is an empty table. A registry is one file, read as one row."""
    line = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    line = line.select("file", (F.col("n") + 1).alias("n"), F.rtrim("line").alias("line")).where((F.trim("line") != "") & ~F.ltrim("line").startswith("#") & ~F.col("line").isin("---", "..."))
    part = lambda k: F.regexp_extract("line", ENTRY, k)
    by_line = Window.partitionBy("file").orderBy("n")  # the lines of a registry
    top = F.when(~F.col("line").rlike("^[ -]"), F.coalesce(F.nullif(part(3), F.lit("")), F.lit("?")))
    line = line.withColumns({"key": part(3), "starts": part(2) != "", "value": part(4), "top": F.last(top, ignorenulls=True).over(by_line)})
    line = line.where((F.col("top") == "claims") & ~F.col("line").rlike(r"^claims: *(\[ *\])? *(#.*)?$"))
    line = line.withColumn("item", F.sum(F.col("starts").cast("int")).over(by_line))
    twice = F.count(F.lit(1)).over(Window.partitionBy("file", "item", "key"))
    where = F.concat(F.lit("line "), F.col("n").cast("string"), F.lit(" of "), F.col("file"), F.lit(": "), F.col("line"))
    key = F.when((F.col("key") == "") | (F.col("item") == 0) | (twice > 1), F.raise_error(where).cast("string")).otherwise(F.col("key"))
    v = F.col("value")
    inner = v.substr(F.lit(2), F.length(v) - 2)
    escaped = F.regexp_replace(F.replace(inner, F.lit("\\n"), F.lit("\n")), r"\\(.)", "$1")
    text = F.when(v.startswith("'"), F.replace(inner, F.lit("''"), F.lit("'"))).when(v.startswith('"'), escaped).otherwise(F.nullif(v, F.lit("")))
    rows = line.select("file", "item", key.alias("key"), text.alias("value"))
    names = ["id", "pattern", "regex", "case_insensitive", "status", "replacement"]
    one = rows.groupBy("file", "item").agg(*(F.max(F.when(F.col("key") == c, F.col("value"))).alias(c) for c in names))
    true = lambda c: F.lower(c).isin("true", "yes", "on")
    return checked_rules(one.withColumns({"regex": true(F.col("regex")), "case_insensitive": true(F.col("case_insensitive"))}))


@query("src_yaml_rules", "SELECT 'R' || n_nationkey AS id, n_name AS pattern, n_nationkey % 2 = 0 AS regex, false AS case_insensitive, CASE WHEN n_nationkey % 3 = 0 THEN 'superseded' ELSE 'forbidden' END AS status, CASE WHEN n_nationkey % 3 = 0 THEN 'say so' END AS replacement FROM nation")
def src_yaml_rules(spark, sf_dir):
    """A registry made of nations, written in block style and read again."""
    k = F.col("n_nationkey")
    quoted = F.concat(F.lit("'"), F.replace("n_name", F.lit("'"), F.lit("''")), F.lit("'"))
    item = F.concat_ws("\n", F.concat(F.lit("  - id: R"), k.cast("string")), F.concat(F.lit("    pattern: "), quoted, F.lit("  # a name")), F.when(k % 2 == 0, F.lit("    regex: true")), F.concat(F.lit("    status: "), F.when(k % 3 == 0, "superseded").otherwise("forbidden")), F.when(k % 3 == 0, F.lit('    replacement: "say so"')))
    path = _scratch(spark, "rules")
    items = spark.read.parquet(f"{sf_dir}/nation.parquet").agg(F.concat_ws("\n", F.lit("# claims"), F.lit("deliverables:\n  - docs/*.md\nclaims:"), F.sort_array(F.collect_list(item))).alias("value"))  # a registry's rules
    items.coalesce(1).write.text(path)
    return read_block_rules(spark, path)


def text_glob(spark: SparkSession, patterns: list[str]) -> tuple[DataFrame, list[str]]:
    """(lines with their path, patterns that match nothing)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found, missing = [], []
    for pattern in patterns:
        p = jvm.org.apache.hadoop.fs.Path(pattern)
        hits = p.getFileSystem(conf).globStatus(p)
        (found.extend if hits is not None and len(hits) else missing.append)(pattern if hits is None or not len(hits) else [f.getPath().toString() for f in hits])
    lines = spark.read.option("lineSep", "\n").text(found) if found else spark.createDataFrame([], "value string")
    return lines.select("value", F.input_file_name().alias("path")), missing


@query("src_text_glob", "SELECT source, count(*) AS texts, sum(length(replace(coalesce(text, ''), chr(10), ' ')))::BIGINT AS characters, 1 AS missing FROM documents WHERE source IS NOT NULL GROUP BY source")
def src_text_glob(spark, sf_dir):
    """Text files by patterns; a pattern without a file is told, not an error."""
    path = _scratch(spark, "texts")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("source IS NOT NULL").select("source", F.translate(F.coalesce("text", F.lit("")), "\n", " ").alias("value"))
    d.write.partitionBy("source").option("lineSep", "\n").text(path)
    lines, missing = text_glob(spark, [f"{path}/source=*", f"{path}/none=*"])
    return lines.groupBy(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source")).agg(F.count(F.lit(1)).alias("texts"), F.sum(F.char_length("value")).alias("characters"), F.lit(len(missing)).alias("missing"))


# Sinks: each writes its format in the shared folder; the query is what is read back.


@query("snk_batch_xml", "SELECT r_name AS arm, n_nationkey AS seed, d::INT AS draw FROM region, nation, range(3) AS g(d)")
def snk_batch_xml(spark, sf_dir):
    """The parameter grid of arms by seeds by draws as XML files, a parameter an element, read again."""
    arms = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_name").alias("arm"))
    seeds = F.broadcast(spark.read.parquet(f"{sf_dir}/nation.parquet").agg(F.sort_array(F.collect_set("n_nationkey")).alias("seeds")))
    grid = arms.join(seeds).select("arm", F.explode("seeds").alias("seed")).select("arm", "seed", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("draw"))
    param = lambda n, t, v: F.struct(F.lit(n).alias("_name"), F.lit(t).alias("_type"), v.cast("string").alias("_value"))
    path = _scratch(spark, "batch")
    grid.select(F.array(param("arm", "string", F.col("arm")), param("randomSeed", "int", F.col("seed")), param("closureDraw", "int", F.col("draw"))).alias("parameter")).write.format("xml").option("rowTag", "sweep").option("rootTag", "batch").save(path)
    x = spark.read.format("xml").option("rowTag", "sweep").schema("parameter array<struct<_name:string,_type:string,_value:string>>").load(path)
    of = lambda n: F.get(F.filter("parameter", lambda p: p["_name"] == n), F.lit(0))["_value"]
    return x.select(of("arm").alias("arm"), of("randomSeed").cast("int").alias("seed"), of("closureDraw").cast("int").alias("draw"))


@query("snk_integrity", "SELECT 'nation.csv' AS file, sha256(string_agg(n_nationkey || ',' || n_name || chr(10), '' ORDER BY n_nationkey)) AS sha256 FROM nation UNION ALL SELECT 'missing.csv', 'unavailable'")
def snk_integrity(spark, sf_dir):
    """A census of named files by the digests of their bytes; one that is not there is unavailable."""
    root = _scratch(spark, "census")
    spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").orderBy("n_nationkey").coalesce(1).write.csv(f"{root}/nation.csv")
    names = spark.createDataFrame([("nation.csv",), ("missing.csv",)], "file string")
    parts = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(root).select(F.regexp_extract("path", r"/([^/]*)/[^/]*$", 1).alias("file"), F.sha2("content", 256).alias("sha256"))
    census = names.join(parts, "file", "left").select("file", F.coalesce("sha256", F.lit("unavailable")).alias("sha256"))
    path = _scratch(spark, "digests")
    census.write.json(path)
    return spark.read.schema(census.schema).json(path)
