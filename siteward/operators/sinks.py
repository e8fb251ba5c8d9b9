"""Sinks of results: each writes its files in the shared folder, and the query is what is read back from them."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteward.catalog import query
from siteward.operators.admission import ORDER, RANKED, admit_first
from siteward.operators.stand_ins import ARRIVALS, OUTCOMES, SITES, arrivals, outcomes, sites
from siteward.operators.tables import _SHEET, STATE_NAMES, label, person_sheet
from siteward.session import scratch_root


def place(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/siteward-{name}-{uuid.uuid4().hex}"


def through_csv(df: DataFrame, name: str) -> DataFrame:
    """df written as quoted CSV with a header and read again with its schema; null is a blank, and so is an empty text."""
    path = place(df.sparkSession, name)
    df.write.options(header=True, quoteAll=True, escape='"', nullValue="", emptyValue="").csv(path)
    return df.sparkSession.read.schema(df.schema).options(header=True, escape='"', nullValue="").csv(path)


@query("snk_readable", f"WITH {OUTCOMES}, h AS (SELECT arm, seed, count(*) FILTER (state = 'SHELTERED') AS inside, avg(distance_m) / 1000 AS km, avg(arrive_tick - depart_tick) / 60 AS h FROM outcomes GROUP BY arm, seed) SELECT arm AS \"Scenario\", min(inside) || ' - ' || max(inside) AS \"Got inside\", round(avg(km), 2) AS \"Walk (km)\", round(avg(h), 2) AS \"Walk (h)\" FROM h GROUP BY arm")
def snk_readable(spark, sf_dir):
    """Scenarios for readers: ranges over seeds as text, kilometres and hours; as CSV."""
    h = outcomes(spark, sf_dir).groupBy("arm", "seed").agg(F.count_if(F.col("state") == "SHELTERED").alias("inside"), (F.avg("distance_m") / 1000).alias("km"), (F.avg(F.col("arrive_tick") - F.col("depart_tick")) / 60).alias("h"))
    g = h.groupBy(F.col("arm").alias("Scenario")).agg(F.format_string("%d - %d", F.min("inside"), F.max("inside")).alias("Got inside"), F.round(F.avg("km"), 2).alias("Walk (km)"), F.round(F.avg("h"), 2).alias("Walk (h)"))
    return through_csv(g, "readable")


@query("snk_deck_numbers", f"WITH {OUTCOMES} SELECT 'people.' || arm AS key, count(*)::DOUBLE AS value, 'orders' AS source FROM outcomes GROUP BY arm UNION ALL SELECT 'dose.' || arm, round(avg(dose_ug), 3), 'orders' FROM outcomes GROUP BY arm")
def snk_deck_numbers(spark, sf_dir):
    """Facts by key with their source, as JSON lines."""
    g = outcomes(spark, sf_dir).groupBy("arm").agg(F.count(F.lit(1)).cast("double").alias("people"), F.round(F.avg("dose_ug"), 3).alias("dose"))
    facts = g.select(F.explode(F.array(*(F.struct(F.concat(F.lit(f"{k}."), "arm").alias("key"), F.col(k).alias("value"), F.lit("orders").alias("source")) for k in ("people", "dose")))).alias("f")).select("f.*")
    path = place(spark, "facts")
    facts.write.json(path)
    return spark.read.schema(facts.schema).json(path)


@query("snk_results_csv", f"WITH {OUTCOMES} {_SHEET}")
def snk_results_csv(spark, sf_dir):
    """The person sheet as CSV, a folder for each scenario."""
    sheet = person_sheet(outcomes(spark, sf_dir))
    path = place(spark, "results")
    sheet.write.partitionBy("Scenario").options(header=True, quoteAll=True).csv(path)
    return spark.read.schema(sheet.schema).option("header", True).csv(path).select(*sheet.columns)


def printed(c: Column, digits: int) -> Column:
    """A number with so many digits as C's printf has it: the nearest to the binary value, of equals the even one. Spark's own
    format_string goes by the shortest decimal and rounds halves up."""

    @F.pandas_udf("string")
    def text(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else f"{v:.{digits}f}").astype(object)

    return text(c.cast("double"))


@query("snk_shelters", f"""WITH {ARRIVALS}, {SITES}, {RANKED}, a AS (SELECT * FROM ranked WHERE capacity IS NULL OR rank <= capacity), r AS (SELECT site_id, count(*) AS asked FROM arrivals GROUP BY site_id)
SELECT s.site_id, s.name, printf('%.6f', s.lon) AS lon, printf('%.6f', s.lat) AS lat, s.capacity, s.operating, count(a.person_id) AS final_occupancy, coalesce(any_value(asked), 0) - count(a.person_id) AS refused_count, CASE WHEN s.capacity > 0 THEN printf('%.4f', count(a.person_id) / s.capacity::DOUBLE) END AS utilization,
 CASE WHEN count(a.person_id) > 0 THEN printf('%.1f', avg(a.price)) END AS mean_travel_dist_m_admitted FROM sites s LEFT JOIN a USING (site_id) LEFT JOIN r USING (site_id) GROUP BY s.site_id, s.name, s.lon, s.lat, s.capacity, s.operating""")  # fmt: skip
def snk_shelters(spark, sf_dir):
    """A site's row with who got in and who was refused; numbers in fixed formats, what does not apply blank."""
    s = sites(spark, sf_dir).select("site_id", "name", "lon", "lat", "capacity", "operating")
    inside = admit_first(arrivals(spark, sf_dir), s, "site_id", ORDER).groupBy("site_id").agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("mean"))
    asked = arrivals(spark, sf_dir).groupBy("site_id").agg(F.count(F.lit(1)).alias("asked"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    t = s.join(inside, "site_id", "left").join(asked, "site_id", "left").select(
        "site_id",
        "name",
        printed(F.col("lon"), 6).alias("lon"),
        printed(F.col("lat"), 6).alias("lat"),
        "capacity",
        "operating",
        zero(F.col("n")).alias("final_occupancy"),
        (zero(F.col("asked")) - zero(F.col("n"))).alias("refused_count"),
        printed(F.when(F.col("capacity") > 0, zero(F.col("n")) / F.col("capacity").cast("double")), 4).alias("utilization"),
        printed(F.col("mean"), 1).alias("mean_travel_dist_m_admitted"),
    )
    return through_csv(t, "shelters")


@query("snk_provenance", f"WITH {OUTCOMES} SELECT arm, 'orders' AS input, count(*) AS n, 42 AS seed, count(*) = count(DISTINCT person_id) AS ids_unique, min(dose_ug) >= 0 AS doses_positive FROM outcomes GROUP BY arm")
def snk_provenance(spark, sf_dir):
    """A JSON document beside each result with its input, parameters and checks."""
    g = outcomes(spark, sf_dir).groupBy("arm").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) == F.count_distinct("person_id")).alias("ids_unique"), (F.min("dose_ug") >= 0).alias("doses_positive"))
    doc = g.select("arm", F.array(F.struct(F.lit("orders").alias("name"), F.col("n").alias("rows"))).alias("inputs"), F.struct(F.lit(42).alias("seed")).alias("parameters"), F.struct("ids_unique", "doses_positive").alias("checks"))
    path = place(spark, "provenance")
    doc.write.partitionBy("arm").json(path)
    d = spark.read.schema(doc.schema).json(path)
    return d.select(F.col("arm").cast("string").alias("arm"), F.get("inputs", F.lit(0))["name"].alias("input"), F.get("inputs", F.lit(0))["rows"].alias("n"), "parameters.seed", "checks.*")


def markdown_rows(df: DataFrame, order: list[str]) -> Column:
    """A table's row as Markdown; bars in a cell are escaped."""
    cell = lambda c: F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")), F.lit("|"), F.lit("\\|"))
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in df.columns)), F.lit(" |"))


@query("snk_markdown", f"WITH {OUTCOMES}, g AS (SELECT CASE state WHEN 'SHELTERED' THEN 'Got inside' WHEN 'REFUSED_ALL_FULL' THEN 'Turned away' WHEN 'UNREACHABLE' THEN 'Could not reach' ELSE state END AS outcome, arm, count(*) AS n FROM outcomes GROUP BY ALL) SELECT 'arm=' || arm AS report, '| ' || outcome || ' | ' || n || ' |' AS line FROM g UNION ALL SELECT DISTINCT 'arm=' || arm, unnest(['# Scenario ' || arm, '| Outcome | People |', '| --- | --- |']) FROM g")
def snk_markdown(spark, sf_dir):
    """A report a scenario: a title, a head and a row for each outcome, as text files in order."""
    g = outcomes(spark, sf_dir).groupBy("arm", label(F.col("state"), STATE_NAMES).alias("Outcome")).agg(F.count(F.lit(1)).alias("People"))
    rows = g.select("arm", F.lit(3).alias("k"), F.col("Outcome").alias("o"), markdown_rows(g.drop("arm"), ["Outcome"]).alias("line"))
    head = g.select("arm").distinct().select("arm", F.posexplode(F.array(F.concat(F.lit("# Scenario "), "arm"), F.lit("| Outcome | People |"), F.lit("| --- | --- |"))).alias("k", "line"))
    lines = rows.unionByName(head.select("arm", "k", F.lit("").alias("o"), "line"))
    path = place(spark, "report")
    # A report is a few lines, and one file.
    lines.repartition("arm").sortWithinPartitions("arm", "k", "o").select("arm", F.col("line").alias("value")).write.partitionBy("arm").text(path)
    return spark.read.text(path).select(F.concat(F.lit("arm="), F.col("arm").cast("string")).alias("report"), F.col("value").alias("line"))
