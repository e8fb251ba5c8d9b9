"""Each check reports a fault that is planted in what it looks at, and none without."""

import pytest
from pyspark.sql import functions as F

from siteward.operators import checks, network
from siteward.plans import exposure


def test_admission_that_is_not_conserved(spark):
    asked = spark.createDataFrame([(1, 5, 10), (1, 6, 11), (1, 7, 12), (2, 5, 10)], "site_id long, tick long, person_id long")
    where = spark.createDataFrame([(1, 2), (2, None), (3, 4)], "site_id long, capacity int")
    inside = asked.where("person_id < 12")
    assert tuple(checks.conservation(asked, inside, where).first()) == (4, 3, 6, 0, 0, 0)
    assert tuple(checks.conservation(asked, asked, where).first())[3:] == (1, 0, 0)
    made_up = inside.where("person_id = 10").unionByName(spark.createDataFrame([(1, 9, 99)], asked.schema))
    assert tuple(checks.conservation(asked, made_up, where).first())[3:] == (0, 1, 0)
    assert tuple(checks.conservation(asked, inside.where("site_id = 2").unionByName(inside.where("site_id = 2")), where).first())[3:] == (0, 0, 1)
    assert tuple(checks.conservation(asked.limit(0), inside.limit(0), where).first()) == (0, 0, 6, 0, 0, 0)


def test_a_walk_that_takes_too_long(spark):
    rows = [("a", 600.0, 10, 1.0), ("a", 600.0, 14, 1.0), ("b", 0.0, 1, 2.0)]
    got = {r.band: (r.over, r.worst) for r in checks.detours_over(spark.createDataFrame(rows, "band string, planned_m double, ticks long, speed_mps double"), "band").collect()}
    assert got == {"a": (1, 240.0), "b": (0, 120.0)}


def test_a_dose_that_is_not_its_parts(spark):
    field = spark.createDataFrame([(h, None if h == 3 else float(h + 1)) for h in range(10)], "hour long, c double")
    who = [(1, 2, 6), (2, 0, None), (3, 5, 4), (4, 9, 40)]
    doses = exposure.exposures(spark.createDataFrame(who, "person_id long, depart_hour long, arrive_hour long"), field).select("person_id", "dose")
    claimed = spark.createDataFrame(who, "person_id long, depart_hour long, arrive_hour long").join(doses, "person_id").withColumn("arm", F.lit("x"))
    assert tuple(exposure.dose_faults(claimed, field, "arm").first()) == ("x", 0, 4)
    for k in (1, 2, 3, 4):
        wrong = claimed.withColumn("dose", F.when(F.col("person_id") == k, F.col("dose") * 1.02).otherwise(F.col("dose")))
        assert exposure.dose_faults(wrong, field, "arm").first().violations == 1


@pytest.mark.parametrize("name, column, value", [("T1", "again", 1010.0), ("T2", "walked", 1100.0), ("T3", "minutes", 2), ("T4 not", "straight", 1500.0), ("T4 circuity", "straight", 100.0)])
def test_a_route_that_is_wrong(spark, name, column, value):
    good = {"net": 1000.0, "again": 1000.0, "snap": 20.0, "door": 10.0, "straight": 800.0, "walked": 1020.0, "minutes": 17}
    df = spark.createDataFrame([tuple(good.values()), tuple((good | {column: value}).values())], "net double, again double, snap double, door double, straight double, walked double, minutes long")
    got = {r.name: r.violations for r in network.route_tests(df).collect()}
    assert {n for n, v in got.items() if v} == {n for n in got if n.startswith(name)} and sum(got.values()) == 1
