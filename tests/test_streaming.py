"""Streams in several triggers: windows that close once, rows too late for them, state that is carried on."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siteward.streaming import events as ev

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def feed(spark, tmp_path, triggers, schema):
    """A stream whose triggers are these lists of rows, in order."""
    import os
    import time

    folder = tmp_path / "in"
    for k, rows in enumerate(triggers):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"k{k}"))
        for f in (folder / f"k{k}").iterdir():
            os.utime(f, (time.time() - 1000 + 10 * k,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(str(folder))


def row(k, hours, value, county="x", user=1):
    return (k, T0 + dt.timedelta(hours=hours), user, county, value, None)


def test_late_rows_are_dropped_and_windows_close_once(spark, tmp_path):
    triggers = [[row(1, 0.5, 10.0), row(2, 0.7, 20.0)], [row(3, 1.5, 5.0), row(4, 0.9, 30.0)], [row(5, 9.0, 1.0)], [row(7, 20.0, 2.0)], [row(6, 0.6, 1000.0)], [row(8, 40.0, 3.0)]]
    out = ev.run_to_end(ev.hourly(feed(spark, tmp_path, triggers, SCHEMA)), "late")
    got = sorted((r.hour_start.hour, r.n, r["mean"]) for r in out.where(F.col("hour_start") < F.lit("2024-01-02").cast("timestamp_ntz")).collect())
    # Row 4 is late within the two hours and counts; row 6 comes when its window is gone, a trigger after the watermark passed it.
    assert got == [(0, 3, 20.0), (1, 1, 5.0), (9, 1, 1.0), (20, 1, 2.0)]


def test_sessions_end_after_a_gap(spark, tmp_path):
    triggers = [[row(1, 0, 60.0), row(2, 1, 60.0)], [row(3, 2.5, 60.0), row(4, 8, 60.0)], [row(5, 30, 60.0)], [row(6, 60, 60.0)], [row(7, 90, 60.0)]]
    out = ev.run_to_end(ev.sessions(feed(spark, tmp_path, triggers, SCHEMA)), "sessions")
    assert sorted((r.first_at - T0).total_seconds() / 3600 for r in out.where("n = 1").collect())[:2] == [8, 30]
    assert [r.n for r in out.where("n > 1").collect()] == [3]


def test_admission_over_triggers(spark, tmp_path):
    schema = "site_id long, person_id long, tick long"
    triggers = [[(1, 5, 3), (1, 4, 3), (2, 9, 1)], [(1, 6, 7), (1, 2, 6), (3, 1, 6)], [(1, 8, 9), (2, 7, 9)]]
    caps = spark.createDataFrame([(1, 3), (2, 0), (3, None)], "site_id long, capacity int")
    out = ev.run_to_end(ev.admit_stream(feed(spark, tmp_path, triggers, schema), caps), "doors")
    assert {(r.site_id, r.person_id) for r in out.collect()} == {(1, 4), (1, 5), (1, 2), (3, 1)}


def test_exposure_updates(spark, tmp_path):
    triggers = [[row(1, 0, 60.0), row(2, 1, 1.0, user=2)], [row(3, 2, 10.0)]]
    out = ev.run_to_end(ev.exposure_stream(feed(spark, tmp_path, triggers, SCHEMA)), "sums", "update", ["user_id"])
    assert {r.user_id: (r.n, r.total, r.over) for r in out.collect()} == {1: (2, 70.0, 1), 2: (1, 1.0, 0)}


@pytest.mark.parametrize("mode", ["append"])
def test_append_gives_each_window_once(spark, tmp_path, mode):
    triggers = [[row(k, 3 * k, 1.0)] for k in range(8)]
    out = ev.run_to_end(ev.hourly(feed(spark, tmp_path, triggers, SCHEMA)), "once", mode)
    assert out.count() == out.select("county", "hour_start").distinct().count() >= 5


def test_shuffled_arrivals_are_let_in_in_order(spark, tmp_path):
    import random

    schema = "site_id long, person_id long, tick long"
    caps = {1: 3, 2: 0, 3: None, 4: 6}
    r = random.Random(6)
    rows = sorted((r.choice(list(caps)), k, r.randint(0, 100)) for k in range(60))
    # Each trigger brings an hour's arrivals in any order, some of them from the hour before.
    triggers = [[x for x in rows if (x[2] + x[1] % 20) // 30 == k] for k in range(5)]
    triggers = [r.sample(t, len(t)) for t in triggers if t] + [[(3, 900, 500)], [(1, 901, 1), (3, 902, 2)], [(3, 903, 2000)], [(3, 904, 5000)]]
    s = spark.createDataFrame(list(caps.items()), "site_id long, capacity int")
    out = ev.run_to_end(ev.admit_ordered(feed(spark, tmp_path, triggers, schema), s, "60 minutes"), "ordered")
    want = set()
    for site, beds in caps.items():
        line = sorted((t, p) for q, p, t in rows if q == site)
        want |= {(site, p, t) for t, p in (line if beds is None else line[:beds])}
    got = [tuple(x) for x in out.where("person_id < 900").collect()]
    assert set(got) == want and len(got) == len(want)
    # 901 and 902 come when the watermark has passed them; 900 is let in once it has passed that, too.
    assert {x.person_id for x in out.where("person_id >= 900").collect()} & {900, 901, 902} == {900}
