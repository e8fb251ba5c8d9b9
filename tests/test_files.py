"""File formats with the faults that real files have, and known answers of the statistics."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteward import plans  # noqa: F401
from siteward.operators import results, tables
from siteward.plans import exposure
from siteward.session import materialize
from siteward.sources import files, shapes

LINES = [[[(0.0, 1.0), (2.0, 3.0)]], [], [[(1.0, 1.0), (2.0, 2.0)], [(5.0, 5.0), (6.0, 7.0), (8.0, 9.0)]]]


def test_shapes_come_back_as_they_were():
    content = shapes.shape_bytes(LINES)
    assert list(shapes.shapes_of(content)) == LINES
    assert list(shapes.shapes_of(content[:-8])) == LINES[:2]
    assert list(shapes.shapes_of(b"")) == [] and list(shapes.shapes_of(b"x" * 200)) == []
    table = shapes.table_bytes([("NAME", 6), ("ID", 3)], [["é a", "1"], ["", "22"], ["toolong", "3"]])
    assert list(shapes.rows_of(table)) == [{"NAME": "é a", "ID": "1"}, {"NAME": None, "ID": "22"}, {"NAME": "toolon", "ID": "3"}]
    assert len(list(shapes.rows_of(table[:-8]))) == 2


def put_shapes(folder, name, lines, rows, cut=0, index=True):
    content = shapes.shape_bytes(lines)
    (folder / f"{name}.shp").write_bytes(content[: len(content) - cut])
    (folder / f"{name}.dbf").write_bytes(shapes.table_bytes([("ID", 3)], rows))
    if index:
        (folder / f"{name}.shx").write_bytes(shapes.index_bytes(content))


def test_shapefiles_are_split_by_their_index(spark, tmp_path):
    lines = [[[(float(k), 1.0), (2.0, float(k))]] if k % 5 else [] for k in range(23)]
    rows = [[str(k)] for k in range(23)]
    put_shapes(tmp_path, "whole", lines, rows)
    put_shapes(tmp_path, "plain", lines, rows, index=False)
    put_shapes(tmp_path, "short", lines, rows[:9])
    # The last record is cut off; the index still names it.
    put_shapes(tmp_path, "cut", lines, rows, cut=8)
    df = shapes.read_shapefiles(spark, str(tmp_path), ["ID", "NONE"], records=4)
    got = {}
    for r in df.collect():
        got.setdefault(r.file, {})[r.number] = ([[(p.lon, p.lat) for p in part] for part in r.parts], r.ID, r.NONE)
    want = {k: (lines[k], str(k), None) for k in range(23)}
    assert got["whole"] == got["plain"] == want
    assert got["short"] == {k: (lines[k], str(k) if k < 9 else None, None) for k in range(23)}
    assert got["cut"] == {k: want[k] for k in range(22)}
    # Six splits a file with an index, one without; a task holds no more than a split.
    assert df.rdd.getNumPartitions() >= 7


def test_what_follows_a_bad_record_is_left_out_in_other_splits_too(spark, tmp_path):
    lines = [[[(float(k), 1.0), (2.0, 3.0)]] for k in range(12)]
    content = bytearray(shapes.shape_bytes(lines))
    content[shapes.HEADER + 2 * (len(content) - shapes.HEADER) // 12 + 8] = 99  # the third record is of another kind
    (tmp_path / "a.shp").write_bytes(bytes(content))
    (tmp_path / "a.shx").write_bytes(shapes.index_bytes(bytes(content)))
    (tmp_path / "b.shp").write_bytes(b"x" * 300)
    assert sorted(r.number for r in shapes.read_shapefiles(spark, str(tmp_path), [], records=3).collect()) == [0, 1]


def test_an_index_that_does_not_fit_is_an_error(spark, tmp_path):
    content = shapes.shape_bytes([[[(float(k), 1.0), (2.0, 3.0)]] for k in range(6)])
    index = bytearray(shapes.index_bytes(content))
    index[shapes.HEADER + 8 * 3 + 3] += 2
    (tmp_path / "a.shp").write_bytes(content)
    (tmp_path / "a.shx").write_bytes(bytes(index))
    with pytest.raises(Exception, match="no record begins"):
        shapes.read_shapefiles(spark, str(tmp_path), [], records=3).collect()


def test_tolerant_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿id, name ,n\r\n1," padded ",2\r\n\r\n2,"say ""x"""\r\n3,a,b,surplus\r\n'.encode())
    rows = [tuple(r) for r in files.read_tolerant(spark, str(tmp_path / "a.csv")).orderBy("id").collect()]
    assert rows == [("1", "padded", "2"), ("2", 'say "x"', ""), ("3", "a", "b")]


@pytest.mark.parametrize("content", ["id,name\n1\n", "id,name\n1,2,3\n"])
def test_strict_rows_fail(spark, tmp_path, content):
    (tmp_path / "b.csv").write_text(content)
    with pytest.raises(Exception, match="MALFORMED|malformed|CSV"):
        files.read_strict(spark, str(tmp_path / "b.csv"), ["id", "name"]).collect()


def test_strict_headers_fail(spark, tmp_path):
    (tmp_path / "c.csv").write_text("id,id\n1,2\n")
    with pytest.raises(ValueError, match="repeated"):
        files.read_strict(spark, str(tmp_path / "c.csv"), ["id", "id"])
    (tmp_path / "d.csv").write_text("")
    with pytest.raises(ValueError, match="empty"):
        files.read_strict(spark, str(tmp_path / "d.csv"), ["id"])


def test_guards_fail(spark, tmp_path):
    (tmp_path / "e.csv").write_text("node_a,node_b,activation_hour\n1,2,-3\n")
    with pytest.raises(Exception, match="negative hour"):
        files.read_closures(spark, str(tmp_path / "e.csv"), 100).collect()
    (tmp_path / "f.csv").write_text("node_a,node_b,activation_hour\n1,x,3\n")
    with pytest.raises(Exception, match="node_b is no number"):
        files.read_closures(spark, str(tmp_path / "f.csv"), 100).collect()
    with pytest.raises(Exception, match="out of range"):
        spark.range(30).select(files.guarded(F.col("id").cast("int"), 0, 20, "code")).collect()
    with pytest.raises(FileNotFoundError):
        files.variant(spark, str(tmp_path / "e.csv"), True)
    with pytest.raises(FileNotFoundError):
        files.resolve_run(spark, "run-x", [str(tmp_path)])
    (tmp_path / "r.json").write_text('{"claims": [{"id": "a", "pattern": "x", "status": "wrong"}]}')
    with pytest.raises(Exception, match="bad claim a"):
        files.read_rules(spark, str(tmp_path / "r.json")).collect()


DIR = "/root/testdata/sf0.001"


def design(spark):
    rows = results.design(results.outcomes(spark, DIR)).select("x", "dose_ug", (F.col("state") == "SHELTERED").cast("double").alias("y")).collect()
    return np.array([r.x for r in rows], float), np.array([r.dose_ug for r in rows]), np.array([r.y for r in rows])


def test_least_squares(spark):
    x, y, _ = design(spark)
    beta, rss, *_ = np.linalg.lstsq(x, y, rcond=None)
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * rss[0] / (len(y) - x.shape[1]))
    got = results.st_ols(spark, DIR).collect()
    assert [r.estimate for r in got] == pytest.approx(beta.tolist(), rel=1e-6, abs=1e-6)
    assert [r.se for r in got] == pytest.approx(se.tolist(), rel=1e-6)
    assert got[0].r2 == pytest.approx(1 - rss[0] / ((y - y.mean()) ** 2).sum(), rel=1e-6)


def test_logistic_regression_is_at_its_maximum(spark):
    x, _, y = design(spark)
    got = results.st_logit(spark, DIR).collect()
    beta = np.array([r.estimate for r in got])
    p = 1 / (1 + np.exp(-x @ beta))
    assert np.abs(x.T @ (y - p)).max() < 1e-5
    assert [r.se for r in got] == pytest.approx(np.sqrt(np.diag(np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x))).tolist(), rel=1e-5)


def far(a, b):
    h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6_371_000.0 * math.asin(math.sqrt(h))


def test_greedy_absorption(spark):
    r = random.Random(8)
    demand = [(k, r.uniform(0, 1), r.uniform(0, 1), r.randrange(1, 12)) for k in range(14)]
    where = [(k, r.uniform(0, 1), r.uniform(0, 1), r.choice([0, 3, 9])) for k in range(8)]
    left, want = {s[0]: s[3] for s in where}, {}
    for g, x, y, n in sorted(demand, key=lambda d: (-d[3], d[0])):
        for s, *_ in sorted(where, key=lambda w: (round(far((x, y), w[1:3]), 6), w[0])):
            take = min(n, left[s])
            if take:
                want[g, s] = take
                left[s], n = left[s] - take, n - take
    got = tables.absorb(spark.createDataFrame(demand, "group_id long, lon double, lat double, units long"), spark.createDataFrame(where, "site_id long, lon double, lat double, capacity int"))
    assert {(x.group_id, x.site_id): x.units for x in got.collect()} == want


def test_greedy_absorption_takes_many_sites_in_a_round(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(tables, "materialize", lambda df, name="step": calls.append(name) or materialize(df, name))
    where = [(k, 0.01 * k, 0.0, 1) for k in range(40)]
    got = tables.absorb(spark.createDataFrame([(1, 0.0, 0.0, 30)], "group_id long, lon double, lat double, units long"), spark.createDataFrame(where, "site_id long, lon double, lat double, capacity int"))
    assert sorted(x.site_id for x in got.collect()) == list(range(30))
    assert calls.count("given") <= 4


def test_shapes_beyond_mercator(spark, tmp_path):
    spark.createDataFrame([(k,) for k in (3, 500_000)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r.seq: r.lat for r in shapes.src_shapefile(spark, str(tmp_path)).collect()}
    assert got[2 * 3] == pytest.approx(45.2, abs=1e-7) and got[2 * 500_000] == pytest.approx(95.2, abs=1e-7)


def test_greedy_siting(spark):
    r = random.Random(4)
    demand = [(k, r.uniform(0, 0.3), r.uniform(0, 0.3), r.randrange(1, 9)) for k in range(12)]
    sites = [(k, r.uniform(0, 0.3), r.uniform(0, 0.3)) for k in range(6)]
    left, chosen, want = {d[0]: d[3] for d in demand}, set(), []
    for capacity in (10, 7, 40):
        best = None
        for s, x, y in sites:
            if s in chosen:
                continue
            cost, room, take = 0.0, capacity, {}
            for d, g in sorted((round(far((a, b), (x, y)), 3), g) for g, a, b, _ in demand if left[g]):
                take[g] = min(room, left[g])
                room -= take[g]
                cost += d * take[g]
            cost = round(cost + room * 60_000.0, 0)
            if best is None or (cost, s) < best[:2]:
                best = (cost, s, take)
        chosen.add(best[1])
        for g, n in best[2].items():
            left[g] -= n
        want.append((best[1], capacity, sum(best[2].values())))
    got = exposure.p_median(spark.createDataFrame(demand, "group_id long, lon double, lat double, units long"), spark.createDataFrame(sites, "site_id long, lon double, lat double"), [10, 7, 40])
    assert [(x.site_id, x.capacity, x.served) for x in got.orderBy("step").collect()] == want


BLOCK = """# a registry
deliverables:
  - docs/*.md
claims:
  - id: R1
    pattern: 'it''s # not a comment'
    status: forbidden
  - id: R2   # a comment
    pattern: "say \\"so\\""
    regex: true
    case_insensitive: Yes

    status: superseded
    replacement: plain words: with a colon
other: x
"""


def test_rules_in_block_style(spark, tmp_path):
    def read(text):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.yaml"
        path.write_text(text)
        return [tuple(r) for r in files.read_block_rules(spark, str(path)).orderBy("id").collect()]

    assert read(BLOCK) == [("R1", "it's # not a comment", False, False, "forbidden", None), ("R2", 'say "so"', True, True, "superseded", "plain words: with a colon")]
    assert read(BLOCK.replace("\n", "\r\n"))[0][1] == "it's # not a comment"
    assert read("claims: []\n") == [] and read("") == []
    for text, what in ((BLOCK.replace("    status: forbidden", "    status forbidden"), "line 7 of"), (BLOCK.replace("    status: forbidden", "    id: again"), "of file"), (BLOCK.replace("forbidden", "maybe"), "bad claim R1"), ("claims:\n    id: x\n", "line 2 of")):
        with pytest.raises(Exception, match=what):
            read(text)


def test_numbers_are_printed_as_c_does(spark):
    from siteward.operators.sinks import printed

    values = [12.25, 12.35, 33663.45, 0.05, -0.25, 1e9 + 0.25, None]
    got = [r.t for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(printed(F.col("v"), 1).alias("t")).collect()]
    assert got == [None if v is None else "%.1f" % v for v in values]
