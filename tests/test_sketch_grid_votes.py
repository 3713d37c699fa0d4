"""Mergeable sketches, adaptive cells, the smoothed grid and the format vote on hand rows."""

import datetime as dt
import math

import pytest

from collected import rows
from pyspark.sql import functions as F
from wardstat.functions import calendar as C
from wardstat.operators import aggregates as A
from wardstat.operators import hotspot as HS


def test_sketches_merge_over_months_and_versions(spark):
    base = spark.range(60_000).select(
        (F.col("id") % 25_000).alias("person"), (F.col("id") % 90).alias("district"), F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(cast(id % 300 as int))").alias("ts")
    )
    first, second = base.where("person < 15000"), base.where("person >= 10000")
    told = None
    for version, part in (("v1", first), ("v2", second)):
        s = A.monthly_sketches(part, ["person", "district"]).withColumn("version", F.lit(version))
        told = s if told is None else told.unionByName(s)
    got = dict(rows(A.merged_cardinalities(told)))
    assert got["district"] == 90 and abs(got["person"] - 25_000) <= A.SKETCH_BOUND * 25_000
    by = {(r["version"], r["column_name"]): r["estimate"] for r in A.merged_cardinalities(told, "version").collect()}
    for version, n in (("v1", 15_000), ("v2", 15_000)):
        assert abs(by[(version, "person")] - n) <= A.SKETCH_BOUND * n
    months = A.merged_cardinalities(told.where("version = 'v1'"), "month")
    assert months.where("column_name = 'district'").count() == 10
    assert "FileScan" not in A.merged_cardinalities(told.where("false"))._jdf.queryExecution().executedPlan().toString()


def test_a_hot_cell_splits_and_leaves_hold_every_row(spark):
    hot = [(28.6 + k * 1e-4, 77.2 + (k % 7) * 1e-4) for k in range(400)]
    calm = [(10.0 + k, 20.0 + k) for k in range(5)]
    df = spark.createDataFrame([*hot, *calm, (None, 1.0), (28.6, 77.2)], "latitude double, longitude double")
    cells = HS.adaptive_cells(df, most=50).collect()
    assert sum(c["crimes"] for c in cells) == 406
    holds = lambda c, lat, lng: abs(lat - c["lat"]) <= c["side"] / 2 and abs(lng - c["lng"]) <= c["side"] / 2
    assert min(c["level"] for c in cells if holds(c, *hot[0])) > max(c["level"] for c in cells if holds(c, *calm[0]))
    assert all(c["crimes"] <= 50 or c["level"] == HS.DEEPEST for c in cells)
    for lat, lng in hot + calm:  # leaves don't overlap, and each row is in one
        assert sum(holds(c, lat, lng) for c in cells) == 1
    assert HS.adaptive_cells(df.where("false")).count() == 0
    assert rows(HS.adaptive_cells(df.limit(0).unionByName(spark.createDataFrame([(1.0, 2.0)], df.schema)), most=5).select("level", "crimes")) == [(0, 1)]


def test_density_of_neighbours(spark):
    df = spark.createDataFrame([(0.005, 0.005)] * 4 + [(0.015, 0.025)] + [(0.995, 0.995)], "latitude double, longitude double")
    got = {(r["cell_y"], r["cell_x"]): r["density"] for r in HS.smoothed_grid(df, 0.01, 1.5, 3).collect()}
    w = math.exp(-5 / 4.5)
    assert got == {(0, 0): pytest.approx(4 + w), (1, 2): pytest.approx(1 + 4 * w), (99, 99): pytest.approx(1.0)}


def test_day_first_columns_are_read_right_throughout(spark):
    days = [dt.date(2024, m, d) for m in (1, 5, 12) for d in (1, 7, 12, 13, 28)]
    table = [(d.strftime("%d/%m/%Y"), d.strftime("%m/%d/%Y"), d.isoformat(), d) for d in days] + [("x", None, "x", None), ("2024-03-04", "13/13/2024", None, None)]
    df = spark.createDataFrame(table, "eu string, us string, iso string, day date")
    votes = {r["column_name"]: r for r in C.format_votes(df, "eu", "us", "iso").collect()}
    assert [votes[c]["chosen"] for c in ("eu", "us", "iso")] == ["day first", "month first", "month first"]
    assert votes["eu"]["n_ambiguous"] == 7 and votes["eu"]["n_text"] == 17 and votes["us"]["n_text"] == 16  # 1/1 and 12/12 are the same day both ways
    for c in ("eu", "us", "iso"):
        got = C.parse_by_vote(df, c, "ts").where("day is not null").select("day", F.to_date("ts").alias("got")).collect()
        assert all(r["day"] == r["got"] for r in got)
    old = df.where("day is not null").select("day", F.to_date(C.parse_datetime("eu")).alias("got")).collect()
    assert any(r["day"] != r["got"] for r in old)  # row by row, month first wins
    last = C.parse_by_vote(df, "eu", "ts").where("day is null").select("eu", F.to_date("ts")).collect()
    assert sorted(map(tuple, last)) == [("2024-03-04", dt.date(2024, 3, 4)), ("x", None)]
