"""Cleaning, dedup, aggregates and quality gates on hand rows and the fixture views."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from collected import rows
from wardstat.functions.calendar import with_calendar
from wardstat.operators import aggregates as A
from wardstat.operators import clean as CL
from wardstat.operators import quality as G


def test_dedup_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([("a", 1), (None, None), ("a", 1), (None, None)], "k string, v int")
    assert CL.dedup(df).count() == 2


def test_canonical_columns_and_ambiguity(spark):
    df = spark.createDataFrame([("2024-01-01", "x", "t", 1.0, 2.0)], "Date string, DISTRICT string, `Crime Type` string, LAT double, LNG double")
    assert CL.canonical_columns(df).columns == ["date", "district", "crime_type", "latitude", "longitude"]
    bad = spark.createDataFrame([("2024-01-01", "2024-01-02")], "Date string, Day string").withColumnRenamed("Day", "date")
    with pytest.raises(ValueError):
        CL.canonical_columns(bad)


def test_clean_incidents_flow(spark):
    raw = spark.createDataFrame(
        [
            ("2024-01-05", "  central-delhi ", " theft", 1.0, 2.0),
            ("2024-01-05", "  central-delhi ", " theft", 1.0, 2.0),
            ("not a date", "x", "y", None, None),
            ("01/02/2024", None, None, None, 3.0),
        ],
        "Date string, District string, Crime_Type string, Latitude double, Longitude double",
    )
    out = CL.clean_incidents(raw)
    got = sorted(rows(out, "ts", "district", "crime_type"))
    assert got == [
        (dt.datetime(2024, 1, 2), "Unknown", "Other"),
        (dt.datetime(2024, 1, 5), "Central-Delhi", "Theft"),
    ]
    assert CL.missing_coordinates(out).count() == 1


def test_monthly_district_single_row_std_is_null(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 6, 10), "D", "t")], "ts timestamp_ntz, district string, crime_type string")
    r = A.monthly_district(with_calendar(df)).first()
    assert (r["total_crimes"], r["unique_crime_types"], r["weekend_crimes"], r["avg_hour"], r["hour_std"]) == (1, 1, 1, 10.0, None)


def test_upload_quality(spark):
    """An undated row is no duplicate; an undated copy is both."""
    rows = [(1, "2024-01-01"), (1, "2024-01-01"), (2, "no date"), (3, None), (3, None), (4, "2024-02-02"), (5, "03/04/2024"), (6, "2024-01-01")]
    df = spark.createDataFrame(rows, "id int, date string")
    r = A.upload_quality(df, "date").first()
    assert (r["original_records"], r["processed_records"], r["duplicates_removed"], r["undated_records"], r["data_quality_pct"]) == (8, 6, 2, 3, 75.0)
    assert A.upload_quality(df.limit(0), "date").first()["data_quality_pct"] == 100.0


def test_upload_quality_of_the_raw_view(spark):
    from wardstat.sources.views import Fixtures

    r = A.upload_quality(Fixtures(spark, "/root/testdata/sf0.01").incidents_raw, "date_text").first()
    assert r["duplicates_removed"] == 1000 and round(r["data_quality_pct"], 6) == 90.909091


def test_processing_log_counts_each_step(spark):
    from wardstat.operators import quality as G

    rows = [("2024-01-01", "a", "x", 1.0, 2.0), ("2024-01-01", " A ", "X", 1.0, 2.0), ("bad", "a", "x", 1.0, 2.0), ("2024-01-02", None, "x", None, 2.0), ("2024-01-02", "b", None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "date string, district string, crime_type string, latitude double, longitude double")
    got = [(r["step"], r["rows_in"], r["rows_out"], r["changed"]) for r in G.processing_log(df).orderBy("step_no").collect()]
    assert got == [("load", 5, 5, 0), ("drop_undated", 5, 4, 1), ("fill_district", 4, 4, 1), ("fill_type", 4, 4, 1), ("flag_coordinates", 4, 4, 1), ("deduplicate", 4, 3, 1)]


def test_data_summary_has_columns_and_date(spark, fx):
    r = A.data_summary(fx.incidents_hourly, processed_on="2024-05-06").first()
    assert r["columns"] == fx.incidents_hourly.columns and str(r["processing_date"]) == "2024-05-06"


def test_missing_values_one_row_per_column(spark, fx):
    got = dict(rows(A.missing_values(fx.incidents_raw)))
    assert set(got) == set(fx.incidents_raw.columns)
    assert got["case_no"] == 0 and got["latitude"] > 0


def test_gates_and_report(spark, fx):
    raw = CL.canonical_columns(fx.incidents_raw.withColumnsRenamed({"date_text": "Date", "district_text": "District"}))
    clean = CL.clean_incidents(raw)
    gates = G.table_gates(raw, "date")
    rep = G.validation_report(gates).first()
    # raw dates include 'not a date' -> G3 fails; 30 days of data -> G4 warning
    assert rep["valid"] is False
    assert "dates_parse" in rep["errors"] and "date_span" in rep["warnings"]
    g1 = G.required_columns(spark, spark.createDataFrame([(1,)], "x int")).first()
    assert g1["ok"] is False and g1["observed"] == 2.0


def test_months_per_district_gate(spark):
    base = dt.datetime(2020, 1, 15)
    data = [(base.replace(year=2020 + (m // 12), month=m % 12 + 1), "A") for m in range(24)]
    data += [(base.replace(year=2020 + (m // 12), month=m % 12 + 1), "B") for m in range(23)]
    df = spark.createDataFrame(data, "ts timestamp_ntz, district string")
    got = dict((r["subject"], r["ok"]) for r in G.months_per_district(df).collect())
    assert got == {"A": True, "B": False}
