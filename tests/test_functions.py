"""Hand rows for the scalar traps (FIXTURES.md §3: R1, R3, R6, R11, P9, P12, R17)."""

import datetime as dt

from pyspark.sql import functions as F

from collected import rows
from wardstat.functions import calendar as C
from wardstat.functions import numeric as N
from wardstat.functions import text as T


def test_strip_title_matches_python_title(spark):
    samples = ["  o'brien st", "central-delhi", "3rd ward x2y", "\tNEW  DELHI\n", None, "", "élan vital", "zone 12"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in df.select(T.strip_title("s")).collect()]
    want = [None if s is None else s.strip().title() for s in samples]
    assert got == want
    assert got[:4] == ["O'Brien St", "Central-Delhi", "3Rd Ward X2Y", "New  Delhi"]


def test_district_from_slug(spark):
    df = spark.createDataFrame([("greater-noida",), ("central-delhi",)], "s string")
    assert [r[0] for r in df.select(T.district_from_slug("s")).collect()] == ["Greater Noida", "Central Delhi"]


def test_time_of_day_is_right_closed(spark):
    hours = [0, 6, 7, 12, 13, 18, 19, 23]
    df = spark.createDataFrame([(h,) for h in hours], "h int")
    got = [r[0] for r in df.select(C.time_of_day("h")).collect()]
    assert got == ["Night", "Night", "Morning", "Morning", "Afternoon", "Afternoon", "Evening", "Evening"]


def test_monday_is_zero_and_weekend(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 1, 6),), (dt.datetime(2024, 1, 7),)], "ts timestamp_ntz")
    got = rows(df, C.day_of_week("ts"), C.is_weekend("ts"), C.day_name("ts"), C.month_name("ts"))
    assert got == [(0, False, "Monday", "January"), (5, True, "Saturday", "January"), (6, True, "Sunday", "January")]


def test_tolerant_parse(spark):
    texts = ["2024-01-05", "2024-01-05 10:11:12", "01/02/2024", "25/12/2024", "zz", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(C.parse_datetime("s")).collect()]
    assert got == [
        dt.datetime(2024, 1, 5),
        dt.datetime(2024, 1, 5, 10, 11, 12),
        dt.datetime(2024, 1, 2),
        dt.datetime(2024, 12, 25),
        None,
        None,
    ]
    assert dict(df.select(C.parse_datetime("s").alias("p")).dtypes)["p"] == "timestamp_ntz"


def test_season_and_month_key(spark):
    df = spark.createDataFrame([(m,) for m in range(1, 13)], "m int")
    got = [r[0] for r in df.select(C.season("m")).collect()]
    assert got == ["Winter", "Spring", "Spring", "Summer", "Summer", "Summer", "Monsoon", "Monsoon", "Monsoon", "Spring", "Winter", "Winter"]
    one = spark.createDataFrame([(2024, 3)], "y int, m int").select(C.month_key("y", "m")).first()[0]
    assert one == "2024-03"


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(None,), (3.0,), (-1.0,)], "x double")
    assert [r[0] for r in df.select(N.clamp("x", 0.0, 1.0)).collect()] == [None, 1.0, 0.0]
    # least() alone would have turned the NULL into the bound (trap T13)
    assert df.select(F.least("x", F.lit(1.0))).first()[0] == 1.0


def test_padded_id_and_colour(spark):
    df = spark.createDataFrame([(1, "High"), (123456, "Medium"), (7, "Low")], "n long, lv string")
    got = rows(df, C.padded_id("CASE_", "n"), N.risk_colour("lv"))
    assert got == [("CASE_000001", "red"), ("CASE_123456", "orange"), ("CASE_000007", "green")]
