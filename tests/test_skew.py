"""A hot key holding a third of all rows: results stay whole and the hot group is
spread over tasks (partial aggregation before every exchange; W6's range sort
includes the tie-breaker, so one hot timestamp still spans several partitions)."""

from pyspark.sql import functions as F

from wardstat.functions.calendar import with_calendar
from wardstat.operators import aggregates as A
from wardstat.operators import clean as CL
from wardstat.operators import series as S
from wardstat.sources.views import Fixtures

SF = "/root/testdata/sf0.01"


def _skewed(spark):
    h = Fixtures(spark, SF).incidents_hourly
    hot = F.col("case_no") % 3 == 0  # every third row moves to one district at one instant
    return h.withColumns(
        {
            "district": F.when(hot, F.lit("Zone Hot")).otherwise(F.col("district")),
            "ts": F.when(hot, F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")).otherwise(F.col("ts")),
        }
    )


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_district_aggregate_is_whole_and_pre_aggregated(spark):
    df = _skewed(spark)
    n = df.count()
    a1 = A.monthly_district(with_calendar(df))
    assert a1.agg(F.sum("total_crimes")).first()[0] == n
    hot = a1.where(F.col("district") == "Zone Hot").first()
    assert hot["total_crimes"] == df.where(F.col("district") == "Zone Hot").count() >= n // 3
    p = _plan(a1)
    assert "partial_count" in p and "partial_stddev_samp" in p  # map-side combine before the shuffle


def test_hot_timestamp_numbering_spreads_over_partitions(spark):
    df = _skewed(spark).select("case_no", "ts")
    n = df.count()
    numbered = S.with_case_id(df)
    rows = numbered.select("case_no", "ts", "case_id").collect()
    ids = sorted(r["case_id"] for r in rows)
    assert len(rows) == n and ids[0] == "CASE_000001" and ids[-1] == f"CASE_{n:06d}" and len(set(ids)) == n
    # ids follow (ts, case_no) order, ties on the hot instant broken by case_no
    by_id = [(r["ts"], r["case_no"]) for r in sorted(rows, key=lambda r: r["case_id"])]
    assert by_id == sorted(by_id)
    # the range sort puts the hot instant's rows (a third of the table) in several partitions
    # (coalescing off, so the 8 range partitions are visible on this small table)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = df.orderBy("ts", "case_no").rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    hot = df.where(F.col("ts") == F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")).count()
    assert hot >= n // 3 and len([x for x in sizes if x]) > 2 and max(sizes) < hot


def test_hot_duplicates_collapse_map_side(spark):
    df = _skewed(spark).select("district", "ts")
    d = CL.dedup(df)
    assert d.count() == df.distinct().count()
    assert _plan(d).count("HashAggregate") >= 2  # partial dedup per task, then the final one


def test_hot_district_series_is_whole(spark):
    df = _skewed(spark)
    s = S.densify(S.monthly_counts(df))
    assert s.agg(F.sum("y")).first()[0] == df.count()
