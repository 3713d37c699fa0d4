"""Grouped aggregates.

All are ``groupBy().agg`` with built-in aggregate functions, so Spark plans a
partial (map-side) aggregate before the exchange and a final one after it:
a district that holds a third of all rows still ships one partial row per
task. Distinct counts use Spark's expand-based two-phase rewrite, which also
pre-aggregates on (key, value) before shuffling. Null grouping keys are dropped
(pandas ``groupby`` drops them, T12); nothing is sorted unless asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardstat.functions.calendar import month_start, parse_datetime


def _drop_null_keys(df: DataFrame, keys) -> DataFrame:
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.where(cond)


def monthly_district(df: DataFrame) -> DataFrame:
    """A1/A2: per (year_month, district): total_crimes, unique_crime_types,
    weekend_crimes, avg_hour, hour_std (sample std; NULL for one row, T11).

    Needs the calendar block (``with_calendar``)."""
    keys = ["year_month", "district"]
    return (
        _drop_null_keys(df, keys)
        .groupBy(*keys)
        .agg(
            F.count("crime_type").alias("total_crimes"),
            F.count_distinct("crime_type").alias("unique_crime_types"),
            F.sum(F.col("is_weekend").cast("long")).alias("weekend_crimes"),
            F.avg("hour").alias("avg_hour"),
            F.stddev_samp("hour").alias("hour_std"),
        )
    )


def daily(df: DataFrame, ts_col: str = "ts") -> DataFrame:
    """A3: per calendar date: daily_crimes, districts_affected."""
    return (
        df.where(F.col(ts_col).isNotNull())
        .groupBy(F.to_date(ts_col).alias("date"))
        .agg(F.count("crime_type").alias("daily_crimes"), F.count_distinct("district").alias("districts_affected"))
    )


def type_by_district(df: DataFrame) -> DataFrame:
    """A4: rows per (district, crime_type)."""
    keys = ["district", "crime_type"]
    return _drop_null_keys(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def monthly_all(df: DataFrame, ts_col: str = "ts") -> DataFrame:
    """A5: incidents per month over all districts."""
    return (
        df.where(F.col(ts_col).isNotNull())
        .groupBy(month_start(ts_col).alias("month"))
        .agg(F.count(F.lit(1)).alias("crime_count"))
    )


def month_coverage(df: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Distinct months with data, plus first and last month, per district."""
    m = month_start(ts_col)
    return (
        _drop_null_keys(df, ["district", ts_col])
        .groupBy("district")
        .agg(F.count_distinct(m).alias("months"), F.min(m).alias("first_month"), F.max(m).alias("last_month"))
    )


def first_last_month(monthly: DataFrame) -> DataFrame:
    """First and last month of a monthly count table and their counts (one row)."""
    return monthly.agg(
        F.min("month").alias("first_month"),
        F.min_by("crime_count", "month").alias("first_count"),
        F.max("month").alias("last_month"),
        F.max_by("crime_count", "month").alias("last_count"),
    )


def value_counts(df: DataFrame, col: str, name: str = "count") -> DataFrame:
    """Rows per value, most frequent first (ties by value)."""
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias(name))
        .orderBy(F.col(name).desc(), F.col(col))
    )


def with_rank(counts: DataFrame, col: str, name: str = "count") -> DataFrame:
    """A9/A10 with the order as a column: ``position`` 1 is the most frequent value.

    The window runs over one row per distinct value, after the aggregate."""
    return counts.withColumn("position", F.row_number().over(Window.orderBy(F.col(name).desc(), F.col(col))))


def district_counts(df: DataFrame) -> DataFrame:
    """A9."""
    return value_counts(df, "district")


def type_counts(df: DataFrame) -> DataFrame:
    """A10."""
    return value_counts(df, "crime_type")


def dataset_info(df: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Rows, first and last date, and the column list (one row)."""
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.min(F.to_date(ts_col)).alias("date_min"),
        F.max(F.to_date(ts_col)).alias("date_max"),
    ).withColumn("columns", F.lit(",".join(df.columns)))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-null values of a column (rows; sort in the payload)."""
    return df.select(col).where(F.col(col).isNotNull()).distinct()


def cardinalities(df: DataFrame, approx: bool = False) -> DataFrame:
    """Number of districts and of crime types (one row).

    ``approx=True`` uses HyperLogLog++ (``approx_count_distinct``), which keeps
    a fixed-size sketch per task instead of shuffling every distinct value."""
    fn = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(fn("district").alias("unique_districts"), fn("crime_type").alias("unique_crime_types"))


#: log2 of a sketch's buckets, and the relative error that 3 of its standard errors make (1.04 / sqrt(buckets) each)
SKETCH_LOG = 12
SKETCH_BOUND = 3 * 1.04 / 2 ** (SKETCH_LOG / 2)


def monthly_sketches(df: DataFrame, columns: Sequence[str], ts_col: str = "ts", log_buckets: int = SKETCH_LOG) -> DataFrame:
    """A13/A3 in a form that adds up: ``month, column_name, sketch``, a HyperLogLog sketch of a few kB for each
    month and column. Written next to a published version, sketches answer later questions without a scan of the rows."""
    per = df.groupBy(F.trunc(ts_col, "MM").alias("month")).agg(*[F.hll_sketch_agg(c, log_buckets).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("sketch")) for c in columns]))
    return per.select("month", rows.alias("s")).select("month", "s.column_name", "s.sketch")


def merged_cardinalities(sketches: DataFrame, *by: str) -> DataFrame:
    """Distinct values (estimated) of each column over the months and versions that ``sketches`` hold, or for each
    value of ``by``. Unions lose nothing: the estimate is that of one sketch over all rows, within
    ``SKETCH_BOUND`` (3 standard errors), and exact for a few hundred values."""
    merged = sketches.groupBy(*by, "column_name").agg(F.hll_union_agg("sketch", True).alias("s"))
    return merged.select(*by, "column_name", F.hll_sketch_estimate("s").alias("estimate"))


def missing_values(df: DataFrame) -> DataFrame:
    """Null count per column, one row per column, in one scan."""
    counts = df.select([F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "missing")


def date_range_days(df: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Days between the first and the last date (one row)."""
    return df.agg(F.datediff(F.max(F.to_date(ts_col)), F.min(F.to_date(ts_col))).alias("span_days"))


def data_summary(df: DataFrame, ts_col: str = "ts", processed_on=None) -> DataFrame:
    """Processing summary — A11 + A13 + A14 in one aggregate pass (one row),
    with the column list and the processing date (``processed_on``, by default today)."""
    nulls = [F.count_if(F.col(c).isNull()) for c in df.columns]
    day = F.current_date() if processed_on is None else F.lit(processed_on).cast("date")
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.struct(F.min(F.to_date(ts_col)).alias("start"), F.max(F.to_date(ts_col)).alias("end")).alias("date_range"),
        F.count_distinct("district").alias("unique_districts"),
        F.count_distinct("crime_type").alias("unique_crime_types"),
        F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*nulls)).alias("missing_values"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        day.alias("processing_date"),
    )


def upload_quality(raw: DataFrame, date_text_col: str | None = None) -> DataFrame:
    """Rows, distinct rows, duplicates removed and quality % (100 when empty),
    with the rows whose date doesn't parse in a column of their own: an undated row
    is no duplicate. One aggregate of the raw rows by value."""
    undated = F.lit(False)
    if date_text_col is not None:
        undated = parse_datetime(date_text_col).isNull()
    same = raw.groupBy(*raw.columns).agg(F.count(F.lit(1)).alias("_n"))
    out = same.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("original_records"),
        F.count(F.lit(1)).alias("processed_records"),
        F.coalesce(F.sum(F.when(undated, F.col("_n"))), F.lit(0)).alias("undated_records"),
    )
    return out.select(
        "original_records",
        "processed_records",
        (F.col("original_records") - F.col("processed_records")).alias("duplicates_removed"),
        "undated_records",
        F.when(F.col("original_records") > 0, F.col("processed_records") / F.col("original_records") * 100.0)
        .otherwise(F.lit(100.0))
        .alias("data_quality_pct"),
    )
