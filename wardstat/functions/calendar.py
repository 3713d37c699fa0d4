"""Calendar expressions (R3-R15, P7, P12) and the feature block of the cleaner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstat import constants as K
from wardstat.functions._util import col_of

# Tried in order after the ISO form: month-first, then day-first.
DATE_FORMATS = ("MM/dd/yyyy", "dd/MM/yyyy")


def parse_datetime(c) -> Column:
    """Tolerant parse; unparseable text becomes NULL (never an error under ANSI).

    Result is ``TIMESTAMP_NTZ`` (wall-clock time, no session-zone shift).
    """
    c = col_of(c)
    tries = [F.try_to_timestamp(c)] + [F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS]
    return F.coalesce(*tries).cast("timestamp_ntz")


def format_votes(df: DataFrame, *columns: str) -> DataFrame:
    """R3 by column: ``column_name, n_text, n_iso, n_month_first, n_day_first, n_ambiguous, chosen``, in one pass.

    A column is written one way, so its rows vote: each counts for every form that reads it. The slashed form
    that reads more rows is chosen (month first if equal). Ambiguous rows are read by both, as
    different days; a single row can't tell, the column can."""
    both = [F.try_to_timestamp(F.col("v"), F.lit(f)) for f in DATE_FORMATS]
    iso = F.try_to_timestamp(F.col("v"))
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns])).alias("s")).select("s.*")
    read = long.select("column_name", F.col("v").isNotNull().alias("text"), iso.isNotNull().alias("iso"), *[(iso.isNull() & b.isNotNull()).alias(n) for b, n in zip(both, "ab")], (iso.isNull() & (both[0] != both[1])).alias("odd"))
    votes = read.groupBy("column_name").agg(
        F.count_if("text").alias("n_text"), F.count_if("iso").alias("n_iso"), F.count_if("a").alias("n_month_first"),
        F.count_if("b").alias("n_day_first"), F.count_if("odd").alias("n_ambiguous"),
    )
    return votes.withColumn("chosen", F.when(F.col("n_day_first") > F.col("n_month_first"), "day first").otherwise("month first"))


def parse_by_vote(df: DataFrame, column: str, out: str) -> DataFrame:
    """R3 with the form that the column's rows chose (``format_votes``; a scalar subquery, so the plan stays lazy):
    ISO text, and slashed text in the chosen form alone. What only the other form reads becomes NULL."""
    chosen = format_votes(df, column).select("chosen").scalar()
    told = df.withColumn("_chosen", chosen)
    slashed = F.when(F.col("_chosen") == "day first", F.try_to_timestamp(F.col(column), F.lit(DATE_FORMATS[1]))).otherwise(F.try_to_timestamp(F.col(column), F.lit(DATE_FORMATS[0])))
    return told.withColumn(out, F.coalesce(F.try_to_timestamp(F.col(column)), slashed).cast("timestamp_ntz")).drop("_chosen")


def parse_datetime_strict(c) -> Column:
    """Strict parse — raises on bad text under ANSI mode; run gate G3 first."""
    return F.to_timestamp_ntz(col_of(c))


def day_of_week(ts) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(col_of(ts))


def is_weekend(ts) -> Column:
    """Saturday or Sunday."""
    return day_of_week(ts).isin(*K.WEEKEND_DAYS)


def day_name(ts) -> Column:
    """Full English day name."""
    return F.date_format(col_of(ts), "EEEE")


def month_name(ts) -> Column:
    """Full English month name."""
    return F.date_format(col_of(ts), "MMMM")


def month_start(ts) -> Column:
    """Month period as the DATE of its first day."""
    return F.trunc(col_of(ts), "MM")


def month_text(ts) -> Column:
    """``yyyy-MM``."""
    return F.date_format(col_of(ts), "yyyy-MM")


def month_key(year, month) -> Column:
    """``year-MM`` from integer parts."""
    return F.concat_ws("-", col_of(year).cast("string"), F.lpad(col_of(month).cast("string"), 2, "0"))


def time_of_day(hour) -> Column:
    """Right-closed hour buckets [0,6], (6,12], (12,18], (18,24]."""
    h = col_of(hour)
    expr = None
    for label, upper in K.TIME_OF_DAY:
        cond = h <= upper
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def season(month) -> Column:
    """Season from month number."""
    m = col_of(month)
    expr = None
    for label, months in K.SEASON_MONTHS:
        expr = F.when(m.isin(*months), label) if expr is None else expr.when(m.isin(*months), label)
    return expr.otherwise(F.when(m.isNotNull(), F.lit(K.SEASON_ELSE)))


def date_text(ts) -> Column:
    """``%Y-%m-%d``."""
    return F.date_format(col_of(ts), "yyyy-MM-dd")


def time_text(ts) -> Column:
    """``%H:%M:%S``."""
    return F.date_format(col_of(ts), "HH:mm:ss")


def datetime_text(ts) -> Column:
    """``%Y-%m-%d %H:%M:%S``."""
    return F.date_format(col_of(ts), "yyyy-MM-dd HH:mm:ss")


def add_days(d, n) -> Column:
    """R14."""
    return F.date_add(col_of(d), n)


def add_months(d, n) -> Column:
    """R14 (T15: calendar months, not 30-day steps)."""
    return F.add_months(col_of(d), n)


def padded_id(prefix: str, n, width: int = 6) -> Column:
    """``CASE_000001``."""
    return F.format_string(f"{prefix}%0{width}d", col_of(n))


def with_calendar(df: DataFrame, ts_col: str = "ts") -> DataFrame:
    """The cleaner's feature block: year, month, day, hour, day_of_week, day_name,
    month_name, year_month (DATE), quarter, is_weekend (BOOLEAN), time_of_day.

    ``ts_col`` is the event-time column (T5: pass the true date-time; a date-only
    column gives hour 0 everywhere).
    """
    ts = F.col(ts_col)
    return df.withColumns(
        {
            "year": F.year(ts),
            "month": F.month(ts),
            "day": F.dayofmonth(ts),
            "hour": F.hour(ts),
            "day_of_week": day_of_week(ts),
            "day_name": day_name(ts),
            "month_name": month_name(ts),
            "year_month": month_start(ts),
            "quarter": F.quarter(ts),
            "is_weekend": is_weekend(ts),
            "time_of_day": time_of_day(F.hour(ts)),
        }
    )
