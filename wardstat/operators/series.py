"""Monthly series and positional operations.

A series is rows ``(district, month, t, y)``, never an array. The heavy work —
counting incidents per (district, month) — is a partial+final hash aggregate
over the incident table; everything after it runs on districts x months rows,
and every window is ``partitionBy('district')`` so Spark plans one exchange
on ``district`` and reuses it for the whole window chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardstat import constants as K
from wardstat.functions.calendar import month_start, padded_id
from wardstat.session import write_table

ALL = "all"


def _by_district(order: str = "t") -> Window:
    return Window.partitionBy("district").orderBy(order)


def monthly_counts(df: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Incidents per (district, month) and the last date among them (``last_date``);
    null districts and dates dropped."""
    return (
        df.where(F.col(ts_col).isNotNull() & F.col("district").isNotNull())
        .groupBy("district", month_start(ts_col).alias("month"))
        .agg(F.count(F.lit(1)).alias("crime_count"), F.max(F.to_date(ts_col)).alias("last_date"))
    )


def _unfinished(counts: DataFrame):
    """Condition: the row's month is the table's last one and the table ends before it does.

    The table's latest date is a scalar subquery over the monthly counts (one
    value, no join)."""
    last = counts.agg(F.max("last_date")).scalar()
    return (F.col("month") == F.trunc(last, "month")) & (last < F.last_day(last))


def complete_months(counts: DataFrame) -> DataFrame:
    """Monthly counts without an unfinished last month, as a series needs them.

    A table that ends before its last month does would end every series on a
    false drop, so that month (and no other) is left out; ``unfinished_month``
    returns what. Counts, cardinalities and spans never go through this step."""
    return counts.where(~_unfinished(counts)).drop("last_date")


def unfinished_month(counts: DataFrame) -> DataFrame:
    """What ``complete_months`` leaves out: ``district, month, crime_count, last_date``."""
    return counts.where(_unfinished(counts))


def monthly_series(df: DataFrame, ts_col: str = "ts", all_label: str = ALL) -> DataFrame:
    """Per-district and all-district monthly counts in one aggregate.

    ``GROUPING SETS ((district, month), (month))``: one scan, one exchange; the
    all-district rows are labelled ``all_label``."""
    d = df.where(F.col(ts_col).isNotNull()).withColumn("month", month_start(ts_col))
    g = d.groupingSets([["district", "month"], ["month"]], "district", "month").agg(
        F.count(F.lit(1)).alias("crime_count"), F.grouping_id().alias("_gid")
    )
    g = g.where((F.col("_gid") != 0) | F.col("district").isNotNull())
    return g.select(
        F.when(F.col("_gid") == 0, F.col("district")).otherwise(F.lit(all_label)).alias("district"),
        "month",
        "crime_count",
    )


def densify(counts: DataFrame, value_col: str = "crime_count") -> DataFrame:
    """Gap-free month calendar per district with zero-filled counts.

    Each district runs from its own first to its last month. Adds ``t`` (1..n).
    Rows only, one window partitioning: every observed month is exploded into
    itself plus the empty months up to the next observed one (``lead``), so no
    calendar frame is built and joined back."""
    w = _by_district("month")
    nxt = F.lead("month").over(w)
    x = counts.select("district", "month", F.col(value_col).alias("_v"), nxt.alias("_next"))
    last = F.coalesce(F.add_months(F.col("_next"), -1), F.col("month"))
    x = x.select("district", "_v", F.col("month").alias("_obs"),
                 F.explode(F.sequence(F.col("month"), last, F.expr("interval 1 month"))).alias("month"))
    y = F.when(F.col("month") == F.col("_obs"), F.coalesce(F.col("_v"), F.lit(0))).otherwise(F.lit(0)).cast("double")
    s = x.select("district", "month", y.alias("y"))
    return s.withColumn("t", F.row_number().over(w))


def with_length(s: DataFrame) -> DataFrame:
    """Number of points of each series as ``n``."""
    return s.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("district")))


def eligible_series(s: DataFrame, min_points: int = K.MIN_MONTHS) -> DataFrame:
    """Keep series with at least ``min_points`` months (the rest are skipped)."""
    s = s if "n" in s.columns else with_length(s)
    return s.where(F.col("n") >= min_points)


def split_series(s: DataFrame, frac: float = K.TRAIN_FRACTION) -> DataFrame:
    """First ``int(n * frac)`` points are ``train``, the rest ``test``."""
    s = s if "n" in s.columns else with_length(s)
    s = s.withColumn("n_train", F.floor(F.col("n") * frac).cast("int"))
    return s.withColumn("split", F.when(F.col("t") <= F.col("n_train"), "train").otherwise("test"))


def lag_features(s: DataFrame, k: int = K.LOOK_BACK, col: str = "y", prefix: str = "l") -> DataFrame:
    """``l1 .. lk`` = value 1..k months earlier (NULL before the start)."""
    w = _by_district()
    return s.withColumns({f"{prefix}{i}": F.lag(col, i).over(w) for i in range(1, k + 1)})


def differences(s: DataFrame, col: str = "y") -> DataFrame:
    """First difference ``dy`` and seasonal (12-month) difference ``sy``."""
    w = _by_district()
    return s.withColumns({"dy": F.col(col) - F.lag(col, 1).over(w), "sy": F.col(col) - F.lag(col, 12).over(w)})


def scale(s: DataFrame, col: str = "y", fit_rows=None) -> DataFrame:
    """Min-max scale per series; min and max come from ``fit_rows`` (default:
    train rows when ``split`` exists). Adds ``y_min``, ``y_max`` and ``{col}_s``."""
    if fit_rows is None:
        fit_rows = F.col("split") == "train" if "split" in s.columns else F.lit(True)
    w = Window.partitionBy("district")
    s = s.withColumns(
        {
            "y_min": F.min(F.when(fit_rows, F.col(col))).over(w),
            "y_max": F.max(F.when(fit_rows, F.col(col))).over(w),
        }
    )
    rng = F.col("y_max") - F.col("y_min")
    return s.withColumn(f"{col}_s", F.when(rng > 0, (F.col(col) - F.col("y_min")) / rng).otherwise(F.lit(0.0)))


def unscale(c, y_min="y_min", y_max="y_max"):
    """W5 inverse as an expression."""
    lo, hi = F.col(y_min), F.col(y_max)
    x = F.col(c) if isinstance(c, str) else c
    return x * (hi - lo) + lo


def numbered(df: DataFrame, *order, name: str = "position", path: str | None = None) -> DataFrame:
    """The place of each row in ``order`` (from 1) as a column, without a global window.

    A range-partitioned sort on the full key spreads even a hot timestamp over
    many tasks; each task numbers its rows locally, and a per-partition offset
    (one row per partition) turns local numbers into global ones. The numbered
    frame is written, so a recomputation after a lost executor reads the same
    numbers: to ``path`` (a shared folder that the caller owns and deletes), or
    to the session's scratch folder, which ``session.drop_scratch`` empties.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    s = df.orderBy(*keys).withColumns(
        {"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}
    )
    s = write_table(s, "numbered", path)
    per = s.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_i0"))
    wo = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    per = per.withColumn("_off", F.coalesce(F.sum("_n").over(wo), F.lit(0)))
    out = s.join(per.select("_p", "_i0", "_off"), "_p")  # the planner broadcasts it by its size
    return out.withColumn(name, F.col("_off") + (F.col("_i") - F.col("_i0")) + 1).drop("_p", "_i", "_i0", "_off")


def with_case_id(
    df: DataFrame, prefix: str = "CASE_", order=("ts", "case_no"), id_col: str = "case_id", path: str | None = None
) -> DataFrame:
    """Sequential ids ``CASE_000001`` in time order (``numbered``; ``path`` as there)."""
    n = numbered(df, *order, name="_position", path=path)
    return n.withColumn(id_col, padded_id(prefix, F.col("_position"))).drop("_position")
