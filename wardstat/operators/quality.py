"""Quality gates (G1-G8). Gate rows: ``check, subject, ok, observed, threshold, severity``.

Table-level gates are one aggregate pass; the per-district month gate (G5) is
a ``count_distinct`` per district. Reports are built from gate rows, never
by collecting data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstat import constants as K
from wardstat.functions.calendar import month_start, parse_datetime
from wardstat.functions.text import strip_title

GATE_SCHEMA = "check string, subject string, ok boolean, observed double, threshold double, severity string"


def _gate(check, subject, ok, observed, threshold, severity="error"):
    return [
        F.lit(check).alias("check"),
        (subject if not isinstance(subject, str) else F.lit(subject)).alias("subject"),
        ok.alias("ok"),
        observed.cast("double").alias("observed"),
        F.lit(float(threshold)).alias("threshold"),
        F.lit(severity).alias("severity"),
    ]


def required_columns(spark: SparkSession, df: DataFrame, required=("date", "district")) -> DataFrame:
    """G1: the required columns exist (schema test; one row)."""
    missing = [c for c in required if c not in df.columns]
    return spark.createDataFrame(
        [("required_columns", ",".join(missing) or "*", not missing, float(len(missing)), 0.0, "error")], GATE_SCHEMA
    )


def min_rows(df: DataFrame, n: int = K.MIN_ROWS) -> DataFrame:
    """At least ``n`` rows."""
    c = F.count(F.lit(1))
    return df.agg(c.alias("_n")).select(*_gate("min_rows", "*", F.col("_n") >= n, F.col("_n"), n))


def dates_parse(df: DataFrame, text_col: str = "date") -> DataFrame:
    """Every non-null date text parses (the strict retrainer would fail otherwise)."""
    bad = F.count_if(F.col(text_col).isNotNull() & parse_datetime(text_col).isNull())
    return df.agg(bad.alias("_b")).select(*_gate("dates_parse", "*", F.col("_b") == 0, F.col("_b"), 0))


def span_warning(df: DataFrame, ts_col: str = "ts", days: int = K.SHORT_SPAN_DAYS) -> DataFrame:
    """Warning when the data spans fewer than ``days`` days."""
    span = F.datediff(F.max(F.to_date(ts_col)), F.min(F.to_date(ts_col)))
    return df.agg(span.alias("_s")).select(*_gate("date_span", "*", F.col("_s") >= days, F.col("_s"), days, "warning"))


def min_rows_and_span(df: DataFrame, ts_col: str = "ts", n: int = K.MIN_ROWS, days: int = K.SHORT_SPAN_DAYS) -> DataFrame:
    """G2 + G4 on an already-typed table in one aggregate pass (two gate rows)."""
    span = F.datediff(F.max(F.to_date(ts_col)), F.min(F.to_date(ts_col)))
    one = df.agg(F.count(F.lit(1)).alias("_n"), span.alias("_s"))
    rows = []
    for check, ok, obs, thr, sev in (
        ("min_rows", F.col("_n") >= n, F.col("_n"), n, "error"),
        ("date_span", F.col("_s") >= days, F.col("_s"), days, "warning"),
    ):
        rows.append(
            F.struct(
                F.lit(check).alias("check"), F.lit("*").alias("subject"), ok.alias("ok"),
                obs.cast("double").alias("observed"), F.lit(float(thr)).alias("threshold"), F.lit(sev).alias("severity"),
            )
        )
    return one.select(F.inline(F.array(*rows)))


def months_per_district(df: DataFrame, ts_col: str = "ts", n: int = K.MIN_MONTHS) -> DataFrame:
    """Months with data per district, at least ``n`` (one row per district)."""
    g = df.where(F.col("district").isNotNull() & F.col(ts_col).isNotNull()).groupBy("district").agg(
        F.count_distinct(month_start(ts_col)).alias("_m")
    )
    return g.select(*_gate("min_months", F.col("district"), F.col("_m") >= n, F.col("_m"), n, "warning"))


def table_gates(raw: DataFrame, date_text_col: str = "date", min_n: int = K.MIN_ROWS, span_days: int = K.SHORT_SPAN_DAYS) -> DataFrame:
    """G1-G4 as gate rows from the loaded table, as the retrainer validates it:
    G1 on the schema, and G2 (rows), G3 (dates parse) and G4 (span) from ONE
    aggregate pass over the raw rows, emitted as three rows with ``inline``."""
    spark = raw.sparkSession
    parsed = parse_datetime(date_text_col)
    one = raw.agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col(date_text_col).isNotNull() & parsed.isNull()).alias("_bad"),
        F.datediff(F.max(F.to_date(parsed)), F.min(F.to_date(parsed))).alias("_span"),
    )

    def row(check, ok, observed, threshold, severity):
        return F.struct(
            F.lit(check).alias("check"), F.lit("*").alias("subject"), ok.alias("ok"),
            observed.cast("double").alias("observed"), F.lit(float(threshold)).alias("threshold"),
            F.lit(severity).alias("severity"),
        )

    n, bad, span = F.col("_n"), F.col("_bad"), F.col("_span")
    rows = one.select(
        F.inline(
            F.array(
                row("min_rows", n >= min_n, n, min_n, "error"),
                row("dates_parse", bad == 0, bad, 0, "error"),
                row("date_span", span >= span_days, span, span_days, "warning"),
            )
        )
    )
    return required_columns(spark, raw).unionByName(rows)


def validation_report(gates: DataFrame) -> DataFrame:
    """``valid``, failed error checks and failed warning checks (one row)."""
    failed = ~F.col("ok")
    return gates.agg(
        (F.count_if(failed & (F.col("severity") == "error")) == 0).alias("valid"),
        F.sort_array(F.collect_list(F.when(failed & (F.col("severity") == "error"), F.col("check")))).alias("errors"),
        F.sort_array(F.collect_list(F.when(failed & (F.col("severity") == "warning"), F.col("check")))).alias("warnings"),
    )


def processing_log(raw: DataFrame, date_text_col: str = "date") -> DataFrame:
    """``step, step_no, rows_in, rows_out, changed`` of the six cleaning steps.

    The raw table is read once: rows are cleaned in place and counted by their
    cleaned values (partial counts first), with what each step changes as flags
    of the row, so the number of groups is the number of rows that dedup keeps."""
    dated = parse_datetime(date_text_col)
    has = set(raw.columns)
    missing = lambda c: F.col(c).isNull() if c in has else F.lit(False)
    title = lambda c: strip_title(c) if c in has else F.lit(None).cast("string")
    flagged = raw.select(
        *[c for c in raw.columns if c not in (date_text_col, "district", "crime_type")],
        dated.alias("_ts"), F.coalesce(title("district"), F.lit(K.NULL_DISTRICT)).alias("_district"),
        F.coalesce(title("crime_type"), F.lit(K.NULL_TYPE)).alias("_type"),
        missing("district").alias("_nd"), missing("crime_type").alias("_nt"), (missing("latitude") | missing("longitude")).alias("_np"),
    )
    keys = [c for c in flagged.columns if c not in ("_nd", "_nt", "_np")]
    count = lambda c: F.count_if(F.col(c))
    same = flagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), count("_nd").alias("_nd"), count("_nt").alias("_nt"), count("_np").alias("_np"))
    kept = F.col("_ts").isNotNull()
    total = lambda c, when=None: F.coalesce(F.sum(F.col(c) if when is None else F.when(when, F.col(c))), F.lit(0))
    one = same.agg(
        total("_n").alias("loaded"), total("_n", kept).alias("dated"), F.count_if(kept).alias("kept"),
        total("_nd", kept).alias("nd"), total("_nt", kept).alias("nt"), total("_np", kept).alias("np"),
    )
    c = F.col
    steps = (
        ("load", c("loaded"), c("loaded"), F.lit(0)),
        ("drop_undated", c("loaded"), c("dated"), c("loaded") - c("dated")),
        ("fill_district", c("dated"), c("dated"), c("nd")),
        ("fill_type", c("dated"), c("dated"), c("nt")),
        ("flag_coordinates", c("dated"), c("dated"), c("np")),
        ("deduplicate", c("dated"), c("kept"), c("dated") - c("kept")),
    )
    rows = [
        F.struct(F.lit(name).alias("step"), F.lit(k).alias("step_no"), a.cast("long").alias("rows_in"), b.cast("long").alias("rows_out"), d.cast("long").alias("changed"))
        for k, (name, a, b, d) in enumerate(steps, 1)
    ]
    return one.select(F.inline(F.array(*rows)))


def dataset_statistics(df: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Rows, date range, distinct districts and types, missing cells (one row)."""
    nulls = None
    for c in df.columns:
        x = F.count_if(F.col(c).isNull())
        nulls = x if nulls is None else nulls + x
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.min(F.to_date(ts_col)).alias("date_min"),
        F.max(F.to_date(ts_col)).alias("date_max"),
        F.count_distinct("district").alias("unique_districts"),
        F.count_distinct("crime_type").alias("unique_crime_types"),
        nulls.alias("missing_cells"),
    )
