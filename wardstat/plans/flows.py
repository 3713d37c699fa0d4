"""End-to-end flows of the original application, as lazy DataFrame plans.

(a) ``preprocess``        clean -> calendar features -> three aggregates
(b) ``forecast_request``  monthly series -> backtest + forecast -> payload rows
(c) ``retrain``           gates -> back-test of three models -> risk forest, saved (M15);
    ``upload_and_retrain`` reads, publishes and retrains
(d) ``risk_request``      features -> defaults -> rule score, or a fitted forest

The per-district loop of the original becomes one grouped plan: districts are
rows, partitioned by ``district`` across executors; an ineligible district is a
gate row, not an exception.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from wardstat import constants as K
from wardstat.functions.calendar import with_calendar
from wardstat.operators import aggregates as A
from wardstat.operators import clean as CL
from wardstat.operators import forecast as FC
from wardstat.operators import quality as G
from wardstat.operators import risk as RK
from wardstat.operators import series as S
from wardstat.session import materialize
from wardstat.sources import io as IO


def preprocess(
    raw: DataFrame, ts_col: str = "ts", cache: bool = False, out_dir: str | None = None
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(a) cleaning flow + features; returns the processed table and the
    ``monthly_district``, ``daily`` and ``crime_type_district`` aggregates.

    The processed table feeds three aggregates. With ``out_dir`` (a shared folder;
    the normal path) it is written there as Parquet partitioned by year (S4, as the
    original saves it) and the aggregates read the files: each scans only its own
    columns, and a lost executor costs a re-read, not a re-clean. Without it the plans
    stay lazy and each aggregate cleans the raw table anew, unless ``cache=True``;
    the caller then unpersists the processed table."""
    processed = with_calendar(CL.clean_incidents(raw, ts_col=ts_col), ts_col)
    if out_dir is not None:
        path = f"{out_dir.rstrip('/')}/processed"
        IO.write_processed(processed, path)
        cols = processed.columns  # the partition column comes back last; keep the original order
        processed = processed.sparkSession.read.schema(processed.schema).parquet(path).select(*cols)
    elif cache:
        processed = processed.cache()
    aggs = {
        "monthly_district": A.monthly_district(processed),
        "daily": A.daily(processed, ts_col),
        "crime_type_district": A.type_by_district(processed),
    }
    return processed, aggs


def preprocess_logged(raw: DataFrame, out_dir: str, ts_col: str = "ts") -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """(a) with G7's log and G2's row count as by-products of the write: ``preprocess`` into ``out_dir``, and
    ``step, step_no, rows_in, rows_out, changed`` of the six cleaning steps.

    Rows are counted as they pass (``Observation``), so the raw table is read once for the processed table,
    the log and everything after. A stage that runs again after a lost executor may be counted
    again; ``quality.processing_log`` counts by an aggregate of its own. (A session that has observed can't
    predict by a classifier that still holds its training summary; the library's forests are copies without it.)"""
    loaded, dated, kept = Observation("loaded"), Observation("dated"), Observation("kept")
    null = lambda d, c: F.count_if(F.col(c).isNull()) if c in d.columns else F.lit(0)
    out = CL.canonical_columns(raw).observe(loaded, F.count(F.lit(1)).alias("n"))
    out = CL.if_has(out, "date", lambda d: CL.parse_dates(d, "date", ts_col))
    out = CL.if_has(CL.tidy_labels(out), ts_col, lambda d: CL.drop_undated(d, ts_col))
    no_place = [F.col(c).isNull() for c in ("latitude", "longitude") if c in out.columns]
    unplaced = F.count_if(reduce(or_, no_place)) if no_place else F.lit(0)
    out = out.observe(dated, F.count(F.lit(1)).alias("n"), null(out, "district").alias("nd"), null(out, "crime_type").alias("nt"), unplaced.alias("np"))
    out = CL.if_has(out, "district", CL.fill_district)
    out = CL.if_has(out, "crime_type", CL.fill_type)
    out = CL.dedup(out).observe(kept, F.count(F.lit(1)).alias("n"))
    processed = with_calendar(out, ts_col)
    path = f"{out_dir.rstrip('/')}/processed"
    IO.write_processed(processed, path)
    spark = raw.sparkSession
    n, d, k = loaded.get["n"], dated.get, kept.get["n"]
    steps = [
        ("load", n, n, 0), ("drop_undated", n, d["n"], n - d["n"]), ("fill_district", d["n"], d["n"], d["nd"]),
        ("fill_type", d["n"], d["n"], d["nt"]), ("flag_coordinates", d["n"], d["n"], d["np"]), ("deduplicate", d["n"], k, d["n"] - k),
    ]
    log = spark.createDataFrame([(s, i, a, b, c) for i, (s, a, b, c) in enumerate(steps, 1)], "step string, step_no int, rows_in long, rows_out long, changed long")
    back = spark.read.schema(processed.schema).parquet(path).select(*processed.columns)
    aggs = {"monthly_district": A.monthly_district(back), "daily": A.daily(back, ts_col), "crime_type_district": A.type_by_district(back)}
    return back, aggs, log


def monthly_series_for(df: DataFrame, district: str | None = "all", ts_col: str = "ts") -> DataFrame:
    """Dense monthly series of one district, of ``all`` districts pooled, or of
    every district (``district=None``), without an unfinished last month of the
    table. For one district the filter on the counts is pushed to the scan; only the
    table's latest date (a scalar subquery) is taken over all of it."""
    if district == S.ALL:
        named = df.where(F.col("district").isNotNull()).select(F.lit(S.ALL).alias("district"), F.col(ts_col))
        counts = S.complete_months(S.monthly_counts(named, ts_col))
    else:
        counts = S.complete_months(S.monthly_counts(df, ts_col))
        counts = counts if district is None else CL.for_district(counts, district)
    return S.densify(counts)


def forecast_request(df: DataFrame, district: str = "all", months_ahead: int = 6, models=("arima", "sarima", "lstm")):
    """(b) forecast rows, model scores and the selection record for one district
    (or ``all``). Returns three DataFrames; ``month`` is ``yyyy-MM`` text.

    The backtest is run once and written; the table's best model and the selection read
    it, so M3 is fitted twice at most: on the hold-out and on the full history."""
    series = materialize(monthly_series_for(df, district))
    closed = all(m in ("arima", "sarima") for m in models)
    scores = FC.backtest(series, models, materialize_input=False)
    scores = scores if closed else materialize(scores)
    table = FC.forecast_table(series, months_ahead, models, materialize_input=False, scores=None if closed else scores)
    return FC.payload_month(table), scores, FC.model_selection(scores)


def training_info(df: DataFrame, ts_col: str = "ts", models=K.MODELS) -> DataFrame:
    """Records, districts, types, span in days and the models run (one row)."""
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_distinct("district").alias("districts"),
        F.count_distinct("crime_type").alias("crime_types"),
        F.datediff(F.max(F.to_date(ts_col)), F.min(F.to_date(ts_col))).alias("span_days"),
    ).withColumn("models", F.lit(",".join(models)))


@dataclass
class Retrained:
    """What M15 returns: the summary (one row), the gate rows, a row for each district
    and model (empty if no forecast was trained), and the forest with its folder."""

    summary: DataFrame
    gates: DataFrame
    districts: DataFrame
    model: object | None = None
    model_path: str | None = None


_SUMMARY = (
    "kind string, status string, total_records long, districts long, crime_types long, span_days int, models string, errors string, warnings string, "
    "forecast_districts long, avg_best_mae double, risk_accuracy double, risk_classes string, feature_names string, num_features int, num_districts long, model_path string"
)


def retrain(
    df: DataFrame,
    kind: str = "all",
    risk_df: DataFrame | None = None,
    dim: DataFrame | None = None,
    class_map: dict | None = None,
    models_dir: str | None = None,
    ts_col: str = "ts",
    date_text_col: str | None = None,
) -> Retrained:
    """(c) M15: gates G1-G5, then the back-test of all three forecast models and/or the
    risk forest.

    ``df`` are the incidents of the forecasts, ``risk_df`` those of the risk features
    (``df`` if None: they need true hours). ``kind`` is ``forecast``, ``risk`` or ``all``.
    A failed gate trains nothing (``status`` ``failed``, its checks in ``errors``); so
    does a risk label of one class (``single_class``), with which any accuracy would be 1. The
    accuracy is that of districts held out of a fit; the model that is kept, and saved
    under ``models_dir``, is fitted on all districts. Rows that reach the driver: one per
    gate kind, one summary."""
    if kind not in ("forecast", "risk", "all"):
        raise ValueError("kind must be forecast, risk or all")
    spark = df.sparkSession
    risk_df = df if risk_df is None else risk_df
    gates = G.required_columns(spark, df, (ts_col, "district")).unionByName(G.min_rows_and_span(df, ts_col))
    if date_text_col is not None:
        gates = gates.unionByName(G.dates_parse(df, date_text_col))
    report = G.validation_report(gates).first()
    months = G.months_per_district(df, ts_col)  # G5: a warning for each short district, which is left out
    gates = gates.unionByName(months)
    info = training_info(df, ts_col, ()).first()
    out = {"kind": kind, "status": "ok", "total_records": info[0], "districts": info[1], "crime_types": info[2], "span_days": info[3], "models": ""}
    errors, warnings = list(report["errors"]), list(report["warnings"])
    if months.where(~F.col("ok")).limit(1).count():
        warnings.append("min_months")
    none = spark.createDataFrame([], "district string, model string, mae double, mse double, n_test long, rmse double, is_best boolean")
    districts, model, path, ran = none, None, None, []
    if not errors and kind in ("forecast", "all"):
        scores = materialize(FC.backtest(monthly_series_for(df, None, ts_col), K.MODELS))
        best = FC.best_model_expr().over(Window.partitionBy("district"))
        districts = scores.withColumn("is_best", F.col("model") == best)
        per = scores.groupBy("model").count().collect()  # one row per model
        ran += [m for m in K.MODELS if m in {r["model"] for r in per}]
        one = FC.best_model(scores).agg(F.count(F.lit(1)), F.avg("best_mae")).first()
        out |= {"forecast_districts": one[0], "avg_best_mae": one[1]}
    if not errors and kind in ("risk", "all"):
        feats = materialize(RK.risk_features(risk_df, dim, class_map, ts_col))
        classes = sorted(r[0] for r in RK.labelled(feats).select("risk_level").distinct().collect())  # three at most
        fit, held = RK.hold_out(feats)
        fit_classes = RK.labelled(fit).select("risk_level").distinct().count()
        out |= {"risk_classes": ",".join(classes), "feature_names": ",".join(RK.FEATURES), "num_features": len(RK.FEATURES), "num_districts": feats.count()}
        if fit_classes < 2:
            errors.append("single_class")
        else:
            out["risk_accuracy"] = RK.held_out_metrics(feats).first()["accuracy"]
            model = RK.train_risk(feats, materialize_input=False)
            ran.append("random_forest")
            if models_dir is not None:
                path = f"{models_dir.rstrip('/')}/risk_forest"
                IO.save_model(model, path)
    out |= {"status": "failed" if errors else "ok", "models": ",".join(ran), "errors": ",".join(errors), "warnings": ",".join(warnings), "model_path": path}
    names = [c.split()[0] for c in _SUMMARY.split(", ")]
    summary = spark.createDataFrame([tuple(out.get(n) for n in names)], _SUMMARY)
    if models_dir is not None:
        IO.write_training_summary(summary, f"{models_dir.rstrip('/')}/training_summary")
    return Retrained(summary, gates, districts, model, path)


def upload_and_retrain(
    spark, path: str, published: str, models_dir: str | None = None, kind: str = "all", dim: DataFrame | None = None, class_map: dict | None = None
) -> tuple[DataFrame, Retrained]:
    """Upload flow: only CSV, at least a row (S2); quality (A17) of what came; canonical
    names, dates, exact duplicates and fills (an unnamed type is ``General Crime``); a new
    published version (S8), older ones stay; then M15 on the published table (S10).

    Returns the upload summary (A17 and the version, one row) and what retraining returns."""
    raw = CL.canonical_columns(IO.read_upload(spark, path))
    quality = A.upload_quality(raw, "date")
    clean = CL.clean_incidents(raw, null_type=K.NULL_TYPE_UPLOAD)
    version = IO.publish(clean, published)
    current = IO.read_current(spark, published)
    return quality.withColumn("version", F.lit(version)), retrain(current, kind, dim=dim, class_map=class_map, models_dir=models_dir)


def risk_request(features: DataFrame, model=None, accuracy: float | None = None) -> DataFrame:
    """(d) score every district: the fitted forest when given, else the rule path.
    Both carry level, confidence, probabilities, accuracy and the importance map."""
    if model is not None:
        return RK.predict_risk(model, features, accuracy)
    return RK.rule_risk(features)
