"""The four flows end to end, with the checks the original's own scripts print:
a forecast for one district and for ``all`` has ``months_ahead`` points, the best
model is one of the scored models, and its MAE prints with 2 decimals."""

import re

from pyspark.sql import functions as F

from wardstat.functions.calendar import with_calendar
from wardstat.operators import aggregates as A
from wardstat.operators import clean as CL
from wardstat.operators import risk as RK
from wardstat.plans import flows
from wardstat.sources.views import CLASS_MAP, Fixtures

SF = "/root/testdata/sf0.01"


def test_preprocess_flow(spark):
    fx = Fixtures(spark, SF)
    raw = fx.incidents_raw.withColumnsRenamed({"date_text": "Date", "district_text": "District", "type_text": "Crime_Type"})
    processed, aggs = flows.preprocess(raw, cache=True)
    try:
        assert {"year_month", "time_of_day", "is_weekend", "day_name"} <= set(processed.columns)
        direct = with_calendar(CL.clean_incidents(raw))
        assert processed.count() == direct.count()
        assert set(aggs) == {"monthly_district", "daily", "crime_type_district"}
        assert aggs["daily"].agg(F.sum("daily_crimes")).first()[0] == direct.count()
        assert aggs["crime_type_district"].agg(F.sum("count")).first()[0] == direct.count()
        md = aggs["monthly_district"].agg(F.sum("total_crimes")).first()[0]
        assert md == A.monthly_district(direct).agg(F.sum("total_crimes")).first()[0]
    finally:
        processed.unpersist()



def test_preprocess_flow_written_table(spark, tmp_path):
    fx = Fixtures(spark, SF)
    raw = fx.incidents_raw.withColumnsRenamed({"date_text": "Date", "district_text": "District", "type_text": "Crime_Type"})
    cached, aggs_c = flows.preprocess(raw, cache=True)
    written, aggs_w = flows.preprocess(raw, out_dir=str(tmp_path / "out"))
    try:
        assert written.dtypes == cached.dtypes
        for name in aggs_c:
            a = sorted(map(tuple, aggs_c[name].collect()))
            b = sorted(map(tuple, aggs_w[name].collect()))
            assert a == b, name
        p = aggs_w["crime_type_district"]._jdf.queryExecution().executedPlan().toString()
        assert "ReadSchema: struct<district:string,crime_type:string>" in p  # only its columns are read
    finally:
        cached.unpersist()

def _check_request(table, scores, selection, months_ahead):
    rows = table.collect()
    assert len(rows) == months_ahead
    models = {r["model"] for r in scores.collect()}
    sel = selection.first()
    assert sel["best_model"] in models
    assert re.fullmatch(r"[A-Z]+ selected with MAE of \d+\.\d{2}", sel["selection_note"])
    assert all(r["best_value"] is not None and r["best_value"] >= 0 for r in rows)


def test_forecast_request_all_and_one_district(spark):
    fx = Fixtures(spark, SF)
    m = fx.incidents_monthly
    for district in ("all", "NATION_3"):
        table, scores, selection = flows.forecast_request(m, district, 6, models=("arima", "sarima"))
        _check_request(table, scores, selection, 6)


def test_retrain_all_trains_saves_and_reloads(spark, tmp_path):
    from wardstat.operators import series as S
    from wardstat.sources import io as IO

    fx = Fixtures(spark, SF)
    done = flows.retrain(fx.incidents_monthly, "all", fx.incidents_hourly, fx.district_dim, CLASS_MAP, models_dir=str(tmp_path / "models"))
    out = done.summary.first()
    assert (out["status"], out["errors"], out["models"]) == ("ok", "", "arima,sarima,lstm,random_forest")
    assert out["forecast_districts"] == 25 and out["num_districts"] == 40 and out["num_features"] == 8
    assert out["feature_names"].split(",") == RK.FEATURES
    assert len(out["risk_classes"].split(",")) > 1 and 0 < out["risk_accuracy"] <= 1
    assert out["total_records"] == fx.incidents_monthly.count()
    rows = done.districts.collect()
    assert {r["model"] for r in rows} == {"arima", "sarima", "lstm"} and sum(r["is_best"] for r in rows) == 25
    assert {r["check"] for r in done.gates.collect()} == {"required_columns", "min_rows", "date_span", "min_months"}
    feats = RK.risk_features(fx.incidents_hourly, fx.district_dim, CLASS_MAP)
    again = IO.load_model(done.model_path)
    key = lambda r: (r["district"], r["risk_level"], round(r["confidence"], 12))
    assert sorted(map(key, RK.predict_risk(again, feats).collect())) == sorted(map(key, RK.predict_risk(done.model, feats).collect()))
    assert spark.read.json(str(tmp_path / "models/training_summary")).first()["status"] == "ok"


def test_retrain_failures(spark):
    fx = Fixtures(spark, SF)
    few = flows.retrain(fx.incidents_monthly.limit(10), kind="risk")
    assert few.summary.first()["status"] == "failed" and "min_rows" in few.summary.first()["errors"] and few.model is None
    # the monthly view has no hours: every district gets the same level, and nothing is trained on that
    one = flows.retrain(fx.incidents_monthly, kind="risk", class_map=CLASS_MAP)
    assert one.summary.first()["errors"] == "single_class" and one.model is None and one.summary.first()["risk_accuracy"] is None


def test_upload_and_retrain(spark, tmp_path):
    from wardstat.sources import io as IO

    fx = Fixtures(spark, SF)
    raw = fx.incidents_raw.withColumnsRenamed({"date_text": "Date", "district_text": "District", "type_text": "Crime_Type"})
    raw.write.option("header", True).csv(str(tmp_path / "up"))
    (tmp_path / "up" / "_SUCCESS").unlink()
    summary, done = flows.upload_and_retrain(spark, str(tmp_path / "up"), str(tmp_path / "pub"), str(tmp_path / "m"), kind="risk", dim=fx.district_dim, class_map=CLASS_MAP)
    s = summary.first()
    assert s["original_records"] == raw.count() and s["duplicates_removed"] == 1000 and s["version"] == IO.current_version(spark, str(tmp_path / "pub"))
    current = IO.read_current(spark, str(tmp_path / "pub"))
    assert current.where("crime_type = 'General Crime'").count() > 0 and current.where("ts is null").count() == 0
    assert done.summary.first()["status"] in ("ok", "failed")


def test_views_keep_every_order(spark):
    """Orders after any date stay in counts, and only an unfinished last month leaves the series."""
    from wardstat.operators import series as S

    fx = Fixtures(spark, SF)
    m = fx.incidents_monthly
    assert m.count() == fx.table("orders").count()
    counts = S.monthly_counts(m)
    left = S.unfinished_month(counts).agg(F.sum("crime_count")).first()[0] or 0
    assert S.complete_months(counts).agg(F.sum("crime_count")).first()[0] + left == m.count()


def test_risk_request_rule_and_model(spark):
    fx = Fixtures(spark, SF)
    feats = RK.risk_features(fx.incidents_hourly, fx.district_dim, CLASS_MAP)
    rule = flows.risk_request(feats).collect()
    model = RK.train_risk(feats, num_trees=10)
    ml = flows.risk_request(feats, model, accuracy=1.0).collect()
    assert len(rule) == len(ml) == 40
    cols = {"risk_level", "confidence", "probabilities", "model_accuracy"}
    assert cols <= set(rule[0].asDict()) and cols <= set(ml[0].asDict())
