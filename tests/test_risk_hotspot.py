"""Risk rule (M8-M11), forest (M12-M14, A25), hotspots (A27-A29), normalise."""

import pytest
from pyspark.sql import functions as F

from wardstat import constants as K
from wardstat.operators import hotspot as HS
from wardstat.operators import risk as RK
from wardstat.sources.views import CLASS_MAP


def _feat(spark, **kw):
    cols = [n for n, _ in K.RISK_FEATURES]
    row = tuple(None if kw.get(c) is None else float(kw[c]) for c in cols)
    return spark.createDataFrame([("d",) + row], "district string, " + ", ".join(f"{c} double" for c in cols))


def test_rule_defaults_give_medium(spark):
    r = RK.rule_risk(_feat(spark)).first()
    assert r["risk_score"] == pytest.approx(0.435)
    assert r["risk_level"] == "Medium" and r["confidence"] == pytest.approx(0.84)
    p = r["probabilities"]
    assert (p["High"], p["Medium"], p["Low"]) == pytest.approx((0.3 / 1.1, 0.6 / 1.1, 0.2 / 1.1))
    assert sum(p.values()) == pytest.approx(1.0)


def test_rule_caps_give_high(spark):
    r = RK.rule_risk(_feat(spark, total_crimes=200, crime_rate=20, violent_crimes=100, evening_crimes_pct=50, night_crimes_pct=30)).first()
    assert r["risk_score"] == pytest.approx(0.90) and r["risk_level"] == "High"


def test_rule_zero_total_is_null_with_reason(spark):
    r = RK.rule_risk(_feat(spark, total_crimes=0)).first()
    assert r["risk_score"] is None and r["risk_level"] is None
    assert r["reject_reason"]


def test_low_band_probabilities(spark):
    r = RK.rule_risk(_feat(spark, total_crimes=10, crime_rate=1, violent_crimes=0, evening_crimes_pct=0, night_crimes_pct=0)).first()
    assert r["risk_level"] == "Low"
    assert r["probabilities"]["Low"] == pytest.approx(0.8 / 1.1)


def test_features_on_fixture(spark, fx):
    f = RK.risk_features(fx.incidents_hourly, fx.district_dim, CLASS_MAP)
    rows = f.collect()
    assert len(rows) == fx.incidents_hourly.select("district").distinct().count()
    for r in rows:
        assert r["violent_crimes"] + r["property_crimes"] + r["drug_crimes"] <= r["total_crimes"]
        assert 0 <= r["night_crimes_pct"] <= 100 and r["crime_rate"] > 0


def test_forest_and_metrics(spark):
    from wardstat.sources.views import Fixtures

    fx = Fixtures(spark, "/root/testdata/sf0.01")
    feats = RK.risk_features(fx.incidents_hourly, fx.district_dim, CLASS_MAP)
    model = RK.train_risk(feats, num_trees=20)
    pred = RK.predict_risk(model, feats).collect()
    assert len(pred) == 40
    for r in pred:
        assert sum(r["probabilities"].values()) == pytest.approx(1.0)
        assert r["confidence"] == pytest.approx(max(r["probabilities"].values()))
    imp = RK.feature_importance(spark, model).collect()
    assert len(imp) == 8 and sum(r["importance"] for r in imp) == pytest.approx(1.0)
    assert [r["importance"] for r in imp] == sorted((r["importance"] for r in imp), reverse=True)
    lab = model.transform(RK.labelled(feats).select("district", *RK.FEATURES, "risk_level"))
    m = RK.classification_metrics(lab).first()
    assert 0 <= m["accuracy"] <= 1 and 0 <= m["f1"] <= 1


def test_classification_metrics_hand(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 1.0)], "label double, prediction double")
    m = RK.classification_metrics(df).first()
    assert m["accuracy"] == pytest.approx(0.75)
    # class 0: p=1, r=.5 ; class 1: p=2/3, r=1 ; support 2/2
    assert m["precision"] == pytest.approx((1 + 2 / 3) / 2)
    assert m["recall"] == pytest.approx(0.75)


def test_hotspot_levels(spark):
    rows = [("A", 28.0, 77.0)] * 150 + [("B", 28.5, 77.5)] * 95 + [("C", 29.0, 78.0)] * 10
    df = spark.createDataFrame(rows, "district string, latitude double, longitude double")
    got = {r["name"]: (r["crimes"], r["risk"], r["colour"], r["radius"]) for r in HS.hotspots(df).collect()}
    assert got == {"A": (150, "High", "red", 3000), "B": (95, "Medium", "orange", 1900), "C": (10, "Low", "green", 200)}


def test_region_totals_rollup(spark, fx):
    out = HS.region_totals(fx.incidents_hourly)
    total = fx.incidents_hourly.count()
    assert out.where(F.col("level") == "all").first()["crimes"] == total
    assert out.where(F.col("level") == "state").agg(F.sum("crimes")).first()[0] == total


def test_normalise(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "k string, v double")
    got = sorted((r["k"], r["v"]) for r in RK.normalise(df, "k", "v").collect())
    assert got == [("a", 0.25), ("a", 0.75), ("b", 1.0)]
    odd = spark.createDataFrame([(None, 1.0), (None, 1.0), ("z", 0.0)], "k string, v double")
    assert sorted((str(r["k"]), str(r["v"])) for r in RK.normalise(odd, "k", "v").collect()) == [("None", "0.5"), ("None", "0.5"), ("z", "None")]


def test_importance_map_is_in_both_risk_results(spark):
    from wardstat.sources.views import CLASS_MAP, Fixtures

    fx = Fixtures(spark, "/root/testdata/sf0.01")  # several classes: the forest splits
    feats = RK.risk_features(fx.incidents_hourly, fx.district_dim, CLASS_MAP)
    rule = RK.rule_risk(feats).first()["feature_importance"]
    assert set(rule) == set(RK.FEATURES) and sum(rule.values()) == pytest.approx(1.0) and rule["weekend_crimes_pct"] == 0
    model = RK.train_risk(feats, num_trees=5)
    ml = RK.predict_risk(model, feats).first()["feature_importance"]
    assert set(ml) == set(RK.FEATURES) and sum(ml.values()) == pytest.approx(1.0)
    ranked = [(r["position"], r["importance"]) for r in RK.feature_importance(spark, model).collect()]
    assert [p for p, _ in sorted(ranked)] == list(range(1, 9)) and [v for _, v in sorted(ranked)] == sorted((v for _, v in ranked), reverse=True)


def test_forest_does_not_depend_on_the_partitioning(spark, fx):
    from wardstat.sources.views import CLASS_MAP

    feats = RK.risk_features(fx.incidents_hourly, fx.district_dim, CLASS_MAP)
    got = []
    for n in ("4", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            model = RK.train_risk(feats.repartition(int(n)), num_trees=10)
            got.append({r["district"]: r["confidence"] for r in RK.predict_risk(model, feats).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got[0] == got[1]
