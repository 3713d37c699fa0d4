"""Series windows and forecasts: hand rows, brute-force recursions and invariants."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from wardstat.operators import forecast as FC
from wardstat.operators import series as S


def _series(spark, values_by_district):
    data = []
    for d, values in values_by_district.items():
        for i, v in enumerate(values):
            data.append((d, dt.date(2000 + i // 12, i % 12 + 1, 1), float(v)))
    counts = spark.createDataFrame(data, "district string, month date, crime_count double")
    return S.densify(counts)


def _wavy(n, a=20.0, b=0.3, seed=1):
    # deterministic non-trivial series: trend + season + a little structure
    return [a + b * t + 5 * math.sin(2 * math.pi * t / 12) + ((t * 7 + seed) % 5) for t in range(n)]


def test_split_sizes_and_eligibility(spark):
    s = _series(spark, {"a": _wavy(24), "b": _wavy(25), "c": _wavy(79), "d": _wavy(23)})
    got = {r["district"]: r["n_train"] for r in S.split_series(S.eligible_series(s)).select("district", "n_train").distinct().collect()}
    assert got == {"a": 19, "b": 20, "c": 63}


def test_densify_fills_gaps_with_zero(spark):
    counts = spark.createDataFrame(
        [("a", dt.date(2020, 1, 1), 3), ("a", dt.date(2020, 4, 1), 5)], "district string, month date, crime_count long"
    )
    got = [(r["t"], r["month"], r["y"]) for r in S.densify(counts).orderBy("t").collect()]
    assert got == [(1, dt.date(2020, 1, 1), 3.0), (2, dt.date(2020, 2, 1), 0.0), (3, dt.date(2020, 3, 1), 0.0), (4, dt.date(2020, 4, 1), 5.0)]


def test_fit_guard(spark):
    const = spark.createDataFrame([("a", 1.0, 4.0), ("a", 1.0, 6.0)], "district string, x double, y double")
    phi, c = FC.guarded_fit("y", "x")
    r = const.groupBy("district").agg(phi.alias("phi"), c.alias("c")).first()
    assert (r["phi"], r["c"]) == (0.0, 5.0)
    pts = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 5.0), ("a", 1.0, 2.0)], "district string, x double, y double")
    r = pts.groupBy("district").agg(phi.alias("phi"), c.alias("c")).first()
    assert r["phi"] == pytest.approx(1.5) and r["c"] == pytest.approx(0.5)


def _ar_fit(y, x):
    pairs = [(a, b) for a, b in zip(y, x) if a is not None and b is not None]
    n = len(pairs)
    mx = sum(b for _, b in pairs) / n
    my = sum(a for a, _ in pairs) / n
    sxx = sum((b - mx) ** 2 for _, b in pairs)
    if sxx <= 0:
        return 0.0, my
    phi = sum((b - mx) * (a - my) for a, b in pairs) / sxx
    return phi, my - phi * mx


def test_m1_closed_form_equals_step_recursion(spark):
    ys = {"a": _wavy(40, seed=2), "b": _wavy(30, a=50, b=-0.4, seed=3)}
    frame = FC.backtest_frame(_series(spark, ys))
    got = {(r["district"], r["k"]): r["yhat"] for r in FC.forecast_ar_diff(frame, 1).collect()}
    for d, y in ys.items():
        n = len(y)
        T = int(n * 0.8)
        dy = [None] + [y[i] - y[i - 1] for i in range(1, n)]
        dy1 = [None] + dy[:-1]
        phi, c = _ar_fit(dy[:T], dy1[:T])
        level, last = y[T - 1], dy[T - 1]
        for k in range(1, n - T + 1):
            last = c + phi * last
            level += last
            assert got[(d, k)] == pytest.approx(level, rel=1e-9, abs=1e-9)


def test_m2_closed_form_equals_step_recursion(spark):
    ys = {"a": _wavy(40, seed=4), "b": _wavy(60, a=30, b=0.1, seed=5)}
    frame = FC.backtest_frame(_series(spark, ys))
    got = {(r["district"], r["k"]): r["yhat"] for r in FC.forecast_seasonal(frame).collect()}
    for d, y in ys.items():
        n = len(y)
        T = int(n * 0.8)
        z = [None] * 12 + [y[i] - y[i - 12] for i in range(12, n)]
        z1 = [None] + z[:-1]
        phi, c = _ar_fit(z[:T], z1[:T])
        hist = list(y[:T])
        zl = z[T - 1]
        for k in range(1, n - T + 1):
            zl = c + phi * zl
            hist.append(hist[-12] + zl)
            assert got[(d, k)] == pytest.approx(hist[-1], rel=1e-9, abs=1e-9)


def test_backtest_invariants_and_best_model(spark):
    ys = {"a": _wavy(36, seed=6), "b": _wavy(48, seed=7)}
    series = _series(spark, ys)
    scores = FC.backtest(series).collect()
    assert {(r["district"], r["model"]) for r in scores} == {(d, m) for d in ys for m in ("arima", "sarima")}
    for r in scores:
        assert r["rmse"] == pytest.approx(math.sqrt(r["mse"]))
        assert r["rmse"] >= r["mae"] - 1e-12
    best = {r["district"]: r for r in FC.best_model(FC.backtest(series)).collect()}
    for d in ys:
        assert best[d]["best_mae"] == min(r["mae"] for r in scores if r["district"] == d)


def test_best_model_tie_goes_to_first(spark):
    scores = spark.createDataFrame(
        [("x", "lstm", 2.0), ("x", "sarima", 2.0), ("x", "arima", 2.0), ("y", "arima", 2.0), ("y", "sarima", 1.0), ("y", "lstm", 3.0)],
        "district string, model string, mae double",
    )
    got = {r["district"]: r["best_model"] for r in FC.best_model(scores).collect()}
    assert got == {"x": "arima", "y": "sarima"}
    sel = {r["district"]: r for r in FC.model_selection(scores).collect()}
    assert sel["y"]["selection_note"] == "SARIMA selected with MAE of 1.00"
    assert sel["x"]["all_models_mae"] == {"arima": 2.0, "lstm": 2.0, "sarima": 2.0}


def test_forecast_table_shape_and_clamp(spark):
    ys = {"a": _wavy(36, seed=8), "b": [0.0] * 30}
    tab = FC.forecast_table(_series(spark, ys), 6)
    rows = tab.collect()
    assert len(rows) == 12
    assert all(r["arima"] >= 0 and r["sarima"] >= 0 for r in rows)
    months = sorted(r["month"] for r in rows if r["district"] == "a")
    assert months[0] == dt.date(2003, 1, 1) and months[-1] == dt.date(2003, 6, 1)


def test_select_order_picks_lower_mae(spark):
    ys = {"trend": [float(t * t) for t in range(40)], "flat": [10.0 + (t % 2) for t in range(40)]}
    got = {r["district"]: r for r in FC.select_order(_series(spark, ys)).collect()}
    assert got["trend"]["d"] == 1
    assert got["trend"]["mae_d1"] <= got["trend"]["mae_d0"]


def test_lag_gbt_rolls_forward(spark):
    ys = {"a": _wavy(40, seed=9), "b": _wavy(40, a=60, seed=10)}
    frame = FC.backtest_frame(_series(spark, ys))
    out = FC.forecast_lag_gbt(frame, max_iter=5).collect()
    assert len(out) == 2 * (40 - 32)
    assert all(r["yhat"] is not None and math.isfinite(r["yhat"]) for r in out)
    assert {r["k"] for r in out} == set(range(1, 9))


def test_window_scores_equal_forecast_join_path(spark):
    # the one-pass window scoring must give what explicit forecasts + alignment give
    s = _series(spark, {"a": _wavy(30), "b": _wavy(79, 40.0, -0.2, 3), "c": [5.0] * 26, "d": _wavy(24, seed=2)})
    frame = FC.backtest_frame(s)
    fast = {(r["district"], r["model"]): r for r in FC.closed_form_scores(frame).collect()}
    fc = FC.run_models(frame, ("arima", "sarima"))
    slow = {(r["district"], r["model"]): r for r in FC.error_metrics(FC.align(frame.where("split = 'test'"), fc)).collect()}
    assert fast.keys() == slow.keys()
    for key, r in slow.items():
        assert fast[key]["n_test"] == r["n_test"]
        for m in ("mae", "mse", "rmse"):
            assert fast[key][m] == pytest.approx(r[m], rel=1e-9, abs=1e-9)


def _closed_form_horizon(frame, period=12):
    """M1 and M2 side by side from one aggregate (a second way to the same values)."""
    x = FC._closed_form_inputs(frame, period)
    at_fit = F.col("t") == F.col("t_fit")
    fit = x.groupBy("district").agg(
        *[e.alias(n) for n, e in FC._closed_form_fit_columns(period).items()],
        F.max("t_fit").alias("t_fit"), F.max("h_steps").alias("h_steps"), F.max(F.when(at_fit, F.col("month"))).alias("m_end"),
    )
    yhats = [e.alias(m) for m, e in FC._closed_form_yhats(F.col("k"), period).items()]
    return FC._steps(fit).select("district", "k", F.add_months(F.col("m_end"), F.col("k")).alias("month"), *yhats)


def _forecast_ar_selected(s, orders):
    """M1 in both orders, the chosen one kept by a join (a second way to the same values)."""
    f0 = FC.forecast_ar_diff(s, 0).withColumn("d", F.lit(0))
    f1 = FC.forecast_ar_diff(s, 1).withColumn("d", F.lit(1))
    return f0.unionByName(f1).join(orders.select("district", "d"), ["district", "d"], "inner")


def test_wide_horizon_equals_long_models(spark):
    s = _series(spark, {"a": _wavy(30), "b": _wavy(79, 40.0, -0.2, 3)})
    frame = FC.horizon_frame(s, 7)
    wide = {(r["district"], r["k"]): r for r in _closed_form_horizon(frame).collect()}
    long_ = FC.run_models(frame, ("arima", "sarima")).collect()
    assert len(wide) == 14 and len(long_) == 28
    for r in long_:
        w = wide[(r["district"], r["k"])]
        assert w["month"] == r["month"]
        assert w[r["model"]] == pytest.approx(r["yhat"], rel=1e-9, abs=1e-9)


def test_one_pass_forecast_table_equals_join_path(spark):
    s = _series(spark, {"a": _wavy(30), "b": _wavy(79, 40.0, -0.2, 3), "c": [5.0] * 26})
    fast = {(r["district"], r["k"]): r for r in FC.closed_form_forecast_table(s, 6).collect()}
    wide = {(r["district"], r["k"]): r for r in _closed_form_horizon(FC.horizon_frame(s, 6)).collect()}
    best = {r["district"]: r["best_model"] for r in FC.best_model(FC.backtest(s)).collect()}
    assert fast.keys() == wide.keys() and len(fast) == 18
    for key, r in fast.items():
        assert r["best_model"] == best[key[0]]
        for m in ("arima", "sarima"):
            assert r[m] == pytest.approx(max(0.0, wide[key][m]), rel=1e-9, abs=1e-9)
        assert r["best_value"] == r[r["best_model"]]


def test_window_scores_short_series_drop_seasonal_like_join_path(spark):
    # 14 points -> 11 train points: no full season before t_fit, so M2 gives no rows
    s = _series(spark, {"a": _wavy(14), "b": _wavy(40, seed=4)})
    frame = FC.backtest_frame(s, min_points=10)
    fast = {(r["district"], r["model"]): r for r in FC.closed_form_scores(frame).collect()}
    fc = FC.run_models(frame, ("arima", "sarima"))
    slow = {(r["district"], r["model"]): r for r in FC.error_metrics(FC.align(frame.where("split = 'test'"), fc)).collect()}
    assert fast.keys() == slow.keys() and ("a", "sarima") not in fast
    for key, r in slow.items():
        assert fast[key]["n_test"] == r["n_test"]
        assert fast[key]["mae"] == pytest.approx(r["mae"], rel=1e-9, abs=1e-9)


def test_auto_order_equals_select_then_forecast(spark):
    s = _series(spark, {"a": _wavy(30), "b": [10.0 + 3 * t for t in range(40)], "c": _wavy(79, 40.0, -0.2, 3)})
    frame = FC.backtest_frame(s)
    fast = {(r["district"], r["k"]): r for r in FC.forecast_ar_auto_order(frame).collect()}
    slow = _forecast_ar_selected(frame, FC.select_order(s)).collect()
    assert len(fast) == len(slow) > 0
    for r in slow:
        f = fast[(r["district"], r["k"])]
        assert (f["d"], f["t"], f["month"]) == (r["d"], r["t"], r["month"])
        assert f["yhat"] == pytest.approx(r["yhat"], rel=1e-9, abs=1e-9)


def test_best_model_window_equals_aggregate(spark):
    from wardstat.operators import charts as CH

    rows = [("a", "arima", 2.0), ("a", "sarima", 2.0), ("a", "lstm", 3.0),  # tie -> arima
            ("b", "arima", float("nan")), ("b", "sarima", 1.5),              # NaN ignored
            ("c", "arima", None), ("c", "sarima", 4.0), ("c", "lstm", 1.0),  # NULL ignored
            ("d", "arima", None)]                                           # no valid score
    scores = spark.createDataFrame(rows, "district string, model string, mae double")
    agg = {r["district"]: r["best_model"] for r in FC.best_model(scores).collect()}
    flags = {(r["district"], r["model"]): r["is_best"] for r in CH.model_performance_rows(scores).collect()}
    assert agg == {"a": "arima", "b": "sarima", "c": "lstm"}
    for (d, m), is_best in flags.items():
        assert is_best == (None if d == "d" else agg[d] == m)


def test_a_model_without_a_score_is_never_selected(spark):
    rows = [("a", "arima", None), ("a", "sarima", 2.0), ("b", "arima", float("nan")), ("b", "sarima", 1.0), ("c", "arima", None)]
    sel = {r["district"]: r for r in FC.model_selection(spark.createDataFrame(rows, "district string, model string, mae double")).collect()}
    assert (sel["a"]["best_model"], sel["a"]["best_model_mae"], sel["a"]["selection_note"]) == ("sarima", 2.0, "SARIMA selected with MAE of 2.00")
    assert (sel["b"]["best_model"], sel["b"]["best_model_mae"]) == ("sarima", 1.0)
    assert sel["c"]["best_model"] is None and sel["c"]["best_model_mae"] is None


def test_best_prediction_is_clamped(spark):
    fc = spark.createDataFrame([("a", "arima", 1, None, -3.0), ("a", "sarima", 1, None, 5.0)], "district string, model string, k int, month date, yhat double")
    best = spark.createDataFrame([("a", "arima")], "district string, best_model string")
    assert [r["best_value"] for r in FC.best_prediction(fc, best).collect()] == [0.0]


def test_an_unfinished_last_month_is_left_out_and_reported(spark):
    import datetime as dt

    def table(last):
        days = [(d, dt.date(2024, 1, 1) + dt.timedelta(days=7 * k)) for k in range(12) for d in ("x", "y")]
        return spark.createDataFrame([*days, ("x", last)], "district string, ts date")

    from wardstat.operators import series as S

    counts = S.monthly_counts(table(dt.date(2024, 4, 2)))
    assert {r["month"].month for r in S.complete_months(counts).collect()} == {1, 2, 3}
    left = S.unfinished_month(counts).collect()
    assert [(r["district"], r["month"], r["crime_count"], r["last_date"]) for r in left] == [("x", dt.date(2024, 4, 1), 1, dt.date(2024, 4, 2))]
    whole = S.monthly_counts(table(dt.date(2024, 4, 30)))
    assert {r["month"].month for r in S.complete_months(whole).collect()} == {1, 2, 3, 4} and S.unfinished_month(whole).count() == 0
    assert counts.agg(F.sum("crime_count")).first()[0] == 25  # the counts themselves keep every row


def test_three_model_table(spark, monkeypatch):
    """M3 is fitted twice for a request (hold-out and full history), and the other columns are as without it."""
    from wardstat.plans import flows

    s = _series(spark, {"a": _wavy(30), "b": _wavy(48, 40.0, -0.2, 3)})
    fits = []
    real = FC.fit_lag_gbt
    monkeypatch.setattr(FC, "fit_lag_gbt", lambda *a, **b: (fits.append(1), real(*a, **b))[1])
    monkeypatch.setattr(flows, "monthly_series_for", lambda df, district: df)
    table, scores, selection = flows.forecast_request(s, "all", 6)
    rows = table.collect()
    assert len(fits) == 2 and len(rows) == 12
    maes = {(r["district"], r["model"]): r["mae"] for r in scores.collect()}
    two = {(r["district"], r["k"]): r for r in FC.forecast_table(s, 6).collect()}
    for r in rows:
        own = {m: maes[(r["district"], m)] for m in ("arima", "sarima", "lstm")}
        assert r["best_model"] == min(own, key=own.get) and r["best_value"] == r[r["best_model"]]
        assert all(r[m] >= 0 for m in own) and r["month"] == r["date"][:7]
        for m in ("arima", "sarima"):
            assert r[m] == pytest.approx(two[(r["district"], r["k"])][m], rel=1e-9, abs=1e-9)
    assert {r["best_model"] for r in selection.collect()} <= {"arima", "sarima", "lstm"}


def test_lag_model_does_not_depend_on_the_partitioning(spark):
    s = _series(spark, {"a": _wavy(30), "b": _wavy(36, 40.0, -0.2, 3), "c": _wavy(33, 9.0, 0.1, 5)})
    frame = FC.horizon_frame(s, 4)
    got = []
    for n in ("4", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            fc = FC.forecast_lag_gbt(frame.repartition(int(n), "district"), max_iter=3)
            got.append({(r["district"], r["k"]): r["yhat"] for r in fc.collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got[0].keys() == got[1].keys() and len(got[0]) == 12
    assert all(got[0][k] == pytest.approx(got[1][k], rel=1e-9) for k in got[0])
