"""Autoregressions of selected order against numpy on hand series."""

import numpy as np
import pytest

from pyspark.sql import functions as F
from wardstat.operators import autoregress as AR
from wardstat.operators import forecast as FC


def series(spark, by):
    rows = [(d, t + 1, float(v)) for d, ys in by.items() for t, v in enumerate(ys)]
    s = spark.createDataFrame(rows, "district string, t int, y double")
    return s.withColumn("month", F.add_months(F.lit("2001-01-01").cast("date"), F.col("t") - 1))


def simulated(seed, n, phi, d=0, mean=50.0):
    rng = np.random.default_rng(seed)
    e = [0.0] * 30
    for _ in range(n + 100):
        e.append(sum(p * e[-1 - j] for j, p in enumerate(phi)) + rng.normal())
    w = np.array(e[-n:]) + (mean if d == 0 else 0.3)
    for _ in range(d):
        w = np.cumsum(w)
    return w


def numpy_fit(y, max_p=12):
    """Order by plain Yule-Walker solves: (aicc, d, p, phi)."""
    out = []
    for d in range(3):
        w = np.diff(y, d) if d else np.asarray(y)
        w = w[len(w) - (len(y) - 2) :]
        n, e = len(w), w - w.mean()
        r = np.array([(e[k:] * e[: n - k]).sum() / n for k in range(max_p + 1)])
        for p in range(max_p + 1):
            phi = np.linalg.solve([[r[abs(i - j)] for j in range(p)] for i in range(p)], r[1 : p + 1]) if p else np.array([])
            v = r[0] - (phi * r[1 : p + 1]).sum()
            out.append((n * np.log(v) + 2 * (p + 2) * n / (n - p - 3), d, p, phi, w.mean(), e))
    return min(out, key=lambda o: o[:3])


def ahead(y, fit, h):
    _, d, p, phi, mean, e = fit
    e, levels, dy = list(e), [y[-1]], y[-1] - y[-2]
    for _ in range(h):
        e.append(sum(phi[j] * e[-1 - j] for j in range(p)))
        w = mean + e[-1]
        dy = dy + w if d == 2 else w
        levels.append(w if d == 0 else levels[-1] + dy)
    return levels[1:]


KNOWN = {"ar2": (11, 400, [0.5, 0.35], 0), "walk": (7, 400, [0.6], 1), "twice": (3, 400, [0.5], 2), "noise": (5, 300, [], 0), "ar12": (9, 500, [0.3] + [0.0] * 10 + [0.5], 0)}


def test_known_orders_are_found(spark):
    by = {name: simulated(*args) for name, args in KNOWN.items()}
    frame = FC.horizon_frame(series(spark, by), 9)
    got = {r["district"]: r for r in AR.paths(frame).collect()}
    for name, (_, _, phi, d) in KNOWN.items():
        want = numpy_fit(by[name])
        ar = got[name]["ar"]
        assert (ar["d"], ar["p"]) == (want[1], want[2])
        assert ar["phi"] == pytest.approx(want[3].tolist(), abs=1e-8)
        assert ar["aicc"] == pytest.approx(want[0], rel=1e-9)
        assert got[name]["arima"] == pytest.approx(ahead(by[name], want, 9), rel=1e-8)
        assert ar["d"] == d and ar["p"] >= len(phi)
    assert got["ar2"]["ar"]["p"] == 2 and got["walk"]["ar"]["p"] == 1 and got["ar12"]["ar"]["p"] == 12


def test_seasonal_coefficients_are_least_squares(spark):
    rng = np.random.default_rng(2)
    y = 100 + 20 * np.sin(np.arange(120) * np.pi / 6) + np.cumsum(rng.normal(size=120))
    row = AR.paths(FC.horizon_frame(series(spark, {"a": y}), 14)).collect()[0]
    z = y[12:] - y[:-12]
    x = np.column_stack([z[12:-1], z[1:-12], z[:-13], np.ones(len(z) - 13)])
    want = np.linalg.lstsq(x, z[13:], rcond=None)[0]
    assert row["seasonal"] == pytest.approx(want.tolist(), rel=1e-6, abs=1e-8)
    z, level = list(z), list(y)
    for _ in range(14):
        z.append(want[0] * z[-1] + want[1] * z[-12] + want[2] * z[-13] + want[3])
        level.append(level[-12] + z[-1])
    assert row["sarima"] == pytest.approx(level[-14:], rel=1e-6)


def test_constant_short_and_periodic_series(spark):
    season = [10.0, 12, 9, 4, 5, 6, 20, 22, 19, 14, 15, 16]
    by = {"constant": [7.0] * 30, "line": [3.0 * t for t in range(30)], "periodic": season * 5, "short": [1.0] * 20, "brief": season * 2}
    got = {r["district"]: r for r in AR.paths(FC.horizon_frame(series(spark, by), 5)).collect()}
    assert set(got) == {"constant", "line", "periodic", "brief"}  # 20 months aren't eligible
    assert (got["constant"]["ar"]["d"], got["constant"]["ar"]["p"]) == (0, 0) and got["constant"]["arima"] == [7.0] * 5
    assert (got["line"]["ar"]["d"], got["line"]["ar"]["p"]) == (1, 0) and got["line"]["arima"] == pytest.approx([90, 93, 96, 99, 102])
    assert got["periodic"]["sarima"] == pytest.approx(season[:5])
    assert got["brief"]["sarima"] == season[:5]  # too short to fit: the season again


def test_solve_drops_spanned_columns(spark):
    a = [[4.0, 2.0, 6.0], [2.0, 5.0, 7.0], [6.0, 7.0, 13.0]]  # the third is the sum of the others
    b = [10.0, 9.0, 19.0]
    lit = lambda m: F.array(*[F.array(*map(F.lit, r)) for r in m])
    got = spark.range(1).select(AR.cholesky_solve(lit(a), F.array(*map(F.lit, b)), 3).alias("x")).first()["x"]
    assert got[2] == 0.0 and np.allclose(np.array(a) @ got, b)
    spd = np.array([[5.0, 1, 0.5, 0], [1, 4, 0.3, 1], [0.5, 0.3, 3, 0.2], [0, 1, 0.2, 6]])
    got = spark.range(1).select(AR.cholesky_solve(lit(spd.tolist()), F.array(*[F.lit(float(i)) for i in range(4)]), 4).alias("x")).first()["x"]
    assert got == pytest.approx(np.linalg.solve(spd, range(4)).tolist())


def test_scores_are_those_of_the_forecasts(spark):
    by = {n: simulated(*KNOWN[n])[:90] for n in ("ar2", "walk")}
    s = series(spark, by)
    frame = FC.backtest_frame(s)
    rows = {(r["district"], r["model"], r["t"]): r["yhat"] for r in AR.forecast_orders(frame).collect()}
    for r in AR.backtest_orders(s).collect():
        errors = [by[r["district"]][t - 1] - rows[(r["district"], r["model"], t)] for t in range(73, 91)]
        assert r["n_test"] == 18 and r["mae"] == pytest.approx(np.abs(errors).mean()) and r["rmse"] == pytest.approx(np.sqrt(np.square(errors).mean()))


def test_one_exchange_no_join_no_python(spark):
    s = series(spark, {"a": simulated(1, 60, [0.5])})
    plan = AR.backtest_orders(s.repartition(3))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Python" not in plan and "Arrow" not in plan
